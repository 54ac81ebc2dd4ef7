"""All places of many words in many texts, by one automaton that goes through all texts in step."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Characters of a piece of text. Pieces go through the automaton side by side.
PIECE = 512
#: Characters that go through at a time.
AT_ONCE = 1 << 21


class Automaton:
    """The words as an automaton of arrays: `go[state, sign]`, and for each state the words that end there.

    Signs are the characters of the words; all others are one, which leads back to the beginning. A state's failure (the longest of its ends that
    begins a word) is worked into the table when it is built, so a step is one look-up.
    """

    def __init__(self, words: list[str]):
        if not all(words):
            raise ValueError("an empty word stands everywhere")
        self.words, self.longest = words, max(map(len, words), default=1)
        signs = sorted({c for w in words for c in w})
        self.sign_of = np.zeros(0x110000, np.int32)  # 0 for what is in no word
        self.sign_of[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        sign = {c: k + 1 for k, c in enumerate(signs)}
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, word in enumerate(words):
            at = 0
            for c in word:
                if sign[c] not in children[at]:
                    children[at][sign[c]] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][sign[c]]
            ends[at].append(k)
        self.go = np.zeros((len(children), len(signs) + 1), np.int32)
        fail, queue = [0] * len(children), deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.go[at] = self.go[fail[at]]
            for s, child in children[at].items():
                fail[child] = int(self.go[at, s]) if at else 0
                self.go[at, s] = child
                ends[child] += ends[fail[child]]
                queue.append(child)
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.ends = np.array([k for e in ends for k in e], np.int64)
        self.lengths = np.array(list(map(len, words)), np.int64)

    def signs(self, text: str) -> np.ndarray:
        """Each character's sign, 0 for those in no word; one more 0 ends the text."""
        out = self.sign_of[np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
        out[-1] = 0
        return out

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, start) of every place of every word, overlapping ones too, by text and end."""
        found: list[tuple[np.ndarray, ...]] = []
        held, size, begun = [], 0, 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text) + 1
            if size > AT_ONCE or k == len(texts) - 1:
                found.append(self._find(held, begun))
                held, size, begun = [], 0, k + 1
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))

    def _find(self, texts: list[str], begun: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        signs = np.concatenate([self.signs(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        n, ahead = len(signs), self.longest - 1
        # Each piece begins as many characters early as a word may reach back, so its own places are all told, and once.
        padded = np.concatenate([np.zeros(ahead, np.int32), signs, np.zeros(-n % PIECE, np.int32)])
        pieces = (n + PIECE - 1) // PIECE
        rows = np.lib.stride_tricks.sliding_window_view(padded, PIECE + ahead)[::PIECE][:pieces]
        state, out = np.zeros(pieces, np.int64), np.empty((PIECE, pieces), np.int64)
        width = self.go.shape[1]
        flat, columns = self.go.ravel().astype(np.int64) * width, np.ascontiguousarray(rows.T)  # states as where their rows begin
        for t in range(PIECE + ahead):
            state = flat[state + columns[t]]
            if t >= ahead:
                out[t - ahead] = state
        reached = out.T.ravel()[:n] // width
        counts = (self.first[1:] - self.first[:-1])[reached]
        at = np.flatnonzero(counts)
        each = counts[at]
        place = np.repeat(at, each)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
        word = self.ends[self.first[reached[place]] + inner]
        text = np.searchsorted(starts, place, side="right") - 1
        return text + begun, word, place - starts[text] + 1 - self.lengths[word]
