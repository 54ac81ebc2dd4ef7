"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words; decoding concatenates binary pieces."""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

#: Bytes of a word that the fold takes, so that a bit for each place, and one for words out of order, fit a number. Longer ones are merged by a heap.
LONG = 62
#: New words of one text that the fold takes, which bounds a row; bytes of new words that are handed on, and looked at, at a time.
MOST, AT_ONCE = 1 << 19, 1 << 18
#: Words that a task numbers before it begins anew.
REMEMBERED = 1_000_000


def ranks_of(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank on each line) by rank, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [base64.b64decode(a) for a, b in sorted(pairs, key=lambda p: int(p[1]))]
    if sorted(int(b) for _, b in pairs) != list(range(len(pairs))) or len({t for t in tokens if len(t) == 1}) < 256:
        raise ValueError(f"{path} must hold ranks from 0 without gaps, and every single byte")
    return tokens


# Words


@lru_cache(maxsize=8)
def class_ranges(of: str) -> list[tuple[int, int]]:
    """Ranges of code points that the tokenizer library counts to a class (its Unicode version is not the platform's)."""
    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = bytes(tiktoken.Encoding("class", pat_str=of, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
    points = np.fromiter(map(ord, found), np.int64, len(found))
    last = np.flatnonzero(np.diff(points, append=points[-1] + 2) != 1)
    first = np.concatenate([[0], last[:-1] + 1])
    return [(int(points[a]), int(points[b])) for a, b in zip(first, last)]


def _written(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Splitter:
    """Cuts a text into the matches of a pattern, in which \\p{L}, \\p{N} and \\s are the library's classes.

    The classes are written out for the basic plane. A text with further characters is cut by a copy in which each of those
    is a stand-in of its class.
    """

    def __init__(self, pattern: str):
        low, high = [], []
        for of in (r"\p{L}", r"\p{N}", r"\s"):
            ranges = class_ranges(of)
            low.append(_written([(a, min(b, 0xFFFF)) for a, b in ranges if a <= 0xFFFF]))
            high.append(_written([(max(a, 0x10000), b) for a, b in ranges if b > 0xFFFF]))
        letters, numbers, blanks = low
        negated = re.sub(r"\[\^([^\]]*)\]", lambda m: "[^" + m[1].replace(r"\s", blanks).replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + "]", pattern)
        self.pattern = negated.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")
        self.high = high[:2]

    def __getstate__(self):
        return {"pattern": self.pattern, "high": self.high}

    def compiled(self) -> Callable[[str], list[str]]:
        cut, beyond = re.compile(self.pattern).findall, re.compile("[\U00010000-\U0010ffff]")
        high = [re.compile(f"[{ranges}]").sub for ranges in self.high]

        def words(text: str) -> list[str]:
            if not beyond.search(text):
                return cut(text)
            stand_in = beyond.sub("!", high[1]("1", high[0]("a", text)))
            return [text[m.start() : m.end()] for m in re.finditer(self.pattern, stand_in)]

        return words


# Merges


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


class Vocabulary(NamedTuple):
    """The tokens as a trie. Nodes are beginnings of tokens, by length and then by bytes; the first 256 are the bytes.

    pairs: the node of every two bytes, -1 for none. edges: node and next byte in one number, sorted; that at k leads to node 256 + k.
    token: a node's rank, -1 for none. Those who come early: splits of a token in two tokens of which one has a higher rank than the token itself, in
    splits[at[rank] : at[rank + 1]], as where the second part starts, the higher rank, and where its part starts.
    """

    pairs: np.ndarray
    edges: np.ndarray
    token: np.ndarray
    at: np.ndarray
    splits: np.ndarray


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    tokens = ranks_of(path)
    ranks = {t: i for i, t in enumerate(tokens)}
    starts = sorted({t[:k] for t in tokens for k in range(1, len(t) + 1)}, key=lambda t: (len(t), t))
    node = {t: k for k, t in enumerate(starts)}
    edges = np.array([node[t[:-1]] << 8 | t[-1] for t in starts[256:]], np.int64)
    pairs = np.full(1 << 16, -1, np.int64)
    for t in starts[256:]:
        if len(t) > 2:
            break
        pairs[t[0] << 8 | t[1]] = node[t]
    splits, at = [], [0]
    for i, t in enumerate(tokens):
        for c in range(1, len(t)):
            if t[:c] in ranks and t[c:] in ranks:
                later, start = max((ranks[x] if len(x) > 1 else -1, k) for x, k in ((t[:c], 0), (t[c:], c)))
                if later > i:
                    splits.append((c, later, start))
        at.append(len(splits))
    return Vocabulary(pairs, edges, np.array([ranks.get(t, -1) for t in starts], np.int64), np.array(at), np.array(splits, np.int64).reshape(-1, 3))


def steps(words: list[bytes], of: Vocabulary) -> pa.ListArray:
    """For each word what its merges could be, in the order in which they would come: (span, ends) as bits of places, for every token in the word.

    A pair's rank is mostly above those of its parts, so pairs come up in the order of their ranks. Where a part has a higher rank than the pair,
    the pair would be due at once when the part comes up: a step with three ends there, whose span has the sign bit, tells such words.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat, word = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.repeat(np.arange(len(words)), size)
    start = np.arange(len(flat)) - (np.cumsum(size) - size)[word]
    left = size[word] - start
    at, n, told = np.flatnonzero(left >= 2), 2, []
    node = of.pairs[flat[at] << 8 | flat[at + 1]]
    while True:
        at, node = at[node >= 0], node[node >= 0]
        if not len(at):
            break
        is_token = of.token[node] >= 0
        told.append((at[is_token], of.token[node[is_token]], np.full(int(is_token.sum()), n)))
        n += 1
        at, node = at[left[at] >= n], node[left[at] >= n]
        key = node << 8 | flat[at + n - 1]
        k = np.minimum(np.searchsorted(of.edges, key), len(of.edges) - 1)
        node = np.where(of.edges[k] == key, k + 256, -1)
    at, token, n = (np.concatenate(x) for x in zip(*told)) if told else (np.empty(0, np.int64),) * 3
    one, first = np.uint64(1), start[at]
    a, b = one << first.astype(np.uint64), one << (first + n).astype(np.uint64)
    key, span, ends = word[at] << 28 | token << 7 | first << 1, (b - a) | b, a | b
    many = of.at[token + 1] - of.at[token]
    each = np.repeat(np.arange(len(token)), many)
    c, later, part = of.splits[np.arange(len(each)) - np.repeat(np.cumsum(many) - many - of.at[token], many)].T
    key = np.concatenate([key, word[at[each]] << 28 | later << 7 | first[each] + part << 1 | 1])
    span = np.concatenate([span, span[each] | one << np.uint64(63)])
    ends = np.concatenate([ends, ends[each] | one << (first[each] + c).astype(np.uint64)])
    order = np.argsort(key)
    each_word = np.bincount(key >> 28, minlength=len(words))
    return pa.ListArray.from_arrays(_offsets(each_word), pa.StructArray.from_arrays([pa.array(span[order].view(np.int64)), pa.array(ends[order].view(np.int64))], ["span", "ends"]))


def merged(whole: Column, steps: Column) -> Column:
    """Where a word's parts start and end, as bits: a fold over its steps, from all places on. Two neighbours are joined where the step's ends are ends of parts
    and one more lies between them; what lies between goes. Negative if the ranks of its merges are out of order."""

    def joined(cuts: Column, step: Column) -> Column:
        span, ends = step["span"], step["ends"]
        due = (cuts.bitwiseAND(ends) == ends) & (F.bit_count(cuts.bitwiseAND(span)) == 3)
        return F.when(due, cuts.bitwiseAND(F.bitwise_not(span)).bitwiseOR(ends).bitwiseOR(span.bitwiseAND(F.lit(-(1 << 63))))).otherwise(cuts)

    return F.aggregate(steps, whole, joined)


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word, in n log n: parts are a linked list, their neighbours a heap of (rank, start)."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the part that starts here; 0 if none does
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            stop = end[after[i]]
            if (r := ranks.get(word[i:stop])) is not None:
                heapq.heappush(heap, (r, i, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two has been joined since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


# Texts


class Numbers(dict):
    """Numbers of words in the order they come up; tokens have their ranks."""

    def __init__(self, tokens: dict[str, int], first: int):
        super().__init__(tokens)
        self.next, self.new = first, []

    def __missing__(self, word: str) -> int:
        self[word] = n = self.next
        self.next += 1
        self.new.append(word)
        return n


def _numbered(batches: Iterator[pa.RecordBatch], tokens: list[bytes], of: Vocabulary, splitter: Splitter, remembered: int) -> Iterator[pa.RecordBatch]:
    """Of rows (text, others): whether the numbers begin anew, the numbers of the text's words, and the words that are new to the task,
    with their steps, or their tokens if they are long."""
    ranks = {t: i for i, t in enumerate(tokens)}
    known = {}
    for i, token in enumerate(tokens):
        try:
            known[token.decode()] = i
        except UnicodeDecodeError:
            continue
    words = splitter.compiled()
    numbers = None

    def out(b: pa.RecordBatch, anew: list[bool], found: list[np.ndarray], news: list[list[bytes]]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(_offsets(list(map(len, found))), pa.array(np.concatenate(found)))
        new = [w for here in news for w in here]
        by_heap = [len(w) > LONG or k >= MOST for here in news for k, w in enumerate(here)]
        ids = pa.array([heap_merged(w, ranks) if h else None for w, h in zip(new, by_heap)], pa.list_(pa.int32()))
        folded = [b"" if h else w for w, h in zip(new, by_heap)]
        whole = pa.array([(1 << len(w) + 1) - 1 for w in folded], pa.int64())
        told = pa.StructArray.from_arrays([pa.array(new, pa.binary()), ids, whole, steps(folded, of)], ["word", "ids", "whole", "steps"])
        fields = [pa.array(anew, pa.bool_()), lists, pa.ListArray.from_arrays(_offsets(list(map(len, news))), told)]
        return pa.RecordBatch.from_arrays([*fields, *b.columns[1:]], names=["_anew", "_numbers", "_new", *b.schema.names[1:]])

    for b in batches:
        first, size, anew, found, news = 0, 0, [], [], []
        for k, text in enumerate(b.column(0).to_pylist(), 1):
            anew.append(numbers is None or numbers.next - len(tokens) > remembered)
            if anew[-1]:
                numbers = Numbers(known, len(tokens))
            here = words(text or "")
            found.append(np.fromiter(map(numbers.__getitem__, here), np.int32, len(here)))
            news.append([w.encode() for w in numbers.new])
            numbers.new = []
            size += sum(map(len, news[-1]))
            if size > AT_ONCE or k == b.num_rows:
                yield out(b.slice(first, k - first), anew, found, news)
                first, size, anew, found, news = k, 0, [], [], []


def _offsets(counts) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _tokens(words: pa.Array, ids: pa.Array, cuts: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of words, one after the other, and how many each has: those between its cuts, but for words that have ids, or are out of order."""
    said, begin = b"".join(words.to_pylist()), np.cumsum(pc.binary_length(words).to_numpy()) - pc.binary_length(words).to_numpy()
    odd = np.flatnonzero((cuts < 0) | ids.is_valid().to_numpy(zero_copy_only=False))
    cuts = cuts.copy()
    cuts[odd] = 0
    word, place = np.nonzero(cuts[:, None] >> np.arange(LONG + 1) & 1)
    inside = word[1:] == word[:-1]
    word, at = word[:-1][inside], (begin[word] + place)
    found = [ranks[said[i:j]] for i, j in zip(at[:-1][inside].tolist(), at[1:][inside].tolist())]
    if len(odd):
        more = [ids[k].as_py() if ids[k].is_valid else heap_merged(words[k].as_py(), ranks) for k in odd.tolist()]
        word = np.concatenate([word, np.repeat(odd, [len(x) for x in more])])
        found = np.concatenate([np.array(found, np.int32), *[np.array(x, np.int32) for x in more]])[np.argsort(word, kind="stable")]
    return np.asarray(found, np.int32), np.bincount(word, minlength=len(cuts))


def _assembled(batches: Iterator[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The token ids of texts (anew, numbers, new words, their ids, their cuts, others): the tokens of the words, one after the other."""
    own, ranks = np.arange(len(tokens), dtype=np.int32), {t: i for i, t in enumerate(tokens)}
    flat, starts, lengths = own, own.astype(np.int64), np.ones(len(own), np.int64)
    for b in batches:
        anew, numbers = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        out, sizes = [], []
        begins = sorted({0, b.num_rows, *np.flatnonzero(anew).tolist()})
        for lo, hi in zip(begins, begins[1:]):
            if anew[lo]:
                flat, starts, lengths = own, own.astype(np.int64), np.ones(len(own), np.int64)
            words, ids, cuts = (b.column(c).slice(lo, hi - lo).flatten() for c in (2, 3, 4))
            if len(words):
                new, size = _tokens(words, ids, cuts.to_numpy(), ranks)
                begin = len(flat) + np.cumsum(size) - size
                flat, starts, lengths = np.concatenate([flat, new]), np.concatenate([starts, begin]), np.concatenate([lengths, size])
            part = numbers.slice(lo, hi - lo)
            n, ends = part.flatten().to_numpy(), np.cumsum(np.diff(part.offsets.to_numpy()))
            each = lengths[n]
            total = np.concatenate([[0], np.cumsum(each)])
            out.append(flat[np.repeat(starts[n] - total[:-1], each) + np.arange(total[-1])])
            sizes.append(np.diff(total[ends], prepend=0))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int32), pa.int32()))
        yield pa.RecordBatch.from_arrays([ids, *b.columns[5:]], names=["_ids", *b.schema.names[5:]])


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], name: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """The columns of keep, and the token ids of each whole text under the ranks of path, each match of the pattern by itself.

    One stage without any shuffle: a task numbers the distinct words of its texts as they come up, the fold merges each once,
    and the numbers become tokens where the words were cut. A task begins its numbers anew after `remembered` words, so its memory
    is bounded. Words of over LONG bytes, and those few whose merges come out of the order of ranks, are merged by a heap.

    Null and empty texts have no tokens. Repeated rows stay. An empty table gives none. Columns that aren't kept are not looked at, and
    names may clash but for `name` itself, which gets further underscores. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    tokens, name = ranks_of(path), fresh(name, docs)
    others = [f"_k{i}" for i in range(len(keep))]
    rest = "".join(f", {o} {dict(docs.dtypes)[c]}" for o, c in zip(others, keep))
    slim = docs.select(F.col("text"), *[F.col(c).alias(o) for o, c in zip(others, keep)])
    new = "array<struct<word:binary,ids:array<int>,whole:bigint,steps:array<struct<span:bigint,ends:bigint>>>>"
    cut = slim.mapInArrow(partial(_numbered, tokens=tokens, of=vocabulary(path), splitter=Splitter(pattern), remembered=remembered), f"_anew boolean, _numbers array<int>, _new {new}" + rest)
    cuts = F.transform("_new", lambda w: merged(w["whole"], w["steps"]))
    known = cut.select("_anew", "_numbers", F.col("_new.word").alias("_words"), F.col("_new.ids").alias("_own"), cuts.alias("_cuts"), *others)
    out = known.mapInArrow(partial(_assembled, tokens=tokens), "_ids array<int>" + rest)
    return out.select(*[F.col(o).alias(c) for o, c in zip(others, keep)], F.col("_ids").alias(name))


@lru_cache(maxsize=4)
def _pieces(path: str) -> str:
    return json.dumps([base64.b64encode(t).decode() for t in ranks_of(path)])


def decode(ids: Column | str, path: str) -> Column:
    """The bytes that token ids stand for: the tokens' bytes, one after the other. Ids that are none give nothing; null gives null."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    table = F.from_json(F.lit(_pieces(path)), "array<binary>")
    return bound(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i).cast("string")), "")).cast("binary")
