"""Places of patterns and of literal words in texts: one linear pass over each text, in Arrow batches.

Offsets need the matches' places, which no built-in expression tells without a fold over what has been found. Rows go to
Python whole batches at a time, all patterns in one pass, and only found places come back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton

#: Found places that are given back at a time.
ROWS = 20_000
PLACE = [("k", pa.int32()), ("valor", pa.string()), ("ini", pa.int32()), ("fim", pa.int32()), ("v_ini", pa.int32()), ("v_fim", pa.int32())]
DDL = "k int, valor string, ini int, fim int, v_ini int, v_fim int"


class Pattern(NamedTuple):
    """A pattern, the group whose place is told (the match's where it took no part), and for patterns whose time could grow with the square of a text:

    pivot: a sign that every match holds once, with a run of `before` signs ahead of it from the match's start on. reach: how a match begins,
    a run that it then goes through, and what may follow before its first digit behind the run; without a digit up to there, nothing matches.
    """

    pattern: str
    ignore_case: bool = False
    group: int = 0
    pivot: str | None = None
    before: str | None = None
    reach: tuple[str, str, str] | None = None


#: Beginnings that a pattern may have at most, to be looked for as words; and characters of each.
BEGINNINGS, LONGEST = 400, 12


def beginnings(pattern: str) -> list[str] | None:
    """Words, one of which every match begins with; none if the pattern may begin with anything else."""

    def joined(heads: dict[str, bool], tails: list[tuple[str, bool]]) -> dict[str, bool]:
        out: dict[str, bool] = {}
        for head, open_ in heads.items():
            for tail, goes_on in tails if open_ and len(head) < LONGEST else [("", False)]:
                out[head + tail] = out.get(head + tail, True) and open_ and goes_on
        return out

    def of(items) -> list[tuple[str, bool]]:
        """(beginning, whether what follows may be joined to it) of a sequence."""
        heads = {"": True}
        for op, value in items:
            name = str(op)
            if name == "AT":
                tails = [("", True)]
            elif name == "LITERAL":
                tails = [(chr(value), True)]
            elif name == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
                tails = [(chr(v), True) for _, v in value]
            elif name == "SUBPATTERN":
                tails = of(value[3])
            elif name == "BRANCH":
                tails = [t for branch in value[1] for t in of(branch)]
            elif name == "MAX_REPEAT" and value[0] == 0 and value[1] == 1:
                tails = [("", True), *of(value[2])]
            else:
                tails = [("", False)]
            heads = joined(heads, tails)
            if len(heads) > BEGINNINGS or not any(heads.values()):
                break
        return list(heads.items())

    words = sorted({w for w, _ in of(re._parser.parse(pattern))})
    short = [w for w in words if not any(v != w and w.startswith(v) for v in words)]  # a longer one begins with a shorter one
    return short if words and min(map(len, words)) > 1 and len(words) <= BEGINNINGS else None  # single signs stand everywhere


def needs_digit(items) -> bool:
    """Whether every match of a parsed pattern holds a digit."""
    for op, value in items:
        name = str(op)
        if name == "IN" and [str(x) for o, x in value] == ["CATEGORY_DIGIT"]:
            return True
        if name == "SUBPATTERN" and needs_digit(value[3]) or name == "MAX_REPEAT" and value[0] and needs_digit(value[2]):
            return True
        if name == "BRANCH" and all(needs_digit(branch) for branch in value[1]):
            return True
    return False


#: What the engine takes for i and s when case doesn't count, beside their own capitals.
ALIKE = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})


def folded(text: str) -> str:
    """The text in small letters, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text) or any(chr(c) in low for c in ALIKE):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(ALIKE))
    return low


#: Characters of texts that are gone through at a time.
AT_ONCE = 1 << 21


def _run(docs: DataFrame, keep: list[str], prepare: Callable[[], Callable[[list[str]], Iterator[tuple[int, tuple]]]]) -> DataFrame:
    """keep and DDL columns for every place (text, place) that the function of some texts tells; prepare makes it once in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = prepare()
        for b in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in PLACE]

            def told(rows=rows, out=out, b=b) -> pa.RecordBatch:
                at = pa.array(rows, pa.int32())
                columns = [c.take(at) for c in b.columns[:-1]] + [pa.array(v, t) for v, (_, t) in zip(out, PLACE)]
                rows.clear()
                for v in out:
                    v.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], *[n for n, _ in PLACE]])

            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            begin, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size <= AT_ONCE and k < len(texts) - 1:
                    continue
                for i, place in places(texts[begin : k + 1]):
                    rows.append(begin + i)
                    for v, x in zip(out, place):
                        v.append(x)
                    if len(rows) >= ROWS:
                        yield told()
                begin, size = k + 1, 0
            if rows:
                yield told()

    types = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, {DDL}")


class Router:
    """Patterns with the ways to them: at their beginnings, which one automaton finds in all texts; about a pivot; or through the text, where a digit is needed."""

    def __init__(self, wanted: list[tuple[int, Pattern]]):
        self.ready, words = [], {}
        for n, (k, p) in enumerate(wanted):
            heads = [p.pivot] if p.pivot else beginnings(p.pattern)
            for w in heads or []:
                words.setdefault(folded(w), []).append(n)
            self.ready.append((k, re.compile(p.pattern, re.IGNORECASE if p.ignore_case else 0), p, heads is not None, needs_digit(re._parser.parse(p.pattern)), [re.compile(x, re.IGNORECASE) for x in p.reach or ()]))
        self.automaton = Automaton(list(words)) if words else None
        self.of = list(words.values())

    def places(self, texts: list[str]) -> Iterator[tuple[int, tuple]]:
        """(text, place) of all matches."""
        starts: dict[tuple[int, int], set[int]] = {}
        if self.automaton:
            for i, word, at in zip(*(x.tolist() for x in self.automaton.find([folded(t) for t in texts]))):
                for n in self.of[word]:
                    starts.setdefault((i, n), set()).add(at)
        through = [n for n, (_, _, _, headed, _, _) in enumerate(self.ready) if not headed]
        for i, text in enumerate(texts):
            digit = DIGIT(text) is not None
            for n in through:
                if digit or not self.ready[n][4]:
                    yield from ((i, self.told(n, m)) for m in self.ready[n][1].finditer(text))
        for (i, n), at in starts.items():
            _, pattern, p, _, digits, reach = self.ready[n]
            if digits and not p.pivot and DIGIT(texts[i], min(at)) is None:
                continue
            matches = self.about(texts[i], pattern, p, sorted(at)) if p.pivot else self.begun(texts[i], pattern, reach, sorted(at))
            yield from ((i, self.told(n, m)) for m in matches)

    def told(self, n: int, m: re.Match) -> tuple:
        k, _, p, *_ = self.ready[n]
        g = p.group if p.group and m[p.group] else 0
        return k, m[g], m.start(), m.end(), m.start(g), m.end(g)

    @staticmethod
    def begun(text: str, pattern: re.Pattern, reach: list[re.Pattern], starts: list[int]) -> Iterator[re.Match]:
        """The matches that begin at these places. What is reached is gone through once, however many of them lie in it."""
        free = run = digit = 0
        for at in starts:
            if at < free:
                continue
            if reach and (head := reach[0].match(text, at)):
                if run < head.end():
                    run = reach[1].match(text, head.end()).end()
                if digit < head.end():
                    found = DIGIT(text, head.end())
                    digit = found.start() if found else len(text) + 1
                if digit > reach[2].match(text, run).end():
                    continue
            if m := pattern.match(text, at):
                yield m
                free = m.end()

    @staticmethod
    def about(text: str, pattern: re.Pattern, p: Pattern, pivots: list[int]) -> Iterator[re.Match]:
        """What stands ahead of a pivot decides where the match begins, what follows whether it is one: so one try for each pivot."""
        before, edge, free = re.compile(p.before), re.compile(r"\b"), 0
        for at in pivots:
            if at < free:
                continue
            begin = at
            while begin > free and before.match(text[begin - 1]):
                begin -= 1
            first = edge.search(text, begin, at) if begin < at else None
            while first and not before.match(text[first.start()]):
                first = edge.search(text, first.start() + 1, at)
            if first and first.start() < at and (m := pattern.match(text, first.start())):
                yield m
                free = m.end()
            else:
                free = max(free, begin)


DIGIT = re.compile(r"\d").search


def patterns(docs: DataFrame, wanted: list[tuple[int, Pattern]], keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, k, valor, ini, fim, v_ini, v_fim: all matches of the patterns (k, Pattern) in the column `text`, offsets from 0
    in code points. ini and fim are the match's, v_ini, v_fim and valor the group's. Null texts have none.

    Texts that hold none of a pattern's beginnings, or no digit where it needs one, are not gone through; if that can be said in a few words,
    such texts don't leave the JVM.
    """
    asked = [[p.pivot] if p.pivot else beginnings(p.pattern) for _, p in wanted]
    words = [w for heads in asked for w in heads or []]
    if all(asked) and len(words) <= FEW:
        low = F.lower(F.translate("text", "İıſ", "iis"))
        docs = docs.where(reduce(Column.__or__, [F.contains(low, F.lit(folded(w))) for w in words]))
    return _run(docs, list(keep), lambda: Router(wanted).places)


#: Words that are looked for ahead of Python at most.
FEW = 12


def literals(docs: DataFrame, words: list[str], lower: bool = False, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, k, valor, ini, fim, v_ini, v_fim: every place of words[k] in the column `text`, overlapping ones too; with
    `lower`, in small letters, character by character. One automaton over all words."""

    def prepare():
        automaton = Automaton(words)

        def places(texts: list[str]) -> Iterator[tuple[int, tuple]]:
            for i, k, at in zip(*(x.tolist() for x in automaton.find([folded(t) for t in texts] if lower else texts))):
                end = at + len(words[k])
                yield i, (k, words[k], at, end, at, end)

        return places

    if not words:
        return docs.select(*keep).where("false").selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in DDL.split(", ")])
    return _run(docs, list(keep), prepare)


def own_words(docs: DataFrame, values: str, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, k, valor, ini, fim, v_ini, v_fim: every place of the texts in a row's own array `values` in its column `text`, in any case, as whole
    words; k is the place in the sorted array."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in PLACE]
            for i, (text, wanted) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                for k, value in enumerate(sorted(wanted or [])):
                    for m in re.finditer(rf"(?<!\w)(?={re.escape(value)}(?!\w))", text or "", re.IGNORECASE):
                        rows.append(i)
                        for column, x in zip(out, (k, value, m.start(), m.start() + len(value), m.start(), m.start() + len(value))):
                            column.append(x)
            at = pa.array(rows, pa.int32())
            columns = [c.take(at) for c in b.columns[:-2]] + [pa.array(v, t) for v, (_, t) in zip(out, PLACE)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-2], *[n for n, _ in PLACE]])

    return docs.select(*keep, F.col("text").alias("_text"), F.col(values).alias("_values")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {DDL}")
