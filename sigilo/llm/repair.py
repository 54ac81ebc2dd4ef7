"""Conversation structure repair: a weighted automaton of edits, made deterministic as rows come up, scanned by table and traced by tight arcs.

The scan goes from a conversation's last row to its first, so that its vectors tell what is still to be paid from a row on. The trace
goes back over the scan, that is with the rows, and takes the least letter among the arcs that are tight: the least audit of all cheapest ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, settle, with_rank

#: Edits and what they cost; a truncated row that stays costs CUT more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows of a conversation that are scanned as one; longer conversations are put together from such chunks.
CHUNK = 4096
#: States: nothing yet, a system turn, a user's turn, an assistant's turn; where a conversation may end.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = 4, (BEGIN, ASSISTANT)
#: The state that follows on a turn, and whose turn (u or a) may be put in or made at a state.
AFTER = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DUE = "uuau"
#: Rows by kind: initials, whole or truncated (capital), and x for those that must go; o is any other initial.
KINDS = "suaoSUAOx"
#: A cost that stands for no way.
NEVER = 1 << 40


def arcs(state: int, kind: str) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the ways to take a row of a kind; in the order of the letters."""
    out = [("D", DELETE, state)]
    if kind != "x":
        extra = CUT if kind.isupper() else 0
        if (state, kind.lower()) in AFTER:
            out.append(("K", KEEP + extra, AFTER[state, kind.lower()]))
        out.append(("R", REROLE + extra, AFTER[state, DUE[state]]))
    return out


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go, if turns may be put in first. Two are enough: a third comes back to a state of the first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[AFTER[s, DUE[s]]]) for s, c in enumerate(costs)]
    return costs


class Scanner:
    """The deterministic automaton, as far as it has been needed: its states are vectors of costs to go with least entry 0,
    its table gives for (state, kind) the next state and what is added to all costs."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []

    def number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.numbers[vector]

    def normal(self, costs: list[int]) -> tuple[int, int]:
        """Number and least entry of a vector of costs to go."""
        least = min(costs)
        return self.number(tuple(min(c - least, NEVER) for c in costs)), least

    def further(self, at: int, kind: str) -> tuple[int, int]:
        """What (state, kind) leads to; worked out the first time."""
        to_go = self.vectors[at]
        self.table[at][kind] = found = self.normal(with_inserts([min(c + to_go[s] for _, c, s in arcs(q, kind)) for q in range(STATES)]))
        return found

    def scan(self, kinds: str, end: list[int]) -> tuple[list[int], int]:
        """The states of the automaton ahead of each row, and behind the last, and what was added in all."""
        at, total = self.normal(with_inserts(end))
        states, table = [at], self.table
        for kind in reversed(kinds):
            at, more = table[at].get(kind) or self.further(at, kind)
            total += more
            states.append(at)
        return states[::-1], total

    def trace(self, kinds: str, states: list[int], state: int, last: bool) -> tuple[str, str, int]:
        """From a state on, the least audit of the cheapest edits, whose turn each edit makes ('=' the row's own, '-' none), and the state at the end.

        Behind the last row turns are put in only if the conversation ends there; else the next chunk does that first.
        """
        audit, roles, at = [], [], 0
        while True:
            to_go, kind = self.vectors[states[at]], kinds[at : at + 1]
            put_in = INSERT + to_go[AFTER[state, DUE[state]]] == to_go[state] and (kind or last)
            ways = [("I", DUE[state], AFTER[state, DUE[state]], at)] if put_in else []
            if kind:
                behind, (_, more) = self.vectors[states[at + 1]], self.table[states[at + 1]][kind]
                made = {"D": "-", "K": "=", "R": DUE[state]}
                ways += [(edit, made[edit], to, at + 1) for edit, cost, to in arcs(state, kind) if cost + behind[to] == to_go[state] + more]
            elif not put_in:
                return "".join(audit), "".join(roles), state
            edit, role, state, at = min(ways)
            audit.append(edit)
            roles.append(role)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """That of the worker."""
    return Scanner()


FINAL = [0 if s in ENDS else NEVER for s in range(STATES)]
ROLES = {"u": "user", "a": "assistant", "=": None, "-": None}


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (conv_id, chunk, kinds) the costs from each state to each, row by row."""
    for b in batches:
        found = []
        for kinds in b.column(2).to_pylist():
            columns = []
            for end in range(STATES):
                states, total = scanner().scan(kinds, [0 if s == end else NEVER for s in range(STATES)])
                columns.append([min(c + total, NEVER) for c in scanner().vectors[states[0]]])
            found.append([columns[r][q] for q in range(STATES) for r in range(STATES)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "chunk", "costs"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (conv_id, chunk, kinds, end) that others follow, the state at the end for each state at the beginning."""
    for b in batches:
        found = []
        for kinds, end in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            states, _ = scanner().scan(kinds, end)
            found.append([scanner().trace(kinds, states, q, False)[2] for q in range(STATES)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["conv_id", "chunk", "exits"])


STEPS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("row", pa.binary())]))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks (conv_id, chunk, kinds, rows, end, state, last) the cost from the state on, the audit and its steps."""
    for b in batches:
        costs, audits, steps = [], [], []
        for kinds, rows, end, state, last in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
            states, total = scanner().scan(kinds, end)
            audit, roles, _ = scanner().trace(kinds, states, state, last)
            following = iter(rows)
            costs.append(scanner().vectors[states[0]][state] + total)
            audits.append(audit)
            steps.append([{"edit": e, "role": ROLES[r], "row": None if e == "I" else next(following)} for e, r in zip(audit, roles)])
        columns = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(steps, STEPS)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["conv_id", "chunk", "cost", "audit", "steps"])


# Conversations


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the checksum of conv_id and turn, nulls being one space: of 20 rows about one each
    goes, is emptied, loses its full stops, comes twice, becomes the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    rows = turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), h.alias("_h")).where("_h <> 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_copy")


def _same(*columns: str) -> Column:
    """A 128-bit name of some values, null being one."""
    shown = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*shown).cast("binary")))


def on(a: DataFrame, b: DataFrame, shift: int = 0, how: str = "inner") -> DataFrame:
    """Chunks of a with what b has of the chunk `shift` further on."""
    there = b.select(F.col("conv_id").alias("_conv"), (F.col("chunk") - shift).alias("_chunk"), *[F.col(c).alias(f"_{c}") for c in b.columns if c not in ("conv_id", "chunk")])
    return a.join(there, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), how).drop("_conv", "_chunk")


def by_doubling(each: DataFrame, value: str, chunks: int, joined, back: bool) -> DataFrame:
    """The chunks' values joined with those of all that follow (or, if not back, that go before), in as many joins as the number of chunks has bits."""
    out, reach = settle(each), 1
    while reach < chunks:
        pair = on(out, out.select("conv_id", "chunk", value), reach if back else -reach, "left")
        both = joined(F.col(value), F.col(f"_{value}")) if back else joined(F.col(f"_{value}"), F.col(value))
        out = settle(pair.select("conv_id", "chunk", F.when(F.col(f"_{value}").isNull(), F.col(value)).otherwise(both).alias(value)))
        reach *= 2
    return out


def times(a: Column, b: Column) -> Column:
    """Least sums over what lies between: costs through two chunks."""
    over = lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda k: F.get(a, F.floor(i / STATES).cast("int") * STATES + k) + F.get(b, k * STATES + i % STATES)))
    return F.transform(F.sequence(F.lit(0), F.lit(STATES * STATES - 1)), lambda i: F.least(over(i), F.lit(NEVER)))


def _placed(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks with end (costs to go behind them), state (at their beginning) and last."""
    final = F.array(*[F.lit(c).cast("long") for c in FINAL])
    if most == 1:
        return chunks.select("*", final.alias("end"), F.lit(BEGIN).alias("state"), F.lit(True).alias("last"))
    kind = f"conv_id {dict(chunks.dtypes)['conv_id']}, chunk long"
    costs = by_doubling(chunks.select("conv_id", "chunk", "kinds").mapInArrow(_costs, f"{kind}, costs array<long>"), "costs", most, times, True)
    to_go = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda q: F.array_min(F.array(*[F.get("costs", q * STATES + r) for r in ENDS])))
    ended = settle(on(chunks, costs.select("conv_id", "chunk", to_go.alias("end")), 1, "left").select("*", F.col("_end").isNull().alias("last")))
    ended = ended.select(*chunks.columns, F.coalesce("_end", final).alias("end"), "last")
    exits = ended.where("not last").select("conv_id", "chunk", "kinds", "end").mapInArrow(_exits, f"{kind}, exits array<int>")
    exits = by_doubling(exits, "exits", most, lambda a, b: F.transform(a, lambda q: F.get(b, q)), False)
    begun = on(ended, exits, -1, "left")
    return begun.select(*chunks.columns, "end", F.coalesce(F.get("_exits", F.lit(BEGIN)), F.lit(BEGIN)).alias("state"), "last")


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of conversations (conv_id, turn, role, text).

    summary: a row for each conversation with gaps (turns missing between the first and the last), blank, duplicate, truncated (rows by their
    first fault), illegal (neighbours whose initials are not su, ua or au), and cost of the cheapest repair to (s?(ua)+)?.
    edits: conv_id, place (chunk and number, ascending), edit (K, R, D, I), role, text (null where deleted), in the order of the least audit.

    Rows go by turn (null first), role and the digest of the text; null role and text are one space, null conv_id is a conversation. Repeated rows
    are rows; all but the first are duplicates. An empty table gives none. Extra columns are not looked at. Texts are read whole and
    move only to meet their edits. A conversation is ranked by ranges, named by a letter a row, and cut into chunks of rows; chunks of one
    conversation are put together by least-sum products over doubling distances, so no task holds one that is longer than a chunk.
    """
    bounded_batches(turns.sparkSession)
    shown = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    rows = rows.select("*", F.md5(F.col("text").cast("binary")).alias("said"), _same("conv_id", "turn", "role", "text").alias("row"))
    with scratch() as held:
        left = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
        fault = F.when(left == "", "b").when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
        initial = F.substring("role", 1, 1)
        slim = rows.select("conv_id", "turn", "role", "said", "row", fault.alias("fault"), initial.alias("initial"), F.monotonically_increasing_id().alias("_m"))
        ranked = settle(with_rank(slim, ["conv_id"], [F.col("turn"), F.col("role"), F.col("said"), F.col("_m")]).select("conv_id", "turn", "role", "said", "row", "fault", "initial", "rank"))
        first = ranked.groupBy("conv_id", "role", "said").agg(F.min("rank").alias("_rank")).select(F.col("conv_id").alias("_conv"), "_rank")
        told = ranked.drop("role", "said").join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_rank")), "left")
        told = told.withColumn("fault", F.when((F.col("fault") != "b") & F.col("_rank").isNull(), "d").otherwise(F.col("fault")))
        kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
        kind = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(kind)).otherwise(kind)
        place = F.floor(F.col("rank") / chunk)
        listed = told.groupBy("conv_id", place.alias("chunk")).agg(
            F.sort_array(F.collect_list(F.struct("rank", kind.alias("kind"), "row", "initial"))).alias("rows"),
            *[F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        )
        legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
        pairs = F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, chunk), lambda a, b: ~legal(a, b))
        listed = listed.withColumn("initials", F.col("rows.initial")).withColumn("illegal", F.size(F.filter(pairs, lambda x: x)))
        chunks = settle(listed.select("conv_id", "chunk", F.array_join("rows.kind", "").alias("kinds"), F.col("rows.row").alias("rows"), "initials", "blank", "duplicate", "truncated", "illegal"))
        most = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
        placed = _placed(chunks.select("conv_id", "chunk", "kinds", "rows"), most)
        fields = f"conv_id {dict(chunks.dtypes)['conv_id']}, chunk long, cost long, audit string, steps array<struct<edit:string,role:string,row:binary>>"
        traced = held(settle(placed.select("conv_id", "chunk", "kinds", "rows", "end", "state", "last").mapInArrow(_traced, fields)))
        ends = chunks.select("conv_id", "chunk", F.element_at("initials", -1).alias("end"))
        met = on(chunks, ends, -1, "left") if most > 1 else chunks.withColumn("_end", F.lit(None).cast("string"))
        met = met.withColumn("illegal", F.col("illegal") + F.when(F.col("_end").isNotNull() & ~legal(F.col("_end"), F.get("initials", F.lit(0))), 1).otherwise(0))
        faults = met.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
        by_turn = ranked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)))
        gaps = by_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        costs = traced.where("chunk = 0").select(F.col("conv_id").alias("_c"), "cost")
        joined = gaps.join(faults.withColumnRenamed("conv_id", "_f"), F.col("conv_id").eqNullSafe(F.col("_f"))).join(costs, F.col("conv_id").eqNullSafe(F.col("_c")))
        summary = held(settle(joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")))
    steps = traced.select("conv_id", "chunk", F.posexplode("steps").alias("number", "step")).select("conv_id", F.struct("chunk", "number").alias("place"), "step.*")
    texts = rows.groupBy("row").agg(F.first("role").alias("own"), F.first("text").alias("text"))
    found = steps.where("edit <> 'I'").join(texts, "row")
    gone = F.col("edit") == "D"
    found = found.select("conv_id", "place", "edit", F.when(~gone, F.coalesce("role", "own")).alias("role"), F.when(~gone, F.col("text")).alias("text"))
    return summary, found.unionByName(steps.where("edit = 'I'").select("conv_id", "place", "edit", "role", F.lit("").alias("text")))


def digest(edits: DataFrame) -> DataFrame:
    """audit and the digest of the repaired rows of each conversation: what has to gather a conversation, for its audit is one string."""
    said = F.when(F.col("role").isNotNull(), F.concat("role", F.lit(":"), "text"))
    rows = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "edit", said.alias("said")))).alias("rows"))
    return rows.select("conv_id", F.array_join("rows.edit", "").alias("audit"), F.sha2(F.array_join("rows.said", "\n").cast("binary"), 256).alias("repaired_sha256"))
