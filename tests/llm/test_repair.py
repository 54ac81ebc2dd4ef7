"""Conversation repair against a plain search over all edits, and vector codes against plain Lloyd rounds."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilo.llm import codes, repair
from sigilo.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text) rows by trying all edits, row by row, with the least (cost, audit) of each state kept."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    def put_in(ways):
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                new = (cost + 2, audit + "I", [*out, names[due[state]] + ":"])
                if due[state] not in ways or new[:2] < ways[due[state]][:2]:
                    ways[due[state]] = new
        return ways

    ways, seen = put_in({"": (0, "", [])}), set()
    for role, text in rows:
        white = not text.strip(WHITE)
        must = white or (role, text) in seen
        seen.add((role, text))
        extra = 0 if white or text.rstrip(WHITE)[-1] in ".!?" else 1
        new = {}
        for state, (cost, audit, out) in ways.items():
            tries = [(state, cost + 3, audit + "D", out)]
            if not must:
                if (to := after.get((state, role[:1]))) is not None:
                    tries.append((to, cost + extra, audit + "K", [*out, f"{role}:{text}"]))
                tries.append((due[state], cost + 2 + extra, audit + "R", [*out, f"{names[due[state]]}:{text}"]))
            for to, c, a, o in tries:
                if to not in new or (c, a) < new[to][:2]:
                    new[to] = (c, a, o)
        ways = put_in(new)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def told(rows):
    """The contract's row for the damaged rows (turn, role, text) of a conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest([r[1:] for r in rows])
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def drawn(seed=5, conversations=60):
    draw, rows = random.Random(seed), []
    texts = ["Hi.", "Yes!", "No", "why?", "", " \t", "a. b", "ü.", "x" * 3000 + "."]
    for c in range(conversations):
        for t in range(draw.choice([1, 2, 3, 5, 9])):
            turn = None if draw.random() < 0.05 else t + (2 if draw.random() < 0.1 else 0)
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ursula"])
            rows.append((None if c == 7 else c, turn, role, draw.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [repair.CHUNK, 1, 3])
def test_repair_is_the_cheapest(spark, chunk):
    rows = drawn(conversations=60 if chunk > 3 else 25)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rank string")
    summary, edits = repair.repair(df, chunk=chunk)
    named = {r.conv_id: r for r in repair.digest(edits).collect()}
    of = {}
    for c, *rest in rows:
        of.setdefault(c, []).append(tuple(rest))
    got = {r.conv_id: (*(r[n] for n in NAMES[:6]), named[r.conv_id].audit, named[r.conv_id].repaired_sha256) for r in summary.collect()}
    assert got == {c: told(r) for c, r in of.items()}


def test_repair_of_one_long_conversation(spark):
    """A conversation of many chunks, all rows of one turn and some of them equal."""
    draw = random.Random(2)
    rows = [(1, 0, draw.choice(["user", "assistant", "system"]), f"{draw.randrange(150)}{draw.choice(['.', ''])}") for _ in range(400)]
    summary, edits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=16)
    s, d = summary.first(), repair.digest(edits).first()
    assert (*(s[n] for n in NAMES[:6]), d.audit, d.repaired_sha256) == told([r[1:] for r in rows])


def test_repair_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, edits = repair.repair(repair.damaged(empty))
    assert summary.count() == edits.count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)], empty.schema)
    summary, edits = repair.repair(nulls)
    assert summary.first().blank == 1 and [r.edit for r in edits.collect()] == ["D"]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            text = "" if h == 1 else text.translate({ord(s): None for s in ".!?"}) if h == 2 else text
            out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    of = {c: [] for c, *_ in rows}
    for c, *rest in damage(rows):
        of[c].append(tuple(rest))
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in QUERIES["op12_edit_automaton"](spark, SF).collect()}
    assert got == {c: told(r) for c, r in of.items()}


def test_repair_sql(spark):
    """The SQL gives the same rows, also on odd ones."""
    rows = drawn(9, 40) + [(3, 1, None, None), (None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    out = c.execute(SQL["op12_edit_automaton"])
    of = {c: [] for c, *_ in rows}
    for k, *rest in damage(rows):
        of[k].append(tuple(rest))
    names = [d[0] for d in out.description]
    assert {r[names.index("conv_id")]: tuple(r[names.index(n)] for n in NAMES) for r in out.fetchall()} == {c: told(r) for c, r in of.items()}


# Vector codes


def lloyd(vectors, ids):
    """Plain rounds over whole numbers: books, codes, errors."""
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    w = x.shape[1] // 16
    parts = x.reshape(len(x), 16, w)
    order = sorted(range(len(x)), key=lambda i: (ids[i], x[i].tolist()))[:64]
    books = parts[order].transpose(1, 0, 2).copy()
    for r in range(3):
        d = np.square(parts[:, :, None] - books[None]).sum(axis=3)
        entry = d.argmin(axis=2)
        if r < 2:
            for p in range(16):
                for e in range(books.shape[1]):
                    rows = parts[entry[:, p] == e, p]
                    if len(rows):
                        books[p, e] = rows.sum(axis=0) // len(rows)
    return books, entry, d.min(axis=2).sum(axis=1)


def vectors(n, seed=1, dim=32):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)).round(1)  # ties
    x[n // 2 :] = x[0]  # a very common vector
    return x.astype(np.float32)


@pytest.mark.parametrize("n", [1, 40, 900])
def test_codes_are_those_of_plain_rounds(spark, n):
    x = vectors(n)
    ids = [i // 2 for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, code string").repartition(5)
    got, books = codes.compress(df, ["vec_id", "embedding"])
    want, entry, error = lloyd(x, ids)
    assert np.array_equal(books, want)
    told_ = sorted((i, bytes(e.astype(np.uint8)), int(r)) for i, e, r in zip(ids, entry, error))
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in got.collect()) == told_


def test_only_what_drift_may_have_changed_is_looked_at(spark, monkeypatch):
    """Parts that aren't popped keep their entry: the rest is what a full comparison would change, and little more."""
    x = vectors(3000, 4).astype(np.float64)
    parts = np.floor(x * 256).astype(np.int64).reshape(len(x), 16, -1)
    old = parts[:64].transpose(1, 0, 2)
    new = old + np.random.default_rng(0).integers(-2, 3, old.shape)
    entry, key = codes.nearest(parts[:, 0], old[0])
    popped = set(codes.violated(entry, key, codes.drift(old, new)[0]))
    changed = set(np.flatnonzero(codes.nearest(parts[:, 0], new[0])[0] != entry).tolist())
    assert changed <= popped and len(popped) < len(x)


def test_codes_edges(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")])], "vec_id long, embedding array<double>")
    got, books = codes.compress(df, ["vec_id"])
    assert got.count() == 0 and books.shape[1] == 0
    df = spark.createDataFrame([(None, [1.0]), (5, []), (6, [-0.001, 1e30])], "vec_id long, embedding array<double>")
    got, books = codes.compress(df, ["vec_id"])
    assert {r.vec_id for r in got.collect()} == {None, 5, 6} and books.shape == (16, 3, 1)
    assert books[:, 1, 0].tolist()[:2] == [-1, codes.MOST]  # floors go down, and far components are cut


def test_group_sums(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3 or None, i) for i in range(50)], "id long, g long, v long")
    want = {i: sum(j for j in range(50) if j % 3 == i % 3) for i in range(50)}
    for bound in (10, 0):
        monkeypatch.setattr("sigilo.llm.common.BROADCAST_ROWS", bound)
        assert {r.id: r.s for r in codes.with_group_sum(df, "g", "v", "s").collect()} == want


def test_codes_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").collect()
    books, entry, error = lloyd([r.embedding for r in rows], [r.vec_id for r in rows])
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = {r.vec_id: (bytes(e.astype(np.uint8)).hex(), int(d), by_label[r.label], digest) for r, e, d in zip(rows, entry, error)}
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op13_heap_lloyd"](spark, SF).collect()} == want
