"""SimHash, lines, fingerprints: brute force over small tables, edges."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigilo.llm import common, lines, minhash, simhash
from sigilo.llm.common import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def classes(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({n for e in edges for n in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_neighbours_share_a_key():
    w = np.random.default_rng(1).integers(0, 1 << 23, 300)
    own = simhash.codeword_indices(w)
    for bit in range(23):
        other = simhash.codeword_indices(w ^ (1 << bit))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(own, other))


def test_keys_meet_within_three_bits():
    rnd = random.Random(4)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 3)):
            b ^= 1 << bit
        row, key = simhash.keys_of(np.array([a, b], dtype=np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies(spark, docs):
    odd = spark.createDataFrame([(-1, None, "a"), (-2, "", "a"), (-3, "One", "a"), (-4, "one", "a"), (None, "x y z w", "a"), (0, "x y z w", "a"), (0, "x y z w", "a"), (-5, "Ä b c d " * 3000, "a")], "doc_id long, text string, fp string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = simhash.near_copies(both).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in both.collect()]
    fps = sorted({f for _, f in rows})
    top = classes(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for d, f in rows:
        if d is not None:
            least[top[f]] = min(d, least.get(top[f], d))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(d), f"{f:016x}", least[top[f]]) for d, f in rows)
    assert simhash.near_copies(odd).count() == 8 and simhash.near_copies(odd.where("false")).count() == 0


def test_keep_one_joins_edited_copies(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(20):
        base = [rnd.choice(words) for _ in range(300)]
        for copy in range(4):
            edit = list(base)
            for at in rnd.sample(range(300), 2 if copy > 1 else 0):
                edit[at] = rnd.choice(words)
            rows.append((k, " ".join(edit), "x"))
            k += 1
    rows += [(None, None, "x"), (900, None, "x"), (901, "", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = simhash.keep_one(docs)
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert kept.columns == docs.columns and 900 in ids and 901 not in ids and kept.where("doc_id is null").count() == 1
    assert all(4 * g in ids for g in range(20)) and len(ids) <= 20 + 1 + 6 and len(set(ids)) == len(ids)


def edited(rnd, words, kind, share):
    """A copy: single words changed, or one block of words added, put in, cut or replaced."""
    n = len(words)
    new = lambda k: [f"new{rnd.randrange(10**6)}" for _ in range(k)]
    k, at = max(1, round(n * share)), rnd.randrange(n // 2)
    if kind == "scattered":
        out = list(words)
        for i in rnd.sample(range(n), max(1, k // 5)):
            out[i] = new(1)[0]
        return out
    return {"appended": words + new(k), "put in": words[:at] + new(k) + words[at:], "cut": words[: n - k], "replaced": words[:at] + new(k) + words[at + k :]}[kind]


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


KINDS = ("scattered", "appended", "put in", "cut", "replaced")


def test_band_keys_meet_at_the_threshold():
    rnd, met, pairs = random.Random(11), 0, 0
    while pairs < 400:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(100, 600))]
        copy = edited(rnd, base, KINDS[pairs % 5], rnd.uniform(0.05, 0.25))
        if 0.8 <= similarity(base, copy) < 0.85:
            row, key = simhash.band_keys([minhash.fingerprint(" ".join(t)) for t in (base, copy)])
            met += bool(set(key[row == 0].tolist()) & set(key[row == 1].tolist()))
            pairs += 1
    assert met >= 398


def test_copies_with_edited_blocks_come_together(spark):
    rnd, rows = random.Random(12), []
    while len(rows) < 200:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(100, 400))]
        copy = edited(rnd, base, KINDS[len(rows) // 2 % 5], rnd.uniform(0.03, 0.15))
        if similarity(base, copy) >= 0.87:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(200)}


def test_lines_equal_brute_force(spark, docs):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab\n\n  ab \ncd"), (None, "ab"), (-4, "z" * 300_000), (-5, "z" * 300_001)], "doc_id long, text string")
    both = docs.where("doc_id < 120").select("doc_id", "text").unionByName(odd)
    rows = [(r.doc_id, i, x.strip()) for r in both.collect() for i, x in enumerate((r.text or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in rows})
    sets = {t: {t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts}
    links = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    top = classes(texts, links)
    first = {}
    for d, i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        first.setdefault(top[t], (d, i))
    got = {(r.doc_id, r.line_no): r.keep for r in lines.line_classes(both).collect()}
    assert got == {(d, i): first[top[t]] == (d, i) for d, i, t in rows}
    out = {r.doc_id: r.text for r in lines.without_repeats(odd).collect()}
    assert out[-3] in ("\n\ncd", "ab\n\ncd", "\ncd") or out[-3].endswith("cd")
    assert lines.dedup(odd.where("false")).count() == 0


def test_line_bands_meet_at_the_threshold():
    rnd, pairs = random.Random(13), []
    while len(pairs) < 800:
        base = [chr(rnd.randrange(97, 123)) for _ in range(rnd.randint(1000, 1500))]
        copy = list(base)
        for at in rnd.sample(range(len(base)), len(base) * 23 // 1000):
            copy[at] = chr(rnd.randrange(65, 91))
        a, b = "".join(base), "".join(copy)
        if 0.8 <= lines.jaccard([a], [b])[0] < 0.82:
            pairs.append((a, b))
    x, y = (lines.band_keys([p[i] for p in pairs]) for i in (0, 1))
    assert (x == y).any(axis=1).mean() >= 0.985


def test_sketches_never_rule_out_similar_lines(spark):
    """Jaccard equals sets of shingles, and the score of similar lines is 0 at most, whatever their lengths."""
    rnd, x, y = random.Random(14), [], []
    while len(x) < 600:
        base = [chr(rnd.randrange(97, 101 + len(x) % 20)) for _ in range(rnd.choice((1, 4, 5, 9, 60, 300, 4000)))]
        copy = list(base)
        for at in rnd.sample(range(len(base)), rnd.randint(0, max(1, len(base) // 30))):
            copy[at] = rnd.choice("xyz")
        x.append("".join(base))
        y.append("".join(copy))
    told = lines.jaccard(x, y)
    sets = [[{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in p] for p in zip(x, y)]
    assert all(abs(j - len(a & b) / len(a | b)) < 1e-12 for j, (a, b) in zip(told, sets))
    (n, v), (m, w) = lines.sketches(x), lines.sketches(y)
    apart = np.bitwise_count(v.view(np.uint64) ^ w.view(np.uint64)).sum(axis=1).astype(int)
    similar = told >= 0.8
    assert similar.sum() > 100 and (9 * apart - n - m <= 0)[similar].all() and (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))[similar].all()
    assert (9 * apart - n - m > 0)[told < 0.5].mean() > 0.9
    rows = [[0, int(n[k]), *v[k].tolist(), 1, int(m[k]), *w[k].tolist()] for k in range(600)]
    df = spark.createDataFrame(rows, [f"{c}_{side}" for side in "ab" for c in lines.LOADS])
    got = [r.s for r in df.select(lines.excess(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")).alias("s")).collect()]
    assert [s <= 0 for s in got] == [5 * min(a, b) >= 4 * max(a, b) and 9 * d <= a + b for a, b, d in zip(n, m, apart)]


@pytest.mark.parametrize("rounds", [0, 64])
def test_families_of_lines_equal_brute_force(spark, monkeypatch, rounds):
    """Large groups of edited lines, in one key for the most part, with and without rounds of drawn lines."""
    monkeypatch.setattr(common, "ROUND_PAIRS", rounds)
    rnd, texts = random.Random(15), set()
    for family in range(3):
        base = [rnd.choice("abcdefghij ") for _ in range(120)]
        for _ in range(150):
            copy = list(base)
            for at in rnd.sample(range(120), rnd.randint(0, 6)):
                copy[at] = rnd.choice("klmnop")
            texts.add("".join(copy).strip())
    texts = sorted(texts)
    sets = {t: {t[i : i + 5] for i in range(len(t) - 4)} for t in texts}
    pairs = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    keys = dict(zip(texts, lines.band_keys(texts)))
    top = classes(texts, [p for p in pairs if (keys[p[0]] == keys[p[1]]).any()])
    got = {}
    for r in lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["class"], set()).add(texts[r.doc_id])
    want = {}
    for t, c in top.items():
        want.setdefault(c, set()).add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 3 <= len(want) < len(texts)


def test_no_line_is_lost_with_repeated_or_null_ids(spark):
    rows = [(1, "A only line one\nB only line two"), (1, "C only line three\nA only line one"), (None, "D only line four\nA only line one"), (None, "E only line five\nD only line four"), (2, "F twice\nG twice"), (2, "F twice\nG twice"), (None, "F twice"), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, _twin string, _id int")
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = Counter(x for r in out.collect() for x in (r.text or "").split("\n") if x)
    assert left == Counter({x for _, t in rows for x in (t or "").split("\n") if x})
    told = sorted((str(r.doc_id), r.n_lines, r.n_kept) for r in lines.dedup(docs).where("doc_id = 2").collect())
    assert told in ([("2", 2, 0), ("2", 2, 1)], [("2", 2, 0), ("2", 2, 2)])


def test_fingerprints(spark, docs):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é😀 x"), (10_000, "tail words " * 20_000), (10_001, "dup"), (10_001, "dup")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    rows = sorted(((r.doc_id, r.text or "") for r in both.collect()), key=lambda r: r[0])
    got = sorted(minhash.fingerprints(both).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    for k, ((doc_id, text), r) in enumerate(zip(rows, got)):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == minhash.fingerprint(text).hex() and r.edited_fingerprint == minhash.fingerprint(changed).hex()
        for told, other in ((r.near_edited, changed), (r.near_next, following)):
            a, b = set(minhash.shingle_hashes(text).tolist()), set(minhash.shingle_hashes(other).tolist())
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(told - true) < 0.17
    assert minhash.fingerprints(odd.where("false")).count() == 0 and minhash.fingerprints(odd.where("doc_id = -3")).first().near_next == 1.0


def test_shared_keys(spark):
    rnd = random.Random(16)
    rows = [(rnd.randrange(60) if i % 3 else i + 100, rnd.randrange(5) if i % 2 else rnd.randrange(1000)) for i in range(900)]
    ids = {k: {j for q, j in rows if q == k} for k, _ in rows}
    got = common.buckets(spark.createDataFrame(rows, "key long, id long")).collect()
    assert sorted(map(tuple, got)) == sorted((k, i, min(v)) for k, v in ids.items() if len(v) > 1 for i in v)
    assert common.buckets(spark.createDataFrame([(1, 2), (1, 2)], "key long, id long")).count() == 0


def test_keep_one_equals_brute_force(spark, docs):
    """One document of each class by the exact similarity of five-word shingles, over whole tables."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rnd = random.Random(17)
    for k, (_, t) in enumerate(rows[:40]):
        words = (t or "").split()
        if len(words) > 30:
            rows.append((10_000 + k, " ".join(edited(rnd, words, KINDS[k % 5], 0.08))))
    told = {}
    for _, t in rows:
        words = (t or "").lower().split()
        told[t or ""] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    texts = sorted(told)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)  # noqa: E731  two texts without words too
    top = classes(texts, [(a, b) for a, b in combinations(texts, 2) if alike(told[a], told[b])])
    least = {}
    for d, t in rows:
        least[top[t or ""]] = min(d, least.get(top[t or ""], d))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == sorted(least.values())
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(table).collect()} == {d: least[top[t or ""]] for d, t in rows}


def plain_print(text):
    """The fingerprint number by number: a hash of five-word shingles, the least in each bin, empty bins by their tries, low bytes."""
    full = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    words = [xxhash.xxh64_intdigest(w) for w in text.lower().encode().split()]
    if not words:
        return ""
    width, bins = min(5, len(words)), {}
    for i in range(len(words) - width + 1):
        h = 0
        for w in words[i : i + width]:
            h = (h * 0x9E3779B185EBCA87 + w) & full
        h = mix(h)
        bins[h >> 56] = min(h, bins.get(h >> 56, h))
    out = []
    for k in range(256):
        at, tried = k, 0
        while at not in bins and tried < 64:
            at, tried = mix(tried * 256 + k + 0x9E3779B97F4A7C15 & full) % 256, tried + 1
        if at not in bins:
            at = next((b for b in sorted(bins) if b >= k), min(bins))
        out.append(mix(bins[at]) & 255)
    return bytes(out).hex()


def test_fingerprints_equal_plain_ones_and_estimate_well(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(80).collect()] + [(-1, "one two"), (-2, "Ä b c d e f g"), (-3, "")]
    got = {r.doc_id: r for r in minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: plain_print(t or "") for d, t in rows}
    rows.sort(key=lambda r: r[0])
    errors = []
    for k, (d, t) in enumerate(rows):
        changed = t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]
        a, b = set(minhash.shingle_hashes(t).tolist()), set(minhash.shingle_hashes(changed).tolist())
        if len(a | b) > 60:
            errors.append(got[d].near_edited - len(a & b) / len(a | b))
    assert len(errors) > 40 and np.abs(errors).max() < 0.125 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_taking_lines_out_is_linear(spark, monkeypatch):
    """A text of very many lines that go: their numbers are looked up, not searched."""
    import time

    n = 400_000
    df = spark.createDataFrame([(1, "\n".join(map(str, range(n)))), (2, "another")], "doc_id long, text string")
    gone = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.sequence(F.lit(1), F.lit(n - 1), F.lit(2)).alias("dropped"), F.lit(0).cast("long").alias("twin"))
    gone = gone.join(df.select("doc_id", F.xxhash64("text").alias("said")), "doc_id")
    monkeypatch.setattr(lines, "dedup", lambda docs: gone)
    began = time.time()
    left = {r.doc_id: r.text for r in lines.without_repeats(df).collect()}
    assert left == {1: "\n".join(map(str, range(0, n, 2))), 2: "another"} and time.time() - began < 60


def test_keys_of_several_ids(spark):
    from sigilo.llm.common import buckets

    rows = [(k, i) for k in range(50) for i in {(k * 7 + j) % 31 for j in range(k % 4 + 1)} for _ in range(1 + i % 2)]
    got = sorted(map(tuple, buckets(spark.createDataFrame(rows, "key long, id long").repartition(3)).select("key", "id", "pivot").collect()))
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    assert got == sorted((k, i, min(v)) for k, v in ids.items() if len(v) > 1 for i in v)
