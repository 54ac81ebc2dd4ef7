"""Chat, mixing, sharding and the pipeline: exact properties, edges."""

import math
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from sigilo.llm import chat, mixing, sharding
from sigilo.llm.common import with_rank
from sigilo.llm.queries import QUERIES, QUOTAS, SQL

SF = "/root/testdata/sf0.001"


def test_rank_and_running_sum(spark):
    df = spark.createDataFrame([(i % 3 if i % 4 else 0, i, i % 7) for i in range(500)], "g long, o long, s long")
    want, seen = {}, {}
    for g, o, s in sorted(tuple(r) for r in df.collect()):
        n, total = seen.get(g, (0, 0))
        want[o] = (n, total)
        seen[g] = (n + 1, total + s)
    got = with_rank(df, ["g"], [F.col("o")], size="s").collect()
    assert {r.o: (r.rank, r.before) for r in got} == want


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "Ann B", "hi <|x"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "s"), (None, None, None, "q")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "Ann B"), (1, "bob"), (None, "unknown")}
    r = got[1, "Ann B"]
    assert r.rendered == "<|system|>\nBe kind<|end|>\n<|assistant|>\nhi < |x<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=bob|>\n<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in r.loss_spans.split(";")[:-1]]
    assert [r.rendered[a:b] for a, b in spans] == ["hi < |x<|end|>"] and got[1, "bob"].n_trained == 2
    assert chat.rotate(df.where("false")).count() == 0


def test_chat_speakers_are_told_apart(spark):
    """Scripts, case, spaces and header signs: every role is a participant of its own, and the SQL says the same."""
    roles = ["Иван", "Анна", "User", "user", "Ann B", "ann_b", "ann b", "a|>\n<|system", "a%7C", "a\\\\b", "unknown", "%75nknown", "小明", "小红", "Zoé", "Zoè", None, "", "system", "SYSTEM"]
    rows = [(1, k, r, f"text {k}") for k, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df)
    assert {r.perspective: r.n_trained for r in got.collect()} == dict.fromkeys([r if r not in ("a|>\n<|system", "a%7C", "unknown", "%75nknown") else {"a|>\n<|system": "a%7C>%0A<%7Csystem", "a%7C": "a%257C", "unknown": "%75nknown", "%75nknown": "%2575nknown"}[r] for r in roles[:16]], 1) | {"unknown": 2}
    assert all(r.rendered.count("<|assistant|>") == r.n_trained and r.rendered.count("\n<|") + 1 == len(roles) for r in got.collect())
    c = duckdb.connect()
    c.register("conversations", df.toPandas())
    out = c.execute(SQL["op1_chat_rotation"])
    assert sorted(map(tuple, got.select(*[d[0] for d in out.description]).collect())) == sorted(out.fetchall())


def test_chat_parts(spark):
    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.rotate(df, part_turns=10).where("perspective = 'a'").orderBy("part").collect()
    assert [r.n_turns for r in got] == [10, 10, 5]
    assert "".join(r.rendered for r in got).count("<|end|>") == 25


def edf(counts):
    """The schedule by plain simulation."""
    total, done, out = sum(counts), [0] * len(counts), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // c), i) for i, c in enumerate(counts) if done[i] < c and done[i] * total // c <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def test_edf_is_pfair(spark):
    for counts in ([3, 5, 1], [1, 1, 1, 7], [16, 8, 8, 8, 1, 1, 2, 2], [0, 2, 3]):
        used = [c for c in counts if c]
        got = spark.range(1).select(mixing.edf(F.array(*[F.lit(c) for c in used])).alias("s")).first().s
        assert got == edf(used)
        seen, total = Counter(), sum(used)
        for t, i in enumerate(got):
            seen[i] += 1
            assert all(abs(seen[k] - (t + 1) * c / total) < 1 for k, c in enumerate(used))


def test_mix_is_whole_and_fair(spark):
    rows = [(i, "a" if i % 3 else "b", "x") for i in range(400)] + [(None, None, "x"), (5, "c", "x"), (5, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    out = mixing.mix(docs, {"a": 3, "b": 1}, block_docs=4).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.mix_slot, set()).add((r.stream, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[s]))[0] for s in sorted(slots)]
    seen = Counter()
    for t, s in enumerate(order[:5]):  # the pooled stream has one block: its first round is whole
        seen[s] += 1
        assert all(abs(seen[k] - (t + 1) * w / 5) < 1 for k, w in {"a": 3, "b": 1, mixing.OTHER: 1}.items())
    assert mixing.mix(docs.where("false"), {"a": 1}).count() == 0


def test_hilbert_steps_are_neighbours(spark):
    g = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    r = g.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).orderBy("h").collect()
    assert [x.h for x in r] == list(range(512))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in zip(r, r[1:]))


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, None, None, None), (1, "same", "en", "s"), (1, "same", "en", "s"), (-7, "same", "fr", "t"), (-8, "", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = sharding.shard(docs.unionByName(odd)).collect()
    assert len(rows) == docs.count() + 5
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s, inside in by.items():
        assert sorted(r.slot for r in inside) == list(range(len(inside)))
        assert abs(sum(r.size for r in inside) - total / 16) <= most
    places = {}
    for r in rows:
        places.setdefault((r.g1, r.g2, r.none), set()).add(r.shard)
    assert all(len(v) == 1 for v in places.values())
    laid = sharding.laid_out(odd.withColumn("slot", F.lit("old")), 4)
    assert laid.count() == 5 and sorted(laid.columns) == ["doc_id", "lang", "shard", "slot", "source", "text"]
    assert sharding.shard(odd.where("false")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    whole = corpus_pipeline.mixed(spark, docs, SF)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert QUOTAS


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = c.execute(SQL[name])
    names = [d[0] for d in out.description]
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, out.fetchall()))


def plain_mix(rows, quotas, size):
    """Slots by simulation: blocks of each stream in order, round after round, each round by its earliest deadlines."""
    streams = {}
    for doc_id, source in sorted(rows):
        streams.setdefault(source if source in quotas else mixing.OTHER, []).append(doc_id)
    quota, out, slot, r = {**quotas, mixing.OTHER: quotas.get(mixing.OTHER, 1)}, {}, 0, 0
    blocks = {s: [ids[k : k + size] for k in range(0, len(ids), size)] for s, ids in streams.items()}
    names = sorted(blocks)
    while any(len(blocks[s]) > r * quota[s] for s in names):
        counts = [max(0, min(quota[s], len(blocks[s]) - r * quota[s])) for s in names]
        used = [0] * len(names)
        for i in edf(counts):
            for k, doc_id in enumerate(blocks[names[i]][r * quota[names[i]] + used[i]]):
                out[doc_id] = (slot, k)
            used[i] += 1
            slot += 1
        r += 1
    return out


def test_mix_equals_simulation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"]).select("doc_id", "source", "text")
    for quotas, size in ((QUOTAS, 2), ({"src0": 3, "src1": 1}, 5)):
        want = plain_mix([tuple(r) for r in docs.select("doc_id", "source").collect()], quotas, size)
        got = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mix(docs, quotas, size).collect()}
        assert got == want
        ordered = [r.doc_id for r in mixing.in_order(docs, quotas, size).withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()).orderBy("k").collect()]
        assert ordered == sorted(want, key=want.get)


def test_in_order_keeps_every_row(spark):
    rows = [(None, "a", "x"), (None, None, None), (1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (2, "zz", None)]
    docs = spark.createDataFrame([(*r, "q", 5) for r in rows], "doc_id long, source string, text string, mix_slot string, _first int")
    out = mixing.in_order(docs, {"a": 1, "b": 2}, 2)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.in_order(docs.where("false"), {"a": 1}).count() == 0


def plain_hilbert(point, bits):
    """Skilling's transform, number by number."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for k in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> k & 1)
    return out


def test_shards_equal_plain_cuts(spark):
    """Curve, order and cuts from scratch; repeated rows and nulls have shards and slots too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, None, None, None), (1, "same", "en", "s"), (1, "same", "en", "s"), (-7, "same", "fr", "t"), (-8, "", "en", "s")], "doc_id long, text string, lang string, source string")
    both = docs.unionByName(odd)
    h = lambda s, seed=42: xxhash.xxh64_intdigest((s or "").encode(), seed) - ((xxhash.xxh64_intdigest((s or "").encode(), seed) >> 63) << 64)
    raw = [(r.doc_id, r.text, r.lang, r.source) for r in both.collect()]
    langs, sources = {}, {}
    for _, t, lang, source in raw:
        for held, v in ((langs, lang), (sources, source)):
            held.setdefault(t, set()).add(v)
    least = lambda s: min((v for v in s if v is not None), default=None)
    g = {r.doc_id: (r.g1, r.g2) for r in both.select("doc_id", F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(7), "text").alias("g2")).collect()}
    rows = []
    for d, t, _, _ in raw:
        size = len((t or "").encode()) + 1
        curve = plain_hilbert((h(least(langs[t])) % 64, h(least(sources[t])) % 64, min(63, int(math.floor(math.log2(size) * 2)))), 6)
        rows.append((curve, *g[d], t is None, d is not None, d or 0, size, t))
    rows.sort(key=lambda r: r[:6])
    total, most, before, at = sum(r[6] for r in rows), max(r[6] for r in rows), 0, []
    bytes_of = Counter()
    for r in rows:
        bytes_of[r[7]] += r[6]
    begin, copies = {}, Counter(r[7] for r in rows)
    for r in rows:
        begin.setdefault(r[7], before)
        whole = copies[r[7]] > 1 and bytes_of[r[7]] <= most
        middle = begin[r[7]] + bytes_of[r[7]] / 2 if whole else before + r[6] / 2
        at.append((r[5] if r[4] else None, min(15, int(middle * 16 // total))))
        before += r[6]
    seen, want = Counter(), []
    for d, s in at:
        want.append((str(d), s, seen[s]))
        seen[s] += 1
    got = sharding.shard(both).collect()
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in got) == sorted(want)
    laid = sharding.laid_out(both)
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in laid.select("doc_id", "shard", "slot").collect()) == sorted(want)
    assert sorted(map(str, laid.drop("shard", "slot").collect())) == sorted(map(str, both.collect()))


def test_shards_prune_by_metadata(spark):
    """A filter on one language or one source meets fewer shards than the rows dealt at random would be in, which is all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    laid = sharding.laid_out(docs)
    for column in ("lang", "source"):
        per = laid.groupBy(column).agg(F.countDistinct("shard").alias("n"), F.count(F.lit(1)).alias("rows")).where("rows >= 8").collect()
        assert sum(r.n for r in per) / len(per) <= 0.75 * 16


def test_pipeline_stages_take_nulls_repeats_and_clashing_names(spark):
    """Every stage keeps its columns and defines what becomes of odd rows."""
    import corpus_pipeline

    rows = [(None, None, None, None), (None, "no id here, some words of a text", "en", "src0"), (1, "", "en", "src0"), (2, "a short text", None, "src1"), (2, "a short text", None, "src1"), (2, "another text of the same id", "fr", None), (3, "long " * 30_000 + "end", "de", "new")]
    names = ["_id", "_said", "_leaks", "_hits", "_text", "_toxicity", "_row", "rank", "stream", "mix_slot", "_k1", "_part"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *names) for r in rows], schema)
    kept = {"toxicity": 7, "near copies": 6, "decontamination": 7, "mixing": 7, "sharding": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert sorted(c for c in out.columns if c not in ("shard", "slot")) == sorted(docs.columns)
        got = out.collect()
        assert len(got) == kept[name] and all(r["_id"] == "_id" and r["mix_slot"] == "mix_slot" for r in got)
        assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}


def test_the_mix_survives_sharding(spark):
    """Within each shard the slots go by the mix; without the stage of mixing they don't, and shards are the same."""
    from corpus_pipeline import mixed, sharded
    from sigilo.llm.common import settle

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain, inside = settle(docs.repartition(3, "doc_id")), settle(mixed(spark, docs, SF))
    slots = {}
    for name, given in (("mixed", inside), ("plain", plain)):
        rows = sharded(spark, given, SF).collect()
        assert len(rows) == docs.count()
        for k in range(16):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
        slots[name] = {r.doc_id: (r.shard, r.slot) for r in rows}
    place = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mix(docs, QUOTAS).collect()}
    for k in range(16):
        own = [d for d, (shard, _) in slots["mixed"].items() if shard == k]
        assert sorted(own, key=lambda d: slots["mixed"][d][1]) == sorted(own, key=place.get)
    assert {d: s for d, (s, _) in slots["mixed"].items()} == {d: s for d, (s, _) in slots["plain"].items()}
    assert sum(slots["mixed"][d] != slots["plain"][d] for d in place) > len(place) / 2


def test_rows_without_files_go_by_the_curve(spark):
    from corpus_pipeline import sharded

    df = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sharding.file_order(df) == [] and sharded(spark, df, SF).count() == 40


def test_groups_of_equal_texts_lie_in_one_shard(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the text of the group "), F.floor(F.col("id") / 30)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows = sharding.shard(df).collect()
    of = {}
    for r in rows:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(of) == 200 and all(len(v) == 1 for v in of.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 30 * max(r.size for r in rows)
