"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, decontaminate, html_text, language, lines, minhash, mixing, repair, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("g1", "g2", "none")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), ["de", "en", "es", "fr"])
    return found.select("page_id", "url", "host", "suffix", "declared", "text_lang", "lang", F.round("probability", 6).alias("probability"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "dropped")


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_toxicity_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.fold(F.col("doc_id")) == 0
    scored = toxicity.score(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Blocks of each source in a round of 64 slots: src0 a quarter, three others an eighth each, the rest evenly.
QUOTAS = {"src0": 16, "src1": 8, "src2": 8, "src3": 8} | {f"src{k}": 1 for k in range(4, 12)} | {f"src{k}": 2 for k in range(12, 20)}


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), QUOTAS)


#: The rank file and its pattern, parameters of the operator.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN, ["doc_id"])
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2(bpe.decode("ids", RANKS), 256).alias("decoded_sha256"))


def op12_edit_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    summary, edits = repair.repair(repair.damaged(turns))
    every, named = turns.select("conv_id").distinct(), repair.digest(edits)
    out = every
    for i, found in enumerate((summary, named)):
        out = out.join(found.withColumnRenamed("conv_id", f"_{i}"), F.col("conv_id").eqNullSafe(F.col(f"_{i}")), "left").drop(f"_{i}")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    print_ = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    summed = codes.with_group_sum(coded, "label", "error", "label_error")
    return summed.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(print_).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_rotation, op2_simhash_golay, op3_language_fusion, op4_fuzzy_lines, op5_minhash_fingerprints, op6_toxicity_deobfuscated, op7_pfair_mix, op8_hilbert_shards, op9_bm25_decontamination, op10_html_text_density, op11_byte_bpe, op12_edit_automaton, op13_heap_lloyd)}


def _lloyd_sql() -> str:
    """Rounds over all parts and entries, each a step of common tables."""

    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT rid, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT rid, q.p, e, list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i])))::BIGINT AS d
  FROM q JOIN b{k} ON q.p = b{k}.p) GROUP BY rid, p)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS (SELECT b{k}.p, b{k}.e, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT q.p, e, i, sum(y[i])::BIGINT AS s, count(*) AS n FROM q JOIN a{k} ON q.rid = a{k}.rid AND q.p = a{k}.p, range(1, (SELECT max(len(y)) FROM q) + 1) t(i) GROUP BY q.p, e, i) GROUP BY p, e) m ON b{k}.p = m.p AND b{k}.e = m.e)"""

    return f"""
WITH v AS (SELECT vec_id, label, x, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
q AS (SELECT rid, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS y FROM v, range(16) t(p)),
b0 AS (SELECT p, rid AS e, y AS c FROM q WHERE rid < 64), {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM v JOIN r USING (rid)"""


def _repair_sql() -> str:
    """The least (cost, audit) of each state, row by row."""

    def one(s: str, cost: str, edit: str, row: str = "''") -> str:
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'o': {s}.o || {row}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def keep(s: str, initial: str) -> str:
        return f"CASE WHEN NOT must AND role[1] = '{initial}' THEN {one(s, 'extra', 'K', row)} ELSE {never} END"

    def make(s: str, name: str) -> str:
        return f"CASE WHEN NOT must THEN {one(s, '2 + extra', 'R', f"chr(10) || '{name}:' || text")} ELSE {never} END"

    def put_in(s: str, name: str) -> str:
        return one(s, "2", "I", f"chr(10) || '{name}:'")

    def inserted(inner: str) -> str:
        user = least("s2", *(put_in(s, "user") for s in ("s0", "s1", "s3")))
        return f"SELECT g, k, n, s0, s1, s2, {least('s3', put_in('s2', 'assistant'))} AS s3 FROM (SELECT g, k, n, s0, s1, {user} AS s2, s3 FROM ({inner}))"

    never, row = "{'c': 1000000000000, 'a': '', 'o': ''}", "chr(10) || role || ':' || text"
    begin = f"SELECT g, 0 AS k, count(*) AS n, {{'c': 0, 'a': '', 'o': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM m GROUP BY g"
    users = (*(keep(s, "u") for s in ("s0", "s1", "s3")), *(make(s, "user") for s in ("s0", "s1", "s3")))
    step = f"""SELECT w.g, m.k, n, {one("s0", "3", "D")} AS s0, {least(one("s1", "3", "D"), keep("s0", "s"))} AS s1, {least(one("s2", "3", "D"), *users)} AS s2,
    {least(one("s3", "3", "D"), keep("s2", "a"), make("s2", "assistant"))} AS s3 FROM w JOIN m ON w.g = m.g AND m.k = w.k + 1"""
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS h FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h)),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY g ORDER BY k) || left(role, 1) AS pair FROM o),
m AS (SELECT g, k, role, text, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra FROM f),
w AS ({inserted(begin)}
  UNION ALL {inserted(step)}),
e AS (SELECT g, {least("s0", "s3")} AS s FROM w WHERE k = n),
c AS (SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id, g)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.g = c.g"""


SQL: dict[str, str] = {
    "op1_chat_rotation": """
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' WHEN role = 'unknown' THEN '%75nknown' WHEN lower(trim(role)) = 'system' THEN 'system'
  ELSE replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') END AS name, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, said) - 1 AS k FROM t),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
x AS (SELECT r.conv_id, k // 512 AS part, perspective, k, said || '<|end|>' AS body, name = perspective AS own,
  CASE WHEN name = 'system' THEN '<|system|>' WHEN name = perspective THEN '<|assistant|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, perspective ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM x)
SELECT conv_id, CAST(part AS INTEGER) AS part, perspective, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS n_trained,
  string_agg(head || body || chr(10), '' ORDER BY k) AS rendered, coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT) || ';', '' ORDER BY k) FILTER (WHERE own), '') AS loss_spans
FROM y GROUP BY conv_id, part, perspective""",
    # The mix by simulation, slot after slot of every round. doc_id is unique, so no tie is left to a hash of the row.
    "op7_pfair_mix": f"""
WITH RECURSIVE q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in {**QUOTAS, mixing.OTHER: 1}.items())}) v(stream, quota)),
r AS (SELECT doc_id, source, lang, n_chars, q.stream, quota, row_number() OVER (PARTITION BY q.stream ORDER BY doc_id NULLS FIRST) - 1 AS place
  FROM documents d JOIN q ON q.stream = CASE WHEN source IN ({", ".join(f"'{k}'" for k in QUOTAS)}) THEN source ELSE '{mixing.OTHER}' END),
n AS (SELECT stream, quota, max(place // 16) + 1 AS blocks FROM r GROUP BY stream, quota),
c AS (SELECT round, list(stream ORDER BY stream) AS names, list(greatest(0, least(quota, blocks - round * quota)) ORDER BY stream) AS counts, CAST(sum(greatest(0, least(quota, blocks - round * quota))) AS BIGINT) AS width
  FROM (SELECT unnest(range(0, (SELECT max((blocks + quota - 1) // quota) FROM n))) AS round), n GROUP BY round),
e AS (SELECT round, names, counts, width, CAST(0 AS BIGINT) AS slot, list_transform(counts, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM c
  UNION ALL SELECT round, names, counts, width, slot + 1, list_transform(range(1, len(counts) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(counts) + 1), lambda i: CASE WHEN done[i] < counts[i] AND done[i] * width // counts[i] <= slot THEN ((done[i] + 1) * width + counts[i] - 1) // counts[i] * 1000 + i END), lambda x: x IS NOT NULL)) % 1000 AS p
    FROM e WHERE slot < width)),
s AS (SELECT round, names[pick] AS stream, done[pick] - 1 AS k, slot - 1 AS slot FROM e WHERE slot > 0),
b AS (SELECT round, coalesce(sum(width) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c)
SELECT doc_id, source, lang, n_chars, r.stream, place // 16 AS block, CAST(base + slot AS BIGINT) AS mix_slot, CAST(place % 16 AS INTEGER) AS mix_offset
FROM r JOIN s ON r.stream = s.stream AND place // 16 // quota = s.round AND place // 16 % quota = k JOIN b ON b.round = s.round""",
    "op12_edit_automaton": _repair_sql(),
    "op13_heap_lloyd": _lloyd_sql(),
}
