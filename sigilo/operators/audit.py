"""The audit log: append, last entry, period, statistics, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilo.functions import text as T


def last_write(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The last entry of each job: an aggregate that is taken ahead of the shuffle, no sort. `order` is any column with an order."""
    last = log.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "job_id"]), order).alias("_last"))
    return last.select("job_id", "_last.*").select(*log.columns)


def lookup(log: DataFrame, job_id: str, order: str = "line_no") -> DataFrame:
    """The last entry of one job, or none."""
    return last_write(log.where(F.col("job_id") == job_id), order)


#: What the service tells of an entry. The hidden file's name, the digests and the time of work stay inside.
TOLD = ("job_id", "timestamp", "arquivo_original", "hash_original", "hash_anonimizado", "total_redacoes", "regras_aplicadas", "usuario", "ip_origem")


def told(log: DataFrame) -> DataFrame:
    return log.select(*[c for c in TOLD if c in log.columns])


def between(log: DataFrame, start: str, end: str) -> DataFrame:
    """Entries of a period, both ends in it; those without a readable time fall away."""
    at = T.iso_time(F.col("timestamp"))
    return log.where(at.between(T.iso_time(F.lit(start)), T.iso_time(F.lit(end))))


def statistics(log: DataFrame) -> DataFrame:
    """Jobs, redactions and whole mean milliseconds; zeros for an empty log."""
    n = F.count(F.lit(1))
    mean = F.when(n > 0, F.floor(F.sum("tempo_processamento_ms") / n)).otherwise(0)
    return log.agg(n.alias("jobs"), F.coalesce(F.sum("total_redacoes"), F.lit(0)).alias("redacoes"), mean.cast("long").alias("media_ms"))


def jobs_by_rule(log: DataFrame) -> DataFrame:
    """Jobs, not redactions, that each rule was applied in."""
    return log.select("job_id", F.explode(F.array_distinct("regras_aplicadas")).alias("regra")).groupBy("regra").agg(F.count(F.lit(1)).alias("jobs"))


def digest(findings: DataFrame) -> DataFrame:
    """What the log may hold of findings: type and 16 digits of the hash, never the value."""
    return findings.select("job_id", "tipo", T.short_hash(F.col("valor")).alias("hash"))


def entry(findings: DataFrame, at: Column) -> DataFrame:
    """One log row for each job of findings, with its rules and digests."""
    d = F.sort_array(F.collect_list(F.struct("tipo", T.short_hash(F.col("valor")).alias("hash"))))
    out = findings.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("total_redacoes"), F.array_sort(F.collect_set("tipo")).alias("regras_aplicadas"), d.alias("dados_anonimizados"))
    return out.withColumn("timestamp", F.concat(F.date_format(F.from_utc_timestamp(at, "-03:00"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00")))


def verify(files: DataFrame, log: DataFrame) -> DataFrame:
    """(job_id, veredito): original, anonimizado, divergente or nao_encontrado, by the hashes of the job's last entry."""
    known = last_write(log).select("job_id", "hash_original", "hash_anonimizado", F.lit(True).alias("_known"))
    out = files.join(known, "job_id", "left")
    verdict = F.when(F.col("_known").isNull(), "nao_encontrado").when(F.col("hash") == F.col("hash_original"), "original").when(F.col("hash") == F.col("hash_anonimizado"), "anonimizado")
    return out.select("job_id", verdict.otherwise("divergente").alias("veredito"))
