"""The list of public names that stay visible: tests, matches, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilo.functions import text as T

from . import grams

TIPOS = ("advogado", "juiz", "promotor", "servidor")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.split(T.normal(c), r"(?U)\s+"))


def exact(names: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Rows (nome) whose normal form is an active entry's: a hash semi join."""
    active = allowlist.where("ativo").select(T.normal(F.col("nome")).alias("_n")).distinct()
    return names.join(active, T.normal(F.col("nome")) == F.col("_n"), "left_semi")


def subset(names: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Distinct names that share all tokens of the shorter side with an active entry, two tokens each side at least.

    The shorter side's rarest token is on the other side too. So names and entries meet on the rarest token of either, not on
    every common one, and are then compared.
    """
    a = names.select("nome").distinct().withColumn("t", tokens(F.col("nome"))).where(F.size("t") >= 2)
    b = allowlist.where("ativo").select(F.col("nome").alias("entry"), tokens(F.col("nome")).alias("u")).where(F.size("u") >= 2).distinct()
    x, y = a.select("nome", "t", F.explode("t").alias("token")), b.select("entry", "u", F.explode("u").alias("token"))
    often = x.select("token").unionAll(y.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    rarest = lambda side, *keys: side.join(often, "token").groupBy(*keys).agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    met = rarest(x, "nome", "t").join(y, "token").select("nome", "t", "u").unionAll(rarest(y, "entry", "u").join(x, "token").select("nome", "t", "u"))
    return met.where(F.size(F.array_intersect("t", "u")) >= F.least(F.size("t"), F.size("u"))).select("nome").distinct()


def allowed(names: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Distinct names that are on the list, by their whole or by their tokens."""
    return exact(names.select("nome").distinct(), allowlist).union(subset(names, allowlist)).distinct()


def match_first(names: DataFrame, allowlist: DataFrame) -> DataFrame:
    """(nome, entry, tipo): the first active entry that holds the name or is held by it, by tipo then place in the list.
    Names and entries meet by their rarest grams, so no name meets every entry. Blank names and entries match nothing."""
    b = allowlist.where("ativo").select(F.col("nome").alias("entry"), "tipo", "seq", T.normal(F.col("nome")).alias("e"))
    a = names.select("nome").distinct().withColumn("n", T.normal(F.col("nome")))
    n, e = a.select(F.col("n").alias("part")), b.select(F.col("e").alias("part"))
    held = grams.contained(n, e.withColumnRenamed("part", "whole")).select(F.col("part").alias("n"), F.col("whole").alias("e"))
    holds = grams.contained(e, n.withColumnRenamed("part", "whole")).select(F.col("whole").alias("n"), F.col("part").alias("e"))
    every = held.union(holds).distinct().join(a, "n").join(b, "e")
    first = every.groupBy("nome").agg(F.min(F.struct("tipo", "seq", "entry")).alias("f"))
    return first.select("nome", "f.entry", "f.tipo")


def stats(allowlist: DataFrame) -> DataFrame:
    """Active entries of each type: of the known ones without a row too, and of any other in the list."""
    known = allowlist.sparkSession.createDataFrame([(t,) for t in TIPOS], "tipo string")
    counted = allowlist.groupBy("tipo").agg(F.count_if("ativo").alias("ativos"))
    return known.join(counted, "tipo", "full").select("tipo", F.coalesce("ativos", F.lit(0)).alias("ativos"))


def route(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Adds status: 'ignorado' for persons on the list, else 'anonimizado'."""
    persons = findings.where("tipo = 'PESSOA'").select(F.col("valor").alias("nome"))
    on = allowed(persons, allowlist).select(F.col("nome").alias("_nome"), F.lit(True).alias("_on"))
    out = findings.join(on, (F.col("valor") == F.col("_nome")) & (F.col("tipo") == "PESSOA"), "left")
    return out.withColumn("status", F.when(F.col("_on"), "ignorado").otherwise("anonimizado")).drop("_nome", "_on")


def insert(allowlist: DataFrame, new: DataFrame) -> DataFrame:
    """Adds entries whose normal name isn't there under their tipo; of entries that are alike in both, the first (by seq, if there is one, and name) comes in."""
    name, tipo = T.normal(F.col("nome")), F.lower("tipo")
    there = allowlist.select(name.alias("_n"), tipo.alias("_t"))
    first = F.row_number().over(Window.partitionBy(name, tipo).orderBy(*[c for c in ("seq", "nome") if c in new.columns]))
    once = new.withColumn("_k", first).where("_k = 1").drop("_k")
    fresh = once.join(there, (name == F.col("_n")) & (tipo == F.col("_t")), "left_anti")
    return allowlist.unionByName(fresh, allowMissingColumns=True)


def delete(allowlist: DataFrame, nome: str) -> DataFrame:
    """Takes out the first entry of that name, by tipo and place."""
    hit = F.coalesce(T.normal(F.col("nome")) == T.normal(F.lit(nome)), F.lit(False))
    first = allowlist.where(hit).agg(F.min(F.struct("tipo", "seq")).alias("_first"))  # one row
    return allowlist.join(F.broadcast(first), hit & F.struct("tipo", "seq").eqNullSafe(F.col("_first")), "left_anti")


def of_tipo(allowlist: DataFrame, tipo: str | None = None) -> DataFrame:
    return allowlist if tipo is None else allowlist.where(F.lower("tipo") == tipo.lower())
