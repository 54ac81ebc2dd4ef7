"""Whether an entity is to be hidden, from who it is and what stands around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import text as T

WINDOW = 80


def decide(entities: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Adds decisao struct<anonimizar, motivo> to rows (text, valor, tipo, ini, fim). One ordered CASE, cheap tests first."""
    text, ini, fim = F.col("text"), F.col("ini"), F.col("fim")
    start = F.greatest(ini - WINDOW, F.lit(0))
    before, after = F.substr(text, start + 1, ini - start), F.substr(text, fim + 1, F.lit(WINDOW))
    name = T.strip(F.col("valor"))

    def says(hide: bool, why: str) -> Column:
        return F.struct(F.lit(hide).alias("anonimizar"), F.lit(why).alias("motivo"))

    chain = F.when(allowed if allowed is not None else F.lit(False), says(False, "allowlist"))
    chain = chain.when(F.contains(F.upper(name), F.lit("OAB")), says(False, "oab no nome"))
    chain = chain.when(before.rlike(R.PUBLIC_BEFORE), says(False, "cargo publico antes"))
    chain = chain.when(after.rlike(R.PUBLIC_AFTER), says(False, "cargo publico depois"))
    chain = chain.when(after.rlike(R.QUALIFIED_AFTER), says(False, "qualificacao publica depois"))
    chain = chain.when(before.rlike(R.PRIVATE_BEFORE), says(True, "papel privado antes"))
    chain = chain.when(after.rlike(R.PRIVATE_AFTER), says(True, "papel privado depois"))
    chain = chain.when(F.col("tipo").isin("PESSOA", "PER", "PERSON"), says(True, "pessoa"))
    public = F.exists(F.array(*[F.lit(b) for b in R.PUBLIC_BODIES]), lambda b: F.contains(F.upper(name), b))
    chain = chain.when(F.col("tipo").isin("ORG", "ORGANIZACAO"), F.when(public, says(False, "ente publico")).otherwise(says(True, "organizacao privada")))
    return entities.withColumn("decisao", chain.otherwise(says(False, "nao mapeada")))
