"""Texts that hold one another, by an index of their grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def _grams(c: Column, size: Column | int) -> Column:
    """The distinct pieces of that many characters; none if there are fewer."""
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(size) if isinstance(size, int) else size)))


def contained(parts: DataFrame, wholes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, part, whole): every pair of distinct texts of the columns `part` and `whole`, equal in `by`, of which one holds the other; blank ones
    and null keys match nothing.

    An index of the wholes' grams tells how often each occurs. A part meets the wholes that hold its rarest gram (itself, if it is shorter than one), and
    those are looked into. A part with a gram that no whole has meets none. Nothing is collected.
    """
    by = list(by)
    own = parts.select(*by, "part").where("part <> ''").distinct()
    index = wholes.select(*by, "whole").where("whole <> ''").distinct()
    index = index.select(*by, "whole", F.explode(F.flatten(F.array(*[_grams(F.col("whole"), k) for k in range(1, GRAM + 1)]))).alias("gram"))
    often = index.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))
    told = own.select(*by, "part", F.explode(_grams(F.col("part"), F.least(F.lit(GRAM), F.length("part")))).alias("gram")).join(often, [*by, "gram"], "left")
    rarest = told.groupBy(*by, "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lost")).where("lost = 0")
    return rarest.join(index, [*by, "gram"]).where(F.contains("whole", "part")).select(*by, "part", "whole")
