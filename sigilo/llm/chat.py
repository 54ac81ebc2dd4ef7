"""Chat formatting: each dialogue is rendered once for every participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, with_rank

#: Turns of a part. A longer dialogue goes on in further parts, so no row gathers an unbounded dialogue.
PART_TURNS = 512


#: Signs that a name can't have in a header, and what they are written as: the escape sign itself, the header's bar, line ends.
ESCAPES = (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D"))
UNKNOWN = "unknown"


def speaker(role: Column) -> Column:
    """The name of a speaker, another one for every role: the role with ESCAPES, case, spaces and letters of any script as they are.

    Only null and empty roles are 'unknown' (that role itself is '%75nknown'), and 'system' in any case is the system.
    """
    name = role
    for sign, written in ESCAPES:
        name = F.replace(name, F.lit(sign), F.lit(written))
    return F.when(F.coalesce(role, F.lit("")) == "", UNKNOWN).when(role == UNKNOWN, "%75nknown").when(F.lower(F.trim(role)) == "system", "system").otherwise(name)


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each conversation part and participant: conv_id, part, perspective, n_turns, n_trained, rendered, loss_spans.

    The perspective's own turns have the header <|assistant|>, other speakers' are <|user name=...|>, system
    turns are <|system|> for all. loss_spans lists 'start-end;' code-point ranges of rendered that are
    trained on: text and end mark of the perspective's turns. A speaker who says nothing in a part has empty spans.
    Participants are all speakers but the system; a dialogue of system turns alone has none, and no row. A dialogue of over
    part_turns turns has several parts, whose renderings in order are the whole.

    Turns go by turn, then role, then text (nulls first), so ties and repeated rows have a defined order and
    stay. Null text is empty; '<|' in a text becomes '< |', so no text can open a header. Null roles and
    null conv_id are values of their own. An empty table gives none. Extra columns are not looked at.
    """
    said = turns.select("conv_id", "turn", speaker(F.col("role")).alias("name"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"))
    ranked = with_rank(said, ["conv_id"], [F.col("turn"), F.col("name"), F.col("said")])
    ranked = settle(ranked.select("conv_id", "name", "said", "rank", F.floor(F.col("rank") / part_turns).alias("piece")))
    parts = ranked.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "said"))).alias("turns"))
    people = ranked.where("name <> 'system'").groupBy(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).agg(F.count(F.lit(1)).alias("_n"))
    parts, people = settle(parts), settle(people)
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def rendered(t: Column) -> Column:
        own = t["name"] == F.col("perspective")
        head = F.when(t["name"] == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
        head = head.otherwise(F.concat(F.lit("<|user name="), t["name"], F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(t["said"], F.lit("<|end|>")).alias("body"), own.alias("own"))

    lines = F.transform("turns", rendered)
    each = each.select("conv_id", F.col("piece").cast("int").alias("part"), "perspective", lines.alias("lines"))

    def further(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.when(t["own"], F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(";"))).otherwise(F.lit(""))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))
    return each.select(
        "conv_id", "part", "perspective",
        F.size("lines").alias("n_turns"), F.size(F.filter("lines", lambda t: t["own"])).alias("n_trained"),
        F.array_join(F.transform("lines", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("lines", begin, further, lambda acc: acc["spans"]).alias("loss_spans"),
    )
