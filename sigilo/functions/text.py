"""Column functions over text: match offsets, check digits, masks, normal forms. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(strip(c))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


#: Matches that one fold takes together: a fold copies what it has gathered at each step.
FOLD = 64
_SPAN = "struct<ini:int,fim:int,valor:string,v_ini:int,v_fim:int>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression tree would repeat it at each mention."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a literal pattern as array<struct<ini, fim, valor, v_ini, v_fim>>, offsets from 0 in code points.

    The pieces between matches and the matches themselves alternate, so the offsets are running sums of their
    lengths. valor is the group if it matched, else the match; it is looked for at the match's end, then anywhere. The pattern must not match the empty string.
    Matches are folded in groups of FOLD, and the groups then, so that many matches don't cost their square.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    rows = F.filter(F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v")), lambda r: r["m"].isNotNull())
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        ini = acc["at"] + F.length(r["g"])
        kept = F.when(r["v"] == "", r["m"]).otherwise(r["v"])
        inside = F.when(F.endswith(r["m"], kept), F.length(r["m"]) - F.length(kept)).otherwise(F.instr(r["m"], kept) - 1)
        v_ini = ini + (inside if group else F.lit(0))
        span = F.struct(ini.alias("ini"), (ini + F.length(r["m"])).alias("fim"), kept.alias("valor"), v_ini.alias("v_ini"), (v_ini + F.length(kept)).alias("v_fim"))
        return let(span, lambda s: F.struct(s["fim"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["ini"] + by).alias("ini"), (s["fim"] + by).alias("fim"), s["valor"].alias("valor"), (s["v_ini"] + by).alias("v_ini"), (s["v_fim"] + by).alias("v_fim"))

    def ahead(parts: Column) -> Column:
        """What lies ahead of each part: a running sum over parts, far fewer than matches."""
        add = lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    def folded(r: Column) -> Column:
        groups = F.sequence(F.lit(0), (F.size(r) - 1).cast("int"), F.lit(FOLD))
        parts = F.transform(groups, lambda k: F.aggregate(F.slice(r, k + 1, F.lit(FOLD)), begin, step))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, ahead(ps), lambda p, by: F.transform(p["out"], lambda s: moved(s, by)))))

    none = F.array().cast(f"array<{_SPAN}>")
    return let(rows, lambda r: F.when(r.isNull() | (F.size(r) <= 0), none).otherwise(folded(r)))


def occurrences(text: Column, word: str) -> Column:
    """Offsets of all occurrences of a literal word, overlapping ones too: cuts ahead of each, and running sums of the pieces."""
    cuts = F.split(text, f"(?=\\Q{word}\\E)", -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    starts = lambda c: F.aggregate(c, begin, step, lambda acc: acc["out"])
    first = F.startswith(text, F.lit(word))
    kept = let(cuts, lambda c: F.when(first, starts(c)).otherwise(F.slice(starts(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))))
    return F.when(text.isNull() | ~F.contains(text, F.lit(word)), F.array().cast("array<int>")).otherwise(kept)


def _check(s: Column, weights: list[int]) -> Column:
    digits_ = F.slice(F.split(s, ""), 1, len(weights))
    total = F.aggregate(F.zip_with(digits_, F.array(*[F.lit(w) for w in weights]), lambda d, w: F.coalesce(d.cast("int"), F.lit(0)) * w), F.lit(0), lambda a, x: a + x)
    return let(total % 11, lambda rest: F.when(rest < 2, F.lit(0)).otherwise(F.lit(11) - rest))


CPF1, CPF2 = list(range(10, 1, -1)), list(range(11, 1, -1))
CNPJ1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
CNPJ2 = [6, *CNPJ1]


def with_checks(base: Column, first: list[int], second: list[int]) -> Column:
    """base and its two check digits."""

    def added(weights: list[int]):
        return lambda b: F.concat(b, _check(b, weights).cast("string"))

    return let(let(base, added(first)), added(second))


def cpf_of(base9: Column) -> Column:
    return with_checks(base9, CPF1, CPF2)


def cnpj_of(base12: Column) -> Column:
    return with_checks(base12, CNPJ1, CNPJ2)


def _valid(c: Column, size: int, first: list[int], second: list[int]) -> Column:
    def right(d: Column) -> Column:
        same = d.rlike(r"^(\d)\1*$")
        return (F.length(d) == size) & ~same & (with_checks(F.substring(d, 1, size - 2), first, second) == d)

    return F.coalesce(let(digits(c), right), F.lit(False))


def valid_cpf(c: Column) -> Column:
    """Eleven digits, not all equal, with right check digits; anything else, null too, is not valid."""
    return _valid(c, 11, CPF1, CPF2)


def valid_cnpj(c: Column) -> Column:
    return _valid(c, 14, CNPJ1, CNPJ2)


def snippet(text: Column, ini: Column, fim: Column, around: int = 50) -> Column:
    """...{around before}[match]{around after}..."""
    before = F.greatest(ini - around, F.lit(0))
    return F.concat(F.lit("..."), F.substr(text, before + 1, ini - before), F.lit("["), F.substr(text, ini + 1, fim - ini), F.lit("]"), F.substr(text, fim + 1, F.lit(around)), F.lit("..."))


def mask3(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 3), F.lit("***"))


def mask_long(c: Column) -> Column:
    """*** for nothing or up to four characters, else the first three and ***."""
    return F.when(c.isNull() | (F.length(c) <= 4), F.lit("***")).otherwise(mask3(c))


def hash_label(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit("---")).otherwise(F.concat(F.substring(c, 1, 16), F.lit("...")))


def short_hash(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def ellipsis(c: Column, most: int = 25) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def sanitized(name: Column) -> Column:
    """The last path segment with odd signs as underscores; 'upload' for nothing."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(base, r"(?U)[^\w\-.]", "_"), F.lit("")), F.lit("upload"))


def extension_allowed(name: Column, allowed: tuple[str, ...] = ("pdf", "docx")) -> Column:
    return F.coalesce(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*allowed) & name.contains("."), F.lit(False))


def magic_ok(content: Column, name: Column) -> Column:
    """First bytes agree with the extension: %PDF or a zip archive."""
    head, ext = F.hex(F.substring(content, 1, 4)), F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.when(ext == "pdf", head == "25504446").when(ext == "docx", head == "504B0304").otherwise(False), F.lit(False))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))


def plain(c: Column) -> Column:
    """Accents off the thirteen letters that carry them in Portuguese names."""
    return F.translate(c, "áàãâéêíóõôúüç", "aaaaeeiooouuc")


def unit_hash(c: Column) -> Column:
    """0 to 1 from the first 32 bits of MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def iso_time(c: Column) -> Column:
    """A timestamp of an ISO string with offset or Z; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def contract_digit(seed: Column, value: Column, i: int) -> Column:
    """Digit i of the deterministic stream of (seed, value)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, value, F.lit(str(i))), 256), 1, 8), 16, 10).cast("long") % 10


def contract_pick(seed: Column, value: Column, i: int, n: int) -> Column:
    """A number from 0 to n-1 of the deterministic stream of (seed, value)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, value, F.lit(str(i))), 256), 1, 8), 16, 10).cast("long") % n
