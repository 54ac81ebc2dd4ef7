"""Word boxes and page areas: reading order, places of entities, lines, units, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilo.functions import text as T

from .spans import ordered_union


def band(y: Column, height: float = 5.0) -> Column:
    return F.bround(y / height) * height


def _cut(columns: list[pa.Array]) -> list[int]:
    """The rows from which on one of the columns isn't as in the row ahead, nulls being alike, and the number of rows."""
    n = len(columns[0])
    new = pa.array([False] * max(n - 1, 0), pa.bool_())
    for c in columns:
        one, two = c[1:], c[:-1]
        unlike = pc.fill_null(pc.not_equal(one, two), False)
        new = pc.or_(new, pc.or_(unlike, pc.xor(pc.is_null(one), pc.is_null(two))))
    return [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n] if n else [0]


def pages(words: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, pagina, and an array of each of the columns): the words of a page that come one after the other in a row.

    Where words come page by page, as a reader gives them, a page is a row or two, in whatever order else, a row for each word. So what is shuffled after it is
    little more than the words. Nothing is looked at across tasks: a page may be several rows.
    """
    types = dict(words.dtypes)

    def packed(batches):
        for b in batches:
            at = _cut([b.column(0), b.column(1)])
            first, ends = pa.array(at[:-1], pa.int64()), pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), *lists], names=["doc_id", "pagina", *columns])

    fields = ", ".join(f"`{c}` array<{types[c]}>" for c in columns)
    return words.select("doc_id", "pagina", *columns).mapInArrow(packed, f"doc_id {types['doc_id']}, pagina {types['pagina']}, {fields}")


def whole_pages(words: DataFrame, columns: list[str]) -> DataFrame:
    """The same with one row for each page: rows of `pages` are dealt and sorted, which spills, and those of a page are put together as they go by."""
    types = dict(words.dtypes)
    dealt = pages(words, columns).repartition("doc_id", "pagina").sortWithinPartitions("doc_id", "pagina")

    def joined(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            if not b.num_rows:
                continue
            at = _cut([c.combine_chunks() for c in b.columns[:2]])
            yield from merged(b, at[:-1])
            held = b.slice(at[-2]).combine_chunks().to_batches()[0]
        if held is not None:
            yield from merged(pa.Table.from_batches([held]), [0, held.num_rows])

    def merged(b, at):
        if len(at) > 1:
            first = pa.array(at[:-1], pa.int64())
            lists = [c.combine_chunks() for c in b.columns[2:]]
            ends = [c.offsets.take(pa.array(at, pa.int64())) for c in lists]
            lists = [pa.ListArray.from_arrays(pc.subtract(e, e[0]), c.values.slice(e[0].as_py(), e[-1].as_py() - e[0].as_py())) for c, e in zip(lists, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0).combine_chunks().take(first), b.column(1).combine_chunks().take(first), *lists], names=["doc_id", "pagina", *columns])

    fields = ", ".join(f"`{c}` array<{types[c]}>" for c in columns)
    return dealt.mapInArrow(joined, f"doc_id {types['doc_id']}, pagina {types['pagina']}, {fields}")


def _asked(entities: DataFrame) -> DataFrame:
    v = T.normal(F.col("valor"))
    return entities.select("doc_id", "ent", v.alias("v"), F.split(v, r"(?U)\s+").alias("ws")).where("v <> ''")


def multiword(words: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, ent, pagina, run, seq) of every word of every run of consecutive words of a page that reads as an entity of
    several words; run is the seq of its first word.
    """
    return _placed(words, entities, [3], False).select("doc_id", "ent", "pagina", "run", "seq")


def locate(words: DataFrame, entities: DataFrame, occurrence: str = "first") -> DataFrame:
    """(doc_id, ent, tier, pagina, seq): the words where an entity stands, by the first tier that has a place.

    Tiers: a word that equals it; one that holds it; a run of consecutive words, of which every word is told, so that all
    of the entity is covered; a word that equals its first word or begins with that and a blank.
    occurrence 'first' gives the first place of the best tier (runs: the first page, then reading order), 'all' every place.

    A page tells the places of the best tier that it has, the first ones if those are asked for; the document's best are among them.
    """
    every = _placed(words, entities, [1, 2, 3, 4], occurrence == "first")
    best = F.struct("tier", "r1", "r2") if occurrence == "first" else F.col("tier")
    return every.withColumn("_b", F.min(best).over(Window.partitionBy("doc_id", "ent"))).where(best == F.col("_b")).select("doc_id", "ent", "tier", "pagina", "seq")


def _placed(words: DataFrame, entities: DataFrame, tiers: list[int], first: bool) -> DataFrame:
    """(doc_id, ent, pagina, tier, r1, r2, run, seq): for each page and entity the words of its places of the first of the tiers that has one there.

    Pages, packed, and entities are dealt by document, and sorted: a document's entities first, then page after page, of which one is held at a time.
    """
    types, asked = dict(words.dtypes), dict(entities.dtypes)
    boxes = pages(words.select("doc_id", "pagina", T.normal(F.col("texto")).alias("t"), band(F.col("y0")).cast("double").alias("y"), F.col("x0").cast("double").alias("x"), "seq"), ["t", "y", "x", "seq"])
    e = _asked(entities)
    e = (e.where(F.size("ws") > 1) if tiers == [3] else e).select("doc_id", F.lit(0).alias("side"), "ent", "v", "ws")
    rows = e.unionByName(boxes.withColumn("side", F.lit(1)), allowMissingColumns=True).where("doc_id is not null")
    dealt = rows.select("doc_id", "side", "pagina", "ent", "v", "ws", "t", "y", "x", "seq").repartition("doc_id").sortWithinPartitions("doc_id", "side", "pagina")

    def run(batches):
        doc, own, page, held = None, [], None, []

        def told() -> list[tuple]:
            if not (own and held):
                return []
            t, y, x, seq = ([v for part in column for v in part] for column in zip(*held))
            return [(doc, ent, page, *place) for ent, *place in _on_page(t, _order(y, x, seq), seq, own, tiers, first)]

        kinds = None
        for b in batches:
            kinds = [b.schema.field(c).type for c in ("doc_id", "ent", "pagina")] + [pa.int32(), pa.int64(), pa.int64()] + [b.schema.field("seq").type.value_type] * 2
            out = []
            for here, side, pagina, ent, v, ws, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if here != doc or side == 0 or pagina != page:
                    out += told()
                    held.clear()
                if here != doc:
                    own.clear()
                doc, page = here, pagina
                if side == 0:
                    own.append((ent, v, ws))
                else:
                    held.append(rest)
            yield _rows(out, kinds)
        if kinds:
            yield _rows(told(), kinds)

    seq = types["seq"]
    return dealt.mapInArrow(run, f"doc_id {types['doc_id']}, ent {asked['ent']}, pagina {types['pagina']}, tier int, r1 long, r2 long, run {seq}, seq {seq}")


def _rows(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "ent", "pagina", "tier", "r1", "r2", "run", "seq"])


def _order(*keys: list) -> list[int]:
    """The places of the rows by the keys, nulls first, as Spark sorts them."""
    if not any(None in k for k in keys):
        return np.lexsort([np.array(k) for k in reversed(keys)]).tolist()
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    return sorted(range(len(keys[0])), key=lambda i: tuple(rank(k[i]) for k in keys))


def _on_page(t: list[str], order: list[int], seq: list, own: list[tuple], tiers: list[int], first: bool) -> list[tuple]:
    """(ent, tier, r1, r2, run, seq) of a page's words in reading order, for each entity (ent, v, ws): the places of the first tier that has one."""
    t, seq = [t[i] for i in order], [seq[i] for i in order]
    least = min((s for s in seq if s is not None), default=None)
    at, heads = {}, {}
    for k, word in enumerate(t):
        if word is not None:
            at.setdefault(word, []).append(k)
    for word in at:
        heads.setdefault(word.split(" ", 1)[0], []).append(word)
    every, out = "\0".join(at), []
    for ent, v, ws in own:
        for tier in tiers:
            if tier == 3:
                found = [(least, k + 1, k, range(k, k + len(ws))) for k in at.get(ws[0], ()) if t[k : k + len(ws)] == ws] if len(ws) > 1 else []
            else:
                named = [v] if tier == 1 else heads.get(ws[0], ()) if tier == 4 else [w for w in at if v in w] if v in every else []
                found = [(0, seq[k], k, (k,)) for word in named for k in at.get(word, ())]
            if found:
                if first:
                    best = min(found, key=lambda f: [(x is not None, x) for x in f[:2]])[:2]
                    found = [f for f in found if f[:2] == best]
                out += [(ent, tier, r1, r2, seq[k], seq[j]) for r1, r2, k, js in found for j in js]
                break
    return out


def lines(boxes: DataFrame, height: int = 20, apart: int = 15) -> DataFrame:
    """(doc_id, pagina, linha, texto): boxes in bands, a new line where the top is further from the line's start than `apart`.

    The start of a line depends on the lines before it, so a page's boxes, which a page bounds, are read one after the other.
    """
    read = F.array_sort(F.arrays_zip("band", "x", "seq", "y", "texto"))
    page = whole_pages(boxes.withColumn("band", F.floor(F.col("y") / height)), ["band", "x", "seq", "y", "texto"]).select("doc_id", "pagina", read.alias("b"))
    told = page.select("doc_id", "pagina", F.col("b.y").alias("y"), F.col("b.texto").alias("texto"))
    types = dict(boxes.dtypes)

    def cut(batches):
        for b in batches:
            rows, number, said = [], [], []
            for k, (tops, texts) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                n, start, line = -1, None, []
                for y, text in zip(tops, texts):
                    if start is None or abs(y - start) > apart:
                        if line:
                            said.append(" ".join(line))
                        n, start, line = n + 1, y, []
                        rows.append(k)
                        number.append(n)
                    line.append(text or "")
                if line:
                    said.append(" ".join(line))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(said, pa.string())], names=["doc_id", "pagina", "linha", "texto"])

    return told.mapInArrow(cut, f"doc_id {types['doc_id']}, pagina {types['pagina']}, linha int, texto string")


def to_points(x: Column, y: Column, w: Column, h: Column, page_height: Column, dpi: float, flip: bool) -> Column:
    """Pixels to points; with flip the origin moves to the lower left."""
    s = 72.0 / dpi
    top = (page_height - y - h) * s if flip else y * s
    return F.struct((x * s).alias("x0"), top.alias("y0"), ((x + w) * s).alias("x1"), (top + h * s).alias("y1"))


def scaled(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Areas on page images (img_w, img_h) to page units (largura, altura); areas off the known pages fall away."""
    out = areas.join(pages, ["doc_id", "pagina"])
    sx, sy = F.col("pdf_w") / F.col("img_w"), F.col("pdf_h") / F.col("img_h")
    return out.select("doc_id", "pagina", "tipo", (F.col("x") * sx).alias("x0"), (F.col("y") * sy).alias("y0"), ((F.col("x") + F.col("largura")) * sx).alias("x1"), ((F.col("y") + F.col("altura")) * sy).alias("y1"))


def visual_findings(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings of detectors on page images (doc_id, pagina, tipo, x, y, largura, altura, confianca, fonte) in the page's points.

    pages: doc_id, pagina, img_w, img_h, pdf_w, pdf_h. A detection without a type is a signature; pages that aren't there fall away.
    """
    typed = detections.withColumn("tipo", F.coalesce("tipo", F.lit("ASSINATURA")))
    out = typed.join(pages, ["doc_id", "pagina"])
    sx, sy = F.col("pdf_w") / F.col("img_w"), F.col("pdf_h") / F.col("img_h")
    box = [(F.col("x") * sx).alias("x0"), (F.col("y") * sy).alias("y0"), ((F.col("x") + F.col("largura")) * sx).alias("x1"), ((F.col("y") + F.col("altura")) * sy).alias("y1")]
    return out.select("doc_id", "pagina", "tipo", F.concat(F.lit("["), "tipo", F.lit(" DETECTADO]")).alias("valor"), *box, "confianca", "fonte")


def detected(images: DataFrame, detectors: dict) -> DataFrame:
    """Detections of several detectors on the same page images, one after the other. A detector is a mapInPandas function of
    (doc_id, pagina, imagem); its name is the source. One that raises in a batch gives none for that batch, the others go on."""
    schema = "doc_id long, pagina int, tipo string, x double, y double, largura double, altura double, confianca double"

    def isolated(detector):
        def run(frames):
            import pandas as pd

            for frame in frames:
                try:
                    found = list(detector(iter([frame])))
                except Exception:  # a detector's failure is its own: pages stay, and other detectors see them
                    found = []
                yield from found or [pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])]

        return run

    parts = [images.mapInPandas(isolated(d), schema).withColumn("fonte", F.lit(name)) for name, d in detectors.items()]
    return reduce(DataFrame.unionByName, parts)


def with_visual(text_findings: DataFrame, visual: DataFrame) -> DataFrame:
    """Text findings, already without repeats, and then the visual ones, all of them: those are not compared with anything."""
    return ordered_union(text_findings, visual)


def on_pages(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Areas whose page is there."""
    return areas.join(pages.select("doc_id", "pagina").distinct(), ["doc_id", "pagina"], "left_semi")


def area_plan(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pagina, areas): what a writer covers on each page that is there, in a fixed order."""
    listed = F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "tipo")))
    return on_pages(areas, pages).groupBy("doc_id", "pagina").agg(listed.alias("areas"), F.count(F.lit(1)).alias("n"))


def side_by_side(before: DataFrame, after: DataFrame, gap: int = 20) -> DataFrame:
    """(doc_id, pagina, largura, antes, depois): pages that both sides have, next to each other."""
    a = before.select("doc_id", "pagina", F.col("largura").alias("w"), F.col("texto").alias("antes"))
    b = after.select("doc_id", "pagina", F.col("texto").alias("depois"))
    return a.join(b, ["doc_id", "pagina"]).select("doc_id", "pagina", (2 * F.col("w") + gap).alias("largura"), "antes", "depois")


def scrubbed(files: DataFrame, column: str = "metadados") -> DataFrame:
    """Files with an empty map of metadata."""
    return files.withColumn(column, F.map_filter(column, lambda k, v: F.lit(False)))


def signature_score(aspect: Column, relative_y: Column, contours: Column, dark: Column) -> Column:
    """Mean of four scores: shape, place on the page, strokes, share of dark pixels (left out of the mean where null)."""
    shape = F.when(aspect.between(2.5, 5.5), 0.9).when(aspect.between(1.5, 7.0), 0.5).otherwise(0.2)
    place = F.when(relative_y > 0.6, 0.8).when(relative_y > 0.4, 0.5).otherwise(0.3)
    strokes = F.when(contours >= 8, 0.9).when(contours >= 5, 0.7).otherwise(0.4)
    ink = F.when(dark.between(0.05, 0.4), 0.8).otherwise(0.3)
    return F.when(dark.isNull(), (shape + place + strokes) / 3).otherwise((shape + place + strokes + ink) / 4)


def dark_ratio(pixels: Column) -> Column:
    """Share of grey values under 128; null for no pixel."""
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda p: p < 128)) / F.size(pixels))


def clipped(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the image; those with nothing left fall away."""
    cut = {"x0": F.greatest(F.col("x0"), F.lit(0)), "y0": F.greatest(F.col("y0"), F.lit(0)), "x1": F.least(F.col("x1"), width), "y1": F.least(F.col("y1"), height)}
    return boxes.withColumns(cut).where("x1 > x0 and y1 > y0")


def polygon_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("largura"), (F.array_max(ys) - F.array_min(ys)).alias("altura"))


def signature_like(area: Column, perimeter: Column) -> Column:
    """Contours of 50 to 50000 square pixels that are far from round."""
    return area.between(50, 50000) & (4 * 3.141592653589793 * area / (perimeter * perimeter) < 0.5)


def region_like(w: Column, h: Column, n: Column) -> Column:
    return (w >= 80) & h.between(15, 200) & (w / h).between(1.5, 10.0) & (n >= 3)


def font_fit(width: Column, height: Column, text: Column) -> Column:
    """Size and text that fit a box: 6 to 12 points, shrunk to the width, then cut."""
    size = F.least(F.greatest((height - 2) * 0.8, F.lit(6.0)), F.lit(12.0))
    wide = 0.55 * size * F.length(text)
    fitted = F.when(wide > width - 2, F.greatest((width - 2) / (0.55 * F.length(text)), F.lit(6.0))).otherwise(size)
    fits = 0.55 * fitted * F.length(text) <= width - 2
    return F.struct(fitted.alias("tamanho"), F.when(fits, text).otherwise(F.substr(text, F.lit(1), F.greatest(((width - 2) / 3.3).cast("int"), F.lit(0)))).alias("texto"))


def _clusters(frame):
    rows = frame.sort_values("seq").to_dict("records")
    seeds: list[dict] = []
    for r in rows:
        for s in seeds:
            if abs(r["x"] - s["x"]) < s["near"] and abs(r["y"] - s["y"]) < s["near"]:
                s["boxes"].append(r)
                break
        else:
            seeds.append({"x": r["x"], "y": r["y"], "near": r["near"], "boxes": [r]})
    out = []
    for k, s in enumerate(seeds):
        b = s["boxes"]
        x0, y0 = min(r["x"] for r in b), min(r["y"] for r in b)
        x1, y1 = max(r["x"] + r["largura"] for r in b), max(r["y"] + r["altura"] for r in b)
        out.append((rows[0]["doc_id"], rows[0]["pagina"], k, x0, y0, x1 - x0, y1 - y0, len(b)))
    return out


def clusters(boxes: DataFrame, near: int = 30) -> DataFrame:
    """Boxes near a seed, first come first served; the seed alone decides, so this is a loop over a page's boxes."""
    import pandas as pd

    names = ["doc_id", "pagina", "grupo", "x", "y", "largura", "altura", "n"]
    schema = "doc_id long, pagina int, grupo int, x int, y int, largura int, altura int, n int"
    keyed = boxes.withColumn("near", F.lit(near))
    return keyed.groupBy("doc_id", "pagina").applyInPandas(lambda f: pd.DataFrame(_clusters(f), columns=names), schema)
