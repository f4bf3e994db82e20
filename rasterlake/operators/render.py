"""Rendering rows to SVG text: layouts, element strings and layer order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers from the bottom up.
LAYERS = ("g_axes", "g_curves", "g_annotations", "g_text", "g_markers")


def many(df: DataFrame) -> DataFrame:
    """A table with rows for every figure, which joins must not gather on the driver: files of few bytes may hold very many rows, so their size
    doesn't tell."""
    return df.hint("merge")


def grid_cells(sizes: DataFrame, width: str, height: str, rows: int, cols: int) -> DataFrame:
    """Cells of a rows x cols grid for each canvas (EXT-07): row, col, x, y, w, h by the margin rules."""
    m = lambda c, r, least: F.greatest((F.col(c) * r).cast("int"), F.lit(least))
    mx, my, head, gx, gy = m(width, 0.06, 36), m(height, 0.06, 28), m(height, 0.12, 70), m(width, 0.04, 18), m(height, 0.05, 20)
    w = (F.col(width) - 2 * mx - gx * (cols - 1)) / cols
    h = (F.col(height) - my - head - gy * (rows - 1)) / rows
    d = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    d = d.withColumn("row", F.floor(F.col("cell") / cols).cast("int")).withColumn("col", (F.col("cell") % cols).cast("int"))
    return d.select(*sizes.columns, "row", "col", F.bround(mx + F.col("col") * (w + gx), 4).alias("x"), F.bround(head + F.col("row") * (h + gy), 4).alias("y"), F.bround(w, 4).alias("w"), F.bround(h, 4).alias("h"))


def escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def element(tag: str, attrs: dict[str, Column], text: Column | None = None) -> Column:
    """An element's text; null attributes are left out (RND-01)."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), escaped(v.cast("string")), F.lit('"')), F.lit("")) for k, v in attrs.items()]
    end = F.lit("/>") if text is None else F.concat(F.lit(">"), escaped(text), F.lit(f"</{tag}>"))
    return F.concat(F.lit(f"<{tag}"), *parts, end)


def documents(elements: DataFrame, key: str, layer: str, order: list[str], body: str, width: Column, height: Column) -> DataFrame:
    """One SVG a key: elements in layer order, then by order (SRT-06, RND-02, SRC-17). A figure is bounded."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LAYERS)), F.col(layer)), F.lit(0))
    sorted_ = F.array_sort(F.collect_list(F.struct(rank.alias("r"), *order, F.col(layer).alias("l"), F.col(body).alias("b"))))
    d = elements.groupBy(key).agg(sorted_.alias("e"), F.max(width).alias("w"), F.max(height).alias("h"))
    group = lambda name: F.concat(F.lit(f'<g id="{name}">'), F.array_join(F.transform(F.filter("e", lambda s: s["l"] == name), lambda s: s["b"]), ""), F.lit("</g>"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d"><g id="figure_root">', F.col("w").cast("int"), F.col("h").cast("int"))
    return d.select(key, F.concat(head, *[group(n) for n in LAYERS], F.lit("</g></svg>")).alias("svg"))


def control_points(p0: tuple, p1: tuple, p2: tuple, p3: tuple) -> list[Column]:
    """Catmull-Rom to Bezier (ALG-09): the two inner control points of the segment p1 to p2."""
    return [p1[0] + (p2[0] - p0[0]) / 6, p1[1] + (p2[1] - p0[1]) / 6, p2[0] - (p3[0] - p1[0]) / 6, p2[1] - (p3[1] - p1[1]) / 6]


def arrow(tip_x: Column, tip_y: Column, angle: Column, size: float, spread: float = 0.5) -> Column:
    """Corners of a triangular arrow head (ALG-15)."""
    side = lambda s: F.struct((tip_x - size * F.cos(angle + s * spread)).alias("x"), (tip_y - size * F.sin(angle + s * spread)).alias("y"))
    return F.array(F.struct(tip_x.alias("x"), tip_y.alias("y")), side(1), side(-1))
