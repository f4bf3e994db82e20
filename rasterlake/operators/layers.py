"""Layers that any figure may have besides its template's (RND-01, RND-03): texts, geometry, bands, double arrows and turned labels, as element rows
(key, layer, o, body)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import render
from rasterlake.operators.templates import arrow_points

#: What stands for a missing font, anchor, size, colour, width, pattern and radius.
FONT, ANCHOR, SIZE, INK, GREY, WIDTH, DASHES, RADIUS = "Arial, sans-serif", "start", 10.0, "#000000", "#555555", 1.0, "6,4", 3.0
LINE = 1.3  # of the font size, between the lines of a text


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with null columns for those that it lacks."""
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items() if n not in df.columns}) if set(columns) - set(df.columns) else df


def _row(df: DataFrame, key: str, layer: str, rank: Column, body: Column) -> DataFrame:
    return df.select(key, F.lit(layer).alias("layer"), rank.cast("double").alias("o"), body.alias("body"))


def _number(prefix: str, rank: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad((rank - 1).cast("string"), 2, "0"))


def undrawn(items: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """Items whose text (white space collapsed, letter case apart) isn't among the texts that a template drew in the same figure. drawn: key, text."""
    plain = lambda c: F.lower(X.collapse(F.coalesce(c, F.lit(""))))
    d = items.withColumn("__t", plain(F.col("text")))
    return d.join(drawn.select(key, plain(F.col("text")).alias("__t")).distinct(), [key, "__t"], "left_anti").drop("__t")


def texts(items: DataFrame, key: str) -> DataFrame:
    """Text items in order of y, x and text; those with render false and without a place are left out, but count in the names txt_text_00 and so on.
    items: key, text, x, y and, where given, id, anchor, font_family, font_size, font_weight, dominant_baseline, fill, render. A text of
    several lines becomes as many tspans, blank ones apart."""
    kinds = {**dict.fromkeys(("id", "anchor", "font_family", "font_weight", "dominant_baseline", "fill"), "string"), "font_size": "double", "render": "boolean"}
    d = _with(items, kinds)
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col("y").cast("double"), F.lit(0.0)), F.coalesce(F.col("x").cast("double"), F.lit(0.0)), F.coalesce("text", F.lit("")))
    d = d.withColumn("rank", F.row_number().over(order)).filter(F.coalesce("render", F.lit(True)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    anchor = F.lower(F.coalesce("anchor", F.lit(ANCHOR)))
    d = d.withColumns({"name": F.coalesce(F.nullif("id", F.lit("")), _number("txt_text_", F.col("rank"))), "size": F.coalesce("font_size", F.lit(SIZE)), "x": F.col("x").cast("double"), "said": F.coalesce("text", F.lit("Unknown"))})
    attrs = {
        "id": F.col("name"), "x": F.col("x"), "y": F.col("y").cast("double"), "font-family": F.coalesce(F.nullif("font_family", F.lit("")), F.lit(FONT)), "font-size": F.col("size"), "text-anchor": F.when(anchor.isin("start", "middle", "end"), anchor).otherwise(ANCHOR),
        "fill": F.coalesce("fill", F.lit(INK)), "font-weight": F.nullif("font_weight", F.lit("")), "dominant-baseline": F.nullif("dominant_baseline", F.lit("")),
    }
    lines = F.filter(F.transform(F.split("said", r"\r?\n"), lambda t: F.trim(t)), lambda t: t != "")
    one = lambda t, i: F.concat(F.lit('<tspan id="'), render.escaped(F.col("name")), F.lit("_line"), i.cast("string"), F.lit('" x="'), F.col("x").cast("string"), F.when(i > 0, F.concat(F.lit('" dy="'), (F.bround(F.col("size") * LINE, 4)).cast("string"))).otherwise(F.lit("")), F.lit('">'), render.escaped(t), F.lit("</tspan>"))
    several = F.concat(F.substring_index(render.element("text", attrs, F.lit("")), "</text>", 1), F.array_join(F.transform(lines, one), ""), F.lit("</text>"))
    return _row(d, key, "g_text", F.col("rank"), F.when(F.contains("said", F.lit("\n")), several).otherwise(render.element("text", attrs, F.col("said"))))


def geometry(key: str, lines: DataFrame | None = None, rects: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """Lines (x1, y1, x2, y2), boxes (x, y, width, height) and markers (x, y, radius), each with role, id, stroke, stroke_width, dashed, dasharray (array of
    double), fill where given, in order of role, place and size. What lacks a coordinate isn't drawn."""
    style = {"role": "string", "id": "string", "stroke": "string", "stroke_width": "double", "dashed": "boolean", "dasharray": "array<double>", "fill": "string"}
    stroke, width = F.coalesce(F.nullif("stroke", F.lit("")), F.lit(GREY)), F.coalesce("stroke_width", F.lit(WIDTH))
    out = []

    def placed(df: DataFrame, place: list[str], order: list[str], prefix: str) -> DataFrame:
        d = _with(df, style)
        w = Window.partitionBy(key).orderBy(F.coalesce("role", F.lit("")), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in order])
        d = d.withColumn("rank", F.row_number().over(w)).withColumns({c: F.col(c).cast("double") for c in place})
        return d.filter(" AND ".join(f"{c} IS NOT NULL" for c in place)).withColumn("name", F.coalesce(F.nullif("id", F.lit("")), _number(prefix, F.col("rank"))))

    if lines is not None:
        d = placed(lines, ["x1", "y1", "x2", "y2"], ["y1", "x1", "y2", "x2"], "geom_line_")
        pattern = F.when(F.col("dashed"), F.coalesce(F.nullif(F.array_join(F.col("dasharray").cast("array<string>"), ","), F.lit("")), F.lit(DASHES)))
        attrs = {"id": F.col("name"), **{c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, "stroke": stroke, "stroke-width": width, "stroke-dasharray": pattern, "class": F.when(F.col("dashed"), "dashed")}
        out.append(_row(d, key, "g_annotations", F.col("rank"), render.element("line", attrs)))
    if rects is not None:
        d = placed(rects, ["x", "y", "width", "height"], ["y", "x", "width", "height"], "geom_rect_")
        attrs = {"id": F.col("name"), **{c: F.col(c) for c in ("x", "y", "width", "height")}, "fill": F.coalesce(F.nullif("fill", F.lit("")), F.lit("none")), "stroke": stroke, "stroke-width": width}
        out.append(_row(d, key, "g_annotations", 1e6 + F.col("rank"), render.element("rect", attrs)))
    if markers is not None:
        d = placed(_with(markers, {"radius": "double"}), ["x", "y"], ["y", "x", "radius"], "geom_marker_")
        attrs = {"id": F.col("name"), "cx": F.col("x"), "cy": F.col("y"), "r": F.coalesce(F.col("radius").cast("double"), F.lit(RADIUS)), "fill": F.coalesce(F.nullif("fill", F.lit("")), F.lit(GREY))}
        out.append(_row(d, key, "g_markers", 1e6 + F.col("rank"), render.element("circle", attrs)))
    return reduce(DataFrame.unionByName, out)


def bands(df: DataFrame, key: str) -> DataFrame:
    """Tinted bands of panels, below all else: key, panel, x, width (of the panel), y, height, fill; opacity where given. A band without height isn't drawn."""
    d = _with(df, {"opacity": "double"}).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("panel", "y"))).filter("height > 0 AND width > 0 AND fill IS NOT NULL")
    attrs = {"id": F.concat(_number("band_", F.col("rank")), F.lit("_"), "panel"), **{c: F.bround(F.col(c).cast("double"), 2) for c in ("x", "y", "width", "height")}, "fill": F.col("fill"), "fill-opacity": F.col("opacity")}
    return _row(d, key, "g_axes", -1e17 + F.col("rank"), render.element("rect", attrs))


def double_arrows(df: DataFrame, key: str, size: float = 8.0) -> DataFrame:
    """Lines with a head at both ends, and a label 6 above the middle of level ones, 6 to the right of others (RND-03). df: key, id, x1, y1, x2, y2, label and,
    where given, stroke. One of no length has no heads."""
    d = _with(df, {"stroke": "string", "label": "string"}).withColumns({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}).withColumn("ink", F.coalesce("stroke", F.lit(INK)))
    point = lambda a: F.struct(F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"))
    d = d.withColumns({f"head{a}": arrow_points(point(a), point(3 - a), F.lit("triangle"), size) for a in (1, 2)})
    rank = F.xxhash64("id")
    line = render.element("line", {"id": F.concat(F.lit("span_"), "id"), **{c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, "stroke": F.col("ink"), "stroke-width": F.lit(1)})
    heads = [_row(d.filter(F.col(f"head{a}").isNotNull()), key, "g_markers", rank, render.element("polygon", {"id": F.concat(F.lit(f"span_head{a}_"), "id"), "points": F.col(f"head{a}"), "fill": F.col("ink")})) for a in (1, 2)]
    level = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    x, y = (F.col("x1") + F.col("x2")) / 2 + F.when(level, 0.0).otherwise(6.0), (F.col("y1") + F.col("y2")) / 2 - F.when(level, 6.0).otherwise(0.0)
    label = render.element("text", {"id": F.concat(F.lit("txt_span_"), "id"), "x": F.bround(x, 2), "y": F.bround(y, 2), "font-family": F.lit(FONT), "font-size": F.lit(SIZE), "text-anchor": F.when(level, "middle").otherwise("start"), "fill": F.col("ink")}, F.col("label"))
    return reduce(DataFrame.unionByName, [_row(d, key, "g_annotations", rank, line), *heads, _row(d.filter("coalesce(label, '') <> ''"), key, "g_text", rank, label)])


def turned(df: DataFrame, key: str) -> DataFrame:
    """Labels turned about their place (RND-03): key, id, text, x, y, angle (degrees; null or 0 isn't turned)."""
    x, y = F.bround(F.col("x").cast("double"), 2), F.bround(F.col("y").cast("double"), 2)
    about = F.when(F.coalesce(F.col("angle").cast("double"), F.lit(0.0)) != 0, F.concat(F.lit("rotate("), F.col("angle").cast("double").cast("string"), F.lit(" "), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")))
    attrs = {"id": F.concat(F.lit("txt_turned_"), "id"), "x": x, "y": y, "font-family": F.lit(FONT), "font-size": F.lit(SIZE), "text-anchor": F.lit("middle"), "fill": F.lit(INK), "transform": about}
    return _row(df.filter("x IS NOT NULL AND y IS NOT NULL"), key, "g_text", F.xxhash64("id"), render.element("text", attrs, F.coalesce("text", F.lit(""))))
