"""Figures from rows: line plots and flow charts, as element rows for render.documents()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import render

BOX = (80.0, 40.0, 640.0, 400.0)


def _row(df: DataFrame, key: str, layer: str, rank: Column, body: Column) -> DataFrame:
    return df.select(key, F.lit(layer).alias("layer"), rank.cast("double").alias("o"), body.alias("body"))


def line_plot(points: DataFrame, key: str, series: str, x: str, y: str, ticks: int = 5, box: tuple = BOX) -> DataFrame:
    """Element rows of one plot a key (RND-04): axes, ticks with labels, one polyline a series in order of x, and a
    legend. Ranges come from the data (AGG-33); a key whose range is empty has no polyline."""
    ox, oy, w, h = box
    span = points.groupBy(key).agg(*[f(c).cast("double").alias(f"{n}{c}") for c in (x, y) for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    lo_x, hi_x, lo_y, hi_y = (F.col(f"{n}{c}") for c in (x, y) for n in ("lo_", "hi_"))
    p = points.join(span, key)
    at = F.struct(F.col(x).alias("x"), F.concat_ws(",", X.to_plot(F.col(x).cast("double"), lo_x, hi_x, ox, w, digits=2), X.to_plot(F.col(y).cast("double"), lo_y, hi_y, oy, h, True, 2)).alias("p"))
    lines = p.filter((hi_x > lo_x) & (hi_y > lo_y)).groupBy(key, series).agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["p"]), " ").alias("points"))
    rank = F.xxhash64(series).cast("double")
    axes = [
        _row(span, key, "g_axes", F.lit(0), render.element("line", {"id": F.lit("axis_x"), "x1": F.lit(ox), "y1": F.lit(oy + h), "x2": F.lit(ox + w), "y2": F.lit(oy + h), "stroke": F.lit("#000000")})),
        _row(span, key, "g_axes", F.lit(1), render.element("line", {"id": F.lit("axis_y"), "x1": F.lit(ox), "y1": F.lit(oy), "x2": F.lit(ox), "y2": F.lit(oy + h), "stroke": F.lit("#000000")})),
    ]
    t = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    share = F.col("i") / (ticks - 1)
    label = lambda lo, hi: F.format_string("%.2f", lo + (hi - lo) * share)
    marks = [
        _row(t, key, "g_text", F.col("i"), render.element("text", {"id": F.concat(F.lit("tick_x"), "i"), "x": F.bround(ox + share * w, 2), "y": F.lit(oy + h + 16), "text-anchor": F.lit("middle")}, label(lo_x, hi_x))),
        _row(t, key, "g_text", F.col("i") + 100, render.element("text", {"id": F.concat(F.lit("tick_y"), "i"), "x": F.lit(ox - 6), "y": F.bround(oy + h - share * h, 2), "text-anchor": F.lit("end")}, label(lo_y, hi_y))),
    ]
    curves = _row(lines, key, "g_curves", rank, render.element("polyline", {"id": F.concat(F.lit("s_"), F.col(series)), "points": F.col("points"), "fill": F.lit("none")}))
    legend = _row(lines, key, "g_annotations", rank, render.element("text", {"id": F.concat(F.lit("legend_"), F.col(series)), "x": F.lit(ox + w + 8), "text-anchor": F.lit("start")}, F.col(series)))
    return reduce(DataFrame.unionByName, [*axes, *marks, curves, legend])


#: Fixed values of flow charts: padding, font and line height of nodes, font of labels, corner of nodes and of lanes, size of heads.
PADDING, FONT, LINE, LABEL, CORNER, LANE_CORNER, HEAD = 12.0, 12.0, 14.0, 10.0, 8.0, 6.0, 10.0


def _tspans(name: Column, x: Column, lines: Column) -> Column:
    """Lines of a text, one below the other, as escaped elements."""
    one = lambda t, i: F.concat(F.lit('<tspan id="'), render.escaped(name), F.lit("_line"), i.cast("string"), F.lit('" x="'), x.cast("string"), F.when(i > 0, F.lit(f'" dy="{LINE}')).otherwise(F.lit("")), F.lit('">'), render.escaped(t), F.lit("</tspan>"))
    return F.array_join(F.transform(lines, one), "")


def _block(name: Column, x: Column, y: Column, lines: Column, size: float) -> Column:
    """A text element of several lines."""
    head = render.element("text", {"id": name, "x": x, "y": y, "font-family": F.lit("Arial, sans-serif"), "font-size": F.lit(size), "text-anchor": F.lit("start"), "fill": F.lit("#000000")}, F.lit(""))
    return F.concat(F.substring_index(head, "</text>", 1), _tspans(name, x, lines), F.lit("</text>"))


def arrow_points(tip: Column, before: Column, kind: Column, size: float = HEAD) -> Column:
    """Corners of an arrow head (ALG-15) at the end of a step from before to tip (structs x, y), half as wide as long: the tip and the two corners
    behind it, of a line the tip between them, of a diamond the far corner too; null for none and steps of no length."""
    length = X.line_length(before["x"], before["y"], tip["x"], tip["y"])
    ux, uy = (tip["x"] - before["x"]) / length, (tip["y"] - before["y"]) / length
    at = lambda back, side: F.concat_ws(",", *[(F.bround(v, 2) + 0.0).cast("string") for v in (tip["x"] - ux * back - uy * side, tip["y"] - uy * back + ux * side)])
    left, right, half = at(size, size / 2), at(size, -size / 2), at(0.0, 0.0)
    corners = F.when(kind == "line", F.concat_ws(" ", left, half, right)).when(kind == "diamond", F.concat_ws(" ", half, at(size / 2, size / 2), at(size, 0.0), at(size / 2, -size / 2))).otherwise(F.concat_ws(" ", half, left, right))
    return F.when((length > 0) & (kind != "none"), corners)


def flow(nodes: DataFrame, edges: DataFrame, key: str, lanes: DataFrame | None = None) -> DataFrame:
    """Element rows of one flow chart a key (RND-05). nodes: key, id, x, y, width, height, text and, where given, rx, ry; edges: key, a, b, label and,
    where given, points (array of struct x, y), dashed, dasharray (text), arrow; lanes: key, id, label, x, y, width, height.

    A node's text stands in lines: its own, or else wrapped to its width. An edge goes through its points, two at least; without them from
    the side of one node that faces the other, by their middles, to the facing side. The head (triangle unless given:
    triangle_open, line, diamond, none) follows the last step, the label stands 6 above the middle between the ends. Edges without points
    whose nodes don't exist are left out; missing_ends() reports them."""
    for name, kind in (("rx", "double"), ("ry", "double")):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    for name, kind in (("points", "array<struct<x:double,y:double>>"), ("dashed", "boolean"), ("dasharray", "string"), ("arrow", "string")):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast(kind))
    n = nodes.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "width", "height")}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(CORNER)) for c in ("rx", "ry")})
    side = n.select(key, F.col("id"), F.struct("x", "width", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")).alias("n"))
    j = edges.withColumn("points", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    j = j.join(side.withColumnsRenamed({"id": "a", "n": "s"}), [key, "a"], "left").join(side.withColumnsRenamed({"id": "b", "n": "t"}), [key, "b"], "left")
    forth = F.col("s.cx") <= F.col("t.cx")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    start = point(F.when(forth, F.col("s.x") + F.col("s.width")).otherwise(F.col("s.x")), F.col("s.cy"))
    end = point(F.when(forth, F.col("t.x")).otherwise(F.col("t.x") + F.col("t.width")), F.col("t.cy"))
    between = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.array(start, end))
    j = j.withColumn("points", F.when(F.size(F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>"))) >= 2, F.col("points")).otherwise(between)).filter("points IS NOT NULL")
    first, last, before = F.get("points", F.lit(0)), F.element_at("points", -1), F.element_at("points", -2)
    number = lambda v: (F.bround(v, 2) + 0.0).cast("string")
    path = F.array_join(F.transform("points", lambda p: F.concat_ws(",", number(p["x"]), number(p["y"]))), " ")
    dashes = F.when(F.col("dashed"), F.coalesce("dasharray", F.lit("6,4")))
    name = F.concat_ws("_", "a", "b")
    shape = F.coalesce("arrow", F.lit("triangle"))
    j = j.withColumns({"head": arrow_points(last, before, shape), "open": shape.isin("triangle_open", "line"), "name": name})
    head = render.element("polygon", {"id": F.concat(F.lit("m_"), "name"), "points": F.col("head"), "fill": F.when(F.col("open"), "none").otherwise("#000000"), "stroke": F.when(F.col("open"), "#000000"), "stroke-width": F.when(F.col("open"), 2)})
    head = F.when(shape == "line", F.replace(head, F.lit("<polygon"), F.lit("<polyline"))).otherwise(head)
    # lines of a text: as given, else as many words as fit
    each = F.greatest(F.floor((F.col("width") - 2 * PADDING) / (0.55 * FONT)), F.lit(1)).cast("int")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    fill = lambda done, t: F.when(F.size(done) == 0, F.array(t)).when(F.length(F.element_at(done, -1)) + 1 + F.length(t) <= each, F.array_append(F.slice(done, 1, F.size(done) - 1), F.concat_ws(" ", F.element_at(done, -1), t))).otherwise(F.array_append(done, t))
    given = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(t)), lambda t: t != "")
    lines = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("\n")), given).otherwise(F.aggregate(words, F.array().cast("array<string>"), fill))
    n = n.withColumn("lines", lines)
    rank = F.xxhash64("a", "b")
    box = {c: F.col(c) for c in ("x", "y", "width", "height")}
    rows = [
        _row(n, key, "g_annotations", F.xxhash64("id"), render.element("rect", {"id": F.concat(F.lit("node_"), "id"), **box, "rx": F.col("rx"), "ry": F.col("ry"), "fill": F.lit("#ffffff"), "stroke": F.lit("#000000"), "stroke-width": F.lit(2)})),
        _row(n.filter(F.size("lines") > 0), key, "g_text", F.xxhash64("id"), _block(F.concat(F.lit("txt_node_"), "id"), F.col("x") + PADDING, F.col("y") + PADDING + FONT, F.col("lines"), FONT)),
        _row(j, key, "g_curves", rank, render.element("polyline", {"id": F.concat(F.lit("e_"), "name"), "points": path, "fill": F.lit("none"), "stroke": F.lit("#000000"), "stroke-width": F.lit(2), "stroke-dasharray": dashes})),
        _row(j.filter("head IS NOT NULL"), key, "g_markers", rank, head),
        _row(j.filter("coalesce(label, '') <> ''"), key, "g_text", rank, render.element("text", {"id": F.concat(F.lit("txt_edge_"), "name"), "x": F.bround((first["x"] + last["x"]) / 2, 2), "y": F.bround((first["y"] + last["y"]) / 2 - 6, 2), "font-family": F.lit("Arial, sans-serif"), "font-size": F.lit(LABEL), "text-anchor": F.lit("start"), "fill": F.lit("#000000")}, F.col("label"))),
    ]
    if lanes is not None:  # below the nodes
        l = lanes.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "width", "height")})  # noqa: E741
        title = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("id"))
        rows.append(_row(l, key, "g_annotations", F.lit(-1e19), render.element("rect", {"id": F.concat(F.lit("lane_"), "id"), **box, "rx": F.lit(LANE_CORNER), "ry": F.lit(LANE_CORNER), "fill": F.lit("#f2f2f2"), "stroke": F.lit("#000000"), "stroke-width": F.lit(1)})))
        rows.append(_row(l, key, "g_text", F.lit(-1e19), _block(F.concat(F.lit("txt_lane_"), "id"), F.col("x") + 8, F.col("y") + 16, F.array(title), LABEL)))
    return reduce(DataFrame.unionByName, rows)


def missing_ends(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """E2227: ends of edges that name no node (JON-07)."""
    ends = edges.select(key, F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.join(nodes.select(key, "id"), [key, "id"], "left_anti").withColumn("code", F.lit("E2227"))
