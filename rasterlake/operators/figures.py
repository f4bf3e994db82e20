"""Figures by template, from rows to element rows for render.documents(): panels, architecture, agent loop, grid, automatic layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import extract, render

#: Issue codes of a figure of panels and what they mean.
PANEL_CODES = {
    "E2101": "not three panels", "E2103": "geometry missing", "E2105": "size not positive", "E2106": "place negative", "E2107": "outside the canvas", "E2110": "ratio missing", "E2112": "ratio out of range",
    "E2113": "ratios out of order", "E2121": "under two points", "E2123": "point without a coordinate", "E2125": "point out of range",
}


def _text(key: str, df: DataFrame, rank: Column, name: Column, x: Column, y: Column, text: Column, anchor: str = "middle", size: Column | float = 12.0, fill: Column | str = "#000000", weight: str | None = None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    attrs = {"id": name, "x": F.bround(x, 2), "y": F.bround(y, 2), "text-anchor": F.lit(anchor), "font-family": F.lit("Arial, sans-serif"), "font-size": lit(size), "fill": lit(fill), "font-weight": F.lit(weight).cast("string")}
    return _row(key, df, "g_text", rank, render.element("text", attrs, text))


def _row(key: str, df: DataFrame, layer: str, rank: Column, body: Column) -> DataFrame:
    return df.select(key, F.lit(layer).alias("layer"), rank.cast("double").alias("o"), body.alias("body"))


def _rect(key: str, df: DataFrame, layer: str, rank: Column, name: Column, box: tuple[Column, Column, Column, Column], **style: str) -> DataFrame:
    attrs = {"id": name, **{c: F.bround(v, 2) for c, v in zip(("x", "y", "width", "height"), box, strict=True)}, **{k.replace("_", "-"): F.lit(v) for k, v in style.items()}}
    return _row(key, df, layer, rank, render.element("rect", attrs))


def _line(key: str, df: DataFrame, layer: str, rank: Column, name: Column, ends: tuple[Column, Column, Column, Column], **style: str) -> DataFrame:
    attrs = {"id": name, **{c: F.bround(v, 2) for c, v in zip(("x1", "y1", "x2", "y2"), ends, strict=True)}, **{k.replace("_", "-"): F.lit(v) for k, v in style.items()}}
    return _row(key, df, layer, rank, render.element("line", attrs))


def curve_path(points: Column) -> Column:
    """A path through points (array of struct x, y) by Catmull-Rom segments (ALG-09, STR-26); null below two points."""
    n = F.size(points)
    number = lambda v: F.format_string("%.2f", v)
    at = lambda i: F.get(points, F.greatest(F.lit(0), F.least(i, n - 1)))

    def segment(i: Column) -> Column:
        p = [at(i + k) for k in (-1, 0, 1, 2)]
        c = render.control_points(*[(q["x"], q["y"]) for q in p])
        return F.concat(F.lit("C "), F.concat_ws(" ", *map(number, [*c, p[2]["x"], p[2]["y"]])))

    start = F.concat(F.lit("M "), number(at(F.lit(0))["x"]), F.lit(" "), number(at(F.lit(0))["y"]))
    return F.when(n >= 2, F.concat(start, F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), n - 2), segment), " ")))


def panel_issues(figures: DataFrame, panels: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    """key, code of what a figure of panels lacks (RND-03). figures: key, width, height, t_start, t_trigger; panels: key, panel, x, y,
    width, height; curves: key, curve, points (array of struct x, y as ratios). Values that are no numbers are missing ones."""
    # no code is told by two of the tables, so each is made unique by itself
    found = lambda df, *rules: df.select(key, F.explode(F.array_compact(F.array(*[F.when(cond, code) for code, cond in rules]))).alias("code")).distinct()
    n = figures.join(render.many(panels.groupBy(key).agg(F.count("*").alias("n"))), key, "left").fillna(0, ["n"])
    lacks = F.col("x").isNull() | F.col("y").isNull() | F.col("pw").isNull() | F.col("ph").isNull()
    p = panels.withColumnsRenamed({"width": "pw", "height": "ph"}).join(render.many(figures.select(key, "width", "height")), key)
    ratio = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    out_of = F.exists("points", lambda q: ~q["x"].between(0, 1) | ~q["y"].between(0, 1))
    rules = [
        found(n, ("E2101", F.col("n") != 3), ("E2110", F.col("t_start").isNull() | F.col("t_trigger").isNull()), ("E2112", ratio("t_start") | ratio("t_trigger")), ("E2113", F.col("t_start") >= F.col("t_trigger"))),
        found(p, ("E2103", lacks), ("E2105", (F.col("pw") <= 0) | (F.col("ph") <= 0)), ("E2106", (F.col("x") < 0) | (F.col("y") < 0)), ("E2107", (F.col("x") + F.col("pw") > F.col("width")) | (F.col("y") + F.col("ph") > F.col("height")))),
        found(curves, ("E2121", F.size(F.coalesce("points", F.array().cast(curves.schema["points"].dataType))) < 2), ("E2123", F.exists("points", lambda q: q["x"].isNull() | q["y"].isNull())), ("E2125", out_of)),
    ]
    return reduce(DataFrame.unionByName, rules)


def event_panels(figures: DataFrame, panels: DataFrame, curves: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Element rows of figures of panels (RND-03): fill, shaded time span and its guides, thresholds, two curves, axes, labels and title.
    figures: key, title, t_start, t_trigger; panels: key, panel, label, x, y, width, height, fill; curves: key, panel, curve, stroke,
    points (ratios); thresholds: key, panel, y_ratio, label. What panel_issues() reports isn't checked again."""
    d = panels.join(figures.select(key, "title", "t_start", "t_trigger"), key).withColumn("rank", F.xxhash64("panel").cast("double"))
    x, y, w, h, name = F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("panel")
    a, b = x + w * F.col("t_start"), x + w * F.col("t_trigger")
    named = lambda prefix: F.concat(F.lit(prefix), name)
    place = panels.select(key, "panel", F.col("x").alias("px"), F.col("y").alias("py"), F.col("width").alias("pw"), F.col("height").alias("ph"))
    c = curves.join(place, [key, "panel"])
    moved = F.transform("points", lambda q: F.struct((F.col("px") + F.col("pw") * q["x"]).alias("x"), (F.col("py") + F.col("ph") * (1 - q["y"])).alias("y")))
    path = render.element("path", {"id": F.concat(F.lit("curve_"), "curve", F.lit("_"), "panel"), "d": curve_path(F.col("moved")), "fill": F.lit("none"), "stroke": F.col("stroke"), "stroke-width": F.lit(2)})
    t = thresholds.join(place, [key, "panel"]).withColumn("ty", F.col("py") + F.col("ph") * (1 - F.col("y_ratio")))
    rank = F.xxhash64("panel", "y_ratio")
    rows = [
        _row(key, d.filter("fill IS NOT NULL"), "g_axes", F.lit(-1e18), render.element("rect", {"id": named("fill_"), "x": F.bround(x, 2), "y": F.bround(y, 2), "width": F.bround(w, 2), "height": F.bround(h, 2), "fill": F.col("fill")})),
        _rect(key, d, "g_axes", F.col("rank"), named("ttt_"), (a, y, b - a, h), fill="#d9d3e8", fill_opacity="0.35"),
        _line(key, d, "g_axes", F.col("rank"), named("axis_y_"), (x, y + h, x, y), stroke="#000000", stroke_width="2"),
        _line(key, d, "g_axes", F.col("rank"), named("axis_x_"), (x, y + h, x + w, y + h), stroke="#000000", stroke_width="2"),
        _line(key, d, "g_annotations", F.col("rank"), named("t_start_"), (a, y, a, y + h), stroke="#555555", stroke_dasharray="4,4"),
        _line(key, d, "g_annotations", F.col("rank"), named("t_trigger_"), (b, y, b, y + h), stroke="#555555", stroke_dasharray="4,4"),
        _line(key, t, "g_annotations", rank, F.concat(F.lit("th_"), "panel", F.lit("_"), F.col("y_ratio").cast("string")), (F.col("px"), F.col("ty"), F.col("px") + F.col("pw"), F.col("ty")), stroke="#888888", stroke_dasharray="4,4"),
        _row(key, c.withColumn("moved", moved).filter(F.size("points") >= 2), "g_curves", F.xxhash64("panel", "curve"), path),
        _text(key, d, F.col("rank"), named("txt_label_"), x + 10, y + 20, F.coalesce("label", "panel"), "start", 14.0, weight="bold"),
        _text(key, t.filter("label IS NOT NULL"), rank, F.concat(F.lit("txt_th_"), "panel", F.lit("_"), F.col("y_ratio").cast("string")), F.col("px") + F.col("pw") - 4, F.col("ty") - 4, F.col("label"), "end"),
        _text(key, figures.filter("title IS NOT NULL"), F.lit(-1e18), F.lit("txt_title"), F.lit(10.0), F.lit(20.0), F.col("title"), "start", 16.0, weight="bold"),
    ]
    return reduce(DataFrame.unionByName, rows)


def _wrapped(key: str, df: DataFrame, name: Column, x: Column, y: Column, width: Column, text: Column, font: float, most: int) -> DataFrame:
    """Text rows of a text wrapped to a width (STR-15, STR-16), most lines of it."""
    each = F.greatest(F.floor(width / (0.55 * font)), F.lit(4)).cast("int")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    step = lambda done, t: F.when(F.size(done) == 0, F.array(t)).when(F.length(F.element_at(done, -1)) + 1 + F.length(t) <= each, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), t)))).otherwise(F.array_append(done, t))
    lines = F.aggregate(words, F.array().cast("array<string>"), step)
    cut = F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most - 1), F.array(F.concat(F.get(lines, F.lit(most - 1)), F.lit("..."))))).otherwise(lines)
    d = df.withColumn("__n", name).withColumn("__x", x).withColumn("__y", y).select("*", F.posexplode(cut).alias("__i", "__t"))
    return _text(key, d, F.xxhash64("__n") + F.col("__i"), F.concat("__n", F.lit("_"), F.col("__i").cast("string")), F.col("__x"), F.col("__y") + F.col("__i") * font * 1.3, F.col("__t"), "start", font)


def architecture(sizes: DataFrame, fields: DataFrame, any_size: bool = False) -> DataFrame:
    """Element rows of architecture figures (RND-06): three panels with bullets and four work packages with goal and output. sizes: image,
    width, height, 1920 x 1080 unless any_size; fields: image, field, value, as extract.architecture_fields() gives them."""
    s = sizes if any_size else sizes.filter("width = 1920 AND height = 1080")
    fields = render.many(fields)
    boxes = extract.architecture_layout(s)
    parts = fields.select("image", F.regexp_extract_all("field", F.lit(r"^(?:panel|wp)_(.*)_(title|bullets|goal|output)$"), 1).alias("of"), F.substring_index("field", "_", -1).alias("part"), "value").filter(F.size("of") > 0)
    parts = parts.groupBy("image", F.get("of", F.lit(0)).alias("region")).agg(*[F.max(F.when(F.col("part") == n, F.col("value"))).alias(n) for n in ("title", "bullets", "goal", "output")])
    d = boxes.join(parts, ["image", "region"], "left")
    x, y, w, region = F.col("x"), F.col("y"), F.col("width"), F.col("region")
    bullets = d.filter("bullets IS NOT NULL").select("*", F.posexplode(F.split("bullets", "\n")).alias("k", "bullet"))
    heads = s.join(fields.filter("field IN ('title', 'subtitle')"), "image")
    rows = [
        _rect("image", boxes, "g_axes", F.xxhash64("region"), F.concat(F.lit("box_"), region), (x, y, w, F.col("height")), fill="none", stroke="#000000", stroke_width="2"),
        _text("image", d.filter("title IS NOT NULL"), F.xxhash64("region"), F.concat(F.lit("txt_title_"), region), x + 16, y + 32, F.col("title"), "start", 20.0, weight="bold"),
        _wrapped("image", bullets, F.concat(F.lit("txt_bullet_"), region, F.lit("_"), F.col("k").cast("string")), x + 16, y + 64 + F.col("k") * 44, w - 32, F.concat(F.lit("- "), "bullet"), 16.0, 2),
        _wrapped("image", d.filter("goal IS NOT NULL"), F.concat(F.lit("txt_goal_"), region), x + 12, y + 64, w - 24, F.concat(F.lit("Goal: "), "goal"), 16.0, 3),
        _wrapped("image", d.filter("output IS NOT NULL"), F.concat(F.lit("txt_output_"), region), x + 12, y + 140, w - 24, F.concat(F.lit("Output: "), "output"), 16.0, 3),
        _text("image", heads, F.xxhash64("field"), F.concat(F.lit("txt_"), "field"), F.col("width") / 2, F.when(F.col("field") == "title", F.col("height") * 0.08).otherwise(F.col("height") * 0.13), F.col("value"), "middle", F.when(F.col("field") == "title", 36.0).otherwise(22.0)),
    ]
    return reduce(DataFrame.unionByName, rows)


def agent_loop(sizes: DataFrame, fields: DataFrame) -> DataFrame:
    """Element rows of agent loops (RND-07): four boxes, and the signals between agent and environment. fields: image, field, value, as
    extract.loop_fields() gives them; an empty value switches constraint or buffer off."""
    fields = render.many(fields)
    boxes = extract.loop_layout(sizes).join(fields.select("image", F.col("field").alias("region"), "value"), ["image", "region"], "left")
    boxes = boxes.filter("region IN ('agent', 'environment') OR coalesce(value, '') <> ''")
    x, y, w, h, region = F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("region")
    pick = lambda r, c: F.max(F.when(region == r, F.col(c)))
    ends = boxes.groupBy("image").agg((pick("agent", "x") + pick("agent", "width")).alias("x1"), pick("environment", "x").alias("x2"), (pick("agent", "y") + pick("agent", "height") * 0.35).alias("ya"), (pick("agent", "y") + pick("agent", "height") * 0.65).alias("yb"))
    signals = ends.join(fields.filter("field IN ('action', 'feedback')"), "image").withColumn("forth", F.col("field") == "action").withColumn("y", F.when(F.col("forth"), F.col("ya")).otherwise(F.col("yb")))
    tip = F.when(F.col("forth"), F.col("x2")).otherwise(F.col("x1"))
    head = F.array_join(F.transform(render.arrow(tip, F.col("y"), F.when(F.col("forth"), 0.0).otherwise(3.141592653589793), 12.0), lambda c: F.format_string("%.2f,%.2f", c["x"], c["y"])), " ")
    title = sizes.join(fields.filter("field = 'title'"), "image")
    rows = [
        _rect("image", boxes, "g_axes", F.xxhash64("region"), F.concat(F.lit("box_"), region), (x, y, w, h), fill="none", stroke="#000000", stroke_width="2", rx="8"),
        _text("image", boxes, F.xxhash64("region"), F.concat(F.lit("txt_box_"), region), x + w / 2, y + h / 2 + 5, F.coalesce("value", "region"), "middle", 16.0),
        _line("image", signals, "g_curves", F.xxhash64("field"), F.concat(F.lit("signal_"), "field"), (F.col("x1"), F.col("y"), F.col("x2"), F.col("y")), stroke="#000000", stroke_width="2"),
        _row("image", signals, "g_markers", F.xxhash64("field"), render.element("polygon", {"id": F.concat(F.lit("head_"), "field"), "points": head, "fill": F.lit("#000000")})),
        _text("image", signals, F.xxhash64("field"), F.concat(F.lit("txt_signal_"), "field"), (F.col("x1") + F.col("x2")) / 2, F.col("y") - 8, F.col("value")),
        _text("image", title, F.lit(-1e18), F.lit("txt_title"), F.col("width") / 2, F.col("height") * 0.08, F.col("value"), "middle", 24.0, weight="bold"),
    ]
    return reduce(DataFrame.unionByName, rows)


def line_plot(sizes: DataFrame, boxes: DataFrame, series: DataFrame, texts: DataFrame, ranges: DataFrame | None = None, ticks: int = 5) -> DataFrame:
    """Element rows of line plots (RND-04): axes, ticks with labels, series as polylines (dashed ones by their pattern, or the default of
    their width), a legend at the upper right, a title and axis labels, the one of y turned upwards.

    boxes: image, x, y, width, height of the plot; series: image, series, stroke, dashed, points (array of struct x, y) and, where
    given, label, stroke_width, dasharray (array of double); texts: image, title, axis_label_x, axis_label_y; ranges: image, min_x,
    max_x, min_y, max_y, without which points are ratios. Series of under two points or an empty range aren't drawn."""
    from rasterlake.functions import figures as G

    for name, kind in (("label", "string"), ("stroke_width", "double"), ("dasharray", "array<double>")):
        if name not in series.columns:
            series = series.withColumn(name, F.lit(None).cast(kind))
    unit = {"min_x": 0.0, "max_x": 1.0, "min_y": 0.0, "max_y": 1.0}
    d = boxes.select("image", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    d = d.withColumns({k: F.lit(v) for k, v in unit.items()}) if ranges is None else d.join(ranges.select("image", *[F.col(k).cast("double").alias(k) for k in unit]), "image")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    number = lambda v: F.format_string("%.2f", v)
    t = d.filter("max_x > min_x AND max_y > min_y").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    share, i = F.col("i") / (ticks - 1), F.col("i").cast("string")
    s = series.join(d, "image").filter((F.size("points") >= 2) & (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")))
    at = lambda p: F.concat(number(x + w * (p["x"] - F.col("min_x")) / (F.col("max_x") - F.col("min_x"))), F.lit(","), number(y + h * (1 - (p["y"] - F.col("min_y")) / (F.col("max_y") - F.col("min_y")))))
    pattern = F.array_join(F.transform(G.default_dashes("dashed", "dasharray", "stroke_width", 2.0), lambda v: F.format_string("%.0f", v)), ",")
    rank = F.row_number().over(Window.partitionBy("image").orderBy("series"))
    s = s.withColumn("k", rank).withColumn("drawn", F.array_join(F.transform("points", at), " ")).withColumn("pattern", F.when(F.col("dashed"), pattern)).withColumn("wide", F.coalesce(F.col("stroke_width"), F.lit(2.0)))
    line = render.element("polyline", {"id": F.concat(F.lit("series_"), "series"), "points": F.col("drawn"), "fill": F.lit("none"), "stroke": F.col("stroke"), "stroke-width": number(F.col("wide")), "stroke-dasharray": F.col("pattern")})
    key = render.element("line", {"id": F.concat(F.lit("legend_"), "series"), "x1": F.bround(x + w - 110, 2), "y1": F.bround(y + 16 * F.col("k"), 2), "x2": F.bround(x + w - 86, 2), "y2": F.bround(y + 16 * F.col("k"), 2), "stroke": F.col("stroke"), "stroke-width": number(F.col("wide")), "stroke-dasharray": F.col("pattern")})
    named = d.join(texts, "image")
    up_x, up_y = F.bround(x - 48, 2), F.bround(y + h / 2, 2)
    turned = {"id": F.lit("txt_axis_y"), "x": up_x, "y": up_y, "text-anchor": F.lit("middle"), "font-family": F.lit("Arial, sans-serif"), "font-size": F.lit(12.0), "fill": F.lit("#000000"), "transform": F.concat(F.lit("rotate(-90 "), up_x.cast("string"), F.lit(" "), up_y.cast("string"), F.lit(")"))}
    rows = [
        _line("image", d, "g_axes", F.lit(0), F.lit("axis_x"), (x, y + h, x + w, y + h), stroke="#000000", stroke_width="2"), _line("image", d, "g_axes", F.lit(1), F.lit("axis_y"), (x, y + h, x, y), stroke="#000000", stroke_width="2"),
        _line("image", t, "g_axes", 10 + F.col("i"), F.concat(F.lit("tick_x_"), i), (x + share * w, y + h, x + share * w, y + h + 5), stroke="#000000", stroke_width="1"),
        _line("image", t, "g_axes", 100 + F.col("i"), F.concat(F.lit("tick_y_"), i), (x - 5, y + h - share * h, x, y + h - share * h), stroke="#000000", stroke_width="1"),
        _text("image", t, 10 + F.col("i"), F.concat(F.lit("txt_tick_x_"), i), x + share * w, y + h + 18, number(F.col("min_x") + (F.col("max_x") - F.col("min_x")) * share), size=10.0),
        _text("image", t, 100 + F.col("i"), F.concat(F.lit("txt_tick_y_"), i), x - 8, y + h - share * h + 4, number(F.col("min_y") + (F.col("max_y") - F.col("min_y")) * share), "end", 10.0),
        _row("image", s, "g_curves", F.col("k"), line), _row("image", s, "g_annotations", F.col("k"), key), _text("image", s, 1000 + F.col("k"), F.concat(F.lit("txt_legend_"), "series"), x + w - 80, y + 16 * F.col("k") + 4, F.coalesce("label", "series"), "start", 10.0),
        _text("image", named.filter("title IS NOT NULL"), F.lit(-1e18), F.lit("txt_title"), x + w / 2, y / 2 + 6, F.col("title"), size=16.0, weight="bold"), _text("image", named.filter("axis_label_x IS NOT NULL"), F.lit(5000), F.lit("txt_axis_x"), x + w / 2, y + h + 36, F.col("axis_label_x")),
        _row("image", named.filter("axis_label_y IS NOT NULL"), "g_text", F.lit(5001), render.element("text", turned, F.col("axis_label_y"))),
    ]
    return reduce(DataFrame.unionByName, rows)


def performance_grid(sizes: DataFrame, panels: DataFrame, series: DataFrame, rows: int, cols: int) -> DataFrame:
    """Element rows of grids of plots (RND-08): cells with axes, a title and polylines of ratio points, kept in 0 to 1, and a legend. panels:
    image, cell (from 0), title; series: image, cell, id, stroke, dashed, points (array of struct x, y)."""
    cells = render.grid_cells(sizes, "width", "height", rows, cols).withColumn("cell", F.col("row") * cols + F.col("col")).select("image", "cell", "x", "y", "w", "h")
    d = cells.join(panels, ["image", "cell"], "left")
    x, y, w, h, n = F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("cell").cast("string")
    s = series.join(cells, ["image", "cell"])
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    points = F.array_join(F.transform("points", lambda p: F.format_string("%.2f,%.2f", F.col("x") + F.col("w") * unit(p["x"]), F.col("y") + F.col("h") * (1 - unit(p["y"])))), " ")
    line = render.element("polyline", {"id": F.concat(F.lit("s_"), n, F.lit("_"), "id"), "points": points, "fill": F.lit("none"), "stroke": F.col("stroke"), "stroke-width": F.lit(2), "stroke-dasharray": F.when(F.col("dashed"), "6,4")})
    legend = series.groupBy("image", "id").agg(F.min("stroke").alias("stroke")).join(sizes, "image").withColumn("k", F.row_number().over(Window.partitionBy("image").orderBy("id")) - 1)
    left = F.col("k") * 120 + 40
    out = [
        _line("image", cells, "g_axes", F.col("cell"), F.concat(F.lit("axis_x_"), n), (x, y + h, x + w, y + h), stroke="#000000", stroke_width="2"), _line("image", cells, "g_axes", F.col("cell") + 0.5, F.concat(F.lit("axis_y_"), n), (x, y + h, x, y), stroke="#000000", stroke_width="2"),
        _row("image", s.filter(F.size("points") >= 2), "g_curves", F.xxhash64("cell", "id"), line), _text("image", d.filter("title IS NOT NULL"), F.col("cell"), F.concat(F.lit("txt_panel_"), n), x + w / 2, y - 8, F.col("title"), "middle", 14.0),
        _line("image", legend, "g_annotations", F.col("k"), F.concat(F.lit("legend_"), "id"), (left, F.col("height") - 16, left + 24, F.col("height") - 16), stroke="#000000", stroke_width="2"), _text("image", legend, F.col("k") + 1000, F.concat(F.lit("txt_legend_"), "id"), left + 30, F.col("height") - 12, F.col("id"), "start", fill=F.col("stroke")),
    ]
    return reduce(DataFrame.unionByName, out)


def auto_layout(sizes: DataFrame, panels: DataFrame) -> DataFrame:
    """Element rows of figures of a found layout (RND-09): a box and a title a panel, its curves as polylines, and a legend of the colours in
    use. panels: image, node, x, y, width, height, title, curves, as extract.auto_layout() gives them."""
    d = panels.withColumn("o", F.col("node").cast("double"))
    x, y, w, h, n = F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("node").cast("string")
    c = d.select("image", "node", F.posexplode("curves").alias("k", "c")).select("image", "node", "k", "c.*").filter(F.size("points") >= 2)
    points = F.array_join(F.transform("points", lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"])), " ")
    used = c.groupBy("image").agg(F.array_sort(F.collect_set("stroke")).alias("s")).join(sizes.select("image", F.col("height").alias("ih")), "image").select("image", "ih", F.posexplode("s").alias("k", "stroke"))
    left, low = F.lit(70) + F.col("k") * 80, F.col("ih") - 30
    rows = [
        _rect("image", d, "g_axes", F.col("o"), F.concat(F.lit("panel_"), n), (x, y, w, h), fill="none", stroke="#e0e0e0", stroke_width="1"),
        _text("image", d.filter("title IS NOT NULL"), F.col("o"), F.concat(F.lit("txt_panel_"), n), x + w / 2, y + 20, F.col("title"), "middle", 12.0, "#333333", "bold"),
        _row("image", c, "g_curves", F.col("node") * 1000 + F.col("k"), render.element("polyline", {"id": F.concat(F.lit("curve_"), n, F.lit("_"), F.col("k").cast("string")), "points": points, "fill": F.lit("none"), "stroke": F.col("stroke"), "stroke-width": F.lit(2)})),
        _row("image", used, "g_markers", F.col("k"), render.element("circle", {"id": F.concat(F.lit("legend_"), F.col("k").cast("string")), "cx": left, "cy": low - 4, "r": F.lit(4), "fill": F.col("stroke")})),
        _text("image", used, F.lit(1e9) + F.col("k"), F.concat(F.lit("txt_legend_"), F.col("k").cast("string")), left + 10, low, F.concat(F.lit("Series "), (F.col("k") + 1).cast("string")), "start", 10.0, "#333333"),
        _text("image", used.filter("k = 0"), F.lit(1e9) - 1, F.lit("txt_legend"), F.lit(20.0), low, F.lit("Legend:"), "start", 10.0, "#666666"),
    ]
    return reduce(DataFrame.unionByName, rows)
