"""Extraction of figures by template: from pixels and recognised texts to the rows that rendering takes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.functions import labels
from rasterlake.operators import colors, layout, panels, shapes, spatial
from rasterlake.operators.curves import simplify_array
from rasterlake.sources import store

#: Texts of an architecture figure whose fields weren't recognised, by field.
ARCHITECTURE = {
    "title": "Project Architecture", "subtitle": "Work Packages (WP1-WP4)",
    "panel_A_title": "Panel A: Core Platform", "panel_A_bullets": "Common services\nInterfaces and APIs\nScalable runtime",
    "panel_B_title": "Panel B: Data and Analytics", "panel_B_bullets": "Ingestion and storage\nAnalytics pipelines\nDashboards",
    "panel_C_title": "Panel C: Integration", "panel_C_bullets": "External systems\nSecurity and compliance\nDeployment ops",
    "wp_WP1_title": "WP1", "wp_WP1_goal": "Requirements and scope", "wp_WP1_output": "Architecture brief",
    "wp_WP2_title": "WP2", "wp_WP2_goal": "Core platform build", "wp_WP2_output": "MVP services",
    "wp_WP3_title": "WP3", "wp_WP3_goal": "Data pipeline and UI", "wp_WP3_output": "Reports and dashboards",
    "wp_WP4_title": "WP4", "wp_WP4_goal": "Integration and rollout", "wp_WP4_output": "Release package",
}
#: Texts of an agent loop, by field, and the region that each is read in.
LOOP = {"title": "RL Agent Loop", "agent": "Agent", "environment": "Environment", "constraint": "Constraints", "buffer": "Replay Buffer", "action": "Action", "feedback": "State / Reward"}
LOOP_REGIONS = {"title": "title", "agent": "box_agent", "environment": "box_environment", "constraint": "box_constraint", "buffer": "box_buffer", "action": "signal_action", "feedback": "signal_feedback"}
#: Colours and hues of a line plot's series, and the curves of a figure of panels.
SERIES = (("series_0", "#1f77b4", 220.0), ("series_1", "#ff7f0e", 30.0), ("series_2", "#2ca02c", 120.0), ("series_3", "#d62728", 0.0))
PANEL_CURVES = (("serving", colors.SERVING, 220.0), ("neighbor", colors.NEIGHBOR, 30.0))


def _least(v: Column, share: float, least: int) -> Column:
    return F.greatest(F.floor(v * share), F.lit(least)).cast("double")


def _boxes(sizes: DataFrame, boxes: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    one = lambda name, b: F.struct(F.lit(name).alias("region"), *[v.cast("double").alias(c) for v, c in zip(b, ("x", "y", "width", "height"), strict=True)])
    return sizes.select("image", F.explode(F.array(*[one(n, b) for n, b in boxes.items()])).alias("b")).select("image", "b.*")


def architecture_layout(sizes: DataFrame) -> DataFrame:
    """image, region, x, y, width, height of an architecture figure (EXT-05): panels A to C, the container, work packages WP1 to WP4."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    mx, my, top, pad, label, gap, step = _least(w, 0.04, 40), _least(h, 0.04, 32), _least(h, 0.28, 260), _least(h, 0.02, 18), _least(h, 0.035, 28), _least(w, 0.02, 24), _least(w, 0.015, 18)
    head = my + _least(h, 0.16, 140)
    low = head + top + _least(h, 0.04, 32)
    tall = F.greatest(h - my - low, F.floor(h * 0.25))
    panel, wide = (w - mx * 2 - gap * 2) / 3, w - mx * 2
    work = (wide - pad * 2 - step * 3) / 4
    boxes = {name: (mx + (panel + gap) * k, head, panel, top) for k, name in enumerate("ABC")}
    boxes["container"] = (mx, low, wide, tall)
    boxes |= {f"WP{k + 1}": (mx + pad + (work + step) * k, low + pad + label, work, F.greatest(tall - pad * 2 - label, label)) for k in range(4)}
    return _boxes(sizes, boxes)


def loop_layout(sizes: DataFrame) -> DataFrame:
    """image, region, x, y, width, height of an agent loop (EXT-06): agent, environment, constraint, buffer."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    mx, my, head, gap = _least(w, 0.08, 40), _least(h, 0.06, 30), _least(h, 0.14, 90), _least(h, 0.08, 50)
    bw, bh, main = w * 0.28, h * 0.2, my + head
    return _boxes(sizes, {
        "agent": (mx, main, bw, bh), "environment": (w - mx - bw, main, bw, bh),
        "constraint": ((w - bw * 0.7) / 2, F.greatest(my + head * 0.4, main - bh * 0.7), bw * 0.7, bh * 0.45), "buffer": ((w - bw * 0.75) / 2, main + bh + gap, bw * 0.75, bh * 0.45),
    })


def region_texts(items: DataFrame) -> DataFrame:
    """image, region, lines (array, in reading order), conf of the texts of each region (STR-18). items: image, region, text, conf, x, y."""
    line = F.when(X.collapse(F.coalesce("text", F.lit(""))) != "", F.struct("y", "x", X.collapse(F.col("text")).alias("t")))
    return items.groupBy("image", "region").agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]).alias("lines"), F.avg(F.coalesce(F.col("conf").try_cast("double"), F.lit(0.0))).alias("conf"))


def role_texts(texts: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """image and a column named after the role: an image's first text of that role, by y, x and item. roles: image, item, role."""
    mine = texts.join(roles.filter(F.col("role") == role).select("image", "item"), ["image", "item"], "left_semi")
    return mine.groupBy("image").agg(F.min_by(X.collapse(F.col("text")), F.struct("y", "x", "item")).alias(role))


def texts_in_regions(texts: DataFrame, regions: DataFrame, prefix: str = "") -> DataFrame:
    """image, region, text, conf, x, y of texts whose middle lies in a region, the smallest that holds it (ties by name); the name gets the
    prefix. texts: image, item, text, conf, x, y, width, height; regions: image, region, x, y, width, height. Regions of a figure
    are few."""
    r = regions.select("image", "region", *[F.col(c).alias(f"r{c}") for c in ("x", "y", "width", "height")])
    inside = panels.center_x().between(F.col("rx"), F.col("rx") + F.col("rwidth")) & panels.center_y().between(F.col("ry"), F.col("ry") + F.col("rheight"))
    found = texts.join(r, "image").filter(inside).groupBy("image", "item").agg(F.min_by(F.struct("region", "text", "conf", "x", "y"), F.struct(F.col("rwidth") * F.col("rheight"), "region")).alias("t"))
    return found.select("image", F.concat(F.lit(prefix), "t.region").alias("region"), "t.text", "t.conf", "t.x", "t.y")


def grid_panels(pixels: DataFrame, sizes: DataFrame, texts: DataFrame, rows: int = 2, cols: int = 2) -> tuple[DataFrame, DataFrame]:
    """Titles (image, cell, title) and series (image, cell, id, stroke, dashed, points as ratios) of grids of plots (EXT-07): the cells by the
    margin rules, in each a series for every dominant hue, traced as in a layout leaf, and the first text of the 24
    pixels above it."""
    from rasterlake.operators import render

    cells = render.grid_cells(sizes, "width", "height", rows, cols).select("image", (F.col("row") * cols + F.col("col")).cast("long").alias("node"), F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y"), F.floor("w").cast("double").alias("width"), F.floor("h").cast("double").alias("height"))
    found = leaf_curves(pixels, cells).join(cells, ["image", "node"])
    unit = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4)
    points = F.transform("points", lambda p: F.struct(unit((p["x"] - F.col("x")) / F.col("width")).alias("x"), unit(1 - (p["y"] - F.col("y")) / F.col("height")).alias("y")))
    rank = F.row_number().over(Window.partitionBy("image", "node").orderBy("hue"))
    series = found.withColumn("points", points).select("image", F.col("node").alias("cell"), F.concat(F.lit("series_"), (rank - 1).cast("string")).alias("id"), "stroke", (rank % 2 == 0).alias("dashed"), "points")
    c = cells.select("image", F.col("node").alias("cell"), *[F.col(n).alias(f"c{n}") for n in ("x", "y", "width")])
    above = panels.center_x().between(F.col("cx"), F.col("cx") + F.col("cwidth")) & panels.center_y().between(F.col("cy") - 24, F.col("cy"))
    titles = texts.join(c, "image").filter(above).groupBy("image", "cell").agg(F.min_by(X.collapse(F.col("text")), F.struct("y", "x", "item")).alias("title"))
    return titles, series


def sane(text: Column, least: float = 0.5) -> Column:
    """Whether at least that share of a text is letters and digits (FLT-08)."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text)) >= least, F.lit(False))


def _fields(images: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return images.select("image", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("default")) for k, v in defaults.items()])).alias("f")).select("image", "f.*")


def architecture_fields(images: DataFrame, items: DataFrame, mode: str = "hybrid", min_conf: float = 0.6) -> DataFrame:
    """image, field, value, source of an architecture figure (EXT-05): the text of its region where that was recognised with min_conf
    and is no noise ('ocr'), the default where it is noise ('rejected') or was not ('default'). Mode 'ocr_text' takes any recognised text,
    'template_text' none. Bodies of work packages give a goal and an output, bullets are one a line."""
    if mode not in ("hybrid", "ocr_text", "template_text"):
        raise ValueError(f"unknown text mode {mode!r}")
    found = region_texts(items if mode != "template_text" else items.limit(0))
    if mode == "hybrid":
        found = found.filter(F.col("conf") >= min_conf)
    found = found.filter(F.size("lines") > 0)
    body, bullet = F.endswith("region", F.lit("_body")), F.endswith("region", F.lit("_bullets"))
    pair = labels.goal_output(F.col("lines"))
    value = lambda name, v, ok: F.struct(name.alias("field"), v.alias("value"), ok.alias("ok"))
    part = lambda suffix: F.regexp_replace("region", "_body$", suffix)
    joined, listed = F.array_join("lines", " "), F.array_join(labels.bullets(F.col("lines")), "\n")
    any_text = F.lit(mode == "ocr_text")
    rows = F.when(body, F.array(value(part("_goal"), pair["goal"], F.lit(True)), value(part("_output"), pair["output"], F.lit(True)))).when(bullet, F.array(value(F.col("region"), listed, listed != ""))).otherwise(F.array(value(F.col("region"), joined, any_text | sane(joined))))
    read = found.select("image", F.explode(rows).alias("r")).select("image", "r.*").filter("coalesce(value, '') <> '' OR NOT ok")
    d = _fields(images, ARCHITECTURE).join(read, ["image", "field"], "left")
    return d.select("image", "field", F.when(F.col("ok"), F.col("value")).otherwise(F.col("default")).alias("value"), F.when(F.col("ok"), "ocr").when(~F.col("ok"), "rejected").otherwise("default").alias("source"))


def loop_fields(images: DataFrame, items: DataFrame) -> DataFrame:
    """image, field, value, source of an agent loop (EXT-06): the text of its region, else the default; a text equal to the default counts as one."""
    names = F.create_map(*[F.lit(v) for f, r in LOOP_REGIONS.items() for v in (r, f)])
    read = region_texts(items).filter(F.size("lines") > 0).select("image", F.try_element_at(names, F.col("region")).alias("field"), F.array_join("lines", " ").alias("value")).filter("field IS NOT NULL")
    d = _fields(images, LOOP).join(read, ["image", "field"], "left")
    own = F.coalesce(F.col("value") != F.col("default"), F.lit(False))
    return d.select("image", "field", F.when(own, F.col("value")).otherwise(F.col("default")).alias("value"), F.when(own, "ocr").otherwise("default").alias("source"))


def fallback_issues(fields: DataFrame) -> DataFrame:
    """image, code, fields of figures of which nothing was recognised, and of those of which something was rejected."""
    d = fields.groupBy("image").agg(F.count_if(F.col("source") == "ocr").alias("n"), F.array_sort(F.collect_set(F.when(F.col("source") == "rejected", F.col("field")))).alias("fields"))
    none = d.filter("n = 0").select("image", F.lit("W4500").alias("code"), F.array().cast("array<string>").alias("fields"))
    return none.unionByName(d.filter(F.size("fields") > 0).select("image", F.lit("W4501").alias("code"), "fields"))


def centre_lines(mask: DataFrame, sizes: DataFrame, window: int = 7, spacing: int = 120, most: int = 8, least: int = 4) -> DataFrame:
    """image, curve, points (array of struct x, y) of masks (AGG-11, WIN-16, WIN-03, WIN-04, ALG-06): the median row of each column that holds
    0.2 % of the height (2 pixels), columns between by interpolation, smoothed over window with its edges repeated, flat
    to 1.5 pixels, and simplified to three times most segments. Fewer than four columns give no curve. A line so
    straight that under five points are left is its first five, as simplify_array() says.

    The medians are aggregated before the shuffle of the columns; a curve is one bounded row."""
    s = sizes.select("image", F.greatest(F.floor(F.col("height") * 0.002), F.lit(2)).alias("few"))
    columns = mask.groupBy("image", "curve", "x").agg(F.median("y").alias("y"), F.count("*").alias("n")).join(s, "image").filter("n >= few").select("image", "curve", "x", "y")
    size = max(window, 3) + (1 - max(window, 3) % 2)
    kind = {c: mask.schema[c].dataType.simpleString() for c in ("image", "curve")}

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        xs, ys = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        out = {"image": [rows["image"].iloc[0]], "curve": [rows["curve"].iloc[0]]}
        if len(xs) < 4:
            return pd.DataFrame({**out, "points": [None]}).iloc[:0]
        full = np.arange(xs[0], xs[-1] + 1)
        padded = np.pad(np.interp(full, xs, ys), size // 2, mode="edge")
        total = np.concatenate([[0.0], np.cumsum(padded)])
        smooth = (total[size:] - total[:-size]) / size
        last = smooth[0]
        for i in range(1, len(smooth)):
            if abs(smooth[i] - last) <= 1.5:
                smooth[i] = last
            else:
                last = smooth[i]
        fewest = max(least + 1, 4)
        points = simplify_array(np.column_stack([full, smooth]), max(most * 3 + 1, fewest), fewest, max(spacing * 0.05, 2.0))
        return pd.DataFrame({**out, "points": [[{"x": float(x), "y": float(y)} for x, y in points]]})

    return columns.groupBy("image", "curve").applyInPandas(trace, f"image {kind['image']}, curve {kind['curve']}, points array<struct<x:double,y:double>>")


def ratio_points(curves: DataFrame, boxes: DataFrame) -> DataFrame:
    """Curves with points as ratios of their image's box, y upwards, kept in 0 to 1 and rounded to four digits (PRJ-16)."""
    b = boxes.select("image", *[F.col(c).alias(f"b{c}") for c in ("x", "y", "width", "height")])
    unit = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 4)
    point = lambda p: F.struct(unit((p["x"] - F.col("bx")) / F.col("bwidth")).alias("x"), unit(1 - (p["y"] - F.col("by")) / F.col("bheight")).alias("y"))
    return curves.join(b, "image").withColumn("points", F.transform("points", point)).drop("bx", "by", "bwidth", "bheight")


def hue_targets(images: DataFrame, curves: tuple[tuple[str, str, float], ...]) -> DataFrame:
    return images.select("image", F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.lit(h).alias("target")) for n, _, h in curves])).alias("c")).select("image", "c.*")


def default_plot(sizes: DataFrame) -> DataFrame:
    """image, x, y, width, height of a line plot's axes: margins of 12, 8, 18 and 12 % of its sides."""
    w, h = F.col("width"), F.col("height")
    left, right, top, bottom = (F.floor(v * s) for v, s in ((w, 0.12), (w, 0.08), (h, 0.18), (h, 0.12)))
    return sizes.select("image", left.alias("x"), top.alias("y"), (w - left - right).alias("width"), (h - top - bottom).alias("height"))


def line_plot(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, series, stroke, dashed, points of line plots (EXT-03): one series for each of SERIES whose hue is drawn, every second dashed;
    a level line where there is none."""
    mask = colors.curve_mask(pixels, hue_targets(sizes, SERIES), sizes)
    found = ratio_points(centre_lines(mask, sizes), default_plot(sizes))
    lists = F.create_map(*[v for k, (n, c, _) in enumerate(SERIES) for v in (F.lit(n), F.struct(F.lit(c).alias("stroke"), F.lit(k % 2 == 1).alias("dashed")))])
    series = found.select("image", F.col("curve").alias("series"), lists[F.col("curve")]["stroke"].alias("stroke"), lists[F.col("curve")]["dashed"].alias("dashed"), "points")
    level = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.5).alias("y")) for x in (0.0, 1.0)])
    none = sizes.select("image").join(series.select("image").distinct(), "image", "left_anti")
    return series.unionByName(none.select("image", F.lit("series_0").alias("series"), F.lit(SERIES[0][1]).alias("stroke"), F.lit(False).alias("dashed"), level.alias("points")))


def event_panels(pixels: DataFrame, sizes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row a panel of figures of three panels (EXT-02): image, panel, x, y, width, height, source, axes and times (NRM-05), fill,
    curve_colors, thresholds (array of ratios), serving and neighbor (points as ratios of the panel), n_texts.

    texts: image, item, x, y, width, height (boxes); none counts none. Panels, lines and curves are small tables that are written once."""
    ink = pixels.select("image", "y", "x", X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a")).cast("int").alias("ink"))
    found = store.saved(layout.detect_panels(ink), "panels")
    order = F.create_map(*[v for k, name in enumerate(layout.PANEL_IDS) for v in (F.lit(name), F.lit(k + 1))])
    found = found.withColumn("ord", order[F.col("panel")])
    lines = layout.axis_lines(ink, found).withColumn("ord", F.row_number().over(Window.partitionBy("image").orderBy("role", "x1", "y1"))).withColumn("stroke_width", F.lit(2))
    lines, dashes = store.saved(lines, "axes"), store.saved(colors.dash_lines(ink), "dashes")
    ends = lambda up, level: F.when(F.col("axis") == "x", F.col(up)).otherwise(F.col(level)).cast("double")
    dashed = dashes.select("image", F.row_number().over(Window.partitionBy("image").orderBy("axis", "at")).alias("ord"), ends("at", "a").alias("x1"), ends("a", "at").alias("y1"), ends("at", "b").alias("x2"), ends("b", "at").alias("y2"))
    meta = layout.panel_metadata(found, lines, dashed)
    fills, curve_colors = colors.panel_fills(pixels, found), colors.curve_colors(pixels, found)
    level = panels.panel_of(dashed.filter("y1 = y2"), found, ["image", "ord"], F.col("x1"), F.col("y1")).filter("panel IS NOT NULL").join(found.select("image", "panel", "y", "height"), ["image", "panel"])
    thresholds = level.groupBy("image", "panel").agg(F.array_sort(F.collect_set(F.bround(1 - (F.col("y1") - F.col("y")) / F.col("height"), 4))).alias("thresholds"))
    mask = colors.curve_mask(pixels, hue_targets(sizes, PANEL_CURVES), sizes)
    box = found.select("image", "panel", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.col("width")).alias("qx"), (F.col("y") + F.col("height")).alias("qy"))
    inside = spatial.pixels_in(mask, box, "px", "py", "qx", "qy").select("image", F.struct("panel", "curve").alias("c"), "x", "y")
    named = inside.select("image", F.concat_ws("|", "c.panel", "c.curve").alias("curve"), "x", "y")
    traced = centre_lines(named, sizes).withColumn("panel", F.split_part("curve", F.lit("|"), F.lit(1))).withColumn("curve", F.split_part("curve", F.lit("|"), F.lit(2)))
    one = lambda c, x, y: F.struct(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4).alias("x"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)), 4).alias("y"))
    traced = traced.join(found.select("image", "panel", "x", "y", "width", "height"), ["image", "panel"]).withColumn("points", F.transform("points", lambda p: one(p, (p["x"] - F.col("x")) / F.col("width"), 1 - (p["y"] - F.col("y")) / F.col("height"))))
    curves = traced.groupBy("image", "panel").agg(*[F.max_by("points", F.when(F.col("curve") == n, 1)).alias(n) for n, _, _ in PANEL_CURVES])
    curves = store.saved(curves, "curves")
    d = found.join(meta.drop("x0", "y0", "x1", "y1"), ["image", "panel"]).join(fills.withColumnRenamed("color", "fill"), ["image", "panel"]).join(curve_colors.withColumnRenamed("colors", "curve_colors"), ["image", "panel"])
    d = d.join(thresholds, ["image", "panel"], "left").join(curves, ["image", "panel"], "left").withColumn("thresholds", F.coalesce("thresholds", F.array().cast("array<double>")))
    if texts is None:
        return d.withColumn("n_texts", F.lit(0).cast("long"))
    held = panels.panel_of(texts, found, ["image", "item"], panels.center_x(), panels.center_y()).filter("panel IS NOT NULL").groupBy("image", "panel").agg(F.count("*").alias("n_texts"))
    return d.join(held, ["image", "panel"], "left").fillna(0, ["n_texts"])


def flow_nodes(sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """image, node, x, y, width, height, label, texts of flow charts (EXT-04, JON-04): three default nodes from left to right, and what
    is written in each, in reading order. texts: image, item, text, x, y, width, height."""
    part = lambda c, share: F.floor(F.col(c) * share).cast("double")
    w, gap = part("width", 0.22), part("width", 0.06)
    node = lambda k: F.struct(F.lit(f"n{k + 1}").alias("node"), (part("width", 0.1) + (w + gap) * k).alias("x"), part("height", 0.2).alias("y"), w.alias("width"), part("height", 0.16).alias("height"), F.lit(f"Node {k + 1}").alias("label"))
    nodes = sizes.select("image", F.explode(F.array(*map(node, range(3)))).alias("n")).select("image", "n.*")
    held = panels.panel_of(texts, nodes.select("image", F.col("node").alias("panel"), F.col("node").alias("ord"), "x", "y", "width", "height"), ["image", "item"], panels.center_x(), panels.center_y())
    inside = held.filter("panel IS NOT NULL").groupBy("image", F.col("panel").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), " ").alias("texts"))
    return nodes.join(inside, ["image", "node"], "left").withColumn("texts", F.coalesce("texts", F.lit("")))


def flow_edges(pixels: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """image, a, b, x1, y1, x2, y2, arrow of the edges between neighbouring nodes (EXT-04): from the right side of one to the left
    side of the next, and the arrow head drawn at its end ('none' below that confidence)."""
    w = Window.partitionBy("image").orderBy("node")
    middle = F.col("y") + F.col("height") / 2
    d = nodes.select("image", F.col("node").alias("a"), F.lead("node").over(w).alias("b"), (F.col("x") + F.col("width")).alias("x1"), middle.alias("y1"), F.lead("x").over(w).alias("x2"), F.lead(middle).over(w).alias("y2")).filter("b IS NOT NULL")
    heads = shapes.arrow_heads(pixels, d.select("image", F.col("b").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    return d.join(heads.select("image", F.col("end").alias("b"), F.when(F.col("confidence") >= least, F.col("kind")).otherwise("none").alias("arrow")), ["image", "b"])


def leaf_curves(pixels: DataFrame, leaves: DataFrame) -> DataFrame:
    """image, node, hue, stroke, points of the curves in layout leaves (ALG-16): one for each dominant hue of a leaf of 20 pixels or more
    a side, its stroke the mask's median colour snapped to the palette. leaves: image, node, x, y, width, height."""
    large = leaves.filter("width >= 20 AND height >= 20").select("image", "node", F.col("x").alias("lx"), F.col("y").alias("ly"), "width", "height")
    inside = spatial.pixels_in(pixels, large, "lx", "ly", F.col("lx") + F.col("width"), F.col("ly") + F.col("height"))
    part = inside.select(F.concat_ws("|", "image", "node").alias("image"), (F.col("y") - F.col("ly")).cast("long").alias("y"), (F.col("x") - F.col("lx")).cast("long").alias("x"), "r", "g", "b", "a")
    sizes = large.select(F.concat_ws("|", "image", "node").alias("image"), F.col("image").alias("whole"), "node", "lx", "ly", "width", "height")
    hues = colors.dominant_hues(part, ["image"])
    part, hues = store.saved(part, "leaves"), store.saved(hues, "hues")
    mask = store.saved(colors.curve_mask(part, hues.select("image", F.col("hue").alias("curve"), F.col("hue").alias("target")), sizes.select("image", "width", "height")), "mask")
    stroke = colors.mask_color(part, mask, ["image", "curve"])
    lines = centre_lines(mask, sizes.select("image", "height")).join(stroke, ["image", "curve"]).join(sizes, "image")
    moved = F.transform("points", lambda p: F.struct((p["x"] + F.col("lx")).alias("x"), (p["y"] + F.col("ly")).alias("y")))
    return lines.select(F.col("whole").alias("image"), "node", F.col("curve").alias("hue"), colors.snapped(F.col("color")).alias("stroke"), moved.alias("points"))


def auto_layout(pixels: DataFrame, texts: DataFrame) -> DataFrame:
    """image, node, x, y, width, height, title, curves (array of struct<hue, stroke, points>) of every leaf of the layout tree (EXT-08,
    JON-01): its title is its first text by place in the upper 15 %, else 'Panel <node>'. texts: image, item, text, x, y, width, height."""
    ink = pixels.select("image", "y", "x", X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a"), "preprocess").cast("int").alias("ink"))
    leaves = store.saved(layout.xy_cut(ink), "tree").filter("type = 'LEAF'").select("image", "node", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    held = texts.select("image", "item", "text", panels.center_x().alias("cx"), panels.center_y().alias("cy"), F.col("y").alias("ty"), F.col("x").alias("tx")).join(leaves, "image")
    held = held.filter((F.col("cx") >= F.col("x")) & (F.col("cx") < F.col("x") + F.col("width")) & (F.col("cy") >= F.col("y")) & (F.col("cy") < F.col("y") + F.col("height")))
    title = held.filter(panels.region_role(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("width"), F.col("height")) == "title").groupBy("image", "node").agg(F.min_by(F.trim("text"), F.struct("ty", "tx", "item")).alias("title"))
    curves = leaf_curves(pixels, leaves).groupBy("image", "node").agg(F.array_sort(F.collect_list(F.struct("hue", "stroke", "points"))).alias("curves"))
    d = leaves.join(title, ["image", "node"], "left").join(curves, ["image", "node"], "left")
    return d.withColumn("title", F.coalesce("title", F.concat(F.lit("Panel "), F.col("node").cast("string"))))


def deduplicate(geometry: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, boxes and circles of all collections, each without near duplicates of its own kind and collection (SET-04). geometry: keys,
    collection, kind ('line', 'rect', 'circle'), ord, a, b, c, d (x1, y1, x2, y2; x, y, width, height; x, y, radius, null)."""
    by = [*keys, "collection"]
    lines = spatial.line_dedup(geometry.filter("kind = 'line'").select(*by, "ord", F.col("a").alias("x1"), F.col("b").alias("y1"), F.col("c").alias("x2"), F.col("d").alias("y2")), by, ["x1", "y1", "x2", "y2"], "ord")
    rects = spatial.rect_nms(geometry.filter("kind = 'rect'").select(*by, "ord", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("width"), F.col("d").alias("height")), by, ["x", "y", "width", "height"], "ord")
    circles = spatial.circle_dedup(geometry.filter("kind = 'circle'").select(*by, "ord", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("radius")), by, ["x", "y", "radius"], "ord")
    kept = [d.select(*by, F.lit(kind).alias("kind"), "ord") for d, kind in ((lines, "line"), (rects, "rect"), (circles, "circle"))]
    return geometry.join(kept[0].unionByName(kept[1]).unionByName(kept[2]), [*by, "kind", "ord"], "left_semi")


def extract(pixels: DataFrame, decisions: DataFrame, texts: DataFrame, drivers: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The rows of each template's driver over the images that were decided for it (EXT-01). decisions: image, template; texts: image,
    item, text, x, y, width, height; drivers: template to a function of (pixels, sizes, texts)."""
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    out = {}
    for template, driver in drivers.items():
        mine = decisions.filter(F.col("template") == template).select("image")
        out[template] = driver(*(d.join(mine, "image", "left_semi") for d in (pixels, sizes, texts)))
    return out


#: Drivers by template and alias (ORC-09).
DRIVERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "t_3gpp_events_3panel": event_panels, "t_performance_lineplot": lambda p, s, t: line_plot(p, s), "t_procedure_flow": lambda p, s, t: flow_nodes(s, t),
    "t_project_architecture_v1": lambda p, s, t: architecture_layout(s), "t_rl_agent_loop_v1": lambda p, s, t: loop_layout(s), "t_performance_grid_v1": lambda p, s, t: grid_panels(p, s, t)[1], "t_auto_layout": lambda p, s, t: auto_layout(p, t),
}
ALIASES = {"t_3gpp_events_3panel_v1": "t_3gpp_events_3panel", "auto": "t_auto_layout"}


def driver(template: str) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """A template's driver, by its name or alias."""
    return DRIVERS[ALIASES.get(template, template)]
