"""Layout of a figure: panels, axis lines, separators, and the recursive cut along empty stretches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import sequence

PANEL_IDS = ("A3", "A4", "A5")


def _sizes(ink: DataFrame) -> DataFrame:
    return ink.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def panel_separators(ink: DataFrame) -> DataFrame:
    """image, width, height, sep1, sep2: the least inked columns near the thirds of each image (AGG-02, WIN-03, WIN-05), by column
    sums smoothed over a twentieth of the width with edges repeated; null where they are closer than 18 % of the width.
    ink: image, y, x, ink (0 or 1), every pixel."""
    sizes = _sizes(ink)
    sums = ink.groupBy("image", "x").agg(F.sum("ink").alias("v")).join(sizes, "image")
    w = Window.partitionBy("image").orderBy("x")
    # the box is window wide; where it reaches over an edge it counts the edge's value again
    window = F.greatest(F.floor(F.col("width") * 0.05), F.lit(5))
    whole = Window.partitionBy("image")
    d = sums.withColumn("total", F.sum("v").over(w)).withColumn("first", F.first("v").over(w)).withColumn("last", F.max_by("v", "x").over(whole)).withColumn("window", window)
    totals = d.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("x", "total"))).alias("c"))  # one entry a column of the image
    d = d.join(totals.select("image", F.transform("c", lambda s: s["total"]).alias("c")), "image")
    before, after = F.floor(F.col("window") / 2), F.floor((F.col("window") - 1) / 2)
    top, bottom = F.least(F.col("x") + after, F.col("width") - 1), F.col("x") - before - 1
    inside = F.get("c", top.cast("int")) - F.when(bottom >= 0, F.get("c", bottom.cast("int"))).otherwise(0)
    over = F.greatest(F.col("x") + after - (F.col("width") - 1), F.lit(0)) * F.col("last") + F.greatest(before - F.col("x"), F.lit(0)) * F.col("first")
    d = d.withColumn("smooth", (inside + over) / F.col("window"))
    span = F.floor(F.col("width") * 0.12)

    def near(k: int) -> Column:
        target = F.floor(F.col("width") * k / 3)
        low, high = F.greatest(target - span, F.lit(0)), F.least(target + span, F.col("width"))
        return F.min_by(F.when((F.col("x") >= low) & (F.col("x") < high), F.col("x")), F.when((F.col("x") >= low) & (F.col("x") < high), F.struct("smooth", "x"))).alias(f"s{k}")

    d = d.groupBy("image", "width", "height").agg(near(1), near(2))
    good = F.col("s2") - F.col("s1") >= F.floor(F.col("width") * 0.18)
    return d.select("image", "width", "height", *[F.when(good, F.col(f"s{k}")).alias(f"sep{k}") for k in (1, 2)])


def detect_panels(ink: DataFrame) -> DataFrame:
    """image, panel, x, y, width, height of three panels side by side (ALG-11); images without two separators, or with a panel
    narrower than 15 % of the width or 40 pixels, have default panels of equal size (source 'default').

    A panel reaches from its first to its last row with over 2 % of ink between 15 % and 90 % of the height; where
    these are closer than a fifth, from a fifth to four fifths."""
    seps = panel_separators(ink)
    w, h = F.col("width"), F.col("height")
    edges = F.array(F.lit(0).cast("long"), F.col("sep1").cast("long"), F.col("sep2").cast("long"), w.cast("long"))
    fits = lambda a, b: b - a >= F.greatest(F.floor(w * 0.15), F.lit(40))
    found = F.col("sep1").isNotNull() & fits(F.lit(0), F.col("sep1")) & fits(F.col("sep1"), F.col("sep2")) & fits(F.col("sep2"), w)
    three = seps.select("image", "width", "height", found.alias("found"), edges.alias("e"), F.posexplode(F.array(*map(F.lit, PANEL_IDS))).alias("k", "panel"))
    three = three.withColumn("left", F.get("e", F.col("k"))).withColumn("right", F.get("e", F.col("k") + 1)).drop("e")
    rows = ink.filter("ink > 0").join(three.filter("found"), "image").filter((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.floor(h * 0.15)) & (F.col("y") < F.floor(h * 0.9)))
    rows = rows.groupBy("image", "panel", "left", "right", "y").agg(F.count("*").alias("n")).filter(F.col("n") > F.greatest(F.floor((F.col("right") - F.col("left")) * 0.02), F.lit(4)))
    ends = rows.groupBy("image", "panel").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    d = three.join(ends, ["image", "panel"], "left").withColumn("y0", F.coalesce("y0", F.floor(h * 0.2))).withColumn("y1", F.coalesce("y1", F.floor(h * 0.8)))
    flat = F.col("y1") - F.col("y0") < F.floor(h * 0.2)
    d = d.withColumn("top", F.when(flat, F.floor(h * 0.2)).otherwise(F.col("y0"))).withColumn("bottom", F.when(flat, F.floor(h * 0.8)).otherwise(F.col("y1")))
    margin = F.greatest(F.floor((F.col("right") - F.col("left")) * 0.04), F.lit(10))
    # default panels: margins of 4, 18 and 12 %, gaps of 2 % or 8 pixels
    gap = F.greatest(F.floor(w * 0.02), F.lit(8))
    side = F.floor(w * 0.04)
    third = (w - side * 2 - gap * 2) / 3.0
    boxes = {
        "x": (F.col("left") + margin, side + F.col("k") * (third + gap)), "y": (F.col("top"), F.floor(h * 0.18)),
        "pw": (F.greatest(F.col("right") - F.col("left") - margin * 2, F.lit(20)), third), "ph": (F.greatest(F.col("bottom") - F.col("top"), F.lit(20)), h - F.floor(h * 0.18) - F.floor(h * 0.12)),
    }
    d = d.withColumns({c: F.when(F.col("found"), x.cast("double")).otherwise(y.cast("double")) for c, (x, y) in boxes.items()})
    return d.select("image", "panel", "x", "y", F.col("pw").alias("width"), F.col("ph").alias("height"), F.when(F.col("found"), "detected").otherwise("default").alias("source"))


def axis_lines(ink: DataFrame, panels: DataFrame, share: float = 0.5) -> DataFrame:
    """image, panel, role ('axis_y' or 'axis_x'), x1, y1, x2, y2 of lines inside panels whose longest run of ink reaches share
    of the panel's height (ALG-12): neighbouring ones (3 pixels) are one line at their mean, cut; its ends are its outermost ink."""
    box = panels.select("image", "panel", F.floor("x").alias("px"), F.floor("y").alias("py"), F.floor(F.col("x") + F.col("width")).alias("qx"), F.floor(F.col("y") + F.col("height")).alias("qy"))
    inside = ink.join(box, "image").filter((F.col("x") >= F.col("px")) & (F.col("x") < F.col("qx")) & (F.col("y") >= F.col("py")) & (F.col("y") < F.col("qy")))
    inside = inside.withColumn("least", F.greatest(F.floor((F.col("qy") - F.col("py")) * share), F.lit(1)))
    out = []
    for role, line, along in (("axis_y", "x", "y"), ("axis_x", "y", "x")):
        d = inside.filter("ink > 0").withColumn("first", F.col(along) - F.row_number().over(Window.partitionBy("image", "panel", line).orderBy(along)))
        runs = d.groupBy("image", "panel", line, "least", "first").agg(F.count("*").alias("len"), F.min(along).alias("a"), F.max(along).alias("b"))
        lines = runs.groupBy("image", "panel", line, "least").agg(F.max("len").alias("longest"), F.min("a").alias("a"), F.max("b").alias("b"))
        centres = sequence.gap_clusters(lines.filter("longest >= least"), ["image", "panel"], line, 3, "cut").select("image", "panel", F.col("centre").alias(line))
        ends = centres.join(lines.select("image", "panel", line, "a", "b"), ["image", "panel", line])
        place = {"x1": line if role == "axis_y" else "a", "y1": "a" if role == "axis_y" else line, "x2": line if role == "axis_y" else "b", "y2": "b" if role == "axis_y" else line}
        out.append(ends.select("image", "panel", F.lit(role).alias("role"), *[F.col(c).cast("double").alias(k) for k, c in place.items()]))
    return out[0].unionByName(out[1])


def axis_positions(panels: DataFrame, lines: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Where each panel's axes are (WIN-18): of the upright and level lines in it the last, by ord, else its left and lower
    edge; near an edge they snap to it. lines: image, ord, x1, y1, x2, y2, stroke_width."""
    p = panels.select("image", "panel", "x", "y", "width", "height")
    j = p.join(lines.select("image", "ord", "x1", "y1", "x2", "y2", "stroke_width"), "image", "left")
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    upright = (F.abs(F.col("x1") - F.col("x2")) < 1) & F.col("x1").between(F.col("x"), right)
    level = (F.abs(F.col("y1") - F.col("y2")) < 1) & F.col("y1").between(F.col("y"), bottom)
    last = lambda row, cond: F.max_by(row, F.when(cond, F.col("ord")))
    d = j.groupBy("image", "panel", "x", "y", "width", "height").agg(last(F.struct(F.col("x1").alias("at"), F.col("stroke_width").alias("w")), upright).alias("v"), last(F.struct(F.col("y1").alias("at"), F.col("stroke_width").alias("w")), level).alias("h"))
    d = d.withColumn("y_axis", F.coalesce("v.at", "x")).withColumn("x_axis", F.coalesce("h.at", F.col("y") + F.col("height")))
    edge = lambda v, e: F.when(F.abs(v - e) <= tolerance, e).otherwise(v)
    width = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(2))
    return d.select("image", "panel", edge(F.col("y_axis"), F.col("x")).alias("y_axis_x"), width("v.w").alias("y_axis_width"), edge(F.col("x_axis"), F.col("y") + F.col("height")).alias("x_axis_y"), width("h.w").alias("x_axis_width"))


def time_positions(panels: DataFrame, dashed: DataFrame, start: float = 0.2, trigger: float = 0.6) -> DataFrame:
    """First and last upright dashed line of each panel (WIN-17) as places and ratios of its width; with fewer than two the
    default ratios. dashed: image, x1, x2."""
    p = panels.select("image", "panel", "x", "width")
    j = p.join(dashed.select("image", "x1", "x2"), "image", "left")
    hit = (F.abs(F.col("x1") - F.col("x2")) <= 1) & F.col("x1").between(F.col("x"), F.col("x") + F.col("width"))
    d = j.groupBy("image", "panel", "x", "width").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("x1"))).alias("a"), F.max(F.when(hit, F.col("x1"))).alias("b"))
    two = F.col("n") >= 2
    d = d.withColumn("p", F.when(two, F.col("a")).otherwise(F.col("x") + F.col("width") * start)).withColumn("q", F.when(two, F.col("b")).otherwise(F.col("x") + F.col("width") * trigger))
    d = d.withColumn("t_start_x", F.least("p", "q")).withColumn("t_trigger_x", F.greatest("p", "q")).withColumn("source", F.when(two, "dashed").otherwise("fallback"))
    ratio = lambda c, default: F.when(F.col("width") > 0, (F.col(c) - F.col("x")) / F.col("width")).otherwise(default)
    return d.select("image", "panel", "t_start_x", "t_trigger_x", ratio("t_start_x", start).alias("t_start_ratio"), ratio("t_trigger_x", trigger).alias("t_trigger_ratio"), "source")


def panel_metadata(panels: DataFrame, lines: DataFrame, dashed: DataFrame, start: float = 0.2, trigger: float = 0.6) -> DataFrame:
    """Bounds, axes and times of each panel, with the counts of its image (NRM-05). lines: image, ord, x1, y1, x2, y2, stroke_width;
    dashed: image, x1, x2."""
    bounds = panels.select("image", "panel", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    counts = panels.groupBy("image").agg(F.count("*").alias("panels_detected"))
    for name, df in (("dashed_lines_detected", dashed), ("axes_lines_detected", lines)):
        counts = counts.join(df.groupBy("image").agg(F.count("*").alias(name)), "image", "left")
    counts = counts.fillna(0, ["dashed_lines_detected", "axes_lines_detected"])
    return bounds.join(axis_positions(panels, lines), ["image", "panel"]).join(time_positions(panels, dashed, start, trigger).select("image", "panel", "t_start_x", "t_trigger_x"), ["image", "panel"]).join(counts, "image")


def grid_choice(width: Column, height: Column, vertical: Column, horizontal: Column) -> Column:
    """Grid of an image by its long lines (FLT-15, CLS-07): those between 15 and 85 % of the width and between 20 and 85 % of
    the height count; two upright and no level line make 1x3, one of each 2x2, else the shape decides."""
    v = F.size(F.filter(vertical, lambda x: (x > width * 0.15) & (x < width * 0.85)))
    h = F.size(F.filter(horizontal, lambda y: (y > height * 0.2) & (y < height * 0.85)))
    return F.when((v >= 2) & (h == 0), "1x3").when((v >= 1) & (h >= 1), "2x2").when(width >= height * 1.5, "1x3").otherwise("2x2")


def gaps(profile: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of at least least places with no more than the 10th percentile, cut, and 2 (WIN-06)."""
    if not len(profile):
        return []
    low = np.concatenate([[False], profile <= int(np.percentile(profile, 10)) + 2, [False]])
    edge = np.flatnonzero(low[1:] != low[:-1])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def cut_places(profile: np.ndarray) -> list[tuple[int, int]]:
    """Empty stretches of a profile at which its box is cut."""
    n = len(profile)
    margin = max(5, int(n * 0.01))
    for share, floor in ((0.02, 10), (0.005, 5)) if n > 500 else ((0.02, 10),):
        found = [(a, b) for a, b in gaps(profile, max(floor, int(n * share))) if a > margin and b < n - margin]
        if found:
            return found
    return []


def cut_tree(mask: np.ndarray, deepest: int = 4) -> list[tuple[int, int, str, int, int, int, int, int]]:
    """Nodes (node, parent, type, depth, x, y, width, height) of one image's recursive cut (ALG-10), in preorder.

    A stretch is cut first by rows, then by columns, in turn, at empty stretches of 2 % of its extent (10 pixels) that
    stay 1 % (5 pixels) off its ends; a long side without one is tried again with 0.5 % (5 pixels). Where one way
    has none, the other is tried; where neither has, where a side is under 20 pixels, or below the deepest level, it is
    a leaf. Parts are what stands between the middles of the stretches."""
    out: list[tuple[int, int, str, int, int, int, int, int]] = []
    todo = [(-1, 0, 0, mask.shape[1], mask.shape[0], True, 0)]
    while todo:
        parent, x, y, w, h, rows, depth = todo.pop()
        part, kind, cuts = mask[y : y + h, x : x + w], "LEAF", []
        if depth <= deepest and min(w, h) >= 20:
            for way in (rows, not rows):
                cuts = cut_places(part.sum(axis=1 if way else 0))
                if cuts:
                    kind, rows = ("ROW" if way else "COL"), way
                    break
        node = len(out)
        out.append((node, parent, kind, depth, x, y, w, h))
        if cuts:
            middle = [0, *[(a + b) // 2 for a, b in cuts], h if rows else w]
            parts = [(node, x, y + a, w, b - a, not rows, depth + 1) if rows else (node, x + a, y, b - a, h, not rows, depth + 1) for a, b in zip(middle, middle[1:])]
            todo += parts[::-1]
    return out


def xy_cut(ink: DataFrame, deepest: int = 4) -> DataFrame:
    """image, node, parent, type, depth, x, y, width, height of each image's layout tree (ALG-10). ink: image, y, x, ink.

    Only the places of ink are gathered, one image a task."""
    sizes = _sizes(ink)
    lines = ink.filter("ink > 0").groupBy("image", "y").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(sizes, "image", "right")
    kind = ink.schema["image"].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(rows["height"].iloc[0]), int(rows["width"].iloc[0])), bool)
        for y, xs in zip(rows["y"], rows["xs"], strict=True):
            if xs is not None:
                mask[int(y), np.asarray(xs, np.int64)] = True
        found = pd.DataFrame(cut_tree(mask, deepest), columns=["node", "parent", "type", "depth", "x", "y", "width", "height"])
        found.insert(0, "image", rows["image"].iloc[0])
        return found

    return lines.groupBy("image").applyInPandas(cut, f"image {kind}, node int, parent int, type string, depth int, x int, y int, width int, height int")
