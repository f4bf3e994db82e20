"""Texts and lines of panels: roles, labels of thresholds, blocks of lines, defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dashed line's default pattern, and words that keep a text out of blocks.
DASHES = (4, 4)
NOT_IN_BLOCKS = ("ttt", "hys", "trigger")
ROLES_NOT_IN_BLOCKS = ("title", "panel_label", "curve_label_serving", "curve_label_neighbor")


def center_x(box: str = "") -> Column:
    """Middle of a box; fields that are no numbers count as 0 (PRJ-17). box: name of a struct, or '' for plain columns."""
    return field(box, "x") + field(box, "width") / 2


def center_y(box: str = "") -> Column:
    return field(box, "y") + field(box, "height") / 2


def field(box: str, name: str) -> Column:
    c = F.col(f"{box}.{name}" if box else name)
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def box_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box with its corners (PRJ-17)."""
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), x.alias("x0"), y.alias("y0"), (x + width).alias("x1"), (y + height).alias("y1"))


def _panels(panels: DataFrame) -> DataFrame:
    return panels.select("image", "panel", F.col("ord").alias("p_ord"), *[F.col(c).cast("double").alias(f"p{c}") for c in ("x", "y", "width", "height")])


def panel_of(points: DataFrame, panels: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Adds panel: the first (by ord) of an image's panels that holds the point, null where none does (JON-02). An image's panels are
    few, so its points meet each of them, and the first is aggregated before the shuffle."""
    j = points.select(*{*keys, "image"}, x.alias("__x"), y.alias("__y")).join(_panels(panels), "image", "left")
    hit = F.col("__x").between(F.col("px"), F.col("px") + F.col("pwidth")) & F.col("__y").between(F.col("py"), F.col("py") + F.col("pheight"))
    first = j.groupBy(*keys).agg(F.min_by(F.when(hit, F.col("panel")), F.when(hit, F.col("p_ord"))).alias("panel"))
    return points.join(first, keys, "left")


def event_roles(texts: DataFrame, panels: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, item, role, anchor, render of the texts of a figure of panels (JON-03), by the first that holds: title (in the
    upper 10 % and wider than half; where an image has none, the upper 14 % and 45 %), panel_label (in the upper 30 % of a panel and at most
    40 % of its width), axis_label (in the lower 20 % of a panel), else annotation. A panel label wins over a title, as it comes later.
    texts: image, item, x, y, width, height (boxes)."""
    t = texts.join(sizes.select("image", F.col("width").alias("iw"), F.col("height").alias("ih")), "image").withColumn("cx", center_x()).withColumn("cy", center_y())
    # shares in whole hundredths: 600 * 0.14 is over 84 in doubles
    upper, length = F.col("y") * 100, F.col("width") * 100
    wide, narrow = (upper < F.col("ih") * 10) & (length > F.col("iw") * 50), (upper < F.col("ih") * 14) & (length > F.col("iw") * 45)
    t = t.withColumn("title", F.when(F.max(wide).over(Window.partitionBy("image")), wide).otherwise(narrow))
    j = t.join(_panels(panels), "image", "left")
    across = F.col("cx").between(F.col("px"), F.col("px") + F.col("pwidth"))
    label = across & F.col("cy").between(F.col("py"), F.col("py") + F.col("pheight") * 0.3) & (F.col("width") <= F.col("pwidth") * 0.4)
    axis = across & F.col("cy").between(F.col("py") + F.col("pheight") * 0.8, F.col("py") + F.col("pheight"))
    d = j.groupBy("image", "item").agg(F.first("title").alias("title"), F.coalesce(F.max(label), F.lit(False)).alias("label"), F.coalesce(F.max(axis), F.lit(False)).alias("axis"))
    role = F.when(F.col("label"), "panel_label").when(F.col("title"), "title").when(F.col("axis"), "axis_label").otherwise("annotation")
    anchor = F.when(role.isin("title", "axis_label"), "middle").otherwise("start")
    return d.select("image", "item", role.alias("role"), anchor.alias("anchor"), (~role.isin("title", "panel_label")).alias("render"))


def plot_roles(texts: DataFrame, plots: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, item, role of the texts of a line plot (JON-05), by the first that holds: title (the first, by y and x, in the upper 10 % and
    wider than half), axis_label_x (below the plot), axis_label_y (left of it), legend (above it, right of 60 %), else annotation.
    texts: image, item, x, y, width, height; plots: image, x, y, width, height (one an image)."""
    t = texts.join(sizes.select("image", F.col("width").alias("iw"), F.col("height").alias("ih")), "image").join(plots.select("image", *[F.col(c).alias(f"p{c}") for c in ("x", "y", "width", "height")]), "image")
    top = (F.col("y") < F.col("ih") * 0.1) & (F.col("width") > F.col("iw") * 0.5)
    first = F.row_number().over(Window.partitionBy("image", top).orderBy("y", "x", "item")) == 1
    cx, cy, right, bottom = center_x(), center_y(), F.col("px") + F.col("pwidth"), F.col("py") + F.col("pheight")
    role = F.when(top & first, "title").when(cx.between(F.col("px"), right) & (cy >= bottom), "axis_label_x").when((cx <= F.col("px")) & cy.between(F.col("py"), bottom), "axis_label_y")
    role = role.when((cy <= F.col("py")) & (cx >= F.col("px") + F.col("pwidth") * 0.6), "legend").otherwise("annotation")
    return t.select("image", "item", role.alias("role"))


def region_role(rel_x: Column, rel_y: Column, width: Column, height: Column) -> Column:
    """Role of a text by its place in a layout node (CLS-05): title in the upper 15 %, axis_x in the lower, axis_y at the left, else
    annotation; the first that holds."""
    return F.when(rel_y < height * 0.15, "title").when(rel_y > height * 0.85, "axis_x").when(rel_x < width * 0.15, "axis_y").otherwise("annotation")


def threshold_lines(dashed: DataFrame, panels: DataFrame, texts: DataFrame) -> DataFrame:
    """image, panel, y_ratio, label of level dashed lines over 40 % of their panel's width (JON-08, SET-08): of lines at one place
    of a panel (to a hundredth) the first by ord; the label is the first text, by ord, that names a threshold and stands within 16 pixels.
    dashed: image, ord, x1, y1, x2, y2; texts: image, ord, text, x, y, width, height."""
    d = panel_of(dashed, panels, ["image", "ord"], (F.col("x1") + F.col("x2")) / 2, F.col("y1")).filter("panel IS NOT NULL AND abs(y1 - y2) <= 1").join(_panels(panels), ["image", "panel"])
    d = d.filter(F.abs(F.col("x2") - F.col("x1")) >= F.col("pwidth") * 0.4).withColumn("ratio", F.when(F.col("pheight") != 0, 1.0 - (F.col("y1") - F.col("py")) / F.col("pheight")).otherwise(0.5)).filter(F.col("ratio").between(0.15, 0.9))
    d = d.groupBy("image", "panel", F.bround("ratio", 2).alias("place")).agg(F.min_by(F.struct("ord", "y1", "ratio", "px", "pwidth"), "ord").alias("l")).select("image", "panel", "l.*")
    named = texts.filter(F.contains(F.lower("text"), F.lit("th"))).select("image", F.col("ord").alias("t_ord"), "text", center_x().alias("cx"), center_y().alias("cy"))
    hit = F.col("cx").between(F.col("px"), F.col("px") + F.col("pwidth")) & (F.abs(F.col("cy") - F.col("y1")) <= 16)
    found = d.join(named, "image").filter(hit).groupBy("image", "ord").agg(F.min_by("text", "t_ord").alias("label"))
    return d.join(found, ["image", "ord"], "left").select("image", "panel", "ord", F.bround("ratio", 4).alias("y_ratio"), "label")


def completed_guides(panels: DataFrame, guides: DataFrame, sizes: DataFrame) -> DataFrame:
    """guides (image, panel, kind, source 'given') and a default one (source 'default') for each panel of a large image, 1600 x 900 or
    more, that lacks a ttt guide, and for its panels A3 and A4 that lack a hys guide (JON-18)."""
    large = panels.join(sizes.filter("width >= 1600 AND height >= 900").select("image"), "image", "left_semi")
    wanted = large.select("image", "panel", F.explode(F.when(F.col("panel").isin("A3", "A4"), F.array(F.lit("ttt"), F.lit("hys"))).otherwise(F.array(F.lit("ttt")))).alias("kind"))
    lacking = wanted.join(guides, ["image", "panel", "kind"], "left_anti")
    return guides.select("image", "panel", "kind", F.lit("given").alias("source")).unionByName(lacking.withColumn("source", F.lit("default")))


def placed_texts(texts: DataFrame, panels: DataFrame) -> DataFrame:
    """Adds x, y of texts placed by ratios of their panel (JON-15); null without such a panel or ratio. texts: image, panel, x_ratio, y_ratio."""
    d = texts.join(_panels(panels), ["image", "panel"], "left")
    at = lambda a, size, ratio: F.col(a) + F.col(size) * F.col(ratio).try_cast("double")
    both = F.col("x_ratio").try_cast("double").isNotNull() & F.col("y_ratio").try_cast("double").isNotNull()
    return d.withColumn("x", F.when(both, at("px", "pwidth", "x_ratio"))).withColumn("y", F.when(both, at("py", "pheight", "y_ratio"))).drop("p_ord", "px", "py", "pwidth", "pheight")


def text_blocks(texts: DataFrame, panels: DataFrame) -> DataFrame:
    """image, panel, block, x, y, lines (array), font_size of the texts inside each panel (WIN-12): texts in order of y and x are one block
    while each is within 1.6 of the panel's median text height (the upper one, 8 pixels at least) below the last. Drawn texts without a role or
    word of its own only. texts: image, item, text, role, render, x, y (of the baseline), font_size, box (struct)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    odd = F.startswith(low, F.lit("th"))
    for word in NOT_IN_BLOCKS + ("threshold",):
        odd = odd | F.contains(low, F.lit(word))
    d = texts.filter(F.coalesce("render", F.lit(True)) & ~F.coalesce("role", F.lit("")).isin(*ROLES_NOT_IN_BLOCKS) & ~odd)
    inside = center_x("box").between(F.col("px"), F.col("px") + F.col("pwidth")) & center_y("box").between(F.col("py"), F.col("py") + F.col("pheight"))
    j = d.join(_panels(panels), "image").filter(inside)
    heights = F.sort_array(F.collect_list(F.when(field("box", "height") > 0, field("box", "height"))).over(Window.partitionBy("image", "panel")))
    j = j.withColumn("gap", F.greatest(F.coalesce(F.get(heights, (F.size(heights) / 2).cast("int")), F.lit(12.0)) * 1.6, F.lit(8.0)))
    w = Window.partitionBy("image", "panel").orderBy("y", "x", "item")
    j = j.withColumn("new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) > F.col("gap")).cast("int"), F.lit(0))).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "item", "text", F.coalesce("font_size", F.lit(12.0)).alias("f"))))
    g = j.filter(F.coalesce("text", F.lit("")) != "").groupBy("image", "panel", "block").agg(F.min("x").alias("x"), F.min("y").alias("y"), rows.alias("rows"))
    lines = F.filter(F.flatten(F.transform("rows", lambda r: F.split(r["text"], "\n"))), lambda t: F.trim(t) != "")
    fonts = F.transform("rows", lambda r: r["f"])
    return g.select("image", "panel", "block", "x", "y", lines.alias("lines"), F.get(fonts, (F.size(fonts) / 2).cast("int")).alias("font_size")).filter(F.size("lines") > 0)


def line_items(words: DataFrame, keys: list[str], font_ratio: float = 0.6) -> DataFrame:
    """One item a line of words (AGG-21): text, box, baseline, mean confidence, and the font size by the upper median of the word heights (6 at
    least). words: keys, ord, text, conf, x, y, width, height; keys name the line. Words that repeat the one before are left out."""
    w = Window.partitionBy(*keys).orderBy("ord")
    d = words.withColumn("again", F.col("text").eqNullSafe(F.lag("text").over(w)))
    kept = F.array_sort(F.collect_list(F.when(~F.col("again") & (F.coalesce("text", F.lit("")) != ""), F.struct("ord", "text", "height"))))
    g = d.groupBy(*keys).agg(kept.alias("k"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.avg("conf").alias("conf"))
    heights = F.sort_array(F.transform("k", lambda t: t["height"]))
    size = F.greatest(F.lit(6.0), F.get(heights, (F.size(heights) / 2).cast("int")) * font_ratio)
    return g.filter(F.size("k") > 0).select(*keys, F.array_join(F.transform("k", lambda t: t["text"]), " ").alias("text"), "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("y1") - F.col("y")).alias("height"), F.col("y1").alias("baseline"), "conf", size.alias("font_size"))


def recognition_stats(words: DataFrame, items: DataFrame, image: str = "image", conf: str = "conf") -> DataFrame:
    """image, blocks_total, text_items, avg_conf (AGG-20): recognised words, items made of them, and the items' mean confidence, in
    which those that are no numbers don't count; 0 where there is none."""
    w = words.groupBy(image).agg(F.count("*").alias("blocks_total"))
    i = items.groupBy(image).agg(F.count("*").alias("text_items"), F.bround(F.avg(F.col(conf).try_cast("double")), 3).alias("avg_conf"))
    return w.join(i, image, "full").fillna(0, ["blocks_total", "text_items"]).fillna(0.0, ["avg_conf"])


def renderable(text: Column, render: Column) -> Column:
    """Whether a text is drawn (FLT-13): not switched off, and not blank."""
    return F.coalesce(render, F.lit(True)) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def lines_of_panels(dashed: DataFrame, panels: DataFrame, most: int = 2) -> DataFrame:
    """image, panel, axis, ord, rank of each panel's first most upright lines, by x, and first most level lines, by y (JON-06). An upright line is
    a panel's by its x, a level one by its y. dashed: image, ord, x1, y1, x2, y2. Spark limits each group before the shuffle."""
    j = dashed.join(_panels(panels), "image")
    up = (F.abs(F.col("x1") - F.col("x2")) <= 1) & F.col("x1").between(F.col("px"), F.col("px") + F.col("pwidth"))
    level = (F.abs(F.col("y1") - F.col("y2")) <= 1) & F.col("y1").between(F.col("py"), F.col("py") + F.col("pheight"))
    out = []
    for axis, hit, place in (("x", up, "x1"), ("y", level, "y1")):
        w = Window.partitionBy("image", "panel").orderBy(place, "ord")
        out.append(j.filter(hit).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("image", "panel", F.lit(axis).alias("axis"), "ord", "rank"))
    return out[0].unionByName(out[1])
