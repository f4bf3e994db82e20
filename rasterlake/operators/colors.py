"""Colours of a figure: background, panel fills, curve colours, bands, dominant hues, curve masks and lettering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import raster, sequence, spatial
from rasterlake.sources import store

SERVING, NEIGHBOR = "#2b6cb0", "#dd6b20"
#: The colours that a figure's own colours are snapped to.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#000000")
RGB = ("r", "g", "b")


def _rgb() -> list[Column]:
    return [F.col(c) for c in RGB]


def clustered(pixels: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """keys, rank, r, g, b, n: colours of each key merged greedily from the most frequent on (ties by value) into the first
    cluster whose leading colour is nearer than distance; each cluster's weighted mean, cut; ranked by pixels (AGG-15).

    Counts are aggregated before the shuffle. A key's distinct colours are folded in one array, which takes their number
    times the number of clusters; regions are sampled by their callers."""
    one = F.struct(*RGB)
    counts = pixels.groupBy(*keys, *RGB).agg(F.count("*").alias("n"))
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), one.alias("c")))).alias("colors"))
    near = lambda a, b: F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in RGB), F.lit(0)).cast("double")) < distance
    add = lambda k, t, u: (t[k] + u["c"][k].cast("double") * -u["neg"]).alias(k)

    def step(found: Column, u: Column) -> Column:
        hit = F.array_position(F.transform(found, lambda t: near(t["lead"], u["c"])), True).cast("int")
        fresh = F.array(F.struct(u["c"].alias("lead"), (-u["neg"]).alias("n"), *[(u["c"][k].cast("double") * -u["neg"]).alias(k) for k in RGB]))
        joined = F.transform(found, lambda t, i: F.when(i + 1 == hit, F.struct(t["lead"].alias("lead"), (t["n"] - u["neg"]).alias("n"), *[add(k, t, u) for k in RGB])).otherwise(t))
        return F.when(hit > 0, joined).otherwise(F.concat(found, fresh))

    kind = counts.schema["r"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<lead:struct<r:{kind},g:{kind},b:{kind}>,n:bigint,r:double,g:double,b:double>>")
    d = listed.select(*keys, F.posexplode(F.aggregate("colors", empty, step)).alias("at", "t"))
    order = Window.partitionBy(*keys).orderBy(F.desc("t.n"), "at")
    return d.select(*keys, F.row_number().over(order).alias("rank"), *[F.floor(F.col(f"t.{k}") / F.col("t.n")).cast("int").alias(k) for k in RGB], F.col("t.n").alias("n"))


def background(pixels: DataFrame, sizes: DataFrame, margin: int = 20) -> DataFrame:
    """image and its background colour (AGG-16): the largest colour cluster of four squares of two margins off the corners, every
    third row and column of each; white where they hold no pixel. sizes: image, width, height."""
    m = F.lit(margin)
    p = pixels.join(sizes.select("image", "width", "height"), "image")
    low = lambda v: F.when((v >= m) & (v < m * 3) & ((v - m) % 3 == 0), True)
    high = lambda v, n: F.when((v >= n - m * 3) & (v < n - m) & ((v - (n - m * 3)) % 3 == 0), True)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    xs, ys = yes(low(F.col("x"))) + yes(high(F.col("x"), F.col("width"))), yes(low(F.col("y"))) + yes(high(F.col("y"), F.col("height")))
    sampled = p.withColumn("times", xs * ys).filter("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times"))))
    top = clustered(sampled, ["image"], 15.0).filter("rank = 1").select("image", X.hex_color(*_rgb()).alias("color"))
    return sizes.select("image").distinct().join(top, "image", "left").fillna("#ffffff", ["color"])


def region_colors(pixels: DataFrame, regions: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, rank, r, g, b, n of the colours in regions (keys with image; x, y, width, height), every step-th row and column."""
    box = regions.select(*keys, F.floor("x").alias("rx"), F.floor("y").alias("ry"), F.floor("width").alias("rw"), F.floor("height").alias("rh"))
    left, top = F.greatest("rx", F.lit(0)), F.greatest("ry", F.lit(0))
    held = spatial.pixels_in(pixels, box, left, top, F.col("rx") + F.col("rw"), F.col("ry") + F.col("rh"))
    return clustered(held.filter(((F.col("x") - left) % step == 0) & ((F.col("y") - top) % step == 0)), keys, 25.0)


def panel_fills(pixels: DataFrame, panels: DataFrame, margin: float = 0.1) -> DataFrame:
    """image, panel, color: the most frequent colour inside a panel that isn't nearly black (AGG-17)."""
    mx, my = F.floor(F.floor("width") * margin), F.floor(F.floor("height") * margin)
    inner = panels.select("image", "panel", (F.floor("x") + mx).alias("x"), (F.floor("y") + my).alias("y"), (F.floor("width") - mx * 2).alias("width"), (F.floor("height") - my * 2).alias("height"))
    found = region_colors(pixels, inner, ["image", "panel"], 10).filter(~X.near_black(*_rgb()))
    top = found.groupBy("image", "panel").agg(F.min_by(X.hex_color(*_rgb()), "rank").alias("color"))
    return panels.select("image", "panel").join(top, ["image", "panel"], "left").fillna("#ffffff", ["color"])


def curve_colors(pixels: DataFrame, panels: DataFrame, most: int = 5) -> DataFrame:
    """image, panel, colors: up to most colours of a panel, the most frequent first, that are neither nearly white, nearly
    black nor very light (AGG-17)."""
    found = region_colors(pixels, panels, ["image", "panel"], 5).filter(~X.near_white(*_rgb(), 245) & ~X.near_black(*_rgb()) & (F.col("r") + F.col("g") + F.col("b") <= 700))
    listed = found.groupBy("image", "panel").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", X.hex_color(*_rgb()).alias("c")))), lambda t: t["c"]), 1, most).alias("colors"))
    return panels.select("image", "panel").join(listed, ["image", "panel"], "left").withColumn("colors", F.coalesce("colors", F.array().cast("array<string>")))


def palette(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, background, primary, accent, text_color (AGG-17): up to five saturated and five other colours of every tenth row and
    column, and the last nearly black one as that of lettering."""
    whole = sizes.select("image", F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height")
    dark, light = X.near_black(*_rgb()), X.near_white(*_rgb(), 245)
    found = region_colors(pixels, whole, ["image"], 10).withColumn("kind", F.when(dark, "text").when(light, "paper").when(X.saturation(*_rgb()) > 0.3, "primary").otherwise("accent")).withColumn("color", X.hex_color(*_rgb()))
    listed = lambda kind: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "color")))), lambda t: t["color"]), 1, 5).alias(kind)
    d = found.groupBy("image").agg(listed("primary"), listed("accent"), F.coalesce(F.max_by("color", F.when(F.col("kind") == "text", F.col("rank"))), F.lit("#000000")).alias("text_color"))
    return background(pixels, sizes).withColumnRenamed("color", "background").join(d, "image", "left")


def bands(pixels: DataFrame, panels: DataFrame) -> DataFrame:
    """image, panel, y (in the panel), height, fill of colour bands across panels (WIN-14): strips of a fiftieth of the height (5
    pixels), of which every fifth column counts; a strip whose leading colour is within 30 of the last strip's joins its
    band. Bands under 5 % of the height are left out."""
    p = panels.select("image", "panel", *[F.floor(c).alias(f"p{c}") for c in ("x", "y", "width", "height")]).withColumn("strip", F.greatest(F.lit(5), F.floor(F.col("pheight") / 50)))
    held = spatial.pixels_in(pixels, p, "px", "py", F.col("px") + F.col("pwidth"), F.col("py") + F.col("pheight")).filter((F.col("x") - F.col("px")) % 5 == 0)
    d = held.withColumn("k", F.floor((F.col("y") - F.col("py")) / F.col("strip"))).filter(F.col("py") + F.col("k") * F.col("strip") < F.col("py") + F.col("pheight") - F.col("strip"))
    d = d.filter(~X.near_white(*_rgb(), 250) & ~X.near_black(*_rgb()))
    keys = ["image", "panel", "pheight", "strip", "k"]
    top = clustered(d, keys, 20.0).filter("rank = 1")
    w = Window.partitionBy("image", "panel").orderBy("k")
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in RGB), F.lit(0)).cast("double")) >= 30
    top = top.withColumn("new", F.coalesce((far | (F.col("k") - F.lag("k").over(w) > 1)).cast("int"), F.lit(1)))
    top = top.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = top.groupBy("image", "panel", "pheight", "strip", "band").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min_by(X.hex_color(*_rgb()), "k").alias("fill"))
    out = out.withColumn("y", F.col("a") * F.col("strip")).withColumn("height", (F.col("b") - F.col("a") + 1) * F.col("strip"))
    return out.filter(F.col("height") >= F.col("pheight") * 0.05).select("image", "panel", "y", "height", "fill")


def dominant_hues(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and hue: peaks of the histogram of 36 hues over coloured pixels (WIN-19, AGG-10): at least 50 pixels and 5 % of
    them, no less than both neighbours around the circle, and 20 degrees from every earlier peak."""
    hue, sat, val = X.hue(*_rgb()), X.saturation(*_rgb()), F.greatest(*_rgb()) / F.lit(255.0)
    bins = pixels.filter((sat > 0.25) & (val > 0.2) & (val < 0.95)).groupBy(*keys, F.least(F.floor(hue / 10), F.lit(35)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    d = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("all"))
    at = lambda i: F.coalesce(F.try_element_at("h", F.pmod(i, F.lit(36))), F.lit(0))
    least = F.greatest(F.lit(50.0), F.col("all") * 0.05)
    peak = lambda i: (at(i) >= least) & (at(i) >= at(i - 1)) & (at(i) >= at(i + 1))
    peaks = F.transform(F.filter(F.sequence(F.lit(0), F.lit(35)), peak), lambda i: i * 10.0 + 5.0)
    far = lambda found, c: F.forall(found, lambda e: X.hue_distance(c, e) >= 20)
    kept = F.aggregate(peaks, F.array().cast("array<double>"), lambda found, c: F.when(far(found, c), F.array_append(found, c)).otherwise(found))
    return d.filter("all >= 50").select(*keys, F.explode(kept).alias("hue"))


def hue_center(pixels: DataFrame, curves: DataFrame, tolerance: float) -> DataFrame:
    """image, curve, target, center: the fullest of 36 hues within twice the tolerance of a curve's target, the first on ties; the
    target itself where there is none. pixels: image and hue; curves: image, curve, target."""
    bins = pixels.groupBy("image", F.pmod(F.floor(F.col("hue") / 10), F.lit(36)).alias("bin")).agg(F.count("*").alias("n"))
    j = curves.join(bins, "image", "left")
    near = X.hue_distance(F.col("bin") * 10.0 + 5.0, F.col("target")) <= tolerance * 2
    best = j.groupBy("image", "curve", "target").agg(F.min_by(F.when(near, F.col("bin") * 10.0 + 5.0), F.when(near, F.struct(-F.col("n"), F.col("bin")))).alias("center"))
    return best.withColumn("center", F.coalesce("center", "target"))


def curve_mask(pixels: DataFrame, curves: DataFrame, sizes: DataFrame, saturation: float = 0.25, value: float = 0.2, tolerance: float = 22.0, least_area: int = 30) -> DataFrame:
    """image, curve, y, x of the pixels of each curve's colour (ALG-04): saturated and bright enough and near the hue centre; where
    that gives under 0.05 % of the image (8 pixels), with limits relaxed to 60 % and 1.4 times the tolerance. The mask is
    closed by a 3 x 3 square and components under least_area go. curves: image, curve, target (a hue)."""
    p = pixels.withColumn("hue", X.hue(*_rgb())).withColumn("sat", X.saturation(*_rgb())).withColumn("val", F.greatest(*_rgb()) / F.lit(255.0)).filter("a > 10")

    def build(sat: float, val: float, tol: float, which: DataFrame) -> DataFrame:
        base = p.filter((F.col("sat") >= sat) & (F.col("val") >= val)).select("image", "y", "x", "hue")
        centers = hue_center(base, which, tol)
        low, high = F.pmod(F.col("center") - tol, F.lit(360.0)), F.pmod(F.col("center") + tol, F.lit(360.0))
        hit = F.when(low <= high, F.col("hue").between(low, high)).otherwise((F.col("hue") >= low) | (F.col("hue") <= high))
        return base.join(centers, "image").filter(hit).select("image", "curve", "y", "x")

    strict = store.saved(build(saturation, value, tolerance, curves), "strict")
    s = sizes.select("image", F.greatest(F.floor(F.col("width") * F.col("height") * 0.0005), F.lit(8)).alias("least"))
    enough = strict.groupBy("image", "curve").agg(F.count("*").alias("n")).join(s, "image").filter("n >= least").select("image", "curve")
    sparse = curves.join(enough, ["image", "curve"], "left_anti")
    relaxed = build(max(saturation * 0.6, 0.05), max(value * 0.6, 0.05), min(tolerance * 1.4, 60.0), sparse)
    mask = strict.join(enough, ["image", "curve"], "left_semi").unionByName(relaxed)
    # closing touches only what is within two pixels of the mask
    square = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("p")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    grown = mask.select("image", "curve", square).select("image", "curve", "p.*").distinct().join(sizes.select("image", "width", "height"), "image").filter(inside)
    # a pixel survives erosion where all its neighbours in the image are grown
    votes = grown.select("image", "curve", "width", "height", square).select("image", "curve", "width", "height", "p.*").groupBy("image", "curve", "width", "height", "y", "x").agg(F.count("*").alias("n"))
    span = lambda v, n: F.lit(3) - (v == 0).cast("int") - (v == n - 1).cast("int")
    closed = votes.filter(inside & (F.col("n") == span(F.col("x"), F.col("width")) * span(F.col("y"), F.col("height"))))
    return raster.keep_components(closed.select("image", "curve", "y", "x"), ["image", "curve"], least_area)


def mask_color(pixels: DataFrame, mask: DataFrame, keys: list[str], fallback: str = SERVING) -> DataFrame:
    """keys and the median colour, cut, of a mask's pixels; the fallback below ten (AGG-12)."""
    d = mask.join(pixels.select("image", "y", "x", *RGB), ["image", "y", "x"]).groupBy(*keys).agg(F.count("*").alias("n"), *[F.floor(F.median(c)).cast("int").alias(c) for c in RGB])
    return d.select(*keys, F.when(F.col("n") < 10, fallback).otherwise(X.hex_color(*_rgb())).alias("color"))


def time_fill(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """image, panel, fill: the bucket of a region's mean colour (AGG-13): null where it is nearly grey, violet where blue leads
    red by over 0.05 and isn't under green, else sand. regions: image, panel, x0, y0, x1, y1."""
    r = regions.select("image", "panel", *[F.bround(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    d = spatial.pixels_in(pixels, r, "x0", "y0", "x1", "y1").groupBy("image", "panel").agg(*[(F.avg(c) / 255.0).alias(c) for c in RGB])
    top, low = F.greatest(*RGB), F.least(*RGB)
    fill = F.when((top <= 0) | (F.try_divide(top - low, top) < 0.05), F.lit(None).cast("string")).when((F.col("b") - F.col("r") > 0.05) & (F.col("b") >= F.col("g")), "#d9d3e8").otherwise("#f2e6b8")
    return r.select("image", "panel").join(d.select("image", "panel", fill.alias("fill")), ["image", "panel"], "left")


def common_fill(fills: DataFrame) -> DataFrame:
    """Every panel's fill replaced by the most frequent of its image, the first panel's on ties (AGG-19). fills: image, panel, fill."""
    n = fills.filter("fill IS NOT NULL").groupBy("image", "fill").agg(F.count("*").alias("n"), F.min("panel").alias("first"))
    top = n.groupBy("image").agg(F.min_by("fill", F.struct(-F.col("n"), F.col("first"))).alias("common"))
    return fills.select("image", "panel").join(top, "image", "left")


def text_color(pixels: DataFrame, texts: DataFrame) -> DataFrame:
    """image, item, color of lettering (AGG-14): by the median hue of its box's coloured pixels (six at least), blue within 25 of
    220 degrees, orange within 20 of 30, else null. texts: image, item, x, y, width, height."""
    t = texts.select("image", "item", F.greatest(F.floor("x"), F.lit(0)).alias("x0"), F.greatest(F.floor("y"), F.lit(0)).alias("y0"), F.floor(F.col("x") + F.col("width")).alias("x1"), F.floor(F.col("y") + F.col("height")).alias("y1"))
    sat, val = X.saturation(*_rgb()), F.greatest(*_rgb()) / F.lit(255.0)
    d = spatial.pixels_in(pixels, t, "x0", "y0", "x1", "y1").filter((sat > 0.3) & (val > 0.2) & (val < 0.9)).groupBy("image", "item").agg(F.count("*").alias("n"), F.median(X.hue(*_rgb())).alias("hue"))
    color = F.when(F.col("n") < 6, F.lit(None).cast("string")).when(X.hue_distance(F.col("hue"), F.lit(220.0)) <= 25, SERVING).when(X.hue_distance(F.col("hue"), F.lit(30.0)) <= 20, NEIGHBOR)
    return t.select("image", "item").join(d.select("image", "item", color.alias("color")), ["image", "item"], "left")


def label_color(role: Column, render: Column, estimated: Column, own: Column, serving: Column | str = SERVING, neighbor: Column | str = NEIGHBOR) -> Column:
    """A text's colour (CLS-06): curve labels have their curve's; others the estimated one where it is drawn and known, else their own."""
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.when(role == "curve_label_serving", as_column(serving)).when(role == "curve_label_neighbor", as_column(neighbor)).when(F.coalesce(render, F.lit(True)), F.coalesce(estimated, own)).otherwise(own)


def snapped(color: Column) -> Column:
    """The nearest of PALETTE, the first on ties; black where it is no colour (PRJ-10)."""
    # channels are parsed once, as a lambda's variable holds them; squared distance and place make one number each
    rgb = F.array(*[F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3)])
    away = lambda c, k, h: (F.get(c, F.lit(k)) - int(h[2 * k + 1 : 2 * k + 3], 16)) * (F.get(c, F.lit(k)) - int(h[2 * k + 1 : 2 * k + 3], 16))
    least = F.transform(F.array(rgb), lambda c: F.array_min(F.array(*[(away(c, 0, h) + away(c, 1, h) + away(c, 2, h)) * len(PALETTE) + i for i, h in enumerate(PALETTE)])))
    near = F.get(F.array(*map(F.lit, PALETTE)), F.get(least, F.lit(0)) % len(PALETTE))
    return F.when(color.rlike("^#[0-9a-fA-F]{6}"), near).otherwise("#000000")


def dash_lines(ink: DataFrame, low: int = 6, high: int = 40, least: int = 6, span: float = 0.6, coverage: tuple[float, float] = (0.02, 0.35), gap: float = 0.5) -> DataFrame:
    """image, axis ('x' upright, 'y' level), at, a, b, n, dash, gap of the lines that are dashed (FLT-11): low to high pixels a
    dash, least dashes or more, over span of the image, with coverage of that span in bounds and gaps of over low * gap on
    average. ink: image, y, x, ink."""
    sizes = ink.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    out = []
    for line, along, extent in (("x", "y", "height"), ("y", "x", "width")):
        runs = sequence.run_length(ink.select("image", line, along, "ink"), ["image", line], [along], F.col("ink") > 0).filter(F.col("value") & F.col("len").between(low, high))
        d = runs.groupBy("image", line).agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max(F.col("start") + F.col("len")).alias("b"), F.sum("len").alias("covered"))
        d = d.join(sizes, "image").withColumn("gap", (F.col("b") - F.col("a") - F.col("covered")) / F.greatest(F.col("n") - 1, F.lit(1)))
        share = F.col("covered") / F.greatest(F.col("b") - F.col("a"), F.lit(1))
        d = d.filter((F.col("n") >= least) & (F.col("b") - F.col("a") >= F.col(extent) * span) & share.between(*coverage) & (F.col("gap") > low * gap))
        out.append(d.select("image", F.lit(line).alias("axis"), F.col(line).alias("at"), "a", "b", "n", (F.col("covered") / F.col("n")).alias("dash"), "gap"))
    return out[0].unionByName(out[1])
