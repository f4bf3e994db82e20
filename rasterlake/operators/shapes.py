"""Shapes in a figure: text boxes, markers, descriptors of small regions, and arrow heads at line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import raster


def text_boxes(components: DataFrame, sizes: DataFrame) -> DataFrame:
    """Components of the size and shape of lettering (FLT-09), in reading order as ord. components: image, x, y, width,
    height, area; sizes: image and the image's own width and height.

    From 0.005 % of the image (8 pixels) to 2 %, 3 pixels a side or more, at most 60 % wide and 40 % high, and 0.2 to 12
    times as wide as high."""
    s = sizes.select("image", F.col("width").alias("w"), F.col("height").alias("h"))
    area = F.col("w") * F.col("h")
    least = F.greatest(F.floor(area * 0.00005), F.lit(8))
    most = F.greatest(F.floor(area * 0.02), least + 1)
    aspect = F.col("width") / F.greatest("height", F.lit(1))
    fits = F.col("area").between(least, most) & (F.least("width", "height") >= 3) & (F.col("width") <= F.col("w") * 0.6) & (F.col("height") <= F.col("h") * 0.4) & aspect.between(0.2, 12)
    order = Window.partitionBy("image").orderBy("y", "x", "width", "height")
    return components.join(s, "image").filter(fits).select("image", F.row_number().over(order).alias("ord"), "x", "y", "width", "height", "area")


def is_red(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (r > 150) & (g < 100) & (b < 100) & (a > 10)


def markers(pixels: DataFrame) -> DataFrame:
    """Event markers (FLT-10): red components of 6 pixels or more and 2 to 30 a side, as centre and radius."""
    red = pixels.withColumn("red", is_red(F.col("r"), F.col("g"), F.col("b"), F.col("a")).cast("int"))
    c = raster.components(red.select("image", "y", "x", "red"), "red", 6)
    c = c.filter(F.col("width").between(2, 30) & F.col("height").between(2, 30))
    return c.select("image", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"), (F.greatest("width", "height") / 2).alias("radius"))


def vertices(xs: Column, ys: Column) -> Column:
    """Corners of an outline given as arrays of its points in order (WIN-20): turns of over 30 degrees and the two ends, 8 at
    most; fewer than four points are corners all."""
    n = F.size(xs)
    step = lambda v, i: F.get(v, i + 1) - F.get(v, i)

    def turn(i: Column) -> Column:
        ax, ay, bx, by = step(xs, i), step(ys, i), step(xs, i + 1), step(ys, i + 1)
        size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, size)))))
        return (ax * ax + ay * ay > 0.01) & (bx * bx + by * by > 0.01) & (angle > 30)

    count = F.size(F.filter(F.sequence(F.lit(0), n - 3), turn)) + 2
    return F.when(n < 4, n).otherwise(F.least(count, F.lit(8)))


def descriptors(ink: DataFrame, keys: list[str]) -> DataFrame:
    """area, width, height, aspect, solidity and vertices of each key's ink (AGG-32); all 0 but area (aspect 1) below three
    pixels, and area 0 below four. ink: keys, y, x of ink pixels; the regions are small and bounded.

    The outline is each row's first and last pixel, from the top."""
    rows = ink.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("y"), F.col("a").alias("x")))).otherwise(F.array(F.struct(F.col("y"), F.col("a").alias("x")), F.struct(F.col("y"), F.col("b").alias("x"))))
    d = rows.groupBy(*keys).agg(F.sum("n").alias("area"), F.greatest(F.max("b") - F.min("a"), F.lit(1)).alias("width"), F.greatest(F.max("y") - F.min("y"), F.lit(1)).alias("height"), F.array_sort(F.flatten(F.collect_list(ends))).alias("outline"))
    d = d.withColumn("xs", F.transform("outline", lambda p: p["x"].cast("double"))).withColumn("ys", F.transform("outline", lambda p: p["y"].cast("double")))
    some = F.col("area") >= 4
    return d.select(
        *keys, F.when(some, F.col("area")).otherwise(0).alias("area"), F.when(some, F.col("width")).otherwise(0).alias("width"), F.when(some, F.col("height")).otherwise(0).alias("height"),
        F.when(some, F.col("width") / F.col("height")).otherwise(1.0).alias("aspect"), F.when(some, F.col("area") / (F.col("width") * F.col("height"))).otherwise(0.0).alias("solidity"), F.when(some, vertices(F.col("xs"), F.col("ys"))).otherwise(0).alias("vertices"),
    )


def arrow_heads(pixels: DataFrame, ends: DataFrame, region: int = 24) -> DataFrame:
    """Kind, size and confidence of what is drawn at each line end (ALG-14). ends: image, end (an id), x, y; pixels: image, y, x,
    r, g, b, a, of which those in a square of region around an end are described. Under six pixels of ink there is no head.

    Ends are joined by image and by square cells of region, four cells an end, so an end meets its own pixels only."""
    half = region // 2
    e = ends.select("image", "end", F.col("x").cast("int").alias("ex"), F.col("y").cast("int").alias("ey"))
    cells = e.withColumn("cx", F.explode(F.sequence(F.floor((F.col("ex") - half) / region), F.floor((F.col("ex") + half - 1) / region)))).withColumn("cy", F.explode(F.sequence(F.floor((F.col("ey") - half) / region), F.floor((F.col("ey") + half - 1) / region))))
    ink = pixels.filter(X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a"), "arrow")).select("image", "y", "x", F.floor(F.col("x") / region).alias("cx"), F.floor(F.col("y") / region).alias("cy"))
    near = ink.join(cells, ["image", "cx", "cy"]).filter((F.col("x") >= F.col("ex") - half) & (F.col("x") < F.col("ex") + half) & (F.col("y") >= F.col("ey") - half) & (F.col("y") < F.col("ey") + half))
    d = e.select("image", "end").join(descriptors(near, ["image", "end"]), ["image", "end"], "left").fillna(0, ["area", "vertices"]).fillna(0.0, ["solidity"]).fillna(1.0, ["aspect"])
    v, s, a = F.col("vertices"), F.col("solidity"), F.col("aspect")
    corner = (v == 3) | ((v == 4) & (s > 0.4))
    dot, line, diamond = (a > 0.8) & (a < 1.2) & (s > 0.7), (v == 2) | ((s < 0.3) & (a > 1.5)), (v == 4) & (a > 0.7) & (a < 1.3) & (s > 0.5)
    pick = lambda none, *values: F.when(F.col("area") < 6, none).when(corner & (s > 0.6), values[0]).when(corner, values[1]).when(dot, values[2]).when(line, values[3]).when(diamond, values[4]).otherwise(values[5])
    kind = pick("none", "triangle", "triangle_open", "dot", "line", "diamond", "triangle")
    confidence = pick(0.9, 0.8 + 0.1 * s, 0.7, 0.75, 0.6, 0.65, 0.5)
    return d.select("image", "end", kind.alias("kind"), F.when(F.col("area") < 6, 0.0).otherwise(F.sqrt("area") * 1.5).alias("size"), confidence.alias("confidence"))
