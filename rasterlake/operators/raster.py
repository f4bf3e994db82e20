"""Raster operators on a long table of pixels: image, y, x and value columns.

Dense neighbourhood work goes line by line with windows partitioned by (image, line), so a task holds a line,
not an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import sequence, tiles


def pixels_of_matrix(rows: DataFrame, image: Column, y: str, values: str) -> DataFrame:
    """Long pixels (image, y, x, v) of rows of arrays."""
    return rows.select(image.alias("image"), F.col(y).alias("y"), F.posexplode(values).alias("x", "v"))


def profile(pixels: DataFrame, axis: str, value: Column) -> DataFrame:
    """Sum of value per column ('x') or row ('y') of each image (AGG-02)."""
    return pixels.groupBy("image", axis).agg(F.sum(value).alias("v"))


def features(pixels: DataFrame, value: str, ink: Column, edge: float) -> DataFrame:
    """Ink ratio, variance and edge ratio of each image (AGG-03): an edge is a step over edge to the right
    neighbour."""
    w = Window.partitionBy("image", "y").orderBy("x")
    d = pixels.withColumn("__d", F.abs(F.lead(value).over(w) - F.col(value)))
    return d.groupBy("image").agg(F.avg(ink.cast("int")).alias("ink"), F.var_pop(value).alias("variance"), F.coalesce(F.avg((F.col("__d") > edge).cast("int")), F.lit(0.0)).alias("edges"))


def longest_runs(pixels: DataFrame, ink: Column, line: str, along: str) -> DataFrame:
    """Longest and total run of ink, number of runs, and first and last ink pixel of each line (AGG-06, AGG-08, AGG-09)."""
    r = sequence.run_length(pixels, ["image", line], [along], ink).filter("value")
    return r.groupBy("image", line).agg(F.max("len").alias("longest"), F.sum("len").alias("total"), F.count("*").alias("runs"), F.min("start").alias("first"), F.max(F.col("start") + F.col("len") - 1).alias("last"))


def morph(pixels: DataFrame, value: str, k: int, grow: bool) -> DataFrame:
    """Dilation (grow) or erosion of a 0/1 grid by a k x k square, one axis after the other (ALG-03)."""
    f = F.max if grow else F.min
    r = k // 2
    across = f(value).over(Window.partitionBy("image", "y").orderBy("x").rowsBetween(-r, r))
    d = pixels.withColumn("__v", across)
    down = f("__v").over(Window.partitionBy("image", "x").orderBy("y").rowsBetween(-r, r))
    return d.withColumn(value, down).drop("__v")


def close(pixels: DataFrame, value: str, k: int = 3) -> DataFrame:
    return morph(morph(pixels, value, k, True), value, k, False)


def local_mean(pixels: DataFrame, value: str, block: int) -> DataFrame:
    """Adds mean: of the block x block box around each pixel, as far as it lies in the image (ALG-02)."""
    r = block // 2
    w = Window.partitionBy("image", "y").orderBy("x").rowsBetween(-r, r)
    d = pixels.withColumn("__s", F.sum(value).over(w)).withColumn("__n", F.count(value).over(w))
    v = Window.partitionBy("image", "x").orderBy("y").rowsBetween(-r, r)
    return d.withColumn("mean", F.sum("__s").over(v) / F.sum("__n").over(v)).drop("__s", "__n")


def keep_components(pixels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, y, x of the pixels whose 4-connected component has at least least of them (SET-10). pixels: ink only."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    runs = pixels.withColumn("__g", F.col("x") - F.row_number().over(w)).groupBy(*keys, "y", "__g").agg(F.min("x").cast("long").alias("start"), F.count("*").alias("len")).drop("__g")
    kept = tiles.large_only(tiles.labelled(runs, keys), keys, least)
    return kept.select(*keys, "y", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("x"))


def components(pixels: DataFrame, ink: str, least: int = 1) -> DataFrame:
    """4-connected components of each image's ink (ALG-01, SET-10): image, component, x, y, width, height, area.

    A row of an image becomes runs first; runs are joined tile by tile, and tiles by contraction (see tiles.py), so a
    task holds a tile's runs. Components are numbered in reading order."""
    runs = sequence.run_length(pixels, ["image", "y"], ["x"], F.col(ink) > 0).filter("value").select("image", "y", "start", "len")
    return tiles.boxes(tiles.labelled(runs, ["image"]), ["image"], least)


def diff(actual: DataFrame, expected: DataFrame, keys: list[str], channels: list[str], tolerance: float, scale: float = 255.0) -> DataFrame:
    """RMSE over all channels and share of bad pixels (any channel off by over tolerance) of each image (AGG-25,
    GAT-02). keys: image and pixel position; the first is the image."""
    d = actual.select(*keys, *[F.col(c).cast("double").alias(f"__a{i}") for i, c in enumerate(channels)]).join(expected.select(*keys, *[F.col(c).cast("double").alias(f"__b{i}") for i, c in enumerate(channels)]), keys)
    steps = [F.col(f"__a{i}") - F.col(f"__b{i}") for i in range(len(channels))]
    square = sum((s * s for s in steps), F.lit(0.0)) / (len(channels) * scale * scale)
    worst = F.greatest(*[F.abs(s) for s in steps], F.lit(0.0))
    return d.groupBy(keys[0]).agg(F.sqrt(F.avg(square)).alias("rmse"), F.avg((worst > tolerance).cast("int")).alias("bad"))


def sane(variance: Column, ink: Column, edges: Column) -> Column:
    """Whether an image holds a figure (FLT-12), by features(): some variance, some ink but not all, and some edges."""
    return (variance >= 2.0) & ink.between(0.002, 0.98) & (edges >= 0.001)


def binary(pixels: DataFrame, threshold: int = 190) -> DataFrame:
    """image, y, x, v (0 or 255) for recognition (PRJ-11): whether the rounded BT.601 grey exceeds the threshold."""
    grey = F.floor((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768) / 65536)
    return pixels.select("image", "y", "x", F.when(grey > threshold, 255).otherwise(0).alias("v"))


def weights(pixels: DataFrame, texts: DataFrame) -> DataFrame:
    """image, item, ink, weight of texts (PRJ-02, PRJ-18): bold where over 32 % of the box is dark. texts: image, item, x, y, width, height."""
    box = texts.select("image", "item", F.floor(F.greatest(F.col("x"), F.lit(0.0))).alias("x0"), F.floor(F.greatest(F.col("y"), F.lit(0.0))).alias("y0"), F.floor("width").alias("w"), F.floor("height").alias("h"))
    from rasterlake.operators import spatial

    dark = X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a"), "bold")
    found = spatial.pixels_in(pixels, box, "x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).groupBy("image", "item").agg(F.avg(dark.cast("int")).alias("ink"))
    return box.select("image", "item").join(found, ["image", "item"], "left").fillna(0.0, ["ink"]).withColumn("weight", F.when(F.col("ink") > 0.32, "bold").otherwise("normal"))


def heat_map(actual: DataFrame, expected: DataFrame, tolerance: int) -> DataFrame:
    """image, y, x, heat (largest channel difference, 0 to 255) and bad (over tolerance) of two sets of pixels, flattened onto
    white (GAT-04, GAT-01). Both: image, y, x, r, g, b, a."""
    flat = lambda df, mark: df.select("image", "y", "x", *[X.flatten_alpha(F.col(c), F.col("a")).alias(f"{mark}{c}") for c in "rgb"])
    d = flat(actual, "a").join(flat(expected, "b"), ["image", "y", "x"])
    heat = F.greatest(*[F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "rgb"])
    return d.select("image", "y", "x", F.floor(heat).cast("int").alias("heat"), (heat > tolerance).alias("bad"))


def merge_colors(counts: DataFrame, image: str, distance: float, most: int) -> DataFrame:
    """Greedy merge of counted colours (r, g, b, n) from the most frequent (AGG-15): a colour within distance of
    an earlier centre adds to it, and centres are means weighted by count. Ties by colour. At most `most` rows an
    image. Colours are quantised before, so an image has a bounded number of rows here."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "r", "g", "b"], ascending=[False, True, True, True], ignore_index=True)
        centre, seed, weight = np.empty((0, 3)), np.empty((0, 3)), np.empty(0)
        for c, n in zip(rows[["r", "g", "b"]].to_numpy(float), rows["n"].to_numpy(float), strict=True):
            near = np.flatnonzero(np.sqrt(((seed - c) ** 2).sum(axis=1)) <= distance)
            if len(near):
                k = near[0]
                centre[k] = (centre[k] * weight[k] + c * n) / (weight[k] + n)
                weight[k] += n
            else:
                seed, centre, weight = np.vstack([seed, c]), np.vstack([centre, c]), np.append(weight, n)
        order = np.argsort(-weight, kind="stable")[:most]
        return pd.DataFrame({image: [rows[image].iloc[0]] * len(order), "rank": np.arange(1, len(order) + 1), "r": centre[order, 0], "g": centre[order, 1], "b": centre[order, 2], "n": weight[order].astype(int)})

    kind = counts.schema[image].dataType.simpleString()
    return counts.groupBy(image).applyInPandas(run, f"{image} {kind}, rank int, r double, g double, b double, n long")
