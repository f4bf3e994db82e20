"""Connected components of images that are cut into tiles.

Ink is a table of runs (keys, y, start, len). Runs are cut at the borders of tiles; a task joins the runs of one tile by
union-find; runs that touch across a border are edges between parts, which star contraction ties together. So no task
holds an image, however large; an image that fits one tile has no edges, and its parts are its components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.operators import graph
from rasterlake.sources import store

HEIGHT, WIDTH = 1024, 2048  # a tile; HEIGHT * WIDTH is at most 2^21
_ROOT, _COLUMN = 21, 20  # bits of a part's number: place of its first run in the tile, column of the tile; the rest is the tile's row


def _roots(y: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First run of the component of each run (rows y, starts a, lengths n, in order): runs of neighbouring rows join."""
    parent = list(range(len(y)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    y, a, n = y.tolist(), a.tolist(), n.tolist()
    j = 0
    for i in range(len(y)):
        while y[j] < y[i] - 1 or y[j] == y[i] - 1 and a[j] + n[j] <= a[i]:
            j += 1
        k = j
        while k < i and y[k] == y[i] - 1 and a[k] < a[i] + n[i]:
            p, q = find(k), find(i)
            parent[max(p, q)] = min(p, q)
            k += 1
    return np.array([find(i) for i in range(len(y))], np.int64)


def labelled(runs: DataFrame, keys: list[str], height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """keys, y, start, len, root of runs (keys, y, start, len; y and start not negative), cut at tiles: pieces of one 4-connected
    component have one root (a long)."""
    if height * width > 1 << _ROOT:
        raise ValueError("a tile may hold 2^21 pixels")
    tile = lambda x: F.floor(x / width)
    cut = F.explode(F.sequence(tile(F.col("start")), tile(F.col("start") + F.col("len") - 1)))
    first, last = F.greatest("start", F.col("tx") * width), F.least(F.col("start") + F.col("len"), (F.col("tx") + 1) * width)
    pieces = runs.withColumn("tx", cut).select(*keys, F.col("y").cast("long").alias("y"), F.floor(F.col("y") / height).alias("ty"), "tx", first.cast("long").alias("start"), (last - first).cast("long").alias("len"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("node", T.LongType())])

    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("start", "ascending")])
        y, a, n = (table.column(c).to_numpy() for c in ("y", "start", "len"))
        tile = (int(table.column("ty")[0].as_py()) << _ROOT + _COLUMN) | (int(table.column("tx")[0].as_py()) << _ROOT)
        return table.append_column("node", pa.array(tile | _roots(y, a, n)))

    parts = store.saved(pieces.groupBy(*keys, "ty", "tx").applyInArrow(label, schema), "parts")
    left = parts.select(*keys, "y", "ty", "tx", F.col("node").alias("a"), F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
    right = parts.select(*keys, "y", "ty", "tx", F.col("node").alias("b"), F.col("start").alias("s2"), (F.col("start") + F.col("len")).alias("e2"))
    # the last line of a tile with the first of the one below
    down = left.filter((F.col("y") + 1) % height == 0).withColumn("y", F.col("y") + 1).drop("ty")
    edges = down.join(right.filter(F.col("y") % height == 0).drop("ty"), [*keys, "y", "tx"]).filter("s < e2 and s2 < e").select(*keys, "a", "b")
    # a run that ends at a tile's right border with the one that goes on behind it
    over = left.filter(F.col("e") % width == 0).select(*keys, "y", F.col("e").alias("s2"), "a")
    edges = edges.union(over.join(right.filter(F.col("s2") % width == 0), [*keys, "y", "s2"]).select(*keys, "a", "b"))
    roots = graph.connected(edges, keys)
    out = parts.join(roots, [*keys, "node"], "left")
    return out.select(*keys, "y", "start", "len", F.coalesce("root", "node").alias("root"))


def boxes(pieces: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, component, x, y, width, height, area of components of at least least pixels, numbered by their first run in reading
    order (from 0)."""
    right, bottom = F.max(F.col("start") + F.col("len")), F.max(F.col("y") + 1)
    d = pieces.groupBy(*keys, "root").agg(F.min("start").alias("x"), F.min("y").alias("y"), right.alias("right"), bottom.alias("bottom"), F.sum("len").alias("area"), F.min(F.struct("y", "start")).alias("first"))
    order = Window.partitionBy(*keys).orderBy("first")
    d = d.filter(F.col("area") >= least).withColumn("component", (F.row_number().over(order) - 1).cast("long"))
    return d.select(*keys, "component", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"), "area")


def large_only(pieces: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, y, start, len of the pieces whose component has at least least pixels (SET-10)."""
    kept = pieces.groupBy(*keys, "root").agg(F.sum("len").alias("area")).filter(F.col("area") >= least).select(*keys, "root")
    return pieces.join(kept, [*keys, "root"], "left_semi").select(*keys, "y", "start", "len")
