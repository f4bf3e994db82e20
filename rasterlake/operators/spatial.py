"""Spatial joins and greedy geometry de-duplication.

Containment joins are bucketed: boxes are exploded to the grid cells that they touch, points carry their
cell, and the join is on the cell with the exact test behind it, so no operator builds all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import greedy
from rasterlake.sources import store


def contain(points: DataFrame, boxes: DataFrame, px: str, py: str, box: tuple[str, str, str, str], cell: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of points and boxes (x, y, width, height) that hold them, give or take tolerance (JON-01, JON-02)."""
    x, y, w, h = (F.col(c) for c in box)
    to = lambda v: F.floor(v / cell)
    b = boxes.withColumn("__cx", F.explode(F.sequence(to(x - tolerance), to(x + w + tolerance)))).withColumn("__cy", F.explode(F.sequence(to(y - tolerance), to(y + h + tolerance))))
    p = points.withColumn("__cx", to(F.col(px))).withColumn("__cy", to(F.col(py)))
    inside = F.col(px).between(x - tolerance, x + w + tolerance) & F.col(py).between(y - tolerance, y + h + tolerance)
    return p.join(b, ["__cx", "__cy"]).filter(inside).drop("__cx", "__cy")


def pixels_in(pixels: DataFrame, boxes: DataFrame, x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str, cell: int = 64) -> DataFrame:
    """Pixels (image, y, x and others) with the columns of every box of their image (image and others, none named x or y) that holds them: from x0, y0 up to,
    but not at, x1, y1, expressions over the boxes. Both meet by image and cell, so an image's pixels aren't multiplied by its boxes, and are
    dealt out by cells. Boxes are cut at the image's upper left corner."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    to = lambda v: F.floor(v / cell)
    ends = [col(c).cast("double").alias(f"__{k}") for c, k in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]
    b = boxes.select("*", *ends).filter("__x1 > greatest(__x0, 0) AND __y1 > greatest(__y0, 0)")
    zero = F.lit(0.0)
    b = b.withColumn("__cx", F.explode(F.sequence(to(F.greatest("__x0", zero)), to(F.col("__x1"))))).withColumn("__cy", F.explode(F.sequence(to(F.greatest("__y0", zero)), to(F.col("__y1")))))
    p = pixels.withColumn("__cx", to(F.col("x"))).withColumn("__cy", to(F.col("y")))
    inside = "x >= __x0 AND x < __x1 AND y >= __y0 AND y < __y1"
    return p.join(b, ["image", "__cx", "__cy"]).filter(inside).drop("__cx", "__cy", "__x0", "__y0", "__x1", "__y1")


def first_match(pairs: DataFrame, key: list[str], order: list[str], row: list[str]) -> DataFrame:
    """The first containing box of each point, by order (deepest, or listed first)."""
    return pairs.groupBy(*key).agg(F.min_by(F.struct(*row), F.struct(*order)).alias("r")).select(*key, "r.*")


def nearest(df: DataFrame, keys: list[str], value: str, centres: DataFrame, centre: str) -> DataFrame:
    """Adds the nearest centre of the same keys, the smaller on ties (JON-11): one sort merge of values and
    centres, in which each value sees the last centre below and the first above."""
    both = df.withColumn("__c", F.lit(None).cast("double")).unionByName(centres.select(*keys, F.col(centre).cast("double").alias(value), F.col(centre).cast("double").alias("__c")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(value)
    d = both.withColumn("__a", F.last("__c", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first("__c", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    below = F.col("__b").isNull() | (F.col(value) - F.col("__a") <= F.col("__b") - F.col(value))
    return d.filter(F.col("__c").isNull()).withColumn("centre", F.when(F.col("__a").isNull(), F.col("__b")).when(below, F.col("__a")).otherwise(F.col("__b"))).drop("__a", "__b", "__c")


def _items(df: DataFrame, keys: list[str], sort: list[Column]) -> DataFrame:
    """keys and items: each group's rows as an ordered array of struct<s0.., r: the other columns>."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sort)], F.struct(*rest).alias("r"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))


def _greedy(df: DataFrame, keys: list[str], sort: list[Column], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """Keeps items in order unless they clash with one that was kept: a fold over each group's array, for groups of up to greedy.FEW."""
    d = _items(df, keys, sort)
    fold = F.aggregate("items", F.filter("items", lambda i: F.lit(False)), lambda kept, i: F.when(F.exists(kept, lambda k: clash(k["r"], i["r"])), kept).otherwise(F.array_append(kept, i)))
    return d.select(*keys, F.explode(fold).alias("i")).select(*keys, "i.r.*").select(*df.columns)


def line_dedup(df: DataFrame, keys: list[str], coords: list[str], order: str, tolerance: float = 2.0, distance: float = 5.0) -> DataFrame:
    """Greedy de-duplication of lines per orientation (SET-01): in order, a seed takes all later unused lines
    whose endpoints lie within distance in sum, either way round; the longest stays, the first on ties.
    Point-like lines are in both the vertical and horizontal list. Adds orientation. Small groups are folded, larger ones
    go in rounds (see greedy.py)."""
    x1, y1, x2, y2 = (F.col(c) for c in coords)
    flat, steep = F.abs(y1 - y2) <= tolerance, F.abs(x1 - x2) <= tolerance
    names = F.array_compact(F.array(F.when(steep, F.lit("vertical")), F.when(flat, F.lit("horizontal")), F.when(~flat & ~steep, F.lit("other"))))
    few, many = greedy.by_size(df.withColumn("orientation", F.explode(names)), [*keys, "orientation"])
    d = _items(few, [*keys, "orientation"], [F.col(order)])
    ends = lambda i: [i["r"][c] for c in coords]
    near = lambda a, b: X.line_distance(ends(a), ends(b)) <= distance
    none = F.filter("items", lambda i: F.lit(False))

    def step(acc: Column, _: Column) -> Column:
        left, seed = acc["left"], F.get(acc["left"], F.lit(0))
        group = F.filter(left, lambda i, n: (n == 0) | near(i, seed))
        size = lambda i: X.line_length(*ends(i))
        best = F.aggregate(group, F.get(group, F.lit(0)), lambda b, i: F.when(size(i) > size(b), i).otherwise(b))
        rest = F.filter(left, lambda i, n: ~((n == 0) | near(i, seed)))
        return F.when(F.size(left) == 0, acc).otherwise(F.struct(rest.alias("left"), F.array_append(acc["kept"], best).alias("kept")))

    fold = F.aggregate("items", F.struct(F.col("items").alias("left"), none.alias("kept")), step, lambda acc: acc["kept"])
    out = d.select(*keys, "orientation", F.explode(fold).alias("i")).select(*keys, "i.r.*", "orientation").select(*df.columns, "orientation")
    return out if many is None else out.union(greedy.lines(many, [*keys, "orientation"], coords, order, distance).select(*out.columns))


def _either(df: DataFrame, keys: list[str], fold: Callable[[DataFrame], DataFrame], rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Small groups by a fold, larger ones in rounds."""
    few, many = greedy.by_size(df, keys)
    return fold(few) if many is None else fold(few).union(rounds(many))


def rect_nms(df: DataFrame, keys: list[str], box: list[str], order: str, overlap: float = 0.8) -> DataFrame:
    """Boxes from the largest, earlier ones on ties; one goes if its intersection with a kept one is at least
    overlap of the smaller area (SET-02)."""
    own = lambda r: [r[c] for c in box]
    fold = lambda d: _greedy(d, keys, [-(F.col(box[2]) * F.col(box[3])), F.col(order)], lambda k, i: X.overlap_ratio(own(k), own(i)) >= overlap)
    return _either(df, keys, fold, lambda d: greedy.boxes(d, keys, box, order, overlap))


def circle_dedup(df: DataFrame, keys: list[str], circle: list[str], order: str, distance: float = 5.0, radius: float = 2.0) -> DataFrame:
    """Circles in order; one goes if a kept one has its centre within distance and its radius within radius (SET-03)."""
    x, y, r = circle
    fold = lambda d: _greedy(d, keys, [F.col(order)], lambda k, i: (X.line_length(k[x], k[y], i[x], i[y]) <= distance) & (F.abs(k[r] - i[r]) <= radius))
    return _either(df, keys, fold, lambda d: greedy.circles(d, keys, circle, order, distance, radius))


def text_dedup(df: DataFrame, keys: list[str], text: str, x: str, y: str, order: str, similarity: float = 0.85, distance: float = 20.0) -> DataFrame:
    """Greedy in order: a text goes if an earlier kept one lies closer than distance and is equal or more similar
    than similarity (SET-05); empty texts go. Positions are rounded to integers."""
    at = lambda r: (F.bround(r[x]), F.bround(r[y]))
    low = lambda r: F.lower(F.trim(r[text]))
    same = lambda a, b: (low(a) == low(b)) | (X.similarity(low(a), low(b)) > similarity)
    fold = lambda d: _greedy(d, keys, [F.col(order)], lambda k, i: (X.line_length(*at(k), *at(i)) < distance) & same(k, i))
    return _either(df.filter(F.trim(text) != ""), keys, fold, lambda d: greedy.texts(d, keys, text, x, y, order, similarity, distance))


def ancestors(nodes: DataFrame, node: str, parent: str, levels: int) -> DataFrame:
    """node, ancestor, depth for up to so many levels (JON-12): one equi-join a level on the parent."""
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor"))
    step = edges.filter("ancestor IS NOT NULL").withColumn("depth", F.lit(1))
    out = step
    up = edges.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for k in range(2, levels + 1):
        step = step.join(up, "ancestor").filter("next IS NOT NULL").select("node", F.col("next").alias("ancestor"), F.lit(k).alias("depth"))
        out = out.union(step)
    return out


def resolved(nodes: DataFrame, node: str, parent: str, value: str, deepest: int = 1000) -> DataFrame:
    """node and its own value, else that of its nearest ancestor that has one, else null (JON-13); an empty value is none. Each round
    joins the nodes that still look for a value with what they have reached, which doubles the way, and is written; fails where
    nodes still look after deepest ancestors, as in a cycle."""
    state = nodes.select(F.col(node).alias("node"), F.col(parent).alias("next"), F.nullif(F.col(value), F.lit("")).alias("value"))
    looking = "value IS NULL AND next IS NOT NULL"
    for _ in range(max(deepest - 1, 1).bit_length() + 1):
        state = store.saved(state, "ancestors")
        if state.filter(looking).isEmpty():
            return state.groupBy("node").agg(F.max("value").alias("value"))
        up = state.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("value").alias("found")).hint("merge")
        moved = state.filter(looking).join(up, "next", "left").select("node", F.col("further").alias("next"), F.col("found").alias("value"))
        state = state.filter(f"NOT ({looking})").unionByName(moved)
    raise ValueError(f"a tree is deeper than {deepest}")
