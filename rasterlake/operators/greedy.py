"""Greedy de-duplication of groups of any size, in rounds: what a fold over the ordered items would keep.

In order, an item stays unless it clashes with an earlier one that stayed. Equal items are one item first. Clashing pairs
come from an equi-join on grid cells with the exact test behind it. An item without an earlier clash stays, and what
clashes with it goes, again and again; connected parts of the clashes that fit a task are settled there by one pass, and only
larger parts take rounds, until they fall apart. No step gathers a group in one row or task. Texts, of which very many equal ones may lie near each
other, are settled without a list of their clashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import graph
from rasterlake.sources import store

FEW = 64  # items of a group that are folded in one row
PART = 200_000  # clashes that one task settles
ROUNDS = 4  # before parts are looked for again


def by_size(df: DataFrame, keys: list[str], few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to few, and rows of larger ones (None where there are none)."""
    large = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > few).select(*keys)
    if large.isEmpty():
        return df, None
    large = store.saved(large, "large")
    same = [df[k].eqNullSafe(large[k]) for k in keys]
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def numbered(df: DataFrame, keys: list[str], sort: list[Column], equal: list[Column]) -> DataFrame:
    """Written rows with __id, __o (their place in the order) and __group (the keys as one value), of equal ones (same keys and same `equal`) only the
    first."""
    rest = [c for c in df.columns if c not in keys]
    d = df.withColumn("__o", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sort)], F.struct(*rest).alias("r")))
    row = F.struct("__o", *rest)
    names = [f"__e{i}" for i in range(len(equal))]
    d = d.groupBy(*keys, *[c.alias(n) for c, n in zip(equal, names, strict=True)]).agg(F.min_by(row, "__o").alias("__r")).select(*keys, "__r.*").select(*df.columns, "__o")
    return store.saved(d.withColumn("__id", F.monotonically_increasing_id()).withColumn("__group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), "items")


def cell_pairs(items: DataFrame, x: Column, y: Column, reach: float, clash: Callable[[Column, Column], Column], also: list[tuple[Column, Column]] | None = None) -> DataFrame:
    """__group, a, b: clashing items, a before b in the order, whose points (x, y) are no further apart than reach in either direction. also: other
    points at which an item can be met."""
    to = lambda v: F.floor(v / reach)
    row = F.struct(*[c for c in items.columns if c not in ("__id", "__group")])
    near = [F.struct((to(u) + dx).alias("cx"), (to(v) + dy).alias("cy")) for u, v in [(x, y), *(also or [])] for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    left = items.select("__group", F.col("__id").alias("a"), row.alias("p"), F.explode(F.array_distinct(F.array(*near))).alias("c")).select("__group", "a", "p", "c.*")
    right = items.select("__group", F.col("__id").alias("b"), row.alias("q"), to(x).alias("cx"), to(y).alias("cy"))
    met = left.join(right, ["__group", "cx", "cy"]).filter((F.col("a") != F.col("b")) & clash(F.col("p"), F.col("q")))
    first = F.col("p.__o") < F.col("q.__o")
    return met.select("__group", F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def lost(pairs: DataFrame) -> DataFrame:
    """__id of the items that go. pairs: __group, a, b (a before b), written."""
    schema = "a long"

    def settle(table: pa.Table) -> pa.Table:
        nodes, flat = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
        a, b = flat[: len(table)], flat[len(table) :]
        order = np.argsort(a, kind="stable")
        later, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist()
        waits = np.bincount(b, minlength=len(nodes)).tolist()
        gone = [False] * len(nodes)
        ready = [i for i, w in enumerate(waits) if not w]
        while ready:  # an item is settled once all that clash with it before it are
            i = ready.pop()
            for j in later[first[i] : first[i + 1]]:
                gone[j] |= not gone[i]
                waits[j] -= 1
                if not waits[j]:
                    ready.append(j)
        return pa.table({"a": nodes[np.array(gone, bool)].astype(np.int64)})

    out = []
    while not pairs.isEmpty():
        n = pairs.groupBy("__group").agg(F.count("*").alias("n"))
        many = n.filter(F.col("n") > PART).select("__group")
        if many.isEmpty():
            out.append(store.saved(pairs.groupBy("__group").applyInArrow(settle, schema), "settled"))
            break
        small = pairs.join(many, "__group", "left_anti")
        rest = store.saved(pairs.join(many, "__group", "left_semi"), "many")
        parts = graph.connected(rest, ["__group"]).withColumnRenamed("node", "a")
        rest = store.saved(rest.join(parts, ["__group", "a"]), "parted")
        wide = rest.groupBy("__group", "root").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("__group", "root")
        out.append(store.saved(small.groupBy("__group").applyInArrow(settle, schema).union(rest.join(wide, ["__group", "root"], "left_anti").groupBy("__group", "root").applyInArrow(settle, schema)), "settled"))
        pairs = store.saved(rest.join(wide, ["__group", "root"], "left_semi").select("__group", "a", "b"), "rest")
        for _ in range(ROUNDS):
            if pairs.isEmpty():
                break
            heads = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            gone = store.saved(pairs.join(heads, "a").select(F.col("b").alias("a")).distinct(), "gone")
            out.append(gone)
            left = pairs.join(heads, "a", "left_anti").join(gone, "a", "left_anti")
            pairs = store.saved(left.join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("__group", "a", "b"), "rest")
    if not out:
        return pairs.select(F.col("a").alias("__id"))
    done = out[0]
    for o in out[1:]:
        done = done.union(o)
    return done.withColumnRenamed("a", "__id")


def kept(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The numbered items that stay."""
    return items.join(lost(store.saved(pairs, "pairs")), "__id", "left_anti")


def lines(df: DataFrame, keys: list[str], coords: list[str], order: str, distance: float) -> DataFrame:
    """Of each group of near lines, in order, the longest (the first on ties). A group is what the first line of the order that is in no group has
    near it, of those in none."""
    x1, y1, x2, y2 = (F.col(c) for c in coords)
    items = numbered(df, keys, [F.col(order)], [x1, y1, x2, y2])
    near = lambda p, q: X.line_distance([p[c] for c in coords], [q[c] for c in coords]) <= distance
    # ends that are near in sum: the first end of one is near either end of the other
    pairs = store.saved(cell_pairs(items, x1, y1, distance, near, [(x2, y2)]), "pairs")
    seeds = store.saved(kept(items, pairs).select(F.col("__id").alias("a"), F.col("__o").alias("seed")), "seeds")
    taken = pairs.join(seeds, "a").groupBy("b").agg(F.min_by("a", "seed").alias("a")).join(items.withColumnRenamed("__id", "b"), "b").drop("b")
    members = items.join(seeds, F.col("__id") == F.col("a")).drop("__id", "seed").unionByName(taken)
    best = members.groupBy("a").agg(F.min_by(F.struct(*df.columns), F.struct((-X.line_length(x1, y1, x2, y2)).alias("l"), "__o")).alias("r"))
    return best.select("r.*").select(*df.columns)


def circles(df: DataFrame, keys: list[str], circle: list[str], order: str, distance: float, radius: float) -> DataFrame:
    x, y, r = circle
    items = numbered(df, keys, [F.col(order)], [F.col(c) for c in circle])
    pairs = cell_pairs(items, F.col(x), F.col(y), distance, lambda p, q: (X.line_length(p[x], p[y], q[x], q[y]) <= distance) & (F.abs(p[r] - q[r]) <= radius))
    return kept(items, pairs).select(*df.columns)


def alike(words: DataFrame, similarity: float) -> DataFrame:
    """__group, w, v: texts of a group that are more similar than similarity, both ways round. words: __group, low, w, written, a row a distinct text.

    A text of n characters allows k edits; of k + 1 stretches of the longer text one is whole in the other, with no more edits before it than
    stretches before it, and no more after it than stretches after it. So texts meet on a stretch, and the exact test follows."""
    if similarity < 0.5:  # stretches would be empty
        p, q = (words.select("__group", F.col("w").alias(n), F.col("low").alias(f"low_{n}")) for n in "wv")
        met = p.join(q, "__group").filter("w < v")
    else:
        k = F.floor(F.col("n") * (1 - similarity) + 1e-6).cast("int")
        start, stop = F.expr("i * n div (k + 1)").cast("int"), F.expr("(i + 1) * n div (k + 1)").cast("int")
        cut = lambda d: d.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), "k"))).withColumn("from", start).withColumn("size", stop - start)
        long = cut(words.withColumn("n", F.length("low"))).select("__group", "n", "i", F.expr("substr(low, from + 1, size)").alias("part"), F.col("w"), F.col("low").alias("low_w"))
        short = cut(words.withColumn("own", F.length("low")).withColumn("n", F.explode(F.sequence(F.col("own"), F.floor(F.col("own") / similarity + 1e-6).cast("int"))))).filter("n - own <= k")
        short = short.withColumn("least", F.expr("greatest(0, from - i, from + own - n - (k - i))")).withColumn("most", F.expr("least(own - size, from + i, from + own - n + (k - i))"))
        short = short.filter("least <= most").withColumn("at", F.explode(F.sequence("least", "most")))
        short = short.select("__group", "n", "i", F.expr("substr(low, at + 1, size)").alias("part"), F.col("w").alias("v"), F.col("low").alias("low_v"))
        met = long.join(short, ["__group", "n", "i", "part"]).filter("w <> v")
    good = met.filter(X.similarity(F.col("low_w"), F.col("low_v")) > similarity).select("__group", "w", "v")
    return good.union(good.select("__group", F.col("v").alias("w"), F.col("w").alias("v"))).distinct()


def lost_texts(items: DataFrame, near: DataFrame, distance: float) -> DataFrame:
    """__id of the items that go: those closer than distance to an earlier kept one of the same text w or one that near (__group, w, v) names.
    items: __group, __id, __o, w, x, y, written.

    Clashes aren't listed. A task takes a group's items in order and looks among the kept ones in the cells around, of which a text has
    a few at most, as they lie apart. A group too large for a task falls into parts of cells that touch. A larger part takes rounds: the first
    item of a text in a small cell stays if those of all cells around are later, and what clashes with it goes."""
    side = distance * (1 + 1e-6)

    def settle(items: pa.Table, near: pa.Table) -> pa.Table:
        like: dict[int, list[int]] = {}
        for w, v in zip(near.column("w").to_pylist(), near.column("v").to_pylist(), strict=True):
            like.setdefault(w, [w]).append(v)
        items = items.sort_by("n")
        kept: dict[tuple[int, int, int], list[tuple[float, float]]] = {}
        gone = []
        for i, w, x, y in zip(*(items.column(c).to_pylist() for c in ("__id", "w", "x", "y")), strict=True):
            cx, cy = math.floor(x / side), math.floor(y / side)
            around = (kept.get((v, a, b), ()) for v in like.get(w, (w,)) for a in (cx, cx - 1, cx + 1) for b in (cy, cy - 1, cy + 1))
            if any(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) < distance for spots in around for a, b in spots):
                gone.append(i)
            else:
                kept.setdefault((w, cx, cy), []).append((x, y))
        return pa.table({"__id": pa.array(gone, pa.int64())})

    def settled(items: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
        ranked = items.select(*by, "__id", "w", "x", "y", F.row_number().over(Window.partitionBy(*by).orderBy("__o")).alias("n"))
        return store.saved(ranked.groupBy(*by).cogroup(near.select(*by, "w", "v").groupBy(*by)).applyInArrow(settle, "__id long"), "settled")

    def sizes(items: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
        """Those of too many items and pairs of texts for a task."""
        return store.saved(items.select(*by).union(near.select(*by)).groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > PART).select(*by), "wide")

    def spots(step: float) -> list[Column]:
        return [F.floor(F.col(c) / step).alias(f"c{c}") for c in "xy"]

    def around(cells: DataFrame, near: DataFrame, reach: int) -> DataFrame:
        """Rows of cells at every cell around, of every text that is like theirs."""
        steps = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
        own = cells.select(*cells.columns, F.col("w").alias("v"))
        like = cells.join(near.select("__group", "w", "v"), ["__group", "w"]).select(*own.columns)
        rest = [c for c in cells.columns if c not in ("cx", "cy", "w", "__group")]
        return own.union(like).select("__group", F.col("v").alias("w"), *rest, F.explode(steps).alias("c")).select("__group", "w", *rest, "c.*")

    group, part, place = ["__group"], ["__group", "root"], ["__group", "w", "cx", "cy"]
    wide = sizes(items, near, group)
    if wide.isEmpty():
        return settled(items, near, group)
    out = [settled(items.join(wide, group, "left_anti"), near.join(wide, group, "left_anti"), group)]
    rest, near = store.saved(items.join(wide, group, "left_semi"), "rest"), store.saved(near.join(wide, group, "left_semi"), "near")
    while not rest.isEmpty():
        cells = store.saved(rest.select("__group", "w", *spots(side)).distinct().withColumn("c", F.monotonically_increasing_id()), "cells")
        edges = around(cells.withColumnRenamed("c", "a"), near, 1).join(cells.withColumnRenamed("c", "b"), place).filter("a < b").select("__group", "a", "b")
        roots = graph.connected(edges, group).withColumnRenamed("node", "c")
        cells = store.saved(cells.join(roots, ["__group", "c"], "left").withColumn("root", F.coalesce("root", "c")), "cells")
        parted = store.saved(rest.select("*", *spots(side)).join(cells, place).select(*rest.columns, "root"), "parted")
        words = cells.select(*part, "w").distinct()
        pairs = store.saved(near.join(words, ["__group", "w"]).join(words.withColumnRenamed("w", "v"), [*part, "v"]).select(*part, "w", "v"), "pairs")
        wide = sizes(parted, pairs, part)
        out.append(settled(parted.join(wide, part, "left_anti"), pairs.join(wide, part, "left_anti"), part))
        rest = store.saved(parted.join(wide, part, "left_semi").select(*rest.columns), "rest")
        for _ in range(ROUNDS):
            if rest.isEmpty():
                break
            placed = rest.select("*", *spots(side / 2))  # items of one cell are all closer than distance
            firsts = store.saved(placed.groupBy(*place).agg(F.min(F.struct("__o", "__id", "x", "y")).alias("first")), "firsts")
            waits = around(firsts, near, 2).join(firsts.withColumnRenamed("first", "other"), place).filter("other.__o < first.__o").select("first.__id").distinct()
            heads = store.saved(firsts.select("*", "first.__id").join(waits, "__id", "left_anti").select(*place, F.col("__id").alias("head"), F.col("first.x").alias("hx"), F.col("first.y").alias("hy")), "heads")
            hit = around(heads, near, 2).join(placed, place).filter((F.col("head") != F.col("__id")) & (X.line_length(F.col("hx"), F.col("hy"), F.col("x"), F.col("y")) < distance))
            gone = store.saved(hit.select("__id").distinct(), "gone")
            out.append(gone)
            rest = store.saved(rest.join(gone, "__id", "left_anti").join(heads.select(F.col("head").alias("__id")), "__id", "left_anti"), "rest")
    return functools.reduce(DataFrame.union, out)


def texts(df: DataFrame, keys: list[str], text: str, x: str, y: str, order: str, similarity: float, distance: float) -> DataFrame:
    low, px, py = F.lower(F.trim(text)), F.bround(x), F.bround(y)
    items = numbered(df, keys, [F.col(order)], [low, px, py])
    placed = items.select("__group", "__id", "__o", low.alias("low"), px.cast("double").alias("x"), py.cast("double").alias("y"))
    placed = placed.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))  # others are near nothing
    words = store.saved(placed.select("__group", "low").distinct().withColumn("w", F.monotonically_increasing_id()), "words")
    near = store.saved(alike(words, similarity), "near")
    placed = store.saved(placed.join(words, ["__group", "low"]).drop("low"), "placed")
    return items.join(lost_texts(placed, near, distance), "__id", "left_anti").select(*df.columns)


def boxes(df: DataFrame, keys: list[str], box: list[str], order: str, overlap: float) -> DataFrame:
    """Boxes meet where the middle of the smaller lies in the larger, which it does as they share over half of its sides. A box is looked for in the
    cells, as large as itself, that it touches: four at most; a middle is in one cell of each size that its group has."""
    if overlap <= 0.5:
        raise ValueError("boxes are met by their middles, so the overlap must be over one half")
    x, y, w, h = (F.col(c) for c in box)
    items = numbered(df, keys, [-(w * h), F.col(order)], [x, y, w, h])
    real = items.filter((w > 0) & (h > 0)).withColumn("level", F.ceil(F.log2(F.greatest(w, h, F.lit(1e-6)))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    to = lambda v: F.floor(v / size)
    row = F.struct(*[c for c in items.columns if c not in ("__id", "__group")])
    large = real.withColumn("cx", F.explode(F.sequence(to(x), to(x + w)))).withColumn("cy", F.explode(F.sequence(to(y), to(y + h)))).select("__group", "level", "cx", "cy", F.col("__id").alias("a"), row.alias("p"))
    levels = real.groupBy("__group").agg(F.collect_set("level").alias("levels"))
    small = real.drop("level").join(levels, "__group").withColumn("level", F.explode("levels"))
    small = small.select("__group", "level", to(x + w / 2).alias("cx"), to(y + h / 2).alias("cy"), F.col("__id").alias("b"), row.alias("q"))
    own = lambda r: [r[c] for c in box]
    # in the order the larger comes first
    pairs = large.join(small, ["__group", "level", "cx", "cy"]).filter((F.col("p.__o") < F.col("q.__o")) & (X.overlap_ratio(own(F.col("p")), own(F.col("q"))) >= overlap)).select("__group", "a", "b").distinct()
    return kept(items, pairs).select(*df.columns)
