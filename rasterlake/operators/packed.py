"""Images as packed lines: one row a line (image, y, width, height, rgba: four bytes a pixel).

A line of 2,752 pixels is one row of 11 KB, where a table of pixels has 2,752 rows. What a line tells by itself is read in
Arrow batches where the lines stand; what needs neighbouring lines is read in strips of STRIP lines, with copies of the
lines around them. Strips of one image are dealt to different tasks, and what goes on across their borders (vertical
runs, components) is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import sequence, tiles
from rasterlake.sources import store

STRIP = 64
LINES = "image string, y int, width int, height int, rgba binary"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Packed lines of all readable images below path (SRC-01), image being the file's name; others give no rows."""
    img = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, width, height, channels = (batch.column(k)[i].as_py() for k in range(4))
                grid = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(height, width, channels)
                for y in range(0, height, STRIP):
                    part = grid[y : y + STRIP]
                    rgba = np.full((*part.shape[:2], 4), 255, np.uint8)
                    for k in range(3):  # the source's order is blue, green, red
                        rgba[..., k] = part[..., 2 - k if channels > 2 else 0]
                    if channels == 4:
                        rgba[..., 3] = part[..., 3]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(y, y + n), pa.int32()), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([x.tobytes() for x in rgba], pa.binary())], ["image", "y", "width", "height", "rgba"])

    return img.select(F.element_at(F.split("origin", "/"), -1).alias("image"), "width", "height", "nChannels", "data").mapInArrow(cut, LINES)


def pack(pixels: DataFrame) -> DataFrame:
    """Packed lines of a table of pixels (image, y, x, r, g, b, a), which must have every pixel of its images."""
    value = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgba"])
    lines = pixels.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("x", value.alias("v")))).alias("p"))
    lines = lines.select("image", F.col("y").cast("int").alias("y"), F.size("p").alias("width"), F.unhex(F.array_join(F.col("p")["v"], "")).alias("rgba"))
    height = lines.groupBy("image").agg((F.max("y") + 1).cast("int").alias("height"))
    return lines.join(height, "image").select("image", "y", "width", "height", "rgba")


def unpack(lines: DataFrame) -> DataFrame:
    """A table of pixels (image, y, x, r, g, b, a) of packed lines."""
    schema = f"image {lines.schema['image'].dataType.simpleString()}, y int, x int, r int, g int, b int, a int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rgba = np.frombuffer(batch.column("rgba")[i].as_buffer(), np.uint8).reshape(-1, 4).astype(np.int32)
                n = len(rgba)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("image")[i].as_py()] * n, batch.schema.field("image").type), pa.array(np.full(n, batch.column("y")[i].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(rgba[:, k]) for k in range(4)]], ["image", "y", "x", *"rgba"])

    return lines.mapInArrow(run, schema)


def in_strips(lines: DataFrame, schema: str, read: Callable[[np.ndarray, int, int, int, pa.Table], pa.Table], before: int = 0, after: int = 0, beside: DataFrame | None = None, strip: int = STRIP) -> DataFrame:
    """read(grid, top, y0, y1, table) of each strip: grid holds the RGBA lines from top on, y0 to y1 are the strip's own, the others
    copies of up to before and after lines around it; table has the strip's lines and the columns of beside (image and
    others, one row an image), which goes to each strip by a join, as it grows with the images. Rows of schema without image,
    strip come out, which are put in front."""
    kind = lines.schema["image"].dataType.simpleString()
    own = F.floor(F.col("y") / strip)
    last = F.floor((F.col("height") - 1) / strip)
    at = F.sequence(F.greatest(F.floor((F.col("y") - after) / strip), F.lit(0)), F.least(F.floor((F.col("y") + before) / strip), last))
    dealt = lines.withColumn("strip", F.explode(at) if before or after else own)
    if beside is not None:
        sizes = lines.groupBy("image").agg(F.max("height").alias("height"))
        every = sizes.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("height")
        dealt = dealt.join(beside.join(every, "image"), ["image", "strip"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("y").combine_chunks()
        y = table.column("y").to_numpy()
        k = table.column("strip")[0].as_py()
        grid = np.stack([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 4) for x in table.column("rgba")])
        out = read(grid, int(y[0]), k * strip, min((k + 1) * strip, table.column("height")[0].as_py()), table)
        n = len(out)
        head = [pa.array([table.column("image")[0].as_py()] * n, table.schema.field("image").type), pa.array([k] * n, pa.int64())]
        return pa.table([*head, *out.columns], names=["image", "strip", *out.column_names])

    return dealt.groupBy("image", "strip").applyInArrow(run, f"image {kind}, strip long, {schema}")


def ink_of(grid: np.ndarray, alpha: int = 10) -> np.ndarray:
    """The classifier's ink: visible (over that alpha) and darker than nearly white (BT.709)."""
    r, g, b, a = (grid[..., k] for k in range(4))
    return (a > alpha) & (r * X.BT709[0] + g * X.BT709[1] + b * X.BT709[2] < 245)


def runs_along(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each run of True in the rows of a mask, in order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, start, end - start


PIECE = "array<struct<x:int,s:int,e:int>>"
FEATURES = f"""width int, height int, n_ink long, n_rich long, n_edge long, n_aligned long, codes array<int>, y0 int, y1 int, x0 int, x1 int,
long array<int>, short_h long, whole array<int>, short_v long, pieces {PIECE}"""


def _extent(n: int, share: float, least: int) -> int:
    return max(int(np.floor(n * share)), least)


def _features(grid: np.ndarray, top: int, y0: int, y1: int, table: pa.Table) -> pa.Table:
    height, n = table.column("height")[0].as_py(), y1 - y0
    width = grid.shape[1]
    ink = ink_of(grid[:n])
    r, g, b = (grid[..., k].astype(np.int32) for k in range(3))
    grey = (r + g + b) / 3.0 / 255.0
    high, low = np.maximum(np.maximum(r, g), b)[:n] / 255.0, np.minimum(np.minimum(r, g), b)[:n] / 255.0
    rich = ink & ((high - low) / (high + 1e-6) > 0.25) & (high > 0.2)
    dx, dy = np.full((n, width), np.nan), np.full((n, width), np.nan)
    dx[:, :-1] = np.abs(grey[:n, 1:] - grey[:n, :-1])
    below = min(n, len(grid) - 1)
    dy[:below] = np.abs(grey[1 : below + 1] - grey[:below])
    edge = ink & (dx + dy > 0.08)
    aligned = edge & ((dx > dy * 2) | (dy > dx * 2))
    codes = np.unique(((r[:n] >> 5) * 64 + (g[:n] >> 5) * 8 + (b[:n] >> 5))[ink])
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    row, _, size = runs_along(ink)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, size)
    short_h = (size >= 2) & (size <= _extent(width, 0.08, 2))
    x, s, size = runs_along(ink.T)
    touches = ((s == 0) & (y0 > 0)) | ((s + size == n) & (y1 < height))
    short_v = ~touches & (size >= 2) & (size <= _extent(height, 0.08, 2))
    pieces = [{"x": i, "s": p, "e": q} for i, p, q in zip(x[touches].tolist(), (y0 + s[touches]).tolist(), (y0 + s + size)[touches].tolist(), strict=True)]
    some = lambda v, k: int(v[k]) if len(v) else None
    values = [
        width, height, int(ink.sum()), int(rich.sum()), int(edge.sum()), int(aligned.sum()), codes.tolist(), None if not len(ys) else y0 + int(ys[0]), None if not len(ys) else y0 + int(ys[-1]), some(xs, 0), some(xs, -1),
        (y0 + np.flatnonzero(longest >= _extent(width, 0.45, 1))).tolist(), int(short_h.sum()), np.unique(x[~touches & (size >= _extent(height, 0.45, 1))]).tolist(), int(short_v.sum()), pieces,
    ]
    names = [c.split(" ")[0] for c in FEATURES.replace("\n", " ").split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.struct([(c, pa.int32()) for c in "xse"]))]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def features(lines: DataFrame, strip: int = STRIP) -> DataFrame:
    """The columns of classify.image_features() from packed lines (AGG-01, AGG-04, AGG-05): an image's strips are read by different tasks,
    each giving one row; vertical runs that touch a strip's border are joined with what goes on behind it."""
    d = store.saved(in_strips(lines, FEATURES, _features, after=1, strip=strip), "strips")
    total = lambda c: F.sum(c).alias(c)
    box = (F.max("y1") - F.min("y0") + 1) * (F.max("x1") - F.min("x0") + 1)
    base = d.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"), *map(total, ("n_ink", "n_rich", "n_edge", "n_aligned", "short_h", "short_v")), box.alias("box"))
    # of the 512 codes, those that occur: a sum of distinct ones, a row for each code and image
    codes = d.select("image", F.explode("codes").alias("code")).groupBy("image", "code").agg(F.lit(1).alias("one")).groupBy("image").agg(F.count("*").alias("n_codes"), F.max(F.col("code") == 511).alias("white"))
    order = Window.partitionBy("image", "x").orderBy("s")
    pieces = d.select("image", "height", F.explode("pieces").alias("p")).select("image", "height", "p.*")
    pieces = pieces.withColumn("new", (F.col("s") != F.coalesce(F.lag("e").over(order), F.lit(-1))).cast("int")).withColumn("g", F.sum("new").over(order))
    joined = pieces.groupBy("image", "x", "g").agg(F.max("height").alias("height"), F.sum(F.col("e") - F.col("s")).alias("len"))
    short = joined.filter((F.col("len") >= 2) & (F.col("len") <= F.greatest(F.floor(F.col("height") * 0.08), F.lit(2)))).groupBy("image").agg(F.count("*").alias("short_more"))
    high = joined.filter(F.col("len") >= F.greatest(F.floor(F.col("height") * 0.45), F.lit(1))).select("image", "x").union(d.select("image", F.explode("whole"))).distinct()
    count = lambda long, line, name: sequence.gap_clusters(long, ["image"], line, 1, "half_even").groupBy("image").agg(F.count("*").alias(name))
    out = base.join(codes, "image", "left").join(short, "image", "left").join(count(high, "x", "long_v"), "image", "left")
    out = out.join(count(d.select("image", F.explode("long").alias("y")), "y", "long_h"), "image", "left")
    out = out.fillna(0, ["n_codes", "short_more", "long_v", "long_h"])
    other = (F.coalesce(F.col("box"), F.lit(0)) > F.col("n_ink")) & ~F.coalesce("white", F.lit(False))
    return out.select(
        "image", "width", "height", (F.col("n_ink") / (F.col("width") * F.col("height"))).alias("ink"), (F.col("n_rich") / F.greatest("n_ink", F.lit(1))).alias("saturated"), F.coalesce(F.try_divide("n_aligned", "n_edge"), F.lit(0.0)).alias("aligned"),
        F.when(F.col("n_ink") > 0, F.col("n_codes") + other.cast("int")).otherwise(0).cast("long").alias("colors"), "long_v", "long_h", (F.col("short_v") + F.col("short_more")).alias("short_v"), "short_h",
    )


def _hsv(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value, as functions.exprs has them."""
    r, g, b = (grid[..., k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    with np.errstate(divide="ignore", invalid="ignore"):
        hue = np.select([d == 0, top == b, top == g], [0.0, 60 * ((r - g) / d + 4), 60 * ((b - r) / d + 2)], 60 * np.mod((g - b) / d, 6.0))
        return hue, np.where(top == 0, 0.0, d / top), top / 255.0


def hue_bins(lines: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """image, lim, bin, n: pixels of each of 36 hues that are visible and reach limits[lim] (saturation, value). A batch of lines gives one
    count an image and bin."""
    kind = lines.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grid = np.frombuffer(batch.column("rgba")[i].as_buffer(), np.uint8).reshape(-1, 4)
                hue, sat, val = _hsv(grid)
                at = (np.floor(hue / 10).astype(np.int64)) % 36
                n = np.concatenate([np.bincount(at[(grid[:, 3] > 10) & (sat >= s) & (val >= v)], minlength=36) for s, v in limits])
                some = np.flatnonzero(n)
                if len(some):
                    name = pa.array([batch.column("image")[i].as_py()] * len(some), batch.schema.field("image").type)
                    yield pa.RecordBatch.from_arrays([name, pa.array((some // 36).astype(np.int32)), pa.array((some % 36).astype(np.int32)), pa.array(n[some])], ["image", "lim", "bin", "n"])

    return lines.mapInArrow(run, f"image {kind}, lim int, bin int, n long").groupBy("image", "lim", "bin").agg(F.sum("n").alias("n"))


def curve_runs(lines: DataFrame, curves: DataFrame, saturation: float = 0.25, value: float = 0.2, tolerance: float = 22.0, least_area: int = 30, strip: int = STRIP) -> DataFrame:
    """image, curve, y, start, len: the runs of colors.curve_mask() (ALG-04, ALG-03, SET-10) from packed lines. curves: image, curve, target.

    One pass counts hues for both sets of limits, one reads each strip with two lines around it, finds the hits of both and
    closes them; where an image has enough strict hits of a curve those count, else the relaxed ones."""
    relaxed = (max(saturation * 0.6, 0.05), max(value * 0.6, 0.05), min(tolerance * 1.4, 60.0))
    limits = [(saturation, value, tolerance), relaxed]
    asked = curves.select("image", "curve", F.col("target").cast("double").alias("target")).crossJoin(F.broadcast(curves.sparkSession.createDataFrame([(k, float(t)) for k, (_, _, t) in enumerate(limits)], "lim int, tolerance double")))
    bins = hue_bins(lines, [x[:2] for x in limits])
    near = X.hue_distance(F.col("bin") * 10.0 + 5.0, F.col("target")) <= F.col("tolerance") * 2
    centre = F.min_by(F.when(near, F.col("bin") * 10.0 + 5.0), F.when(near, F.struct(-F.col("n"), F.col("bin"))))
    centres = asked.join(bins, ["image", "lim"], "left").groupBy("image", "curve", "lim", "target").agg(F.coalesce(centre, F.col("target")).alias("center"))
    beside = centres.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("curve", "lim", "center"))).alias("wanted"))
    spread = lambda m, r: np.logical_or.reduce([m[r + k : m.shape[0] - r + k] for k in range(-r, r + 1)])

    def read(grid: np.ndarray, top: int, y0: int, y1: int, table: pa.Table) -> pa.Table:
        height = table.column("height")[0].as_py()
        hue, sat, val = _hsv(grid)
        rows: list[dict] = []
        # lines around the strip that aren't there: two before and two after, as far as they lie in the image
        pad = ((2 - (y0 - top), 2 - (top + len(grid) - y1)), (1, 1))
        real = np.pad(np.ones(hue.shape, bool), pad)
        for w in table.column("wanted")[0].as_py():
            s, v, t = limits[w["lim"]]
            low, high = (w["center"] - t) % 360.0, (w["center"] + t) % 360.0
            near = (hue >= low) & (hue <= high) if low <= high else (hue >= low) | (hue <= high)
            hit = (grid[..., 3] > 10) & (sat >= s) & (val >= v) & near
            grown = spread(spread(np.pad(hit, pad), 1).T, 1).T  # one line and column less on each side
            grown = np.pad(grown, 1) & real
            closed = ~spread(spread(real & ~grown, 1).T, 1).T
            y, start, size = runs_along(closed[1:-1])
            rows.append({"curve": w["curve"], "lim": w["lim"], "hits": int(hit[y0 - top : y1 - top].sum()), "runs": [{"y": a, "start": b, "len": c} for a, b, c in zip((y0 + y).tolist(), start.tolist(), size.tolist(), strict=True)]})
        return pa.Table.from_pylist(rows, pa.schema([("curve", pa.string()), ("lim", pa.int32()), ("hits", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int32()) for c in ("y", "start", "len")])))]))

    found = store.saved(in_strips(lines, "curve string, lim int, hits long, runs array<struct<y:int,start:int,len:int>>", read, 2, 2, beside, strip), "masks")
    sizes = lines.groupBy("image").agg(F.greatest(F.floor(F.max(F.col("width").cast("long") * F.col("height")) * 0.0005), F.lit(8)).alias("least"))
    chosen = found.filter("lim = 0").groupBy("image", "curve").agg(F.sum("hits").alias("hits")).join(sizes, "image").select("image", "curve", F.when(F.col("hits") >= F.col("least"), 0).otherwise(1).alias("lim"))
    runs = found.join(chosen, ["image", "curve", "lim"]).select("image", "curve", F.explode("runs").alias("r")).select("image", "curve", "r.*")
    return tiles.large_only(tiles.labelled(runs, ["image", "curve"]), ["image", "curve"], least_area)


def diff(actual: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """image, rmse, bad of two tables of packed lines (AGG-25, GAT-02, JON-16): over white, the root of the mean square of all channels (0 to
    1) and the share of pixels of which a channel is off by over tolerance. Images of different sizes, or in one table only, have no
    row. A pair of lines gives one row of sums."""
    kind = actual.schema["image"].dataType.simpleString()
    size = lambda df: df.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("lines"))
    same = size(actual).join(size(expected), ["image", "width", "height", "lines"]).select("image").hint("merge")  # a row an image, never gathered
    pairs = actual.select("image", "y", F.col("rgba").alias("p")).join(expected.select("image", "y", F.col("rgba").alias("q")), ["image", "y"]).join(same, "image", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def white(x: pa.Scalar) -> np.ndarray:
            v = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 4).astype(np.float64)
            share = v[:, 3:] / 255
            return np.where(share == 1, v[:, :3], v[:, :3] * share + 255 * (1 - share))

        for batch in batches:
            square, bad, n = [], [], []
            for p, q in zip(batch.column("p"), batch.column("q"), strict=True):
                d = np.abs(white(p) - white(q))
                square.append(float((d * d).sum() / (3 * 255 * 255)))
                bad.append(int((d.max(axis=1, initial=0) > tolerance).sum()))
                n.append(len(d))
            yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(square, pa.float64()), pa.array(bad, pa.int64()), pa.array(n, pa.int64())], ["image", "square", "bad", "n"])

    sums = pairs.mapInArrow(run, f"image {kind}, square double, bad long, n long").groupBy("image").agg(*[F.sum(c).alias(c) for c in ("square", "bad", "n")])
    return sums.select("image", F.sqrt(F.col("square") / F.col("n")).alias("rmse"), (F.col("bad") / F.col("n")).alias("bad"))


_BOX = "x int, y int, width int, height int"


def _profiles(lines: DataFrame, boxes: DataFrame, alpha: int, strip: int) -> DataFrame:
    """image, path, from, rows, cols: of each strip that a box touches, the ink of its lines (from line `from` on) and of its columns, as 64-bit numbers."""
    beside = boxes.groupBy("image").agg(F.collect_list(F.struct("path", "x", "y", "width", "height")).alias("boxes"))

    def read(grid: np.ndarray, top: int, y0: int, y1: int, table: pa.Table) -> pa.Table:
        ink, out = ink_of(grid, alpha), []
        for b in table.column("boxes")[0].as_py():
            first, last = max(y0, b["y"]), min(y1, b["y"] + b["height"])
            if first < last:
                part = ink[first - top : last - top, b["x"] : b["x"] + b["width"]]
                out.append({"path": b["path"], "from": first, "rows": part.sum(axis=1, dtype="<i8").tobytes(), "cols": part.sum(axis=0, dtype="<i8").tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("path", pa.list_(pa.int32())), ("from", pa.int32()), ("rows", pa.binary()), ("cols", pa.binary())]))

    return in_strips(lines, "path array<int>, `from` int, rows binary, cols binary", read, beside=beside, strip=strip)


def xy_cut(lines: DataFrame, deepest: int = 4, alpha: int = 10, strip: int = STRIP) -> DataFrame:
    """The tree of layout.xy_cut() (ALG-10) from packed lines, level by level: image, node, parent, type, depth, x, y, width, height.

    A level's boxes get their profiles from all strips that they touch, by different tasks; a box's profiles, no longer than its
    sides times the strips, are added up and cut in one. So no task holds an image. Levels are as many as the tree is deep."""
    from rasterlake.operators import layout

    kind = lines.schema["image"].dataType.simpleString()
    lines = lines.select("image", "y", "width", "height", "rgba")
    sizes = lines.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    boxes = store.saved(sizes.select("image", F.array().cast("array<int>").alias("path"), F.lit(True).alias("by_rows"), F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height"), "boxes")
    done = []
    for depth in range(deepest + 1):
        large = boxes.filter("width >= 20 AND height >= 20")
        if large.isEmpty():
            break

        def cut(table: pa.Table) -> pa.Table:
            table = table.sort_by("from")
            rows = np.concatenate([np.frombuffer(v.as_buffer(), "<i8") for v in table.column("rows")])
            cols = np.sum([np.frombuffer(v.as_buffer(), "<i8") for v in table.column("cols")], axis=0)
            by_rows, name, cuts = table.column("by_rows")[0].as_py(), "LEAF", []
            for way in (by_rows, not by_rows):
                cuts = layout.cut_places(rows if way else cols)
                if cuts:
                    name = "ROW" if way else "COL"
                    break
            n = len(rows) if name == "ROW" else len(cols)
            middle = [0, *[(a + b) // 2 for a, b in cuts], n] if cuts else []
            parts = [{"a": a, "b": b} for a, b in zip(middle, middle[1:])]
            return pa.table([table.column("image").slice(0, 1), table.column("path").slice(0, 1), pa.array([name]), pa.array([parts], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["image", "path", "type", "parts"])

        profiles = _profiles(lines, large, alpha, strip).join(large.select("image", "path", "by_rows"), ["image", "path"])
        found = profiles.groupBy("image", "path").applyInArrow(cut, f"image {kind}, path array<int>, type string, parts array<struct<a:int,b:int>>")
        level = store.saved(boxes.join(found, ["image", "path"], "left").withColumn("type", F.coalesce("type", F.lit("LEAF"))), "level")
        done.append(level.select("image", "path", "type", F.lit(depth).alias("depth"), "x", "y", "width", "height"))
        child = level.select("image", "path", "type", "x", "y", "width", "height", F.posexplode("parts").alias("k", "p"))
        down = F.col("type") == "ROW"
        size = F.col("p.b") - F.col("p.a")
        boxes = store.saved(child.select("image", F.concat("path", F.array("k")).alias("path"), (~down).alias("by_rows"), F.when(down, F.col("x")).otherwise(F.col("x") + F.col("p.a")).alias("x"), F.when(down, F.col("y") + F.col("p.a")).otherwise(F.col("y")).alias("y"), F.when(down, F.col("width")).otherwise(size).alias("width"), F.when(down, size).otherwise(F.col("height")).alias("height")), "boxes")
    done.append(boxes.select("image", "path", F.lit("LEAF").alias("type"), F.size("path").alias("depth"), "x", "y", "width", "height"))
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    # arrays compare by their first difference, a beginning before what it begins: this is preorder
    nodes = nodes.withColumn("node", F.row_number().over(Window.partitionBy("image").orderBy("path")) - 1)
    above = nodes.select("image", F.col("path").alias("up"), F.col("node").alias("parent"))
    out = nodes.withColumn("up", F.when(F.size("path") > 0, F.slice("path", 1, F.size("path") - 1))).join(above, ["image", "up"], "left")
    return out.select("image", "node", F.coalesce("parent", F.lit(-1)).alias("parent"), "type", "depth", "x", "y", "width", "height")


def kernel(sigma: float) -> list[int]:
    """Weights of a Gaussian from -reach to reach, three sigma wide, in parts of 65,536, which they add up to; the middle takes what rounding leaves."""
    reach = int(np.ceil(3 * sigma))
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)
    parts = np.rint(65536 * w / w.sum()).astype(int)
    parts[reach] += 65536 - parts.sum()
    return parts.tolist()


def blurred(lines: DataFrame, sigmas: DataFrame, widest: float = 8.0, strip: int = STRIP) -> DataFrame:
    """Packed lines under a Gaussian blur of all four channels (PRJ-12), first along lines, then across, each rounded to whole numbers; beyond an edge its last
    pixels repeat. sigmas: image, sigma (null or 0 leaves an image as it is; widest at most). Whole-number weights give the same result
    everywhere. A strip is read with the lines around it that a kernel reaches."""
    reach = int(np.ceil(3 * widest))

    def along(v: np.ndarray, weights: list[int]) -> np.ndarray:
        r = len(weights) // 2
        padded = np.pad(v, ((r, r), (0, 0), (0, 0)), mode="edge").astype(np.int64)
        return sum(w * padded[k : k + len(v)] for k, w in enumerate(weights)) + 32768 >> 16

    def read(grid: np.ndarray, top: int, y0: int, y1: int, table: pa.Table) -> pa.Table:
        sigma = table.column("sigma")[0].as_py() or 0.0
        if not 0 <= sigma <= widest:
            raise ValueError(f"a blur of {sigma} is over the widest, {widest}")
        out, height = grid[y0 - top : y1 - top], table.column("height")[0].as_py()
        if sigma > 0:
            weights = kernel(sigma)
            r = len(weights) // 2
            level = along(grid.transpose(1, 0, 2), weights).transpose(1, 0, 2)
            # lines that the strip lacks lie beyond the image's edge: its last one repeats
            level = np.concatenate([np.repeat(level[:1], max(0, r - (y0 - top)), axis=0), level, np.repeat(level[-1:], max(0, r - (top + len(grid) - y1)), axis=0)])
            first = max(y0 - top, r) - r
            out = along(level, weights)[first + r : first + r + y1 - y0]
        rgba = np.ascontiguousarray(out, np.uint8)
        n = y1 - y0
        return pa.table({"y": pa.array(range(y0, y1), pa.int32()), "width": pa.array([grid.shape[1]] * n, pa.int32()), "height": pa.array([height] * n, pa.int32()), "rgba": pa.array([v.tobytes() for v in rgba], pa.binary())})

    found = in_strips(lines.select("image", "y", "width", "height", "rgba"), "y int, width int, height int, rgba binary", read, reach, reach, sigmas.select("image", F.col("sigma").cast("double").alias("sigma")), strip)
    return found.drop("strip")
