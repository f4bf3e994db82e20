"""Runs of cases: time limits, rasters of rendered figures, gates, codes and folders of what a run leaves."""

from __future__ import annotations

import contextlib
import re
import signal
import threading
import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import figures as G
from rasterlake.operators import scoring

#: Codes of a run on a real figure, in the order in which they are looked for.
REAL_CODES = {
    "E1400": "no path", "E1401": "no file", "E1402": "no PNG", "E1403": "no gates", "E1404": "gates incomplete", "E1405": "gates not numeric", "E1406": "another template than expected",
    "E1407": "validator errors", "E1408": "no raster to compare", "E1409": "gate failed",
}


class TimedOut(Exception):
    """A call took longer than it may."""


class _Deadlines:
    """The times by which open blocks of this process must end; the alarm is always set for the earliest."""

    ends: list[float] = []

    @classmethod
    def set(cls) -> None:
        signal.setitimer(signal.ITIMER_REAL, max(min(cls.ends) - time.monotonic(), 1e-4) if cls.ends else 0.0)

    @classmethod
    def ring(cls, *_: object) -> None:
        late = cls.ends and min(cls.ends) <= time.monotonic()
        if late:
            raise TimedOut("over its time limit")
        cls.set()  # an alarm that came early


@contextlib.contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """Raises TimedOut in a block that runs longer than seconds, or than a block around it may (ORC-02). Limits of 0 or none, and threads other than a
    process's main one, which Spark's Python workers run in, have no limit."""
    end = time.monotonic() + (seconds or 0)
    limited = end > time.monotonic() and threading.current_thread() is threading.main_thread()
    if limited:
        signal.signal(signal.SIGALRM, _Deadlines.ring)
        _Deadlines.ends.append(end)
        _Deadlines.set()
    try:
        yield
    finally:
        if limited:
            _Deadlines.ends.remove(end)
            _Deadlines.set()


def guarded(df: DataFrame, keys: list[str], call: Callable[[dict], str | None], seconds: float | None = None) -> DataFrame:
    """keys, result, error of call(row as a dict), one row at a time (ORC-04): what it raises, a time limit included, is the row's error and
    never the job's."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                result = error = None
                try:
                    with time_limit(seconds):
                        result = call(row)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append([*[row[k] for k in keys], result, error])
            yield pd.DataFrame(out, columns=[*keys, "result", "error"])

    return df.mapInPandas(run, f"{kinds}, result string, error string")


def debug_folder(root: Column | str, template: Column, case: Column | None = None) -> Column:
    """Where a candidate's artifacts go (ORC-03): one folder a case and template below root, with signs that no path has replaced."""
    safe = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("none")), r"[^A-Za-z0-9._-]+", "_")
    parts = [F.lit(root) if isinstance(root, str) else root, *([safe(case)] if case is not None else []), F.lit("candidates"), safe(template)]
    return F.concat_ws("/", *parts)


def placeholder(svg: Column, reason: Column, width: int = 640, height: int = 360) -> Column:
    """The SVG, or one that only states the reason where there is none (SRC-21)."""
    from rasterlake.operators import render

    body = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><g id="figure_root"><text id="txt_placeholder" x="{width // 2}" y="{height // 2}" text-anchor="middle">'), render.escaped(F.coalesce(reason, F.lit("no result"))), F.lit("</text></g></svg>"))
    return F.coalesce(svg, body)


_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _color(value: str | None) -> tuple[int, int, int] | None:
    if value and re.fullmatch("#[0-9a-fA-F]{6}", value):
        return int(value[1:3], 16), int(value[3:5], 16), int(value[5:7], 16)
    return {"black": (0, 0, 0), "white": (255, 255, 255)}.get(value or "")


def _curve(d: str) -> list[tuple[float, float]]:
    """Points of a path of absolute M, L and C commands, curves in sixteen steps."""
    out: list[tuple[float, float]] = []
    for command, args in re.findall(r"([MLC])([^MLC]*)", d):
        v = list(map(float, _NUMBER.findall(args)))
        if command == "C":
            for k in range(0, len(v) - 5, 6):
                p = np.array([out[-1], v[k : k + 2], v[k + 2 : k + 4], v[k + 4 : k + 6]])
                t = np.linspace(0, 1, 17)[1:, None]
                out += map(tuple, (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3])
        else:
            out += zip(v[::2], v[1::2])
    return out


def rasterize(svg: str) -> np.ndarray:
    """An RGBA raster of what rendering draws (SRC-18): boxes, lines, polylines, polygons, circles and paths, in order, on white. Texts, dashes
    and smoothing of edges are left out; it stands in for an external rasteriser. ValueError for a document without a size."""
    root = ElementTree.fromstring(svg)
    if not (root.get("width") and root.get("height")):
        raise ValueError("the document has no size")
    w, h = int(float(root.get("width"))), int(float(root.get("height")))
    out = np.full((h, w, 4), 255, np.uint8)
    ys, xs = np.arange(h)[:, None] + 0.5, np.arange(w)[None, :] + 0.5

    def paint(mask: np.ndarray, color: tuple[int, int, int], opacity: float, at: tuple[slice, slice]) -> None:
        part = out[at][..., :3]
        part[mask] = np.rint(part[mask] * (1 - opacity) + np.array(color) * opacity).astype(np.uint8)

    def window(x0: float, y0: float, x1: float, y1: float) -> tuple[slice, slice]:
        return slice(max(0, int(y0) - 1), max(0, min(h, int(y1) + 2))), slice(max(0, int(x0) - 1), max(0, min(w, int(x1) + 2)))

    def stroke(points: list[tuple[float, float]], color: tuple[int, int, int], width: float) -> None:
        r = max(width, 1.0) / 2
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            at = window(min(x1, x2) - r, min(y1, y2) - r, max(x1, x2) + r, max(y1, y2) + r)
            y, x = ys[at[0]], xs[:, at[1]]
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
            paint((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= r * r, color, 1.0, at)

    def fill(points: list[tuple[float, float]], color: tuple[int, int, int], opacity: float) -> None:
        p = np.array(points)
        at = window(*p.min(axis=0), *p.max(axis=0))
        y, x = ys[at[0]], xs[:, at[1]]
        inside = np.zeros((y.shape[0], x.shape[1]), bool)
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            if y1 != y2:
                inside ^= ((y1 <= y) != (y2 <= y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        paint(inside, color, opacity, at)

    for e in root.iter():
        tag = e.tag.rsplit("}", 1)[-1]
        n = lambda k, e=e: float(e.get(k) or 0)
        closed, points = True, []
        if tag == "rect":
            x, y, a, b = n("x"), n("y"), n("width"), n("height")
            points = [(x, y), (x + a, y), (x + a, y + b), (x, y + b)]
        elif tag == "circle":
            points = [(n("cx") + n("r") * np.cos(t), n("cy") + n("r") * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 33)[:-1]]
        elif tag in ("polygon", "polyline"):
            v = list(map(float, _NUMBER.findall(e.get("points") or "")))
            points, closed = list(zip(v[::2], v[1::2])), tag == "polygon"
        elif tag == "line":
            points, closed = [(n("x1"), n("y1")), (n("x2"), n("y2"))], False
        elif tag == "path":
            points, closed = _curve(e.get("d") or ""), False
        color = _color(e.get("fill") or ("black" if closed else None))
        if closed and len(points) > 2 and color and e.get("fill") != "none":
            fill(points, color, float(e.get("fill-opacity") or 1))
        color = _color(e.get("stroke"))
        if color and len(points) > 1:
            stroke([*points, points[0]] if closed else points, color, float(e.get("stroke-width") or 1))
    return out


def rasters(documents: DataFrame, key: str, svg: str, seconds: float | None = 60) -> DataFrame:
    """key, y, x, r, g, b, a of each document's raster, and one row of nulls with an error where it has none (SRC-18, ORC-02). A document
    is one bounded image."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch[svg], strict=True):
                try:
                    with time_limit(seconds):
                        grid = rasterize(text)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({key: [k], "y": [None], "x": [None], "r": [None], "g": [None], "b": [None], "a": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                h, w, _ = grid.shape
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({key: [k] * (h * w), "y": y, "x": x, **{c: grid[..., i].reshape(-1) for i, c in enumerate("rgba")}, "error": None})

    return documents.select(key, svg).mapInPandas(run, f"`{key}` {kind}, y int, x int, r int, g int, b int, a int, error string")


def raster_lines(documents: DataFrame, key: str, svg: str, seconds: float | None = 60) -> DataFrame:
    """image (the key as text), y, width, height, rgba, error: each document's raster as packed lines, or one row with an error where it
    has none (SRC-18, ORC-02)."""
    import pyarrow as pa

    schema = pa.schema([("image", pa.string()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with time_limit(seconds):
                        grid = rasterize(text)
                except Exception as e:  # noqa: BLE001
                    yield pa.RecordBatch.from_pylist([{"image": k, "error": f"{type(e).__name__}: {e}"}], schema)
                    continue
                h, w, _ = grid.shape
                yield pa.RecordBatch.from_pylist([{"image": k, "y": y, "width": w, "height": h, "rgba": grid[y].tobytes()} for y in range(h)], schema)

    return documents.select(F.col(key).cast("string").alias("image"), F.col(svg)).mapInArrow(run, "image string, y int, width int, height int, rgba binary, error string")


def real_code(path: Column, exists: Column, png: Column, gates: Column, selected: Column, expected: Column, must_pass: Column, errors: Column, rmse: Column, bad: Column) -> Column:
    """Code of a run on a real figure (ORC-05), the first of REAL_CODES that holds, else null. gates: map of text with max_rmse,
    max_bad_pixel_ratio and pixel_tolerance; expected: array of templates; errors: how many the validator found."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    names = ("max_rmse", "max_bad_pixel_ratio", "pixel_tolerance")
    value = lambda n: F.try_element_at(gates, F.lit(n))
    every = lambda f: f(value(names[0])) | f(value(names[1])) | f(value(names[2]))
    listed = F.coalesce(expected, F.array().cast("array<string>"))
    out = F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "E1400").when(no(exists), "E1401").when(no(png), "E1402").when(gates.isNull() | (F.size(gates) == 0), "E1403")
    out = out.when(every(lambda v: v.isNull()), "E1404").when(every(lambda v: v.try_cast("double").isNull()), "E1405")
    out = out.when((F.size(listed) > 0) & no(F.array_contains(listed, selected)), "E1406").when(F.coalesce(must_pass, F.lit(True)) & (F.coalesce(errors, F.lit(0)) > 0), "E1407")
    over = (rmse > value("max_rmse").try_cast("double")) | (bad > value("max_bad_pixel_ratio").try_cast("double"))
    return out.when(rmse.isNull() | bad.isNull(), "E1408").when(over, "E1409")


def run_cases(cases: DataFrame, actual: DataFrame, expected: DataFrame, max_rmse: float, max_bad: float, tolerance: float = 10) -> DataFrame:
    """case, status, rmse, bad, error of rendered cases against their expected rasters (ORC-04, GAT-03). cases: case, svg; actual: rows of
    rasters() by case; expected: case, y, x, r, g, b, a. A case without a raster, or of another size than expected, is
    'skipped' with its error."""
    from rasterlake.operators import raster

    channels = ["r", "g", "b"]
    drawn = actual.filter("error IS NULL").withColumnRenamed("case", "image")
    metrics = raster.diff(drawn, expected.withColumnRenamed("case", "image"), ["image", "y", "x"], channels, tolerance)
    size = lambda df, name: df.groupBy("image").agg(F.struct(F.max("y"), F.max("x")).alias(name))
    same = size(drawn, "p").join(size(expected.withColumnRenamed("case", "image"), "q"), "image").filter("p = q").select("image")
    errors = actual.filter("error IS NOT NULL").groupBy("case").agg(F.first("error").alias("error"))
    d = cases.select("case").join(metrics.join(same, "image", "left_semi").withColumnRenamed("image", "case"), "case", "left").join(errors, "case", "left")
    why = F.when(F.col("rmse").isNull(), F.coalesce("error", F.lit("no raster of the expected size")))
    return d.select("case", scoring.gate(F.col("rmse"), F.col("bad"), max_rmse, max_bad).alias("status"), "rmse", "bad", why.alias("error"))


def degraded(pixels: DataFrame, cases: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Pixels of rebuilt, harder inputs (ORC-07, PRJ-12, PRJ-13): each image rescaled about its middle, under gamma and contrast and with
    noise, all by draws seeded with its case's name. pixels: image, y, x, r, g, b, a; cases: image, case; ranges: scale, gamma, contrast,
    noise_sigma and blur_radius, where given. What is scaled out of view is white and clear. Rotation isn't built."""
    from rasterlake.operators import packed

    wanted = {k: ranges.get(k, (d, d)) for k, d in (("scale", 1.0), ("gamma", 1.0), ("contrast", 1.0), ("noise_sigma", 0.0), ("blur_radius", 0.0))}
    drawn = G.seeded_draws(cases.select("image", "case"), "case", wanted)
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).join(drawn, "image")
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    source = lambda v, n: F.floor((F.col(v) + 0.5 - F.col(n) / 2) / F.col("scale") + F.col(n) / 2).cast("long")
    p = pixels.select("image", F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "r", "g", "b", "a")
    d = grid.withColumn("sy", source("y", "height")).withColumn("sx", source("x", "width")).join(p, ["image", "sy", "sx"], "left").fillna(255, ["r", "g", "b"]).fillna(0, ["a"])
    if max(wanted["blur_radius"]) > 0:
        soft = packed.blurred(packed.pack(d), drawn.select("image", F.greatest("blur_radius", F.lit(0.0)).alias("sigma")), max(wanted["blur_radius"]))
        d = packed.unpack(soft).join(drawn, "image")
    d = d.withColumns({c: G.gamma_contrast(F.col(c), F.col("gamma"), F.col("contrast")) for c in "rgb"})
    unit = lambda salt: (F.pmod(F.xxhash64("case", "y", "x", F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = lambda c: F.sqrt(-2 * F.ln(unit(c))) * F.cos(2 * np.pi * unit(c + "'")) * F.col("noise_sigma")
    return d.select("image", "y", "x", *[F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) + noise(c)))).cast("int").alias(c) for c in "rgb"], "a")
