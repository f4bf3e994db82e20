"""Curves as ordered arrays of points: simplification, Bezier fits and paths, one curve a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_curve(points: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """keys and xy (array of struct x, y) in order; a curve has a bounded number of points."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    return points.groupBy(*keys).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("xy"))


def rdp(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Marks of the points that Ramer-Douglas-Peucker keeps (ALG-05)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        v = q - p
        n = np.hypot(*v)
        inner = points[a + 1 : b] - p
        d = np.abs(v[0] * inner[:, 1] - v[1] * inner[:, 0]) / n if n else np.hypot(inner[:, 0], inner[:, 1])
        k = int(d.argmax())
        if d[k] > epsilon:
            m = a + 1 + k
            keep[m] = True
            stack += [(a, m), (m, b)]
    return keep


def simplify_array(points: np.ndarray, most: int, least: int, epsilon: float) -> np.ndarray:
    """Points within a budget (ALG-06): epsilon grows by 1.6 up to six times, then the ends and every n-th point between,
    as many as fit; too few gives the first `least` of the input."""
    if len(points) <= most:
        return points
    out = points
    for _ in range(7):
        out = points[rdp(points, epsilon)]
        if len(out) <= most:
            break
        epsilon *= 1.6
    if len(out) > most:
        inner = points[1:-1 : max(1, (len(points) - 2) // (most - 2))] if most > 2 else points[:0]
        out = np.concatenate([points[:1], inner, points[-1:]])[:most]
    return points[:least] if len(out) < least else out


def simplify(curves: DataFrame, most: int, least: int = 2, epsilon: float = 1.0) -> DataFrame:
    """Each row's xy within the budget; Arrow batches, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [simplify_array(np.array([(p["x"], p["y"]) for p in c]).reshape(-1, 2), most, least, epsilon) for c in rows["xy"]]
            yield rows.assign(xy=[[{"x": float(a), "y": float(b)} for a, b in c] for c in done])

    return curves.mapInPandas(run, curves.schema)


def collinear(points: Column, tolerance: float) -> Column:
    """Points without those on the line from the last kept one to the next (WIN-15): a fold over the array."""
    p = lambda s, i: F.try_element_at(s, i)

    def step(acc: Column, i: Column) -> Column:
        a, b, c = p(acc, F.lit(-1)), p(points, i), p(points, i + 1)
        flat = F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) <= tolerance
        return F.when(c.isNotNull() & flat, acc).otherwise(F.array_append(acc, b))

    inner = F.when(F.size(points) > 1, F.sequence(F.lit(2), F.size(points))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(inner, F.slice(points, 1, 1), step)


def fit_bezier(points: np.ndarray, limit: float) -> list[np.ndarray]:
    """Cubic segments (4 x 2) within limit of the points (ALG-07): least squares on chord lengths with end
    tangents, improved by Newton steps where the fit is within four times the limit, and split at the worst point
    until it holds; two points are always within it."""
    unit = lambda v: v / n if (n := np.hypot(*v)) else np.array([1.0, 0.0])
    curve = lambda c, t: (1 - t)[:, None] ** 3 * c[0] + 3 * ((1 - t) ** 2 * t)[:, None] * c[1] + 3 * ((1 - t) * t**2)[:, None] * c[2] + t[:, None] ** 3 * c[3]

    def solve(p: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        b1, b2 = 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2
        base = ((1 - t) ** 3 + b1)[:, None] * p[0] + (b2 + t**3)[:, None] * p[-1]
        m = np.stack([(b1[:, None] * a).ravel(), (b2[:, None] * b).ravel()], axis=1)
        alpha, *_ = np.linalg.lstsq(m, (p - base).ravel(), rcond=None)
        third = np.hypot(*(p[-1] - p[0])) / 3
        alpha = np.where(alpha > 1e-6 * third, alpha, third)
        return np.stack([p[0], p[0] + alpha[0] * a, p[-1] + alpha[1] * b, p[-1]])

    out: list[np.ndarray] = []
    todo = [(points, unit(points[1] - points[0]), unit(points[-2] - points[-1]))] if len(points) > 1 else []
    while todo:  # not by recursion, so that long curves may be split as often as they need
        p, a, b = todo.pop()
        if len(p) == 2:
            third = np.hypot(*(p[1] - p[0])) / 3
            out.append(np.stack([p[0], p[0] + a * third, p[1] + b * third, p[1]]))
            continue
        step = np.hypot(*np.diff(p, axis=0).T)
        t = np.concatenate([[0], np.cumsum(step)])
        t = t / t[-1] if t[-1] else np.linspace(0, 1, len(p))
        for _ in range(5):
            c = solve(p, t, a, b)
            d = curve(c, t) - p
            e = (d**2).sum(axis=1)
            if e.max() <= limit**2 or e.max() > (4 * limit) ** 2:
                break
            d1 = 3 * ((1 - t)[:, None] ** 2 * (c[1] - c[0]) + 2 * ((1 - t) * t)[:, None] * (c[2] - c[1]) + t[:, None] ** 2 * (c[3] - c[2]))
            d2 = 6 * ((1 - t)[:, None] * (c[2] - 2 * c[1] + c[0]) + t[:, None] * (c[3] - 2 * c[2] + c[1]))
            low = (d1**2).sum(axis=1) + (d * d2).sum(axis=1)
            t = np.clip(t - np.where(np.abs(low) > 1e-12, (d * d1).sum(axis=1) / np.where(low == 0, 1, low), 0), 0, 1)
        if e.max() <= limit**2:
            out.append(c)
            continue
        k = int(np.clip(e.argmax(), 1, len(p) - 2))
        mid = unit(p[k - 1] - p[k + 1])
        todo += [(p[k:], -mid, b), (p[: k + 1], a, mid)]
    return out


def bezier_paths(curves: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """keys, segments, error and path of each curve (ALG-08, STR-26)."""
    schema = T.StructType([*curves.select(*keys).schema.fields, T.StructField("segments", T.IntegerType()), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fits = [fit_bezier(np.array([(p["x"], p["y"]) for p in c]).reshape(-1, 2), limit) for c in rows["xy"]]
            text = [" ".join([f"M {s[0][0][0]:.2f} {s[0][0][1]:.2f}", *["C " + " ".join(f"{x:.2f} {y:.2f}" for x, y in c[1:]) for c in s]]) if s else "" for s in fits]
            yield rows[keys].assign(segments=[len(s) for s in fits], path=text)

    return curves.mapInPandas(run, schema)
