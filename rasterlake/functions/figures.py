"""Parameters and values of figures: adaptive sizes, degradations, seeded draws, and normal form."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X

#: The defaults that adaptive() scales.
BASE_EDGE, SCALES, BLOCK, BLOCKS = 800, (0.6, 1.8), 31, (15, 61)
LONG_LINE, DASHES, AREAS, LEAST_SIZE = 0.5, (0.03, 0.12), (0.00005, 0.02), 3


def bright(color: Column, least: int = 245) -> Column:
    """Whether a colour's BT.601 luminance reaches least; what is no colour counts as bright (PRJ-09)."""
    return F.coalesce(X.weighted(*[X.from_hex(color, k) for k in range(3)], X.BT601) >= least, F.lit(True))


def adaptive(width: Column, height: Column) -> Column:
    """struct of parameters by an image's size (PRJ-19): scale, block_size (odd), long_line, dash_min, dash_max, min_area, max_area,
    min_size, all but the first whole pixels."""
    whole = lambda v: F.bround(v).cast("int")
    scale = F.greatest(F.lit(SCALES[0]), F.least(F.lit(SCALES[1]), F.greatest(width, height) / float(BASE_EDGE)))
    odd = lambda v: v + F.when(v % 2 == 0, 1).otherwise(0)
    block = odd(F.least(F.lit(BLOCKS[1]), F.greatest(F.lit(BLOCKS[0]), odd(F.greatest(whole(scale * BLOCK), F.lit(3))))))
    low = F.greatest(whole(height * F.lit(DASHES[0]) * scale), F.lit(2))
    area = width.cast("double") * height
    least = F.greatest(whole(area * AREAS[0] * scale), F.lit(8))
    return F.struct(
        scale.alias("scale"), block.alias("block_size"), F.greatest(whole(height * F.lit(LONG_LINE) * scale), F.lit(1)).alias("long_line"), low.alias("dash_min"), F.greatest(whole(height * F.lit(DASHES[1]) * scale), low + 1).alias("dash_max"),
        least.alias("min_area"), F.greatest(whole(area * AREAS[1] * scale), least + 1).alias("max_area"), F.greatest(whole(scale * LEAST_SIZE), F.lit(2)).alias("min_size"),
    )


def gamma_contrast(value: Column, gamma: Column, contrast: Column) -> Column:
    """A channel (0 to 255) under gamma, then contrast around the middle, cut (PRJ-12)."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / 255.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.pow(v, F.greatest(gamma, F.lit(0.001))) - 0.5) * contrast + 0.5))
    return F.floor(u * 255 + 1e-9).cast("int")


def seeded_draws(df: DataFrame, name: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds seed (decimal(20,0)) and a uniform draw for each range, in order, by a generator seeded with the first eight bytes of the
    SHA-256 of the name (PRJ-13): the same on every run and executor. Reversed bounds are swapped; a null name is ''."""
    bounds = [(min(r), max(r)) for r in ranges.values()]
    kind = ", ".join(f"{k} double" for k in ranges)

    @F.pandas_udf(f"seed decimal(20,0), {kind}")
    def draw(names: pd.Series) -> pd.DataFrame:
        seeds = [int.from_bytes(hashlib.sha256((x or "").encode()).digest()[:8], "big") for x in names]
        values = [[rng.uniform(a, b) for a, b in bounds] for rng in map(np.random.default_rng, seeds)]
        from decimal import Decimal

        return pd.DataFrame({"seed": list(map(Decimal, seeds)), **{k: [v[i] for v in values] for i, k in enumerate(ranges)}})

    return df.withColumn("__draw", draw(F.col(name))).select(*df.columns, "__draw.*")


def noisy(pixels: DataFrame, seed: str, sigma: float, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Channels with normal noise of sigma, kept in 0 to 255 and cut (PRJ-12). The noise of a pixel follows from seed (a column), y and
    x, so it doesn't depend on how pixels are dealt out. pixels: y, x and channels."""
    if sigma <= 0:
        return pixels
    unit = lambda salt: (F.pmod(F.xxhash64(seed, "y", "x", F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda c: F.sqrt(-2 * F.ln(unit(c))) * F.cos(2 * np.pi * unit(c + "'"))
    return pixels.withColumns({c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) + normal(c) * sigma))).cast("int") for c in channels})


def snapped(value: Column, grid: float) -> Column:
    """Half-even to a grid; a grid of 0 leaves the value (PRJ-14)."""
    return F.bround(value / grid) * grid if grid > 0 else value


def default_dashes(dashed: str, dasharray: str, stroke_width: str, width: float) -> Column:
    """A dashed line's pattern, by its stroke width where it has none (NRM-02): three widths of dash, four pixels at least, and two of gap,
    three at least. width stands for a missing stroke width."""
    w = F.coalesce(F.col(stroke_width).cast("double"), F.lit(width))
    lacks = F.col(dashed) & (F.col(dasharray).isNull() | (F.size(dasharray) == 0))
    return F.when(lacks, F.array(F.greatest(F.lit(4.0), w * 3), F.greatest(F.lit(3.0), w * 2))).otherwise(F.col(dasharray))


def normal_panels(panels: DataFrame, grid: float, width: Column, height: Column) -> DataFrame:
    """x, y, width, height snapped to the grid, the place kept on a canvas of width by height (NRM-01)."""
    d = panels.withColumns({c: snapped(F.col(c).cast("double"), grid) for c in ("x", "y", "width", "height")})
    inside = lambda c, size, whole: F.greatest(F.lit(0.0), F.least(F.greatest(whole - F.col(size), F.lit(0.0)), F.col(c)))
    return d.withColumns({"x": inside("x", "width", width), "y": inside("y", "height", height)})


def normal_ratio(ratio: Column, digits: int = 3) -> Column:
    """A ratio from 0 to 1, rounded (NRM-01)."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), digits)
