"""Drawn figures: one 640 x 360 raster a region, by a formula that Spark and SQL share, and queries over them.

Each figure has three panels with axes, two curves, dashed lines, a tinted band, a marker and an arrow head, and lettering on top.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.plans.common import table
from rasterlake.sources import store

WIDTH, HEIGHT = 640, 360
#: Place in a panel, and where the panel begins.
_PX, _PANEL = "x % 213", "(x - x % 213)"
#: What a pixel shows, the first that holds.
_SHOWS = f"""CASE
WHEN y BETWEEN 12 AND 23 AND x BETWEEN 150 AND 480 AND (x + image * 7) % 12 < 8 THEN 1
WHEN {_PX} BETWEEN 20 AND 21 AND y BETWEEN 60 AND 300 THEN 2
WHEN y BETWEEN 300 AND 301 AND {_PX} BETWEEN 20 AND 190 THEN 2
WHEN {_PX} BETWEEN 186 AND 199 AND abs(y - 300) * 2 <= 199 - {_PX} THEN 2
WHEN {_PX} = 80 + image AND y BETWEEN 70 AND 295 AND y % 24 < 8 THEN 3
WHEN y = 150 + 5 * image AND {_PX} BETWEEN 25 AND 190 AND {_PX} % 24 < 8 THEN 4
WHEN {_PANEL} = 213 AND {_PX} BETWEEN 100 AND 107 AND y BETWEEN 180 AND 187 THEN 5
WHEN {_PX} BETWEEN 30 AND 180 AND abs(4 * (y - 100 - image * 2) - 3 * ({_PX})) <= 6 THEN 6
WHEN {_PX} BETWEEN 30 AND 180 AND abs(2 * (y - 250 + image) + {_PX}) <= 3 THEN 7
WHEN {_PX} BETWEEN 90 AND 139 AND y BETWEEN 62 AND 298 THEN 8
ELSE 0 END"""
#: Colours of what is shown: paper, lettering, axes, two kinds of dashes, marker, two curves, band.
COLORS = ((255, 255, 255), (32, 32, 32), (0, 0, 0), (85, 85, 85), (136, 136, 136), (200, 40, 40), (43, 108, 176), (221, 107, 32), (217, 211, 232))


def _channel(k: int) -> str:
    return "CASE c " + " ".join(f"WHEN {i} THEN {rgb[k]}" for i, rgb in enumerate(COLORS)) + " END"


_CHANNELS = ", ".join(f"{_channel(k)} AS {name}" for k, name in enumerate("rgb"))
#: The pixels as SQL, for a WITH clause: table f of image, y, x, r, g, b, a.
SQL_PIXELS = f"""f0 AS (SELECT CAST(r_regionkey AS BIGINT) AS image, y, x FROM region, range({HEIGHT}) t(y), range({WIDTH}) u(x)),
f AS (SELECT image, y, x, {_CHANNELS}, CASE WHEN y < 2 THEN 0 ELSE 255 END AS a FROM (SELECT *, {_SHOWS} AS c FROM f0))"""


_DRAWN: dict[tuple[str, str], object] = {}


def figure_pixels(spark, sf):
    """image, y, x, r, g, b, a of the drawn figures: a table that is written once an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _DRAWN:
        _DRAWN[key] = store.saved(_draw(spark, sf), "drawn")
    return _DRAWN[key]


def _draw(spark, sf):
    d = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    d = d.select("image", F.col("y").cast("long").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))).alias("x")).withColumn("c", F.expr(_SHOWS))
    channel = lambda k: F.get(F.array(*[F.lit(rgb[k]) for rgb in COLORS]), F.col("c"))
    return d.select("image", "y", "x", *[channel(k).alias(name) for k, name in enumerate("rgb")], F.when(F.col("y") < 2, 0).otherwise(255).alias("a"))


def figure_lines(spark, sf):
    """The drawn figures as packed lines: a table that is written once an application."""
    key = spark.sparkContext.applicationId, sf, "lines"
    if key not in _DRAWN:
        _DRAWN[key] = store.saved(_draw_lines(spark, sf), "lines")
    return _DRAWN[key]


def _draw_lines(spark, sf):
    d = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    colors = F.expr("array(" + ", ".join(f"'{r:02X}{g:02X}{b:02X}'" for r, g, b in COLORS) + ")")
    d = d.withColumn("colors", colors).withColumn("alpha", F.when(F.col("y") < 2, "00").otherwise("FF"))
    shown = F.expr(f"unhex(array_join(transform(sequence(0L, {WIDTH - 1}L), x -> concat(get(colors, {_SHOWS}), alpha)), ''))")
    return d.select("image", "y", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), shown.alias("rgba"))
