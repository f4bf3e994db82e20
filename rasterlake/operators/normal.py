"""Normal forms (NRM-01 to NRM-04): texts laid out by role, blocks on common baselines, series and flows on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import figures as G
from rasterlake.operators import render, sequence, spatial
from rasterlake.operators.curves import simplify_array

#: Font size (of a figure 360 pixels high), weight and anchor by role; other roles are laid out as annotations.
ROLE_STYLES = {
    "title": (16.0, "bold", "middle"), "panel_label": (12.0, "bold", "start"), "axis_label": (10.0, "normal", "middle"), "axis_label_x": (10.0, "normal", "middle"), "axis_label_y": (10.0, "normal", "middle"),
    "legend": (9.0, "normal", "start"), "node_label": (11.0, "normal", "start"), "curve_label_serving": (9.0, "normal", "start"), "curve_label_neighbor": (9.0, "normal", "start"), "annotation": (7.0, "normal", "start"),
}
#: The grid, how far apart neighbours on one line may stand, and the height and range of the font's scale.
GRID, TOLERANCE, REFERENCE, SCALES = 5.0, 2.0, 360.0, (0.8, 3.0)


def _styles() -> Column:
    one = lambda s: F.struct(F.lit(s[0]).alias("size"), F.lit(s[1]).alias("weight"), F.lit(s[2]).alias("anchor"))
    return F.create_map(*[v for role, s in ROLE_STYLES.items() for v in (F.lit(role), one(s))])


def text_layout(items: DataFrame, sizes: DataFrame, grid: float = GRID, tolerance: float = TOLERANCE) -> DataFrame:
    """Texts laid out by role (NRM-03): font_size, font_weight and anchor are those of the role unless given, sizes scaled by the figure's
    height; texts of one line (y no further than tolerance from the next) get its mean y, snapped; x is snapped, and the box
    stands on the line, before, around or behind x by the anchor.

    items: image, item, role, x, y (a title without x stands in the middle, other texts at 0), box_x, box_y, box_width, box_height
    (null: no box), and font_size, font_weight, anchor where given; other columns pass through. sizes: image, width, height.
    Texts without y go. Adds baseline_group."""
    for name, kind in (("font_size", "double"), ("font_weight", "string"), ("anchor", "string")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    d = items.join(sizes.select("image", F.col("width").alias("__w"), F.col("height").alias("__h")), "image").filter("y IS NOT NULL")
    style = F.coalesce(F.try_element_at(_styles(), F.coalesce("role", F.lit("annotation"))), F.try_element_at(_styles(), F.lit("annotation")))
    scale = F.greatest(F.lit(SCALES[0]), F.least(F.lit(SCALES[1]), F.col("__h") / REFERENCE))
    d = d.withColumn("__s", style).withColumns({"font_size": F.coalesce("font_size", F.col("__s.size") * scale), "font_weight": F.coalesce("font_weight", "__s.weight"), "anchor": F.lower(F.coalesce("anchor", "__s.anchor"))})
    d = d.withColumn("x", F.coalesce(F.col("x"), F.when(F.col("role") == "title", F.col("__w") / 2).otherwise(0.0)).cast("double"))
    d = sequence.snap_groups(sequence.tolerance_groups(d, ["image"], ["item"], "y", tolerance), ["image"], "y", grid)
    d = d.withColumn("y", F.col("snapped")).withColumn("x", G.snapped(F.col("x"), grid)).withColumnRenamed("grp", "baseline_group")
    left = F.when(F.col("anchor") == "middle", F.col("x") - F.col("box_width") / 2).when(F.col("anchor") == "end", F.col("x") - F.col("box_width")).otherwise(F.col("x"))
    return d.withColumns({"box_x": F.when(F.col("box_width").isNotNull(), G.snapped(left, grid)), "box_y": G.snapped(F.col("y") - F.col("box_height"), grid)}).drop("__w", "__h", "__s", "snapped")


def block_baselines(blocks: DataFrame, grid: float, tolerance: float = 4.0) -> DataFrame:
    """Blocks (image, block, y, height and others) moved to common baselines (NRM-04): lower edges no further than tolerance from the next
    are one cluster; each block's lower edge goes to the nearest cluster's mean, snapped (of two equally near ones the upper). Blocks
    without y or height stay as they are."""
    whole, none = blocks.filter("y IS NOT NULL AND height IS NOT NULL"), blocks.filter("y IS NULL OR height IS NULL")
    d = whole.withColumn("__base", (F.col("y") + F.col("height")).cast("double"))
    centres = sequence.tolerance_groups(d, ["image"], ["block"], "__base", tolerance).groupBy("image", "grp").agg(F.avg("__base").alias("at")).drop("grp")
    moved = spatial.nearest(d, ["image"], "__base", centres, "at")
    return moved.withColumn("y", G.snapped(F.col("centre"), grid) - F.col("height")).select(*blocks.columns).unionByName(none)


def snapped_box(names: tuple[str, str, str, str], grid: float, least: float = 1.0) -> dict[str, Column]:
    """Columns of a box on the grid, its sides no shorter than least."""
    x, y, w, h = names
    side = lambda c: F.greatest(G.snapped(F.col(c).cast("double"), grid), F.lit(least))
    return {x: G.snapped(F.col(x).cast("double"), grid), y: G.snapped(F.col(y).cast("double"), grid), w: side(w), h: side(h)}


def simplified(curves: DataFrame, points: str, most: int, least: int, share: float, digits: int) -> DataFrame:
    """Curves whose points (array of struct x, y) are within the budget, at a tolerance of share of their larger extent (1 at least), and
    rounded half-even. Points without a coordinate go first. Arrow batches, no shuffle."""
    good = curves.withColumn(points, F.transform(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for c in rows[points]:
                if c is None:
                    done.append(None)
                    continue
                v = np.array([(p["x"], p["y"]) for p in c], float).reshape(-1, 2)
                if len(v):
                    v = simplify_array(v, most, least, max(float(np.ptp(v, axis=0).max()), 1.0) * share)
                done.append([{"x": float(x), "y": float(y)} for x, y in v])
            yield rows.assign(**{points: done})

    round_ = lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y"))
    return good.mapInPandas(run, good.schema).withColumn(points, F.transform(points, round_))


def normal_curves(curves: DataFrame) -> DataFrame:
    """Curves of a figure of panels (NRM-01): three or four points, kept in 0 to 1, three digits."""
    d = simplified(curves, "points", 4, 3, 0.02, 12)
    unit = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 3)
    return d.withColumn("points", F.transform("points", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))))


def normal_series(series: DataFrame) -> DataFrame:
    """Series of line plots (NRM-01): ten points at most, four digits, dashed ones with the default pattern of their width. series: dashed,
    dasharray, stroke_width, points and others."""
    return simplified(series, "points", 10, 2, 0.01, 4).withColumn("dasharray", G.default_dashes("dashed", "dasharray", "stroke_width", 2.0))


def _not_in_line(points: Column, tolerance: float) -> Column:
    """Points without those between two steps that are both level or both upright, from the last point kept on."""

    def step(kept: Column, i: Column) -> Column:
        a, b, c = F.element_at(kept, -1), F.get(points, i), F.get(points, i + 1)
        flat = lambda k: (F.abs(b[k] - a[k]) <= tolerance) & (F.abs(c[k] - b[k]) <= tolerance)
        return F.when(flat("x") | flat("y"), kept).otherwise(F.array_append(kept, b))

    inner = F.aggregate(F.sequence(F.lit(1), F.size(points) - 2), F.slice(points, 1, 1), step)
    return F.when(F.size(points) > 2, F.array_append(inner, F.element_at(points, -1))).otherwise(points)


def normal_flow(nodes: DataFrame, edges: DataFrame, key: str, grid: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of flow charts on the grid (NRM-01): boxes are snapped; an edge's points are snapped, points between two level or two
    upright steps go, and the ends become the middles of the nodes that they name, snapped; dashed edges get a pattern. Edges of under
    two points keep what they have. nodes: key, id, x, y, width, height; edges: key, a, b, points, dashed, dasharray, stroke_width."""
    n = nodes.withColumns(snapped_box(("x", "y", "width", "height"), grid))
    middle = lambda c, size: G.snapped(F.col(c) + F.col(size) / 2, grid).alias(c)
    at = n.select(key, "id", F.struct(middle("x", "width"), middle("y", "height")).alias("at"))
    e = edges.withColumn("dasharray", G.default_dashes("dashed", "dasharray", "stroke_width", 2.0))
    # the nodes of a chart meet its edges by the chart alone, so one shuffle on it serves both ends
    e = e.join(render.many(at.groupBy(key).agg(F.collect_list(F.struct("id", "at")).alias("__nodes"))), key, "left")
    of = lambda end: F.explode_outer(F.filter("__nodes", lambda n: n["id"] == F.col(end)))
    e = e.withColumn("__a", of("a")).withColumn("__b", of("b")).withColumns({"__a": F.col("__a.at"), "__b": F.col("__b.at")})
    whole = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    on = F.transform(whole, lambda p: F.struct(G.snapped(p["x"].cast("double"), grid).alias("x"), G.snapped(p["y"].cast("double"), grid).alias("y")))
    kept = _not_in_line(on, grid * 0.4)
    inner = F.slice(kept, 2, F.size(kept) - 2)
    ended = F.concat(F.array(F.coalesce("__a", F.get(kept, F.lit(0)))), inner, F.array(F.coalesce("__b", F.element_at(kept, -1))))
    rounded = F.transform(ended, lambda p: F.struct(F.bround(p["x"], 3).alias("x"), F.bround(p["y"], 3).alias("y")))
    few = F.coalesce(F.size(whole), F.lit(0)) < 2
    return n, e.withColumn("points", F.when(few, F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).otherwise(rounded)).select(*edges.columns)
