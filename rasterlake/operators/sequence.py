"""Operators on ordered sequences: runs, clusters, gaps, smoothing, folds.

Each takes partition columns (keys) and order columns, so that one shuffle on the keys serves the whole
operator. Windows that would gather an ungrouped series in one task are only used on aggregated series,
whose length is the number of positions (columns of an image, days), not of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_length(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Runs of equal values (WIN-01): keys, run (from 0), value, start and len in positions from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, value.alias("value")).withColumn("pos", F.row_number().over(w) - 1)
    d = d.withColumn("step", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first("value").alias("value"), F.min("pos").alias("start"), F.count("*").alias("len"))


def gap_clusters(df: DataFrame, keys: list[str], pos: str, gap: float, rounding: str = "half_even") -> DataFrame:
    """1-D clusters of distinct positions no further apart than gap (WIN-02): keys, cluster, first, last, n,
    centre. The centre is the mean, rounded half-even or truncated."""
    w = Window.partitionBy(*keys).orderBy(pos)
    d = df.select(*keys, pos).distinct().withColumn("new", F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("int"), F.lit(0)))
    d = d.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean = F.avg(pos)
    centre = F.bround(mean) if rounding == "half_even" else mean
    return d.groupBy(*keys, "cluster").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"), centre.cast("long").alias("centre"))


def tolerance_groups(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float) -> DataFrame:
    """Adds grp: a new group wherever the value is over tolerance from its neighbour's (WIN-09)."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    d = df.withColumn("__new", F.coalesce((F.abs(F.col(value) - F.lag(value).over(w)) > tolerance).cast("int"), F.lit(0)))
    return d.withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def snap_groups(df: DataFrame, keys: list[str], value: str, grid: float) -> DataFrame:
    """Writes each group's mean, snapped to grid, back to its members (WIN-10, NRM-03)."""
    w = Window.partitionBy(*keys, "grp")
    return df.withColumn("snapped", F.bround(F.avg(value).over(w) / grid) * grid)


def split_on_gap(df: DataFrame, keys: list[str], order: list[str], start: str, width: str, gap: Column) -> DataFrame:
    """Adds part: a new part where the space since the previous item's end is over gap (WIN-08)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__new", F.coalesce((F.col(start) - F.lag(F.col(start) + F.col(width)).over(w) > gap).cast("int"), F.lit(0)))
    return d.withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def moving_average(series: DataFrame, keys: list[str], pos: str, value: str, window: int) -> DataFrame:
    """Centred mean over an odd window, edges padded with the end values (WIN-03)."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    k = window // 2
    w = Window.partitionBy(*keys).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = series.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole)).withColumn("__a", F.first(value).over(whole)).withColumn("__b", F.last(value).over(whole))
    before = F.greatest(F.lit(0), k - F.col("__i") + 1)
    after = F.greatest(F.lit(0), k - F.col("__n") + F.col("__i"))
    inside = F.sum(value).over(w.rowsBetween(-k, k))
    return d.withColumn("smooth", (inside + before * F.col("__a") + after * F.col("__b")) / window).drop("__i", "__n", "__a", "__b")


def separators(series: DataFrame, keys: list[str], pos: str, value: str, min_gap: int, extra: int = 2) -> DataFrame:
    """Stretches of at least min_gap positions whose value is at most int(10th percentile) + extra (WIN-06):
    keys, start, end (one past the last)."""
    limit = series.groupBy(*keys).agg((F.expr(f"percentile({value}, 0.1)").cast("int") + extra).alias("__t"))
    d = series.join(limit, keys) if keys else series.crossJoin(F.broadcast(limit))
    w = Window.partitionBy(*keys).orderBy(pos)
    d = d.withColumn("__low", F.col(value) <= F.col("__t")).withColumn("__i", F.row_number().over(w) - 1)
    d = d.filter("__low").withColumn("__g", F.col("__i") - F.row_number().over(w))
    return d.groupBy(*keys, "__g").agg(F.min("__i").alias("start"), (F.max("__i") + 1).alias("end"), F.count("*").alias("__c")).filter(F.col("__c") >= min_gap).select(*keys, "start", "end")


def snap_flat(values: Column, tolerance: float) -> Column:
    """Carries the last kept value while the next is within tolerance of it (WIN-04): a fold over an array."""
    start = F.array().cast("array<double>")
    keep = lambda acc, v: F.when((F.size(acc) > 0) & (F.abs(v - F.try_element_at(acc, F.lit(-1))) <= tolerance), F.try_element_at(acc, F.lit(-1))).otherwise(v)
    return F.aggregate(values, start, lambda acc, v: F.array_append(acc, keep(acc, v)))


def moving_centre_groups(values: Column, tolerance: float) -> Column:
    """Group number of each of sorted values: a group's centre becomes the mean of itself and the newcomer (WIN-07)."""
    start = F.struct(F.array().cast("array<int>").alias("g"), F.lit(-1).alias("n"), F.lit(None).cast("double").alias("c"))

    def step(acc: Column, v: Column) -> Column:
        new = acc["c"].isNull() | (F.abs(v - acc["c"]) > tolerance)
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.array_append(acc["g"], n).alias("g"), n.alias("n"), F.when(new, v).otherwise((acc["c"] + v) / 2).alias("c"))

    return F.aggregate(values, start, step, lambda acc: acc["g"])


def drop_repeats(tokens: Column) -> Column:
    """Consecutive tokens that are equal but for case are kept once (WIN-13)."""
    return F.filter(tokens, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.try_element_at(tokens, i))))


def argmin_near(series: DataFrame, keys: list[str], pos: str, value: str, low: Column, high: Column) -> DataFrame:
    """Position of the least value between low and high; ties to the smaller position (WIN-05)."""
    return series.filter(F.col(pos).between(low, high)).groupBy(*keys).agg(F.min_by(pos, F.struct(value, pos)).alias("at"), F.min(value).alias("least"))


def interpolate(series: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Every integer position from the first to the last, missing values on the line between neighbours (WIN-16). Neighbours are found among the
    given positions, in either order of them, and each spans the positions up to the next; a null key has no values."""
    here = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    d = series.filter(F.col(pos).isNotNull()).select(*keys, pos, F.when(here, F.col(value)).alias("__v"))
    on, back = (Window.partitionBy(*keys).orderBy(order(pos)) for order in (F.asc, F.desc))
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col(pos).alias("x"), F.col("__v").alias("y")))
    d = d.withColumn("__b", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__next", F.lead(pos).over(on)).withColumn("__a", F.last(known, True).over(on.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__at", F.explode(F.sequence(F.col(pos), F.greatest(F.col(pos), F.col("__next") - 1))))
    own = F.when(F.col("__at") == F.col(pos), F.col("__v"))
    a, b = F.col("__a"), F.col("__b")
    made = a["y"] + (b["y"] - a["y"]) * (F.col("__at") - a["x"]) / (b["x"] - a["x"])
    return d.select(*keys, F.col("__at").alias(pos), F.coalesce(own, made).alias(value), own.isNull().alias("made"))


def mean_in_order(series: DataFrame, keys: list[str], pos: str, value: str, *more: Column) -> DataFrame:
    """Mean of each key's values that aren't null, added one by one from the least pos on: a sum of doubles hangs on their order in its last bits,
    which decide where a mean lies half-way between two roundings. more: other aggregates of the series, before the mean."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = series.withColumn("__sum", F.sum(value).over(w))
    return d.groupBy(*keys).agg(*more, F.try_divide(F.max_by("__sum", pos), F.count(value)).alias("mean"))


def dash_stats(runs: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Mean, population deviation and variation of the lengths of true runs and of the positive gaps between
    them (AGG-18), over runs (keys, start, len) of one value. more: other aggregates of the runs."""
    w = Window.partitionBy(*keys).orderBy("start")
    d = runs.withColumn("gap", F.lead("start").over(w) - F.col("start") - F.col("len"))
    g = F.when(F.col("gap") > 0, F.col("gap"))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("len").alias("dash"), F.stddev_pop("len").alias("dash_sd"), F.countDistinct("len").alias("lengths"), F.avg(g).alias("gap"), F.stddev_pop(g).alias("gap_sd"), F.count(g).alias("gaps"), *more)


def standard(value: Column) -> Column:
    """A dash or gap length as drawings use it: half-even to 2 below 10, to 5 from there on (ALG-13)."""
    return F.when(value < 10, F.bround(value / 2) * 2).otherwise(F.bround(value / 5) * 5)


def dash_array(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern, confidence, dasharray of true runs (ALG-13): a dotted line's dash is 2, a uniform one's its mean; an alternating line of
    four dashes or more has the means of its shorter and longer half in turn. 4, 4 without a gap or below three dashes. A line's runs are few."""
    d = dash_class(dash_stats(runs, keys, F.sort_array(F.collect_list(F.col("len").cast("double"))).alias("lens")))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    half = (F.size("lens") / 2).cast("int")
    dash, gap = F.greatest(F.lit(2.0), standard(F.col("dash"))), F.greatest(F.lit(2.0), standard(F.col("gap")))
    two = F.array(standard(mean(F.slice("lens", 1, half))), gap, standard(mean(F.slice("lens", half + 1, F.size("lens")))), gap)
    array = F.when((F.col("n") < 3) | (F.col("gaps") == 0), F.array(F.lit(4.0), F.lit(4.0))).when(F.col("pattern") == "dotted", F.array(F.lit(2.0), gap)).when((F.col("pattern") == "alternating") & (F.col("n") >= 4), two).otherwise(F.array(dash, gap))
    return d.select(*keys, "pattern", "confidence", array.alias("dasharray"))


def dash_class(stats: DataFrame) -> DataFrame:
    """Dash pattern of dash_stats (ALG-13): pattern and confidence. 3 dashes, 4 pixels, 1.5, 0.3, 3 lengths, 0.6, 0.4 and 10."""
    cv = lambda sd, mean: F.when(F.col(mean) > 0, F.col(sd) / F.col(mean)).otherwise(F.lit(0.0))
    a, b = cv("dash_sd", "dash"), cv("gap_sd", "gap")
    none = (F.col("n") < 3) | (F.col("gaps") == 0)
    kind = F.when(none, "unknown").when((F.col("dash") < 4) & (F.col("gap") > 1.5 * F.col("dash")), "dotted").when((a < 0.3) & (b < 0.3), "uniform").when(F.col("lengths") <= 3, "alternating").otherwise("unknown")
    sure = 0.6 * (1 - F.least(F.lit(1.0), (a + b) / 2)) + 0.4 * F.least(F.lit(1.0), F.col("n") / 10)
    return stats.withColumn("pattern", kind).withColumn("confidence", F.when(none, F.lit(0.0)).otherwise(sure))
