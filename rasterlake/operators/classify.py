"""Template classification of figures: the image feature vector, additive rule scores, evidence and decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import sequence

#: Words that speak for two of the templates.
LOOP_WORDS = ("agent", "environment", "state", "action", "reward", "policy", "value", "qnetwork", "q-network", "critic", "actor", "buffer", "replay", "constraint", "lagrangian", "multiobjective", "morl")
GRID_WORDS = ("cdf", "latency", "throughput", "rmse", "packet", "handover", "rlf", "pingpong", "ping-pong", "uho", "energy", "efficiency", "kpi")
#: The rules of each template as (condition, weight) over the columns of image_features(), tokens (array of
#: lower-case words), n_tokens, loop_hits, grid_hits, short (all short segments) and aspect. Weights of rules that hold add up.
RULES: dict[str, tuple[tuple[str, float | str], ...]] = {
    "t_3gpp_events_3panel": (
        ("true", "least(long_v, 8) * 0.4D"), ("long_v >= 4", 1.0), ("saturated >= 0.02D", 0.2), ("long_v >= 4 and n_tokens >= 6", 0.6),
        ("not (long_v >= 4 and n_tokens >= 6) and n_tokens >= 12", 0.4), ("long_v >= 6 and long_h <= 1 and aligned >= 0.7D", 0.8),
        ("long_v >= 6 and long_h <= 1 and aligned >= 0.7D and n_tokens >= 12", 0.4), ("long_v >= 6 and long_h <= 1 and aligned >= 0.7D and short >= 8000", 0.6),
    ),
    "t_performance_lineplot": (
        ("long_v >= 1", 1.0), ("long_h >= 1", 1.0), ("saturated >= 0.02D", 0.4), ("short >= 8", 0.2), ("long_v >= 4", -0.6), ("saturated < 0.1D", -0.6), ("ink > 0.2D", -0.6),
        ("long_v >= 1 and long_h >= 1 and short <= 5000", 0.4), ("long_v >= 1 and long_h >= 1 and short >= 8000", -0.6),
    ),
    "t_procedure_flow": (
        ("aligned >= 0.7D", 0.7), ("saturated < 0.02D", 0.6), ("long_v = 0", 0.3), ("long_h <= 1", 0.2), ("long_h >= 2 and ink < 0.2D", -0.4), ("ink > 0.2D and colors <= 5", -0.6),
        ("long_h >= 2 and ink >= 0.3D", 0.4), ("long_h >= 3 and aligned >= 0.8D and saturated < 0.05D", 1.0), ("long_v = 0 and long_h = 0 and aligned >= 0.75D and colors > 10", 0.6),
    ),
    "t_project_architecture_v1": (
        ("true", "project"), ("long_v >= 6 and long_h <= 1 and aligned >= 0.7D", -0.8),
    ),
    "t_rl_agent_loop_v1": (
        ("loop_hits >= 2", 2.2), ("loop_hits = 1", 1.0), ("aligned >= 0.6D", 0.3), ("colors <= 80", 0.2), ("saturated >= 0.02D", 0.4), ("ink >= 0.08D", 1.0), ("ink >= 0.05D and ink < 0.08D", 0.6),
        ("long_h >= 2 and long_v = 0 and ink >= 0.08D", 1.2), ("long_v >= 1", -0.4), ("long_h < 1", -0.6), ("colors <= 5", -0.8),
    ),
    "t_performance_grid_v1": (
        ("long_v >= 1", 1.2), ("long_v >= 2", 0.3), ("long_v >= 1 and long_h >= 1", 0.4), ("aligned >= 0.6D", 0.2), ("grid_hits >= 1", 0.8), ("ink > 0.2D", -0.6), ("long_v >= 1 and short >= 8000", 1.2),
    ),
}
#: The score of an architecture figure, which counts only at the right shape and size.
PROJECT_SHAPE = "aspect >= 1.55D and aspect <= 2.05D and width >= 1200 and height >= 700"
PROJECT_RULES: tuple[tuple[str, float], ...] = (
    ("aspect >= 1.6D and aspect <= 2.0D", 1.0), ("width >= 1400 and height >= 800", 1.0), ("colors <= 30", 1.0), ("colors > 30 and colors <= 80", 0.8), ("colors > 80 and colors <= 200", 0.5),
    ("array_contains(tokens, 'project') and array_contains(tokens, 'architecture')", 1.6), ("array_contains(tokens, 'work') and (array_contains(tokens, 'packages') or array_contains(tokens, 'package'))", 1.2),
    ("contains(joined, 'wp1')", 0.4), ("contains(joined, 'wp2')", 0.4), ("contains(joined, 'wp3')", 0.4), ("contains(joined, 'wp4')", 0.4),
    ("array_contains(tokens, 'panel')", 0.2), ("array_contains(tokens, 'panela')", 0.2), ("array_contains(tokens, 'panelb')", 0.2), ("array_contains(tokens, 'panelc')", 0.2), ("n_tokens >= 30", 1.0),
)
#: Factors of the leading template's confidence, by (condition, factor).
EVIDENCE: dict[str, tuple[tuple[str, float], ...]] = {
    "t_performance_lineplot": (
        ("long_v < 1 or long_h < 1", 0.6), ("ink > 0.2D", 0.4), ("saturated < 0.2D", 0.6), ("long_v >= 1 and long_h >= 1 and saturated >= 0.2D and aligned >= 0.7D and short <= 7000", 1.1),
    ),
    "t_3gpp_events_3panel": (
        ("long_v < 4", 0.4), ("long_h > 1", 0.6), ("saturated > 0.4D", 0.6),
    ),
    "t_procedure_flow": (
        ("aligned < 0.7D", 0.6), ("aligned > 0.97D", 0.6), ("saturated > 0.35D", 0.4), ("ink > 0.2D and colors <= 5", 0.4), ("colors > 20 and ink < 0.1D and long_v = 0 and long_h = 0", 1.3),
        ("colors > 20 and ink >= 0.3D and long_h >= 3", 1.6), ("long_h >= 3 and ink >= 0.3D", 1.3), ("long_v = 0 and long_h = 0 and colors > 10 and aligned >= 0.75D", 1.2),
    ),
    "t_project_architecture_v1": (
        ("height <= 0 or width <= 0", 0.6), ("aspect < 1.5D or aspect > 2.1D", 0.6), ("colors > 220", 0.6),
    ),
    "t_rl_agent_loop_v1": (("n_tokens = 0 and aligned < 0.6D", 0.6),),
    "t_performance_grid_v1": (("long_v < 1 and long_h < 1", 0.6),),
}
FALLBACK = "t_auto_layout"


def long_lines(runs: DataFrame, line: str, least: Column, gap: int = 1, rounding: str = "half_even") -> DataFrame:
    """image and centre of the clusters of lines whose longest run reaches least (WIN-02, AGG-06)."""
    long = runs.groupBy("image", line).agg(F.max("len").alias("longest"), F.max(least).alias("least")).filter("longest >= least")
    return sequence.gap_clusters(long.select("image", line), ["image"], line, gap, rounding)


def image_features(pixels: DataFrame) -> DataFrame:
    """One row of features an image (AGG-01, AGG-04, AGG-05): width, height, ink, saturated, aligned, colors, long_v, long_h,
    short_v, short_h. pixels: image, y, x, r, g, b, a.

    Pixels are dealt by image once; every window and aggregation below keeps that partitioning. aligned is the share
    of ink edges (steps of grey to the right and downwards of over 0.08 together) whose one step is over twice the
    other. colors are those of ink cut to eighths, and white where the ink's box holds other pixels. A line is long
    at 45 % of the image, a segment short at 2 pixels to 8 %."""
    p = pixels.repartition("image").withColumn("ink", X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a")))
    size = Window.partitionBy("image")
    right, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    grey = (F.col("r") + F.col("g") + F.col("b")) / F.lit(3.0) / 255.0
    top = F.greatest("r", "g", "b") / F.lit(255.0)
    rich = F.col("ink") & ((top - F.least("r", "g", "b") / F.lit(255.0)) / (top + 1e-6) > 0.25) & (top > 0.2)
    d = p.withColumn("g0", grey).withColumn("dx", F.abs(F.lead("g0").over(right) - F.col("g0"))).withColumn("dy", F.abs(F.lead("g0").over(down) - F.col("g0")))
    edge = F.col("ink") & (F.col("dx") + F.col("dy") > 0.08)
    code = (F.floor(F.col("r") / 32) * 64 + F.floor(F.col("g") / 32) * 8 + F.floor(F.col("b") / 32)).cast("int")
    ys, xs = F.when(F.col("ink"), F.col("y")), F.when(F.col("ink"), F.col("x"))
    box = (F.max(ys) - F.min(ys) + 1) * (F.max(xs) - F.min(xs) + 1)
    base = d.groupBy("image").agg(
        (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.avg(F.col("ink").cast("int")).alias("ink"), F.count_if(rich).alias("n_rich"), F.count_if(F.col("ink")).alias("n_ink"),
        F.count_if(edge).alias("n_edge"), F.count_if(edge & ((F.col("dx") > F.col("dy") * 2) | (F.col("dy") > F.col("dx") * 2))).alias("n_aligned"), F.collect_set(F.when(F.col("ink"), code)).alias("codes"), box.alias("box"),
    )
    white = F.when(F.col("box") > F.col("n_ink"), F.array(F.lit(511))).otherwise(F.array().cast("array<int>"))
    base = base.select(
        "image", "width", "height", "ink", (F.col("n_rich") / F.greatest("n_ink", F.lit(1))).alias("saturated"), F.coalesce(F.try_divide("n_aligned", "n_edge"), F.lit(0.0)).alias("aligned"),
        F.when(F.col("n_ink") > 0, F.size(F.array_union("codes", white))).otherwise(0).cast("long").alias("colors"),
    )
    sized = p.select("image", "y", "x", "ink", (F.max("x").over(size) + 1).alias("width"), (F.max("y").over(size) + 1).alias("height"))
    out = base
    for name, line, along, extent in (("v", "x", "y", "height"), ("h", "y", "x", "width")):
        runs = sequence.run_length(sized, ["image", line, extent], [along], F.col("ink")).filter("value")
        long = long_lines(runs, line, F.greatest(F.floor(F.col(extent) * 0.45), F.lit(1))).groupBy("image").agg(F.count("*").alias(f"long_{name}"))
        short = runs.groupBy("image").agg(F.count_if((F.col("len") >= 2) & (F.col("len") <= F.greatest(F.floor(F.col(extent) * 0.08), F.lit(2)))).alias(f"short_{name}"))
        out = out.join(long, "image", "left").join(short, "image", "left")
    return out.fillna(0, ["long_v", "long_h", "short_v", "short_h"])


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits (STR-20)."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]", " "), " +"), lambda t: t != "")


def _sum(rules: tuple[tuple[str, float | str], ...]) -> Column:
    term = lambda w: F.expr(w) if isinstance(w, str) else F.lit(w)
    return reduce(lambda a, b: a + b, [F.when(F.expr(c), term(w)).otherwise(0.0) for c, w in rules], F.lit(0.0))


def template_scores(features: DataFrame) -> DataFrame:
    """Adds a score column for each template (CLS-01) and what its rules need: features with tokens (array of words)."""
    hits = lambda words: reduce(lambda a, b: a + b, [F.when(F.contains("joined", F.lit(w)), 1).otherwise(0) for w in words], F.lit(0))
    d = features.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("joined", F.array_join("tokens", " ")).withColumn("n_tokens", F.size("tokens"))
    d = d.withColumn("short", F.col("short_v") + F.col("short_h")).withColumn("aspect", F.coalesce(F.try_divide(F.col("width").cast("double"), F.col("height")), F.lit(0.0)))
    d = d.withColumn("loop_hits", hits(LOOP_WORDS)).withColumn("grid_hits", hits(GRID_WORDS))
    project = F.greatest(_sum(PROJECT_RULES) * F.when(F.col("ink") < 0.18, 0.5).otherwise(1.0), F.lit(0.0))
    d = d.withColumn("project", F.when(F.expr(PROJECT_SHAPE), project).otherwise(0.0))
    return d.withColumns({name: _sum(rules) for name, rules in RULES.items()})


def classify(features: DataFrame, keys: list[str], min_confidence: float = 0.52, min_margin: float = 0.05) -> DataFrame:
    """keys, top, score, confidence, margin, decision and reasons (CLS-01 to CLS-04): the template of the highest score
    (ties by name), its share of the scores shifted by the least positive one, times the evidence of CLS-03 for it.
    Low confidence or margin makes the decision FALLBACK. A row's scores stay in it, so nothing is shuffled."""
    d = template_scores(features)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("neg"), F.lit(t).alias("id")) for t in RULES]))
    d = d.withColumn("ranked", ranked).withColumn("top", F.get("ranked", F.lit(0))["id"])
    scores = F.transform("ranked", lambda s: -s["neg"])
    low = F.coalesce(F.array_min(F.filter(scores, lambda v: v > 0)), F.array_min(scores))
    # added in the order of RULES: another one changes the last digit, and with it confidences that lie on a bound
    total = reduce(lambda a, t: a + F.greatest(F.col(t) - F.col("low"), F.lit(0.0)), RULES, F.lit(0.0))
    d = d.withColumn("low", low).withColumn("total", total).withColumn("score", F.get(scores, F.lit(0))).withColumn("margin", F.get(scores, F.lit(0)) - F.get(scores, F.lit(1)))
    share = F.when(F.col("total") > 0, F.greatest(F.col("score") - F.col("low"), F.lit(0.0)) / F.col("total")).otherwise(1.0 / len(RULES))
    product = lambda rules: reduce(lambda a, b: a * b, [F.when(F.expr(c), f).otherwise(1.0) for c, f in rules], F.lit(1.0))
    scale = reduce(lambda a, t: a.when(F.col("top") == t[0], product(t[1])), list(EVIDENCE.items())[1:], F.when(F.col("top") == next(iter(EVIDENCE)), product(next(iter(EVIDENCE.values())))))
    d = d.withColumn("confidence", share * scale)
    weak, near = F.col("confidence") < min_confidence, F.col("margin") < min_margin
    codes = F.array_compact(F.array(F.when(weak, F.lit("LOW_CONFIDENCE")), F.when(near, F.lit("AMBIGUOUS_MARGIN")), F.when(weak | near, F.lit("FALLBACK_TO_AUTO"))))
    return d.select(*keys, "top", "score", "confidence", "margin", F.when(weak | near, FALLBACK).otherwise(F.col("top")).alias("decision"), F.array_join(codes, ",").alias("reasons"))


def expected_template(selected: Column, expected: Column) -> Column:
    """Whether the selected template is one of those expected; none expected allows any (JON-19)."""
    return (F.size(F.coalesce(expected, F.array().cast("array<string>"))) == 0) | F.coalesce(F.array_contains(expected, selected), F.lit(False))
