"""Additive rule scores, ranking, confidence, decisions and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_scores(df: DataFrame, keys: list[str], rules: dict[str, list[tuple[Column, float]]]) -> DataFrame:
    """Long scores (CLS-01): one row a key and class, the sum of the weights of the rules that hold."""
    pair = lambda name, terms: F.struct(F.lit(name).alias("class_id"), sum((F.when(c, w).otherwise(0.0) for c, w in terms), F.lit(0.0)).alias("score"))
    return df.select(*keys, F.explode(F.array(*[pair(n, t) for n, t in rules.items()])).alias("s")).select(*keys, "s.*")


def decide(df: DataFrame, keys: list[str], rules: dict[str, list[tuple[Column, float]]], evidence: Column | None = None, min_confidence: float = 0.52, min_margin: float = 0.05) -> DataFrame:
    """The decision of each row (CLS-02, CLS-04, SRT-01): classes ranked by score, ties by name; confidence is the
    top's share after a shift by the least positive score (uniform if nothing is left), times evidence; margin is top less
    second. Low confidence or margin gives decision 'unknown' with reason codes.

    All classes of a row stay in one array, so there is no shuffle."""
    pair = lambda name, terms: F.struct((-sum((F.when(c, w).otherwise(0.0) for c, w in terms), F.lit(0.0))).alias("neg"), F.lit(name).alias("class_id"))
    d = df.select(*keys, (evidence if evidence is not None else F.lit(1.0)).alias("evidence"), F.array_sort(F.array(*[pair(n, t) for n, t in rules.items()])).alias("ranked"))
    scores = F.transform("ranked", lambda s: -s["neg"])
    low = F.coalesce(F.array_min(F.filter(scores, lambda v: v > 0)), F.lit(0.0))
    shifted = F.transform(scores, lambda v: F.greatest(v - low, F.lit(0.0)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    share = F.when(total > 0, F.element_at(shifted, 1) / total).otherwise(F.lit(1.0 / len(rules)))
    d = d.select(*keys, F.element_at("ranked", 1)["class_id"].alias("top"), F.element_at(scores, 1).alias("score"), F.bround(share * F.col("evidence"), 6).alias("confidence"), F.bround(F.element_at(scores, 1) - F.element_at(scores, 2), 6).alias("margin"))
    weak, near = F.col("confidence") < min_confidence, F.col("margin") < min_margin
    codes = F.array_compact(F.array(F.when(weak, F.lit("LOW_CONFIDENCE")), F.when(near, F.lit("AMBIGUOUS_MARGIN")), F.when(weak | near, F.lit("FALLBACK_TO_AUTO"))))
    return d.withColumn("decision", F.when(weak | near, "unknown").otherwise(F.col("top"))).withColumn("reasons", F.array_join(codes, ","))


def best_candidate(df: DataFrame, keys: list[str], order: list[Column], row: list[str]) -> DataFrame:
    """The row of least composite key (SRT-03); missing metrics count as infinite. Aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*row), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select(*keys, "r.*")


def or_infinite(x: str) -> Column:
    return F.coalesce(F.col(x).cast("double"), F.lit(float("inf")))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (SRT-02, SRT-04, SRT-07), with rank; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """Counts of exploded tags; an empty or null array counts as UNKNOWN (AGG-27, AGG-29)."""
    full = F.when(F.size(F.coalesce(F.col(tags), F.array())) > 0, F.col(tags)).otherwise(F.array(F.lit("UNKNOWN")))
    return df.select(F.explode(full).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def failure_reasons(codes: DataFrame, key: str, code: str, rules: list[tuple[list[str], str]]) -> DataFrame:
    """Reasons by the set of codes of a key, sorted; UNKNOWN where no rule holds (AGG-30). rules: codes, reason."""
    d = codes.groupBy(key).agg(F.collect_set(code).alias("codes"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.arrays_overlap("codes", F.array(*map(F.lit, c))), F.lit(r)) for c, r in rules]))))
    return d.select(key, F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("UNKNOWN").alias("reasons"))


def precedence(*layers: Column) -> Column:
    """Thresholds of several layers: the later wins where it has a value (JON-17)."""
    return F.coalesce(*reversed(layers))


def gate(rmse: Column, bad: Column, max_rmse: Column | float, max_bad: Column | float) -> Column:
    """Status of a quality gate with its reason (GAT-03, FLT-14)."""
    return F.when(rmse.isNull() | bad.isNull(), "skipped").when((rmse > max_rmse) & (bad > max_bad), "fail:rmse,bad").when(rmse > max_rmse, "fail:rmse").when(bad > max_bad, "fail:bad").otherwise("pass")
