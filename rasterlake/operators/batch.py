"""Case manifests, candidate selection and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators import scoring

CASES = "id string, dir string, tags array<string>, force_template string, gates struct<rmse_max:double,bad_pixel_ratio_max:double,pixel_tolerance:int,quality_gate:boolean>"
#: Which codes stand for which reason of failure.
REASONS = [(["E5107", "E1300"], "CLASSIFY_UNKNOWN"), (["E3002", "E3003"], "VISUAL_DIFF"), (["E2003"], "MISSING_GROUP"), (["E2014", "E2017"], "TEXT_MISSING"), (["E2005", "E2006"], "STYLE"), (["E1200"], "TIMEOUT"), (["E1000"], "UNREADABLE")]


def cases(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Typed rows of a manifest's entries (SRC-05, ORC-06), in order; the id defaults to the folder's last name.
    A manifest is a bounded driver-side list."""
    if not isinstance(entries, list):
        raise ValueError("a manifest needs a list of cases")
    rows = []
    for e in entries:
        e = {"dir": e} if isinstance(e, str) else e
        g = e.get("gates") or {}
        rows.append((e.get("id"), e.get("dir"), list(e.get("tags") or []), e.get("force_template"), tuple(g.get(k) for k in ("rmse_max", "bad_pixel_ratio_max", "pixel_tolerance", "quality_gate"))))
    d = spark.createDataFrame(rows, CASES)
    return d.withColumn("id", F.coalesce("id", F.regexp_extract("dir", "([^/]+)/*$", 1)))


def only(df: DataFrame, ids: list[str] | None, limit: int | None) -> DataFrame:
    """The --only and --limit options (SRT-09)."""
    d = df if not ids else df.filter(F.col("id").isin(ids))
    return d if limit is None else d.limit(limit)


def select(attempts: DataFrame, key: str, by: str = "metrics") -> DataFrame:
    """The best attempt of each case (ORC-01, SRT-03): accepted ones by (rmse, bad, warnings, -score), or with
    by='warnings' by (warnings, rmse, bad, -score); missing metrics come last, ties go to the template's name."""
    metrics = [scoring.or_infinite("rmse"), scoring.or_infinite("bad")]
    order = [F.col("status") != "pass", *([*metrics, F.col("warnings")] if by == "metrics" else [F.col("warnings"), *metrics]), -F.col("score"), F.col("template")]
    return scoring.best_candidate(attempts, [key], order, ["template", "status", "rmse", "bad", "warnings", "score"])


def summary(results: DataFrame, group: list[str]) -> DataFrame:
    """Totals, passes, failures and skips (AGG-27, AGG-28); skipped cases don't count towards the total."""
    s = F.col("status")
    d = results.groupBy(*group).agg(F.count_if(s != "skipped").alias("total"), F.count_if(s == "pass").alias("passed"), F.count_if(~s.isin("pass", "skipped")).alias("failed"), F.count_if(s == "skipped").alias("skipped"))
    return d.withColumn("rate", F.when(F.col("total") > 0, F.bround(F.col("passed") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def markdown(df: DataFrame, order: list[Column]) -> DataFrame:
    """A summary as one Markdown table (SRC-16); summaries are small."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]), F.lit(" |"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], cells.alias("t")))).alias("r"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("value"))
