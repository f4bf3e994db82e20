"""Decisions on a stream of documents, and windowed counts of them.

The reference has no streams; this is the batch operator on an unbounded table. decide() is a projection,
so it streams as it is; counts need a watermark, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import scoring


def decide_stream(stream: DataFrame, keys: list[str], rules: dict[str, list[tuple[Column, float]]]) -> DataFrame:
    """Stateless decisions; late rows are decided like any other."""
    return scoring.decide(stream, keys, rules)


def decision_counts(decided: DataFrame, time: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and decision; rows later than `late` are dropped by the watermark."""
    return decided.withWatermark(time, late).groupBy(F.window(time, every).alias("window"), "decision").agg(F.count("*").alias("n"))
