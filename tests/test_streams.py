"""Streams of documents and windowed counts of their decisions."""

from pyspark.sql import functions as F

from rasterlake.streaming import scores


def test_counts_by_window_and_late_rows(spark, tmp_path):
    schema = "doc_id long, at timestamp, text string"
    batches = [
        [(1, "2024-01-01 00:10:00", "long text"), (2, "2024-01-01 00:50:00", "x"), (3, "2024-01-01 01:10:00", "long text")],
        [(4, "2024-01-01 05:00:00", "x")],
        [(5, "2024-01-01 00:20:00", "late"), (6, "2024-01-01 05:30:00", "long text")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, at string, text string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/b={k}")
    rules = {"long": [(F.length("text") > 4, 3.0)], "short": [(F.length("text") <= 4, 3.0)], "base": [(F.lit(True), 1.0)]}
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    decided = scores.decide_stream(stream, ["doc_id", "at"], rules)
    counts = scores.decision_counts(decided, "at")
    counts.writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.window.start)[11:16], r.decision): r.n for r in spark.table("counted").groupBy("window", "decision").agg(F.max("n").alias("n")).collect()}
    assert got[("00:00", "long")] == 1 and got[("00:00", "short")] == 1 and got[("01:00", "long")] == 1
    assert got[("05:00", "short")] == 1 and got[("05:00", "long")] == 1  # the late row of document 5 is not counted
