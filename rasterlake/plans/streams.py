"""Queries on streams: the given tables as an unbounded input that is read to its end."""

from __future__ import annotations

from rasterlake.plans.common import query
from rasterlake.plans.texts import _SCORES, _document_rules
from rasterlake.sources import images
from rasterlake.streaming import scores


@query(f"WITH {_SCORES} SELECT doc_id, top, score, decision FROM z")
def streamed_decisions(spark, sf):
    """CLS-04 on a stream: documents arrive as files and their decisions are written as they come; no state is kept."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # a pattern, as the table may be a file or a folder of files: a stream takes a plain path for a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    decided = scores.decide_stream(stream, ["doc_id"], _document_rules()).select("doc_id", "top", "score", "decision")
    folder = images.work_folder(spark)
    decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{folder}/out")
