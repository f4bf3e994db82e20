"""Shared helpers: work tables in the cluster's shared folder, and Arrow maps in bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096


def work_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, or a folder of our own where that is unset (local tests)."""
    home = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        home = spark.conf.get("rasterlake.local.work", None) or tempfile.mkdtemp(prefix="rasterlake-")
        spark.conf.set("rasterlake.local.work", home)
    return f"{home.rstrip('/')}/rasterlake/{spark.sparkContext.applicationId}"


def new_table(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a work table and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Deletes the work tables of this application; call it once results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of about `most` bytes of text (one longer text is a run of its own)."""
    n = batch.num_rows
    if not n:
        return
    if text is None:
        for k in range(0, n, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    k = 0
    while k < n:
        base = size[k - 1] if k else 0
        stop = min(max(int(np.searchsorted(size, base + most, "right")), k + 1), k + SLICE_ROWS)
        yield batch.slice(k, stop - k)
        k = stop


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable], text: str | None = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow in bounded slices. make() runs once a task and gives a function from a slice's columns
    (name -> Python list) to a list of columns in schema's order, or None for no rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, most):
                columns = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_batches(df: DataFrame, make: Callable[[], Callable], text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Rows for which make()'s function, given a slice's texts, holds; every column passes through as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for batch in batches:
            for part in slices(batch, text, most):
                yield part.filter(pa.array(np.asarray(good(part.column(text).to_pylist()), bool)))

    return df.mapInArrow(run, df.schema)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (extra columns of any name stay out), text as string and ids as long."""
    kinds = {"doc_id": "long", "text": "string"}
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in columns])


def held_out(column: str = "doc_id") -> F.Column:
    """Fold 1 of 3 by crc32 of the id's decimal text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(lengths: Sequence[int] | np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of the concatenation of runs [starts[i], starts[i] + lengths[i])."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
