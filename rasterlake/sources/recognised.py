"""Recognition of regions through a cache that is keyed by content (SRC-13, SRC-14).

A region's key is the digest of its pixels and of the recogniser's parameters. Regions whose key is stored are read from the
cache, equal ones among the others are recognised once, and what is new is appended. A changed pixel changes the key.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.sources import store

STRIP = 64
WORD = "struct<text:string,conf:double,x:double,y:double,width:double,height:double>"
CACHE = f"key string, words array<{WORD}>, bucket string"
Recogniser = Callable[[np.ndarray], list[tuple[str, float, float, float, float, float]]]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path, empty where there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)


def crops(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """image, region, y, pixels (the bytes from x0 to x1) of the lines of each region. Lines meet regions by image and strip of
    STRIP lines, so an image's lines aren't multiplied by all its regions. lines: packed; plan: image, region, x0, y0, x1, y1, factor."""
    p = plan.select("image", "region", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(F.floor(F.col("y0") / STRIP), F.floor((F.col("y1") - 1) / STRIP))).alias("strip"))
    d = lines.withColumn("strip", F.floor(F.col("y") / STRIP)).join(p, ["image", "strip"]).filter("y >= y0 AND y < y1")
    return d.select("image", "region", "y", F.substring("rgba", 4 * F.col("x0") + 1, 4 * (F.col("x1") - F.col("x0"))).alias("pixels"))


def scan(lines: DataFrame, plan: DataFrame, recognise: Recogniser, cache: str, parameters: dict, seconds: float | None = 6) -> DataFrame:
    """image, region, text, conf, x, y, width, height, error of the words in each region, in the image's coordinates; plan as
    datasets.region_plan() gives it. What the cache at this path holds isn't recognised again; new results are appended to it, errors
    (a recogniser that raises, or takes over seconds) aren't. parameters (JSON values) are whatever changes what a
    recogniser finds. Two runs at once may store a key twice, which reads as one."""
    from rasterlake.operators.convert import time_limit

    spark = lines.sparkSession
    cut = store.saved(crops(lines, plan), "crops")
    said = json.dumps(parameters, sort_keys=True)
    whole = cut.groupBy("image", "region").agg(F.array_sort(F.collect_list(F.struct("y", F.sha2("pixels", 256).alias("d")))).alias("l"), F.first(F.length("pixels")).alias("n"))
    keyed = plan.join(whole, ["image", "region"]).withColumn("key", F.sha2(F.concat_ws("|", F.lit(said), F.col("n").cast("string"), F.round("factor", 9).cast("string"), F.array_join(F.col("l")["d"], "")), 256))
    keyed = store.saved(keyed.select("image", "region", "x0", "y0", "x1", "y1", "factor", "key"), "keys")
    known = _stored(spark, cache)
    new = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("image", "region", "x0", "x1", "factor")).alias("r")).select("key", "r.*")
    todo = cut.join(new, ["image", "region"]).select("key", "y", "pixels", "factor")
    arrow = pa.schema([("key", pa.string()), ("words", pa.list_(pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in ("conf", "x", "y", "width", "height")]]))), ("error", pa.string())])

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        grid = np.stack([np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 4) for v in table.column("pixels")])
        f = table.column("factor")[0].as_py()
        if f < 1:
            h, w = (max(1, round(n * f)) for n in grid.shape[:2])
            grid = grid[(np.arange(h) / f).astype(int).clip(0, grid.shape[0] - 1)][:, (np.arange(w) / f).astype(int).clip(0, grid.shape[1] - 1)]
        out = {"key": table.column("key")[0].as_py(), "words": None, "error": None}
        try:
            with time_limit(seconds):
                out["words"] = [{"text": t, "conf": c, "x": x / f, "y": y / f, "width": w / f, "height": h / f} for t, c, x, y, w, h in recognise(grid)]
        except Exception as e:  # noqa: BLE001
            out["error"] = f"{type(e).__name__}: {e}"
        return pa.Table.from_pylist([out], arrow)

    found = store.saved(todo.groupBy("key").applyInArrow(read, f"key string, words array<{WORD}>, error string"), "recognised")
    fresh = found.filter("error IS NULL").select("key", "words", F.substring("key", 1, 2).alias("bucket"))
    out = keyed.join(known.select("key", "words").unionByName(fresh.select("key", "words")).groupBy("key").agg(F.first("words").alias("words")), "key", "left").join(found.select("key", "error"), "key", "left")
    out = out.select("image", "region", "x0", "y0", "error", F.explode_outer("words").alias("w")).filter("w IS NOT NULL OR error IS NOT NULL")
    out = store.saved(out.select("image", "region", "w.text", "w.conf", (F.col("x0") + F.col("w.x")).alias("x"), (F.col("y0") + F.col("w.y")).alias("y"), "w.width", "w.height", "error"), "words")
    fresh.write.mode("append").partitionBy("bucket").parquet(cache)
    return out
