"""PNG files, JSON and delimited sources, and sinks.

Channel order of Spark's image source is BGRA; pixels() gives r, g, b, a columns.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_PIXELS = 65_536
MAGIC = bytes.fromhex("89504e470d0a1a0a")


def png_bytes(rgba: np.ndarray) -> bytes:
    """A PNG of an array h x w x 4 (uint8), with the standard library only (SRC-19)."""
    h, w, _ = rgba.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgba[y].astype(np.uint8).tobytes() for y in range(h))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def work_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which a cluster shares; on a local master, a temporary one where that is unset."""
    home = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rasterlake.figures.work", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        home = f"file://{tempfile.mkdtemp(prefix='rasterlake-')}"
        spark.conf.set("rasterlake.figures.work", home)
    return f"{home.rstrip('/')}/figures/{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession) -> str:
    """A new folder of this application."""
    return f"{work_root(spark)}/{uuid.uuid4().hex}"


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in any store that Spark can write to, from the driver."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def scan_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, length and valid (the PNG magic) of all files below path (SRC-02, SRC-03)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", (F.substring("content", 1, 8) == F.lit(MAGIC)).alias("valid"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """image, y, x, r, g, b, a of all readable images below path (SRC-01); unreadable ones give no rows. Arrow maps cut the
    decoded bytes into pixels, so many lines of an image at a time that a batch stays small."""
    img = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width, height, channels, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                grid = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                lines = max(1, BATCH_PIXELS // max(1, width))
                for y in range(0, height, lines):
                    part = grid[y : y + lines].reshape(-1, channels)
                    n = len(part)
                    blue, green, red = (part[:, min(k, channels - 1)].astype(np.int32) for k in range(3))  # the source's order
                    alpha = part[:, 3].astype(np.int32) if channels == 4 else np.full(n, 255, np.int32)
                    at = np.arange(n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *map(pa.array, (y + at // width, at % width, red, green, blue, alpha))], ["image", "y", "x", "r", "g", "b", "a"])

    found = img.select(F.element_at(F.split("origin", "/"), -1).alias("image"), "width", "height", "nChannels", "data")
    return found.mapInArrow(cut, "image string, y int, x int, r int, g int, b int, a int")


def write_figures(figures: DataFrame, folder: str) -> str:
    """Each image of pixels (image, y, x, r, g, b, a) as <image>.png in a folder of any store that Spark writes to (SRC-19), drawn
    one image a task; the driver passes the files on, one at a time. Returns the folder."""
    lines = figures.select("image", "y", F.struct("x", "r", "g", "b", "a").alias("p")).groupBy("image", "y").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y", ignore_index=True)
        grid = np.array([[[p["r"], p["g"], p["b"], p["a"]] for p in ps] for ps in rows["p"]], np.uint8)
        return pd.DataFrame({"image": [str(rows["image"].iloc[0])], "png": [png_bytes(grid)]})

    drawn = lines.groupBy("image").applyInPandas(draw, "image string, png binary")
    for row in drawn.toLocalIterator():  # one file at a time: Spark has no sink of named binary files
        put_file(figures.sparkSession, f"{folder}/{row.image}.png", bytes(row.png))
    return folder


def params(spark: SparkSession, path: str) -> DataFrame:
    """path and doc (variant) of JSON files; doc is null where a file isn't a JSON object (SRC-04)."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))
    return d.withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's tab-separated files (SRC-11): text, conf (0 to 1), x, y, width, height."""
    d = spark.read.csv(path, sep="\t", header=True, quote="")
    keep = (F.trim("text") != "") & (F.col("conf").try_cast("double") >= 0)
    box = [F.col(a).try_cast("int").alias(b) for a, b in (("left", "x"), ("top", "y"), ("width", "width"), ("height", "height"))]
    return d.filter(keep).select("text", (F.col("conf").try_cast("double") / 100).alias("conf"), *box)


def cache_key(columns: list[str]) -> F.Column:
    """Key of a row in a result cache (SRC-14): the digest of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def reports(spark: SparkSession, glob: str) -> DataFrame:
    """Case reports (SRC-22): path, status, codes of issues; tolerant of missing fields (SRC-23)."""
    d = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "status string, errors array<struct<code:string>>, warnings array<struct<code:string>>").alias("r"))
    codes = lambda c: F.transform(F.coalesce(F.col(f"r.{c}"), F.array()), lambda e: e["code"])
    return d.select("path", "r.status", codes("errors").alias("errors"), codes("warnings").alias("warnings"))


def write_json(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines (SRC-15)."""
    df.write.mode("overwrite").json(path)
