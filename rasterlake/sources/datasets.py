"""Data sets of figures: manifests, configuration, vocabularies, regions to recognise, and what a run leaves for reading."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATES = T.MapType(T.StringType(), T.StringType())
CASE = T.StructType([T.StructField("id", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("force_template", T.StringType()), T.StructField("gates", GATES), T.StructField("expected_templates", T.ArrayType(T.StringType()))])


def text_of(spark: SparkSession, path: str) -> str:
    """The text of one small file in any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def parsed(text: str) -> object:
    """A configuration text: YAML where a parser is installed, else JSON, which is a part of it (SRC-07)."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def manifest_path(spark: SparkSession, dataset: str) -> tuple[str | None, str]:
    """(manifest, folder) of a data set (SRC-06): a manifest file itself, a folder with manifest.yaml, or a folder that is one case (no
    manifest). FileNotFoundError where there is neither."""
    base = dataset.rstrip("/")
    if base.endswith((".yaml", ".yml", ".json")):
        if not exists(spark, base):
            raise FileNotFoundError(base)
        return base, base.rsplit("/", 1)[0]
    if exists(spark, f"{base}/manifest.yaml"):
        return f"{base}/manifest.yaml", base
    if exists(spark, f"{base}/params.json") or exists(spark, f"{base}/input.png"):
        return None, base
    raise FileNotFoundError(f"no manifest and no case at {base}")


def cases(spark: SparkSession, dataset: str) -> DataFrame:
    """One row a case, in order, of a data set (SRC-05, SRC-06): ord, id, dir, tags, force_template, gates, expected_templates. ValueError for a
    manifest that isn't a mapping with a list of cases, each with an id."""
    manifest, folder = manifest_path(spark, dataset)
    if manifest is None:
        rows = [{"id": folder.rsplit("/", 1)[-1], "dir": folder}]
    else:
        found = parsed(text_of(spark, manifest))
        if not isinstance(found, dict) or not isinstance(found.get("cases"), list):
            raise ValueError(f"{manifest} must be a mapping with a list of cases")
        rows = found["cases"]
        if not all(isinstance(r, dict) and r.get("id") for r in rows):
            raise ValueError(f"every case of {manifest} must be a mapping with an id")
    one = lambda r: (str(r["id"]), r.get("dir") if r.get("dir", "").startswith(("/", folder)) else f"{folder}/{r.get('dir') or r['id']}", list(map(str, r.get("tags") or [])), r.get("force_template"), {k: str(v) for k, v in (r.get("gates") or {}).items()}, r.get("expected_templates"))
    schema = T.StructType([T.StructField("ord", T.IntegerType()), *CASE.fields])
    return spark.createDataFrame([(k, *one(r)) for k, r in enumerate(rows)], schema)


def config(spark: SparkSession, path: str, defaults: dict, required: tuple[str, ...] = ()) -> dict:
    """Defaults overlaid with a configuration file, section by section (SRC-07); a file that isn't there leaves them. ValueError where it is no
    mapping, or lacks a required section."""
    if not exists(spark, path):
        return defaults
    found = parsed(text_of(spark, path))
    if not isinstance(found, dict):
        raise ValueError(f"{path} must be a mapping")
    lost = [r for r in required if r not in found]
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")

    def over(a: object, b: object) -> object:
        return {**a, **{k: over(a.get(k), v) for k, v in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b

    return over(defaults, found)


def thresholds(values: dict, names: dict[str, float | int]) -> dict[str, float | int]:
    """Typed thresholds of a section by their defaults' types (SRC-08). ValueError where a value is no number."""
    out = {}
    for name, default in names.items():
        try:
            out[name] = type(default)(values.get(name, default))
        except (TypeError, ValueError):
            raise ValueError(f"{name} must be a number") from None
    return out


_VOCABULARIES: dict[str, dict | None] = {}


def vocabulary(spark: SparkSession, folder: str, template: str) -> dict | None:
    """A template's vocabulary, read once a process; None where it has no file (SRC-09)."""
    path = f"{folder.rstrip('/')}/{template}.yaml"
    if path not in _VOCABULARIES:
        found = parsed(text_of(spark, path)) if exists(spark, path) else None
        _VOCABULARIES[path] = found if isinstance(found, dict) else None
    return _VOCABULARIES[path]


def words_of_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a recogniser that gives parallel arrays text, conf, left, top, width, height (SRC-12): keys, text, conf (0 to 1), x, y, width,
    height. Blank words and those of negative or no confidence go; a short array's missing entries are null."""
    d = df.select(*keys, F.explode(F.arrays_zip("text", "conf", "left", "top", "width", "height")).alias("w")).select(*keys, "w.*")
    conf = F.col("conf").try_cast("double")
    box = [F.col(a).try_cast("int").alias(b) for a, b in (("left", "x"), ("top", "y"), ("width", "width"), ("height", "height"))]
    return d.filter((F.trim("text") != "") & (conf >= 0)).select(*keys, F.trim("text").alias("text"), (conf / 100).alias("conf"), *box)


def region_plan(regions: DataFrame, most: int) -> DataFrame:
    """Adds x0, y0, x1, y1 (whole, kept in the image) and factor of each region to recognise (SRC-13, PRJ-18): a longer side over most pixels is
    scaled down to it. Regions without area go. regions: image, region, x, y, width, height, image_width, image_height."""
    low = lambda c: F.greatest(F.floor(c), F.lit(0))
    d = regions.withColumn("x0", low("x")).withColumn("y0", low("y")).withColumn("x1", F.least(F.ceil(F.col("x") + F.col("width")), F.col("image_width"))).withColumn("y1", F.least(F.ceil(F.col("y") + F.col("height")), F.col("image_height")))
    d = d.filter("x1 > x0 AND y1 > y0")
    return d.withColumn("factor", F.least(F.lit(1.0), most / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))


def scan_regions(pixels: DataFrame, plan: DataFrame, recognise: Callable[[np.ndarray], list[tuple[str, float, float, float, float, float]]], seconds: float | None = 6, known: DataFrame | None = None) -> DataFrame:
    """image, region, text, conf, x, y, width, height, error of the words that recognise() finds in each region (SRC-13, SRC-14): it takes the
    region's pixels (rows x columns x 4), scaled down by its factor, and gives (text, conf, x, y, width, height); places are mapped back
    to the image. A region that takes over seconds, or raises, gives one row with its error, and the others stay. Regions of known (image,
    region), such as those of an earlier run's table, aren't scanned again. pixels: image, y, x, r, g, b, a; one region a group."""
    from rasterlake.operators import spatial
    from rasterlake.operators.convert import time_limit

    todo = plan if known is None else plan.join(known.select("image", "region").distinct(), ["image", "region"], "left_anti")
    p = todo.select("image", "region", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "factor")
    inside = spatial.pixels_in(pixels, p, "x0", "y0", "x1", "y1")
    kind = {c: p.schema[c].dataType.simpleString() for c in ("image", "region")}
    names = ["image", "region", "text", "conf", "x", "y", "width", "height", "error"]

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        x0, y0, x1, y1 = (int(one[c]) for c in ("x0", "y0", "x1", "y1"))
        grid = np.full((y1 - y0, x1 - x0, 4), 255, np.uint8)
        grid[rows["y"] - y0, rows["x"] - x0] = rows[["r", "g", "b", "a"]].to_numpy()
        f = float(one["factor"])
        if f < 1:
            h, w = max(1, round(grid.shape[0] * f)), max(1, round(grid.shape[1] * f))
            grid = grid[(np.arange(h) / f).astype(int).clip(0, grid.shape[0] - 1)][:, (np.arange(w) / f).astype(int).clip(0, grid.shape[1] - 1)]
        key = [one["image"], one["region"]]
        try:
            with time_limit(seconds):
                found = recognise(grid)
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([[*key, None, None, None, None, None, None, f"{type(e).__name__}: {e}"]], columns=names)
        return pd.DataFrame([[*key, t, c, x0 + x / f, y0 + y / f, w / f, h / f, None] for t, c, x, y, w, h in found], columns=names)

    return inside.groupBy("image", "region").applyInPandas(scan, f"image {kind['image']}, region {kind['region']}, text string, conf double, x double, y double, width double, height double, error string")


def artifacts(folder: str, **tables: DataFrame) -> dict[str, str]:
    """Intermediate tables of a run, each as Parquet in a folder of its own (SRC-20): name to path."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def option(values: Column, name: str, kind: str, default: object) -> Column:
    """An option of a map of texts, as a type, or its default where it is missing or no such value (PRJ-24)."""
    return F.coalesce(F.try_element_at(values, F.lit(name)).try_cast(kind), F.lit(default).cast(kind))


def write_reports(reports: DataFrame, case: str, folder: str) -> None:
    """A JSON report a case, in folder/case=<case>/ (SRC-15), keys sorted: the report's columns as one object. images.reports() reads them back."""
    body = F.to_json(F.struct(*sorted(c for c in reports.columns if c != case)))
    reports.select(F.col(case).alias("case"), body.alias("value")).write.mode("overwrite").partitionBy("case").text(folder)
