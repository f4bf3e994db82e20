"""Command line (ORC-08): classify, extract, render, convert, validate or regress figures in folders that Spark reads.

classify, extract, render and convert take a folder of PNG files and follow each figure's decision: the template of its
features and words, or the one of --template. validate takes a folder of SVG files, regress a folder of manifests whose cases
name folders below --images. The result is written as Parquet below the output folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators import batch, candidates, classify, extract, packed, rules
from rasterlake.sources import manifests, markup, store

TEXTS = "image string, item long, text string, conf double, x double, y double, width double, height double"


def _texts(spark: SparkSession, path: str | None) -> DataFrame:
    """Texts of a JSON file of image, item, text, conf, x, y, width, height; none without a file. A text without confidence is sure."""
    return spark.read.schema(TEXTS).json(path).fillna(1.0, ["conf"]) if path else spark.createDataFrame([], TEXTS)


def features(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """The features of each figure, with its words as tokens."""
    words = texts.groupBy("image").agg(F.flatten(F.collect_list(classify.words_of("text"))).alias("tokens"))
    return store.saved(packed.features(lines).join(words, "image", "left"), "features")


def decisions(found: DataFrame, forced: str | None) -> DataFrame:
    """image, template, top, confidence, margin, reasons of each figure."""
    d = classify.classify(found, ["image"]).withColumnRenamed("decision", "template")
    return d.withColumn("template", F.lit(extract.ALIASES.get(forced, forced))) if forced else d


def converted(lines: DataFrame, texts: DataFrame, found: DataFrame, top: int, forced: DataFrame | None, gates: tuple[float, float, float] | None, allow_failed_gate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Attempts and the choice of each figure."""
    attempts, unknown = candidates.ranked(found, "image", top, forced)
    tried = store.saved(candidates.run(attempts, lines, texts, candidates.BUILDERS, gates), "tried")
    chosen = candidates.choose(tried, found.select(F.col("image").alias("case")), unknown, gates is not None, allow_failed_gate)
    return tried, chosen.join(tried.select("case", "template", "svg"), ["case", "template"], "left")


def validated(spark: SparkSession, path: str, contract: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues, and the report of each SVG file below path."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.svg").text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc"), "value")
    elements = store.saved(markup.elements(docs, "doc", "value"), "elements")
    issues = store.saved(rules.validate_elements(elements, candidates.CONTRACT | (contract or {})), "issues")
    return issues, rules.report(elements, issues)


def regressed(spark: SparkSession, lines: DataFrame, texts: DataFrame, cases: DataFrame, top: int, gates: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Results of a manifest's cases, and their summary. A case's figure is the file <dir>.png, or any named <dir>/<file>.png by its last folder; its
    own limits, where given, override the gates. Cases with issues are skipped with them, those without a figure fail with E1401."""
    good = cases.filter("size(issues) = 0").select("id", F.concat(F.regexp_extract("dir", "([^/]+)/*$", 1), F.lit(".png")).alias("image"), "force_template", "expected_templates", *manifests.GATES)
    mine = lines.join(good.select("image").distinct(), "image", "left_semi")
    found = features(mine, texts)
    forced = good.filter("force_template IS NOT NULL").groupBy(F.col("image").alias("case")).agg(F.min("force_template").alias("template"))
    tried, chosen = converted(mine, texts, found, top, forced, gates, True)
    d = good.join(chosen.withColumnRenamed("case", "image"), "image", "left")
    over = (F.col("rmse") > F.coalesce("rmse_max", F.lit(gates[0]))) | (F.col("bad") > F.coalesce("bad_pixel_ratio_max", F.lit(gates[1])))
    code = F.when(F.col("template").isNull(), F.coalesce("code", F.lit("E1401"))).when(~classify.expected_template(F.col("template"), F.col("expected_templates")), "E1406").when(over, "E1409")
    done = d.select("id", "image", "template", "rmse", "bad", "warnings", code.alias("code")).withColumn("status", F.when(F.col("code").isNull(), "pass").otherwise("fail"))
    skipped = cases.filter("size(issues) > 0").select("id", F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("template"), *[F.lit(None).cast("double").alias(c) for c in ("rmse", "bad")], F.lit(None).cast("long").alias("warnings"), F.array_join("issues", ",").alias("code"), F.lit("skipped").alias("status"))
    results = store.saved(done.unionByName(skipped), "results")
    return results, batch.summary(results.withColumn("run", F.lit("all")), ["run"])


def main(arguments: list[str] | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="rasterlake", description=__doc__)
    parser.add_argument("command", choices=("classify", "extract", "render", "convert", "validate", "regress"))
    parser.add_argument("input", help="folder of PNG files, of SVG files (validate) or of manifests (regress)")
    parser.add_argument("output", help="folder that results are written to as Parquet")
    parser.add_argument("--texts", help="JSON lines of recognised texts")
    parser.add_argument("--images", help="folder of PNG files (regress)")
    parser.add_argument("--template", help="the template of all figures, whatever their features")
    parser.add_argument("--top", type=int, default=2, help="candidates a figure")
    parser.add_argument("--max-rmse", type=float, default=0.75)
    parser.add_argument("--max-bad", type=float, default=0.65)
    parser.add_argument("--tolerance", type=float, default=10)
    parser.add_argument("--allow-failed-gate", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("rasterlake").getOrCreate()
    gates = (a.max_rmse, a.max_bad, a.tolerance)
    tables: dict[str, DataFrame] = {}
    if a.command == "validate":
        tables["issues"], tables["report"] = validated(spark, a.input)
        result = "report"
    else:
        lines, texts = packed.read_lines(spark, a.images or a.input), _texts(spark, a.texts)
        if a.command == "regress":
            tables["results"], tables["summary"] = regressed(spark, lines, texts, manifests.read(spark, a.input), a.top, gates)
            result = "results"
        else:
            lines = store.saved(lines, "lines")
            found = features(lines, texts)
            decided = tables["decisions"] = store.saved(decisions(found, a.template), "decisions")
            result = "decisions"
            own = decided.select(F.col("image").alias("case"), "template")
            if a.command == "extract":
                pixels = store.saved(packed.unpack(lines), "pixels")
                wanted = {r.template for r in own.select("template").distinct().collect()}
                tables |= extract.extract(pixels, decided, texts, {t: d for t, d in extract.DRIVERS.items() if t in wanted})
            elif a.command == "render":
                tried, _ = converted(lines, texts, found, 1, own, None)
                tables["figures"], result = tried.select(F.col("case").alias("image"), "template", "stage", "code", "svg"), "figures"
            elif a.command == "convert":
                tables["attempts"], tables["choices"] = converted(lines, texts, found, a.top, own if a.template else None, gates, a.allow_failed_gate)
                result = "choices"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    return spark.read.parquet(f"{a.output}/{result}")


if __name__ == "__main__":
    main()
