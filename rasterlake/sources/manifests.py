"""Case manifests as tables (SRC-05, ORC-06): JSON files that Spark scans, one row a case, with what is wrong in it as issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gates that a case may set, and the issue of one that is no number.
GATES = ("rmse_max", "bad_pixel_ratio_max", "pixel_tolerance")
KNOWN = ("id", "dir", "tags", "force_template", "expected_templates", "gates")


def read(spark: SparkSession, path: str) -> DataFrame:
    """manifest (file name), ord, id, dir, tags, force_template, expected_templates, rmse_max, bad_pixel_ratio_max, pixel_tolerance, issues of
    every case of the JSON manifests below path. An entry may be a folder's name alone; the id defaults to the folder's last part.

    Issues, sorted: not_json, cases_missing (no list of cases; ord -1), not_an_object, dir_missing, tags_not_a_list, gates_not_an_object,
    gate_not_numeric:<name>, unknown_field:<name>. Of repeated ids in a manifest, each but the first is duplicate_id. A value
    with an issue is null. Each file is one row while it is read, so a manifest is bounded by a row's size."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    files = text.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("manifest"), F.try_parse_json("value").alias("doc"))
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    files = files.withColumn("cases", F.try_variant_get("doc", "$.cases", "variant"))
    listed = F.startswith(kind("cases"), F.lit("ARRAY"))
    broken = files.filter(~listed).select("manifest", F.lit(-1).alias("ord"), F.lit(None).cast("variant").alias("c"), F.when(F.col("doc").isNull(), "not_json").otherwise("cases_missing").alias("lost"))
    found = files.filter(listed).select("manifest", F.posexplode(F.try_variant_get("cases", "$", "array<variant>")).alias("ord", "c")).withColumn("lost", F.lit(None).cast("string"))
    d = found.unionByName(broken).withColumn("k", kind("c"))
    is_object, is_text = F.startswith("k", F.lit("OBJECT")), F.col("k") == "STRING"
    get = lambda name, t="variant": F.when(is_object, F.try_variant_get("c", f"$.{name}", t))
    given = lambda name: F.coalesce(~kind(get(name)).isin("VOID"), F.lit(False))
    d = d.withColumns({"dir": F.when(is_text, F.try_variant_get("c", "$", "string")).otherwise(get("dir", "string")), "gates": get("gates"), "fields": F.when(is_object, F.map_keys(F.try_variant_get("c", "$", "map<string,variant>")))})
    d = d.withColumn("id", F.coalesce(get("id", "string"), F.regexp_extract("dir", "([^/]+)/*$", 1)))
    numeric = {g: F.when(F.startswith(kind("gates"), F.lit("OBJECT")), F.try_variant_get("gates", f"$.{g}", "double")) for g in GATES}
    set_ = lambda g: F.coalesce(~kind(F.try_variant_get("gates", f"$.{g}", "variant")).isin("VOID"), F.lit(False))
    alone = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name if isinstance(name, Column) else F.lit(name))
    some = [
        F.col("lost"), alone(F.col("lost").isNull() & ~is_object & ~is_text, "not_an_object"), alone((is_object | is_text) & (F.coalesce(F.trim("dir"), F.lit("")) == ""), "dir_missing"),
        alone(given("tags") & get("tags", "array<string>").isNull(), "tags_not_a_list"), alone(given("gates") & ~F.startswith(kind("gates"), F.lit("OBJECT")), "gates_not_an_object"),
        *[alone(F.startswith(kind("gates"), F.lit("OBJECT")) & set_(g) & numeric[g].isNull(), f"gate_not_numeric:{g}") for g in GATES],
    ]
    strange = F.transform(F.array_except(F.coalesce("fields", F.array().cast("array<string>")), F.array(*map(F.lit, KNOWN))), lambda n: F.concat(F.lit("unknown_field:"), n))
    d = d.select(
        "manifest", "ord", "id", F.nullif(F.trim("dir"), F.lit("")).alias("dir"), F.coalesce(get("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), get("force_template", "string").alias("force_template"),
        F.coalesce(get("expected_templates", "array<string>"), F.array().cast("array<string>")).alias("expected_templates"), *[numeric[g].alias(g) for g in GATES], F.concat(F.array_compact(F.array(*some)), strange).alias("issues"),
    )
    first = d.filter("id IS NOT NULL").groupBy("manifest", "id").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").select("manifest", "id", "first")
    d = d.join(first, ["manifest", "id"], "left")
    again = F.when(F.col("ord") > F.col("first"), F.array(F.lit("duplicate_id"))).otherwise(F.array().cast("array<string>"))
    return d.withColumn("issues", F.array_sort(F.concat("issues", again))).drop("first").select("manifest", "ord", "id", "dir", "tags", "force_template", "expected_templates", *GATES, "issues")
