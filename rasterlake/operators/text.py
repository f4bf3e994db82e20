"""Text cleaning, vocabularies, filters with reasons, and greedy de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions import exprs as X


def lexicon_correct(tokens: DataFrame, token: str, lexicon: list[str], max_distance: int = 2) -> DataFrame:
    """Adds corrected and changed (JON-09, STR-05): an exact key wins, else the least edit distance of at most
    max_distance, earlier keys on ties; the token's case carries over; tokens that start with something else
    than a letter or digit are copied. The lexicon is literal, so there is no join; distances are computed
    once for each distinct token."""
    t = F.lower(F.col("__t"))
    best = F.array_min(F.array_compact(F.array(*[F.when(F.levenshtein(t, F.lit(k.lower())) <= max_distance, F.struct(F.levenshtein(t, F.lit(k.lower())).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, k in enumerate(lexicon)])))
    words = tokens.select(F.col(token).alias("__t")).distinct()
    plain = F.col("__t").rlike(r"^[\p{L}\p{N}]")
    words = words.withColumn("__k", F.when(plain, best["k"])).withColumn("corrected", F.coalesce(X.apply_case(F.col("__t"), F.col("__k")), F.col("__t")))
    return tokens.join(words.select("__t", "corrected"), F.col(token) == F.col("__t"), "left").drop("__t").withColumn("changed", F.coalesce(F.col("corrected") != F.col(token), F.lit(False)))


def vocabulary_match(texts: DataFrame, text: str, terms: list[str], min_similarity: float = 0.75, max_edit: int = 2) -> DataFrame:
    """Adds term, similarity, matched (JON-10, STR-07): equal or containing terms count 1; else the best
    similarity of the whole text or of a word of three or more characters, earlier terms on ties. A short
    text (10 or fewer) within max_edit of its best term matches too."""
    s = F.lower(F.trim(F.col(text)))
    words = F.filter(F.split(s, r"\s+"), lambda w: F.length(w) >= 3)

    def score(term: str) -> Column:
        low = F.lit(term.lower())
        best = F.coalesce(F.array_max(F.transform(words, lambda w: X.similarity(w, low))), F.lit(0.0))
        inside = (F.length(s) > 0) & (F.contains(s, low) | F.contains(low, s))
        return F.when(inside, F.lit(1.0)).otherwise(F.greatest(X.similarity(s, low), best))

    ranked = F.array_max(F.array(*[F.struct(score(k).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(terms)]))
    d = texts.withColumn("__b", ranked)
    near = (F.length(s) <= 10) & (F.levenshtein(s, F.lower(F.col("__b.k"))) <= max_edit)
    return d.withColumn("term", F.col("__b.k")).withColumn("similarity", F.col("__b.s")).withColumn("matched", (F.col("similarity") >= min_similarity) | (F.col("similarity") > 0) & near).drop("__b")


def validation_reason(text: Column, confidence: Column, least: Column, noise: list[str], valid: list[str], vocabulary: Column | None = None, strict: bool = False) -> Column:
    """The cascade of reasons (FLT-04 to FLT-07): patterns are case-insensitive; valid ones match from the start."""
    rlike = lambda p, anchor="": text.rlike(f"(?i){anchor}{p}")
    is_noise = F.lit(False)
    for p in noise:
        is_noise = is_noise | rlike(p)
    is_valid = F.lit(False)
    for p in valid:
        is_valid = is_valid | rlike(p, "^")
    known = vocabulary if vocabulary is not None else F.lit(False)
    reason = F.when(F.trim(text) == "", "empty_text").when(is_noise, "noise_pattern").when((confidence < least) & ~is_valid, "low_confidence")
    if strict:
        reason = reason.when(~known, "no_vocab_match")
    return reason.when(~known & X.suspicious(text), "suspicious_pattern").otherwise("valid")


def keep_text(text: Column, confidence: Column, min_confidence: float = 0.5) -> Column:
    """Whether a recognised text is kept (FLT-01, FLT-08), without a vocabulary."""
    t = X.collapse(text)
    s = X.char_stats(t)
    good = (s["ascii"] >= 0.7) & (s["alnum"] >= 0.35) & ~((s["alpha"] < 0.2) & (s["digit"] < 0.15))
    return (F.length(t) >= 2) & ~X.random_chars(t) & (confidence >= min_confidence) & good


def grid_dedup(df: DataFrame, keys: list[Column], order: str, score: str) -> DataFrame:
    """One row a key, that of the highest score, earlier rows on ties; slot is the first row's order (SET-06).
    Partial aggregation before the shuffle, so a frequent key is never gathered."""
    rest = [c for c in df.columns]
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    d = df.withColumns(named).groupBy(*named).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("r"), F.min(order).alias("slot"))
    return d.select("r.*", "slot")


def sequence_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ratio: the Ratcliff-Obershelp similarity (STR-08), by difflib over Arrow batches."""
    from difflib import SequenceMatcher

    schema = T.StructType([*df.schema.fields, T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(ratio=[SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(rows[a], rows[b], strict=True)])

    return df.mapInPandas(run, schema)


def reading_order(df: DataFrame, keys: list[str], x: str, y: str, text: str, conf: str) -> DataFrame:
    """Texts of each region joined by spaces in reading order, and their mean confidence (STR-18, SRT-05)."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y, x, text))), lambda s: s[text]), " ").alias("text"), F.avg(conf).alias("conf"))


def stacked(items: DataFrame, keys: list[str], gap: float = 1.8, overlap: float = 0.6) -> DataFrame:
    """keys, grp, text, x, y, right, bottom of stacked items (WIN-11): from the top, an item joins the one before it where they overlap sideways by
    at least overlap of the narrower one (a pixel at least), its baseline is no lower than gap times the taller one's height, and
    both have one role. items: keys, item, text, role, baseline, x, y, width, height. Texts are collapsed and stand in lines of their own."""
    w = Window.partitionBy(*keys).orderBy("y", "item")
    last = lambda c: F.lag(c).over(w)
    right = F.col("x") + F.col("width")
    shared = F.greatest(F.lit(0.0), F.least(right, last(right)) - F.greatest("x", last("x"))) / F.greatest(F.least("width", last("width")), F.lit(1.0))
    apart = (shared < overlap) | (F.col("baseline") - last("baseline") > F.greatest("height", last("height")) * gap) | ~F.col("role").eqNullSafe(last("role"))
    d = items.withColumn("__new", F.when(last("y").isNull(), 0).otherwise(apart.cast("int"))).withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.when(X.collapse(F.coalesce("text", F.lit(""))) != "", F.struct("y", "item", X.collapse(F.col("text")).alias("t")))
    return d.groupBy(*keys, "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(right).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
