"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame;
all but the last return the columns of documents. run() writes each stage's rows and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import jaccard, langid, packing, quality, work

#: A document goes where its quality score is lower.
LEAST_QUALITY = 0.5
#: Distinct chunks of text that a worker remembers while it encodes, beside what earlier stages left in it.
CACHED = 150_000
#: A document goes where its language holds no more of its n-grams than this or than the language's fitted bound, or where it has no letter.
LEAST_LANGUAGE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores LEAST_QUALITY or more; learned from this input's labelled documents.
    Rows are judged by their own text where they stand, whatever their other columns hold."""
    model = quality.train(docs, work.read(spark, sf_dir, "labels").filter(~work.held_out()))
    return quality.keep(docs, model, LEAST_QUALITY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; without letters or evidence they go."""
    return langid.keep(docs, langid.train(docs), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of five-word shingles at a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80, 100)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED)


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: A learned model and a packing heuristic have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = work.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.saved(stage(spark, docs, sf_dir), name)
    return docs
