"""Operator 9: byte-pair encoding and decoding by speculation and verification (see bpe.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work
from rasterlake.llm.bpe import loaded


def _listed(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32)))


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null and empty texts have none, repeated rows stay."""

    def make():
        _, encode = loaded(tokenizer)
        return lambda c: [c["doc_id"], _listed(*encode(c["text"]))]

    return work.map_batches(work.pick(docs, "doc_id", "text"), "doc_id long, ids array<int>", make)


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids: what they decode to, special tokens kept; null ids are empty."""

    def make():
        bpe, _ = loaded(tokenizer)
        return lambda c: [c["doc_id"], [bpe.decode(i or []) for i in c["ids"]]]

    return work.map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", make, None)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text: encode_texts and decode_ids in one pass, which share a worker's vocabulary."""

    def make():
        bpe, encode = loaded(tokenizer)

        def one(c: dict) -> list:
            flat, counts = encode(c["text"])
            ends = np.cumsum(counts)
            return [c["doc_id"], _listed(flat, counts), [bpe.decode(flat[e - n : e].tolist()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]]

        return one

    return work.map_batches(work.pick(docs, "doc_id", "text"), "doc_id long, ids array<int>, text string", make)


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    import public_tokenizers

    both = round_trip(work.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
