"""Operator 11: token counts of whole texts, huge ones from overlapping chunks that are spliced where they agree.

A byte-level pre-tokenizer matches words from left to right without looking back, so where a word begins in the
whole text, the rest of its words depend on the text from there on only. A chunk that starts anywhere need not start
at such a place. But if the chunk before it, whose words are right from its own splice on, begins a word at the same
place as this chunk, both go on alike, so the place is a proven boundary: tokens before it are the left chunk's,
tokens after it the right one's. What stands close to a chunk's end may still change with the text behind it
(a longer word, white space, half a special token), so boundaries within `margin` characters of it aren't used.

Chunks that have no boundary in common in their overlap get a wider one, four times as wide each round; a chunk that
has none in its whole step (one giant word) is left out, and the chunk before it is spliced with the next one that is
left, over all the text between them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm import work
from rasterlake.llm.chunks import library_encoder

STEP = 16_384  # bytes between the starts of chunks
OVERLAP = 512  # bytes that a chunk has of the next one's step
WIDEN = 4
CACHED = 150_000  # distinct chunks of short texts that a worker remembers
LIMIT = 1024


class WordEncoder:
    """Tokens and word starts of pieces of text by the tokenizers library.

    Only for files without a normaliser, with the byte-level pre-tokenizer's own pattern, and with added tokens that
    don't look at their neighbours: for others the module's argument doesn't hold, which raises ValueError."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        if made.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError(f"{path}: overlapping chunks need a byte-level pre-tokenizer and no normaliser")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token looks at its neighbours")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = 3 + max([len(t["content"]) for t in added], default=0)

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text: all tokens, the characters where words begin, and the tokens before each."""
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            word = np.array(e.word_ids, np.int64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(word))
            yield len(word), at[first], first


_LOADED: dict[str, WordEncoder] = {}


def _words(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _whole(data: np.ndarray, at: int) -> int:
    """The first start of a character at byte `at` or after it."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def starts(data: np.ndarray, step: int) -> list[int]:
    """Where chunks start; the last one has half a step at least."""
    return [_whole(data, a) for a in range(0, max(len(data) - step // 2, 1), step)]


def _pieces(rows: DataFrame, schema: str, cut) -> DataFrame:
    """Rows of the pieces that cut(bytes of text, other columns) yields, in Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            others = [n for n in batch.schema.names if n != "text"]
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                for piece in cut(data, {n: batch.column(n)[i].as_py() for n in others}):
                    held.append(piece)
                    size += sum(len(x) for x in piece if isinstance(x, str)) + 64
                    if size > work.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, p, strict=True)) for p in held], schema=arrow)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, p, strict=True)) for p in held], schema=arrow)

    return rows.mapInArrow(run, schema)


def _text(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().decode()


def _chunks(huge: DataFrame, step: int, overlap: int) -> DataFrame:
    """row, k, at (byte where the chunk starts), own (characters before the next chunk, null in the last), text."""

    def cut(data: np.ndarray, c: dict) -> Iterator[tuple]:
        first = starts(data, step)
        for k, a in enumerate(first):
            if k + 1 == len(first):
                yield c["row"], k, a, None, _text(data, a, len(data))
            else:
                own = _text(data, a, first[k + 1])
                yield c["row"], k, a, len(own), own + _text(data, first[k + 1], _whole(data, first[k + 1] + overlap))

    return _pieces(huge.select("row", "text"), "row long, k int, at long, own int, text string", cut)


ZONE = "array<struct<at:int,n:int>>"


def _zone(at: np.ndarray, n: np.ndarray, low: int, high: int) -> list[dict]:
    """Word starts from low to high, from low on, with the tokens before each."""
    a, b = np.searchsorted(at, [low, high + 1])
    return [{"at": x, "n": y} for x, y in zip((at[a:b] - low).tolist(), n[a:b].tolist(), strict=True)]


def _encoded(chunks: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """row, k, at, last, total (tokens), head and tail (word starts in the overlaps with the chunks before and after,
    from the start of the later chunk), end (bytes into the chunk of its last word start in its own step), before
    (tokens before end)."""

    def make():
        words = _words(tokenizer)

        def one(c: dict) -> list:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for own, text, (total, at, n) in zip(c["own"], c["text"], words(c["text"]), strict=True):
                last = own is None
                head = len(text.encode()[:overlap].decode(errors="ignore")) - words.margin
                e = 0 if last else max(int(np.searchsorted(at, own)) - 1, 0)
                values = (last, total, _zone(at, n, 0, head), [] if last else _zone(at, n, own, len(text) - words.margin), len(text[: at[e]].encode()), int(n[e]))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            return [c["row"], c["k"], c["at"], *out]

        return one

    return work.map_batches(chunks, f"row long, k int, at long, last boolean, total long, head {ZONE}, tail {ZONE}, end int, before long", make)


def _spliced(left: str, right: str) -> F.Column:
    """Tokens left of the first word start that both zones have, less those of the right chunk; null if there is none."""
    at = F.array_min(F.array_intersect(F.col(left)["at"], F.col(right)["at"]))
    tokens = [F.element_at(F.col(z)["n"], F.array_position(F.col(z)["at"], at).cast("int")) for z in (left, right)]
    return F.when(at.isNotNull(), (tokens[0] - tokens[1]).cast("long"))


def _widened(huge: DataFrame, links: DataFrame, tokenizer: str) -> DataFrame:
    """row, j, delta of links (row, j, a, b, width): words from byte a (a boundary of the left chunk) and from byte b
    (the start of the right one) up to width bytes behind b, spliced anew; for b null, all tokens from a on."""
    asked = links.groupBy("row").agg(F.collect_list(F.struct("j", "a", "b", "width")).alias("asked"))

    def cut(data: np.ndarray, c: dict) -> Iterator[tuple]:
        for x in c["asked"]:
            if x["b"] is None:
                yield c["row"], x["j"], None, None, _text(data, x["a"], len(data)), ""
            else:
                stop = _whole(data, min(x["b"] + x["width"], len(data)))
                yield c["row"], x["j"], stop == len(data), len(_text(data, x["a"], x["b"])), _text(data, x["a"], stop), _text(data, x["b"], stop)

    pieces = _pieces(huge.select("row", "text").join(asked, "row"), "row long, j int, whole boolean, own int, text string, right string", cut)

    def make():
        words = _words(tokenizer)

        def one(c: dict) -> list:
            total, left, right = [], [], []
            for own, whole, (t, at, n), (_, at2, n2), text in zip(c["own"], c["whole"], words(c["text"]), words(c["right"]), c["text"], strict=True):
                total.append(t if own is None else None)
                high = len(text) - (0 if whole else words.margin)
                left.append([] if own is None else _zone(at, n, own, high))
                right.append([] if own is None else _zone(at2, n2, 0, high - own))
            return [c["row"], c["j"], total, left, right]

        return one

    zones = work.map_batches(pieces.repartition("row", "j"), f"row long, j int, total long, `left` {ZONE}, `right` {ZONE}", make)
    return zones.select("row", "j", F.coalesce("total", _spliced("left", "right")).alias("delta"))


def huge_counts(huge: DataFrame, tokenizer: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """row, n_tokens, n_chunks of documents (row, a number of its own for each, and text, not null or empty).

    Chunks are dealt to tasks one by one, so a giant text is spread. Between rounds only links are written: a text's
    links are one group in the step that leaves chunks out (131,072 of them in the longest text a row can hold)."""
    chunk = work.saved(_encoded(_chunks(huge, step, overlap).repartition("row", "k"), tokenizer, overlap), "chunks")
    inner = chunk.select("row", (F.col("k") + 1).alias("j"), F.col("before"), (F.col("at") + F.col("end")).alias("a"), "tail")
    links = work.saved(
        chunk.filter("k > 0").select("row", F.col("k").alias("j"), F.col("at").alias("b"), "head").join(inner, ["row", "j"])
        .select("row", "j", "a", "before", "b", F.lit(overlap).alias("width"), _spliced("tail", "head").alias("delta")),
        "links",
    )
    while not links.filter("delta is null").isEmpty():
        # wider overlaps
        retry = links.withColumn("width", F.when(F.col("delta").isNull(), F.least(F.col("width") * WIDEN, F.lit(step))).otherwise(F.col("width")))
        found = _widened(huge, retry.filter("delta is null"), tokenizer).withColumnRenamed("delta", "found")
        links = work.saved(retry.join(found, ["row", "j"], "left").withColumn("delta", F.coalesce("delta", F.col("before") + F.col("found"))).drop("found"), "links")
        # chunks without a boundary of their neighbour's in a whole step go; the chunk before meets the next that stays
        lost = links.filter(f"delta is null and width >= {step}")
        if lost.isEmpty():
            continue
        order = Window.partitionBy("row").orderBy("j")
        chain = links.withColumn("gone", F.col("delta").isNull() & (F.col("width") >= step))
        # a and before of a link belong to the last chunk that stays: the link's own, or that of the run of lost links
        chain = chain.withColumn("after_gone", F.coalesce(F.lag("gone").over(order), F.lit(False)))
        held = [F.last(F.when(~F.col("after_gone"), F.col(c)), ignorenulls=True).over(order).alias(f"{c}2") for c in ("a", "before")]
        chain = chain.select("*", *held, F.lead("j").over(order).isNull().alias("ending"))
        kept = chain.filter(~F.col("gone") & ~F.col("after_gone")).select(*links.columns)
        fresh = chain.filter(~F.col("gone") & F.col("after_gone")).select("row", "j", F.col("a2").alias("a"), F.col("before2").alias("before"), "b", F.lit(overlap // WIDEN).alias("width"), F.lit(None).cast("long").alias("delta"))
        ends = chain.filter("gone and ending").select("row", "j", F.col("a2").alias("a"), F.col("before2").alias("before"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("width"), F.lit(None).cast("long").alias("delta"))
        links = work.saved(kept.union(fresh).union(ends), "links")
    # the last chunk's own tokens count where it stayed; a link without b holds all that is left of the text
    last = chunk.filter("last").select("row", F.col("k").alias("j"), "total").join(links.filter("b is null").select("row", "j"), ["row", "j"], "left_anti")
    parts = links.select("row", "delta").union(last.select("row", "total"))
    size = chunk.groupBy("row").agg(F.count("*").cast("int").alias("n_chunks"))
    return parts.groupBy("row").agg(F.sum("delta").alias("n_tokens")).join(size, "row")


def token_counts(docs: DataFrame, tokenizer: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks of each row's whole text, as tokenizers counts it with special strings in
    texts taken as it does, and nothing added. Null and empty texts have 0 of both; repeated rows and null ids stay.

    Texts of up to two steps are counted where they stand, through the cache of distinct chunks of chunks.py; only
    longer ones are cut, written once and dealt to tasks. A word is the library's in either case."""
    docs = work.pick(docs, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))

    def make():
        encode = library_encoder(tokenizer, CACHED)
        return lambda c: [c["doc_id"], c["n_bytes"], encode(c["text"])[1], [1] * len(c["text"])]

    small = work.map_batches(docs.filter(F.col("n_bytes") <= 2 * step), "doc_id long, n_bytes long, n_tokens long, n_chunks int", make)
    huge = work.saved(docs.filter(F.col("n_bytes") > 2 * step).withColumn("row", F.monotonically_increasing_id()), "huge")
    counted = huge.select("row", "doc_id", "n_bytes").join(huge_counts(huge, tokenizer, step, overlap), "row")
    return small.union(counted.select("doc_id", "n_bytes", "n_tokens", "n_chunks"))


def op11_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over 1,024."""
    import public_tokenizers

    counts = token_counts(work.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
