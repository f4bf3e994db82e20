"""Operator 13: groups of spelling variants by letter-parity bitmask bands.

A word's mask has a bit for the parity of how often each letter occurs (letters share BITS bits by their code point). An
inserted or deleted letter flips one bit, a replaced one two or none, so the masks of two words that are one edit apart
differ in two bits at most, and of three bands of the mask one at least is equal. Words meet in an equi-join on a band,
the length of the shorter word, and the half of the word that the edit left alone (an edit stands in one half, so the
other is equal as well); a pair counts in the first slot in which it meets. Masks of up to two different bits and an
edit distance of 1 are then verified.

The band alone would bring a fixed share of all pairs of like length together, which grows with the square of the
vocabulary; with the untouched half, what meets are words that share half their letters in order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BITS, BANDS = 60, 3
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 6, 5, 5
STRETCH = 1 << 20  # characters searched at once
HELD = 200_000  # words a task counts before it passes them on
DROP_ONE_IN = 199


def _runs(text: str) -> Iterator[list[str]]:
    """All runs of letters of a text, a stretch at a time; a stretch ends where a run does."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            stop = _OTHER.search(text, end)
            end = stop.start() if stop else len(text)
        yield RUN.findall(text, at, end)
        at = end


def varied(doc_id: int | None, run: str) -> str:
    """The run, or, for one in DROP_ONE_IN of (document, run), without one of its letters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP_ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: words of least_length letters or more, and how often they occur in all texts. A task adds up what it
    meets before anything is shuffled. Null and empty texts have no words; a null id counts as an empty one."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for part in work.slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found: Counter = Counter()
                    for some in _runs(text or ""):
                        found.update(some)
                    for word, n in found.items():
                        lower = word.lower() if word.isascii() else word.translate(_LOWER)
                        lower = varied(doc_id, lower)
                        if len(lower) >= least_length:
                            held[lower] += n
                    if len(held) > HELD:
                        yield full()
        yield full()

    return work.pick(docs, "doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parity_mask(word: str) -> F.Column:
    """The letters that occur an odd number of times, a bit each (code point modulo BITS)."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % BITS).cast("int"))))


def _band(mask: F.Column, k: int) -> F.Column:
    """Every BANDS-th bit, so that the common letters are spread over the bands."""
    return mask.bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS))))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each two distinct words (word, n; n is carried along) that are one inserted, deleted or replaced
    letter apart, once; of equal lengths a is the smaller, otherwise the shorter. Words have two letters at least."""
    base = words.select("word", "n", F.length("word").alias("size"), parity_mask("word").alias("mask"))

    def slots(df: DataFrame) -> DataFrame:
        """A row for each band and each half of the word that may be whole (0: the first, 1: the last); m is the shorter word's length."""
        half = F.floor(F.col("m") / 2).cast("int")
        keys = [F.struct(F.lit(3 * side + k).alias("slot"), _band(F.col("mask"), k).alias("bits"), (F.substring("word", F.lit(1), half) if side == 0 else F.right(F.col("word"), F.col("m") - half)).alias("half")) for side in (0, 1) for k in range(BANDS)]
        return df.withColumn("key", F.explode(F.array(*keys))).select("*", "key.*").drop("key")

    as_shorter = base.withColumn("m", F.col("size"))
    left = slots(as_shorter).select("slot", "bits", "half", "m", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"))
    right = slots(as_shorter.union(base.withColumn("m", F.col("size") - 1))).select("slot", "bits", "half", "m", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), "size")
    flips = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    half = F.floor(F.col("m") / 2).cast("int")
    k = F.col("slot") % BANDS
    first_band = F.lit(True)
    for j in range(BANDS - 1):
        first_band &= (k <= j) | (_band(flips, j) != 0)
    first_half = (F.col("slot") < BANDS) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    met = left.join(right, ["slot", "bits", "half", "m"]).filter(((F.col("size") > F.col("m")) | (F.col("a") < F.col("b"))) & (F.bit_count(flips) <= 2) & first_band & first_half)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form of each word's chain of forms (word, form), by doubling; chains may not be circles.
    A form is FORM_TIMES as frequent as its word, so a chain has no more links than 63 / log2(FORM_TIMES), 28."""
    state = work.saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = work.saved(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        state = step.select("word", "root")


def spelling_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: words of least_count occurrences or more; n_near counts those one edit away;
    form is the most frequent of them (ties: the smallest) if it is `times` as frequent, else null; root ends the chain."""
    words = work.saved(word_counts(docs, least_length).filter(F.col("n") >= least_count), "words")
    pairs = work.saved(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    told = work.saved(told.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    last = roots(told.filter("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_parity_band_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with the form that it may be a variant of."""
    return spelling_groups(work.read(spark, sf_dir, "documents"))


#: crc32 as a rule over the bytes of `<doc_id>:<run>` (letters from U+00C0 on are the byte 195 and the code point less 64).
ORACLE = """
WITH RECURSIVE table_of AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
of_doc AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) > 127 THEN [195, ord(x) - 64] ELSE [ord(x)] END))::BIGINT[] AS b FROM of_doc),
hashed AS (SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) AS h FROM bytes, table_of),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, left(word, i::INT - 1) AS a, substr(word, i::INT + 1) AS z FROM places),
pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
named AS (SELECT p.word, min(p.near) AS form FROM pairs p JOIN best b ON p.word = b.word AND p.near_n = b.top GROUP BY p.word),
told AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 5 * w.n THEN m.form END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN named m ON w.word = m.word),
walk AS (SELECT word, word AS at FROM told UNION ALL SELECT k.word, t.form FROM walk k JOIN told t ON k.at = t.word WHERE t.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN told t ON k.at = t.word WHERE t.form IS NULL)
SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON t.word = e.word
"""
