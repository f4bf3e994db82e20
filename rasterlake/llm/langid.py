"""Operator 5: language identification with bit-sliced Bloom filters of character n-grams.

One table of slots holds the Bloom filters of up to 64 languages (one more table for each further 64): bit l of a slot's
word belongs to language l, so one look-up of an n-gram's PROBES slots and an AND give the mask of all languages whose
sample contains it. The number of slots follows from the number of n-grams of the richest language.
A text's hits per language are popcounts of those masks; each language's share is corrected for its own
rate of false positives (the filled share of its slice to the power PROBES).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work
from rasterlake.llm.wordhash import mix

ORDERS = (2, 3, 4)
PROBES, FILLED = 3, 0.25  # a slice's slots are filled to a quarter at most
LEAST_BITS, MOST_BITS = 16, 24  # 2**24 slots hold 1.4 million n-grams a language at a quarter, and more at a higher rate of false positives
MOST_BYTES = 256 << 20  # of all tables, which are broadcast: with over 128 languages, each has fewer slots
SLICE_BITS = 16  # slots that one task packs
TEXT_BYTES = 512 << 10  # of text looked at at once: a worker's arrays take about 70 bytes a byte of text
WORD = 64  # languages a mask word
SAMPLE_PER_LANGUAGE = 4000  # bound of the labelled sample: documents a language, in expectation
UNKNOWN = "und"
FIT_PER_LANGUAGE = 500  # labelled documents a language, in expectation, on which the bound of its evidence is fitted
LEARNED_PART = 0.9  # of the median share of the longest n-grams of a language's labelled documents: text with less is in no learned language

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each order: n-gram hashes of all texts together, and each text's first and last + 1; and
    whether a text has a letter. Lower case; each run of other characters, and a text's ends, is one space."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join([" ", *[t + " " for t in low]]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    stop = np.cumsum(size) + 1
    place = np.concatenate([[0], np.cumsum(keep)])
    count = np.concatenate([[0], np.cumsum(letter)])
    start = stop - size
    has = count[stop] > count[start]
    flat = np.where(letter, code, 32)[keep].astype(np.uint64)
    first, last = place[start] - 1, place[stop]  # the space before a text is part of it
    out = []
    for n in ORDERS:
        m = max(len(flat) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ flat[j : j + m]) * _MUL[j]
        out.append((mix(h), np.minimum(first, m), np.minimum(np.maximum(last - n + 1, first), m)))
    return out, has


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """An n-gram's PROBES slots: steps of its lower half (made odd) from its upper half."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1), hashes >> np.uint64(32)
    return [((high + low * np.uint64(j)) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(PROBES)]


@dataclass
class Model:
    languages: list[str]
    bits: int
    tables: list[np.ndarray]  # of 2**bits masks, one for each WORD languages
    false: np.ndarray  # rate of false positives a language
    bound: np.ndarray  # least share of a text in the language

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares of hits (texts x languages), and whether each text has a letter."""
        share, has, _ = self.counted(texts)
        return share, has

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shares(); whether each text has a letter; and the shares of its longest n-grams alone, which tell its
        languages from others best."""
        found, has = grams(texts)
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, first, last in found:
            a, b, c = slots(h, self.bits)
            own = np.zeros_like(hits)
            for word, table in enumerate(self.tables):
                mask = table[a] & table[b] & table[c]
                for k in range(word * WORD, min(word * WORD + WORD, len(self.languages))):
                    n = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(k % WORD)) & mask.dtype.type(1), dtype=np.int64)])
                    own[:, k] = n[last] - n[first]
            hits += own
            total += last - first
        true = lambda n, of: np.clip((n / np.maximum(of, 1)[:, None] - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        longest = np.where((last > first)[:, None], true(own, last - first), true(hits, total))  # a text of two letters has none
        return true(hits, total), has, longest

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, the corrected share of the text's longest n-grams in it, and whether the text has a letter. The
        share is 0 where it doesn't exceed the language's bound; the other languages have no part in it."""
        share, has, longest = self.counted(texts)
        best = share.argmax(axis=1)
        own = longest[np.arange(len(best)), best]
        return best, np.where(has & (own > np.minimum(self.bound[best], 1 - 1e-9)), own, 0.0), has


def _kind(languages: int) -> type:
    """The smallest mask for so many languages."""
    return np.uint8 if languages <= 8 else np.uint16 if languages <= 16 else np.uint32 if languages <= 32 else np.uint64


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: str = "langid") -> Model:
    """Learns from docs' text and non-null lang. A sample of about per_language documents of each
    language, chosen by a hash of the id and the text (so null and repeated ids are sampled like others), gives the n-grams, every one
    of which enters its language's filter. Spark ORs the masks of each slot, and tasks pack them by ranges of slots; only
    packed tables come to the driver and are broadcast, at most MOST_BYTES. A part of the sample then fits the bounds. All
    languages are learned, however many, as far as a table of LEAST_BITS for each fits; ValueError beyond."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], LEAST_BITS, [], np.zeros(0), np.zeros(0))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000))

    def chosen(most: int) -> Column:
        out = F.lit(False)
        for name in languages:
            out = out | ((F.col("lang") == name) & (part < int(1_000_000 * min(1.0, most / sizes[name])) + 1))
        return out

    number = {name: k for k, name in enumerate(languages)}

    def make():
        def one(c: dict) -> list:
            found, _ = grams(c["text"])
            label = np.array([number[x] for x in c["lang"]], np.int64)
            out: list[list[np.ndarray]] = [[], []]
            for k in set(label.tolist()):
                at = np.flatnonzero(label == k)
                g = np.unique(np.concatenate([h[work.runs((last - first)[at], first[at])] for h, first, last in found]))
                out[0].append(np.full(len(g), k))
                out[1].append(g.view(np.int64))
            return [pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int32(), pa.int64()), strict=True)]

        return one

    held = work.saved(work.map_batches(rows.filter(chosen(per_language)).select("text", "lang"), "lang int, gram long", make, most=TEXT_BYTES).distinct(), "grams")
    most = held.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    kinds = [_kind(min(WORD, len(languages) - k)) for k in range(0, len(languages), WORD)]
    width = sum(np.dtype(k).itemsize for k in kinds)
    room = (MOST_BYTES // width).bit_length() - 1  # the table is broadcast
    if room < LEAST_BITS:
        raise ValueError(f"{len(languages)} languages need larger tables than {MOST_BYTES} bytes")
    bits = min(MOST_BITS, room, max(LEAST_BITS, int(PROBES * most / FILLED - 1).bit_length()))
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF).bitwiseOR(1), F.shiftrightunsigned("gram", 32)
    each = F.explode(F.array(*[(high + low * j).bitwiseAND((1 << bits) - 1).cast("int") for j in range(PROBES)]))
    marks = held.select((F.col("lang") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, lang % {WORD})").alias("mask"), each.alias("slot"))
    marks = marks.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).withColumn("range", F.shiftright("slot", SLICE_BITS))

    def pack(rows: pa.Table) -> pa.Table:
        word, place = rows.column("word")[0].as_py(), rows.column("range")[0].as_py()
        part = np.zeros(1 << SLICE_BITS, kinds[word])
        part[rows.column("slot").to_numpy() & ((1 << SLICE_BITS) - 1)] = rows.column("mask").to_numpy().view(np.uint64).astype(kinds[word])
        return pa.table({"word": pa.array([word], pa.int32()), "range": pa.array([place], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    packed = marks.groupBy("word", "range").applyInArrow(pack, "word int, range int, part binary")
    tables, filled = [np.zeros(1 << bits, k) for k in kinds], np.zeros(len(languages))
    for row in packed.toLocalIterator():
        tables[row.word][row.range << SLICE_BITS : (row.range + 1) << SLICE_BITS] = np.frombuffer(row.part, kinds[row.word])
    for k in range(len(languages)):
        table = tables[k // WORD]
        filled[k] = ((table >> table.dtype.type(k % WORD)) & table.dtype.type(1)).mean()
    model = Model(languages, bits, tables, filled**PROBES, np.zeros(len(languages)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fit():
        def one(c: dict) -> list:
            _, has, share = sent.value.counted(c["text"])
            at = np.flatnonzero(has)
            label = np.array([number[x] for x in c["lang"]], np.int64)[at]
            return [label.tolist(), share[at, label].tolist()]

        return one

    fitted = work.map_batches(rows.filter(chosen(min(per_language, FIT_PER_LANGUAGE))).select("text", "lang"), "lang int, share double", fit, most=TEXT_BYTES).toArrow()
    lang, share = np.asarray(fitted.column("lang")), np.asarray(fitted.column("share"))
    model.bound = np.array([LEARNED_PART * np.median(share[lang == k]) if (lang == k).any() else 0.0 for k in range(len(languages))])
    return model


def _decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best, score, has = model.evidence(texts)
    return [model.languages[k] if h else UNKNOWN for k, h in zip(best.tolist(), has.tolist(), strict=True)], score


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of docs (all columns as they are) whose language is known with a score over least; null texts,
    texts without a letter, texts in no learned language, and all texts where nothing was learned go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[str | None]) -> list[bool]:
        names, score = _decide(sent.value, texts)
        return [n != UNKNOWN and s > least for n, s in zip(names, score.tolist(), strict=True)]

    return work.filter_batches(docs, lambda: good, most=TEXT_BYTES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each whole text. lang_pred has the largest corrected share of the text's n-grams; score is
    its share of the longest ones, and 0 where that is no more than text in another language reaches: lang_pred is only the nearest
    language then, the first by name where there is no hit. Null texts, texts without a letter, and all texts
    where nothing was learned are 'und' with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(c: dict) -> list:
            names, score = _decide(sent.value, c["text"])
            return [c["doc_id"], names, score.tolist()]

        return one

    return work.map_batches(work.pick(docs, "doc_id", "text"), "doc_id long, lang_pred string, score double", make, most=TEXT_BYTES)


def op5_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the folds that aren't held out."""
    docs = work.read(spark, sf_dir, "documents")
    model = train(docs.filter(~work.held_out()))
    return predict(docs, model).select("doc_id", work.held_out().alias("held_out"), "lang_pred", "score")
