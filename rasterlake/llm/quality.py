"""Operator 6: a generalised additive model with pairwise interactions for text quality.

Cyclic boosting: round after round, each feature in turn gets a shallow tree on the current residuals;
the trees of a feature add up to one look-up table over its bins. Pairs of features that still explain
residuals get tables over two features' bins the same way. A score is the logistic of table entries added up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work
from rasterlake.llm.wordhash import Words, window_hashes

SAMPLE_ROWS = 20_000  # bound of the labelled sample, in expectation
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, RATE, LEAST = 150, 0.1, 20
FEATURES = (
    "log_words", "word_length", "longest_word", "symbols", "exclaims", "upper", "digits", "distinct_words", "adjacent_repeats",
    "duplicate_lines", "words_a_line", "ended_lines", "stops", "repeated_windows", "top_word", "non_ascii", "bars",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = {"symbols": _table(b"#*$%&|<>~^=_"), "exclaims": _table(b"!?"), "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))), "digits": _table(b"0123456789"), "stops": _table(b".,;:"), "high": _table(bytes(range(128, 256))), "bars": _table(b"|")}


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each whole text; null and empty texts are zeros."""
    words = Words(texts, lower=True)
    h = words.hashes()
    windows = window_hashes(h, 3)
    size = words.end - words.start
    sums = {k: np.concatenate([[0], np.cumsum(t[words.buf])]) for k, t in _CLASSES.items()}
    n_of = {k: (s[words.doc_end] - s[words.doc_start]).astype(float) for k, s in sums.items()}
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        a, b = int(words.first[i]), int(words.last[i])
        n = b - a
        if not n:
            continue
        own, length = h[a:b], size[a:b]
        _, count = np.unique(own, return_counts=True)
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        twice = 0.0
        if n >= 4:
            _, c = np.unique(windows[a : b - 2], return_counts=True)
            twice = c[c > 1].sum() / (n - 2)
        letters = max(1.0, n_of["upper"][i] + n_of["lower"][i])
        total = float(length.sum())
        out[i] = (
            np.log1p(n), total / n, np.log1p(length.max()), n_of["symbols"][i] / n, n_of["exclaims"][i] / n, n_of["upper"][i] / letters, n_of["digits"][i] / total, len(count) / n,
            float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), n_of["stops"][i] / n, twice, count.max() / n, n_of["high"][i] / total, n_of["bars"][i] / n,
        )
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of bins with gradient sums g and weights w; (0, 0) if there is none."""
    gl, wl = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
    gr, wr = g.sum() - gl, w.sum() - wl
    ok = (wl >= LEAST * 0.02) & (wr >= LEAST * 0.02)
    gain = np.where(ok, gl**2 / (wl + 1) + gr**2 / (wr + 1), -1.0)
    if not len(gain) or gain.max() < 0:
        return 0.0, 0
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (w.sum() + 1)), k + 1


def _tree(g: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Values a bin of a shallow tree on one feature's bins."""
    gain, cut = _best_cut(g, w) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (w.sum() + 1))
    return np.concatenate([_tree(g[:cut], w[:cut], depth - 1), _tree(g[cut:], w[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature, then the second on each side."""
    gain, out = 0.0, np.zeros_like(g)
    _, cut = _best_cut(g.sum(axis=1), w.sum(axis=1))
    for rows in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
        more, place = _best_cut(g[rows].sum(axis=0), w[rows].sum(axis=0))
        gain += more
        for cols in (slice(0, place), slice(place, None)) if place else (slice(None),):
            out[rows, cols] = g[rows, cols].sum() / (w[rows, cols].sum() + 1)
    return gain, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts on rows x and labels y (0 or 1). Without rows, or with one label only, the score is constant."""
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if share * (len(y) + 1) in (0.5, len(y) + 0.5):
        return model
    cuts = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    model.edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    for _ in range(ROUNDS):
        for j, at in enumerate(bins):
            step = RATE * np.clip(_tree(*sums(at, len(model.tables[j])), 2), -4, 4)
            model.tables[j] += step
            total += step[at]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a):
            g, w = sums(coarse[a] * shape[b] + coarse[b], shape[a] * shape[b])
            ranked.append((_pair_tree(g.reshape(shape[a], -1), w.reshape(shape[a], -1))[0], a, b))
    chosen = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in sorted(ranked, reverse=True)[:PAIRS]]
    for _ in range(ROUNDS // 2):
        for a, b, table in chosen:
            at = coarse[a] * shape[b] + coarse[b]
            g, w = sums(at, table.size)
            step = RATE * np.clip(_pair_tree(g.reshape(table.shape), w.reshape(table.shape))[1], -4, 4)
            table += step
            total += step.reshape(-1)[at]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: str = "quality") -> Model:
    """Learns quality from docs' texts and labels (doc_id, quality), on about rows labelled documents chosen
    by a hash of the id. Repeated labels count once (the larger one); null labels or ids aren't used. The
    sample of labels is bounded, so it is broadcast to the scan. One row of features an id comes to the driver, of
    documents that share an id the one whose features sort first, so repeated documents don't add to it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000_000)) < int(1_000_000_000 * rows / n))
    sample = work.pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")

    def make():
        def one(c: dict) -> list:
            return [c["doc_id"], c["quality"], features(c["text"]).tolist()]

        return one

    found = work.map_batches(sample, "doc_id long, quality int, x array<double>", make)
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s")).select("doc_id", "s.quality", "s.x").toPandas().sort_values("doc_id", ignore_index=True)
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each whole text; null texts score as empty ones, repeated rows alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def one(c: dict) -> list:
            return [c["doc_id"], model.score(features(c["text"])).tolist()]

        return one

    return work.map_batches(work.pick(docs, "doc_id", "text"), "doc_id long, score double", make)


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of docs (all columns as they are) whose whole text scores least or more; null texts score as empty ones."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return work.filter_batches(docs, lambda: lambda texts: sent.value.score(features(texts)) >= least)


def op6_pairwise_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels of the folds that aren't held out."""
    docs, labels = work.read(spark, sf_dir, "documents"), work.read(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~work.held_out()))
    return score(docs, model).select("doc_id", work.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
