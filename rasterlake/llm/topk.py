"""Operator 8: exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm import work

SCALE, TOP = 1024, 10
QUERY_EVERY = 100
QUERY_BLOCK = 4096  # queries that are sent to the executors at once, about 2 MB
SCORE_ROWS, SCORE_QUERIES = 4096, 128  # the dense score array, 4 MB
#: Weights from this on don't fit a long and are computed as whole numbers of any size.
MAX_WEIGHT = float(1 << 63)
#: Products up to this are summed as longs, with room for the rounding of the estimate; others as whole numbers of any size.
SAFE = float(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part: those with an id and a vector whose
    components are all finite numbers. Other columns aren't read."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)


def _weights(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs; 0 in rows where one doesn't fit."""
    with np.errstate(over="ignore"):
        w = np.floor(x * SCALE)
    large = (np.abs(w) >= MAX_WEIGHT).any(axis=1) if w.size else np.zeros(len(w), bool)
    w[large] = 0
    return w.astype(np.int64)


def _whole(x: np.ndarray) -> list[int]:
    """floor(SCALE * x) as whole numbers of any size."""
    return [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.tolist()]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of components; missing trailing ones are 0."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    out = np.zeros((len(column), width), np.float64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    fits = at < width
    out[row[fits], at[fits]] = values[offsets[0] : offsets[-1]][fits]
    return out


def _exact(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, vec: np.ndarray, y: np.ndarray) -> np.ndarray:
    """scores (queries x candidates), with those that may have left the long range computed again as whole
    numbers of any size; the array holds Python numbers then."""
    with np.errstate(over="ignore"):
        query, row = (np.abs(x) * SCALE + 1).sum(axis=1), (np.abs(y) * SCALE + 1).max(axis=1, initial=0)
        if query.max(initial=0) * row.max(initial=0) < SAFE:
            return scores
        again = np.argwhere((np.outer(query, row) >= SAFE) & (ids[:, None] != vec[None, :])).tolist()
    scores = scores.astype(object)
    mine, theirs = ({k: _whole(v[k]) for k in {p[side] for p in again}} for side, v in enumerate((x, y)))
    for i, j in again:
        scores[i, j] = sum(a * b for a, b in zip(mine[i], theirs[j], strict=True))
    return scores


def _select(score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id; every row tied with the k-th is looked at."""
    if score.dtype == object:
        order = sorted(range(len(score)), key=lambda i: (-score[i], vec[i]))[:k]
        return score[order], vec[order]
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        score, vec = score[near], vec[near]
    order = np.lexsort((vec, -score))[:k]
    return score[order], vec[order]


def _columns(scores: list) -> tuple[list, list, list]:
    """Each score as a long (null where it doesn't fit), its size class (0: it fits; else its digits, below 0 for
    negative scores), and its digits where it doesn't fit."""
    fits = [-(1 << 63) <= v < 1 << 63 for v in scores]
    digits = [None if f else str(abs(v)) for v, f in zip(scores, fits, strict=True)]
    return [v if f else None for v, f in zip(scores, fits, strict=True)], [0 if d is None else len(d) if v > 0 else -len(d) for v, d in zip(scores, digits, strict=True)], digits


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score, digits: each query's k best candidates other than rows of its own id.

    Both tables have vec_id and embedding, as usable() makes them. Queries go to the executors in blocks of
    bounded size, one pass over the candidates each. In a task, a slice of candidates becomes postings by
    component; the queries' non-zero weights scatter them, term by term, into a dense score array, of which
    each query's k best stay. Repeated ids are rows of their own, as
    queries (each has its k best and its ranks) and as candidates. Scores and
    ranks are exact whatever the components' size; score is null where it doesn't fit a long, and digits (a text,
    without its sign) is null where it does."""
    spark = candidates.sparkSession
    passes = []
    block: list = []

    def one_pass(rows: list, first: int) -> DataFrame:
        width = max((len(r.embedding) for r in rows), default=0)
        ids = np.array([r.vec_id for r in rows], np.int64)
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r.embedding)] = r.embedding
        sent = spark.sparkContext.broadcast((ids, x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = sent.value
            weights = _weights(x.copy())
            terms = [np.flatnonzero(weights[:, t]) for t in range(weights.shape[1])]
            best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
            for batch in batches:
                for at in range(0, batch.num_rows, SCORE_ROWS):
                    part = batch.slice(at, SCORE_ROWS)
                    vec = np.asarray(part.column(0))
                    y = _matrix(part.column(1), weights.shape[1])
                    rows = _weights(y)
                    postings = [np.flatnonzero(rows[:, t]) for t in range(rows.shape[1])]
                    for q in range(0, len(ids), SCORE_QUERIES):
                        scores = np.zeros((min(SCORE_QUERIES, len(ids) - q), len(vec)), np.int64)
                        for t, where in enumerate(postings):
                            use = terms[t][(terms[t] >= q) & (terms[t] < q + SCORE_QUERIES)]
                            if len(use) and len(where) == len(vec):
                                scores[use - q] += np.outer(weights[use, t], rows[:, t])
                            elif len(use) and len(where):
                                scores[np.ix_(use - q, where)] += np.outer(weights[use, t], rows[where, t])
                        scores = _exact(scores, ids[q : q + SCORE_QUERIES], x[q : q + SCORE_QUERIES], vec, y)
                        for j, score in enumerate(scores):
                            other = vec != ids[q + j]
                            s, v = _select(score[other], vec[other], k)
                            best[q + j] = _select(np.concatenate([best[q + j][0], s]), np.concatenate([best[q + j][1], v]), k)
            n = [len(s) for s, _ in best]
            if sum(n):
                score, size, digits = _columns([v for s, _ in best for v in s.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(first + np.repeat(np.arange(len(ids)), n)), pa.array(np.repeat(ids, n)), pa.array(np.concatenate([v for _, v in best])), pa.array(score, pa.int64()), pa.array(size, pa.int32()), pa.array(digits, pa.string())], ["query", "query_id", "vec_id", "score", "size", "digits"])

        found = candidates.mapInArrow(run, "query long, query_id long, vec_id long, score long, size int, digits string")
        # of scores beyond the long range, more digits are farther from 0, and so are larger digits of one length
        order = Window.partitionBy("query").orderBy(F.desc("size"), F.desc(F.when(F.col("size") > 0, F.col("digits"))), F.when(F.col("size") < 0, F.col("digits")), F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "digits")

    asked = 0
    for row in queries.select("vec_id", "embedding").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            passes.append(work.saved(one_pass(block, asked), "topk"))
            asked, block = asked + len(block), []
    passes.append(one_pass(block, asked))
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def op8_term_at_a_time_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector among all others."""
    vectors = usable(work.read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0)).drop("digits")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
