"""The join against brute force: every pair of sets, whatever the candidate search does."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from rasterlake.llm import jaccard
from rasterlake.llm.wordhash import shingle_sets

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h1", T.StringType()), T.StructField("node", T.LongType())])


def words(text, k):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if len(out) >= k:
        return {tuple(out[i : i + k]) for i in range(len(out) - k + 1)}
    return {tuple(out)} if out else set()


def brute(rows, k, num, den):
    sets = [words(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, groups=6, size=12, common=True):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=30)
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 8, 40, 90, 200]))
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 30))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            if common and r.random() < 0.4:
                t += passage
            rows.append(" ".join(x.upper() if r.random() < 0.1 else x for x in t))
    rows += [None, "", " \n", "one", "ONE", "a b c", "a b  c", "é à ü o", "É à ü o"]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def run(spark, rows, k=4, num=85, den=100, **caps):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA)
    got = jaccard.jaccard_components(df, k, num, den, **caps).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows, 4, 85, 100)


def test_split_classes(spark, monkeypatch):
    """Tiny units: classes are split, anchors and the second round must find the rest."""
    monkeypatch.setattr(jaccard, "ANCHORS", 2)
    rows = corpus(2, groups=3, size=40)
    assert run(spark, rows, 5, 80, 100, unit_sets=6, unit_tokens=10**9) == brute(rows, 5, 80, 100)


def test_edges(spark):
    """Null ids and texts, repeated rows, repeated ids with other texts, one long text."""
    long = " ".join(f"v{i % 5000}" for i in range(60000))
    rows = [(None, "p q r s t"), (3, "p q r s t"), (None, "lone text of nobody here"), (7, "x y z"), (7, "x y z"), (7, "other words under this id"), (9, long), (8, long + " end"), (1, None), (2, "")]
    got = run(spark, rows)
    assert got == brute(rows, 4, 85, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signatures_meet():
    """Linked sets share a signature, whatever tokens are frequent."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        limit = jaccard.Threshold(num, den)
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 2**62, int(rng.integers(0, 2)), dtype=np.uint64)))
                inter = len(np.intersect1d(a, c))
                if den * inter < num * (len(a) + len(c) - inter) or len(c) < 2:
                    break
                b = c
            if len(a) < 2 or np.array_equal(a, b):
                continue
            share = rng.random()
            mark = lambda s, share=share: (jaccard.mix(s) >> np.uint64(11)).astype(float) / 2**53 < share
            both = np.intersect1d(a, b)
            x, y = (jaccard.signatures(s, np.isin(s, both), mark(s) & np.isin(s, both), limit) for s in (a, b))
            assert len(np.intersect1d(x[0], y[0])) + len(np.intersect1d(x[1], y[1]))


def test_low_similarity_is_refused():
    with pytest.raises(ValueError):
        jaccard.Threshold(1, 2)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "q r s t u v"), (4, None), (4, " "), (None, "n o p q r s t"), (None, "n o p q r s t")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA)
    got = jaccard.keep_one(df, 5, 80, 100)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "").strip()) for r in got.collect()) == [("2", "a b c d e f g h"), ("4", ""), ("4", ""), ("9", "q r s t u v"), ("None", "n o p q r s t")]


def second_round(spark, monkeypatch, rows, unit_sets):
    """Components, and the texts that each round sends to verification."""
    sent, verify = [], jaccard._verify

    def counted(units, texts, k, *rest):
        sent.append(jaccard._only_keys(texts, units, k).join(units, ["key", "h1", "h2"]).count())
        return verify(units, texts, k, *rest)

    monkeypatch.setattr(jaccard, "_verify", counted)
    got = run(spark, rows, 4, 85, 100, unit_sets=unit_sets, unit_tokens=10**9)
    monkeypatch.setattr(jaccard, "_verify", verify)
    return got, sent


def test_overlapping_excerpts_grow_in_proportion(spark, monkeypatch):
    """A chain of excerpts is one candidate class without a link: what is compared follows the overlaps."""
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    made = {n: [(k, " ".join(words[6 * k : 6 * k + 40])) for k in range(n)] for n in (150, 300)}
    counts = {}
    for n, rows in made.items():
        got, counts[n] = second_round(spark, monkeypatch, rows, 12)
        assert got == brute(rows, 4, 85, 100) and len(counts[n]) == 2
    assert sum(counts[300]) < 2.5 * sum(counts[150])


def test_null_ids_grow_in_proportion(spark, monkeypatch):
    r = random.Random(7)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    base = [text() for _ in range(20)]
    rows = [(None, b + " " + f"end{k}") for k in range(6) for b in base] + [(None, base[0])] * 40 + [(5, base[1])] * 40
    got, sent = second_round(spark, monkeypatch, rows, 4096)
    assert got == brute(rows, 4, 85, 100) and 122 <= sent[0] < 140  # a row for each text that a link is sought for, and repeated ones once a task


def test_keep_one_of_blank_texts(spark):
    """Texts without words link with nothing: every row stays, with or without an id."""
    rows = [(1, ""), (1, " "), (1, None), (None, None), (None, ""), (None, " \n"), (1, ""), (2, "a b c d e f")]
    got = jaccard.keep_one(spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA), 5, 80, 100).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(map(repr, rows))


def test_shingles_of_short_texts():
    assert [len(s) for s in shingle_sets([None, "", "a", "a b c", "a b c d", "a b c d e"], 4)] == [0, 0, 1, 1, 1, 2]


def test_keep_one_with_clashing_names(spark):
    names = ["copies", "k0", "k1", "__key", "__H1", "__h2", "component_id", "lone", "node", "___k2"]
    text = "a b c d e f g h i j"
    rows = [(1, text, *names), (1, text, *names), (2, text + " k", *names), (3, "other words that link with nothing at all", *names), (None, "", *names)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    got = jaccard.keep_one(spark.createDataFrame(rows, schema), 5, 80, 100)
    assert got.columns == ["doc_id", "text", *names]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[4]]))


def test_a_token_of_every_document_is_one_entry_a_slice(spark, monkeypatch):
    """Counts are right, and what a slice sends for a token doesn't grow with its documents."""
    monkeypatch.setattr(jaccard, "COUNT_PIECE", 50)
    docs = spark.createDataFrame([(k, "the very same words " + " ".join(f"w{k}x{j}" for j in range(3))) for k in range(600)], "doc_id long, text string").coalesce(1)
    frequent, _ = jaccard.token_classes(docs, 4, 3000)
    assert len(frequent) == 1
    fp, n = jaccard.summed([(np.array([1, 5], np.uint64), np.array([2, 1])), (np.array([0, 5], np.uint64), np.array([1, 7]))])
    assert fp.tolist() == [0, 1, 5] and n.tolist() == [1, 2, 8]
