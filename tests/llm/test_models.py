"""Held-out accuracy on the given tables, and defined results on odd input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm import langid, quality, work

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()))])
ROWS = [(1, "the cat and the dog " * 20, "en", "x"), (2, "le chat et le chien " * 20, "fr", None), (None, "der Hund und die Katze " * 20, "de", None), (4, None, None, None), (5, "", "en", None), (6, "12 34 !!", "en", None), (6, "12 34 !!", "en", None), (7, "the " * 50000, "en", None)]
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@given
def test_language_held_out(spark):
    docs = work.read(spark, SF, "documents")
    got = langid.op5_bitmask_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert got.n > 200 and got.a > 0.97


@given
def test_quality_held_out(spark):
    labels = work.read(spark, SF, "labels")
    got = quality.op6_pairwise_additive_quality(spark, SF).join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert got.n > 80 and got.a > 0.93


def test_language_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    model = langid.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "en"), (2, "fr"), (None, "de"), (4, "und"), (5, "und"), (6, "und"), (6, "und"), (7, "en")]))
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    kept = langid.keep(docs, model, 0.3)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "7", "None"]


def test_masks_hold_every_inserted_gram(spark):
    model = langid.train(spark.createDataFrame(ROWS, SCHEMA))
    share, _ = model.shares(["the the the"])
    assert share[0, 1] > 0.9 and (model.false < 0.01).all()


def test_grams_are_those_of_a_plain_loop():
    texts = ["Ab, c", None, "É1é", ""]
    found, has = langid.grams(texts)
    clean = [" ab c ", "  ", " é é ", "  "]
    for n, (h, first, last) in zip(langid.ORDERS, found, strict=True):
        for t, a, b in zip(clean, first, last, strict=True):
            assert b - a == max(len(" ".join(t.split(" "))) - n + 1, 0) or t == "  "
        assert len(np.unique(h[first[0] : last[0]])) == len({clean[0][i : i + n] for i in range(len(clean[0]) - n + 1)})
    assert has.tolist() == [True, False, True, False]


def test_quality_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((1, 17)))[0] == 0.5
    one = quality.fit(np.zeros((5, len(quality.FEATURES))), np.ones(5))
    assert one.score(np.zeros((1, 17)))[0] > 0.5
    assert quality.keep(docs, one, 0.5).count() == len(ROWS)


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


@given
def test_texts_in_no_learned_language_go(spark):
    r = random.Random(1)
    made = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "consonants": "bcdfghjklmnpqrstvwxz"}
    odd = [(name, " ".join("".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(n))) for name, letters in made.items() for n in [3, 30, *[300] * 20]]
    odd.append(("finnish", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."))
    learned = work.read(spark, SF, "documents").select("doc_id", "text", "lang", F.lit("given").alias("score")).filter("text rlike '[A-Za-z]'")
    for languages in (["de", "en", "es", "fr"], ["en"]):
        docs = learned.filter(F.col("lang").isin(languages))
        model = langid.train(docs)
        both = docs.unionByName(spark.createDataFrame([(k, t, None, name) for k, (name, t) in enumerate(odd)], SCHEMA))
        kept = {x["score"]: x["count"] for x in langid.keep(both, model, 0.3).groupBy("score").count().collect()}
        assert set(kept) == {"given"} and kept["given"] > 0.99 * docs.count()


def test_more_languages_than_bits_of_a_word(spark):
    rows = [(k, " ".join("".join(chr(0x4E00 + 10 * k + (j + i) % 7) for i in range(4)) for j in range(7)) + " ", f"l{k:03}", None) for k in range(70)]
    docs = spark.createDataFrame([(k, t * (5 + k), g, s) for k, t, g, s in rows], SCHEMA)
    model = langid.train(docs)
    assert len(model.languages) == 70
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {k: g for k, _, g, _ in rows}
    assert langid.keep(docs, model, 0.3).count() == 70


def test_language_is_that_of_exact_sets(spark):
    """Against sets of n-grams as strings, without filters, hashes or corrections."""
    r = random.Random(2)
    letters = {"aa": "abcdeé", "bb": "cdefghß", "cc": "aghijk"}
    docs = [(k, " ".join("".join(r.choices(letters[g], k=r.randrange(1, 7))) for _ in range(r.randrange(1, 60))), g, None) for k, g in enumerate(r.choices(sorted(letters), k=150))]
    model = langid.train(spark.createDataFrame(docs, SCHEMA))
    of = lambda t: [w[i : i + n] for w in [" " + " ".join(t.split()) + " "] for n in langid.ORDERS for i in range(len(w) - n + 1)]
    held = {g: {x for _, t, h, _ in docs if h == g for x in of(t)} for g in sorted(letters)}
    fresh = [(k, " ".join("".join(r.choices(letters[r.choice(sorted(letters))] if k % 3 else letters[g], k=r.randrange(1, 7))) for _ in range(r.randrange(1, 40))), g, None) for k, g in enumerate(r.choices(sorted(letters), k=200))]
    share, _ = model.shares([t for _, t, _, _ in fresh])
    for (_, t, _, _), row in zip(fresh, share, strict=True):
        exact = [sum(x in held[g] for x in of(t)) / len(of(t)) for g in sorted(letters)]
        assert np.abs(np.array(exact) - row).max() < 0.05
    for (_, t, g, _), row in zip(docs, model.shares([t for _, t, _, _ in docs])[0], strict=True):
        assert row[sorted(letters).index(g)] == 1  # a mask names every language that contains the n-gram


def test_equal_languages_tie_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "one two three", "b", None), (2, "one two three", "a", None)], SCHEMA)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {"a"}


def plain_features(text):
    """One text's features by plain loops."""
    import math
    import re

    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if not n:
        return [0.0] * len(quality.FEATURES)
    size = [len(w.encode()) for w in words]
    count = {w: words.count(w) for w in set(words)}
    spans = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    of = lambda chars: sum(text.count(c) for c in chars)
    upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
    high = sum(len(c.encode()) for c in text if ord(c) > 127)
    return [
        math.log1p(n), sum(size) / n, math.log1p(max(size)), of("#*$%&|<>~^=_") / n, of("!?") / n, upper / max(1, upper + lower), of("0123456789") / sum(size), len(count) / n,
        sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(x[-1] in ".!?" for x in lines) / len(lines),
        of(".,;:") / n, sum(spans.count(s) > 1 for s in spans) / (n - 2) if n >= 4 else 0, max(count.values()) / n, high / sum(size), of("|") / n,
    ]


@given
def test_quality_scores_are_those_of_plain_loops(spark):
    """Features by loops over characters and words, and the score as a plain sum of look-ups."""
    docs = work.read(spark, "/root/testdata/sf0.001", "documents")
    model = quality.train(docs, work.read(spark, "/root/testdata/sf0.001", "labels"))
    want = {}
    for r in docs.collect():
        x = plain_features(r.text)
        place = lambda edges, v: sum(e <= v for e in edges)
        total = model.base + sum(t[place(e, x[j])] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        total += sum(t[place(model.pair_edges[a], x[a])][place(model.pair_edges[b], x[b])] for a, b, t in model.pairs)
        want[r.doc_id] = 1 / (1 + np.exp(-total))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_best_cut_is_that_of_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(50):
        g, w = rng.normal(size=9), rng.random(9) * 3
        gain, cut = quality._best_cut(g, w)
        every = {k: g[:k].sum() ** 2 / (w[:k].sum() + 1) + g[k:].sum() ** 2 / (w[k:].sum() + 1) - g.sum() ** 2 / (w.sum() + 1) for k in range(1, 9) if min(w[:k].sum(), w[k:].sum()) >= quality.LEAST * 0.02}
        assert cut == max(every, key=every.get) and abs(gain - every[cut]) < 1e-9


def test_repeated_documents_don_t_add_to_the_sample(spark):
    docs = spark.createDataFrame([(1, "good words here.", None, None)] * 50 + [(2, "## bad", None, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = quality.train(docs.dropDuplicates(), labels)
    many = quality.train(docs, labels)
    assert many.base == once.base and all((a == b).all() for a, b in zip(many.tables, once.tables, strict=True))


def test_null_ids_are_sampled_like_others(spark):
    rows = [(None, f"some english words number{k} here and there", "en") for k in range(1500)] + [(7, f"einige deutsche wörter nummer{k} hier und dort", "de") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, per_language=100)
    got = langid.predict(spark.createDataFrame([(1, "some words here"), (2, "einige wörter dort")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "en", 2: "de"}
    assert all(0 < f < 0.1 for f in model.false)


def test_tables_have_a_size_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"text {k} of some words", f"l{k % 3}") for k in range(30)], "doc_id long, text string, lang string")
    whole = langid.train(df)
    monkeypatch.setattr(langid, "MOST_BYTES", 1 << langid.LEAST_BITS)
    small = langid.train(df)
    assert small.bits == langid.LEAST_BITS and sum(t.nbytes for t in small.tables) <= langid.MOST_BYTES and (small.tables[0] == whole.tables[0]).all() == (whole.bits == small.bits)
    monkeypatch.setattr(langid, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="larger tables"):
        langid.train(df)
