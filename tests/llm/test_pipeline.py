"""run() against a version that uses plain loops over the same models."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from rasterlake.llm import langid, quality, work
from tests.llm.test_jaccard import words

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()))])


def corpus():
    rng = np.random.default_rng(7)
    en, fr = ["the", "and", "of", "with", "thing", "other", "water", "house", "north", "which"], ["le", "les", "une", "eau", "maison", "avec", "pour", "chez", "nous", "leur"]
    texts = []
    for k in range(60):
        w = rng.choice(en if k % 2 else fr, 70)
        texts.append((" ".join(w) + ".", "en" if k % 2 else "fr", 1))
    texts += [(texts[3][0] + " End of it.", "en", 1), (texts[3][0], "en", 1), (texts[8][0], "fr", 1)]
    texts += [(" ".join(f"{x}###" for x in rng.choice(en, 60)), "en", 0) for _ in range(40)]
    texts += [(None, "en", 0), ("", None, 0), ("12 34. " * 30, "en", 1), ("water house " * 3000, "en", None)]
    return [(k, t, g, "s", len(t or ""), "clash") for k, (t, g, _) in enumerate(texts)], [(k, q, 0) for k, (_, _, q) in enumerate(texts)]


def test_run_equals_plain_loops(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = work.read(spark, str(tmp_path), "documents")
    model = quality.train(docs, work.read(spark, str(tmp_path), "labels").filter(~work.held_out()))
    kept = [r for r in rows if model.score(quality.features([r[1]]))[0] >= 0.5]
    tongue = langid.train(spark.createDataFrame(kept, SCHEMA))
    named = [langid._decide(tongue, [r[1]]) for r in kept]
    kept = [r for r, (n, s) in zip(kept, named, strict=True) if n[0] != "und" and s[0] > corpus_pipeline.LEAST_LANGUAGE]
    sets = [words(r[1], 5) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = [r for i, r in enumerate(kept) if group[i] == i]
    assert 40 < len(kept) < 64

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for r in kept:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "best_fit_packing"]


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == none.columns
