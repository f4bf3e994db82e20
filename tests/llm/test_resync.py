"""Operator 11 against the tokenizers library on whole texts."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterlake.llm import resync

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", "ing", " ", "  ", "\n", "'ll", "'s", "é", "日本", "😀", "<|endoftext|>", "<|endof", "12", "--", "   \n ", "x" * 90, "'", "y "]


def texts():
    r = np.random.default_rng(1)
    mixed = lambda n: "".join(r.choice(PARTS) for _ in range(n))
    hard = [
        None, "", "a b", mixed(400), mixed(2000), "x" * 5000, " " * 5000, mixed(50) + "z" * 3000 + mixed(60) + " " * 700 + mixed(100) + "日" * 900, "<|endoftext|>" * 200,
        "é" * 1500 + " " + "b" * 1500, mixed(100) + "q" * 2000, "'s" * 1000, "a " * 1500, "q" * 900 + mixed(300), "q" * 900 + mixed(300),
    ]
    return [*enumerate(hard), (None, mixed(1000)), (None, None), (2**60 + 1, mixed(1500))]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    return sorted((str(k), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in rows)


@pytest.mark.parametrize(("step", "overlap"), [(128, 32), (1024, 64)])
def test_equals_library(spark, step, overlap):
    rows = texts()
    df = spark.createDataFrame([(k, x, "clash", 7, 1) for k, x in rows], "doc_id long, text string, row string, k int, n_tokens int")
    got = resync.token_counts(df, PATH, step, overlap).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected(rows)
    assert max(r.n_chunks for r in got) > 4
    assert resync.token_counts(df.limit(0), PATH, step, overlap).count() == 0


def test_overlaps_are_widened_and_chunks_left_out(spark, monkeypatch):
    """A word of more than an overlap asks for a wider one, a word of several chunks for their removal."""
    asked = []
    widened = resync._widened

    def spy(huge, links, tokenizer):
        asked.extend((r.b is None, r.width, r.b is not None and r.b - r.a > 3 * 128) for r in links.collect())
        return widened(huge, links, tokenizer)

    monkeypatch.setattr(resync, "_widened", spy)
    rows = [(0, "ab " * 40 + "x" * 60 + " cd" * 60), (1, "ab " * 40 + "y" * 2000 + " ef" * 60), (2, "ab " * 30 + "z" * 2000), (3, "plain words " * 90)]
    got = resync.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 128, 32).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected(rows)
    assert {(False, 128, False), (False, 32, True), (True, 0, False)} <= set(asked)


def test_common_token_borders_are_not_proof():
    """Chunks may share the border of a token inside a word; only word starts are used."""
    words = resync.WordEncoder(PATH)
    (_, at, _), = words(["say  <|endoftext|> it's"])
    assert at.tolist() == [0, 3, 5, 18, 21]


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="normaliser"):
        resync.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    made = json.load(open(PATH))
    made["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match="neighbours"):
        resync.WordEncoder(str(tmp_path / "t.json"))


def test_query(spark, tmp_path):
    rows = [(1, "word " * 1100), (2, None), (3, "é" * 40_000), (4, "some words and 'll " * 4000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = resync.op11_overlap_token_counts(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
