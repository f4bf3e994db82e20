"""BPE, token shards and packing against the tokenizers library and plain arithmetic."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rasterlake.llm import bpe, chunks, encoding, packing, rans

ODD = [
    None, "", " ", "a ", "  a  b\n c \n\n  d's 12 x", "\n x\n", "é <|endoftext|> foo<|endoftext|>bar  ", "<|startoftext|>", " x 　 y", "DON'T we'll \x1c x ́y ß İ Σ", " \x1cq", "漢字かな交じり文 テスト", "a" * 1000 + " " + "ab" * 700,
    "x́" * 20, "🙂🙃 o🙂k", "١٢٣ ²³ Ⅷ", "= " * 10 + "=" * 300, "same same same", "same same same", "tab\tand\x0bvt\x0cff", "''s 're", "\x00nul \x7f", "ǅ ﬁ Å",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("part", T.StringType())])


def rows(texts):
    return [(k, t, "clash", None) for k, t in enumerate(texts)]


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def more():
    r = np.random.default_rng(3)
    parts = ["the", "ing", "sch", "eau", "ción", "XY", "'s", "12", "--", "é", "ß", "\n", "  ", "q", "zz", "ñ", "|", "***"]
    return ["".join(r.choice(parts) + ("" if r.random() < 0.5 else " ") for _ in range(int(r.integers(1, 60)))) for _ in range(300)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(name):
    texts = ODD + more()
    _, want = library(name, texts)
    path = public_tokenizers.path(name)
    for encoder in (bpe.loaded(path)[1], chunks.ChunkEncoder(*chunks.library_resolver(path), cap=50)):
        for part in (texts, texts[::-1], texts[:40]):  # the small cache starts anew between batches
            flat, counts = encoder(part)
            ends = np.cumsum(counts)
            assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [want[texts.index(t)] for t in part]


def test_speculation_needs_verification():
    """Greedy tokens alone are wrong for some words; verified and merged ones never are."""
    b = bpe.SpeculativeBPE(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for w in {w for t in more() for w in t.lower().split() if w.isascii() and w.isalpha()}]
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    symbols[end - 1] += 256
    greedy, n = b.propose(symbols, end - size, end)
    ids, m = b.encode_words(words)
    assert not np.array_equal(greedy, ids)
    assert b.merge_long(b.base[symbols[: size[0]]]).tolist() == ids[: m[0]].tolist()


def test_op9_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, want = library("word_bpe_49k.json", ODD)
    df = spark.createDataFrame(rows(ODD), SCHEMA)
    got = {r.doc_id: r for r in encoding.round_trip(df, path).collect()}
    assert [got[k].ids for k in range(len(ODD))] == want
    assert [got[k].text for k in range(len(ODD))] == [t.decode(i, skip_special_tokens=False) for i in want]
    again = {r.doc_id: r.text for r in encoding.decode_ids(encoding.encode_texts(df, path), path).collect()}
    assert again == {k: r.text for k, r in got.items()}
    assert encoding.round_trip(df.limit(0), path).count() == 0


def test_op9_query(spark, tmp_path):
    spark.createDataFrame(rows(ODD), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    t, want = library("word_bpe_49k.json", ODD)
    for r in encoding.op9_speculative_bpe(spark, str(tmp_path)).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 255, 257, 70_000, 600_000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    docs, counts = ([None, 4, 4][: min(n, 3)], np.array([n - 2 * (n > 2), 1, 1][: min(n, 3)]) if n > 2 else np.array([n] * min(n, 1)))
    docs = docs[: len(counts)]
    payload = rans.encode_shard(ids, docs, counts, 11)
    got = rans.decode_shard(payload)
    assert np.array_equal(got[0], ids) and got[1] == docs and got[2].tolist() == counts.tolist() and got[3] == 11
    if n:
        broken = bytearray(payload)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode_shard(bytes(broken))


def test_shards_are_near_entropy():
    ids = np.random.default_rng(0).choice(64, 500_000, p=np.arange(1, 65) / 2080).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids)
    assert len(rans.encode_shard(ids, [1], np.array([len(ids)]))) * 8 < 1.12 * bits


def test_op2_files(spark, tmp_path):
    texts = ODD + more()
    data = [(None if k == 3 else k, t, "clash", None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rans.write_token_shards(df, str(tmp_path / "shards"), path, shard_tokens=2000)
    got = rans.read_token_shards(spark, str(tmp_path / "shards")).orderBy("start").collect()
    order = sorted(range(len(texts)), key=lambda k: (k != 3, k))
    _, want = library("byte_bpe_50k.json", texts)
    at = 0
    for r, k in zip(got, order, strict=True):
        ids = np.array([*want[k], 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (data[k][0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rans.write_token_shards(df.limit(0), str(tmp_path / "none"), path)
    assert rans.read_token_shards(spark, str(tmp_path / "none")).count() == 0


def test_packing_places(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, *more(), "word " * 5000]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = packing.pack_documents(df, path, 256).collect()
    _, want = library("word_bpe_49k.json", texts)
    whole: dict = {}
    sequences: dict = {}
    for r in got:
        assert 1 <= r.length <= 256
        whole.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, ids in enumerate(want):
        ids = np.array([*ids, 0], "<u4")
        parts = sorted(whole[k], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in parts] == [(a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for a in range(0, len(ids), 256)]
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(len(i) + 1 for i in want)
    assert len(sequences) <= -(-total // 256) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_sum_of_squares_rule():
    """Each choice is the one that a plain search over open gaps makes."""
    lengths = np.sort(np.random.default_rng(2).integers(1, 40, 300))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 50)
    gaps: dict[int, int] = {}
    for n, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        squares = {}
        for g in {g for g in gaps.values() if g >= n}:
            count = {}
            for x in [*gaps.values(), g - n]:
                count[x] = count.get(x, 0) + 1
            count[g] -= 1
            squares[g] = sum(v * v for x, v in count.items() if x)
        if b not in gaps:
            assert not squares and at == 0
            gaps[b] = 50
        else:
            assert squares[gaps[b]] == min(squares.values()) and at == 50 - gaps[b]
        gaps[b] -= n


def test_many_special_tokens_and_long_words():
    """Thousands of special tokens side by side, and words of a million letters, equal the library."""
    r = np.random.default_rng(9)
    letters = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    texts = ["<|endoftext|>" * 3000, "a<|endoftext|>b" * 1500 + "<|startoftext|>", letters, "ab" * 500_000, "x" * 100_001, "QUJD" * 5000 + letters[:3000] + " " + letters[:700]]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        _, want = library(name, texts)
        flat, counts = bpe.loaded(public_tokenizers.path(name))[1](texts)
        ends = np.cumsum(counts)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want


def test_packing_deals_out_repeated_and_null_ids(spark):
    pieces = spark.createDataFrame([(None, 0, 100)] * 400 + [(7, 0, 100)] * 400, "doc_id long, piece int, length long")
    got = packing.pack_lengths(pieces, 1000, 100).toPandas()
    assert len(got) == 800 and (got["sequence_id"] // (1 << 40)).value_counts().max() < 200
    for _, one in got.groupby("sequence_id"):
        assert sorted(one["offset"]) == [100 * k for k in range(len(one))] and len(one) <= 10


def test_failing_words_are_merged_in_pieces(monkeypatch):
    """More symbols of failing words than a long has room for beside the rank; and one huge word."""
    r = np.random.default_rng(9)
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = r.integers(97, 123, (1_150_000, 8), np.uint8)
    text = " ".join(map(bytes.decode, map(bytes, letters)))
    huge = bytes(r.integers(97, 123, 300_000, np.uint8)).decode()
    _, want = library("word_bpe_49k.json", [text, huge])
    flat, counts = bpe.SpeculativeBPE(path).encode_words([bytes(x[:-1]) + bytes(x[-1:]) for x in letters])
    assert np.array_equal(flat, want[0]) and len(counts) == len(letters)
    assert bpe.loaded(path)[1]([huge])[0].tolist() == want[1]
    monkeypatch.setattr(bpe, "MERGED_AT_ONCE", 20)
    some = [bytes(x) for x in letters[:500]]
    assert bpe.SpeculativeBPE(path).encode_words(some)[0].tolist() == flat[: counts[:500].sum()].tolist()


def test_packing_keeps_ids_beside_null(spark):
    rows = [(2**60 + 1, 0, 5), (None, 0, 7), (None, 0, None), (3, 0, 0), (2**60 + 1, 0, 5)]
    got = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 10).collect()
    assert sorted(repr((r.doc_id, r.piece, r.length)) for r in got) == sorted(map(repr, rows))
    assert all((r.sequence_id is None) == (not r.length) for r in got)
    docs = spark.createDataFrame([(2**60 + 1, "one two"), (None, "three"), (None, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()} == {2**60 + 1, None}


def test_shards_spread_null_ids(spark, tmp_path):
    texts = [f"text number {k}" for k in range(400)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rans.write_token_shards(df, str(tmp_path / "s"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "s")).select("part").distinct().count() > 1
    got = rans.read_token_shards(spark, str(tmp_path / "s")).orderBy("start").collect()
    _, want = library("byte_bpe_50k.json", texts)
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*x, 0], "<u4").tobytes() for x in want)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_a_column_asks_the_cache_once_a_distinct_piece():
    texts = [*ODD, *more(), None, "", " ", "  two  spaces ", " lead", "end ", "a  b", "a \x1cb", "tab\t x", "x\n y", "same words same words"] * 3
    name = "byte_bpe_50k.json"
    encoder = chunks.ChunkEncoder(*chunks.library_resolver(public_tokenizers.path(name)))
    _, want = library(name, texts)
    for part in (texts, texts[:1], [None], [], texts[::-1], [t for t in texts if t and "  " in t]):
        order = {t: w for t, w in zip(texts, want, strict=True)}
        for column in (pa.array(part, pa.string()), pa.array(["cut", *part], pa.large_string()).slice(1)):
            flat, counts = encoder.column(column)
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])][: len(part)] == [list(order[t]) for t in part]
    asked = []

    class Counting(type(encoder.known)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.known.__class__ = Counting
    flat, counts = encoder.column(pa.array(["one two two two one"] * 500))
    assert len(asked) == 500 + 2  # the first word of each text, which has no space before it, and two others
    again, same = encoder(["one two two two one"] * 500)
    assert np.array_equal(flat, again) and np.array_equal(counts, same)
