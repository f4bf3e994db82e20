"""Operator 12 against plain slicing of strings."""

import hashlib

import numpy as np
import pytest

from rasterlake.llm import fim

PARTS = ["a", "é", "日本", "😀", "<", "P", "S>", "M", "plain words ", "\n", "<P", "x" * 40]


def plain(doc_id, text):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    return n, form, *((None, None) if form == "plain" else (a, b - a)), out


def texts():
    r = np.random.default_rng(5)
    some = ["".join(r.choice(PARTS) for _ in range(int(r.integers(0, 90)))) for _ in range(300)]
    some += ["", None, "<P>", "y" * 255, "y" * 256, "é" * 128, "z" * 254 + "<M>" + "z" * 300, "<S" * 500, "<" * 700 + "S>", "é" * 3000, "日" * 255 + "<P>", "same", "same"]
    return [*enumerate(some), (None, "a text without an id"), (None, None), (2**60 + 1, "b" * 600)]


@pytest.mark.parametrize(("giant", "chunk"), [(1 << 16, 1 << 14), (100, 7), (0, 64), (300, 513)])
def test_equals_slicing(spark, giant, chunk):
    rows = texts()
    df = spark.createDataFrame([(k, x, "clash", 1) for k, x in rows], "doc_id long, text string, form string, h1 int")
    got = fim.fill_in_middle(df, giant, chunk).withColumn("again", fim.restored()).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    for r, (k, x) in zip(sorted(got, key=lambda r: key((r.doc_id, r.text))), sorted(rows, key=key), strict=True):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(k, x)
        assert r.again == (x or "")
    assert fim.fill_in_middle(df.limit(0), giant, chunk).count() == 0


def test_stretches_compose_from_every_state():
    """Functions of parts, composed, are the function of the whole, also where a part starts inside a character or a mark."""
    data = np.frombuffer(("é日😀<P<S" * 60 + "<M>" + "x" * 300).encode(), np.uint8)
    for machine in (fim.UNITS, fim.SENTINELS):
        whole = fim.functions(machine, np.vstack([data[:, None].astype(int)]))
        for cut in (1, 2, 5, 333, len(data) - 1):
            (e1, u1), (e2, u2) = (fim.functions(machine, part[:, None].astype(int)) for part in (data[:cut], data[cut:]))
            e, u = fim.composed(np.vstack([e1, e2]), np.vstack([u1, u2]), np.zeros(2, int))
            assert (e[1] == whole[0][0]).all() and (u[1] == whole[1][0]).all()
    assert fim.functions(fim.UNITS, data[:, None].astype(int))[1][0, 0] == len(data.tobytes().decode())


def test_query(spark, tmp_path):
    rows = [(k, x) for k, x in texts()] + [(77_000, "long é text " * 9000), (77_001, "<P" * 50_000 + ">")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = sorted(repr((k, *plain(k, x)[:4], sha(plain(k, x)[4]), sha(x))) for k, x in rows)
    assert sorted(repr(tuple(r)) for r in fim.op12_automaton_fill_in_middle(spark, str(tmp_path)).collect()) == want
