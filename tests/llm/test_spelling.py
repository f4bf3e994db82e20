"""Operator 13 against plain counting and all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np

from rasterlake.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def texts():
    r = np.random.default_rng(2)
    letters = list("abcdeéÉßÿ")
    base = ["".join(r.choice(letters) for _ in range(int(r.integers(6, 12)))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abcabcabc", "Colour", "COLOURS", "colors"]
    rows = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = list(base[min(int(r.exponential(4)), len(base) - 1)])
            p, what = int(r.integers(0, len(w))), r.random()
            if what < 0.04:
                w.insert(p, str(r.choice(letters)))
            elif what < 0.08:
                del w[p]
            elif what < 0.12:
                w[p] = str(r.choice(letters))
            words.append("".join(w))
        rows.append((k, (" " if k % 2 else "-12 ").join(words)))
    chain = "zzzzzza " * 5 + "zzzzzzab " * 30 + "zzzzzzabc " * 200
    return [*rows, (502, chain), (None, "aaaaab " * 7), (None, None), (500, ""), (500, "123 !"), (501, rows[3][1]), (501, rows[3][1])]


def result(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_equals_all_pairs(spark):
    rows = texts()
    want = plain(rows)
    df = spark.createDataFrame([(k, x, "clash", 1) for k, x in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.spelling_groups(df)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_pairs_meet_once(spark):
    """Every pair of one edit, in each band and half, once; also where letters share bits and where a letter repeats."""
    r = np.random.default_rng(4)
    words = sorted({"".join(r.choice(list("aaabÀ÷")) for _ in range(int(r.integers(2, 8)))) for _ in range(400)})
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    want = {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((x.a, x.b)) for x in got} == want


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = "abc defgh " * 50 + "x" * 100 + " yz"
    monkeypatch.setattr(spelling, "STRETCH", 7)
    assert [w for part in spelling._runs(text) for w in part] == re.findall("[a-z]+", text)


def test_chains_of_forms_end(spark):
    df = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(27)] + [("v", "w5")], "word string, form string")
    assert {tuple(x) for x in spelling.roots(df).collect()} == {(f"w{k}", "w27") for k in range(27)} | {("v", "w27")}
    assert spelling.roots(df.limit(0)).count() == 0
