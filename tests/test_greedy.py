"""De-duplication in rounds against the plain fold over ordered items."""

import functools
import math
import time

import numpy as np
import pytest

from rasterlake.operators import greedy, spatial


@pytest.fixture
def in_rounds(monkeypatch):
    monkeypatch.setattr(greedy, "FEW", 0)
    monkeypatch.setattr(greedy.by_size, "__defaults__", (0,))


def fold(items, clash):
    out = []
    for i in items:
        if not any(clash(k, i) for k in out):
            out.append(i)
    return out


def rows(df, *names):
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("part", [200_000, 5])
def test_circles(spark, in_rounds, monkeypatch, part):
    monkeypatch.setattr(greedy, "PART", part)
    r = np.random.default_rng(1)
    items = [(g, int(o), float(r.integers(0, 60)), float(r.integers(0, 60)), float(r.integers(1, 5)), "x") for g in ("a", "b", None) for o in r.permutation(150)]
    items += [("c", k, 4.0 * k, 0.0, 1.0, "chain") for k in range(60)] + [("c", 1000, 3.0, 1.0, 1.0, "late"), ("c", 1001, None, 1.0, 1.0, "no place"), ("c", 1001, 0.0, 0.0, 1.0, "equal")]
    df = spark.createDataFrame(items, "k string, ord long, x double, y double, r double, other string")
    want = []
    for g in ("a", "b", "c", None):
        mine = sorted((i for i in items if i[0] == g), key=lambda i: i[1])
        want += fold([i for i in mine if i[2] is not None], lambda p, q: math.hypot(p[2] - q[2], p[3] - q[3]) <= 5 and abs(p[4] - q[4]) <= 2) + [i for i in mine if i[2] is None]
    assert rows(spatial.circle_dedup(df, ["k"], ["x", "y", "r"], "ord"), "k", "ord", "x", "y", "r", "other") == sorted(map(repr, want))
    assert spatial.circle_dedup(df.limit(0), ["k"], ["x", "y", "r"], "ord").count() == 0


def test_boxes(spark, in_rounds):
    r = np.random.default_rng(2)
    items = [(1, o, float(r.integers(0, 80)), float(r.integers(0, 80)), float(2 ** r.integers(0, 6)), float(r.integers(1, 40))) for o in range(300)] + [(1, 900, 5.0, 5.0, 0.0, 3.0)]
    df = spark.createDataFrame(items, "k int, ord int, x double, y double, w double, h double")

    def ratio(p, q):
        w, h = (min(p[a] + p[b], q[a] + q[b]) - max(p[a], q[a]) for a, b in ((2, 4), (3, 5)))
        least = min(p[4] * p[5], q[4] * q[5])
        return max(w, 0) * max(h, 0) / least if least > 0 else 0

    want = fold(sorted(items, key=lambda i: (-i[4] * i[5], i[1])), lambda p, q: ratio(p, q) >= 0.8)
    assert rows(spatial.rect_nms(df, ["k"], ["x", "y", "w", "h"], "ord"), "ord") == sorted(repr((i[1],)) for i in want)
    with pytest.raises(ValueError, match="half"):
        spatial.rect_nms(df, ["k"], ["x", "y", "w", "h"], "ord", 0.4)


def test_lines(spark, in_rounds):
    r = np.random.default_rng(3)
    items = []
    for o in range(260):
        x, y, n = (float(v) for v in r.integers(0, 30, 3))
        items.append((1, o, *[(x, y, x + n, y), (x, y, x, y + n), (x, y, x + n, y + n), (x + n, y, x, y), (x, y, x, y)][o % 5]))
    df = spark.createDataFrame(items, "k int, ord int, x1 double, y1 double, x2 double, y2 double")
    d = lambda p, q, a, b, c, e: math.hypot(p[a] - q[c], p[b] - q[e])
    near = lambda p, q: min(d(p, q, 2, 3, 2, 3) + d(p, q, 4, 5, 4, 5), d(p, q, 2, 3, 4, 5) + d(p, q, 4, 5, 2, 3)) <= 5
    want = []
    for name, holds in (("vertical", lambda i: abs(i[2] - i[4]) <= 2), ("horizontal", lambda i: abs(i[3] - i[5]) <= 2), ("other", lambda i: abs(i[2] - i[4]) > 2 and abs(i[3] - i[5]) > 2)):
        left = [i for i in items if holds(i)]
        while left:
            group = [left[0], *[i for i in left[1:] if near(left[0], i)]]
            want.append((name, max(group, key=lambda i: (math.hypot(i[2] - i[4], i[3] - i[5]), -i[1]))[1]))
            left = [i for i in left if i not in group]
    assert rows(spatial.line_dedup(df, ["k"], ["x1", "y1", "x2", "y2"], "ord"), "orientation", "ord") == sorted(map(repr, want))


def test_texts_in_rounds_equal_the_fold(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = ["Threshold", "threshold", "Treshold", " Threshold ", "Time", "Tine", "timer", "", "A3"]
    items = [(1, o, str(r.choice(words)), float(r.random() * 90), float(r.random() * 40)) for o in range(200)]
    df = spark.createDataFrame(items, "k int, ord int, t string, x double, y double")
    call = lambda: rows(spatial.text_dedup(df, ["k"], "t", "x", "y", "ord"), "ord")
    monkeypatch.setattr(greedy.by_size, "__defaults__", (1000,))
    whole = call()
    monkeypatch.setattr(greedy.by_size, "__defaults__", (64,))
    assert call() == whole and 10 < len(whole) < 190


def test_a_hundred_thousand_items_of_one_key(spark):
    n = 100_000
    df = spark.range(n, numPartitions=8).selectExpr("1 AS k", "id AS ord", "CAST((id * 7919) % 1009 * 3 AS double) AS x", "CAST((id * 104729) % 997 * 3 AS double) AS y", "1.0D AS r")
    began = time.time()
    got = spatial.circle_dedup(df, ["k"], ["x", "y", "r"], "ord").select("x", "y", "ord").collect()
    assert time.time() - began < 300
    cells = {}
    for k in range(n):  # the fold, by cells
        x, y = k * 7919 % 1009 * 3, k * 104729 % 997 * 3
        c = (x // 5, y // 5)
        if all(math.hypot(x - a, y - b) > 5 for dx in (-1, 0, 1) for dy in (-1, 0, 1) for a, b in cells.get((c[0] + dx, c[1] + dy), ())):
            cells.setdefault(c, []).append((x, y))
    assert sorted((r.x, r.y) for r in got) == sorted(p for v in cells.values() for p in v)

def plain_texts(items, similarity, distance):
    """What a fold keeps of (key, order, text, x, y), by its own edit distance."""

    @functools.cache
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def clash(p, q):
        a, b = p[2].strip(" ").lower(), q[2].strip(" ").lower()
        return math.hypot(round(p[3]) - round(q[3]), round(p[4]) - round(q[4])) < distance and (a == b or 1 - edits(a, b) / max(len(a), len(b)) > similarity)

    return fold(sorted((i for i in items if i[2].strip(" ")), key=lambda i: i[1]), clash)


@pytest.mark.parametrize(("part", "similarity"), [(200_000, 0.85), (5, 0.85), (40, 0.6), (40, 0.3)])
def test_texts_without_a_list_of_clashes(spark, in_rounds, monkeypatch, part, similarity):
    monkeypatch.setattr(greedy, "PART", part)
    r = np.random.default_rng(5)
    letters = list("abcäé\U0001f600")
    words = ["".join(r.choice(letters, r.integers(1, 16))) for _ in range(12)]
    for w in list(words):  # and edited ones
        for _ in range(3):
            at = int(r.integers(0, len(w)))
            words.append([w[:at] + w[at + 1 :], w[:at] + "x" + w[at + 1 :], w[:at] + "y" + w[at:], "z" + w[:-1]][int(r.integers(0, 4))])
    items = [(1, int(o), f" {w}" if o % 7 == 0 else w.upper() if o % 5 == 0 else w, float(r.random() * 120), float(r.random() * 60)) for o, w in enumerate(r.choice(words, 260).tolist())]
    items += [(1, 1000 + k, "chain", 9.0 * k, 500.0) for k in range(12)]
    df = spark.createDataFrame([*items, (1, 5000, "chain", None, 500.0), (1, 5001, "chain", float("nan"), 500.0)], "k int, ord int, t string, x double, y double")
    got = rows(spatial.text_dedup(df, ["k"], "t", "x", "y", "ord", similarity, 20.0), "ord")
    assert got == sorted(repr((o,)) for o in [*(i[1] for i in plain_texts(items, similarity, 20.0)), 5000, 5001])


@pytest.mark.parametrize("part", [200_000, 20_000])
def test_equal_texts_at_ninety_thousand_places(spark, monkeypatch, part):
    """Each is near 2,800 others: 127 million clashes."""
    monkeypatch.setattr(greedy, "PART", part)
    n, side = 90_000, 300
    df = spark.range(n, numPartitions=8).selectExpr("1 AS k", "id AS ord", "'Threshold' AS t", f"CAST((id * 7919) % {n} % {side} AS double) AS x", f"CAST(floor((id * 7919) % {n} / {side}) AS double) AS y")
    began = time.time()
    got = sorted(r.ord for r in spatial.text_dedup(df, ["k"], "t", "x", "y", "ord", distance=30.0).select("ord").collect())
    assert time.time() - began < 100
    kept, want = [], []
    for k in range(n):
        y, x = divmod(k * 7919 % n, side)
        if all((x - a) ** 2 + (y - b) ** 2 >= 900 for a, b in kept):
            kept.append((x, y))
            want.append(k)
    assert got == want
