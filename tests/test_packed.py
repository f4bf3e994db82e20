"""Packed lines, tiles and contraction against the pixel operators and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import classify, colors, graph, packed, raster, tiles
from rasterlake.sources import images, store


def pixels_of(spark, grids):
    rows = [(k, y, x, *map(int, g[y, x])) for k, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int, a int")


@pytest.fixture(scope="module")
def grids():
    r = np.random.default_rng(11)
    out = {}
    for k, (h, w) in enumerate(((40, 57), (9, 31), (1, 1), (33, 12))):
        g = r.choice([0, 20, 90, 160, 250, 255], (h, w, 4), p=[0.1, 0.1, 0.1, 0.1, 0.1, 0.5]).astype(np.uint8)
        g[..., 3] = np.where(r.random((h, w)) < 0.9, 255, 5)
        g[:, w // 3, :3] = 0
        g[h // 2, :, :3] = 0
        g[2 : h // 2, 1:8] = (43, 108, 176, 255)
        out[f"f{k}.png"] = g
    out["blank.png"] = np.full((12, 20, 4), 255, np.uint8)
    return out


def as_rows(df):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.mark.parametrize("strip", [5, 64])
def test_features_equal_those_of_pixels(spark, grids, strip):
    p = pixels_of(spark, grids)
    want = classify.image_features(p)
    assert as_rows(packed.features(packed.pack(p), strip).select(*want.columns)) == as_rows(want)


@pytest.mark.parametrize("strip", [4, 64])
def test_curve_runs_equal_masks(spark, grids, strip):
    p = pixels_of(spark, grids)
    names = [(k, c, t) for k in grids for c, t in (("serving", 220.0), ("neighbor", 30.0), ("none", 355.0))]
    curves = spark.createDataFrame(names, "image string, curve string, target double")
    sizes = p.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    want = colors.curve_mask(p, curves, sizes, least_area=4)
    got = packed.curve_runs(packed.pack(p), curves, least_area=4, strip=strip).select("image", "curve", "y", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("x"))
    a, b = ({(r.image, r.curve, int(r.y), int(r.x)) for r in d.collect()} for d in (got, want))
    assert a == b and len(a) > 50


def test_lines_of_files(spark, grids, tmp_path):
    p = pixels_of(spark, grids)
    for k, g in grids.items():
        (tmp_path / k).write_bytes(images.png_bytes(g))
    (tmp_path / "broken.png").write_bytes(b"no image")
    lines = packed.read_lines(spark, str(tmp_path))
    assert as_rows(packed.unpack(lines)) == as_rows(p)
    assert as_rows(packed.pack(p)) == as_rows(lines)


def flooded(mask):
    """Labels by plain flooding: the first pixel of each component."""
    out = {}
    for y, x in np.argwhere(mask).tolist():
        if (y, x) in out:
            continue
        todo = [(y, x)]
        while todo:
            q = todo.pop()
            if q in out or not (0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1]) or not mask[q]:
                continue
            out[q] = (y, x)
            todo += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
    return out


def test_components_across_64_tiles(spark):
    r = np.random.default_rng(3)
    spiral = np.zeros((64, 64), bool)
    for k in range(0, 32, 4):  # arms that pass through all tiles
        spiral[k, k : 64 - k] = spiral[k : 64 - k, 63 - k] = spiral[63 - k, k : 64 - k] = spiral[k + 4 : 64 - k, k] = True
        spiral[k + 4, k : k + 5] = True
    masks = {"random": r.random((64, 64)) < 0.55, "spiral": spiral, "full": np.ones((64, 64), bool), "none": np.zeros((64, 64), bool)}
    rows = [(k, y, x, int(m[y, x])) for k, m in masks.items() for y in range(64) for x in range(64)]
    p = spark.createDataFrame(rows, "image string, y long, x long, ink int")
    runs = [(k, int(y), int(s), int(n)) for k, m in masks.items() for y, s, n in zip(*packed.runs_along(m), strict=True)]
    df = spark.createDataFrame(runs, "image string, y long, start long, len long")
    whole = as_rows(raster.components(p, "ink"))
    pieces = tiles.labelled(df, ["image"], 8, 8)
    assert as_rows(tiles.boxes(pieces, ["image"])) == whole
    for k, m in masks.items():
        want = flooded(m)
        got = {}
        for q in pieces.filter(F.col("image") == k).collect():
            for x in range(q.start, q.start + q.len):
                got.setdefault(q.root, set()).add((q.y, x))
        assert sorted(map(sorted, got.values())) == sorted(sorted(q for q in want if want[q] == c) for c in set(want.values()))
    large = tiles.large_only(pieces, ["image"], 20).groupBy("image").agg(F.sum("len").alias("n")).collect()
    sizes = {k: sum(n for n in np.unique(list(map(hash, flooded(m).values())), return_counts=True)[1] if n >= 20) for k, m in masks.items() if m.any()}
    assert {q.image: q.n for q in large} == {k: n for k, n in sizes.items() if n}
    with pytest.raises(ValueError, match="2\\^21"):
        tiles.labelled(df, ["image"], 4096, 1024)


def test_contraction_of_paths_and_stars(spark):
    edges = [("p", k, k + 1) for k in range(40)] + [("s", 1000, k) for k in range(50)] + [("q", 5, 5), ("q", 7, 6), ("q", 6, 7), ("r", 2, 1)]
    got = {(x.key, x.node): x.root for x in graph.connected(spark.createDataFrame(edges, "key string, a long, b long"), ["key"]).collect()}
    want = {("p", k): 0 for k in range(41)} | {("s", k): 0 for k in [*range(50), 1000]} | {("q", 6): 6, ("q", 7): 6, ("r", 1): 1, ("r", 2): 1}
    assert got == want


def test_work_of_an_application_is_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "work_root", lambda _: f"file://{tmp_path}/work")
    df = store.saved(spark.range(3), "some")
    assert df.count() == 3
    store.drop_work(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.count()


@pytest.mark.parametrize("strip", [16, 64])
def test_cut_by_levels_equals_the_recursive_one(spark, strip):
    from rasterlake.operators import layout

    r = np.random.default_rng(6)
    grids = {}
    for k in range(3):
        g = np.full((150 + 40 * k, 560 - 200 * k, 4), 255, np.uint8)
        for _ in range(7):
            y, x = int(r.integers(0, g.shape[0] - 30)), int(r.integers(0, g.shape[1] - 60))
            g[y : y + int(r.integers(8, 30)), x : x + int(r.integers(20, 60)), :3] = 0
        grids[f"g{k}"] = g
    grids["small"], grids["blank"] = np.full((12, 30, 4), 255, np.uint8), np.full((64, 64, 4), 255, np.uint8)
    rows = [(k, y, g.shape[1], g.shape[0], bytearray(g[y].tobytes())) for k, g in grids.items() for y in range(g.shape[0])]
    lines = spark.createDataFrame(rows, "image string, y int, width int, height int, rgba binary")
    want = sorted((k, *n) for k, g in grids.items() for n in layout.cut_tree(packed.ink_of(g)))
    got = sorted((q.image, q.node, q.parent, q.type, q.depth, q.x, q.y, q.width, q.height) for q in packed.xy_cut(lines, strip=strip).collect())
    assert got == want and len(want) > 12


@pytest.mark.parametrize("strip", [5, 64])
def test_blur(spark, grids, strip):
    """Against plain sums over both axes, with repeated edges; a sigma of 0 or null changes nothing."""
    sigma = {"f0.png": 1.3, "f1.png": 2.0, "f2.png": 1.0, "f3.png": 0.0, "blank.png": None}
    rows = [(k, y, g.shape[1], g.shape[0], bytearray(g[y].tobytes())) for k, g in grids.items() for y in range(g.shape[0])]
    lines = spark.createDataFrame(rows, "image string, y int, width int, height int, rgba binary")
    got = {(r.image, r.y): np.frombuffer(r.rgba, np.uint8).reshape(-1, 4) for r in packed.blurred(lines, spark.createDataFrame(list(sigma.items()), "image string, sigma double"), 2.0, strip).collect()}
    assert len(got) == len(rows)
    for k, g in grids.items():
        want = g.astype(np.int64)
        for axis in (1, 0) if sigma[k] else ():
            w = packed.kernel(sigma[k])
            assert sum(w) == 65536 and w == w[::-1]
            r, n = len(w) // 2, want.shape[axis]
            want = sum(p * np.take(want, np.clip(np.arange(n) + i - r, 0, n - 1), axis) for i, p in enumerate(w)) + 32768 >> 16
        assert all((got[k, y] == want[y]).all() for y in range(g.shape[0]))
