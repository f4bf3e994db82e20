"""The candidate loop, normal forms, the recognition cache and regions by template, against plain values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import candidates, chain, curves, normal, packed, render
from rasterlake.sources import images, recognised

WHITE = (255, 255, 255, 255)


def lines_of(spark, grids):
    rows = [(k, y, g.shape[1], g.shape[0], g[y].tobytes()) for k, g in grids.items() for y in range(g.shape[0])]
    return spark.createDataFrame([(k, y, w, h, bytearray(b)) for k, y, w, h, b in rows], "image string, y int, width int, height int, rgba binary")


def no_texts(spark):
    return spark.createDataFrame([], "image string, item long, text string, conf double, x double, y double, width double, height double")


def filled(color):
    def build(f):
        body = render.element("rect", {"id": F.lit("r"), "x": F.lit(0), "y": F.lit(0), "width": F.col("width"), "height": F.col("height"), "fill": F.lit(color)})
        return candidates.Made(f.sizes.select("image", F.lit("g_axes").alias("layer"), F.lit(0.0).alias("o"), body.alias("body")))

    return build


def test_the_fitting_candidate_wins_over_the_likelier_one(spark):
    """A white and a black candidate of a white figure: the white one is chosen although its score is lower."""
    lines = lines_of(spark, {"a": np.full((10, 12, 4), 255, np.uint8), "b": np.zeros((4, 5, 4), np.uint8) + np.array([0, 0, 0, 255], np.uint8)})
    attempts = spark.createDataFrame([("a", "white", 0.1), ("a", "black", 9.0), ("b", "white", 3.0), ("b", "lost", 1.0), ("c", "white", 1.0)], "case string, template string, score double")
    builders = {"white": filled("white"), "black": filled("black")}
    tried = candidates.run(attempts, lines, no_texts(spark), builders, (0.2, 0.2, 10.0)).cache()
    got = {(r.case, r.template): r for r in tried.collect()}
    assert got["a", "white"].status == "pass" and got["a", "white"].rmse == 0 and got["a", "black"].gate == "fail:rmse,bad" and got["a", "black"].rmse == 1
    assert (got["b", "lost"].stage, got["b", "lost"].code) == ("extract", "E5107") and (got["c", "white"].stage, got["c", "white"].code) == ("extract", "E1000")
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case string")
    chosen = {r.case: (r.template, r.status, r.code) for r in candidates.choose(tried, cases, spark.createDataFrame([("d", "E5107")], "case string, code string")).collect()}
    assert chosen == {"a": ("white", "pass", None), "b": (None, "fail", "E5108"), "c": (None, "fail", "E5105"), "d": (None, "fail", "E5107")}
    assert {r.case: r.template for r in candidates.choose(tried, cases, allow_failed_gate=True).collect()} == {"a": "white", "b": "white", "c": None, "d": None}
    open_ = candidates.run(attempts, lines, no_texts(spark), builders, None)
    assert {r.case: r.template for r in candidates.choose(open_, cases, gated=False).collect()} == {"a": "black", "b": "white", "c": None, "d": None}


def test_attempts_of_ranked_templates(spark):
    features = spark.createDataFrame([("a", 1600, 900, 0.3, 0.01, 0.8, 20, 9, 0, 9000, 100, ["agent"]), ("b", 640, 360, 0.0, 0.0, 0.0, 1, 0, 0, 0, 0, [])], "case string, width int, height int, ink double, saturated double, aligned double, colors long, long_v long, long_h long, short_v long, short_h long, tokens array<string>")
    attempts, unknown = candidates.ranked(features, "case", 2, spark.createDataFrame([("b", "t_auto_layout")], "case string, template string"))
    rows = [(r.case, r.template, r["rank"]) for r in attempts.orderBy("case", "rank").collect()]
    assert rows[0][:2] == ("a", "t_3gpp_events_3panel") and len(rows) == 3 and rows[2] == ("b", "t_auto_layout", 1) and unknown.count() == 0
    assert {r.case for r in candidates.ranked(features, "case", 2)[1].collect()} == {"b"}


def test_every_builder_draws(spark):
    """Each template's extraction and rendering gives a document of the required layers, or says why not."""
    g = np.full((90, 160, 4), 255, np.uint8)
    g[20:70, 30] = g[69, 30:130] = (0, 0, 0, 255)
    for x in range(32, 120):
        g[60 - x // 3 : 63 - x // 3, x] = (43, 108, 176, 255)
    lines = lines_of(spark, {"f": g})
    attempts = spark.createDataFrame([("f", t, 1.0) for t in candidates.BUILDERS], "case string, template string, score double")
    texts = spark.createDataFrame([("f", 1, "A title", 0.9, 50.0, 3.0, 60.0, 8.0), ("f", 2, "time", 0.9, 70.0, 82.0, 20.0, 6.0)], no_texts(spark).schema)
    got = {r.template: r for r in candidates.run(attempts, lines, texts, candidates.BUILDERS).collect()}
    assert (got["t_project_architecture_v1"].code, got["t_project_architecture_v1"].svg) == ("E2301", None)
    for name, r in got.items():
        assert r.stage is not None or (r.svg.startswith("<svg") and r.rmse is not None and all(f'id="{layer}"' in r.svg for layer in render.LAYERS)), name
    plot = got["t_performance_lineplot"]
    assert plot.stage is None and 'id="series_series_0"' in plot.svg and 'id="txt_tick_x_4"' in plot.svg and ">A title<" in plot.svg and ">time<" in plot.svg


def test_recognition_is_keyed_by_content(spark, tmp_path):
    r = np.random.default_rng(5)
    a = r.integers(0, 255, (100, 80, 4), np.uint8)
    b = a.copy()
    b[70:, :, :] = 9  # the first region is as in a
    plan = spark.createDataFrame([(k, n, 0, y0, 80, y1, 1.0 if n else 0.5) for k in "ab" for n, (y0, y1) in enumerate(((0, 66), (60, 100)))], "image string, region int, x0 int, y0 int, x1 int, y1 int, factor double")
    log = tmp_path / "log"

    def engine(grid):
        with log.open("a") as f:
            f.write(f"{grid.shape[0]}\n")
        if int(grid.sum()) == 0:
            raise ValueError("black")
        return [(f"sum {int(grid.sum())}", 0.5, 1.0, 2.0, 3.0, 4.0)]

    calls = lambda: len(log.read_text().split()) if log.exists() else 0
    cache = f"file://{tmp_path}/cache"
    scan = lambda grids, parameters={"lang": "en"}: sorted((x.image, x.region, x.text, x.x, x.y, x.width, x.error) for x in recognised.scan(lines_of(spark, grids), plan, engine, cache, parameters).collect())  # noqa: B006, E731
    first = scan({"a": a, "b": b})
    half = a[np.arange(33) * 2][:, np.arange(40) * 2]
    assert first[0] == ("a", 0, f"sum {int(half.sum())}", 2.0, 4.0, 6.0, None) and first[1] == ("a", 1, f"sum {int(a[60:].sum())}", 1.0, 62.0, 3.0, None)
    assert calls() == 3 and len(first) == 4  # a and b share the content of the first region
    assert scan({"a": a, "b": b}) == first and calls() == 3
    b[99, 79, 3] ^= 1
    again = scan({"a": a, "b": b})
    assert calls() == 4 and again[:3] == first[:3] and again[3] != first[3]
    scan({"a": a, "b": b}, {"lang": "de"})
    assert calls() == 7
    b[:] = 0
    assert [x[6] for x in scan({"a": a, "b": b})] == [None, None, "ValueError: black", "ValueError: black"] and calls() == 9
    scan({"a": a, "b": b})
    assert calls() == 11  # errors aren't stored


def test_series_are_simplified_within_their_budget(spark):
    x = np.linspace(0, 1, 60)
    points = [{"x": float(a), "y": float(np.sin(9 * a))} for a in x]
    df = spark.createDataFrame([(1, points, True, None, 2.0), (2, points[:3], False, None, None), (3, [], True, [1.0, 2.0], 1.0)], "k int, points array<struct<x:double,y:double>>, dashed boolean, dasharray array<double>, stroke_width double")
    got = {r.k: r for r in normal.normal_series(df).collect()}
    v = np.array([(p["x"], p["y"]) for p in points])
    want = curves.simplify_array(v, 10, 2, float(np.ptp(v, axis=0).max()) * 0.01)
    assert [(p.x, p.y) for p in got[1].points] == [(round(a, 4), round(b, 4)) for a, b in want.tolist()] and 2 <= len(got[1].points) <= 10
    assert got[1].dasharray == [6.0, 4.0] and got[2].dasharray is None and len(got[2].points) == 3 and got[3].points == [] and got[3].dasharray == [1.0, 2.0]
    curve = normal.normal_curves(df).collect()[0].points
    assert 3 <= len(curve) <= 4 and all(0 <= p.y <= 1 and round(p.y, 3) == p.y for p in curve)


def test_regions_by_template(spark):
    names = ["t_3gpp_events_3panel", "t_performance_lineplot", "t_project_architecture_v1", "t_rl_agent_loop_v1", "t_performance_grid_v1", "t_auto_layout"]
    sizes = spark.createDataFrame([(n, 1000, 600) for n in names], "image string, width int, height int")
    decisions = sizes.select("image", F.col("image").alias("template"))
    boxes = spark.createDataFrame([(names[0], "A3", 100.0, 100.0, 200.0, 400.0)], "image string, panel string, x double, y double, width double, height double")
    found = spark.createDataFrame([(n, k, 10.0 * k, 20.0, 5.0 + k, 6.0) for n in names for k in range(5)], "image string, ord int, x double, y double, width double, height double")
    got = {}
    for r in chain.regions(decisions, sizes, boxes, found, most=3, pad=4).collect():
        got.setdefault(r.image, {})[r.region] = (r.x, r.y, r.width, r.height)
    assert got[names[0]] == {"title": (0, 0, 1000, 112), "panel_top_A3": (96, 96, 208, 108), "panel_mid_A3": (96, 216, 208, 168), "panel_bottom_A3": (96, 396, 208, 108)}
    assert set(got[names[1]]) == {"title", "axis_x", "axis_y"} and len(got[names[2]]) == 8 and len(got[names[3]]) == 4 and len(got[names[4]]) == 4
    assert got[names[5]] == {f"text_box_{k}": (10.0 * k - 4, 16, 13.0 + k, 14) for k in (2, 3, 4)}


def test_diff_of_packed_lines(spark):
    r = np.random.default_rng(8)
    a, b = r.integers(0, 256, (6, 7, 4), np.uint8), r.integers(0, 256, (6, 7, 4), np.uint8)
    flat = lambda g: g[..., :3] * (g[..., 3:] / 255.0) + 255 * (1 - g[..., 3:] / 255.0)
    d = np.abs(flat(a) - flat(b))
    one = {"k": a, "small": a, "equal": a}
    other = {"k": b, "small": b[:5], "equal": a, "extra": b}
    got = {x.image: x for x in packed.diff(lines_of(spark, one), lines_of(spark, other), 40).collect()}
    assert set(got) == {"k", "equal"} and got["equal"].rmse == got["equal"].bad == 0
    assert got["k"].rmse == pytest.approx(np.sqrt((d**2).mean()) / 255) and got["k"].bad == pytest.approx((d.max(axis=2) > 40).mean())
    assert images.png_bytes(a)[:8] == images.MAGIC
