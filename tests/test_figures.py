"""Figure operators against plain versions and values worked out by hand."""

import json
import time
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import figures as G
from rasterlake.functions import labels
from rasterlake.operators import classify, colors, convert, curves, extract, figures, layout, panels, raster, render, shapes
from rasterlake.sources import datasets, images

PIXEL = "image string, y int, x int, r int, g int, b int, a int"


def frame(spark, grids):
    """Pixels of RGBA arrays by name."""
    rows = [pd.DataFrame({"image": n, "y": np.repeat(np.arange(g.shape[0]), g.shape[1]), "x": np.tile(np.arange(g.shape[1]), g.shape[0]), **{c: g[..., i].reshape(-1).astype(int) for i, c in enumerate("rgba")}}) for n, g in grids.items()]
    return spark.createDataFrame(pd.concat(rows), PIXEL)


def paper(h, w):
    return np.full((h, w, 4), 255, np.uint8)


def sizes(spark, **of):
    return spark.createDataFrame([(n, w, h) for n, (w, h) in of.items()], "image string, width int, height int")


RECORDED = {"width": 2752, "height": 1536, "ink": 0.3059685285701308, "saturated": 0.0351157574393958, "aligned": 0.752597629838288, "colors": 16, "long_v": 51, "long_h": 0, "short_v": 38500, "short_h": 43258}


def test_recorded_classification(spark):
    """Scores that a recorded run gave for these features (its words aren't recorded, only their number)."""
    df = spark.createDataFrame([pd.Series({**RECORDED, "tokens": ["x"] * 227}).to_dict()], "width int, height int, ink double, saturated double, aligned double, colors long, long_v long, long_h long, short_v long, short_h long, tokens array<string>")
    row = classify.template_scores(df).first()
    want = {"t_3gpp_events_3panel": 6.8, "t_performance_grid_v1": 2.3, "t_procedure_flow": 0.9, "t_performance_lineplot": -0.2}
    assert {k: round(row[k], 6) for k in want} == want
    out = classify.classify(df, ["width"]).first()
    assert out.top == out.decision == "t_3gpp_events_3panel" and out.reasons == "" and abs(out.confidence - 0.6145833333333333) < 1e-9 and abs(out.margin - 3.6) < 1e-9


def test_evidence_and_fallback(spark):
    plain = {"width": 100, "height": 100, "ink": 0.0, "saturated": 0.0, "aligned": 0.0, "colors": 0, "long_v": 0, "long_h": 0, "short_v": 0, "short_h": 0, "tokens": None}
    df = spark.createDataFrame([plain], "width int, height int, ink double, saturated double, aligned double, colors long, long_v long, long_h long, short_v long, short_h long, tokens array<string>")
    out = classify.classify(df, ["width"]).first()
    # flow: 0.6 + 0.3 + 0.2, the only score over 0; the shift leaves nothing of it
    assert out.top == "t_procedure_flow" and abs(out.score - 1.1) < 1e-9 and out.decision == "t_auto_layout" and out.reasons == "LOW_CONFIDENCE,FALLBACK_TO_AUTO"
    assert classify.classify(df.limit(0), ["width"]).count() == 0


def plain_features(g):
    rgb, a = g[..., :3].astype(float), g[..., 3]
    ink = (a > 10) & (rgb @ [0.2126, 0.7152, 0.0722] < 245)
    grey = rgb.mean(axis=2) / 255
    dx, dy = np.abs(np.diff(grey, axis=1))[:-1], np.abs(np.diff(grey, axis=0))[:, :-1]
    edge = (dx + dy > 0.08) & ink[:-1, :-1]

    def runs(line):
        out, n = [], 0
        for v in [*line, False]:
            if v:
                n += 1
            elif n:
                out, n = [*out, n], 0
        return out

    found = {"ink": ink.mean(), "aligned": (edge & ((dx > 2 * dy) | (dy > 2 * dx))).sum() / max(1, edge.sum())}
    for name, lines, extent in (("v", ink.T, ink.shape[0]), ("h", ink, ink.shape[1])):
        each = [runs(v) for v in lines]
        long = [i for i, r in enumerate(each) if max(r, default=0) >= max(int(extent * 0.45), 1)]
        found[f"long_{name}"] = sum(k == 0 or i - long[k - 1] > 1 for k, i in enumerate(long))
        found[f"short_{name}"] = sum(2 <= n <= max(int(extent * 0.08), 2) for r in each for n in r)
    return found


def test_image_features(spark):
    rng = np.random.default_rng(1)
    g = paper(60, 50)
    g[5:50, 10:12] = [0, 0, 0, 255]
    g[30, 5:45] = [200, 20, 30, 255]
    noise = paper(40, 40)
    noise[..., :3] = rng.integers(0, 256, (40, 40, 1))
    noise[:3, :, 3] = 0
    blank = paper(20, 20)
    got = {r.image: r for r in classify.image_features(frame(spark, {"g": g, "noise": noise, "blank": blank})).collect()}
    for name, grid in (("g", g), ("noise", noise), ("blank", blank)):
        for k, v in plain_features(grid).items():
            assert abs(got[name][k] - v) < 1e-9, (name, k)
    assert got["blank"].colors == 0 and got["g"].colors == 3 and (got["g"].width, got["g"].height) == (50, 60)


def test_cut_tree():
    mask = np.zeros((200, 300), bool)
    mask[20:80, 20:280] = True
    mask[120:180, 20:130] = True
    mask[120:180, 170:280] = True
    tree = layout.cut_tree(mask)
    assert [(n[0], n[1], n[2], n[3]) for n in tree] == [(0, -1, "ROW", 0), (1, 0, "LEAF", 1), (2, 0, "COL", 1), (3, 2, "LEAF", 2), (4, 2, "LEAF", 2)]
    assert tree[1][4:] == (0, 0, 300, 100) and tree[3][4:] == (0, 100, 150, 100) and tree[4][4:] == (150, 100, 150, 100)
    assert layout.cut_tree(np.zeros((10, 10), bool)) == [(0, -1, "LEAF", 0, 0, 0, 10, 10)]
    leaves = [n for n in layout.cut_tree(np.random.default_rng(3).random((400, 400)) < 0.01) if n[2] == "LEAF"]
    assert sum(n[6] * n[7] for n in leaves) == 400 * 400  # leaves tile the image


def test_layout_of_blank_and_missing(spark):
    g = paper(120, 120)
    p = frame(spark, {"blank": g}).select("image", "y", "x", F.lit(0).alias("ink"))
    assert [(r.node, r.type) for r in layout.xy_cut(p).collect()] == [(0, "LEAF")]
    found = layout.detect_panels(p).orderBy("panel").collect()
    assert [r.source for r in found] == ["default"] * 3 or [r.source for r in found] == ["detected"] * 3
    assert layout.xy_cut(p.limit(0)).count() == 0 and layout.detect_panels(p.limit(0)).count() == 0


def test_vertices_and_descriptors(spark):
    square = [(y, x) for y in range(10) for x in range(10)]
    tri = [(y, x) for y in range(10) for x in range(10 - y)]
    rows = [("square", y, x) for y, x in square] + [("tri", y, x) for y, x in tri] + [("dot", 0, 0)]
    got = {r.k: r for r in shapes.descriptors(spark.createDataFrame(rows, "k string, y int, x int"), ["k"]).collect()}
    assert got["square"].area == 100 and got["square"].aspect == 1 and round(got["square"].solidity, 4) == round(100 / 81, 4)
    assert got["square"].vertices == 8 and got["dot"].area == 0 and got["dot"].vertices == 0 and got["tri"].area == 55


def test_arrow_heads_of_nothing(spark):
    ends = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 900, 900)], "image string, end int, x int, y int")
    got = shapes.arrow_heads(frame(spark, {"a": paper(30, 30)}), ends).collect()
    assert [(r.kind, r.size, r.confidence) for r in got] == [("none", 0.0, 0.9)] * 2


def test_palette_and_labels(spark):
    d = spark.createDataFrame([("#1f77b5",), ("#000001",), ("red",), (None,), ("#FF7F0E",)], "c string")
    assert [r.s for r in d.select(colors.snapped(F.col("c")).alias("s")).collect()] == ["#1f77b4", "#000000", "#000000", "#000000", "#ff7f0e"]
    t = spark.createDataFrame([(["Goal: a: b", "x"],), (["x", "y"],), (["the Output c"],), ([],), (["y", "goal only", "z"],)], "l array<string>")
    got = [tuple(r.g) for r in t.select(labels.goal_output(F.col("l")).alias("g")).collect()]
    assert got == [("a: b", "x"), ("x", "y"), (None, "the Output c"), (None, None), ("goal only", "y")]
    n = spark.createDataFrame([("12 abc d\n7\n3 4",), ("1 2",), ("5 x9",), (" 3  ok ",), (None,)], "t string")
    assert [r.t for r in n.select(labels.drop_leading_number(F.col("t")).alias("t")).collect()] == ["abc d\n7\n3 4", "1 2", "5 x9", "ok", None]


def test_rasterize():
    svg = '<svg xmlns="http://www.w3.org/2000/svg" width="40" height="30"><rect x="5" y="5" width="10" height="8" fill="#ff0000"/><line x1="0" y1="20" x2="40" y2="20" stroke="#0000ff" stroke-width="2"/><circle cx="30" cy="10" r="5" fill="#00ff00"/><path d="M 0 25 C 10 25 20 25 40 25" fill="none" stroke="#000000"/><text x="1" y="1">t</text></svg>'
    g = convert.rasterize(svg)
    assert g.shape == (30, 40, 4) and tuple(g[8, 10, :3]) == (255, 0, 0) and tuple(g[4, 10, :3]) == (255, 255, 255)
    assert ((g[..., :3] == [255, 0, 0]).all(axis=2)).sum() == 80 and ((g[5:13, 5:15, :3] == [255, 0, 0]).all(axis=2)).all()
    assert tuple(g[20, 20, :3]) == (0, 0, 255) and tuple(g[10, 30, :3]) == (0, 255, 0) and tuple(g[24, 20, :3]) in ((0, 0, 0), (255, 255, 255))
    with pytest.raises(ValueError):
        convert.rasterize("<svg/>")


def test_cases_never_fail_the_job(spark):
    ok = '<svg width="20" height="10"><rect x="0" y="0" width="20" height="10" fill="#102030"/></svg>'
    cases = spark.createDataFrame([("good", ok), ("other", ok), ("broken", "<svg"), ("none", None), ("small", '<svg width="5" height="5"/>')], "case string, svg string")
    grid = paper(10, 20)
    grid[..., :3] = [16, 32, 48]
    other = paper(10, 20)
    want = frame(spark, {"good": grid, "other": other, "broken": grid, "none": grid, "small": grid}).withColumnRenamed("image", "case")
    got = {r.case: r for r in convert.run_cases(cases, convert.rasters(cases, "case", "svg"), want, 0.2, 0.2).collect()}
    assert got["good"].status == "pass" and got["good"].rmse == 0 and got["other"].status == "fail:rmse,bad"
    assert {k: got[k].status for k in ("broken", "none", "small")} == {"broken": "skipped", "none": "skipped", "small": "skipped"}
    assert "ParseError" in got["broken"].error and got["small"].error == "no raster of the expected size"


def test_time_limit(spark):
    began = time.time()
    with pytest.raises(convert.TimedOut), convert.time_limit(0.2):
        time.sleep(5)
    assert time.time() - began < 2
    with convert.time_limit(None):
        pass

    def call(row):
        if row["k"] == 1:
            time.sleep(30)
        return str(10 // row["k"]) if row["k"] != 1 else "late"

    d = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, v string")
    got = {r.k: r for r in convert.guarded(d, ["k"], call, 0.5).collect()}
    assert got[5].result == "2" and "ZeroDivisionError" in got[0].error and "TimedOut" in got[1].error


def test_bezier_holds_its_limit():
    rng = np.random.default_rng(2)
    points = np.column_stack([np.arange(3000.0), np.cumsum(rng.normal(size=3000)) * 8])
    fits = curves.fit_bezier(points, 0.5)
    t = np.linspace(0, 1, 400)[:, None]
    at = np.concatenate([(1 - t) ** 3 * c[0] + 3 * (1 - t) ** 2 * t * c[1] + 3 * (1 - t) * t**2 * c[2] + t**3 * c[3] for c in fits])
    for p in points[::37]:
        assert np.hypot(*(at - p).T).min() < 0.75
    assert np.allclose(fits[0][0], points[0]) and np.allclose(fits[-1][3], points[-1])
    assert all(np.allclose(a[3], b[0]) for a, b in zip(fits, fits[1:]))
    assert curves.fit_bezier(points[:1], 1.0) == [] and len(curves.fit_bezier(points[:2], 1.0)) == 1


def test_large_image_in_linear_time(spark, tmp_path):
    g = paper(1200, 1600)
    g[100:110, :, :3] = [10, 200, 30]
    g[:, :, 3] = 250
    images.put_file(spark, f"file://{tmp_path}/big.png", images.png_bytes(g))
    (tmp_path / "bad.png").write_bytes(b"no png")
    began = time.time()
    got = images.pixels(spark, f"file://{tmp_path}").groupBy("image").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b"), F.sum("a").alias("a")).collect()
    assert time.time() - began < 60
    assert [tuple(r) for r in got] == [("big.png", 1200 * 1600, *[int(g[..., k].astype(int).sum()) for k in range(4)])]


def test_data_sets(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "manifest.yaml").write_text(json.dumps({"cases": [{"id": "a", "dir": "cases/a", "tags": ["x"], "gates": {"rmse_max": 0.5}}, {"id": 7, "expected_templates": ["t"]}]}))
    got = datasets.cases(spark, at("set")).orderBy("ord").collect()
    assert [(r.id, r.tags, r.gates, r.expected_templates) for r in got] == [("a", ["x"], {"rmse_max": "0.5"}, None), ("7", [], {}, ["t"])]
    assert got[0].dir.endswith("set/cases/a") and got[1].dir.endswith("set/7")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "params.json").write_text("{}")
    assert [r.id for r in datasets.cases(spark, at("one")).collect()] == ["one"]
    for name, text in (("list.yaml", "[1]"), ("none.yaml", '{"cases": 3}'), ("noid.yaml", '{"cases": [{}]}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            datasets.cases(spark, at(name))
    with pytest.raises(FileNotFoundError):
        datasets.cases(spark, at("missing"))
    (tmp_path / "c.yaml").write_text('{"gate": {"rmse": 0.1}}')
    assert datasets.config(spark, at("c.yaml"), {"gate": {"rmse": 0.5, "bad": 0.2}, "x": 1}) == {"gate": {"rmse": 0.1, "bad": 0.2}, "x": 1}
    assert datasets.config(spark, at("missing.yaml"), {"x": 1}) == {"x": 1}
    with pytest.raises(ValueError):
        datasets.config(spark, at("c.yaml"), {}, ("text",))
    assert datasets.thresholds({"a": "0.5"}, {"a": 1.0, "b": 3}) == {"a": 0.5, "b": 3}
    with pytest.raises(ValueError):
        datasets.thresholds({"a": "wide"}, {"a": 1.0})
    (tmp_path / "t1.yaml").write_text('{"required_exact": ["A3"]}')
    assert datasets.vocabulary(spark, at(""), "t1") == {"required_exact": ["A3"]} and datasets.vocabulary(spark, at(""), "t2") is None
    (tmp_path / "t1.yaml").unlink()
    assert datasets.vocabulary(spark, at(""), "t1") == {"required_exact": ["A3"]}  # read once


def test_regions_scale_and_fail_alone(spark):
    g = paper(80, 200)
    g[20:40, 60:120, :3] = 0
    plan = datasets.region_plan(spark.createDataFrame([("a", "wide", 0, 0, 200, 80, 200, 80), ("a", "slow", 0, 0, 40, 40, 200, 80), ("a", "bad", 40, 0, 41, 41, 200, 80), ("a", "out", 300, 0, 10, 10, 200, 80)], "image string, region string, x int, y int, width int, height int, image_width int, image_height int"), 100)
    assert {r.region: r.factor for r in plan.collect()} == {"wide": 0.5, "slow": 1.0, "bad": 1.0}

    def recognise(grid):
        if grid.shape[:2] == (40, 40):
            time.sleep(20)
        if grid.shape[:2] == (41, 41):
            raise OSError("no engine")
        ys, xs = (grid[..., 0] < 9).nonzero()
        return [("box", 0.9, float(xs.min()), float(ys.min()), float(np.ptp(xs) + 1), float(np.ptp(ys) + 1))]

    got = {r.region: r for r in datasets.scan_regions(frame(spark, {"a": g}), plan, recognise, 0.5).collect()}
    assert (got["wide"].x, got["wide"].y, got["wide"].width, got["wide"].height) == (60.0, 20.0, 60.0, 20.0)
    assert "TimedOut" in got["slow"].error and "OSError" in got["bad"].error and got["bad"].text is None


def test_draws_repeat(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "case string")
    once, twice = ([tuple(r) for r in G.seeded_draws(d.repartition(n), "case", {"u": (2.0, 3.0), "v": (1.0, 0.0)}).orderBy("case").collect()] for n in (1, 3))
    assert once == twice and all(2 <= r[2] < 3 and 0 <= r[3] < 1 for r in once)
    import hashlib

    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(b"a").digest()[:8], "big"))
    assert once[1][2:] == (rng.uniform(2, 3), rng.uniform(0, 1))


def test_degraded_inputs(spark):
    g = paper(20, 30)
    g[5:10, 5:10, :3] = 100
    p = frame(spark, {"i": g})
    cases = spark.createDataFrame([("i", "c1")], "image string, case string")
    same = convert.degraded(p, cases, {})
    assert same.count() == 600 and same.exceptAll(p.select(*[F.col(c).cast(t) for c, t in same.dtypes])).count() == 0
    a, b = ([tuple(r) for r in convert.degraded(p.repartition(n), cases, {"noise_sigma": (5.0, 5.0), "scale": (0.5, 0.5)}).orderBy("y", "x").collect()] for n in (1, 4))
    assert a == b and sum(r[-1] == 0 for r in a) > 300


def test_heat_map(spark):
    a, b = paper(4, 4), paper(4, 4)
    a[0, 0] = [0, 0, 0, 255]
    a[1, 1] = [0, 0, 0, 0]
    a[2, 2] = [250, 255, 255, 255]
    got = {(r.y, r.x): (r.heat, r.bad) for r in raster.heat_map(frame(spark, {"i": a}), frame(spark, {"i": b}), 10).collect()}
    assert got[0, 0] == (255, True) and got[1, 1] == (0, False) and got[2, 2] == (5, False)


def test_rendered_figures_are_well_formed(spark):
    s = sizes(spark, a=(1920, 1080), b=(800, 600))
    fields = extract.architecture_fields(s.select("image"), spark.createDataFrame([("a", "title", "My <Plan> & more", 0.9, 0, 0)], "image string, region string, text string, conf double, x int, y int"))
    rows = figures.architecture(s, fields).join(s, "image")
    docs = {r.image: r.svg for r in render.documents(rows, "image", "layer", ["o"], "body", F.col("width"), F.col("height")).collect()}
    assert set(docs) == {"a"}  # the other canvas is refused
    root = ElementTree.fromstring(docs["a"])
    texts = [e.text for e in root.iter() if e.tag.endswith("text")]
    assert "My <Plan> & more" in texts and "WP1" in texts and any(t.startswith("Goal: Requirements") for t in texts)
    loop = figures.agent_loop(s, extract.loop_fields(s.select("image"), spark.createDataFrame([], "image string, region string, text string, conf double, x int, y int"))).join(s, "image")
    for r in render.documents(loop, "image", "layer", ["o"], "body", F.col("width"), F.col("height")).collect():
        assert len([e for e in ElementTree.fromstring(r.svg).iter() if e.tag.endswith("rect")]) == 4
    assert {(r.code, len(r.fields)) for r in extract.fallback_issues(fields.filter("image = 'b'")).collect()} == {("W4500", 0)}


def test_architecture_modes(spark):
    images_ = spark.createDataFrame([("a",)], "image string")
    items = spark.createDataFrame([("a", "title", "Real Title", 0.9, 0, 0), ("a", "subtitle", "#### ..", 0.9, 0, 0), ("a", "panel_A_title", "Weak", 0.2, 0, 0), ("a", "wp_WP1_body", "Goal: g1", 0.9, 0, 0), ("a", "wp_WP1_body", "o1", 0.9, 0, 1)], "image string, region string, text string, conf double, x int, y int")
    got = lambda mode: {r.field: (r.value, r.source) for r in extract.architecture_fields(images_, items, mode).collect()}
    h = got("hybrid")
    assert h["title"] == ("Real Title", "ocr") and h["subtitle"][1] == "rejected" and h["panel_A_title"][1] == "default"
    assert h["wp_WP1_goal"] == ("g1", "ocr") and h["wp_WP1_output"] == ("o1", "ocr") and len(h) == len(extract.ARCHITECTURE)
    assert got("ocr_text")["panel_A_title"] == ("Weak", "ocr") and {s for _, s in got("template_text").values()} == {"default"}
    with pytest.raises(ValueError):
        extract.architecture_fields(images_, items, "other")


def test_centre_lines(spark):
    middle = lambda x: int(45 + 30 * np.sin(x / 9))
    rows = [("i", "c", x, y) for x in range(10, 110) if x % 9 for y in range(middle(x) - 1, middle(x) + 2)]
    mask = spark.createDataFrame([*rows, ("i", "few", 1, 1), ("i", "few", 1, 2)], "image string, curve string, x int, y int")
    got = extract.centre_lines(mask, sizes(spark, i=(120, 100))).collect()
    assert [r.curve for r in got] == ["c"]
    p = got[0].points
    assert (p[0]["x"], p[-1]["x"]) == (10.0, 109.0) and 5 <= len(p) <= 25 and all(abs(q["y"] - middle(q["x"])) < 9 for q in p)
    straight = spark.createDataFrame([("i", "s", x, y) for x in range(50) for y in (4, 5, 6)], "image string, curve string, x int, y int")
    assert [q["x"] for q in extract.centre_lines(straight, sizes(spark, i=(120, 100))).first().points] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_panel_issues_of_nothing(spark):
    f = spark.createDataFrame([("k", 100, 100, 0.2, 0.6)], "k string, width int, height int, t_start double, t_trigger double")
    p = spark.createDataFrame([], "k string, panel string, x double, y double, width double, height double")
    c = spark.createDataFrame([("k", "serving", None)], "k string, curve string, points array<struct<x:double,y:double>>")
    assert sorted(r.code for r in figures.panel_issues(f, p, c, "k").collect()) == ["E2101", "E2121"]


def test_drivers_by_name_and_alias(spark):
    assert extract.driver("auto") is extract.DRIVERS["t_auto_layout"] and extract.driver("t_3gpp_events_3panel_v1") is extract.event_panels
    g = paper(40, 60)
    p = frame(spark, {"a": g, "b": g})
    texts = spark.createDataFrame([("a", 1, "Start", 8.0, 10.0, 4.0, 4.0)], "image string, item long, text string, x double, y double, width double, height double")
    d = spark.createDataFrame([("a", "t_procedure_flow"), ("b", "t_rl_agent_loop_v1")], "image string, template string")
    out = extract.extract(p, d, texts, {t: extract.DRIVERS[t] for t in ("t_procedure_flow", "t_rl_agent_loop_v1")})
    assert {r.image for r in out["t_procedure_flow"].collect()} == {"a"} and out["t_rl_agent_loop_v1"].count() == 4
    assert [r.texts for r in out["t_procedure_flow"].orderBy("node").collect()] == ["Start", "", ""]


def test_first_panel_and_roles(spark):
    boxes = spark.createDataFrame([("i", "B", 2, 0.0, 0.0, 50.0, 50.0), ("i", "A", 1, 10.0, 10.0, 50.0, 50.0)], "image string, panel string, ord int, x double, y double, width double, height double")
    t = spark.createDataFrame([("i", 1, 20.0, 20.0), ("i", 2, 2.0, 2.0), ("i", 3, 99.0, 99.0), ("j", 4, 1.0, 1.0)], "image string, item int, px double, py double")
    got = {r.item: r.panel for r in panels.panel_of(t, boxes, ["image", "item"], F.col("px"), F.col("py")).collect()}
    assert got == {1: "A", 2: "B", 3: None, 4: None}


def test_command_line(spark, tmp_path):
    from rasterlake import __main__ as cli

    g = paper(120, 200)
    g[10:60, 10:90, :3] = 0
    g[70:110, 110:190, :3] = [43, 108, 176]
    images.put_file(spark, f"file://{tmp_path}/in/f.png", images.png_bytes(g))
    words = {"image": "f.png", "item": 1, "text": "Title", "x": 20.0, "y": 2.0, "width": 160.0, "height": 6.0}
    (tmp_path / "words.json").write_text(json.dumps(words))
    run = lambda command, *more: cli.main([command, f"file://{tmp_path}/in", f"file://{tmp_path}/{command}", "--texts", f"file://{tmp_path}/words.json", *more])
    assert run("classify").first().template == "t_auto_layout"
    assert run("extract").first().template == "t_auto_layout"
    assert {"node", "curves"} <= set(spark.read.parquet(f"file://{tmp_path}/extract/t_auto_layout").columns)
    # a forced template is drawn, whatever the features say
    row = run("render", "--template", "t_rl_agent_loop_v1").first()
    assert row.template == "t_rl_agent_loop_v1" and "box_agent" in row.svg
    assert run("convert").first().code == "E5107"  # the decision is unknown
    row = run("convert", "--template", "t_auto_layout", "--allow-failed-gate").first()
    assert row.template == "t_auto_layout" and row.svg and row.rmse is not None
    images.put_file(spark, f"file://{tmp_path}/svg/one.svg", row.svg.encode())
    images.put_file(spark, f"file://{tmp_path}/svg/two.svg", b"<svg><image/></svg>")
    report = {r.doc: r.status for r in cli.main(["validate", f"file://{tmp_path}/svg", f"file://{tmp_path}/validate"]).collect()}
    assert report == {"one.svg": "pass", "two.svg": "fail"}
    cases = [{"dir": "cases/f", "force_template": "t_auto_layout", "gates": {"rmse_max": 0.9}}, {"dir": "gone"}, {"id": "x"}, {"dir": "a/f/", "id": "strict", "expected_templates": ["t_procedure_flow"]}]
    images.put_file(spark, f"file://{tmp_path}/manifests/m.json", json.dumps({"cases": cases}).encode())
    results = {r.id: (r.status, r.code) for r in cli.main(["regress", f"file://{tmp_path}/manifests", f"file://{tmp_path}/regress", "--images", f"file://{tmp_path}/in"]).collect()}
    assert results == {"f": ("pass", None), "gone": ("fail", "E1401"), "x": ("skipped", "dir_missing"), "strict": ("fail", "E1406")}
    total = spark.read.parquet(f"file://{tmp_path}/regress/summary").first()
    assert (total.total, total.passed, total.failed, total.skipped) == (3, 1, 2, 1)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_drawn_figures_are_found_again(spark):
    """What the extraction says of the drawn figures against the formula that they are drawn by."""
    from rasterlake.plans import drawings
    from rasterlake.plans.drawn import figure_pixels

    sf = "/root/testdata/sf0.001"
    d = extract.event_panels(figure_pixels(spark, sf).filter("image < 2"), drawings._sizes(spark, sf).filter("image < 2")).collect()
    assert len(d) == 6 and {r.source for r in d} == {"detected"}
    for r in d:
        begins = {"A3": 0, "A4": 213, "A5": 426}[r.panel]
        assert abs(r.x - begins) < 30 and abs(r.x_axis_y - 300) <= 3
        assert begins + 20 - 3 <= r.y_axis_x <= begins + 139  # the last upright line wins, which may be the tinted band
        assert r.fill == "#ffffff" and "#2b6cb0" in r.curve_colors and "#dd6b20" in r.curve_colors
        for name, line in (("serving", lambda px, i: 100 + 2 * i + 0.75 * px), ("neighbor", lambda px, i: 250 - i - 0.5 * px)):
            for p in r[name]:
                x, y = r.x + r.width * p["x"], r.y + r.height * (1 - p["y"])
                if 30 < x - begins < 180:
                    assert abs(y - line(x - begins, r.image)) < 6
    tree = {r.image: r.n for r in layout.xy_cut(figure_pixels(spark, sf).filter("image < 2").select("image", "y", "x", (F.col("r") + F.col("g") + F.col("b") < 720).cast("int").alias("ink"))).groupBy("image").agg(F.count("*").alias("n")).collect()}
    assert set(tree) == {0, 1} and min(tree.values()) > 1
