"""Operators against plain Python, and the documented small cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import curves, raster, render, rules, scoring, sequence, spatial, text
from rasterlake.sources import images, markup


def one(spark, **columns):
    return lambda c: spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(c).first()[0]


def test_colours(spark):
    import colorsys

    rng = np.random.default_rng(1)
    rows = [tuple(map(int, c)) for c in rng.integers(0, 256, (60, 3))] + [(0, 0, 0), (255, 255, 255), (10, 10, 3)]
    d = spark.createDataFrame(rows, "r int, g int, b int")
    rgb = [F.col(c) for c in "rgb"]
    for r in d.select("r", "g", "b", X.hue(*rgb).alias("h"), X.saturation(*rgb).alias("s"), X.hex_color(*rgb).alias("x"), X.from_hex(X.hex_color(*rgb), 1).alias("g2")).collect():
        h, s, _ = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        ties = sorted((r.r, r.g, r.b))[1] == max(r.r, r.g, r.b)
        assert ties or abs((r.h - 360 * h + 180) % 360 - 180) < 1e-6
        assert abs(r.s - s) < 1e-9 and r.x == f"#{r.r:02x}{r.g:02x}{r.b:02x}" and r.g2 == r.g


def test_half_even_and_clamp(spark):
    at = one(spark, v=2.5)
    assert at(X.snap(F.col("v"), 1)) == 2.0 and at(X.snap(F.col("v"), 5)) == 0.0 and at(X.clamp(F.col("v"), 3, 4)) == 3.0 and at(X.snap_to_edge(F.col("v"), 3.0, 0.5)) == 3.0


def test_text_predicates(spark):
    at = one(spark, v="x")
    f = lambda g, s: at(g(F.lit(s)))
    assert f(X.random_chars, "aB3") and not f(X.random_chars, "abc") and f(X.random_chars, "x") and not f(X.random_chars, "A")
    assert f(X.suspicious, "ab cd") and f(X.suspicious, "a b c word") and f(X.suspicious, "oooops") and not f(X.suspicious, "plain words here")
    assert f(X.sanitize, " ..foo! b (bar) ") == "foo bar" and f(X.sanitize, "a b") == "a b"
    assert f(X.collapse, "  a \n b ") == "a b" and f(X.leading_number, " -1.5px") == -1.5 and f(X.leading_number, "auto") is None
    assert f(X.parse_color, "#0F0") == "rgb(0,255,0)" and f(X.parse_color, "rgb(10%, 50%,100%)") == "rgb(26,128,255)" and f(X.parse_color, "url(#a)") is None and f(X.parse_color, " Red") == "red"
    assert at(X.similarity(F.lit("Kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert [at(X.apply_case(F.lit(t), F.lit("wORd"))) for t in ("ABC", "abc", "Abc", "aBc")] == ["WORD", "word", "Word", "wORd"]


def test_wrapping(spark):
    import textwrap

    s = "the quick brown fox jumps over the lazy dog and keeps running for a while"
    at = one(spark, v="x")
    lines = at(X.word_wrap(F.lit(s), 16))
    assert lines == textwrap.wrap(s, 16)
    assert at(X.truncate_lines(X.word_wrap(F.lit(s), 16), 2, 16))[1].endswith("...")


def test_runs_and_dashes(spark):
    bits = [1, 1, 0, 1, 1, 0, 0, 1, 1, 0, 1, 1]
    d = spark.createDataFrame([(0, i, b) for i, b in enumerate(bits)], "k int, i int, b int")
    r = sequence.run_length(d, ["k"], ["i"], F.col("b") == 1)
    got = sorted((x.start, x.len, x.value) for x in r.collect())
    want, at = [], 0
    for v, g in itertools.groupby(bits):
        n = len(list(g))
        want.append((at, n, v == 1))
        at += n
    assert got == want
    s = sequence.dash_class(sequence.dash_stats(r.filter("value"), ["k"])).first()
    assert (s.n, s.dash, s.gaps) == (4, 2.0, 3) and s.pattern in {"uniform", "alternating"}
    few = sequence.dash_class(sequence.dash_stats(r.filter("value AND start < 5"), ["k"])).first()
    assert few.pattern == "unknown" and few.confidence == 0


def test_smoothing_equals_numpy(spark):
    v = np.random.default_rng(3).integers(0, 50, 23)
    d = spark.createDataFrame([(0, i, int(x)) for i, x in enumerate(v)], "k int, i int, v int")
    got = [r.smooth for r in sequence.moving_average(d, ["k"], "i", "v", 5).orderBy("i").collect()]
    assert np.allclose(got, np.convolve(np.pad(v, 2, mode="edge"), np.ones(5) / 5, "valid"))


def test_folds(spark):
    at = one(spark, v=[1.0, 2.0, 3.4, 1.5, 9.0])
    assert at(sequence.snap_flat(F.col("v"), 1.5)) == [1.0, 1.0, 3.4, 1.5, 9.0]
    at = one(spark, v=[1.0, 3.0, 5.5, 9.0])
    assert at(sequence.moving_centre_groups(F.col("v"), 4.0)) == [0, 0, 0, 1]
    at = one(spark, v=["a", "A", "b", "a"])
    assert at(sequence.drop_repeats(F.col("v"))) == ["a", "b", "a"]


def test_interpolation(spark):
    d = spark.createDataFrame([(0, 1, 10.0), (0, 4, 16.0), (0, 5, 5.0)], "k int, x int, v double")
    assert [r.v for r in sequence.interpolate(d, ["k"], "x", "v").orderBy("x").collect()] == [10.0, 12.0, 14.0, 16.0, 5.0]


def test_decisions(spark):
    d = spark.createDataFrame([(1, 5), (2, 0), (3, 9)], "id int, v int")
    rules_ = {"a": [(F.col("v") >= 5, 2.0)], "b": [(F.col("v") >= 9, 2.0), (F.col("v") > 0, 0.5)]}
    got = {r.id: r for r in scoring.decide(d, ["id"], rules_).collect()}
    assert got[1].decision == "a" and got[1].confidence == 1.0
    assert got[2].reasons == "LOW_CONFIDENCE,AMBIGUOUS_MARGIN,FALLBACK_TO_AUTO" and got[2].top == "a" and got[2].confidence == 0.5
    assert got[3].top == "b" and got[3].score == 2.5


def test_containment_equals_pairs(spark):
    rng = np.random.default_rng(5)
    p = [(i, *map(float, v)) for i, v in enumerate(rng.integers(-50, 250, (80, 2)))]
    b = [(i, *map(float, v)) for i, v in enumerate(np.column_stack([rng.integers(0, 200, (12, 2)), rng.integers(1, 90, (12, 2))]))]
    got = spatial.contain(spark.createDataFrame(p, "pid int, px double, py double"), spark.createDataFrame(b, "bid int, x double, y double, w double, h double"), "px", "py", ("x", "y", "w", "h"), 40.0, 5.0)
    want = {(i, j) for i, px, py in p for j, x, y, w, h in b if x - 5 <= px <= x + w + 5 and y - 5 <= py <= y + h + 5}
    rows = [(r.pid, r.bid) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = [(i % 2, float(x)) for i, x in enumerate(rng.integers(0, 100, 40))]
    c = [(0, 10.0), (0, 50.0), (1, 20.0), (1, 22.0)]
    got = spatial.nearest(spark.createDataFrame(v, "k int, v double"), ["k"], "v", spark.createDataFrame(c, "k int, c double"), "c").collect()
    assert len(got) == 40 and all(r.centre == min((abs(r.v - y), y) for k, y in c if k == r.k)[1] for r in got)


def test_greedy_dedup_equals_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(k % 3, k, *map(float, v)) for k, v in enumerate(rng.integers(0, 30, (90, 4)))]
    rows = [(g, k, a, b, w + 1, h + 1) for g, k, a, b, w, h in rows]
    d = spark.createDataFrame(rows, "g int, k int, x double, y double, w double, h double")
    got = {(r.g, r.k) for r in spatial.rect_nms(d, ["g"], ["x", "y", "w", "h"], "k", 0.6).collect()}
    want = set()
    for g in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4] * r[5], r[1])):
            def over(a, b):
                w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
                h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
                return max(w, 0) * max(h, 0) / min(a[4] * a[5], b[4] * b[5])

            if all(over(r, k) < 0.6 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


def test_line_dedup(spark):
    rows = [(0, 0, 10.0, 0.0, 10.0, 50.0), (0, 1, 11.0, 0.0, 11.0, 53.0), (0, 2, 30.0, 5.0, 80.0, 5.0), (0, 3, 5.0, 5.0, 5.0, 5.0), (0, 4, 0.0, 0.0, 40.0, 40.0)]
    got = spatial.line_dedup(spark.createDataFrame(rows, "g int, k int, x1 double, y1 double, x2 double, y2 double"), ["g"], ["x1", "y1", "x2", "y2"], "k")
    assert sorted((r.k, r.orientation) for r in got.collect()) == [(1, "vertical"), (2, "horizontal"), (3, "horizontal"), (3, "vertical"), (4, "other")]


def test_text_dedup_and_grid(spark):
    rows = [(0, 0, "Label one", 0.0, 0.0, 0.5), (0, 1, "label one", 3.0, 0.0, 0.9), (0, 2, "label one", 90.0, 0.0, 0.7), (0, 3, " ", 0.0, 0.0, 0.9), (0, 4, "Labe1 one", 1.0, 1.0, 0.9)]
    d = spark.createDataFrame(rows, "g int, k int, t string, x double, y double, c double")
    assert sorted(r.k for r in spatial.text_dedup(d, ["g"], "t", "x", "y", "k").collect()) == [0, 2]
    got = text.grid_dedup(d, [F.lower("t"), F.bround(F.col("x") / 10)], "k", "c").collect()
    assert sorted((r.slot, r.k) for r in got) == [(0, 1), (2, 2), (3, 3), (4, 4)]


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(9)
    grid = (rng.random((3, 14, 17)) < 0.45).astype(int)
    d = spark.createDataFrame([(i, y, x, int(v)) for i in range(3) for (y, x), v in np.ndenumerate(grid[i])], "image int, y int, x int, v int")
    got = sorted((r.image, r.x, r.y, r.width, r.height, r.area) for r in raster.components(d, "v").collect())
    want = []
    for i in range(3):
        left = {tuple(p) for p in np.argwhere(grid[i])}
        while left:
            stack, seen = [left.pop()], []
            while stack:
                y, x = stack.pop()
                seen.append((y, x))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.remove(q)
                        stack.append(q)
            ys, xs = zip(*seen, strict=True)
            want.append((i, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
    assert got == sorted(want)


def test_diff(spark):
    a = spark.createDataFrame([("i", y, x, 10.0) for y in range(8) for x in range(8)], "image string, y int, x int, v double")
    same = raster.diff(a, a, ["image", "y", "x"], ["v"], 10).first()
    far = raster.diff(a, a.withColumn("v", F.col("v") + 51), ["image", "y", "x"], ["v"], 10).first()
    assert (same.rmse, same.bad) == (0.0, 0.0) and far.rmse == pytest.approx(0.2) and far.bad == 1.0


def test_curves(spark):
    t = np.linspace(0, math.pi, 40)
    p = np.column_stack([t * 50, 40 * np.sin(t)])
    keep = p[curves.rdp(p, 1.0)]
    assert 4 < len(keep) < 15 and (keep[0] == p[0]).all() and (keep[-1] == p[-1]).all()
    for seg in [curves.fit_bezier(p, 0.5)]:
        u = np.linspace(0, 1, 200)[:, None]
        path = np.vstack([(1 - u) ** 3 * c[0] + 3 * (1 - u) ** 2 * u * c[1] + 3 * (1 - u) * u**2 * c[2] + u**3 * c[3] for c in seg])
        assert max(np.hypot(*(path - q).T).min() for q in p) < 1.0 and len(seg) <= 4
    assert len(curves.simplify_array(p, 5, 2, 0.01)) <= 5
    at = one(spark, v=[0.0])
    pts = F.transform(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (2, 0), (3, 1), (4, 2))]), lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    assert [(q.x, q.y) for q in at(curves.collinear(pts, 1e-9))] == [(0, 0), (2, 0), (4, 2)]


SVG = """<svg xmlns="http://www.w3.org/2000/svg"><g id="g_axes"/><g id="figure_root"><text id="a" text-anchor="start" style="font-family: Arial">x</text><text>y
z</text><line id="l" x1="0" y1="10" x2="50" y2="10.3"/><path id="txt_1" d="M 0 0 L 1 1"/><image href="q"/><rect class="dashed"/></g></svg>"""


def test_validation(spark):
    d = spark.createDataFrame([("one", SVG), ("bad", "<svg><g>")], "doc string, svg string")
    e = markup.elements(d, "doc", "svg")
    found = rules.validate_elements(e, {"forbid_elements": ["image"], "required_groups": ["g_axes", "g_text"], "allowed_font_families": ["Arial"]})
    codes = sorted(r.code for r in found.filter("doc = 'one'").collect())
    assert codes == ["E2001", "E2003", "E2009", "E2010", "E2012", "E2013", "E2016", "W2101"]
    status = {r.doc: r.status for r in rules.report(e, found).collect()}
    assert status == {"one": "fail", "bad": "fail"}
    assert e.filter("doc = 'bad'").first().tag == "!error" and e.filter("tag = 'text' AND attrs['font-family'] = 'Arial'").count() == 1


def test_rule_limits(spark):
    at = one(spark, v=1)
    assert [at(rules.required_texts(F.lit(n))) for n in (0, 1, 2, 4, 10)] == [0, 1, 1, 3, 7]
    assert at(rules.path_commands(F.lit("M0 0" + "L1 1" * 70))) == 71
    d = spark.createDataFrame([("a", 2.1), ("a", 2.3), ("a", 2.3)], "doc string, w double")
    assert [r.subject for r in rules.off_set(d, "doc", "w", [1.0, 2.0], 0.2).collect()] == ["2.3"]
    s = spark.createDataFrame([("a", 1, "k")] * 6 + [("a", 2, "k")] * 5, "doc string, y int, stroke string")
    assert [r.subject for r in rules.simulated_dashes(s, "doc", ["y", "stroke"]).collect()] == ["1|k|6"]
    assert len(rules.CODES) == 29


def test_png_round_trip(spark, tmp_path):
    rgba = np.random.default_rng(2).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    rgba[..., 3] = 255
    (tmp_path / "a.png").write_bytes(images.png_bytes(rgba))
    (tmp_path / "b.png").write_bytes(b"no image")
    assert {r.path.rsplit("/", 1)[1]: r.valid for r in images.scan_files(spark, str(tmp_path)).collect()} == {"a.png": True, "b.png": False}
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in images.pixels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): tuple(map(int, rgba[y, x, :3])) for y in range(5) for x in range(7)}


def test_svg_text(spark):
    at = one(spark, v="a<b")
    assert at(render.element("text", {"id": F.col("v"), "x": F.lit(None)}, F.col("v"))) == '<text id="a&lt;b">a&lt;b</text>'
    cells = render.grid_cells(spark.createDataFrame([(1000, 800)], "w0 int, h0 int"), "w0", "h0", 2, 2).collect()
    assert len(cells) == 4 and cells[0].x == 60.0 and cells[0].y == 96.0


def test_every_element_code_can_arise(spark):
    text = '<text id="t" text-anchor="start" font-family="Arial, serif" y="5">x</text>'
    dash = "".join(f'<line id="d{k}" x1="{9 * k}" y1="3" x2="{9 * k + 4}" y2="3" stroke="red" stroke-width="1"/>' for k in range(6))
    bodies = {
        "none": text, "E2001": "<image/>" + text, "E2002": "<feBlend/>" + text, "E2004": text.replace("Arial", "Courier"), "E2005": text + "".join(f'<rect fill="#00000{k}"/>' for k in range(7)),
        "E2006": text + '<rect stroke="red" stroke-width="7"/>', "E2007": text + f'<path d="M0 0{"L1 1" * 80}"/>', "E2008": "", "E2009": text.replace('id="t"', ""), "E2010": text + '<path id="txt_a" d="M0 0"/>',
        "E2011": text.replace("x</text>", "<tspan>x</tspan></text>"), "E2012": text.replace("x<", "x\n<"), "E2013": text + '<line class="dashed"/>', "E2014": text, "E2015": text.replace(", serif", ""), "E2016": text.replace("start", "left"),
        "W2101": text + '<line x1="0" y1="1" x2="9" y2="1.2"/>', "W2102": text + dash, "W2104": text + f'<polyline points="{"1,1 " * 31}"/>', "W2105": text + '<polyline points="0,0 9,0.3 9,9"/>',
        "W2106": text + text.replace('id="t"', 'id="u"').replace('"5"', '"5.5"'),
    }
    docs = [(k, f'<svg><g id="g_text">{x}</g></svg>') for k, x in bodies.items()]
    docs += [("E2003", f'<svg><g id="a"><g id="g_text2">{text}</g></g></svg>'), ("W2103", f'<svg><g id="g_text"/>{text}</svg>'), ("E2017", '<svg><g id="g_text"/></svg>')]
    docs += [("font of the group", f"""<svg><g id="g_text" style="font-family: Arial">{text.replace(' font-family="Arial, serif"', "")}</g></svg>"""), ("one baseline", '<svg><g id="g_text" dominant-baseline="middle">' + bodies["W2106"] + "</g></svg>")]
    e = markup.elements(spark.createDataFrame(docs, "doc string, svg string"), "doc", "svg")
    contract = {"forbid_elements": ["image"], "forbid_element_prefixes": ["fe"], "required_groups": ["g_text"], "allowed_font_families": ["Arial"], "generic_font_families": ["serif", "sans-serif"], "text_group": "g_text", "allowed_stroke_widths": [1.0]}
    issues = rules.validate_elements(e, contract, spark.createDataFrame([("E2014", 10), ("E2017", 10), ("none", 1)], "doc string, texts_detected int")).cache()
    got = {d: set() for d, _ in docs}
    for r in issues.collect():
        got[r.doc].add(r.code)
    want = {d: {d} for d, _ in docs} | {"none": set(), "one baseline": set(), "font of the group": {"E2015"}, "E2003": {"E2003", "W2103"}, "E2017": {"E2008", "E2017"}}
    assert got == want
    assert {c for c in rules.CODES if c[:2] in ("E2", "W2")} <= set.union(*got.values())
    status = {r.doc: r.status for r in rules.report(e, issues).collect()}
    assert status["none"] == "pass" and status["E2008"] == status["E2015"] == "fail"
