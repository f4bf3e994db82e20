"""Queries of the candidate loop, of texts laid out by role, and of normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import candidates, chain, normal, packed, render
from rasterlake.plans import labels
from rasterlake.plans.cases import _darkest, _texts
from rasterlake.plans.common import query, table
from rasterlake.plans.drawn import HEIGHT, SQL_PIXELS, WIDTH, figure_lines
from rasterlake.sources import datasets, images, manifests, recognised, store

#: A supplier's figure: a black box of _W by _H at (4, 4) on white, 48 x 40.
_W, _H = "(s_suppkey % 20 + 5)", "(s_nationkey % 12 + 4)"


def _box_lines(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image"), F.expr(_W).alias("w"), F.expr(_H).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y"))
    pixel = F.expr("unhex(array_join(transform(sequence(0, 47), x -> if(x >= 4 and x < 4 + w and y >= 4 and y < 4 + h, '000000FF', 'FFFFFFFF')), ''))")
    return s.select("image", "y", F.lit(48).alias("width"), F.lit(40).alias("height"), pixel.alias("rgba"))


@query(f"""WITH s AS (SELECT s_suppkey AS k, {_W} AS w, {_H} AS h FROM supplier), c AS (SELECT k, w, h, unnest(['exact', 'wide', 'tall', 'plain', 'none', 'broken']) AS template FROM s),
a AS (SELECT k, w, h, template, CASE template WHEN 'exact' THEN 1.0 WHEN 'wide' THEN 9.0 WHEN 'tall' THEN 5.0 ELSE 2.0 END AS score FROM c WHERE template = 'wide' OR template = 'exact' AND k % 5 > 0 OR template = 'tall' AND k % 3 = 0 OR template = 'plain' AND k % 7 = 0 OR template = 'none' AND k % 4 = 0 OR template = 'broken' AND k % 6 = 0),
m AS (SELECT *, CASE template WHEN 'exact' THEN 0 WHEN 'wide' THEN 3 * h WHEN 'tall' THEN w * 8 WHEN 'plain' THEN w * h END / 1920.0::DOUBLE AS bad FROM a),
g AS (SELECT *, sqrt(bad) AS rmse, CASE WHEN template IN ('none', 'broken') THEN NULL WHEN template = 'tall' AND k % 2 = 0 THEN 1 ELSE 0 END AS errors FROM m),
p AS (SELECT *, errors = 0 AND rmse <= 0.18 AND bad <= 0.05 AS pass FROM g),
b AS (SELECT k, min_by(template, (NOT pass, rmse, bad, -score, template)) FILTER (errors = 0) AS template, bool_or(pass) AS pass FROM p GROUP BY k)
SELECT b.k AS "case", CASE WHEN b.pass THEN b.template END AS template, CASE WHEN b.pass THEN 'pass' ELSE 'fail' END AS status, CASE WHEN NOT b.pass THEN 'E5108' END AS code, CASE WHEN b.pass THEN round(p.rmse, 6) END AS rmse, CASE WHEN b.pass THEN p.score::DOUBLE END AS score FROM b JOIN p ON p.k = b.k AND p.template = b.template""")
def candidate_choice(spark, sf):
    """ORC-01, ORC-04, SRT-03, GAT-02, GAT-03: up to six candidates for each supplier's drawn box, rendered, validated, rasterised and gated; the
    best one is chosen although others score higher. One candidate has no driver and one draws nothing."""
    k = F.col("s_suppkey")
    offered = {"exact": (1.0, k % 5 > 0), "wide": (9.0, F.lit(True)), "tall": (5.0, k % 3 == 0), "plain": (2.0, k % 7 == 0), "none": (2.0, k % 4 == 0), "broken": (2.0, k % 6 == 0)}
    made = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(t).alias("template"), F.lit(score).alias("score"))) for t, (score, on) in offered.items()]))
    attempts = table(spark, sf, "supplier").select(k.alias("case"), F.explode(made).alias("a")).select("case", "a.*")
    boxes = table(spark, sf, "supplier").select(k.cast("string").alias("name"), k.alias("k"), F.expr(_W).alias("w"), F.expr(_H).alias("h"))

    def rect(width: str, height: str):
        def build(f: candidates.Figure) -> candidates.Made:
            d = f.sizes.join(render.many(boxes), F.split_part("image", F.lit("|"), F.lit(1)) == F.col("name"))
            # a dashed class without a pattern is a validation error
            attrs = {"id": F.lit("box"), "x": F.lit(4), "y": F.lit(4), "width": F.expr(width), "height": F.expr(height), "fill": F.lit("black"), "class": F.when(F.expr("k % 2 = 0") & F.lit(height != "h"), "dashed")}
            return candidates.Made(d.select("image", F.lit("g_axes").alias("layer"), F.lit(0.0).alias("o"), render.element("rect", attrs).alias("body")))

        return build

    def line(f: candidates.Figure) -> candidates.Made:
        return candidates.Made(f.sizes.select("image", F.lit("g_text").alias("layer"), F.lit(0.0).alias("o"), F.lit("").alias("body")))

    builders = {"exact": rect("w", "h"), "wide": rect("w + 3", "h"), "tall": rect("w", "h + 8"), "plain": line, "none": lambda f: candidates.Made(line(f).rows.limit(0))}
    lines, texts = store.saved(_box_lines(spark, sf), "boxes"), _texts(spark, sf).withColumn("conf", F.lit(1.0)).limit(0)
    tried = store.saved(candidates.run(attempts, lines, texts, builders, (0.18, 0.05, 10.0), {"require_text": False}), "tried")
    return candidates.choose(tried, lines.select(F.col("image").alias("case")).distinct()).select("case", "template", "status", "code", F.round("rmse", 6).alias("rmse"), "score")


@query()
def converted_cases(spark, sf):
    """ORC-01, ORC-02, ORC-04, EXT-01, SRC-18, GAT-03: the drawn figures by the two best templates of their features and, one of them, by a forced
    one; the chosen attempt of each."""
    lines = figure_lines(spark, sf)
    features = packed.features(lines).withColumn("tokens", F.array().cast("array<string>"))
    forced = lines.select(F.col("image").alias("case")).distinct().select("case", F.when(F.col("case") == 0, "t_auto_layout").otherwise("t_3gpp_events_3panel").alias("template")).filter("case < 2")
    attempts, unknown = candidates.ranked(features, "image", 2, forced)
    tried = store.saved(candidates.run(attempts, lines, _texts(spark, sf).withColumn("conf", F.lit(1.0)), candidates.BUILDERS), "tried")
    d = candidates.choose(tried, lines.select(F.col("image").alias("case")).distinct(), unknown, allow_failed_gate=True)
    return d.select("case", "template", "status", "code", F.round("rmse", 4).alias("rmse"), F.round("bad", 4).alias("bad"), "warnings")


_STYLES = ", ".join(f"('{role}', {s}, '{w}', '{a}')" for role, (s, w, a) in normal.ROLE_STYLES.items())


def _layout_sql(source: str) -> str:
    """Texts laid out by role, from a table of image, item, role, x, y, bw, bh, anchor and the figure's w and h."""
    return f"""st AS (SELECT * FROM (VALUES {_STYLES}) v(srole, size, weight, sanchor)),
l0 AS (SELECT t.* EXCLUDE (anchor), coalesce(s.size, 7) * greatest(0.8, least(3.0, h / 360.0)) AS font_size, coalesce(s.weight, 'normal') AS font_weight, lower(coalesce(anchor, s.sanchor, 'start')) AS anchor, y - lag(y) OVER (PARTITION BY image ORDER BY y, item) > 2 AS new FROM {source} t LEFT JOIN st s ON s.srole = t.role),
l1 AS (SELECT *, sum(coalesce(new::INT, 0)) OVER (PARTITION BY image ORDER BY y, item) AS grp, round_even(coalesce(x, CASE WHEN role = 'title' THEN w / 2.0 ELSE 0 END) / 5, 0) * 5 AS sx FROM l0),
l2 AS (SELECT *, round_even(avg(y) OVER (PARTITION BY image, grp) / 5, 0) * 5 AS base FROM l1),
laid AS (SELECT image, item, role, round(font_size, 6)::DOUBLE AS font_size, font_weight, anchor, sx::DOUBLE AS x, base::DOUBLE AS y, (round_even(CASE WHEN bw IS NULL THEN NULL WHEN anchor = 'middle' THEN sx - bw / 2 WHEN anchor = 'end' THEN sx - bw ELSE sx END / 5, 0) * 5)::DOUBLE AS box_x, (round_even((base - bh) / 5, 0) * 5)::DOUBLE AS box_y, grp::BIGINT AS baseline_group FROM l2)"""


def _laid(d):
    return d.select("image", "item", "role", F.round("font_size", 6).alias("font_size"), "font_weight", "anchor", "x", "y", "box_x", "box_y", F.col("baseline_group").cast("long").alias("baseline_group"))


_ROLES = {"click": "title", "purchase": "panel_label", "error": "axis_label", "signup": "legend", "view": "other"}


@query(f"""WITH {labels._ITEMS}, t AS (SELECT image, item, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items())} END AS role, CASE WHEN item % 7 > 0 THEN x END AS x, y, CASE WHEN item % 5 > 0 THEN width END AS bw, CASE WHEN item % 5 > 0 THEN height END AS bh, CASE WHEN item % 11 = 0 THEN 'End' END AS anchor, 900 AS w, 600 AS h FROM i),
{_layout_sql('t')} SELECT * FROM laid""")
def role_layout(spark, sf):
    """NRM-03: texts laid out by role, on common baselines, with boxes by anchor."""
    i = labels._items(spark, sf)
    k = F.col("item")
    role = F.create_map(*[F.lit(v) for pair in _ROLES.items() for v in pair])[F.col("event_type")]
    d = i.select("image", "item", role.alias("role"), F.when(k % 7 > 0, F.col("x")).alias("x"), "y", F.when(k % 5 > 0, F.col("x")).alias("box_x"), F.when(k % 5 > 0, F.col("y")).alias("box_y"), F.when(k % 5 > 0, F.col("width")).alias("box_width"), F.when(k % 5 > 0, F.col("height")).alias("box_height"), F.when(k % 11 == 0, "End").alias("anchor"))
    return _laid(normal.text_layout(d, labels._sizes(spark, sf)))


@query(f"""WITH {labels._ITEMS}, b AS (SELECT image, item AS block, y, height, y + height AS base FROM i), n AS (SELECT *, base - lag(base) OVER (PARTITION BY image ORDER BY base, block) > 4 AS new FROM b), g AS (SELECT *, sum(coalesce(new::INT, 0)) OVER (PARTITION BY image ORDER BY base, block) AS grp FROM n),
c AS (SELECT image, avg(base) AS centre FROM g GROUP BY image, grp), m AS (SELECT b.image, b.block, b.height, min_by(c.centre, (abs(c.centre - b.base), c.centre)) AS centre FROM b JOIN c ON c.image = b.image GROUP BY b.image, b.block, b.height)
SELECT image, block, (round_even(centre / 2, 0) * 2 - height)::DOUBLE AS y FROM m""")
def block_baselines(spark, sf):
    """NRM-04: blocks of text moved to common baselines."""
    d = labels._items(spark, sf).select("image", F.col("item").alias("block"), "y", "height")
    return normal.block_baselines(d, 2.0).select("image", "block", "y")


@query("""WITH p AS (SELECT l_orderkey AS k, list(printf('%.4f,%.4f', round_even(l_partkey / 97.0::DOUBLE, 4), round_even(l_extendedprice / 991.0::DOUBLE, 4)) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pts FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 10)
SELECT k, array_to_string(pts, ' ') AS points, CASE WHEN k % 2 = 1 THEN NULL WHEN k % 3 = 0 THEN '1.0,2.0' ELSE greatest(4.0, 3.0 * (k % 4 + 1))::DOUBLE || ',' || greatest(3.0, 2.0 * (k % 4 + 1))::DOUBLE END AS dasharray FROM p""")
def normal_plots(spark, sf):
    """NRM-01, ALG-06: series of line plots within their budget of points, with the default pattern of dashes; those of up to ten points."""
    k = F.col("l_orderkey")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r")).filter(F.size("r") <= 10)
    d = d.select(k.alias("k"), F.transform("r", lambda s: F.struct((s["l_partkey"] / 97.0).alias("x"), (s["l_extendedprice"] / 991.0).alias("y"))).alias("points"), (k % 2 == 0).alias("dashed"), F.when(k % 3 == 0, F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(2.0)))).alias("dasharray"), (k % 4 + 1).cast("double").alias("stroke_width"))
    n = normal.normal_series(d)
    return n.select("k", F.array_join(F.transform("points", lambda p: F.format_string("%.4f,%.4f", p["x"], p["y"])), " ").alias("points"), F.array_join(F.col("dasharray").cast("array<string>"), ",").alias("dasharray"))


_SNAP = lambda v: f"round_even(({v}) / 5.0, 0) * 5"


@query(f"""WITH n AS (SELECT o_orderkey AS k, {_SNAP('o_custkey % 501 * 1.3')} AS ax, {_SNAP('o_custkey % 77')} AS ay, greatest(1, {_SNAP('o_custkey % 9')}) AS aw, greatest(1, {_SNAP('40')}) AS ah FROM orders),
q AS (SELECT l_orderkey AS k, {_SNAP('l_quantity * 7')} AS x, {_SNAP('l_suppkey % 10 * 4')} AS y, row_number() OVER w AS i, lead({_SNAP('l_quantity * 7')}) OVER w AS nx, lead({_SNAP('l_suppkey % 10 * 4')}) OVER w AS ny FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
f AS (SELECT k, count(*) AS c, list_reduce(list([{{'x': x, 'y': y, 'nx': nx, 'ny': ny}}] ORDER BY i), lambda a, b: CASE WHEN b[1].nx IS NOT NULL AND (abs(b[1].x - a[-1].x) <= 2 AND abs(b[1].nx - b[1].x) <= 2 OR abs(b[1].y - a[-1].y) <= 2 AND abs(b[1].ny - b[1].y) <= 2) THEN a ELSE list_concat(a, b) END) AS p FROM q GROUP BY k)
SELECT f.k, CASE WHEN c < 2 THEN c ELSE len(p) END AS n, CASE WHEN c >= 2 THEN array_to_string(list_transform(list_slice(p, 2, len(p) - 1), lambda e: CAST(e.x AS BIGINT) || ',' || CAST(e.y AS BIGINT)), ' ') END AS middle,
CASE WHEN c >= 2 THEN CASE WHEN f.k % 4 > 0 THEN ({_SNAP('ax + aw / 2')})::BIGINT || ',' || ({_SNAP('ay + ah / 2')})::BIGINT ELSE p[1].x::BIGINT || ',' || p[1].y::BIGINT END END AS first, CASE WHEN c >= 2 THEN p[-1].x::BIGINT || ',' || p[-1].y::BIGINT END AS last FROM f JOIN n ON n.k = f.k""")
def normal_flows(spark, sf):
    """NRM-01, WIN-15: edges of flow charts on the grid, without points in line, and from the middle of their first node where it exists."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    l = table(spark, sf, "lineitem")  # noqa: E741
    o = store.dealt(table(spark, sf, "orders"), "o_orderkey", like=l)
    nodes = o.filter(k % 4 > 0).select(k.alias("k"), F.lit("a").alias("id"), (c % 501 * 1.3).cast("double").alias("x"), (c % 77).cast("double").alias("y"), (c % 9).cast("double").alias("width"), F.lit(40.0).alias("height"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    points = F.transform(F.array_sort(F.collect_list(at)), lambda s: F.struct((s["l_quantity"] * 7).alias("x"), (s["l_suppkey"] % 10 * 4).cast("double").alias("y")))
    edges = store.dealt(l, "l_orderkey").join(render.many(o.select(k.alias("l_orderkey"))), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("k")).agg(points.alias("points"))
    edges = edges.select("k", F.lit("a").alias("a"), F.lit("gone").alias("b"), "points", F.lit(False).alias("dashed"), F.lit(None).cast("array<double>").alias("dasharray"), F.lit(2.0).alias("stroke_width"))
    d = normal.normal_flow(nodes, edges, "k", 5.0)[1]
    text = lambda p: F.concat(p["x"].cast("long").cast("string"), F.lit(","), p["y"].cast("long").cast("string"))
    two = F.size("points") >= 2
    return d.select("k", F.size("points").cast("long").alias("n"), F.when(two, F.array_join(F.transform(F.slice("points", 2, F.greatest(F.size("points") - 2, F.lit(0))), text), " ")).alias("middle"), F.when(two, text(F.get("points", F.lit(0)))).alias("first"), F.when(two, text(F.element_at("points", -1))).alias("last"))


def _silent(grid):
    raise ValueError("nothing is recognised any more")


@query(f"""WITH {SQL_PIXELS}, p AS (SELECT k, 40 * k - 20 AS x, 30 * k AS y FROM range(16) t(k)), q AS (SELECT k, greatest(x, 0) AS x0, y AS y0, least(x + 100, {WIDTH}) AS x1, least(y + 45, {HEIGHT}) AS y1 FROM p)
SELECT f.image, CAST(k AS BIGINT) AS region, round(count(*) / any_value((x1 - x0) * (y1 - y0)), 6) AS conf, min(f.x)::DOUBLE AS x, min(f.y)::DOUBLE AS y, (max(f.x) - min(f.x) + 1)::DOUBLE AS width, (max(f.y) - min(f.y) + 1)::DOUBLE AS height FROM q JOIN f ON f.x >= x0 AND f.x < x1 AND f.y >= y0 AND f.y < y1 WHERE x1 > x0 AND y1 > y0 AND r + g + b < 150 GROUP BY f.image, k""")
def cached_regions(spark, sf):
    """SRC-13, SRC-14, PRJ-18: regions of the drawn figures recognised once, and read from the cache by a second scan whose recogniser only fails."""
    lines, k = figure_lines(spark, sf), F.col("region")
    plan = lines.select("image", F.col("width").alias("image_width"), F.col("height").alias("image_height")).distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("region"))
    plan = datasets.region_plan(plan.withColumn("x", 40 * k - 20).withColumn("y", 30 * k).withColumn("width", F.lit(100)).withColumn("height", F.lit(45)), 1200)
    cache = f"{images.work_folder(spark)}/words"
    recognised.scan(lines, plan, _darkest, cache, {"engine": "dark"})
    d = recognised.scan(lines, plan, _silent, cache, {"engine": "dark"})
    return d.select("image", "region", F.round("conf", 6).alias("conf"), "x", "y", "width", "height")


_TEMPLATES = {0: "t_3gpp_events_3panel", 1: "t_performance_lineplot", 2: "t_procedure_flow", 3: "t_auto_layout", 4: "t_rl_agent_loop_v1"}


@query(f"""WITH n AS (SELECT n_regionkey::BIGINT AS image, n_nationkey::BIGINT AS item, n_name AS text, (n_nationkey * 97 % 600)::DOUBLE AS x, (n_nationkey * 53 % 340)::DOUBLE AS y, 30.0::DOUBLE AS width, 12.0::DOUBLE AS height FROM nation WHERE n_name NOT LIKE 'I%' AND n_nationkey % 6 > 0),
c AS (SELECT *, x + 15 AS cx, y + 6 AS cy FROM n), b AS (SELECT * FROM (VALUES (20, 200), (230, 190), (430, 200)) v(px, pw)),
r AS (SELECT *, CASE image
  WHEN 0 THEN CASE WHEN EXISTS (SELECT 1 FROM b WHERE cx BETWEEN px AND px + pw AND cy BETWEEN 40 AND 40 + 280 * 0.3) THEN 'panel_label' WHEN EXISTS (SELECT 1 FROM b WHERE cx BETWEEN px AND px + pw AND cy BETWEEN 40 + 280 * 0.8 AND 320) THEN 'axis_label' ELSE 'annotation' END
  WHEN 1 THEN CASE WHEN cx BETWEEN 76 AND 589 AND cy >= 317 THEN 'axis_label_x' WHEN cx <= 76 AND cy BETWEEN 64 AND 317 THEN 'axis_label_y' WHEN cy <= 64 AND cx >= 76 + 513 * 0.6 THEN 'legend' ELSE 'annotation' END
  WHEN 2 THEN CASE WHEN cy BETWEEN 72 AND 129 AND (cx BETWEEN 64 AND 204 OR cx BETWEEN 242 AND 382 OR cx BETWEEN 420 AND 560) THEN 'node_label' ELSE 'annotation' END
  ELSE CASE WHEN y < 54 THEN 'title' WHEN y > 306 THEN 'axis_x' WHEN x < 96 THEN 'axis_y' ELSE 'annotation' END END AS role FROM c),
t AS (SELECT image, item, role, x, y + 12 AS y, width AS bw, height AS bh, NULL::VARCHAR AS anchor, 640 AS w, 360 AS h FROM r),
{_layout_sql('t')} SELECT laid.*, r.text FROM laid JOIN r USING (image, item)""")
def figure_texts(spark, sf):
    """EXT-01, NRM-03, FLT-07, SET-06, JON-03 to JON-05: recognised words as laid-out texts of figures of five templates, noise and doubtful words left out."""
    k = F.col("item")
    words = _texts(spark, sf).withColumn("conf", F.when(k % 6 > 0, 0.9).otherwise(0.2))
    words = words.unionByName(words.withColumn("conf", F.col("conf") / 2).withColumn("item", k + 1000))  # each once more, less surely
    sizes = words.select("image").distinct().withColumn("width", F.lit(640)).withColumn("height", F.lit(360))
    decisions = sizes.select("image", F.create_map(*[v for n, t in _TEMPLATES.items() for v in (F.lit(n).cast("long"), F.lit(t))])[F.col("image")].alias("template"))
    boxes = sizes.select("image", F.explode(F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(o).alias("ord"), F.lit(float(x)).alias("x"), F.lit(40.0).alias("y"), F.lit(float(w)).alias("width"), F.lit(280.0).alias("height")) for p, o, x, w in (("A3", 1, 20, 200), ("A4", 2, 230, 190), ("A5", 3, 430, 200))])).alias("b")).select("image", "b.*")
    d = chain.figure_texts(words, decisions, sizes, boxes, ["^I"], [], 0.4)
    return _laid(d).join(d.select("image", "item", "text"), ["image", "item"])


@query("""WITH c AS (SELECT s_nationkey AS m, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord FROM supplier),
d AS (SELECT *, CASE WHEN m % 11 = 0 THEN NULL WHEN k % 9 = 0 THEN 'x' || m || '/' || (k % 2) WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 'cases/' || k ELSE 'cases/' || k || '/' END AS dir FROM c),
i AS (SELECT *, CASE WHEN k % 9 = 0 THEN k % 2 || '' WHEN k % 7 = 0 THEN 'same' WHEN dir IS NOT NULL THEN k || '' END AS id, k % 9 > 0 AND k % 3 > 0 AS obj FROM d WHERE m % 11 > 0)
SELECT 'm' || m || '.json' AS manifest, CAST(ord AS INTEGER) AS ord, coalesce(id, '-') AS id, coalesce(dir, '-') AS dir, CASE WHEN k % 9 > 0 AND k % 4 > 0 THEN (k % 4) / 4.0 END::DOUBLE AS rmse_max,
array_to_string(list_sort(list_filter([CASE WHEN dir IS NULL THEN 'dir_missing' END, CASE WHEN k % 9 > 0 AND k % 4 = 0 THEN 'gate_not_numeric:rmse_max' END, CASE WHEN k % 9 > 0 AND k % 5 = 0 THEN 'unknown_field:note' END, CASE WHEN k % 9 > 0 AND k % 6 = 0 THEN 'tags_not_a_list' END,
  CASE WHEN id IS NOT NULL AND ord > min(ord) OVER (PARTITION BY m, id) THEN 'duplicate_id' END], lambda x: x IS NOT NULL)), ',') AS issues FROM i
UNION ALL SELECT DISTINCT 'm' || m || '.json', -1, '-', '-', NULL, CASE WHEN m = 0 THEN 'not_json' ELSE 'cases_missing' END FROM c WHERE m % 11 = 0""")
def manifest_cases(spark, sf):
    """SRC-05, ORC-06: cases of manifests written as JSON, a file a nation, with their issues; some files are no JSON or have no list of cases."""
    k, m = F.col("s_suppkey"), F.col("s_nationkey")
    q = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    ks = k.cast("string")
    folder = F.when(k % 3 == 0, F.concat(F.lit("cases/"), ks)).otherwise(F.concat(F.lit("cases/"), ks, F.lit("/")))
    parts = F.array_compact(F.array(
        F.when(k % 10 > 0, q("dir", text(folder))), F.when(k % 7 == 0, q("id", text(F.lit("same")))), F.when(k % 5 == 0, F.lit('"note": 1')), F.when(k % 6 == 0, F.lit('"tags": "one"')).otherwise(F.lit('"tags": ["a", "b"]')),
        q("gates", F.concat(F.lit('{"rmse_max": '), F.when(k % 4 == 0, F.lit('"wide"')).otherwise((k % 4 / 4.0).cast("string")), F.lit("}"))),
    ))
    entry = F.when(k % 9 == 0, text(F.concat(F.lit("x"), m.cast("string"), F.lit("/"), (k % 2).cast("string")))).otherwise(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))
    cases = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("e")))), lambda s: s["e"]), ", ").alias("cases"))
    body = F.when(m == 0, "no json {").when(m % 11 == 0, '{"cases": {"a": 1}}').otherwise(F.concat(F.lit('{"cases": ['), "cases", F.lit("]}")))
    folder_ = images.work_folder(spark)
    for r in cases.select(F.concat(F.lit("m"), m.cast("string"), F.lit(".json")).alias("name"), body.alias("body")).toLocalIterator():  # a small file a nation: Spark has no sink of named files
        images.put_file(spark, f"{folder_}/{r.name}", r.body.encode())
    d = manifests.read(spark, folder_)
    return d.select("manifest", "ord", F.coalesce("id", F.lit("-")).alias("id"), F.coalesce("dir", F.lit("-")).alias("dir"), "rmse_max", F.array_join("issues", ",").alias("issues"))
