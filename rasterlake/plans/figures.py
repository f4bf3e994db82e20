"""Queries that run whole figures and whole manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import batch, render, templates
from rasterlake.plans.common import query, table


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS template, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_discount END AS rmse, l_tax AS bad, l_linenumber % 3 AS warnings, l_quantity AS score, CASE WHEN l_discount <= 0.05 THEN 'pass' ELSE 'fail' END AS status FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY status <> 'pass', coalesce(rmse, 'Infinity'::DOUBLE), bad, warnings, -score, template) AS r FROM g)
SELECT l_orderkey, template, status, round(coalesce(rmse, -1), 6) AS rmse, bad, CAST(warnings AS INTEGER) AS warnings, score FROM r WHERE r = 1""")
def select_attempts(spark, sf):
    """ORC-01, SRT-03: the best attempt of each case, failed ones only where nothing passed."""
    a = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("template"), F.when(F.col("l_tax") <= 0.07, F.col("l_discount")).alias("rmse"), F.col("l_tax").alias("bad"), (F.col("l_linenumber") % 3).alias("warnings"), F.col("l_quantity").alias("score"), F.when(F.col("l_discount") <= 0.05, "pass").otherwise("fail").alias("status"))
    return batch.select(a, "l_orderkey").select("l_orderkey", "template", "status", F.round(F.coalesce("rmse", F.lit(-1.0)), 6).alias("rmse"), "bad", "warnings", "score")


@query("""WITH s AS (SELECT o_orderpriority AS tier, CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN o_totalprice < 150000 THEN 'pass' ELSE 'fail' END AS status FROM orders)
SELECT tier, count(*) FILTER (status <> 'skipped') AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
round_even(CASE WHEN count(*) FILTER (status <> 'skipped') > 0 THEN count(*) FILTER (status = 'pass') / count(*) FILTER (status <> 'skipped') ELSE 0 END, 4) AS rate FROM s GROUP BY tier""")
def case_summary(spark, sf):
    """AGG-27, AGG-28, SRC-16."""
    s = F.when(F.col("o_orderstatus") == "P", "skipped").when(F.col("o_totalprice") < 150000, "pass").otherwise("fail")
    return batch.summary(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), s.alias("status")), ["tier"])


@query()
def render_lineplot(spark, sf):
    """RND-04, AGG-33, PRJ-16: monthly order totals of each segment, one line a priority."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.groupBy("c_mktsegment", "o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return render.documents(templates.line_plot(p, "c_mktsegment", "o_orderpriority", "m", "v"), "c_mktsegment", "layer", ["o"], "body", F.lit(800), F.lit(480))


_AT = "n_nationkey % 4 * 160.0"
_FLOW = f"""n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_nationkey::VARCHAR AS id, ({_AT})::DOUBLE AS x, (n_nationkey // 4 * 90.0)::DOUBLE AS y, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' & more words' ELSE n_name || chr(10) || 'two' END AS t FROM nation),
e AS (SELECT r, id AS a, lead(id) OVER w AS b, k, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM n WINDOW w AS (PARTITION BY r ORDER BY k)),
f AS (SELECT *, CASE WHEN k % 3 = 0 THEN [{{'x': x + 60, 'y': y + 50}}, {{'x': x + 60, 'y': y + 70}}, {{'x': x2 + 40, 'y': y2}}] WHEN x <= x2 THEN [{{'x': x + 120, 'y': y + 25}}, {{'x': x2, 'y': y2 + 25}}] ELSE [{{'x': x, 'y': y + 25}}, {{'x': x2 + 120, 'y': y2 + 25}}] END AS p, ['triangle', 'line', 'diamond', 'none', 'triangle_open'][k % 5 + 1] AS kind FROM e WHERE b IS NOT NULL),
g AS (SELECT *, p[-1].x AS tx, p[-1].y AS ty, (p[-1].x - p[-2].x) / sqrt((p[-1].x - p[-2].x) ** 2 + (p[-1].y - p[-2].y) ** 2) AS ux, (p[-1].y - p[-2].y) / sqrt((p[-1].x - p[-2].x) ** 2 + (p[-1].y - p[-2].y) ** 2) AS uy FROM f)"""


def _corner(back: float, side: float) -> str:
    return f"(round_even(tx - ux * {back}::DOUBLE - uy * {side}::DOUBLE, 2) + 0.0::DOUBLE) || ',' || (round_even(ty - uy * {back}::DOUBLE + ux * {side}::DOUBLE, 2) + 0.0::DOUBLE)"


_LEFT, _RIGHT, _TIP = _corner(10, 5), _corner(10, -5), _corner(0, 0)
_TEXT = 'font-family="Arial, sans-serif" font-size="'


@query(f"""WITH {_FLOW}
SELECT r, 'g_annotations' AS layer, '<rect id="node_' || id || '" x="' || x || '" y="' || y || '" width="120.0" height="50.0" rx="8.0" ry="8.0" fill="#ffffff" stroke="#000000" stroke-width="2"/>' AS body FROM n
UNION ALL SELECT r, 'g_text', '<text id="txt_node_' || id || '" x="' || (x + 12) || '" y="' || (y + 24) || '" {_TEXT}12.0" text-anchor="start" fill="#000000"><tspan id="txt_node_' || id || '_line0" x="' || (x + 12) || '">' || CASE WHEN k % 3 > 0 THEN split_part(t, chr(10), 1) WHEN length(split_part(t, ' & ', 1)) <= 12 THEN split_part(t, ' & ', 1) || ' &amp;' ELSE split_part(t, ' & ', 1) END
  || '</tspan><tspan id="txt_node_' || id || '_line1" x="' || (x + 12) || '" dy="14.0">' || CASE WHEN k % 3 > 0 THEN 'two' WHEN length(split_part(t, ' & ', 1)) <= 12 THEN 'more words' ELSE '&amp; more words' END || '</tspan></text>' FROM n
UNION ALL SELECT r, 'g_curves', '<polyline id="e_' || a || '_' || b || '" points="' || array_to_string(list_transform(p, lambda q: q.x || ',' || q.y), ' ') || '" fill="none" stroke="#000000" stroke-width="2"' || CASE WHEN k % 2 = 1 THEN ' stroke-dasharray="' || CASE WHEN k % 3 = 1 THEN '2,3' ELSE '6,4' END || '"' ELSE '' END || '/>' FROM g
UNION ALL SELECT r, 'g_markers', CASE WHEN kind = 'line' THEN '<polyline' ELSE '<polygon' END || ' id="m_' || a || '_' || b || '" points="' || CASE kind WHEN 'line' THEN {_LEFT} || ' ' || {_TIP} || ' ' || {_RIGHT} WHEN 'diamond' THEN {_TIP} || ' ' || {_corner(5, 5)} || ' ' || {_corner(10, 0)} || ' ' || {_corner(5, -5)} ELSE {_TIP} || ' ' || {_LEFT} || ' ' || {_RIGHT} END
  || CASE WHEN kind IN ('line', 'triangle_open') THEN '" fill="none" stroke="#000000" stroke-width="2"/>' ELSE '" fill="#000000"/>' END FROM g WHERE kind <> 'none'
UNION ALL SELECT r, 'g_text', '<text id="txt_edge_' || a || '_' || b || '" x="' || (p[1].x + tx) / 2 || '" y="' || ((p[1].y + ty) / 2 - 6) || '" {_TEXT}10.0" text-anchor="start" fill="#000000">' || a || '-' || b || '</text>' FROM g WHERE k % 4 > 0
UNION ALL SELECT r_regionkey, 'g_annotations', '<rect id="lane_' || r_name || '" x="-8.0" y="-8.0" width="640.0" height="600.0" rx="6.0" ry="6.0" fill="#f2f2f2" stroke="#000000" stroke-width="1"/>' FROM region
UNION ALL SELECT r_regionkey, 'g_text', '<text id="txt_lane_' || r_name || '" x="0.0" y="8.0" {_TEXT}10.0" text-anchor="start" fill="#000000"><tspan id="txt_lane_' || r_name || '_line0" x="0.0">' || CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Lane ' || r_regionkey END || '</tspan></text>' FROM region""")
def render_flow(spark, sf):
    """RND-05, ALG-15, JON-07: nations of each region as nodes in a lane, each with an edge to the next: through given points, dashed, with heads of
    five kinds; the element rows themselves."""
    from pyspark.sql import Window

    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.concat("n_name", F.lit(" & more words"))).otherwise(F.concat("n_name", F.lit("\ntwo")))
    nodes = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r"), k.alias("k"), k.cast("string").alias("id"), (k % 4 * 160.0).cast("double").alias("x"), (F.floor(k / 4) * 90.0).cast("double").alias("y"), F.lit(120.0).alias("width"), F.lit(50.0).alias("height"), text.alias("text"))
    w = Window.partitionBy("r").orderBy("k")
    e = nodes.select("r", "k", "x", "y", F.col("id").alias("a"), F.lead("id").over(w).alias("b"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("b IS NOT NULL")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.when(F.col("k") % 3 == 0, F.array(point(F.col("x") + 60, F.col("y") + 50), point(F.col("x") + 60, F.col("y") + 70), point(F.col("x2") + 40, F.col("y2"))))
    kinds = F.array(*map(F.lit, ("triangle", "line", "diamond", "none", "triangle_open")))
    edges = e.select("r", "a", "b", F.when(F.col("k") % 4 > 0, F.concat_ws("-", "a", "b")).alias("label"), points.alias("points"), (F.col("k") % 2 == 1).alias("dashed"), F.when(F.col("k") % 3 == 1, "2,3").alias("dasharray"), F.get(kinds, F.col("k") % 5).alias("arrow"))
    n = F.col("r_regionkey")
    lanes = table(spark, sf, "region").select(n.alias("r"), F.col("r_name").alias("id"), F.when(n % 2 == 1, F.concat(F.lit("Lane "), n.cast("string"))).otherwise(" ").alias("label"), F.lit(-8).alias("x"), F.lit(-8).alias("y"), F.lit(640).alias("width"), F.lit(600).alias("height"))
    return templates.flow(nodes, edges, "r", lanes).select("r", "layer", "body")
