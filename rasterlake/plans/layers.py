"""Queries of the layers that any figure may have, on the elements' text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import layers
from rasterlake.plans import labels
from rasterlake.plans.common import query, table
from rasterlake.plans.figures import _TEXT

_ORDERED = "row_number() OVER (PARTITION BY image ORDER BY y, coalesce(x, 0), text) - 1"


@query(f"""WITH {labels._ITEMS}, a AS (SELECT image, item, CASE WHEN item % 13 > 0 THEN x END AS x, y, CASE WHEN item % 4 = 0 THEN event_type || ' <' || item || '>' WHEN item % 4 = 1 THEN ' one ' || chr(10) || chr(10) || 'two ' || item ELSE event_type || ' ' || item END AS text, item % 17 > 0 AS shown, CASE item % 5 WHEN 0 THEN 'End' WHEN 1 THEN 'odd' END AS anchor, CASE WHEN item % 3 = 0 THEN 7.5 END::DOUBLE AS size FROM i),
u AS (SELECT * FROM a WHERE NOT (item % 4 > 1 AND event_type_of(item))), r AS (SELECT *, {_ORDERED} AS k FROM u),
t AS (SELECT *, CASE WHEN k < 10 THEN 'txt_text_0' || k ELSE 'txt_text_' || k END AS name, coalesce(size, 10.0::DOUBLE) AS s FROM r WHERE shown AND x IS NOT NULL)
SELECT image, '<text id="' || name || '" x="' || x || '" y="' || y || '" font-family="Arial, sans-serif" font-size="' || s || '" text-anchor="' || CASE WHEN anchor = 'End' THEN 'end' ELSE 'start' END || '" fill="#000000">' || CASE WHEN item % 4 = 1 THEN '<tspan id="' || name || '_line0" x="' || x || '">one</tspan><tspan id="' || name || '_line1" x="' || x || '" dy="' || round_even(s * 1.3::DOUBLE, 4) || '">two ' || item || '</tspan>'
  ELSE replace(replace(text, '<', '&lt;'), '>', '&gt;') END || '</text>' AS body FROM t""".replace("event_type_of(item)", "text LIKE 'click%' AND item % 3 = 0"))
def generic_texts(spark, sf):
    """RND-01, JON-14: text items of figures in reading order, but those that a template drew already."""
    i, k = labels._items(spark, sf), F.col("item")
    ks = k.cast("string")
    text = F.when(k % 4 == 0, F.concat("event_type", F.lit(" <"), ks, F.lit(">"))).when(k % 4 == 1, F.concat(F.lit(" one \n\ntwo "), ks)).otherwise(F.concat_ws(" ", "event_type", ks))
    d = i.select("image", "item", F.when(k % 13 > 0, F.col("x")).alias("x"), "y", text.alias("text"), (k % 17 > 0).alias("render"), F.when(k % 5 == 0, "End").when(k % 5 == 1, "odd").alias("anchor"), F.when(k % 3 == 0, 7.5).alias("font_size"))
    drawn = d.filter((k % 4 > 1) & F.startswith("text", F.lit("click")) & (k % 3 == 0)).select("image", F.concat(F.lit(" "), F.upper("text")).alias("text"))
    return layers.texts(layers.undrawn(d, drawn, "image"), "image").select("image", "body")


@query("""WITH l AS (SELECT l_orderkey AS image, l_linenumber AS k, CASE WHEN l_linenumber % 5 > 0 THEN l_quantity END AS x1, l_partkey::DOUBLE AS y1, l_suppkey::DOUBLE AS x2, l_extendedprice AS y2, l_returnflag AS role FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY role, y1, coalesce(x1, 0), y2, x2) - 1 AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY role, y1, x2, k) - 1 AS n FROM l), c AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y2, y1, CASE WHEN k = 1 THEN 0 ELSE 1 END) - 1 AS n FROM l)
SELECT image, 'g_annotations' AS layer, '<line id="' || CASE WHEN k = 4 THEN 'own' ELSE 'geom_line_' || lpad(n::VARCHAR, 2, '0') END || '" x1="' || x1 || '" y1="' || y1 || '" x2="' || x2 || '" y2="' || y2 || '" stroke="' || CASE WHEN k = 2 THEN '#ff0000' ELSE '#555555' END || '" stroke-width="1.0"' || CASE WHEN k % 2 = 0 THEN ' stroke-dasharray="' || CASE WHEN k = 2 THEN '3.0,1.5' ELSE '6,4' END || '" class="dashed"' ELSE '' END || '/>' AS body FROM a WHERE x1 IS NOT NULL
UNION ALL SELECT image, 'g_annotations', '<rect id="geom_rect_' || lpad(n::VARCHAR, 2, '0') || '" x="' || x2 || '" y="' || y1 || '" width="10.0" height="' || k || '.0" fill="none" stroke="#555555" stroke-width="1.0"/>' FROM b
UNION ALL SELECT image, 'g_markers', '<circle id="geom_marker_' || lpad(n::VARCHAR, 2, '0') || '" cx="' || y1 || '" cy="' || y2 || '" r="' || CASE WHEN k = 1 THEN '3.0' ELSE '4.5' END || '" fill="#555555"/>' FROM c""")
def generic_geometry(spark, sf):
    """RND-01: lines, boxes and markers of figures, in order of role and place."""
    k = F.col("l_linenumber")
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), k.alias("k"), F.when(k % 5 > 0, F.col("l_quantity")).alias("q"), F.col("l_partkey").cast("double").alias("p"), F.col("l_suppkey").cast("double").alias("s"), F.col("l_extendedprice").alias("e"), F.col("l_returnflag").alias("role"))
    k = F.col("k")
    lines = d.select("image", "role", F.col("q").alias("x1"), F.col("p").alias("y1"), F.col("s").alias("x2"), F.col("e").alias("y2"), F.when(k == 4, "own").alias("id"), F.when(k == 2, "#ff0000").alias("stroke"), (k % 2 == 0).alias("dashed"), F.when(k == 2, F.array(F.lit(3.0), F.lit(1.5))).alias("dasharray"))
    rects = d.select("image", "role", F.col("s").alias("x"), F.col("p").alias("y"), F.lit(10).alias("width"), k.alias("height"))
    markers = d.select("image", F.col("p").alias("x"), F.col("e").alias("y"), F.when(k > 1, 4.5).alias("radius"))
    return layers.geometry("image", lines, rects, markers).select("image", "layer", "body")


_HEAD = lambda tx, ty, ux, uy: f"{tx} || ',' || {ty} || ' ' || (round_even({tx} - ({ux}) * 8::DOUBLE - ({uy}) * 4::DOUBLE, 2) + 0.0::DOUBLE) || ',' || (round_even({ty} - ({uy}) * 8::DOUBLE + ({ux}) * 4::DOUBLE, 2) + 0.0::DOUBLE) || ' ' || (round_even({tx} - ({ux}) * 8::DOUBLE - ({uy}) * (-4)::DOUBLE, 2) + 0.0::DOUBLE) || ',' || (round_even({ty} - ({uy}) * 8::DOUBLE + ({ux}) * (-4)::DOUBLE, 2) + 0.0::DOUBLE)"


@query(f"""WITH s AS (SELECT s_nationkey AS image, s_suppkey AS k, (s_suppkey % 50 * 10)::DOUBLE AS x1, (s_suppkey % 7 * 30)::DOUBLE AS y1, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 50 * 10 ELSE s_suppkey % 50 * 10 + s_suppkey % 3 * 40 END::DOUBLE AS x2, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 7 * 30 ELSE s_suppkey % 7 * 30 + s_suppkey % 4 * 30 + 20 END::DOUBLE AS y2 FROM supplier),
d AS (SELECT *, abs(x2 - x1) >= abs(y2 - y1) AS level, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY 'P' || k % 3, y1, k) - 1 AS r FROM s)
SELECT image, 'g_annotations' AS layer, '<line id="span_' || k || '" x1="' || x1 || '" y1="' || y1 || '" x2="' || x2 || '" y2="' || y2 || '" stroke="#000000" stroke-width="1"/>' AS body FROM d
UNION ALL SELECT image, 'g_markers', '<polygon id="span_head2_' || k || '" points="' || {_HEAD('x2', 'y2', '(x2 - x1) / n', '(y2 - y1) / n')} || '" fill="#000000"/>' FROM d WHERE n > 0
UNION ALL SELECT image, 'g_markers', '<polygon id="span_head1_' || k || '" points="' || {_HEAD('x1', 'y1', '(x1 - x2) / n', '(y1 - y2) / n')} || '" fill="#000000"/>' FROM d WHERE n > 0
UNION ALL SELECT image, 'g_text', '<text id="txt_span_' || k || '" x="' || ((x1 + x2) / 2 + CASE WHEN level THEN 0 ELSE 6 END) || '" y="' || ((y1 + y2) / 2 - CASE WHEN level THEN 6 ELSE 0 END) || '" {_TEXT}10.0" text-anchor="' || CASE WHEN level THEN 'middle' ELSE 'start' END || '" fill="#000000">T' || k || '</text>' FROM d WHERE k % 2 = 0
UNION ALL SELECT image, 'g_text', '<text id="txt_turned_' || k || '" x="' || x1 || '" y="' || y1 || '" {_TEXT}10.0" text-anchor="middle" fill="#000000"' || CASE WHEN k % 4 = 0 THEN '' ELSE ' transform="rotate(' || (k % 4 * -30)::DOUBLE || ' ' || x1 || ' ' || y1 || ')"' END || '>A &amp; B</text>' FROM s
UNION ALL SELECT image, 'g_axes', '<rect id="band_' || lpad(r::VARCHAR, 2, '0') || '_P' || k % 3 || '" x="5.0" y="' || y1 || '" width="100.0" height="' || (k % 5)::DOUBLE || '" fill="#f2e6b8"' || CASE WHEN k % 2 = 0 THEN ' fill-opacity="0.5"' ELSE '' END || '/>' FROM b WHERE k % 5 > 0""")
def panel_layers(spark, sf):
    """RND-03, ALG-15: bands, double arrows with labels, and turned labels of figures of panels."""
    k = F.col("s_suppkey")
    same = k % 9 == 0
    d = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("image"), k.alias("k"), k.cast("string").alias("id"), (k % 50 * 10).alias("x1"), (k % 7 * 30).alias("y1"), F.when(same, k % 50 * 10).otherwise(k % 50 * 10 + k % 3 * 40).alias("x2"), F.when(same, k % 7 * 30).otherwise(k % 7 * 30 + k % 4 * 30 + 20).alias("y2"))
    k = F.col("k")
    spans = layers.double_arrows(d.withColumn("label", F.when(k % 2 == 0, F.concat(F.lit("T"), "id"))), "image")
    labels_ = layers.turned(d.select("image", "id", F.lit("A & B").alias("text"), F.col("x1").alias("x"), F.col("y1").alias("y"), (k % 4 * -30).alias("angle")), "image")
    tints = layers.bands(d.select("image", F.concat(F.lit("P"), (k % 3).cast("string")).alias("panel"), F.lit(5).alias("x"), F.lit(100).alias("width"), (F.col("y1") + k / 1e9).alias("y"), (k % 5).alias("height"), F.lit("#f2e6b8").alias("fill"), F.when(k % 2 == 0, 0.5).alias("opacity")), "image")
    return spans.unionByName(labels_).unionByName(tints).select("image", "layer", "body")


_PLOT = """b AS (SELECT n_nationkey AS image, n_name AS title, (60 + n_nationkey % 3 * 10)::DOUBLE AS x, (40 + n_nationkey % 4 * 5)::DOUBLE AS y, 300.0::DOUBLE AS w, 200.0::DOUBLE AS h FROM nation),
s AS (SELECT c_nationkey AS image, c_mktsegment AS series, list({'x': c_custkey % 31, 'y': greatest(floor(c_acctbal), 0)} ORDER BY c_custkey) AS pts, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment),
d AS (SELECT b.*, series, pts, k, k % 2 = 0 AS dashed, CASE WHEN k = 4 THEN '9,1' WHEN k % 3 = 0 THEN '12,8' ELSE '6,4' END AS pattern, CASE WHEN k % 3 = 0 THEN 4.0 ELSE 2.0 END AS wide FROM b JOIN (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM s) s ON s.image = b.image WHERE len(pts) >= 2),
e AS (SELECT * REPLACE (row_number() OVER (PARTITION BY image ORDER BY series) AS k) FROM d),
f AS (SELECT * REPLACE (k % 2 = 0 AS dashed, CASE WHEN k = 4 THEN '9,1' WHEN k % 3 = 0 THEN '12,8' ELSE '6,4' END AS pattern, CASE WHEN k % 3 = 0 THEN 4.0 ELSE 2.0 END AS wide) FROM e),
t AS (SELECT b.*, i, i / 4.0::DOUBLE AS share FROM b, range(5) u(i))"""
_FONT = 'font-family="Arial, sans-serif" font-size="'


def _line_sql(name: str, x1: str, y1: str, x2: str, y2: str, rest: str) -> str:
    return f"""'<line id="{name}" x1="' || ({x1}) || '" y1="' || ({y1}) || '" x2="' || ({x2}) || '" y2="' || ({y2}) || '" {rest}/>'"""


def _text_sql(name: str, x: str, y: str, anchor: str, size: float, text: str, more: str = "") -> str:
    return f"""'<text id="{name}" x="' || ({x}) || '" y="' || ({y}) || '" text-anchor="{anchor}" {_FONT}{size}" fill="#000000"{more}>' || {text} || '</text>'"""


_BLACK = 'stroke="#000000" stroke-width="{}"'
_DASH = """' || CASE WHEN dashed THEN ' stroke-dasharray="' || pattern || '"' ELSE '' END || '"""


@query(f"""WITH {_PLOT}
SELECT image, 'g_axes' AS layer, {_line_sql('axis_x', 'x', 'y + h', 'x + w', 'y + h', _BLACK.format(2))} AS body FROM b UNION ALL SELECT image, 'g_axes', {_line_sql('axis_y', 'x', 'y + h', 'x', 'y', _BLACK.format(2))} FROM b
UNION ALL SELECT image, 'g_axes', {_line_sql("tick_x_' || i || '", 'x + share * w', 'y + h', 'x + share * w', 'y + h + 5', _BLACK.format(1))} FROM t UNION ALL SELECT image, 'g_axes', {_line_sql("tick_y_' || i || '", 'x - 5', 'y + h - share * h', 'x', 'y + h - share * h', _BLACK.format(1))} FROM t
UNION ALL SELECT image, 'g_text', {_text_sql("txt_tick_x_' || i || '", 'x + share * w', 'y + h + 18', 'middle', 10.0, "printf('%.2f', 30 * share)")} FROM t UNION ALL SELECT image, 'g_text', {_text_sql("txt_tick_y_' || i || '", 'x - 8', 'y + h - share * h + 4', 'end', 10.0, "printf('%.2f', 10000 * share)")} FROM t
UNION ALL SELECT image, 'g_curves', '<polyline id="series_' || series || '" points="' || array_to_string(list_transform(pts, lambda p: printf('%.2f', x + 10.0 * p.x) || ',' || printf('%.2f', round(y + h - p.y / 50.0, 2))), ' ') || '" fill="none" stroke="#1f77b4" stroke-width="' || printf('%.2f', wide) || '"{_DASH}/>' FROM f
UNION ALL SELECT image, 'g_annotations', {_line_sql("legend_' || series || '", 'x + w - 110', 'y + 16 * k', 'x + w - 86', 'y + 16 * k', '''stroke="#1f77b4" stroke-width="' || printf('%.2f', wide) || '"''' + _DASH)} FROM f
UNION ALL SELECT image, 'g_text', {_text_sql("txt_legend_' || series || '", 'x + w - 80', 'y + 16 * k + 4', 'start', 10.0, "CASE WHEN k = 1 THEN 'the first' ELSE series END")} FROM f
UNION ALL SELECT image, 'g_text', {_text_sql('txt_title', 'x + w / 2', 'y / 2 + 6', 'middle', 16.0, 'title', ' font-weight="bold"')} FROM b UNION ALL SELECT image, 'g_text', {_text_sql('txt_axis_x', 'x + w / 2', 'y + h + 36', 'middle', 12.0, "'day'")} FROM b WHERE image % 2 = 0
UNION ALL SELECT image, 'g_text', '<text id="txt_axis_y" x="' || (x - 48) || '" y="' || (y + h / 2) || '" text-anchor="middle" {_FONT}12.0" fill="#000000" transform="rotate(-90 ' || (x - 48) || ' ' || (y + h / 2) || ')">' || title || '</text>' FROM b""")
def plot_rows(spark, sf):
    """RND-04, EXT-03, AGG-33, PRJ-16: line plots of each nation's customers, a series a segment: ticks, dashes, widths, a legend, a title and axis labels, as element rows."""
    from pyspark.sql import Window

    from rasterlake.operators import figures

    n = F.col("n_nationkey")
    boxes = table(spark, sf, "nation").select(n.alias("image"), (60 + n % 3 * 10).alias("x"), (40 + n % 4 * 5).alias("y"), F.lit(300).alias("width"), F.lit(200).alias("height"))
    texts = table(spark, sf, "nation").select(n.alias("image"), F.col("n_name").alias("title"), F.when(n % 2 == 0, "day").alias("axis_label_x"), F.col("n_name").alias("axis_label_y"))
    one = F.struct("c_custkey", (F.col("c_custkey") % 31).cast("double").alias("x"), F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("double").alias("y"))
    s = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("image"), F.col("c_mktsegment").alias("series")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")).filter(F.size("points") >= 2)
    k = F.row_number().over(Window.partitionBy("image").orderBy("series"))
    s = s.withColumn("k", k).select("image", "series", "points", F.lit("#1f77b4").alias("stroke"), (F.col("k") % 2 == 0).alias("dashed"), F.when(F.col("k") % 3 == 0, 4.0).alias("stroke_width"), F.when(F.col("k") == 4, F.array(F.lit(9.0), F.lit(1.0))).alias("dasharray"), F.when(F.col("k") == 1, "the first").alias("label"))
    ranges = boxes.select("image", F.lit(0).alias("min_x"), F.lit(30).alias("max_x"), F.lit(0).alias("min_y"), F.lit(10000).alias("max_y"))
    return figures.line_plot(boxes.select("image"), boxes, s, texts, ranges).select("image", "layer", "body")
