"""Queries of extraction by template, of rendered figures, and of runs of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import batch, convert, extract, figures, panels, raster, render, rules, sequence, text
from rasterlake.plans import drawings, labels
from rasterlake.plans.common import query, table
from rasterlake.plans.drawn import HEIGHT, SQL_PIXELS, WIDTH, figure_pixels
from rasterlake.sources import datasets, images, store

_CANVAS = "s AS (SELECT p_partkey AS image, 700 + p_size * 61 AS w, 500 + p_partkey * 37 % 900 AS h FROM part)"


def _canvases(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (700 + F.col("p_size") * 61).alias("width"), (500 + F.col("p_partkey") * 37 % 900).alias("height"))


def _rounded(df):
    return df.select("image", "region", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


@query(f"""WITH {_CANVAS}, m AS (SELECT *, greatest(floor(w * 0.04), 40) AS mx, greatest(floor(h * 0.04), 32) AS my, greatest(floor(h * 0.16), 140) AS hd, greatest(floor(h * 0.28), 260) AS top, greatest(floor(h * 0.02), 18) AS pad, greatest(floor(h * 0.035), 28) AS lab, greatest(floor(w * 0.02), 24) AS gap, greatest(floor(w * 0.015), 18) AS step FROM s),
n AS (SELECT *, my + hd + top + greatest(floor(h * 0.04), 32) AS low, (w - 2 * mx - 2 * gap) / 3.0::DOUBLE AS pw FROM m), o AS (SELECT *, greatest(h - my - low, floor(h * 0.25)) AS tall, (w - 2 * mx - 2 * pad - 3 * step) / 4.0::DOUBLE AS ww FROM n)
SELECT image, ['A', 'B', 'C'][k + 1] AS region, round(mx + k * (pw + gap), 4)::DOUBLE AS x, (my + hd)::DOUBLE AS y, round(pw, 4)::DOUBLE AS width, top::DOUBLE AS height FROM o, range(3) t(k) UNION ALL SELECT image, 'container', mx, low, w - 2 * mx, tall FROM o
UNION ALL SELECT image, 'WP' || (k + 1), round(mx + pad + k * (ww + step), 4), low + pad + lab, round(ww, 4), greatest(tall - 2 * pad - lab, lab) FROM o, range(4) t(k)""")
def architecture_regions(spark, sf):
    """EXT-05, PRJ-18: regions of architecture figures on canvases sized by parts."""
    return _rounded(extract.architecture_layout(_canvases(spark, sf)))


@query(f"""WITH {_CANVAS}, m AS (SELECT *, greatest(floor(w * 0.08), 40) AS mx, greatest(floor(h * 0.06), 30) AS my, greatest(floor(h * 0.14), 90) AS hd, w * 0.28::DOUBLE AS bw, h * 0.2::DOUBLE AS bh, greatest(floor(h * 0.08), 50) AS gap FROM s)
SELECT image, 'agent' AS region, mx::DOUBLE AS x, (my + hd)::DOUBLE AS y, round(bw, 4) AS width, round(bh, 4) AS height FROM m UNION ALL SELECT image, 'environment', round(w - mx - bw, 4), my + hd, round(bw, 4), round(bh, 4) FROM m
UNION ALL SELECT image, 'constraint', round((w - bw * 0.7) / 2, 4), round(greatest(my + hd * 0.4, my + hd - bh * 0.7), 4), round(bw * 0.7, 4), round(bh * 0.45, 4) FROM m UNION ALL SELECT image, 'buffer', round((w - bw * 0.75) / 2, 4), round(my + hd + bh + gap, 4), round(bw * 0.75, 4), round(bh * 0.45, 4) FROM m""")
def loop_regions(spark, sf):
    """EXT-06: regions of agent loops on canvases sized by parts."""
    return _rounded(extract.loop_layout(_canvases(spark, sf)))


_REGIONS = ("title", "subtitle", "panel_A_title", "panel_A_bullets", "panel_B_bullets", "wp_WP1_title", "wp_WP1_body", "wp_WP2_body", "other", "box_agent", "signal_action")
_FIELD_ITEMS = f"""i AS (SELECT event_id // 25 AS image, [{", ".join(f"'{r}'" for r in _REGIONS)}][event_id % 11 + 1] AS region, CASE event_id % 6 WHEN 0 THEN 'Goal: ' || event_type WHEN 1 THEN 'output' WHEN 2 THEN '- ' || event_type WHEN 3 THEN '..:;' ELSE event_type || event_id END AS text, (event_id * 7 % 100) / 100.0::DOUBLE AS conf, event_id % 5 AS y, event_id AS x FROM events),
l AS (SELECT image, region, list(text ORDER BY y, x) AS lines, avg(conf) AS conf FROM i GROUP BY image, region)"""


def _field_items(spark, sf):
    e = F.col("event_id")
    region = F.get(F.array(*map(F.lit, _REGIONS)), (e % 11).cast("int"))
    kind = e % 6
    text = F.when(kind == 0, F.concat(F.lit("Goal: "), "event_type")).when(kind == 1, "output").when(kind == 2, F.concat(F.lit("- "), "event_type")).when(kind == 3, "..:;").otherwise(F.concat("event_type", e.cast("string")))
    return table(spark, sf, "events").select(F.floor(e / 25).alias("image"), region.alias("region"), text.alias("text"), (e * 7 % 100 / 100.0).alias("conf"), (e % 5).alias("y"), e.alias("x"))


_DEFAULTS = lambda d: ", ".join("('{}', '{}')".format(k, v.replace(chr(10), "|")) for k, v in d.items())


@query(f"""WITH {_FIELD_ITEMS}, d AS (SELECT DISTINCT image, f.* FROM i, (VALUES {_DEFAULTS(extract.ARCHITECTURE)}) f(field, def)), r AS (SELECT * FROM l WHERE conf >= 0.4),
b AS (SELECT image, replace(region, '_body', '') AS wp, list_filter(lines, lambda t: contains(lower(t), 'goal'))[-1] AS g, list_filter(lines, lambda t: contains(lower(t), 'output'))[-1] AS o, list_filter(lines, lambda t: NOT contains(lower(t), 'goal') AND NOT contains(lower(t), 'output')) AS r FROM r WHERE region LIKE '%_body'),
v AS (SELECT image, region AS field, array_to_string(lines, ' ') AS value, length(regexp_replace(array_to_string(lines, ' '), '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(array_to_string(lines, ' ')) >= 0.5 AS ok FROM r WHERE region IN ('title', 'subtitle') OR region LIKE '%_title'
  UNION ALL SELECT image, region, array_to_string(list_filter(list_transform(lines, lambda t: trim(regexp_replace(t, '^[•\\-–· ]+', ''))), lambda t: t <> ''), '|'), len(lines) > 0 FROM r WHERE region LIKE '%_bullets'
  UNION ALL SELECT image, wp || '_goal', coalesce(trim(replace(g, 'Goal:', '')), r[1]), true FROM b UNION ALL SELECT image, wp || '_output', coalesce(o, CASE WHEN g IS NULL THEN r[2] ELSE r[1] END), true FROM b)
SELECT d.image, d.field, CASE WHEN ok AND coalesce(value, '') <> '' THEN value ELSE def END AS value, CASE WHEN ok AND coalesce(value, '') <> '' THEN 'ocr' WHEN NOT ok THEN 'rejected' ELSE 'default' END AS source FROM d LEFT JOIN v ON v.image = d.image AND v.field = d.field""")
def architecture_fields(spark, sf):
    """EXT-05, STR-13, STR-14, STR-18, FLT-08, SRT-05: fields of architecture figures, read or default."""
    i = _field_items(spark, sf)
    return extract.architecture_fields(i.select("image").distinct(), i, min_conf=0.4).withColumn("value", F.replace("value", F.lit("\n"), F.lit("|")))


@query(f"""WITH {_FIELD_ITEMS}, d AS (SELECT DISTINCT image, f.* FROM i, (VALUES {_DEFAULTS(extract.LOOP)}) f(field, def)), v AS (SELECT image, CASE region WHEN 'title' THEN 'title' WHEN 'box_agent' THEN 'agent' ELSE 'action' END AS field, array_to_string(lines, ' ') AS value FROM l WHERE region IN ('title', 'box_agent', 'signal_action'))
SELECT d.image, d.field, coalesce(value, def) AS value, CASE WHEN value <> def THEN 'ocr' ELSE 'default' END AS source FROM d LEFT JOIN v USING (image, field)""")
def loop_fields(spark, sf):
    """EXT-06: fields of agent loops, read or default."""
    i = _field_items(spark, sf)
    return extract.loop_fields(i.select("image").distinct(), i)


def _texts(spark, sf):
    """Words placed over the drawn figures."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("image"), k.cast("long").alias("item"), F.col("n_name").alias("text"), (k * 97 % 600).cast("double").alias("x"), (k * 53 % 340).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(12.0).alias("height"))


@query()
def event_figures(spark, sf):
    """EXT-01, EXT-02: what the drawn figures hold, a row a panel."""
    d = extract.event_panels(figure_pixels(spark, sf), drawings._sizes(spark, sf), _texts(spark, sf))
    return d.select("image", "panel", "x", "y", "width", "height", "source", "y_axis_x", "x_axis_y", F.round("t_start_x", 4).alias("t_start_x"), F.round("t_trigger_x", 4).alias("t_trigger_x"), "fill", F.array_join("curve_colors", ",").alias("colors"), F.array_join(F.col("thresholds").cast("array<string>"), ",").alias("thresholds"), F.size("serving").alias("serving"), F.size("neighbor").alias("neighbor"), "n_texts")


@query()
def plot_figures(spark, sf):
    """EXT-03: the drawn figures as line plots, a row a series."""
    d = extract.line_plot(figure_pixels(spark, sf), drawings._sizes(spark, sf))
    return d.select("image", "series", "stroke", "dashed", F.size("points").alias("n"), F.to_json("points").alias("points"))


@query(f"""WITH t AS (SELECT n_regionkey AS image, n_nationkey AS item, n_name AS text, n_nationkey * 97 % 600 + 15 AS cx, n_nationkey * 53 % 340 + 6 AS cy, n_nationkey * 53 % 340 AS y, n_nationkey * 97 % 600 AS x FROM nation),
n AS (SELECT r_regionkey AS image, k, {int(WIDTH * 0.1)} + k * {int(WIDTH * 0.22) + int(WIDTH * 0.06)} AS nx FROM region, range(3) u(k))
SELECT CAST(n.image AS BIGINT) AS image, 'n' || (k + 1) AS node, nx::DOUBLE AS x, coalesce(string_agg(text, ' ' ORDER BY y, x), '') AS texts FROM n LEFT JOIN (SELECT t.*, (SELECT min(k) FROM n WHERE n.image = t.image AND cx BETWEEN nx AND nx + {int(WIDTH * 0.22)} AND cy BETWEEN {int(HEIGHT * 0.2)} AND {int(HEIGHT * 0.2) + int(HEIGHT * 0.16)}) AS held FROM t) h ON h.image = n.image AND h.held = k GROUP BY n.image, k, nx""")
def flow_figures(spark, sf):
    """EXT-04, JON-04: nodes of flow charts with what is written in them."""
    return extract.flow_nodes(drawings._sizes(spark, sf), _texts(spark, sf)).select("image", "node", "x", "texts")


@query()
def flow_arrows(spark, sf):
    """EXT-04, ALG-14: edges of flow charts with the heads drawn at their ends."""
    nodes = extract.flow_nodes(drawings._sizes(spark, sf), _texts(spark, sf))
    return extract.flow_edges(figure_pixels(spark, sf), nodes)


@query()
def auto_figures(spark, sf):
    """EXT-08, ALG-10, ALG-16, JON-01, PRJ-10: the layout of the drawn figures with titles and curves."""
    d = extract.auto_layout(figure_pixels(spark, sf), _texts(spark, sf))
    return d.select("image", "node", "x", "y", "width", "height", "title", F.coalesce(F.array_join(F.transform("curves", lambda c: F.concat(c["stroke"], F.lit(":"), F.size(c["points"]).cast("string"))), ","), F.lit("")).alias("curves"))


def _documents(rows, sizes, key="image"):
    return render.documents(rows.join(render.many(sizes.select(key, "width", "height")), key), key, "layer", ["o"], "body", F.col("width"), F.col("height"))


@query(f"""WITH {_CANVAS}, r AS (SELECT unnest(['A', 'B', 'C', 'container', 'WP1', 'WP2', 'WP3', 'WP4']) AS region) SELECT image, 8 AS boxes, CASE WHEN image % 5 = 0 THEN 2 ELSE 0 END AS heads, CAST(w AS INTEGER) AS width FROM s""")
def render_architecture(spark, sf):
    """RND-06, STR-15, STR-16: architecture figures of parts, counted by element."""
    s = _canvases(spark, sf)
    fields = extract.architecture_fields(s.select("image"), _field_items(spark, sf).limit(0)).filter("image % 5 = 0 OR field NOT IN ('title', 'subtitle')")
    d = _documents(figures.architecture(s, fields, True), s)
    return d.select("image", F.regexp_count("svg", F.lit("<rect ")).alias("boxes"), F.regexp_count("svg", F.lit('id="txt_(title|subtitle)"')).alias("heads"), F.regexp_extract("svg", ' width="(\\d+)"', 1).cast("int").alias("width"))


@query(f"WITH {_CANVAS} SELECT image, CASE WHEN image % 3 = 0 THEN 3 ELSE 4 END AS boxes, 2 AS signals, 'RL Agent Loop' AS title FROM s")
def render_loop(spark, sf):
    """RND-07, ALG-15: agent loops of parts, counted by element."""
    s = _canvases(spark, sf)
    fields = extract.loop_fields(s.select("image"), _field_items(spark, sf).limit(0)).withColumn("value", F.when((F.col("image") % 3 == 0) & (F.col("field") == "buffer"), "").otherwise(F.col("value")))
    d = _documents(figures.agent_loop(s, fields), s)
    return d.select("image", F.regexp_count("svg", F.lit("<rect ")).alias("boxes"), F.regexp_count("svg", F.lit("<polygon ")).alias("signals"), F.regexp_extract("svg", 'id="txt_title"[^>]*>([^<]*)<', 1).alias("title"))


@query("""WITH p AS (SELECT o_custkey % 40 AS image, o_orderkey % 4 AS cell, o_orderpriority AS id, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY ALL)
SELECT CAST(image AS BIGINT) AS image, 8 + count(DISTINCT id) AS lines, count(*) FILTER (n >= 2) AS series, count(DISTINCT id) AS legend FROM p GROUP BY image""")
def render_grid(spark, sf):
    """RND-08, EXT-07: grids of plots of orders, counted by element."""
    o = table(spark, sf, "orders").withColumn("image", F.col("o_custkey") % 40).withColumn("cell", F.col("o_orderkey") % 4).filter("cell < 3")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    series = o.groupBy("image", "cell", F.col("o_orderpriority").alias("id")).agg(F.array_sort(F.collect_list(F.struct((day / 3000.0).alias("x"), (F.col("o_totalprice") / 500000).alias("y"), "o_orderkey"))).alias("points"))
    series = series.withColumn("stroke", F.lit("#1f77b4")).withColumn("dashed", F.col("cell") == 1)
    s = o.select("image").distinct().withColumn("width", F.lit(900)).withColumn("height", F.lit(600))
    titles = s.select("image", F.lit(0).cast("long").alias("cell"), F.lit("First").alias("title"))
    d = _documents(figures.performance_grid(s, titles, series, 2, 2), s)
    return d.select("image", F.regexp_count("svg", F.lit("<line ")).cast("long").alias("lines"), F.regexp_count("svg", F.lit("<polyline ")).cast("long").alias("series"), F.regexp_count("svg", F.lit('id="txt_legend_')).cast("long").alias("legend"))


@query()
def render_panels(spark, sf):
    """RND-03, ALG-09, STR-26: the drawn figures, extracted and rendered again as figures of panels."""
    p, s = figure_pixels(spark, sf), drawings._sizes(spark, sf)
    d = extract.event_panels(p, s)
    ratio = lambda c: F.round((F.col(c) - F.col("x")) / F.col("width"), 4)
    times = d.groupBy("image").agg(F.min(ratio("t_start_x")).alias("t_start"), F.max(ratio("t_trigger_x")).alias("t_trigger")).withColumn("title", F.lit("Events"))
    curves = d.select("image", "panel", F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.lit(c).alias("stroke"), F.col(n).alias("points")) for n, c, _ in extract.PANEL_CURVES])).alias("c")).select("image", "panel", "c.*").filter("points IS NOT NULL")
    thresholds = d.select("image", "panel", F.explode("thresholds").alias("y_ratio")).withColumn("label", F.lit("Th"))
    rows = figures.event_panels(times, d.withColumn("label", F.col("panel")), curves, thresholds, "image")
    return _documents(rows, s)


@query()
def render_layout(spark, sf):
    """RND-09: the drawn figures by their found layout."""
    s = drawings._sizes(spark, sf)
    return _documents(figures.auto_layout(s, extract.auto_layout(figure_pixels(spark, sf), _texts(spark, sf))), s)


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 13 / 10.0::DOUBLE END AS a, o_orderkey % 7 / 6.0::DOUBLE AS b FROM orders), p AS (SELECT l_orderkey AS k, l_quantity * 9 - 20 AS x, l_linenumber * 50.0 AS y, CASE WHEN l_partkey % 17 > 0 THEN l_tax * 4000 END AS w, 100.0 * (l_suppkey % 5) AS h FROM lineitem WHERE l_linenumber <= 4),
j AS (SELECT p.* FROM p JOIN f ON f.k = p.k), i AS (SELECT f.k, 'E2101' AS code FROM f LEFT JOIN (SELECT k, count(*) AS n FROM p GROUP BY k) c ON c.k = f.k WHERE coalesce(n, 0) <> 3 UNION SELECT k, 'E2103' FROM j WHERE w IS NULL UNION SELECT k, 'E2105' FROM j WHERE w <= 0 OR h <= 0 UNION SELECT k, 'E2106' FROM j WHERE x < 0
UNION SELECT k, 'E2107' FROM j WHERE x + w > 500 OR y + h > 500 UNION SELECT k, 'E2110' FROM f WHERE a IS NULL UNION SELECT k, 'E2112' FROM f WHERE a > 1 UNION SELECT k, 'E2113' FROM f WHERE a >= b
UNION SELECT k, 'E2121' FROM f WHERE k % 3 = 0 UNION SELECT k, 'E2123' FROM f WHERE k % 3 = 1 AND k % 5 = 0 UNION SELECT k, 'E2125' FROM f WHERE k % 3 > 0 AND k % 4 = 0)
SELECT code, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM i GROUP BY code""")
def panel_issues(spark, sf):
    """RND-03: issues of the parameters of figures of panels."""
    k = F.col("o_orderkey")
    l = table(spark, sf, "lineitem")  # noqa: E741
    o = store.dealt(table(spark, sf, "orders"), "o_orderkey", like=l)
    f = o.select(k.alias("k"), F.lit(500).alias("width"), F.lit(500).alias("height"), F.when(k % 11 > 0, k % 13 / 10.0).alias("t_start"), (k % 7 / 6.0).alias("t_trigger"))
    p = store.dealt(l, "l_orderkey").filter("l_linenumber <= 4").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("panel"), (F.col("l_quantity") * 9 - 20).alias("x"), (F.col("l_linenumber") * 50.0).alias("y"), F.when(F.col("l_partkey") % 17 > 0, F.col("l_tax") * 4000).alias("width"), (100.0 * (F.col("l_suppkey") % 5)).alias("height"))
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.when(k % 3 == 0, F.array(point(0.1, F.lit(0.1)))).otherwise(F.array(point(0.1, F.lit(0.2)), point(0.4, F.when((k % 3 == 1) & (k % 5 == 0), F.lit(None)).otherwise(F.lit(0.5))), point(0.5, F.when(k % 4 == 0, F.lit(1.5)).otherwise(F.lit(0.5)))))
    c = o.select(k.alias("k"), F.lit("serving").alias("curve"), points.alias("points"))
    return figures.panel_issues(f, p, c, "k").groupBy("code").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


_CODE_SQL = """CASE WHEN o_orderkey % 23 = 0 THEN 'E1400' WHEN o_orderkey % 19 = 0 THEN 'E1401' WHEN o_orderkey % 17 = 0 THEN 'E1402' WHEN o_custkey % 13 = 0 THEN 'E1403' WHEN o_custkey % 11 = 0 THEN 'E1404' WHEN o_custkey % 7 = 0 THEN 'E1405' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'E1406'
WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 = 1 THEN 'E1407' WHEN o_orderkey % 29 = 0 THEN 'E1408' WHEN o_totalprice / 500000 > 0.75 OR o_custkey % 100 / 100.0 > 0.65 THEN 'E1409' ELSE 'pass' END"""


@query(f"SELECT o_orderkey, {_CODE_SQL} AS code, 'runs/' || CASE WHEN o_orderkey % 2 = 0 THEN 'case_' || o_orderkey ELSE 'case_' || o_orderkey || '_' END || '/candidates/' || replace(o_orderpriority, ' ', '_') AS folder FROM orders")
def real_cases(spark, sf):
    """ORC-05, ORC-03, JON-19: codes of runs on real figures and the folders of their candidates."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = F.create_map(F.lit("max_rmse"), F.when(c % 7 == 0, "wide").otherwise("0.75"), F.lit("max_bad_pixel_ratio"), F.lit("0.65"), F.lit("pixel_tolerance"), F.when(c % 11 > 0, "10"))
    gates = F.when(c % 13 > 0, F.map_filter(values, lambda n, v: v.isNotNull()))
    code = convert.real_code(F.when(k % 23 > 0, "a.png"), k % 19 > 0, k % 17 > 0, gates, F.col("o_orderstatus"), F.when(k % 2 == 0, F.array(F.lit("F"), F.lit("O"))), k % 3 > 0, F.when(k % 4 == 1, 2), F.when(k % 29 > 0, F.col("o_totalprice") / 500000), c % 100 / 100.0)
    case = F.when(k % 2 == 0, F.concat(F.lit("case_"), k.cast("string"))).otherwise(F.concat(F.lit("case_"), k.cast("string"), F.lit("?*")))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(code, F.lit("pass")).alias("code"), convert.debug_folder("runs", F.col("o_orderpriority"), case).alias("folder"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<svg/>' ELSE '<svg xmlns="http://www.w3.org/2000/svg" width="640" height="360"><g id="figure_root"><text id="txt_placeholder" x="320" y="180" text-anchor="middle">' || CASE WHEN p_partkey % 3 = 0 THEN 'no result' ELSE p_name || ' &lt;' END || '</text></g></svg>' END AS svg FROM part""")
def placeholders(spark, sf):
    """SRC-21: placeholders of figures without a result."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", convert.placeholder(F.when(k % 2 == 0, "<svg/>"), F.when(k % 3 > 0, F.concat("p_name", F.lit(" <")))).alias("svg"))


@query("""SELECT l_orderkey, l_returnflag || l_linenumber AS text, round((l_quantity * 3 - 10) / 100, 4) AS conf, CAST(l_partkey AS INTEGER) AS x FROM lineitem WHERE l_linenumber % 4 > 0 AND l_quantity * 3 - 10 >= 0""")
def column_words(spark, sf):
    """SRC-12: words of parallel arrays of texts, confidences and boxes."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 4 > 0, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise(" ").alias("t"), (F.col("l_quantity") * 3 - 10).cast("string").alias("c"))
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("w"))
    part = lambda f, name: F.transform("w", f).alias(name)
    zero = lambda name: part(lambda s: F.lit(0), name)
    d = d.select("l_orderkey", part(lambda s: s["t"], "text"), part(lambda s: s["c"], "conf"), part(lambda s: s["l_partkey"], "left"), zero("top"), zero("width"), zero("height"))
    return datasets.words_of_columns(d, ["l_orderkey"]).select("l_orderkey", "text", F.round("conf", 4).alias("conf"), "x")


def _darkest(grid):
    """Stands in for a recogniser: one word, the box of a region's dark pixels."""
    ys, xs = (grid[..., :3].sum(axis=2) < 150).nonzero()
    return [] if not len(ys) else [("dark", len(ys) / (grid.shape[0] * grid.shape[1]), float(xs.min()), float(ys.min()), float(xs.max() - xs.min() + 1), float(ys.max() - ys.min() + 1))]


@query(f"""WITH {SQL_PIXELS}, p AS (SELECT k, 40 * k - 20 AS x, 30 * k AS y FROM range(16) t(k)), q AS (SELECT k, greatest(x, 0) AS x0, y AS y0, least(x + 100, {WIDTH}) AS x1, least(y + 45, {HEIGHT}) AS y1 FROM p)
SELECT f.image, CAST(k AS BIGINT) AS region, round(count(*) / any_value((x1 - x0) * (y1 - y0)), 6) AS conf, min(f.x)::DOUBLE AS x, min(f.y)::DOUBLE AS y, (max(f.x) - min(f.x) + 1)::DOUBLE AS width, (max(f.y) - min(f.y) + 1)::DOUBLE AS height FROM q JOIN f ON f.x >= x0 AND f.x < x1 AND f.y >= y0 AND f.y < y1 WHERE x1 > x0 AND y1 > y0 AND r + g + b < 150 AND (f.image + k) % 5 > 0 GROUP BY f.image, k""")
def scanned_regions(spark, sf):
    """SRC-13, SRC-14, PRJ-18: regions of the drawn figures through a recogniser, but those that are known already."""
    k = F.col("region")
    plan = drawings._sizes(spark, sf).select("image", F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("region"))
    plan = datasets.region_plan(plan.withColumn("x", 40 * k - 20).withColumn("y", 30 * k).withColumn("width", F.lit(100)).withColumn("height", F.lit(45)), 1200)
    known = plan.filter((F.col("image") + k) % 5 == 0).select("image", "region")
    d = datasets.scan_regions(figure_pixels(spark, sf), plan, _darkest, known=known)
    return d.select("image", "region", F.round("conf", 6).alias("conf"), "x", "y", "width", "height")


@query()
def degraded_figures(spark, sf):
    """ORC-07, PRJ-12, PRJ-13: harder inputs of the drawn figures, by seed of the case."""
    cases = drawings._sizes(spark, sf).select("image", F.concat(F.lit("case_"), F.col("image").cast("string")).alias("case"))
    d = convert.degraded(figure_pixels(spark, sf), cases, {"scale": (0.95, 1.05), "gamma": (0.8, 1.2), "contrast": (0.8, 1.2), "noise_sigma": (1.0, 3.0)})
    return d.groupBy("image", "y").agg(F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total"), F.count_if(F.col("a") == 0).alias("clear"))


@query("""WITH g AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'axes' ELSE 'geometry' END AS collection, l_linenumber AS ord, l_quantity AS x, l_discount * 300 AS y, (l_tax * 100)::INT % 3 + 1.0 AS r, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
l AS (SELECT k, collection, list([{'i': i, 'x': x, 'y': y, 'r': r}] ORDER BY i) AS c FROM g GROUP BY ALL),
o AS (SELECT k, collection, list_reduce(c, lambda a, b: CASE WHEN len(list_filter(a, lambda e: sqrt((e.x - b[1].x) ** 2 + (e.y - b[1].y) ** 2) <= 5 AND abs(e.r - b[1].r) <= 2)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l)
SELECT k, collection, CAST(unnest(kept).i AS BIGINT) AS ord FROM o""")
def geometry_dedup(spark, sf):
    """SET-04, SET-03: circles of two collections without near duplicates of their own collection."""
    from pyspark.sql import Window

    n = F.col("l_linenumber")
    i = F.row_number().over(Window.partitionBy("l_orderkey", n % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(n % 2 == 0, "axes").otherwise("geometry").alias("collection"), F.lit("circle").alias("kind"), i.cast("long").alias("ord"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 300).alias("b"), (F.bround(F.col("l_tax") * 100).cast("int") % 3 + 1.0).alias("c"), F.lit(None).cast("double").alias("d"))
    return extract.deduplicate(g, ["k"]).select("k", "collection", "ord")


@query(f"""WITH {SQL_PIXELS}, t AS (SELECT k, (37 * k)::DOUBLE AS x, (11 + 19 * k)::DOUBLE AS y, 5 + k AS w, 3 + k % 7 AS h FROM range(16) t(k))
SELECT f.image, k AS item, round(avg((0.299 * r + 0.587 * g + 0.114 * b < 180)::INT), 6) AS ink, CASE WHEN avg((0.299 * r + 0.587 * g + 0.114 * b < 180)::INT) > 0.32 THEN 'bold' ELSE 'normal' END AS weight FROM t JOIN f ON f.x >= t.x AND f.x < t.x + w AND f.y >= t.y AND f.y < t.y + h GROUP BY f.image, k""")
def text_weights(spark, sf):
    """PRJ-02, PRJ-18: weight of lettering by its ink."""
    k = F.col("item")
    texts = drawings._sizes(spark, sf).select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("item")).select("image", "item", (37 * k).cast("double").alias("x"), (11 + 19 * k).cast("double").alias("y"), (5 + k).alias("width"), (3 + k % 7).alias("height"))
    return raster.weights(figure_pixels(spark, sf), texts).withColumn("ink", F.round("ink", 6))


@query(f"""WITH {SQL_PIXELS}, g AS (SELECT image, y, x, (r + g + b) / 3.0::DOUBLE AS v, a > 10 AND 0.2126 * r + 0.7152 * g + 0.0722 * b < 245 AS ink, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 > 190 AS light FROM f),
d AS (SELECT *, abs(lead(v) OVER (PARTITION BY image, y ORDER BY x) - v) > 8 AS edge FROM g)
SELECT image, round(var_pop(v), 4) AS variance, round(avg(edge::INT), 6) AS edges, var_pop(v) >= 2 AND avg(ink::INT) BETWEEN 0.002 AND 0.98 AND avg(edge::INT) >= 0.001 AS sane, count(*) FILTER (light) AS light FROM d GROUP BY image""")
def figure_sanity(spark, sf):
    """FLT-12, PRJ-11, AGG-03: whether the drawn figures are figures, and their light pixels for recognition."""
    p = figure_pixels(spark, sf)
    d = raster.features(p.withColumn("v", (F.col("r") + F.col("g") + F.col("b")) / 3.0), "v", X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a")), 8.0)
    light = raster.binary(p).groupBy("image").agg(F.count_if(F.col("v") == 255).alias("light"))
    return d.join(light, "image").select("image", F.round("variance", 4).alias("variance"), F.round("edges", 6).alias("edges"), raster.sane(F.col("variance"), F.col("ink"), F.col("edges")).alias("sane"), "light")


@query(f"""WITH {labels._ITEMS}, {labels._SQL_BOXES}, l AS (SELECT image, item AS ord, x AS x1, y AS y1, item % 2 = 0 AS up FROM i), j AS (SELECT * FROM l CROSS JOIN b),
r AS (SELECT image, panel, 'x' AS axis, ord, row_number() OVER (PARTITION BY image, panel ORDER BY x1, ord) AS r FROM j WHERE up AND x1 BETWEEN px AND px + pw UNION ALL SELECT image, panel, 'y', ord, row_number() OVER (PARTITION BY image, panel ORDER BY y1, ord) FROM j WHERE NOT up AND y1 BETWEEN py AND py + ph)
SELECT image, panel, axis, ord, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 2""")
def panel_lines(spark, sf):
    """JON-06, SRT-07: the first two upright and level lines of each panel."""
    i = labels._items(spark, sf)
    up = F.col("item") % 2 == 0
    lines = i.select("image", F.col("item").alias("ord"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.when(up, F.col("x")).otherwise(F.col("x") + 50).alias("x2"), F.when(up, F.col("y") + 50).otherwise(F.col("y")).alias("y2"))
    return panels.lines_of_panels(lines, labels._panels(spark, sf))


@query(f"""WITH {labels._ITEMS}, s AS (SELECT image, item, event_type AS role, y + height AS base, floor(x / 9) * 9 AS x, floor(y / 40) * 8 AS y, width, height, event_type || ' ' || item AS t FROM i),
n AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL THEN 0 WHEN greatest(0, least(x + width, lag(x + width) OVER w) - greatest(x, lag(x) OVER w)) / greatest(least(width, lag(width) OVER w), 1) < 0.3 OR base - lag(base) OVER w > greatest(height, lag(height) OVER w) * 1.8 OR role <> lag(role) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY image ORDER BY y, item)),
g AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY y, item) AS grp FROM n)
SELECT image, CAST(grp AS BIGINT) AS grp, string_agg(t, '|' ORDER BY y, item) AS text, min(x) AS x, min(y) AS y, max(x + width) AS "right", max(y + height) AS bottom FROM g GROUP BY image, grp""")
def stacked_items(spark, sf):
    """WIN-11: stacked texts of one role as one."""
    i = labels._items(spark, sf)
    d = i.select("image", "item", F.concat("event_type", F.lit("  "), F.col("item").cast("string")).alias("text"), F.col("event_type").alias("role"), (F.col("y") + F.col("height")).alias("baseline"), (F.floor(F.col("x") / 9) * 9).cast("double").alias("x"), (F.floor(F.col("y") / 40) * 8).cast("double").alias("y"), "width", "height")
    return text.stacked(d, ["image"], overlap=0.3).withColumn("text", F.replace("text", F.lit("\n"), F.lit("|")))


@query("""WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CASE WHEN l_orderkey % 3 = 0 THEN 2 WHEN l_orderkey % 3 = 1 THEN 12 ELSE CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 21 END END AS len, 6 + l_orderkey % 7 AS gap FROM lineitem),
d AS (SELECT k, len, CASE WHEN lead(i) OVER w IS NOT NULL THEN 30 - len END AS gap FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, count(*) AS n, avg(len) AS dash, stddev_pop(len) AS sd, count(DISTINCT len) AS lens, avg(gap) AS gap, stddev_pop(gap) AS gsd, count(gap) AS gaps, list(len ORDER BY len) AS l FROM d GROUP BY k),
c AS (SELECT *, CASE WHEN n < 3 OR gaps = 0 THEN 'unknown' WHEN dash < 4 AND gap > 1.5 * dash THEN 'dotted' WHEN sd / dash < 0.3 AND gsd / gap < 0.3 THEN 'uniform' WHEN lens <= 3 THEN 'alternating' ELSE 'unknown' END AS pattern, list_avg(l[:n // 2]) AS short, list_avg(l[n // 2 + 1:]) AS long FROM s),
t AS (SELECT *, list_transform([dash, gap, short, long], lambda v: CASE WHEN v < 10 THEN round_even(v / 2, 0) * 2 ELSE round_even(v / 5, 0) * 5 END) AS u FROM c)
SELECT k, pattern, CASE WHEN n < 3 OR gaps = 0 THEN '4.0,4.0' WHEN pattern = 'dotted' THEN '2.0,' || greatest(2.0::DOUBLE, u[2]) WHEN pattern = 'alternating' AND n >= 4 THEN u[3] || ',' || greatest(2.0::DOUBLE, u[2]) || ',' || u[4] || ',' || greatest(2.0::DOUBLE, u[2]) ELSE greatest(2.0::DOUBLE, u[1]) || ',' || greatest(2.0::DOUBLE, u[2]) END AS dasharray FROM t""")
def dash_arrays(spark, sf):
    """ALG-13, AGG-18: dash arrays of lines made of order lines."""
    from pyspark.sql import Window

    k = F.col("l_orderkey")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    size = F.when(k % 3 == 0, 2).when(k % 3 == 1, 12).otherwise(F.when(F.col("l_linenumber") % 2 == 0, 4).otherwise(21))
    d = sequence.dash_array(store.dealt(table(spark, sf, "lineitem"), "l_orderkey").select(k.alias("k"), (i * 30).alias("start"), size.alias("len")), ["k"])
    return d.select("k", "pattern", F.array_join(F.col("dasharray").cast("array<string>"), ",").alias("dasharray"))


@query("""WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS status, n_nationkey % 3 = 0 AS bad FROM nation)
SELECT CAST(k AS VARCHAR) AS name, status, CASE WHEN bad THEN 'E2001,E2003' ELSE '' END AS errors, CASE WHEN k % 2 = 0 THEN 'W2101' ELSE '' END AS warnings FROM r""")
def report_files(spark, sf):
    """SRC-15, SRC-22, SRC-23: reports of cases written as JSON and read again, tolerant of missing fields."""
    k = F.col("n_nationkey")
    codes = lambda *c: F.array(*[F.struct(F.lit(x).alias("code"), F.lit("m").alias("message")) for x in c])
    r = table(spark, sf, "nation").select(k.cast("string").alias("name"), F.when(k % 3 == 0, "fail").otherwise("pass").alias("status"), F.when(k % 3 == 0, codes("E2001", "E2003")).alias("errors"), F.when(k % 2 == 0, codes("W2101")).alias("warnings"))
    folder = images.work_folder(spark)
    datasets.write_reports(r, "name", folder)
    d = images.reports(spark, f"{folder}/case=*/*.txt")
    return d.select(F.regexp_extract("path", "case=([^/]*)/", 1).alias("name"), "status", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("""WITH s AS (SELECT o_orderstatus AS tier, count(*) FILTER (o_orderkey % 5 > 0) AS total, count(*) FILTER (o_orderkey % 5 > 1) AS passed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus)
SELECT '| tier | total | passed |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || tier || ' | ' || total || ' | ' || passed || ' |', chr(10) ORDER BY passed DESC, tier) AS value FROM s""")
def summary_markdown(spark, sf):
    """SRC-16, SRT-08, SRT-09, AGG-27: the summary of selected cases as a Markdown table."""
    o = batch.only(table(spark, sf, "orders").withColumn("id", F.col("o_orderpriority")), ["1-URGENT", "2-HIGH"], None)
    k = F.col("o_orderkey") % 5
    r = o.select(F.col("o_orderstatus").alias("tier"), F.when(k == 0, "skipped").when(k == 1, "fail").otherwise("pass").alias("status"))
    s = batch.summary(r, ["tier"]).select("tier", "total", "passed")
    return batch.markdown(s, [-F.col("passed"), F.col("tier")])


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 ELSE -1.5 END AS limit_, CASE WHEN o_orderkey % 2 = 0 THEN '{"code":"E2001","context":{"tag":"' || o_orderstatus || '"},"hint":"look","message":"forbidden element"}' ELSE '{"code":"E2009","hint":"look","message":"text without id"}' END AS issue FROM orders""")
def issue_payloads(spark, sf):
    """PRJ-24, PRJ-25: options of cases with defaults, and issues with message, hint and context."""
    k = F.col("o_orderkey")
    options = F.when(k % 4 == 0, F.create_map(F.lit("max"), F.col("o_custkey").cast("string"))).when(k % 4 == 1, F.create_map(F.lit("max"), F.lit("wide"))).when(k % 4 == 2, F.create_map(F.lit("min"), F.lit("3"))).otherwise(F.create_map(F.lit("max"), F.lit("-1.5")))
    code = F.when(k % 2 == 0, "E2001").otherwise("E2009")
    issue = rules.payload(code, F.when(k % 2 == 0, F.create_map(F.lit("tag"), F.col("o_orderstatus"))), F.lit("look"))
    return table(spark, sf, "orders").select("o_orderkey", datasets.option(options, "max", "double", 0.75).alias("limit_"), issue.alias("issue"))


_CODES = ", ".join(f"({i}, '{c}', '{m}')" for i, (c, m) in enumerate(sorted(rules.CODES.items())))


@query(f"""WITH k AS (SELECT * FROM (VALUES {_CODES}) v(i, code, message)), e AS (SELECT *, event_id % 31 AS i FROM events)
SELECT coalesce(code, 'X' || e.i) AS code, coalesce(message, '-') AS message, CASE WHEN code IS NULL THEN '-' WHEN code LIKE 'E%' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM e LEFT JOIN k USING (i) GROUP BY ALL""")
def registered_codes(spark, sf):
    """VAL-20: events as issues, counted by code with the registry's message and severity; codes that aren't registered have neither."""
    names = F.array(*[F.lit(c) for c in sorted(rules.CODES)])
    i = (F.col("event_id") % 31).cast("int")
    code = F.coalesce(F.get(names, i), F.concat(F.lit("X"), i.cast("string")))
    message = F.get_json_object(rules.payload(F.col("code"), F.create_map().cast("map<string,string>")), "$.message")
    d = table(spark, sf, "events").select(code.alias("code")).withColumn("message", message)
    severity = F.when(F.col("message").isNull(), "-").when(F.startswith("code", F.lit("E")), "error").otherwise("warning")
    return d.select("code", F.coalesce("message", F.lit("-")).alias("message"), severity.alias("severity")).groupBy("code", "message", "severity").agg(F.count("*").alias("n"))
