"""Queries of texts, panels and figures as rows: roles, blocks, wordings, configuration and classification.

Events stand for the items of figures of 900 x 600, twenty to a figure, each with three panels.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.functions import figures as G
from rasterlake.functions import labels as L
from rasterlake.operators import classify, colors, layout, panels, rules, scoring, spatial
from rasterlake.plans.common import query, table

_BOXES = (("A3", 1, 20, 100, 270, 400), ("A4", 2, 310, 100, 270, 400), ("A5", 3, 570, 90, 290, 420))
_ITEMS = """i AS (SELECT event_id // 20 AS image, event_id AS item, (event_id * 37 % 880)::DOUBLE AS x, (event_id * 53 % 590)::DOUBLE AS y, (CASE WHEN event_id % 23 = 0 THEN 600 ELSE event_id * 29 % 260 + 10 END)::DOUBLE AS width, (8 + event_id % 25)::DOUBLE AS height, event_type FROM events)"""
_SQL_BOXES = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {o}, {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for n, o, x, y, w, h in _BOXES) + ") t(panel, p_ord, px, py, pw, ph))"
_CENTER = "c AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy FROM i)"


def _items(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.floor(e / 20).alias("image"), e.alias("item"), (e * 37 % 880).cast("double").alias("x"), (e * 53 % 590).cast("double").alias("y"),
        F.when(e % 23 == 0, 600).otherwise(e * 29 % 260 + 10).cast("double").alias("width"), (8 + e % 25).cast("double").alias("height"), "event_type",
    )


def _images(spark, sf):
    return _items(spark, sf).select("image").distinct()


def _panels(spark, sf):
    box = F.array(*[F.struct(F.lit(n).alias("panel"), F.lit(o).alias("ord"), *[F.lit(float(v)).alias(c) for c, v in zip(("x", "y", "width", "height"), b, strict=True)]) for n, o, *b in _BOXES])
    return _images(spark, sf).select("image", F.explode(box).alias("b")).select("image", "b.*")


def _sizes(spark, sf):
    return _images(spark, sf).withColumn("width", F.lit(900)).withColumn("height", F.lit(600))


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, {_CENTER}, t AS (SELECT *, y < 60 AND width > 450 AS wide, y < 84 AND width > 405 AS narrow FROM c), u AS (SELECT *, CASE WHEN bool_or(wide) OVER (PARTITION BY image) THEN wide ELSE narrow END AS title FROM t),
r AS (SELECT u.image, u.item, CASE WHEN bool_or(cx BETWEEN px AND px + pw AND cy BETWEEN py AND py + ph * 0.3 AND width <= pw * 0.4) THEN 'panel_label' WHEN any_value(title) THEN 'title' WHEN bool_or(cx BETWEEN px AND px + pw AND cy BETWEEN py + ph * 0.8 AND py + ph) THEN 'axis_label' ELSE 'annotation' END AS role FROM u CROSS JOIN b GROUP BY u.image, u.item)
SELECT image, item, role, CASE WHEN role IN ('title', 'axis_label') THEN 'middle' ELSE 'start' END AS anchor, role NOT IN ('title', 'panel_label') AS render FROM r""")
def event_roles(spark, sf):
    """JON-03: roles of texts in a figure of three panels."""
    return panels.event_roles(_items(spark, sf), _panels(spark, sf), _sizes(spark, sf))


@query(f"""WITH {_ITEMS}, {_CENTER}, t AS (SELECT *, y < 60 AND width > 450 AS top FROM c), u AS (SELECT *, row_number() OVER (PARTITION BY image, top ORDER BY y, x, item) AS r FROM t)
SELECT image, item, CASE WHEN top AND r = 1 THEN 'title' WHEN cx BETWEEN 100 AND 800 AND cy >= 500 THEN 'axis_label_x' WHEN cx <= 100 AND cy BETWEEN 100 AND 500 THEN 'axis_label_y' WHEN cy <= 100 AND cx >= 520 THEN 'legend' ELSE 'annotation' END AS role FROM u""")
def plot_roles(spark, sf):
    """JON-05: roles of texts around a line plot."""
    plots = _images(spark, sf).select("image", F.lit(100.0).alias("x"), F.lit(100.0).alias("y"), F.lit(700.0).alias("width"), F.lit(400.0).alias("height"))
    return panels.plot_roles(_items(spark, sf), plots, _sizes(spark, sf))


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, {_CENTER} SELECT c.image, c.item, coalesce(min_by(panel, p_ord), '-') AS panel, CASE WHEN any_value(c.y) < 90 THEN 'title' WHEN any_value(c.y) > 510 THEN 'axis_x' WHEN any_value(c.x) < 135 THEN 'axis_y' ELSE 'annotation' END AS role
FROM c LEFT JOIN b ON cx BETWEEN px AND px + pw AND cy BETWEEN py AND py + ph GROUP BY c.image, c.item""")
def first_panels(spark, sf):
    """JON-02, CLS-05, PRJ-17: the first panel that holds a text's middle, and its role by place."""
    d = panels.panel_of(_items(spark, sf), _panels(spark, sf), ["image", "item"], panels.center_x(), panels.center_y())
    return d.select("image", "item", F.coalesce("panel", F.lit("-")).alias("panel"), panels.region_role(F.col("x"), F.col("y"), F.lit(900), F.lit(600)).alias("role"))


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, {_CENTER}, d AS (SELECT image, item, item AS ord, x AS x1, x + width AS x2, y AS y1, cx FROM c WHERE item % 2 = 0),
p AS (SELECT d.*, b.*, 1 - (y1 - py) / ph AS ratio, row_number() OVER (PARTITION BY item ORDER BY p_ord) AS r FROM d JOIN b ON cx BETWEEN px AND px + pw AND y1 BETWEEN py AND py + ph),
f AS (SELECT *, round_even(ratio, 2) AS place FROM p WHERE r = 1 AND x2 - x1 >= pw * 0.4 AND ratio BETWEEN 0.15 AND 0.9), l AS (SELECT *, row_number() OVER (PARTITION BY image, panel, place ORDER BY ord) AS k FROM f),
t AS (SELECT l.ord, min_by(event_type || 'Th', c.item) AS label FROM l JOIN c ON c.image = l.image AND c.item % 2 = 1 AND c.cx BETWEEN px AND px + pw AND abs(c.cy - y1) <= 16 WHERE k = 1 GROUP BY l.ord)
SELECT image, panel, ord, round_even(ratio, 4) AS y_ratio, coalesce(label, '-') AS label FROM l LEFT JOIN t USING (ord) WHERE k = 1""")
def threshold_labels(spark, sf):
    """JON-08, SET-08, JON-02: level dashed lines of panels, one a place, with the text beside them."""
    i = _items(spark, sf)
    dashed = i.filter("item % 2 = 0").select("image", F.col("item").alias("ord"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), F.col("y").alias("y2"))
    texts = i.filter("item % 2 = 1").select("image", F.col("item").alias("ord"), F.concat("event_type", F.lit("Th")).alias("text"), "x", "y", "width", "height")
    return panels.threshold_lines(dashed, _panels(spark, sf), texts).fillna("-", ["label"])


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, g AS (SELECT image, 'A' || (3 + item % 3) AS panel, CASE WHEN item % 2 = 0 THEN 'ttt' ELSE 'hys' END AS kind FROM i WHERE item % 7 = 0), w AS (SELECT DISTINCT image, panel, kind FROM i CROSS JOIN b CROSS JOIN (SELECT unnest(['ttt', 'hys']) AS kind) WHERE image % 2 = 0 AND (kind = 'ttt' OR panel <> 'A5'))
SELECT image, panel, kind, 'given' AS source FROM g UNION ALL SELECT image, panel, kind, 'default' FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image = w.image AND g.panel = w.panel AND g.kind = w.kind)""")
def completed_guides(spark, sf):
    """JON-18: default guides for panels of large figures that lack one."""
    i = _items(spark, sf).filter("item % 7 = 0")
    guides = i.select("image", F.concat(F.lit("A"), (3 + F.col("item") % 3).cast("string")).alias("panel"), F.when(F.col("item") % 2 == 0, "ttt").otherwise("hys").alias("kind"))
    sizes = _images(spark, sf).withColumn("width", F.lit(1600)).withColumn("height", F.when(F.col("image") % 2 == 0, 900).otherwise(899))
    return panels.completed_guides(_panels(spark, sf), guides, sizes)


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, t AS (SELECT image, item, 'A' || (2 + item % 5) AS panel, CASE WHEN item % 11 = 0 THEN NULL ELSE item % 10 / 10.0::DOUBLE END AS rx, item % 7 / 7.0::DOUBLE AS ry FROM i)
SELECT image, item, round(CASE WHEN rx IS NULL THEN NULL ELSE px + pw * rx END, 6) AS x, round(CASE WHEN rx IS NULL THEN NULL ELSE py + ph * ry END, 6) AS y FROM t LEFT JOIN b USING (panel)""")
def placed_texts(spark, sf):
    """JON-15: places of texts given by ratios of a panel."""
    i = F.col("item")
    t = _items(spark, sf).select("image", "item", F.concat(F.lit("A"), (2 + i % 5).cast("string")).alias("panel"), F.when(i % 11 == 0, "none").otherwise((i % 10 / 10.0).cast("string")).alias("x_ratio"), (i % 7 / 7.0).cast("string").alias("y_ratio"))
    d = panels.placed_texts(t, _panels(spark, sf))
    return d.select("image", "item", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, {_CENTER}, j AS (SELECT c.*, panel, y + height AS base FROM c JOIN b ON cx BETWEEN px AND px + pw AND cy BETWEEN py AND py + ph WHERE item % 13 <> 0 AND item % 4 <> 1),
m AS (SELECT image, panel, greatest(list_sort(list(height))[CAST(count(*) // 2 AS INT) + 1] * 1.6, 8) AS gap FROM j GROUP BY image, panel),
n AS (SELECT j.*, CASE WHEN abs(base - lag(base) OVER w) > gap THEN 1 ELSE 0 END AS new FROM j JOIN m USING (image, panel) WINDOW w AS (PARTITION BY image, panel ORDER BY base, x, item)),
k AS (SELECT *, sum(new) OVER (PARTITION BY image, panel ORDER BY base, x, item) AS block FROM n)
SELECT image, panel, CAST(block AS BIGINT) AS block, min(x) AS x, min(base) AS y, string_agg(event_type || item, '|' ORDER BY base, x, item) AS lines, list(height * 0.5 ORDER BY base, x, item)[CAST(count(*) // 2 AS INT) + 1] AS font_size FROM k GROUP BY image, panel, block""")
def text_blocks(spark, sf):
    """WIN-12: blocks of texts in each panel."""
    d = _items(spark, sf)
    role = F.when(F.col("item") % 4 == 1, "panel_label").otherwise("annotation")
    t = d.select("image", "item", F.concat("event_type", F.col("item").cast("string")).alias("text"), role.alias("role"), (F.col("item") % 13 != 0).alias("render"), "x", (F.col("y") + F.col("height")).alias("y"), (F.col("height") * 0.5).alias("font_size"), F.struct("x", "y", "width", "height").alias("box"))
    return panels.text_blocks(t, _panels(spark, sf)).withColumn("lines", F.array_join("lines", "|"))


@query(f"""WITH {_ITEMS}, w AS (SELECT *, item // 5 AS line, lag(event_type) OVER (PARTITION BY image, item // 5 ORDER BY item) AS prev FROM i),
k AS (SELECT * FROM w WHERE prev IS NULL OR prev <> event_type), h AS (SELECT line, string_agg(event_type, ' ' ORDER BY item) AS text, greatest(6, list_sort(list(height))[CAST(count(*) // 2 AS INT) + 1] * 0.6) AS font_size FROM k GROUP BY line),
g AS (SELECT image, line, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) AS baseline, round(avg(height / 40), 6) AS conf FROM w GROUP BY image, line)
SELECT image, line, text, x, y, width, baseline, conf, round(font_size, 6) AS font_size FROM g JOIN h USING (line)""")
def line_items(spark, sf):
    """AGG-21: words to lines with their box, confidence and font size."""
    w = _items(spark, sf).select("image", F.floor(F.col("item") / 5).alias("line"), F.col("item").alias("ord"), F.col("event_type").alias("text"), (F.col("height") / 40).alias("conf"), "x", "y", "width", "height")
    d = panels.line_items(w, ["image", "line"])
    return d.select("image", "line", "text", "x", "y", "width", "baseline", F.round("conf", 6).alias("conf"), F.round("font_size", 6).alias("font_size"))


@query(f"""WITH {_ITEMS}, t AS (SELECT *, item % 3 > 0 AS is_item, CASE WHEN item % 7 > 0 THEN height / 40 END AS conf FROM i)
SELECT image, count(*) AS blocks_total, count(*) FILTER (is_item) AS text_items, coalesce(round_even(avg(conf) FILTER (is_item), 3), 0) AS avg_conf, count(*) FILTER (item % 5 > 0 AND item % 2 = 0) AS renderable FROM t GROUP BY image""")
def recognition_stats(spark, sf):
    """AGG-20, FLT-13: what was recognised in each figure, and how many texts of it are drawn."""
    i = _items(spark, sf)
    words = i.withColumn("conf", F.when(F.col("item") % 7 > 0, (F.col("height") / 40).cast("string")).otherwise("none"))
    drawn = i.groupBy("image").agg(F.count_if(panels.renderable(F.when(F.col("item") % 5 > 0, F.col("event_type")).otherwise("  "), F.when(F.col("item") % 2 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(False)))).alias("renderable"))
    return panels.recognition_stats(words, words.filter("item % 3 > 0")).join(drawn, "image")


@query(f"""WITH {_ITEMS}, {_SQL_BOXES}, l AS (SELECT image, item AS ord, x AS x1, y AS y1, CASE WHEN item % 2 = 0 THEN x ELSE x + width END AS x2, CASE WHEN item % 2 = 0 THEN y + height ELSE y END AS y2, item % 4 AS w FROM i),
j AS (SELECT l.*, b.*, abs(x1 - x2) < 1 AND x1 BETWEEN px AND px + pw AS up, abs(y1 - y2) < 1 AND y1 BETWEEN py AND py + ph AS flat, abs(x1 - x2) <= 1 AND x1 BETWEEN px AND px + pw AS dash FROM l CROSS JOIN b),
g AS (SELECT image, panel, any_value(px) AS px, any_value(py) AS py, any_value(pw) AS pw, any_value(ph) AS ph, max_by(x1, ord) FILTER (up) AS vx, max_by(w, ord) FILTER (up) AS vw, max_by(y1, ord) FILTER (flat) AS hy, max_by(w, ord) FILTER (flat) AS hw,
  count(*) FILTER (dash) AS n, min(x1) FILTER (dash) AS a, max(x1) FILTER (dash) AS z, count(*) AS lines FROM j GROUP BY image, panel)
SELECT image, panel, px AS x0, py + ph AS y1, CASE WHEN abs(coalesce(vx, px) - px) <= 3 THEN px ELSE vx END AS y_axis_x, coalesce(vw, 2) AS y_axis_width, CASE WHEN abs(coalesce(hy, py + ph) - py - ph) <= 3 THEN py + ph ELSE hy END AS x_axis_y, coalesce(hw, 2) AS x_axis_width,
  round(CASE WHEN n >= 2 THEN a ELSE px + pw * 0.2 END, 6) AS t_start_x, round(CASE WHEN n >= 2 THEN z ELSE px + pw * 0.6 END, 6) AS t_trigger_x, 3 AS panels_detected, lines AS axes_lines_detected FROM g""")
def panel_metadata(spark, sf):
    """WIN-17, WIN-18, NRM-05: axes and times of each panel."""
    i = _items(spark, sf)
    up = F.col("item") % 2 == 0
    lines = i.select("image", F.col("item").alias("ord"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.when(up, F.col("x")).otherwise(F.col("x") + F.col("width")).alias("x2"), F.when(up, F.col("y") + F.col("height")).otherwise(F.col("y")).alias("y2"), (F.col("item") % 4).alias("stroke_width"))
    d = layout.panel_metadata(_panels(spark, sf), lines, lines)
    return d.select("image", "panel", "x0", "y1", "y_axis_x", F.col("y_axis_width").cast("long").alias("y_axis_width"), "x_axis_y", F.col("x_axis_width").cast("long").alias("x_axis_width"), F.round("t_start_x", 6).alias("t_start_x"), F.round("t_trigger_x", 6).alias("t_trigger_x"), F.col("panels_detected").cast("int").alias("panels_detected"), "axes_lines_detected")


_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda t: trim(t) <> '')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_LINES} AS lines FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(lines, lambda t: trim(regexp_replace('- ' || t, '^[•\\-–· ]+', ''))), lambda t: t <> '') AS bullets FROM d)
SELECT doc_id, CASE WHEN starts_with(lower(trim(t)), 'a3') THEN 'A3' WHEN starts_with(lower(trim(t)), 'a4') THEN 'A4' WHEN starts_with(lower(trim(t)), 'a5') THEN 'A5' ELSE '-' END AS label, len(bullets) AS bullets, md5(array_to_string(bullets, '|')) AS digest,
CASE doc_id % 3 WHEN 0 THEN 'Serving beam' WHEN 1 THEN 'Neighbor/Target beam' ELSE left(t, 20) END AS wording FROM d JOIN b USING (doc_id)""")
def label_texts(spark, sf):
    """STR-10, STR-12, STR-14: label prefixes, canonical wordings and bullets."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda t: F.trim(t) != "")
    b = L.bullets(F.transform(lines, lambda t: F.concat(F.lit("- "), t)))
    role = F.when(F.col("doc_id") % 3 == 0, "curve_label_serving").when(F.col("doc_id") % 3 == 1, "curve_label_neighbor").otherwise("annotation")
    return d.select("doc_id", F.coalesce(L.label_prefix(F.col("t")), F.lit("-")).alias("label"), F.size(b).cast("long").alias("bullets"), F.md5(F.array_join(b, "|")).alias("digest"), L.canonical(role, F.substring("t", 1, 20)).alias("wording"))


@query("""WITH t AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 4 = 0 THEN 'Goal: ' || l_returnflag || ': ' || l_partkey WHEN l_linenumber % 5 = 0 THEN 'the OUTPUT ' || l_suppkey ELSE l_linestatus || l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lines FROM lineitem GROUP BY l_orderkey),
g AS (SELECT l_orderkey, list_filter(lines, lambda t: contains(lower(t), 'goal')) AS g, list_filter(lines, lambda t: contains(lower(t), 'output') AND NOT contains(lower(t), 'goal')) AS o, list_filter(lines, lambda t: NOT contains(lower(t), 'goal') AND NOT contains(lower(t), 'output')) AS r FROM t),
h AS (SELECT l_orderkey, r, CASE WHEN len(g) > 0 THEN trim(regexp_replace(g[-1], '^[^:]*:', '')) END AS goal, CASE WHEN len(o) > 0 THEN o[-1] END AS output FROM g)
SELECT l_orderkey, coalesce(goal, r[1], '-') AS goal, coalesce(output, CASE WHEN goal IS NULL THEN r[2] ELSE r[1] END, '-') AS output FROM h""")
def goal_lines(spark, sf):
    """STR-13: goal and output of the lines of an order."""
    n = F.col("l_linenumber")
    line = F.when(n % 4 == 0, F.concat(F.lit("Goal: "), "l_returnflag", F.lit(": "), F.col("l_partkey").cast("string"))).when(n % 5 == 0, F.concat(F.lit("the OUTPUT "), F.col("l_suppkey").cast("string"))).otherwise(F.concat("l_linestatus", F.col("l_partkey").cast("string")))
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    g = L.goal_output(F.col("lines"))
    return d.select("l_orderkey", F.coalesce(g["goal"], F.lit("-")).alias("goal"), F.coalesce(g["output"], F.lit("-")).alias("output"))


@query("""WITH t AS (SELECT p_partkey, p_size || ' ' || p_name || chr(10) || p_partkey || chr(10) || p_brand || '  12 x' AS t FROM part),
l AS (SELECT p_partkey, t, list_transform(string_split(t, chr(10)), lambda s: list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) AS lines FROM t)
SELECT p_partkey, array_to_string(list_transform(lines, lambda w: array_to_string(CASE WHEN len(w) > 1 AND regexp_full_match(w[1], '[0-9]+') AND len(list_filter(w[2:], lambda x: regexp_full_match(x, '[A-Za-z]+'))) > 0 THEN w[2:] ELSE w END, ' ')), chr(10)) AS text FROM l""")
def leading_numbers(spark, sf):
    """STR-11: leading numbers of lines."""
    t = F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("\n"), F.col("p_partkey").cast("string"), F.lit("\n"), "p_brand", F.lit("  12 x"))
    return table(spark, sf, "part").select("p_partkey", L.drop_leading_number(t).alias("text"))


@query("""SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]', ' ', 'g'), ' +'), lambda t: t <> '') AS w FROM documents)""")
def figure_words(spark, sf):
    """STR-20: lower-case words of texts."""
    w = classify.words_of(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.md5(F.array_join(w, " ")).alias("digest"))


_FACTS = {
    "long_v": "doc_id % 9", "long_h": "doc_id // 3 % 5", "short_v": "doc_id * 61 % 9000", "short_h": "doc_id % 13", "colors": "doc_id * 7 % 260", "width": "900 + doc_id % 4 * 500", "height": "500 + doc_id % 5 * 200",
    "ink": "doc_id % 41 / 100.0", "saturated": "doc_id % 47 / 100.0", "aligned": "doc_id % 101 / 100.0",
}
#: Words of a document and, by its number, some that the rules look for.
_EXTRA = ("agent reward", "project architecture wp1 wp3", "latency cdf", "work packages panel", "", "state", "wp2 panela")


def _sql_rule(text: str) -> str:
    """A rule's condition in SQL: no suffixes of doubles, lists instead of arrays."""
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", text).replace("array_contains", "list_contains")


def _sql_sum(rules, start: str = "0") -> str:
    return " + ".join([start, *[f"CASE WHEN {_sql_rule(c)} THEN {_sql_rule(str(w)) if isinstance(w, str) else f'{w}::DOUBLE'} ELSE 0 END" for c, w in rules]])


_T = list(classify.RULES)
_EXTRA_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_EXTRA)) + " END"
_HITS = lambda words: " + ".join(f"CASE WHEN contains(joined, '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"""WITH a AS (SELECT doc_id, {", ".join(f"CAST({v} AS {'DOUBLE' if '.0' in v else 'BIGINT'}) AS {k}" for k, v in _FACTS.items())}, list_filter(string_split(lower({_EXTRA_SQL} || CASE WHEN doc_id % 3 = 0 THEN ' ' || lang || repeat(' x', CAST(doc_id % 40 AS INTEGER)) ELSE '' END), ' '), lambda t: t <> '') AS tokens FROM documents),
b AS (SELECT *, array_to_string(tokens, ' ') AS joined, len(tokens) AS n_tokens, short_v + short_h AS short, width::DOUBLE / height AS aspect FROM a), c AS (SELECT *, {_HITS(classify.LOOP_WORDS)} AS loop_hits, {_HITS(classify.GRID_WORDS)} AS grid_hits FROM b),
d AS (SELECT *, CASE WHEN {_sql_rule(classify.PROJECT_SHAPE)} THEN greatest(({_sql_sum(classify.PROJECT_RULES)}) * CASE WHEN ink < 0.18 THEN 0.5 ELSE 1 END, 0) ELSE 0 END AS project FROM c),
s AS (SELECT *, {", ".join(f"{_sql_sum(classify.RULES[t], '0::DOUBLE')} AS {'s' + str(k)}" for k, t in enumerate(_T))} FROM d),
l AS (SELECT doc_id, unnest([{", ".join(f"'{t}'" for t in _T)}]) AS template, unnest([{", ".join(f"s{k}" for k in range(len(_T)))}]) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS r FROM l), low AS (SELECT doc_id, coalesce(min(score) FILTER (score > 0), min(score)) AS low FROM l GROUP BY doc_id),
t AS (SELECT doc_id, sum(greatest(score - low, 0)) AS total FROM l JOIN low USING (doc_id) GROUP BY doc_id), e AS (SELECT doc_id, CASE template {" ".join(f"WHEN '{t}' THEN " + " * ".join(f"(CASE WHEN {_sql_rule(c)} THEN {f}::DOUBLE ELSE 1 END)" for c, f in rules) for t, rules in classify.EVIDENCE.items())} END AS scale FROM r JOIN s USING (doc_id) WHERE r = 1),
o AS (SELECT a.doc_id, a.template AS top, a.score, a.score - b.score AS margin, CASE WHEN total > 0 THEN greatest(a.score - low, 0) / total ELSE 1.0 / 6 END * scale AS confidence FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.r = 2 JOIN low ON low.doc_id = a.doc_id JOIN t ON t.doc_id = a.doc_id JOIN e ON e.doc_id = a.doc_id WHERE a.r = 1)
SELECT doc_id, top, round(score, 4) AS score, round(confidence, 6) AS confidence, CASE WHEN confidence < 0.52 OR margin < 0.05 THEN 't_auto_layout' ELSE top END AS decision,
concat_ws(',', CASE WHEN confidence < 0.52 THEN 'LOW_CONFIDENCE' END, CASE WHEN margin < 0.05 THEN 'AMBIGUOUS_MARGIN' END, CASE WHEN confidence < 0.52 OR margin < 0.05 THEN 'FALLBACK_TO_AUTO' END) AS reasons, top IN ('{_T[0]}', '{_T[3]}') OR doc_id % 2 = 0 AS expected FROM o""")
def template_decisions(spark, sf):
    """CLS-01 to CLS-04, STR-19, JON-19, SRT-01: scores, evidence and decision over six templates."""
    words = F.concat(F.expr(_EXTRA_SQL), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang", F.expr("repeat(' x', CAST(doc_id % 40 AS INT))"))).otherwise(""))
    d = table(spark, sf, "documents").select("doc_id", *[F.expr(v.replace("//", "div").replace("100.0", "100.0D")).cast("double" if ".0" in v else "long").alias(k) for k, v in _FACTS.items()], classify.words_of(words).alias("tokens"))
    c = classify.classify(d, ["doc_id"])
    allowed = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(_T[0]), F.lit(_T[3])))
    return c.select("doc_id", "top", F.round("score", 4).alias("score"), F.round("confidence", 6).alias("confidence"), "decision", "reasons", classify.expected_template(F.col("top"), allowed).alias("expected"))


_PALETTE = ", ".join(f"'{c}'" for c in colors.PALETTE)


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INT) AS r, CAST(p_partkey * 91 % 256 AS INT) AS g, CAST(p_size * 5 % 256 AS INT) AS b FROM part), t AS (SELECT unnest([{_PALETTE}]) AS h, unnest(range(11)) AS i),
d AS (SELECT p.*, h, i, sqrt((r - ('0x' || h[2:3])::INT) ** 2 + (g - ('0x' || h[4:5])::INT) ** 2 + (b - ('0x' || h[6:7])::INT) ** 2) AS d FROM p CROSS JOIN t)
SELECT p_partkey, min_by(h, (d, i)) AS snapped, round(min(d), 4) AS distance, any_value(r >= 200 AND g >= 200 AND b >= 200) AS light, any_value(r <= 60 AND g <= 60 AND b <= 60) AS dark, any_value(0.299 * r + 0.587 * g + 0.114 * b >= 180) AS bright FROM d GROUP BY p_partkey""")
def palette_snap(spark, sf):
    """PRJ-07 to PRJ-10: the nearest palette colour and its distance, and tests for light and dark."""
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select("p_partkey", (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))
    rgb = tuple(F.col(c) for c in "rgb")
    d = d.withColumn("snapped", colors.snapped(X.hex_color(*rgb)))
    other = tuple(X.from_hex(F.col("snapped"), i) for i in range(3))
    return d.select("p_partkey", "snapped", F.round(X.color_distance(rgb, other), 4).alias("distance"), X.near_white(*rgb, 200).alias("light"), X.near_black(*rgb, 60).alias("dark"), G.bright(X.hex_color(*rgb), 180).alias("bright"))


@query("""WITH s AS (SELECT p_partkey, 300 + p_size * 97 AS w, 200 + p_partkey * 31 % 1800 AS h FROM part), k AS (SELECT *, greatest(0.6, least(1.8, greatest(w, h) / 800.0::DOUBLE)) AS s FROM s),
b AS (SELECT *, greatest(round_even(31 * s, 0), 3) AS b0 FROM k), c AS (SELECT *, greatest(15, least(61, b0 + (b0 % 2 = 0)::INT)) AS b1 FROM b)
SELECT p_partkey, round(s, 6) AS scale, CAST(b1 + (b1 % 2 = 0)::INT AS INTEGER) AS block_size, CAST(greatest(round_even(h * 0.5 * s, 0), 1) AS INTEGER) AS long_line, CAST(greatest(round_even(h * 0.03 * s, 0), 2) AS INTEGER) AS dash_min, CAST(greatest(round_even(h * 0.12 * s, 0), greatest(round_even(h * 0.03 * s, 0), 2) + 1) AS INTEGER) AS dash_max,
CAST(greatest(round_even(w * h * 0.00005 * s, 0), 8) AS INTEGER) AS min_area, CAST(greatest(round_even(w * h * 0.02 * s, 0), greatest(round_even(w * h * 0.00005 * s, 0), 8) + 1) AS INTEGER) AS max_area, CAST(greatest(round_even(3 * s, 0), 2) AS INTEGER) AS min_size FROM c""")
def adaptive_parameters(spark, sf):
    """PRJ-19, PRJ-14: parameters by the size of an image."""
    w, h = 300 + F.col("p_size") * 97, 200 + F.col("p_partkey") * 31 % 1800
    p = G.adaptive(w.cast("int"), h.cast("int"))
    d = table(spark, sf, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.*")
    return d.withColumn("scale", F.round("scale", 6))


@query("""WITH d AS (SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INT) AS v, 0.5 + p_size / 50.0::DOUBLE AS gamma, 0.6 + p_partkey % 9 / 10.0::DOUBLE AS contrast FROM part), g AS (SELECT *, greatest(0, least(1, (pow(v / 255.0::DOUBLE, gamma) - 0.5) * contrast + 0.5)) AS u FROM d)
SELECT p_partkey, CAST(floor(u * 255 + 1e-9) AS INTEGER) AS v FROM g""")
def gamma_contrast(spark, sf):
    """PRJ-12: gamma and contrast of a channel."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", G.gamma_contrast((k * 37 % 256).cast("int"), 0.5 + F.col("p_size") / 50.0, 0.6 + k % 9 / 10.0).alias("v"))


@query()
def seeded_draws(spark, sf):
    """PRJ-13, PRJ-12: draws by a seed of the case's name, and noise that a second run repeats."""
    d = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("case_"), F.col("p_partkey").cast("string")).alias("case"))
    return G.seeded_draws(d, "case", {"gamma": (0.8, 1.2), "noise": (5.0, 1.0)}).withColumn("seed", F.col("seed").cast("string"))


@query("""WITH l AS (SELECT o_orderkey, 600 + o_custkey % 900 AS w, 500 + o_orderkey % 700 AS h FROM orders), v AS (SELECT l_orderkey AS o_orderkey, list(l_partkey * 7 % 1500) AS vs, list(l_suppkey * 13 % 1200) AS hs FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey),
c AS (SELECT l.*, len(list_filter(coalesce(vs, []), lambda x: x > w * 0.15 AND x < w * 0.85)) AS v, len(list_filter(coalesce(hs, []), lambda y: y > h * 0.2 AND y < h * 0.85)) AS hh FROM l LEFT JOIN v USING (o_orderkey))
SELECT o_orderkey, CASE WHEN v >= 2 AND hh = 0 THEN '1x3' WHEN v >= 1 AND hh >= 1 THEN '2x2' WHEN w >= h * 1.5 THEN '1x3' ELSE '2x2' END AS grid FROM c""")
def grid_choice(spark, sf):
    """FLT-15, CLS-07: the grid of a figure by its separators."""
    o = table(spark, sf, "orders").select("o_orderkey", (600 + F.col("o_custkey") % 900).alias("w"), (500 + F.col("o_orderkey") % 700).alias("h"))
    v = table(spark, sf, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey") * 7 % 1500).alias("vs"), F.collect_list(F.col("l_suppkey") * 13 % 1200).alias("hs"))
    none = F.array().cast("array<bigint>")
    return o.join(v, "o_orderkey", "left").select("o_orderkey", layout.grid_choice(F.col("w"), F.col("h"), F.coalesce("vs", none), F.coalesce("hs", none)).alias("grid"))


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 3 = 0 AS dashed, CASE WHEN o_custkey % 5 = 0 THEN [9.0::DOUBLE, 9.0] END AS given, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4)::DOUBLE END AS w, o_totalprice / 97 AS x FROM orders)
SELECT o_orderkey, CASE WHEN dashed AND given IS NULL THEN greatest(4, coalesce(w, 1) * 3) || ',' || greatest(3, coalesce(w, 1) * 2) WHEN given IS NOT NULL THEN '9.0,9.0' ELSE '-' END AS dasharray, round_even(x / 5, 0) * 5 AS x1 FROM t""")
def normal_geometry(spark, sf):
    """NRM-02: lines snapped to a grid, with default dashes."""
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 3 == 0).alias("dashed"), F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit(9.0), F.lit(9.0))).alias("dasharray"), F.when(k % 4 > 0, (k % 4).cast("double")).alias("stroke_width"), (F.col("o_totalprice") / 97).alias("x1"))
    d = d.select("o_orderkey", G.default_dashes("dashed", "dasharray", "stroke_width", 1.0).alias("d"), G.snapped(F.col("x1"), 5.0).alias("x1"))
    return d.select("o_orderkey", F.coalesce(F.array_join(F.col("d").cast("array<string>"), ","), F.lit("-")).alias("dasharray"), "x1")


@query("""WITH b AS (SELECT n_nationkey, n_nationkey * 61.3 % 700 - 20 AS x, n_nationkey * 17.7 % 500 AS y, 100 + n_nationkey * 11.2 AS w, 80 + n_nationkey * 5.1 AS h FROM nation),
s AS (SELECT n_nationkey, round_even(x / 5, 0) * 5 AS x, round_even(y / 5, 0) * 5 AS y, round_even(w / 5, 0) * 5 AS w, round_even(h / 5, 0) * 5 AS h FROM b)
SELECT n_nationkey, CAST(greatest(0, least(greatest(800 - w, 0), x)) AS DOUBLE) AS x, CAST(greatest(0, least(greatest(500 - h, 0), y)) AS DOUBLE) AS y, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height,
round_even(greatest(0, least(1, n_nationkey / 17.0 - 0.1)), 3)::DOUBLE AS ratio FROM s""")
def normal_panels(spark, sf):
    """NRM-01, PRJ-14: panels snapped to a grid and kept on the canvas."""
    k = F.col("n_nationkey")
    dec = lambda v: v.cast("double")
    d = table(spark, sf, "nation").select("n_nationkey", dec(k * 61.3 % 700 - 20).alias("x"), dec(k * 17.7 % 500).alias("y"), dec(100 + k * 11.2).alias("width"), dec(80 + k * 5.1).alias("height"), (k / 17.0 - 0.1).alias("ratio"))
    d = G.normal_panels(d, 5.0, F.lit(800.0), F.lit(500.0))
    return d.select("n_nationkey", "x", "y", "width", "height", G.normal_ratio(F.col("ratio")).alias("ratio"))


@query("""WITH RECURSIVE n AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE CAST(p_partkey - 1 - p_partkey % 3 % greatest(p_partkey % 40, 1) AS BIGINT) END AS parent, CASE WHEN p_size % 6 = 0 THEN p_type WHEN p_size % 6 = 1 THEN '' END AS value FROM part),
m AS (SELECT node, CASE WHEN parent < node // 40 * 40 THEN node // 40 * 40 ELSE parent END AS parent, nullif(value, '') AS value FROM n),
r AS (SELECT node, node AS here, 0 AS depth FROM m UNION ALL SELECT r.node, m.parent, depth + 1 FROM r JOIN m ON m.node = r.here WHERE m.parent IS NOT NULL)
SELECT r.node, coalesce(min_by(value, depth) FILTER (value IS NOT NULL), '') AS value FROM r JOIN m ON m.node = r.here GROUP BY r.node""")
def resolved_properties(spark, sf):
    """JON-13, JON-12: a property of an element, else of its nearest ancestor that has one."""
    k = F.col("p_partkey")
    top = F.floor(k / 40) * 40
    parent = F.when(k % 40 == 0, F.lit(None).cast("long")).otherwise(F.greatest(k - 1 - k % 3 % F.greatest(k % 40, F.lit(1)), top))
    d = table(spark, sf, "part").select(k.alias("node"), parent.alias("parent"), F.when(F.col("p_size") % 6 == 0, F.col("p_type")).when(F.col("p_size") % 6 == 1, "").alias("value"))
    return spatial.resolved(d, "node", "parent", "value").select("node", F.coalesce("value", F.lit("")).alias("value"))


@query("""SELECT o_orderkey, o_clerk FROM (SELECT o_orderkey, o_orderpriority AS o_clerk, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3""")
def bounded_sample(spark, sf):
    """SRT-10: the first three cases of each group."""
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("o_clerk"))
    return scoring.top_n(d, ["o_clerk"], [F.col("o_orderkey")], 3).drop("rank")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'E3001' WHEN o_orderkey % 19 = 0 THEN 'E3002' WHEN o_totalprice / 500000 > 0.5 OR o_custkey % 100 / 100.0 > 0.6 THEN 'E3003' ELSE 'pass' END AS code FROM orders""")
def diff_codes(spark, sf):
    """VAL-19: codes of the visual comparison."""
    k = F.col("o_orderkey")
    rasterized, comparable = k % 17 != 0, k % 19 != 0
    code = rules.diff_code(rasterized, comparable, F.col("o_totalprice") / 500000, F.col("o_custkey") % 100 / 100.0, F.lit(0.5), F.lit(0.6))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(code, F.lit("pass")).alias("code"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 5 = 0 OR regexp_matches(lower(p_type), 'text|glyph|font') AS outlined FROM part""")
def outlined_texts(spark, sf):
    """STR-27: paths that are outlined text, by id or class."""
    k = F.col("p_partkey")
    node = F.when(k % 2 == 0, F.concat(F.lit("Txt_"), "p_name")).otherwise(F.col("p_name"))
    css = F.when(k % 5 == 0, F.concat("p_type", F.lit(" Glyphs"))).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", L.looks_like_text_path(node, css).alias("outlined"))
