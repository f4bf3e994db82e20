"""Queries of rules, joins, gates and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import rules, scoring
from rasterlake.plans.common import query, table
from rasterlake.sources import store


@query("""SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'E2227' ELSE 'ok' END AS status, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 100000000 ELSE 0 END""")
def edge_nodes(spark, sf):
    """JON-07: edges to nodes by id; an id without a node is an issue row."""
    o = table(spark, sf, "orders").withColumn("to", F.col("o_custkey") + F.when(F.col("o_orderkey") % 97 == 0, 100000000).otherwise(0))
    j = o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("to"), "left")
    return j.select("o_orderkey", "o_custkey", F.when(F.col("c_custkey").isNull(), "E2227").otherwise("ok").alias("status"), "c_nationkey")


@query("""SELECT n_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 0.1::DOUBLE * n_nationkey END, CASE WHEN r_regionkey % 2 = 0 THEN 0.5::DOUBLE + r_regionkey END, 0.75::DOUBLE) AS rmse_max,
CASE WHEN n_nationkey % 3 = 0 THEN 'case' WHEN r_regionkey % 2 = 0 THEN 'tier' ELSE 'default' END AS source FROM nation JOIN region ON r_regionkey = n_regionkey""")
def override_merge(spark, sf):
    """JON-17, SRC-08: thresholds of default, tier and case; the later wins."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    case, tier = F.when(F.col("n_nationkey") % 3 == 0, 0.1 * F.col("n_nationkey")), F.when(F.col("r_regionkey") % 2 == 0, 0.5 + F.col("r_regionkey"))
    return j.select("n_name", scoring.precedence(F.lit(0.75), tier, case).alias("rmse_max"), F.when(case.isNotNull(), "case").when(tier.isNotNull(), "tier").otherwise("default").alias("source"))


REQUIRED = ["article", "nav", "table", "footer", "h1", "ul"]


@query("""WITH t AS (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:]*)', 1))) AS tag FROM pages), r AS (SELECT unnest(['article', 'nav', 'table', 'footer', 'h1', 'ul']) AS tag)
SELECT page_id::VARCHAR AS doc, 'error' AS severity, 'E2003' AS code, r.tag AS subject FROM pages CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = pages.page_id AND t.tag = r.tag)""")
def required_groups(spark, sf):
    """JON-14, VAL-03."""
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"), rules.tags(F.coalesce("html", F.lit(""))).alias("tags"))
    return rules.missing(p, "page_id", REQUIRED, p.select("page_id", F.explode("tags").alias("tag")), "tag")


@query("""WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:]*)', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY tag""")
def tag_inventory(spark, sf):
    """STR-21, VAL-02, VAL-07: tags of markup that isn't well formed. Pages are counted by one tag a page, so there is no distinct shuffle of every tag."""
    t = table(spark, sf, "pages").select(rules.tags(F.coalesce("html", F.lit(""))).alias("t"))
    per = t.select(F.explode(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("tag"), F.size(F.filter("t", lambda y: y == x)).alias("n")))).alias("s"))
    return per.groupBy("s.tag").agg(F.sum("s.n").alias("n"), F.count("*").alias("pages"))


_LITERAL = "CASE p_partkey % 7 WHEN 0 THEN '#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') WHEN 1 THEN '#' || lpad(to_hex(p_partkey % 4096), 3, '0') WHEN 2 THEN 'rgb(' || p_partkey % 256 || ', ' || p_partkey * 3 % 256 || ',' || p_partkey * 7 % 256 || ')' WHEN 3 THEN 'rgb(' || p_partkey % 101 || '%,' || p_partkey * 3 % 101 || '%,50%)' WHEN 4 THEN 'url(#g)' WHEN 5 THEN ' Red ' ELSE '' END"


@query(f"""WITH l AS (SELECT p_partkey, lower(trim({_LITERAL})) AS t FROM part), p AS (SELECT *, regexp_extract(t, '^rgb\\(([^,]*),([^,]*),([^,)]*)\\)$', ['a', 'b', 'c']) AS q FROM l)
SELECT p_partkey, CASE WHEN regexp_matches(t, '^#[0-9a-f]{{6}}$') THEN 'rgb(' || ('0x' || t[2:3])::INT || ',' || ('0x' || t[4:5])::INT || ',' || ('0x' || t[6:7])::INT || ')' WHEN regexp_matches(t, '^#[0-9a-f]{{3}}$') THEN 'rgb(' || ('0x' || t[2] || t[2])::INT || ',' || ('0x' || t[3] || t[3])::INT || ',' || ('0x' || t[4] || t[4])::INT || ')'
WHEN t LIKE 'rgb(%' AND contains(t, '%') THEN 'rgb(' || round_even(replace(trim(q.a), '%', '')::DOUBLE * 255 / 100, 0)::INT || ',' || round_even(replace(trim(q.b), '%', '')::DOUBLE * 255 / 100, 0)::INT || ',' || round_even(replace(trim(q.c), '%', '')::DOUBLE * 255 / 100, 0)::INT || ')'
WHEN t LIKE 'rgb(%' THEN 'rgb(' || trim(q.a) || ',' || trim(q.b) || ',' || trim(q.c) || ')' WHEN t LIKE 'url(%' OR t = '' THEN NULL ELSE t END AS color FROM p""")
def color_parse(spark, sf):
    """STR-22, PRJ-07: literals made from part keys."""
    literal = _LITERAL.replace("to_hex", "hex").replace("hex(p_partkey * 7919 % 16777216)", "hex(p_partkey * 7919 % 16777216)")
    return table(spark, sf, "part").selectExpr("p_partkey", f"{literal} AS s").select("p_partkey", X.parse_color(F.col("s")).alias("color"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity || 'px' WHEN 1 THEN ' -' || l_discount || 'em' WHEN 2 THEN 'auto' ELSE l_partkey || '%' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract(s, '^[ \\t]*([-+]?([0-9]+[.]?[0-9]*|[.][0-9]+))', 1), '') AS DOUBLE) AS number FROM s""")
def number_parse(spark, sf):
    """STR-23, STR-24."""
    s = "CASE l_linenumber % 4 WHEN 0 THEN l_quantity || 'px' WHEN 1 THEN ' -' || l_discount || 'em' WHEN 2 THEN 'auto' ELSE l_partkey || '%' END AS s"
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", s).select("l_orderkey", "l_linenumber", X.leading_number(F.col("s")).alias("number"))


@query("""WITH w AS (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE NOT (abs(l_quantity - 10) <= 4 OR abs(l_quantity - 25) <= 6 OR abs(l_quantity - 40) <= 4)),
g AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 6), c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 6),
a AS (SELECT l_orderkey, 'error' AS severity, 'E2006' AS code, l_quantity::VARCHAR AS subject FROM w UNION ALL SELECT l_orderkey, 'warning', 'W2101', l_linenumber::VARCHAR FROM lineitem WHERE abs(l_discount - l_tax) > 0 AND abs(l_discount - l_tax) <= 0.011
UNION ALL SELECT l_orderkey, 'warning', 'W2102', l_returnflag || '|' || l_linestatus || '|' || n FROM g UNION ALL SELECT l_orderkey, 'error', 'E2005', n::VARCHAR FROM c)
SELECT code, severity, count(*) AS n, count(DISTINCT l_orderkey) AS docs FROM a GROUP BY code, severity""")
def rule_report(spark, sf):
    """VAL-01, VAL-05, VAL-06, VAL-13, VAL-14, AGG-23, SET-07: lines of orders as elements of documents."""
    l = store.dealt(table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey").cast("string")), "key")  # noqa: E741
    off = rules.issue(l.filter(~((F.abs(F.col("l_quantity") - 10) <= 4) | (F.abs(F.col("l_quantity") - 25) <= 6) | (F.abs(F.col("l_quantity") - 40) <= 4))).select("key", "l_quantity").distinct(), "key", "E2006", F.col("l_quantity"))
    near = rules.where(l, "key", "W2101", rules.nearly_aligned(F.col("l_discount") - F.col("l_tax"), 0.011), "l_linenumber")
    dash = rules.simulated_dashes(l, "key", ["l_returnflag", "l_linestatus"])
    many = rules.too_many(l, "key", "l_partkey", 6)
    # no code is in two of the tables, so each counts its own documents
    each = [i.groupBy("doc", "code", "severity").agg(F.count("*").alias("n")) for i in (off, near, dash, many)]
    return reduce(DataFrame.union, each).groupBy("code", "severity").agg(F.sum("n").alias("n"), F.count("doc").alias("docs"))


@query("""SELECT p_size, count(DISTINCT p_brand || p_type) AS colors, count(DISTINCT p_brand || p_type) > 20 AS over FROM part GROUP BY p_size""")
def distinct_palette(spark, sf):
    """AGG-22, VAL-05."""
    return table(spark, sf, "part").groupBy("p_size").agg(F.countDistinct(F.concat("p_brand", "p_type")).alias("colors")).withColumn("over", F.col("colors") > 20)


@query("""WITH t AS (SELECT unnest(CASE WHEN o_orderpriority = '5-LOW' THEN ['UNKNOWN'] ELSE [o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'dear' ELSE 'cheap' END] END) AS tag FROM orders) SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def tag_counts(spark, sf):
    """AGG-27, AGG-29."""
    tags = F.when(F.col("o_orderpriority") != "5-LOW", F.array("o_orderstatus", "o_orderpriority", F.when(F.col("o_totalprice") > 100000, "dear").otherwise("cheap")))
    return scoring.tag_counts(table(spark, sf, "orders").withColumn("tags", tags), "tags")


REASONS = [(["R|F"], "RETURNED"), (["A|F", "N|F"], "FINISHED"), (["N|O"], "OPEN")]


@query("""WITH c AS (SELECT l_orderkey, array_agg(DISTINCT l_returnflag || '|' || l_linestatus) AS c FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(nullif(concat_ws(',', CASE WHEN list_contains(c, 'A|F') OR list_contains(c, 'N|F') THEN 'FINISHED' END, CASE WHEN list_contains(c, 'N|O') THEN 'OPEN' END, CASE WHEN list_contains(c, 'R|F') THEN 'RETURNED' END), ''), 'UNKNOWN') AS reasons FROM c""")
def failure_reasons(spark, sf):
    """AGG-30, SET-09."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("|", "l_returnflag", "l_linestatus").alias("code"))  # noqa: E741
    return scoring.failure_reasons(l, "l_orderkey", "code", REASONS)


@query("""WITH g AS (SELECT o_custkey, sqrt(avg(pow(o_totalprice / 500000, 2))) AS rmse, avg((o_totalprice > 250000)::INT) AS bad, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT CASE WHEN rmse > 0.3 AND bad > 0.1 THEN 'fail:rmse,bad' WHEN rmse > 0.3 THEN 'fail:rmse' WHEN bad > 0.1 THEN 'fail:bad' ELSE 'pass' END AS status, count(*) AS cases, CAST(sum(n) AS BIGINT) AS orders FROM g GROUP BY status""")
def quality_gates(spark, sf):
    """GAT-03, FLT-14, AGG-28: customers as cases."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sqrt(F.avg(F.pow(F.col("o_totalprice") / 500000, 2))).alias("rmse"), F.avg((F.col("o_totalprice") > 250000).cast("int")).alias("bad"), F.count("*").alias("n"))
    return g.withColumn("status", scoring.gate(F.col("rmse"), F.col("bad"), 0.3, 0.1)).groupBy("status").agg(F.count("*").alias("cases"), F.sum("n").alias("orders"))


@query("""WITH d AS (SELECT o_custkey, count(*) AS expected, count(*) FILTER (o_orderstatus <> 'O') AS actual FROM orders GROUP BY o_custkey), r AS (SELECT *, CAST(ceil(greatest(least(expected * 0.7, expected - 1.0), 1)) AS INTEGER) AS need FROM d)
SELECT o_custkey::VARCHAR AS doc, 'error' AS severity, CASE WHEN actual = 0 THEN 'E2017' ELSE 'E2014' END AS code, actual::VARCHAR AS subject FROM r WHERE actual < need""")
def text_expectations(spark, sf):
    """VAL-11, AGG-34: finished orders against all orders of a customer."""
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("o_custkey")).agg(F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") != "O").alias("actual"))
    return rules.text_count(d, "o_custkey", "expected", "actual")


@query()
def markup_validation(spark, sf):
    """SRC-10, VAL-01 to VAL-10, VAL-12 to VAL-18: figures rendered from nations, parsed again and validated."""
    from rasterlake.plans.shapes import svg_elements
    from rasterlake.sources import markup

    docs = svg_elements(spark, sf).withColumn("doc", F.col("n_regionkey").cast("string"))
    e = store.saved(markup.elements(docs, "doc", "svg"), "elements")  # parsed once
    issues = rules.validate_elements(e, {"forbid_elements": ["image"], "required_groups": ["figure_root", "g_axes", "g_text", "g_legend"], "allowed_font_families": ["Arial"], "generic_font_families": ["serif", "sans-serif"], "text_group": "g_text"})
    return rules.report(e, issues)


@query("""WITH c AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS y, CAST(floor(c_acctbal) AS BIGINT) AS v, c_custkey AS key FROM customer),
p AS (SELECT k, y, x, (v + 20000 + x * 7) % 256 AS r, (key * 5 + x) % 256 AS g, CASE WHEN x < 4 THEN 255 ELSE key % 200 END AS b, CASE WHEN key % 6 = 0 THEN 0 ELSE 255 END AS a FROM c, range(9) t(x))
SELECT 'n' || k || '.png' AS image, count(*) AS pixels, CAST(sum((y + 1) * (r + 2 * g + 3 * b + 5 * a) * (x + 1)) AS BIGINT) AS mark, count(*) FILTER (a > 10 AND 0.2126 * r + 0.7152 * g + 0.0722 * b < 245) AS ink FROM p GROUP BY k""")
def png_roundtrip(spark, sf):
    """SRC-01 to SRC-03, SRC-19: customers of each nation as the lines of a figure, written as PNG files, scanned by their magic, and read back as packed
    lines."""
    from pyspark.sql import Window

    from rasterlake.operators import packed
    from rasterlake.sources import images

    key = F.col("c_custkey")
    c = table(spark, sf, "customer").withColumn("y", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x = F.col("x")
    pixels = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("image"), "y", "x", ((F.floor("c_acctbal") + 20000 + x * 7) % 256).cast("int").alias("r"), ((key * 5 + x) % 256).cast("int").alias("g"), F.when(x < 4, 255).otherwise(key % 200).cast("int").alias("b"), F.when(key % 6 == 0, 0).otherwise(255).alias("a"))
    folder = images.write_figures(pixels, images.work_folder(spark))
    good = images.scan_files(spark, folder).filter("valid").select(F.element_at(F.split("path", "/"), -1).alias("image"))
    p = packed.unpack(packed.read_lines(spark, folder)).join(good, "image", "left_semi")
    mark = (F.col("y") + 1) * (F.col("r") + 2 * F.col("g") + 3 * F.col("b") + 5 * F.col("a")) * (F.col("x") + 1)
    return p.groupBy("image").agg(F.count("*").alias("pixels"), F.sum(mark).cast("long").alias("mark"), F.count_if(X.is_ink(*[F.col(c) for c in "rgba"])).alias("ink"))


@query("""SELECT l_returnflag || l_linenumber AS text, round((l_quantity * 3 - 10) / 100, 4) AS conf, CAST(l_partkey AS INTEGER) AS x, CAST(l_suppkey AS INTEGER) AS y, count(*) AS n FROM lineitem WHERE l_linenumber % 4 > 0 AND l_quantity * 3 - 10 >= 0 GROUP BY ALL""")
def tsv_words(spark, sf):
    """SRC-11, SRC-20: words of a recogniser's tab-separated files, written from order lines, read, and kept as an artifact of the run."""
    from rasterlake.sources import datasets, images

    n = F.col("l_linenumber")
    text = F.when(n % 4 > 0, F.concat("l_returnflag", n.cast("string"))).otherwise(" ")
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") * 3 - 10).alias("conf"), F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("top"), F.lit(5).alias("width"), n.alias("height"), text.alias("text"))
    folder = images.work_folder(spark)
    rows.write.csv(f"{folder}/tsv", sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    kept = datasets.artifacts(folder, words=images.ocr_words(spark, f"{folder}/tsv"))
    return spark.read.parquet(kept["words"]).groupBy("text", F.round("conf", 4).alias("conf"), "x", "y").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def params_json(spark, sf):
    """SRC-04, PRJ-24: JSON documents as variants, with typed fields."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").select("user_id", "event_type", (k % 5).alias("bucket")).groupBy("user_id", "event_type", "bucket").agg(F.count("*").alias("n"))




_ELEMENTS = """e0 AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS node, l_partkey AS p, l_suppkey AS s, l_linenumber AS l, l_quantity AS q, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem),
e AS (SELECT *, ['text', 'tspan', 'path', 'line', 'polyline', 'g', 'image', 'linearGradient'][p % 8 + 1] AS tag, CASE WHEN s % 3 > 0 THEN CASE p % 8 WHEN 5 THEN CASE WHEN s % 2 = 0 THEN 'g_axes' ELSE 'g_text' END WHEN 2 THEN CASE WHEN s % 2 = 0 THEN 'Txt_' || node ELSE 'curve' END ELSE 'e' || node END END AS id,
CASE WHEN s % 5 = 0 THEN 'dashed' WHEN s % 7 = 0 THEN 'a GlyphRun' END AS css, CASE WHEN s % 10 = 0 THEN '4,4' END AS dash, CASE WHEN p % 3 > 0 THEN printf('#0000%02x', CAST(q AS INTEGER)) END AS fill, CASE WHEN p % 2 = 0 THEN t / 2.0::DOUBLE END AS width,
CASE WHEN t % 3 = 0 THEN 0.3::DOUBLE WHEN t % 3 = 1 THEN 0 ELSE 7 END AS dy, CASE s % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Arial, sans-serif' WHEN 2 THEN 'Comic Sans MS, serif' END AS font, CASE WHEN p % 5 > 0 THEN 'middle' END AS anchor FROM e0)"""


@query(f"""WITH {_ELEMENTS}, b AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc ORDER BY y, node) > 1 THEN 1 ELSE 0 END AS new FROM (SELECT doc, node, q + dy / 2 AS y FROM e WHERE tag = 'text')), c AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY y, node) AS line FROM b),
i AS (SELECT doc, 'E2001' AS code FROM e WHERE tag = 'image' UNION ALL SELECT doc, 'E2002' FROM e WHERE tag = 'linearGradient' UNION ALL SELECT doc, 'E2003' FROM (SELECT doc, count(DISTINCT id) FILTER (tag = 'g') AS n FROM e GROUP BY doc), range(2) r(k) WHERE k < 2 - n
UNION ALL SELECT doc, 'E2009' FROM e WHERE tag = 'text' AND id IS NULL UNION ALL SELECT doc, 'E2011' FROM e WHERE tag = 'tspan' AND id IS NULL UNION ALL SELECT doc, 'E2012' FROM e WHERE tag IN ('text', 'tspan') AND l % 4 = 0 UNION ALL SELECT doc, 'E2007' FROM e WHERE tag = 'path' AND CAST(q AS INTEGER) * 2 > 70
UNION ALL SELECT doc, 'E2010' FROM e WHERE tag = 'path' AND (id LIKE 'Txt_%' OR css LIKE '%Glyph%') UNION ALL SELECT doc, 'E2013' FROM e WHERE css = 'dashed' AND dash IS NULL UNION ALL SELECT doc, 'E2016' FROM e WHERE tag = 'text' AND anchor IS NULL UNION ALL SELECT doc, 'W2101' FROM e WHERE tag = 'line' AND dy = 0.3
UNION ALL SELECT doc, 'W2104' FROM e WHERE tag = 'polyline' AND CAST(q AS INTEGER) > 30 UNION ALL SELECT doc, 'E2005' FROM (SELECT doc FROM e WHERE fill IS NOT NULL GROUP BY doc HAVING count(DISTINCT fill) > 6) UNION ALL SELECT doc, 'E2008' FROM (SELECT doc FROM e GROUP BY doc HAVING count(*) FILTER (tag = 'text') = 0)
UNION ALL SELECT doc, 'W2105' FROM e WHERE tag = 'polyline' AND q >= 2 AND dy = 0.3 UNION ALL SELECT doc, 'W2106' FROM (SELECT doc FROM c GROUP BY doc, line HAVING max(y) - min(y) > 0.001) UNION ALL SELECT doc, 'W2103' FROM e WHERE tag = 'text' AND s % 2 > 0
UNION ALL SELECT doc, 'E2015' FROM e WHERE tag = 'text' AND font = 'Arial' UNION ALL SELECT doc, 'E2004' FROM e WHERE tag = 'text' AND font LIKE 'Comic%' UNION ALL SELECT doc, 'E2006' FROM (SELECT DISTINCT doc, width FROM e WHERE width IS NOT NULL AND abs(width - 1) > 0.2 AND abs(width - 2) > 0.2)
UNION ALL SELECT e.doc, CASE WHEN n = 0 THEN 'E2017' ELSE 'E2014' END FROM (SELECT doc, count(*) FILTER (tag = 'text') AS n FROM e GROUP BY doc) e WHERE n < ceil(greatest(least(doc % 5 * 0.7, doc % 5 - 1), 1)) AND doc % 5 > 0)
SELECT code, count(*) AS n, CAST(sum(doc) AS BIGINT) AS docs FROM i GROUP BY code""")
def rule_codes(spark, sf):
    """VAL-02 to VAL-13, VAL-15 to VAL-18, AGG-24, AGG-34, STR-24, STR-25: every rule over elements made of lines, counted by code."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = store.dealt(table(spark, sf, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("node"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("q"), F.round(F.col("l_tax") * 100).cast("int").alias("t"))
    p, s, t, q = (F.col(c) for c in "pstq")
    n = F.col("node").cast("string")
    tag = F.get(F.array(*map(F.lit, ("text", "tspan", "path", "line", "polyline", "g", "image", "linearGradient"))), (p % 8).cast("int"))
    dy = F.when(t % 3 == 0, 0.3).when(t % 3 == 1, 0.0).otherwise(7.0)
    name = F.when(p % 8 == 5, F.when(s % 2 == 0, "g_axes").otherwise("g_text")).when(p % 8 == 2, F.when(s % 2 == 0, F.concat(F.lit("Txt_"), n)).otherwise("curve")).otherwise(F.concat(F.lit("e"), n))
    point = lambda x, y: F.concat(x.cast("string"), F.lit(","), y.cast("string"))
    steps = F.transform(F.sequence(F.lit(0), q.cast("int") - 1), lambda k: point(k * 10, F.when(k == 1, dy).otherwise(F.when(k == 0, 0.0).otherwise(50.0 * k))))
    attrs = {
        "id": F.when(s % 3 > 0, name), "class": F.when(s % 5 == 0, "dashed").when(s % 7 == 0, "a GlyphRun"), "stroke-dasharray": F.when(s % 10 == 0, "4,4"), "fill": F.when(p % 3 > 0, F.format_string("#0000%02x", q.cast("int"))),
        "stroke-width": F.when(p % 2 == 0, (t / 2.0).cast("string")), "stroke": F.when(p % 2 == 0, "none "), "d": F.when(p % 8 == 2, F.repeat(F.lit("M 0 0 L 1 1 "), q.cast("int"))), "points": F.when(p % 8 == 4, F.array_join(steps, " ")),
        "x1": F.when(p % 8 == 3, "0"), "y1": F.when(p % 8 == 3, "10"), "x2": F.when(p % 8 == 3, "90"), "y2": F.when(p % 8 == 3, (10 + dy).cast("string")), "y": F.when(p % 8 == 0, (q + dy / 2).cast("string")),
        "font-family": F.when(s % 4 == 0, "Arial").when(s % 4 == 1, "Arial, sans-serif").when(s % 4 == 2, "Comic Sans MS, serif"), "text-anchor": F.when(p % 5 > 0, "middle"),
    }
    full = F.map_filter(F.create_map(*[v for k, c in attrs.items() for v in (F.lit(k), c)]), lambda k, v: v.isNotNull())
    none = F.lit(None).cast("int")
    e = d.select(F.col("doc").cast("string").alias("doc"), "node", none.alias("parent"), tag.alias("tag"), full.alias("attrs"), F.when(F.col("l") % 4 == 0, "two\nlines").otherwise("one").alias("text"), F.when(s % 2 == 0, F.array(F.lit("g_text"))).otherwise(F.array().cast("array<string>")).alias("groups"), F.create_map().cast("map<string,string>").alias("inherited"))
    contract = {"forbid_elements": ["image"], "forbid_element_prefixes": ["linear"], "required_groups": ["g_axes", "g_text"], "allowed_font_families": ["Arial"], "generic_font_families": ["serif", "sans-serif"], "allowed_stroke_widths": [1.0, 2.0], "text_group": "g_text", "min_dash_segments": 100}
    expected = d.select("doc").distinct().select("doc", (F.col("doc") % 5).alias("texts_detected"))
    return rules.validate_elements(e, contract, expected).groupBy("code").agg(F.count("*").alias("n"), F.sum(F.col("doc").cast("long")).alias("docs"))
