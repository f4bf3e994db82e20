"""Queries of the spatial, raster, curve and rendering operators.

Vectors stand for images: 64 neighbouring vectors of 64 components are one image of 64 x 64 pixels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import curves, raster, render, sequence, spatial
from rasterlake.plans.common import day, query, sql_day, table
from rasterlake.plans.drawings import components_sql

PIXELS = "p AS (SELECT vec_id // 64 AS image, vec_id % 64 AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _pixels(spark, sf):
    e = table(spark, sf, "embeddings")
    d = raster.pixels_of_matrix(e.withColumn("y", F.col("vec_id") % 64).withColumn("d", F.transform("embedding", lambda v: v.cast("double"))), F.floor(F.col("vec_id") / 64), "y", "d")
    return d.withColumn("x", F.col("x").cast("long"))


@query(f"""WITH {PIXELS}, d AS (SELECT *, abs(lead(v) OVER (PARTITION BY image, y ORDER BY x) - v) AS d FROM p)
SELECT image, round(avg((v > 0)::INT), 6) AS ink, round(var_pop(v), 6) AS variance, round(coalesce(avg((d > 0.2)::INT), 0), 6) AS edges FROM d GROUP BY image""")
def matrix_features(spark, sf):
    """AGG-03: share of positive values, variance and share of steps; FLT-12's inputs."""
    d = raster.features(_pixels(spark, sf), "v", F.col("v") > 0, 0.2)
    return d.select("image", *[F.round(c, 6).alias(c) for c in ("ink", "variance", "edges")])


@query(f"""WITH {PIXELS}, i AS (SELECT image, y, x, v > 0 AS ink, x - row_number() OVER (PARTITION BY image, y, v > 0 ORDER BY x) AS g FROM p),
r AS (SELECT image, y, min(x) AS s, count(*) AS n FROM i WHERE ink GROUP BY image, y, g)
SELECT image, y, max(n) AS longest, CAST(sum(n) AS BIGINT) AS total, count(*) AS runs, min(s) AS first, max(s + n - 1) AS last FROM r GROUP BY image, y""")
def matrix_runs(spark, sf):
    """AGG-06, AGG-08, AGG-09, WIN-01."""
    d = raster.longest_runs(_pixels(spark, sf), F.col("v") > 0, "y", "x")
    return d.select("image", "y", "longest", "total", "runs", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""WITH {PIXELS}, s AS (SELECT image, x, sum((v > 0.05)::INT) AS v FROM p GROUP BY image, x), t AS (SELECT image, CAST(trunc(quantile_cont(v, 0.1)) AS BIGINT) + 2 AS t FROM s GROUP BY image),
i AS (SELECT s.image, x, v <= t AS low FROM s JOIN t ON s.image = t.image), g AS (SELECT image, x, x - row_number() OVER (PARTITION BY image ORDER BY x) AS g FROM i WHERE low)
SELECT image, min(x) AS start, max(x) + 1 AS "end" FROM g GROUP BY image, g HAVING count(*) >= 2""")
def matrix_projection(spark, sf):
    """AGG-02, WIN-06: empty stretches of column sums."""
    s = raster.profile(_pixels(spark, sf), "x", (F.col("v") > 0.05).cast("int"))
    d = sequence.separators(s, ["image"], "x", "v", 2)
    return d.select("image", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH c AS (SELECT vec_id // 64 AS image, CAST(round_even(greatest(0, least(255, (embedding[1] + 1) * 127.5)), 0) AS INTEGER) AS r, CAST(round_even(greatest(0, least(255, (embedding[2] + 1) * 127.5)), 0) AS INTEGER) AS g, CAST(round_even(greatest(0, least(255, (embedding[3] + 1) * 127.5)), 0) AS INTEGER) AS b FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)),
h AS (SELECT *, greatest(r, g, b) AS t, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM c),
u AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = b THEN 60 * ((r - g) / d + 4) WHEN t = g THEN 60 * ((b - r) / d + 2) ELSE 60 * (CASE WHEN (g - b) / d < 0 THEN (g - b) / d + 6 ELSE (g - b) / d END) END AS hue FROM h)
SELECT image, CAST(floor(hue / 10) AS BIGINT) AS bin, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b, count(*) FILTER (least(abs(hue - 350), 360 - abs(hue - 350)) <= 20) AS reds, CAST(sum(CASE WHEN t > 0 AND d / t > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS saturated FROM u GROUP BY image, bin""")
def matrix_hsv(spark, sf):
    """PRJ-04, PRJ-05, PRJ-06, AGG-10, AGG-12: three components as colour."""
    c = lambda i: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("embedding")[i].cast("double") + 1) * 127.5))).cast("int")
    d = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image"), c(0).alias("r"), c(1).alias("g"), c(2).alias("b"))
    rgb = [F.col(k) for k in "rgb"]
    d = d.withColumn("hue", X.hue(*rgb)).withColumn("s", X.saturation(*rgb))
    return d.groupBy("image", F.floor(F.col("hue") / 10).alias("bin")).agg(F.count("*").alias("n"), *[F.median(k).alias(k) for k in "rgb"], F.count_if(X.hue_distance(F.col("hue"), F.lit(350)) <= 20).alias("reds"), F.count_if(F.col("s") > 0.3).alias("saturated"))


_BOX = "OVER (PARTITION BY image, {a} ORDER BY {b} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_STEPS = ", ".join(f"m{i + 1} AS (SELECT image, x, y, {f}(i) {_BOX.format(a=a, b=b)} AS i FROM m{i})" for i, (f, a, b) in enumerate((("max", "y", "x"), ("max", "x", "y"), ("min", "y", "x"), ("min", "x", "y"))))


@query(f"WITH {PIXELS}, m0 AS (SELECT image, x, y, (v > 0.1)::INT AS i FROM p), {_STEPS} SELECT image, y, CAST(sum(i) AS BIGINT) AS ink, CAST(sum(i * x) AS BIGINT) AS moment FROM m4 GROUP BY image, y")
def matrix_morph(spark, sf):
    """ALG-03: closing by a 3 x 3 square."""
    d = _pixels(spark, sf).withColumn("i", (F.col("v") > 0.1).cast("int"))
    return raster.close(d, "i").groupBy("image", "y").agg(F.sum("i").alias("ink"), F.sum(F.col("i") * F.col("x")).alias("moment"))


@query(f"""WITH {PIXELS}, a AS (SELECT *, sum(v) OVER w AS s, count(v) OVER w AS n FROM p WINDOW w AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, sum(s) OVER w / sum(n) OVER w AS mean FROM a WINDOW w AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT image, y, round(sum(mean), 4) AS mean, count(*) FILTER (v > mean + 0.05) AS above FROM b GROUP BY image, y""")
def matrix_local_mean(spark, sf):
    """ALG-02, PRJ-11: adaptive threshold by a 5 x 5 box."""
    d = raster.local_mean(_pixels(spark, sf), "v", 5)
    return d.groupBy("image", "y").agg(F.round(F.sum("mean"), 4).alias("mean"), F.count_if(F.col("v") > F.col("mean") + 0.05).alias("above"))


@query(f"""WITH RECURSIVE {PIXELS}, ink AS (SELECT image, y, x FROM p WHERE v > 0.1), {components_sql('ink')}, c AS (SELECT * FROM parts WHERE area >= 3)
SELECT image, row_number() OVER (PARTITION BY image ORDER BY root) - 1 AS component, x, y, width, height, CAST(area AS BIGINT) AS area FROM c""")
def matrix_components(spark, sf):
    """ALG-01, SET-10: components of at least three pixels, numbered by their first run."""
    d = _pixels(spark, sf).withColumn("ink", (F.col("v") > 0.1).cast("int"))
    return raster.components(d, "ink", 3)


@query(f"""WITH {PIXELS}, q AS (SELECT a.image, a.v, b.v AS w FROM p a JOIN p b ON a.image + 1 = b.image AND a.x = b.x AND a.y = b.y),
m AS (SELECT image, sqrt(avg((v - w) * (v - w))) AS rmse, avg((abs(v - w) > 0.2)::INT) AS bad, sqrt(avg((v + w) * (v + w))) AS rmse_i, avg((abs(v + w) > 0.2)::INT) AS bad_i, avg(w) AS mean FROM q GROUP BY image)
SELECT image, round(CASE WHEN mean < 0 AND (rmse_i < rmse OR rmse_i = rmse AND bad_i < bad) THEN rmse_i ELSE rmse END, 6) AS rmse, round(CASE WHEN mean < 0 AND (rmse_i < rmse OR rmse_i = rmse AND bad_i < bad) THEN bad_i ELSE bad END, 6) AS bad FROM m""")
def matrix_diff(spark, sf):
    """JON-16, AGG-25, AGG-26, GAT-02: each image against the next, or its inversion where that is darker and closer."""
    p = _pixels(spark, sf)
    nxt = p.withColumn("image", F.col("image") - 1)
    keys = ["image", "y", "x"]
    plain = raster.diff(p, nxt, keys, ["v"], 0.2, 1.0)
    inverse = raster.diff(p, nxt.withColumn("v", -F.col("v")), keys, ["v"], 0.2, 1.0).select("image", F.struct("rmse", "bad").alias("i"))
    dark = nxt.groupBy("image").agg(F.avg("v").alias("mean"))
    d = plain.join(inverse, "image").join(dark, "image")
    best = F.when((F.col("mean") < 0) & (F.col("i") < F.struct("rmse", "bad")), F.col("i")).otherwise(F.struct("rmse", "bad"))
    return d.select("image", F.round(best["rmse"], 6).alias("rmse"), F.round(best["bad"], 6).alias("bad"))


@query()
def color_merge(spark, sf):
    """AGG-15: frequent colours of each image."""
    c = lambda i: (F.floor((F.col("embedding")[i].cast("double") + 1) * 4) * 32).cast("int")
    d = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("image"), c(0).alias("r"), c(1).alias("g"), c(2).alias("b")).agg(F.count("*").alias("n"))
    return raster.merge_colors(d, "image", 40.0, 5)


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS w, l_linenumber + 1.0 AS h FROM lineitem)
SELECT a.l_orderkey, a.n AS n1, b.n AS n2, round(least(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + sqrt((a.x + a.w - b.x - b.w) ** 2 + (a.y + a.h - b.y - b.h) ** 2), sqrt((a.x - b.x - b.w) ** 2 + (a.y - b.y - b.h) ** 2) + sqrt((a.x + a.w - b.x) ** 2 + (a.y + a.h - b.y) ** 2)), 4) AS distance,
round(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h), 4) AS overlap FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.n < b.n""")
def pair_distances(spark, sf):
    """PRJ-20 to PRJ-23: lines of one order as segments and boxes, pair by pair."""
    a = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("w"), (F.col("l_linenumber") + 1.0).alias("h"))
    j = a.alias("a").join(a.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.n") < F.col("b.n")))
    box = lambda t: [F.col(f"{t}.{c}") for c in "xywh"]
    seg = lambda t: [F.col(f"{t}.x"), F.col(f"{t}.y"), F.col(f"{t}.x") + F.col(f"{t}.w"), F.col(f"{t}.y") + F.col(f"{t}.h")]
    return j.select("a.l_orderkey", F.col("a.n").alias("n1"), F.col("b.n").alias("n2"), F.round(X.line_distance(seg("a"), seg("b")), 4).alias("distance"), F.round(X.overlap_ratio(box("a"), box("b")), 4).alias("overlap"))


@query("""WITH b AS (SELECT n_nationkey, n_name, -1000 + 400.0 * n_nationkey AS x, 500.0 AS w, n_nationkey % 5 * 30.0 AS y, 60.0 AS h FROM nation),
j AS (SELECT c_custkey, n_nationkey, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY n_nationkey DESC) AS r FROM customer JOIN b ON c_acctbal BETWEEN x - 5 AND x + w + 5 AND c_custkey % 150 BETWEEN y - 5 AND y + h + 5)
SELECT c_custkey, coalesce(n_name, 'annotation') AS box FROM customer LEFT JOIN (SELECT * FROM j WHERE r = 1) USING (c_custkey)""")
def containment_join(spark, sf):
    """JON-01: customers as points in boxes made of nations, the deepest box first, else a default."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", (-1000 + 400.0 * F.col("n_nationkey")).alias("x"), (F.col("n_nationkey") % 5 * 30.0).alias("y"), F.lit(500.0).alias("w"), F.lit(60.0).alias("h"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("px"), (F.col("c_custkey") % 150).cast("double").alias("py"))
    found = spatial.contain(c, n, "px", "py", ("x", "y", "w", "h"), 100.0, 5.0).withColumn("deep", -F.col("n_nationkey"))
    first = spatial.first_match(found, ["c_custkey"], ["deep"], ["n_name"])
    return c.join(first, "c_custkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("annotation")).alias("box"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k, floor(avg(c_acctbal)) AS c FROM customer GROUP BY c_nationkey, c_mktsegment), s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL),
r AS (SELECT s_suppkey, c.c, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c.c), c.c) AS r FROM s JOIN c ON c.k = s_nationkey) SELECT s_suppkey, c AS centre FROM r WHERE r = 1""")
def nearest_centre(spark, sf):
    """JON-11, NRM-04: each supplier's nearest segment mean in its nation, without pairing them all."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg(F.floor(F.avg("c_acctbal")).cast("double").alias("c")).select("k", "c").distinct()
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal").filter("s_acctbal IS NOT NULL")
    return spatial.nearest(s, ["k"], "s_acctbal", c, "c").filter("centre IS NOT NULL").select("s_suppkey", "centre")


def _segments(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount") * 100, "l_quantity", F.col("l_discount") * 100 + F.col("l_linenumber") % 3, F.col("l_quantity") + F.col("l_linenumber") % 4 * 5).toDF("l_orderkey", "l_linenumber", "x1", "y1", "x2", "y2")


#: Lines of orders, each an array of one, in order: folding arrays keeps what no kept one clashes with.
_FOLD = """s AS (SELECT l_orderkey, l_linenumber AS n, l_discount * 100 AS x1, l_quantity AS y1, l_discount * 100 + l_linenumber % 3 AS x2, l_quantity + l_linenumber % 4 * 5 AS y2, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS i FROM lineitem),
l AS (SELECT l_orderkey, list([{{'n': n, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY i) AS c FROM s GROUP BY l_orderkey),
k AS (SELECT l_orderkey, list_reduce(c, lambda a, b: CASE WHEN len(list_filter(a, lambda e: {clash})) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l), f AS (SELECT l_orderkey, unnest(kept) AS r FROM k)"""
_TIES = "l_discount, l_quantity"


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS x1, l_quantity AS y1, l_discount * 100 + l_linenumber % 3 AS x2, l_quantity + l_linenumber % 4 * 5 AS y2 FROM lineitem),
o AS (SELECT *, 'vertical' AS o FROM s WHERE abs(x1 - x2) <= 2 UNION ALL SELECT *, 'horizontal' FROM s WHERE abs(y1 - y2) <= 2 UNION ALL SELECT *, 'other' FROM s WHERE abs(x1 - x2) > 2 AND abs(y1 - y2) > 2),
t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, o ORDER BY l_linenumber, x1, x2, y1, y2) AS i, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS len FROM o),
p AS (SELECT a.l_orderkey, a.o, a.i, b.i AS j FROM t a JOIN t b ON b.l_orderkey = a.l_orderkey AND b.o = a.o AND b.i > a.i AND least(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) + sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2), sqrt((a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2) + sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2)) <= 5),
n AS (SELECT t.l_orderkey, t.o, t.i, coalesce(list(p.j) FILTER (p.j IS NOT NULL), []) AS near FROM t LEFT JOIN p ON p.l_orderkey = t.l_orderkey AND p.o = t.o AND p.i = t.i GROUP BY ALL),
f AS (SELECT l_orderkey, o, 1::BIGINT AS i, near AS used, list_concat([1::BIGINT], near) AS grp FROM n WHERE i = 1 UNION ALL
  SELECT n.l_orderkey, n.o, n.i, CASE WHEN list_contains(used, n.i) THEN used ELSE list_concat(used, near) END, CASE WHEN list_contains(used, n.i) THEN NULL ELSE list_concat([n.i], list_filter(near, lambda x: NOT list_contains(used, x))) END FROM f JOIN n ON n.l_orderkey = f.l_orderkey AND n.o = f.o AND n.i = f.i + 1),
g AS (SELECT l_orderkey, o, i AS seed, unnest(grp) AS i FROM f WHERE grp IS NOT NULL), r AS (SELECT t.*, row_number() OVER (PARTITION BY g.l_orderkey, g.o, seed ORDER BY len DESC, t.i) AS r FROM g JOIN t ON t.l_orderkey = g.l_orderkey AND t.o = g.o AND t.i = g.i)
SELECT l_orderkey, l_linenumber, x1, y1, x2, y2, o AS orientation FROM r WHERE r = 1""")
def line_dedup(spark, sf):
    """SET-01, PRJ-21."""
    return spatial.line_dedup(_segments(spark, sf), ["l_orderkey"], ["x1", "y1", "x2", "y2"], "l_linenumber")


@query("WITH " + _FOLD.format(order=f"-(((l_discount * 100 + l_linenumber % 3) - l_discount * 100 + 5) * ((l_quantity + l_linenumber % 4 * 5) - l_quantity + 5)), l_linenumber, {_TIES}", clash="greatest(0, least(e.x2 + 5, b[1].x2 + 5) - greatest(e.x1, b[1].x1)) * greatest(0, least(e.y2 + 5, b[1].y2 + 5) - greatest(e.y1, b[1].y1)) / least((e.x2 - e.x1 + 5) * (e.y2 - e.y1 + 5), (b[1].x2 - b[1].x1 + 5) * (b[1].y2 - b[1].y1 + 5)) >= 0.8") + " SELECT l_orderkey, r.n AS l_linenumber, r.x1 AS x, r.y1 AS y, r.x2 - r.x1 + 5 AS w, r.y2 - r.y1 + 5 AS h FROM f")
def rect_nms(spark, sf):
    """SET-02, PRJ-22."""
    d = _segments(spark, sf).select("l_orderkey", "l_linenumber", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1") + 5).alias("w"), (F.col("y2") - F.col("y1") + 5).alias("h"))
    return spatial.rect_nms(d, ["l_orderkey"], ["x", "y", "w", "h"], "l_linenumber")


@query("WITH " + _FOLD.format(order=f"l_linenumber, {_TIES}", clash="sqrt((e.x1 - b[1].x1) ** 2 + (e.y1 - b[1].y1) ** 2) <= 5 AND abs(e.n % 3 - b[1].n % 3) <= 2") + " SELECT l_orderkey, r.n AS l_linenumber, r.x1 AS x, r.y1 AS y, (r.n % 3 + 1)::DOUBLE AS r FROM f")
def circle_dedup(spark, sf):
    """SET-03."""
    d = _segments(spark, sf).select("l_orderkey", "l_linenumber", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("l_linenumber") % 3 + 1.0).alias("r"))
    return spatial.circle_dedup(d, ["l_orderkey"], ["x", "y", "r"], "l_linenumber")


@query("""SELECT 'child' AS kind, n_nationkey::BIGINT AS node, n_regionkey::BIGINT AS ancestor, 1 AS depth FROM nation UNION ALL SELECT 'leaf', c_custkey, c_nationkey, 1 FROM customer UNION ALL SELECT 'leaf', c_custkey, n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def ancestor_groups(spark, sf):
    """JON-12: a tree of regions, nations and customers, with every ancestor of each node."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    a = spatial.ancestors(r.union(n).union(c), "id", "up", 3)
    number = lambda k: F.substring(k, 2, 20).cast("long")
    return a.select(F.when(F.startswith("node", F.lit("n")), "child").otherwise("leaf").alias("kind"), number(F.col("node")).alias("node"), number(F.col("ancestor")).alias("ancestor"), "depth")


TOTALS = f"t AS (SELECT o_orderpriority AS k, {sql_day('o_orderdate')} AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)"


def _totals(spark, sf):
    """Daily totals of each priority."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), day("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query()
def rdp_simplify(spark, sf):
    """ALG-05, ALG-06."""
    c = curves.simplify(curves.as_curve(_totals(spark, sf), ["k"], "d", "d", "v"), 60, 10, 5000.0)
    return c.select("k", F.size("xy").alias("n"), F.element_at("xy", -1)["x"].alias("last"))


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, floor(o_totalprice / 20000) AS v FROM orders), n AS (SELECT k, i, i * 1.0::DOUBLE AS x, v, lead(v) OVER (PARTITION BY k ORDER BY i) AS z FROM t),
r AS (SELECT k, i, x AS ax, v AS ay, 1 AS kept FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, CASE WHEN z IS NOT NULL AND abs((n.x - ax) * (z - ay) - (n.v - ay) * (n.x + 1 - ax)) <= 0.5 THEN ax ELSE n.x END, CASE WHEN z IS NOT NULL AND abs((n.x - ax) * (z - ay) - (n.v - ay) * (n.x + 1 - ax)) <= 0.5 THEN ay ELSE n.v END,
 kept + CASE WHEN z IS NOT NULL AND abs((n.x - ax) * (z - ay) - (n.v - ay) * (n.x + 1 - ax)) <= 0.5 THEN 0 ELSE 1 END FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
SELECT k AS o_custkey, CAST(max(i) AS INTEGER) AS n, max(kept) AS kept FROM r GROUP BY k""")
def collinear(spark, sf):
    """WIN-15: each customer's orders as a stepped curve."""
    from pyspark.sql import Window

    d = table(spark, sf, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).withColumn("v", F.floor(F.col("o_totalprice") / 20000))
    c = curves.as_curve(d, ["o_custkey"], "i", "i", "v")
    return c.select("o_custkey", F.size("xy").alias("n"), F.size(curves.collinear(F.col("xy"), 0.5)).alias("kept"))


@query()
def bezier_fit(spark, sf):
    """ALG-07, ALG-08, STR-26: daily totals of each month and priority as cubic paths."""
    d = _totals(spark, sf).withColumn("m", F.floor(F.col("d") / 30))
    c = curves.as_curve(d, ["k", "m"], "d", "d", "v")
    return curves.bezier_paths(c.select("k", "m", F.transform("xy", lambda p: F.struct((p["x"] % 30).alias("x"), (p["y"] / 10000).alias("y"))).alias("xy")), ["k", "m"], 2.0)


@query(f"""WITH {TOTALS}, w AS (SELECT k, d, v, lag(d) OVER o AS d0, lag(v) OVER o AS v0, lead(d) OVER o AS d2, lead(v) OVER o AS v2, lead(d, 2) OVER o AS d3, lead(v, 2) OVER o AS v3 FROM t WINDOW o AS (PARTITION BY k ORDER BY d))
SELECT k, CAST(d AS INTEGER) AS d, round(d + (d2 - coalesce(d0, d)) / 6, 4) AS ax, round(v + (v2 - coalesce(v0, v)) / 6, 4) AS ay, round(d2 - (coalesce(d3, d2) - d) / 6, 4) AS bx, round(v2 - (coalesce(v3, v2) - v) / 6, 4) AS b_y FROM w WHERE d2 IS NOT NULL""")
def catmull_rom(spark, sf):
    """ALG-09."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("d")
    p = [tuple(F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("d", "v")), (F.col("d"), F.col("v")), tuple(F.lead(c).over(w) for c in ("d", "v")), tuple(F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w)) for c in ("d", "v"))]
    c = render.control_points(*p)
    return _totals(spark, sf).select("k", "d", *[F.round(v, 4).alias(n) for v, n in zip(c, ("ax", "ay", "bx", "b_y"), strict=True)], F.lead("d").over(w).alias("nxt")).filter("nxt IS NOT NULL").drop("nxt")


@query(f"""WITH {TOTALS}, m AS (SELECT k, min(d) AS d0, max(d) AS d1, min(v) AS v0, max(v) AS v1 FROM t GROUP BY k)
SELECT t.k, CAST(t.d AS INTEGER) AS d, round_even(80 + (t.d - d0) / (d1 - d0) * 640, 4) AS x, round_even(40 + (400 - (t.v - v0) / (v1 - v0) * 400), 4) AS y FROM t JOIN m ON m.k = t.k""")
def plot_mapping(spark, sf):
    """PRJ-16, AGG-33: axis ranges from the data, y upwards."""
    t = _totals(spark, sf)
    m = t.groupBy("k").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    j = t.join(m, "k")
    return j.select("k", "d", X.to_plot(F.col("d"), F.col("d0"), F.col("d1"), 80.0, 640.0).alias("x"), X.to_plot(F.col("v"), F.col("v0"), F.col("v1"), 40.0, 400.0, True).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS one, round_even(l_extendedprice / 5, 0) * 5 AS five, greatest(1000, least(50000, l_extendedprice)) AS clamped, CASE WHEN abs(l_quantity - 50) <= 2 THEN 50 ELSE l_quantity END AS edge FROM lineitem""")
def snap_round(spark, sf):
    """PRJ-14, PRJ-15."""
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.snap(p, 1).alias("one"), X.snap(p, 5).alias("five"), X.clamp(p, 1000.0, 50000.0).alias("clamped"), X.snap_to_edge(F.col("l_quantity"), 50.0, 2.0).alias("edge"))


@query("""WITH s AS (SELECT p_partkey, 600 + p_size * 20 AS w, 400 + CAST(p_retailprice AS INTEGER) % 300 AS h FROM part),
m AS (SELECT *, greatest(CAST(trunc(w * 0.06) AS INTEGER), 36) AS mx, greatest(CAST(trunc(h * 0.06) AS INTEGER), 28) AS my, greatest(CAST(trunc(h * 0.12) AS INTEGER), 70) AS hd, greatest(CAST(trunc(w * 0.04) AS INTEGER), 18) AS gx, greatest(CAST(trunc(h * 0.05) AS INTEGER), 20) AS gy FROM s),
c AS (SELECT *, (w - 2 * mx - gx * 2) / 3 AS cw, (h - my - hd - gy) / 2 AS ch, unnest(range(6)) AS i FROM m)
SELECT p_partkey, CAST(i // 3 AS INTEGER) AS row, CAST(i % 3 AS INTEGER) AS col, round_even(mx + i % 3 * (cw + gx), 4) AS x, round_even(hd + i // 3 * (ch + gy), 4) AS y, round_even(cw, 4) AS w, round_even(ch, 4) AS h FROM c""")
def roi_layout(spark, sf):
    """EXT-07: a 2 x 3 grid on canvases sized by parts."""
    s = table(spark, sf, "part").select("p_partkey", (600 + F.col("p_size") * 20).alias("cw"), (400 + F.bround("p_retailprice").cast("int") % 300).alias("ch"))
    return render.grid_cells(s, "cw", "ch", 2, 3).drop("cw", "ch")


@query("""WITH e AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'g_text' ELSE 'g_curves' END AS layer, CASE WHEN n_nationkey % 2 = 0 THEN '<text id="t' || n_nationkey || '" x="' || n_nationkey * 10 || '">' || n_name || '</text>' ELSE '<line id="l' || n_nationkey || '" x1="' || n_nationkey * 10 || '"/>' END AS body FROM nation)
SELECT n_regionkey, '<svg xmlns="http://www.w3.org/2000/svg" width="640" height="480"><g id="figure_root"><g id="g_axes"></g><g id="g_curves">' || coalesce(string_agg(body, '' ORDER BY n_nationkey) FILTER (layer = 'g_curves'), '') || '</g><g id="g_annotations"></g><g id="g_text">' || coalesce(string_agg(body, '' ORDER BY n_nationkey) FILTER (layer = 'g_text'), '') || '</g><g id="g_markers"></g></g></svg>' AS svg FROM e GROUP BY n_regionkey""")
def svg_elements(spark, sf):
    """RND-01, RND-02, RND-04, SRT-06, SRC-17."""
    k = F.col("n_nationkey")
    even = k % 2 == 0
    body = F.when(even, render.element("text", {"id": F.concat(F.lit("t"), k), "x": k * 10}, F.col("n_name"))).otherwise(render.element("line", {"id": F.concat(F.lit("l"), k), "x1": k * 10}))
    d = table(spark, sf, "nation").withColumn("layer", F.when(even, "g_text").otherwise("g_curves")).withColumn("body", body)
    return render.documents(d, "n_regionkey", "layer", ["n_nationkey"], "body", F.lit(640), F.lit(480))
