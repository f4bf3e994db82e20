"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import scoring, sequence
from rasterlake.plans.common import day, query, sql_day, table
from rasterlake.sources import store

RUNS = """e AS (SELECT user_id, value > 100 AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, value ORDER BY pos) AS island FROM e),
r AS (SELECT user_id, value, min(pos) AS start, count(*) AS len FROM g GROUP BY user_id, value, island)"""


def _event_runs(spark, sf):
    return sequence.run_length(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 100)


@query(f"WITH {RUNS} SELECT user_id, value, CAST(start AS BIGINT) AS start, len FROM r")
def event_runs(spark, sf):
    """WIN-01."""
    return _event_runs(spark, sf).select("user_id", "value", F.col("start").cast("long").alias("start"), "len")


@query(f"""WITH {RUNS} SELECT user_id, CAST(max(len) AS BIGINT) AS longest, count(*) FILTER (len BETWEEN 2 AND 4) AS in_band, count(*) AS runs,
CAST(min(start) AS BIGINT) AS first_on, CAST(max(start + len - 1) AS BIGINT) AS last_on FROM r WHERE value GROUP BY user_id""")
def event_run_stats(spark, sf):
    """AGG-06, AGG-07, AGG-08."""
    r = _event_runs(spark, sf).filter("value")
    return r.groupBy("user_id").agg(F.max("len").alias("longest"), F.count_if(F.col("len").between(2, 4)).alias("in_band"), F.count("*").alias("runs"), F.min("start").cast("long").alias("first_on"), F.max(F.col("start") + F.col("len") - 1).alias("last_on"))


@query(f"""WITH {RUNS}, d AS (SELECT user_id, len, lead(start) OVER (PARTITION BY user_id ORDER BY start) - start - len AS gap FROM r WHERE value),
s AS (SELECT user_id, count(*) AS n, avg(len) AS dash, stddev_pop(len) AS dash_sd, count(DISTINCT len) AS lengths, avg(gap) FILTER (gap > 0) AS gap, stddev_pop(gap) FILTER (gap > 0) AS gap_sd, count(*) FILTER (gap > 0) AS gaps FROM d GROUP BY user_id),
c AS (SELECT *, CASE WHEN dash > 0 THEN dash_sd / dash ELSE 0 END AS a, CASE WHEN gap > 0 THEN gap_sd / gap ELSE 0 END AS b FROM s)
SELECT user_id, n, round(dash, 6) AS dash, round(coalesce(gap, 0), 6) AS gap, CASE WHEN n < 3 OR gaps = 0 THEN 'unknown' WHEN dash < 4 AND gap > 1.5 * dash THEN 'dotted' WHEN a < 0.3 AND b < 0.3 THEN 'uniform' WHEN lengths <= 3 THEN 'alternating' ELSE 'unknown' END AS pattern,
round(CASE WHEN n < 3 OR gaps = 0 THEN 0 ELSE 0.6 * (1 - least(1.0, (a + b) / 2)) + 0.4 * least(1.0, n / 10) END, 6) AS confidence FROM c""")
def event_dash_pattern(spark, sf):
    """AGG-18, FLT-11, ALG-13."""
    d = sequence.dash_class(sequence.dash_stats(_event_runs(spark, sf).filter("value"), ["user_id"]))
    return d.select("user_id", "n", F.round("dash", 6).alias("dash"), F.round(F.coalesce("gap", F.lit(0.0)), 6).alias("gap"), "pattern", F.round("confidence", 6).alias("confidence"))


def _clusters(gap, centre):
    return f"""SELECT {gap} AS gap, k AS o_custkey, c AS cluster, CAST(min(d) AS BIGINT) AS first, CAST(max(d) AS BIGINT) AS last, count(*) AS n, CAST({centre} AS BIGINT) AS centre FROM
(SELECT k, d, sum(new) OVER (PARTITION BY k ORDER BY d) AS c FROM (SELECT k, d, CASE WHEN d - lag(d) OVER (PARTITION BY k ORDER BY d) > {gap} THEN 1 ELSE 0 END AS new FROM
(SELECT DISTINCT o_custkey AS k, {sql_day("o_orderdate")} AS d FROM orders))) GROUP BY k, c"""


@query(f"SELECT gap, o_custkey, CAST(cluster AS BIGINT) AS cluster, first, last, n, centre FROM ({_clusters(1, 'round_even(avg(d), 0)')} UNION ALL {_clusters(3, 'trunc(avg(d))')})")
def position_clusters(spark, sf):
    """WIN-02 in both presets: gap 1 with rounded centres, gap 3 with truncated ones."""
    d = store.dealt(table(spark, sf, "orders"), "o_custkey").select("o_custkey", day("o_orderdate").alias("d"))
    parts = [sequence.gap_clusters(d, ["o_custkey"], "d", g, r).withColumn("gap", F.lit(g)) for g, r in ((1, "half_even"), (3, "truncate"))]
    return parts[0].unionByName(parts[1]).select("gap", "o_custkey", "cluster", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n", "centre")


DAILY = f"""p AS (SELECT o_orderpriority AS k, {sql_day("o_orderdate")} AS d, count(*) AS v, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"""


def _daily(spark, sf):
    """Daily counts and totals of each priority: the columns of a profile."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), day("o_orderdate").alias("d")).agg(F.count("*").alias("v"), F.sum("o_totalprice").alias("total"))


@query(f"""WITH {DAILY}, t AS (SELECT k, CAST(trunc(quantile_cont(v, 0.1)) AS BIGINT) + 1 AS t FROM p GROUP BY k),
i AS (SELECT p.k, v <= t AS low, row_number() OVER (PARTITION BY p.k ORDER BY d) - 1 AS i FROM p JOIN t ON p.k = t.k),
g AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM i WHERE low)
SELECT k, CAST(min(i) AS BIGINT) AS start, CAST(max(i) + 1 AS BIGINT) AS "end" FROM g GROUP BY k, g HAVING count(*) >= 3""")
def profile_separators(spark, sf):
    """AGG-02, WIN-06: at least three positions in a row at or under the 10th percentile + 1."""
    d = sequence.separators(_daily(spark, sf), ["k"], "d", "v", 3, 1)
    return d.select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {DAILY}, i AS (SELECT k, d, v, row_number() OVER (PARTITION BY k ORDER BY d) AS i, count(*) OVER (PARTITION BY k) AS n, first(v) OVER (PARTITION BY k ORDER BY d) AS a, last(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b,
sum(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM p)
SELECT k, CAST(d AS INTEGER) AS d, round((s + greatest(0, 4 - i) * a + greatest(0, 3 - n + i) * b) / 7, 6) AS smooth FROM i""")
def profile_smooth(spark, sf):
    """WIN-03."""
    return sequence.moving_average(_daily(spark, sf), ["k"], "d", "v", 7).select("k", "d", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {DAILY}, m AS (SELECT min(d) AS a, max(d) AS b FROM p), w AS (SELECT j, CAST(trunc(a + (b - a) * j / 3.0) AS BIGINT) AS c FROM m, (VALUES (1), (2)) AS q(j)),
x AS (SELECT k, j, d, v, row_number() OVER (PARTITION BY k, j ORDER BY v, d) AS r FROM p JOIN w ON d BETWEEN c - 60 AND c + 60)
SELECT k, CAST(j AS INTEGER) AS third, CAST(d AS INTEGER) AS at, v AS least FROM x WHERE r = 1""")
def profile_argmin(spark, sf):
    """WIN-05: the least count within 60 days of each third."""
    d = _daily(spark, sf)
    span = d.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    d = d.crossJoin(F.broadcast(span.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("third"), "a", "b")))
    c = (F.col("a") + (F.col("b") - F.col("a")) * F.col("third") / 3.0).cast("long")
    return sequence.argmin_near(d, ["k", "third"], "d", "v", c - 60, c + 60)


MONTHS = f"""m AS (SELECT date_trunc('month', o_orderdate) AS m, {sql_day("o_orderdate")} AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
i AS (SELECT CAST(year(m) * 12 + month(m) AS BIGINT) AS m, d, v, row_number() OVER (PARTITION BY m ORDER BY d) AS i FROM m)"""


def _months(spark, sf):
    """Daily counts of each month, as one array in order of days."""
    d = table(spark, sf, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("m"), day("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("v"))
    return d.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("s"))


@query(f"""WITH RECURSIVE {MONTHS}, r AS (SELECT m, d, i, v, v AS kept FROM i WHERE i = 1 UNION ALL
SELECT i.m, i.d, i.i, i.v, CASE WHEN abs(i.v - r.kept) <= 1.5 THEN r.kept ELSE i.v END FROM r JOIN i ON i.m = r.m AND i.i = r.i + 1)
SELECT m, CAST(d AS INTEGER) AS d, v, kept FROM r""")
def snap_flat(spark, sf):
    """WIN-04."""
    d = _months(spark, sf).withColumn("f", sequence.snap_flat(F.transform("s", lambda x: x["v"]), 1.5))
    return d.select("m", F.explode(F.arrays_zip("s", "f")).alias("z")).select("m", "z.s.d", "z.s.v", F.col("z.f").alias("kept"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT p_brand AS b, CAST(p_size AS DOUBLE) AS v FROM part), i AS (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY v) AS i FROM s),
r AS (SELECT b, v, i, 0 AS g, v AS c FROM i WHERE i = 1 UNION ALL SELECT i.b, i.v, i.i, CASE WHEN abs(i.v - r.c) > 4 THEN g + 1 ELSE g END, CASE WHEN abs(i.v - r.c) > 4 THEN i.v ELSE (r.c + i.v) / 2 END FROM r JOIN i ON i.b = r.b AND i.i = r.i + 1)
SELECT b AS p_brand, g, CAST(count(*) AS INTEGER) AS n, min(v) AS low, max(v) AS high FROM r GROUP BY b, g""")
def moving_centre_lines(spark, sf):
    """WIN-07: distinct sizes of each brand around a moving centre."""
    d = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size").cast("double"))).alias("v"))
    d = d.select("p_brand", F.explode(F.arrays_zip("v", sequence.moving_centre_groups(F.col("v"), 4).alias("g"))).alias("z"))
    return d.groupBy("p_brand", F.col("z.g").alias("g")).agg(F.count("*").cast("int").alias("n"), F.min("z.v").alias("low"), F.max("z.v").alias("high"))


@query("""WITH c AS (SELECT *, length(text) AS w, sum(length(text) + turn % 3 * 40) OVER (PARTITION BY conv_id ORDER BY turn, role, text) - length(text) AS x FROM conversations),
n AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 30 THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS part FROM n)
SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS n, CAST(min(x) AS BIGINT) AS x, CAST(max(x + w) AS BIGINT) AS x_end FROM g GROUP BY conv_id, part""")
def line_split(spark, sf):
    """WIN-08: turns laid out on a line, split at wide gaps."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    d = table(spark, sf, "conversations").withColumn("w", F.length("text")).withColumn("x", F.sum(F.col("w") + F.col("turn") % 3 * 40).over(w) - F.col("w"))
    d = sequence.split_on_gap(d, ["conv_id"], ["turn", "role", "text"], "x", "w", F.lit(30))
    return d.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x_end"))


@query("""WITH n AS (SELECT p_brand, p_partkey, p_retailprice AS v, CASE WHEN abs(p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) > 3 THEN 1 ELSE 0 END AS new FROM part),
g AS (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY v, p_partkey) AS grp FROM n)
SELECT p_partkey, CAST(grp AS BIGINT) AS grp, round_even(avg(v) OVER (PARTITION BY p_brand, grp) / 5, 0) * 5 AS snapped FROM g""")
def baseline_groups(spark, sf):
    """WIN-09, WIN-10, NRM-03."""
    d = sequence.tolerance_groups(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], "p_retailprice", 3)
    return sequence.snap_groups(d, ["p_brand"], "p_retailprice", 5).select("p_partkey", "grp", "snapped")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR lower(w[i]) <> lower(w[i - 1]))) AS INTEGER) AS n_kept FROM w""")
def token_dedup(spark, sf):
    """WIN-13, STR-01: consecutive repeats in every whole text."""
    from rasterlake.functions import exprs as X

    d = table(spark, sf, "documents").select("doc_id", F.filter(F.split(X.collapse(F.col("text")), " "), lambda t: t != "").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_tokens"), F.size(sequence.drop_repeats(F.col("w"))).alias("n_kept"))


@query("""WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, median(value) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, unnest(range(min(h), max(h) + 1)) AS h FROM h GROUP BY user_id),
j AS (SELECT b.user_id, b.h, v FROM b LEFT JOIN h ON h.user_id = b.user_id AND h.h = b.h),
f AS (SELECT user_id, h, v, last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS y0, first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER z AS x1, first_value(v IGNORE NULLS) OVER z AS y1 FROM j
 WINDOW a AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, count(*) AS positions, count(*) FILTER (v IS NULL) AS made, round(avg(coalesce(v, y0 + (y1 - y0) * (h - x0) / (x1 - x0))), 1) AS mean FROM f GROUP BY user_id""")
def centerline(spark, sf):
    """AGG-11, WIN-16: hourly medians of each user, hours without events interpolated."""
    hour = F.unix_date(F.to_date("ts")).cast("long") * 24 + F.hour("ts")  # unix_timestamp() cuts parts of a second towards 1970
    h = store.dealt(table(spark, sf, "events"), "user_id").groupBy("user_id", hour.alias("h")).agg(F.median("value").alias("v"))
    d = sequence.interpolate(h, ["user_id"], "h", "v")
    d = sequence.mean_in_order(d, ["user_id"], "h", "v", F.count("*").alias("positions"), F.count_if("made").alias("made"))
    return d.withColumn("mean", X.round_product(F.col("mean"), 1))


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS m FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(m, 'Infinity'::DOUBLE), o_orderdate DESC, o_orderkey) AS r FROM t)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE r = 1""")
def best_candidate(spark, sf):
    """SRT-02, SRT-03: each customer's best order, a missing metric last, later dates first."""
    d = table(spark, sf, "orders").withColumn("m", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return scoring.best_candidate(d, ["o_custkey"], [scoring.or_infinite("m"), -F.unix_timestamp("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("""WITH j AS (SELECT c_mktsegment, o_orderkey, o_totalprice, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM j)
SELECT c_mktsegment, o_orderkey, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM r WHERE rank <= 40""")
def top_n_then_restore(spark, sf):
    """SRT-04 to SRT-07: the 40 dearest orders of each segment, numbered in date order again."""
    from pyspark.sql import Window

    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    d = scoring.top_n(j, ["c_mktsegment"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 40)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("o_orderdate", "o_orderkey"))).select("c_mktsegment", "o_orderkey", "rank", "place")
