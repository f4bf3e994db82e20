"""Results on bounds, larger tables and tables that are folders."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterlake import plans
from rasterlake.functions import exprs as X
from rasterlake.operators import candidates, classify, colors, figures, normal, panels, sequence, spatial
from rasterlake.plans import cases
from rasterlake.sources import store

SF = "/root/testdata/sf0.001"


def test_a_text_on_the_edge_of_the_upper_share_is_no_title(spark):
    texts = spark.createDataFrame([(1, 1, 700.0, 84.0, 406.0, 9.0), (1, 2, 700.0, 83.0, 406.0, 9.0), (1, 3, 700.0, 83.0, 405.0, 9.0)], "image long, item long, x double, y double, width double, height double")
    sizes = spark.createDataFrame([(1, 900, 600)], "image long, width int, height int")
    none = spark.createDataFrame([], "image long, panel string, ord int, x double, y double, width double, height double")
    assert {r.item: r.role for r in panels.event_roles(texts, none, sizes).collect()} == {1: "annotation", 2: "title", 3: "annotation"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_streamed_documents_may_be_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got, want = (plans.QUERIES["streamed_decisions"](spark, d).collect() for d in (f"file://{tmp_path}", SF))
    assert want and sorted(got) == sorted(want)


def test_confidence_on_the_bound_is_enough(spark):
    d = spark.sql("SELECT 1 AS image, 4L AS long_v, 0L AS long_h, 1L AS short_v, 9L AS short_h, 167L AS colors, 1400 AS width, 700 AS height, 0.36D AS ink, 0.39D AS saturated, 0.17D AS aligned, CAST(array() AS array<string>) AS tokens")
    r = classify.classify(d, ["image"]).first()
    assert (round(r.confidence, 6), r.decision) == (0.52, "t_3gpp_events_3panel")


def test_properties_of_more_nodes_than_a_recursive_query_may_hold(spark):
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        nodes = spark.range(100).selectExpr("id AS node", "nullif(id - 1, -1) AS parent", "CASE WHEN id IN (0, 70) THEN concat('v', id) WHEN id = 90 THEN '' END AS value")
        got = {r.node: r.value for r in spatial.resolved(nodes, "node", "parent", "value").collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert got == {k: "v70" if k >= 70 else "v0" for k in range(100)}


def test_properties_of_nodes_without_ancestors_and_of_cycles(spark):
    nodes = spark.createDataFrame([(1, 9, None), (2, 1, ""), (3, None, None), (4, 3, "own")], "node long, parent long, value string")
    assert {r.node: r.value for r in spatial.resolved(nodes, "node", "parent", "value").collect()} == {1: None, 2: None, 3: None, 4: "own"}
    cycle = spark.createDataFrame([(1, 2, None), (2, 1, None)], "node long, parent long, value string")
    with pytest.raises(ValueError, match="deeper"):
        spatial.resolved(cycle, "node", "parent", "value", 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_every_figure_are_not_gathered_on_the_driver(spark):
    sizes = spark.range(3).selectExpr("id AS image", "1920 AS width", "1080 AS height")
    architecture = spark.range(3).selectExpr("id AS image", "explode(array('title', 'panel_A_title', 'panel_A_bullets', 'wp_WP1_goal')) AS field", "'a' AS value")
    loop = spark.range(3).selectExpr("id AS image", "explode(array('title', 'agent', 'action')) AS field", "'a' AS value")
    for rows in (figures.architecture(sizes, architecture), figures.agent_loop(sizes, loop)):
        done = cases._documents(rows, sizes)
        assert "BroadcastExchange" not in plan(done) and done.count() == 3
    attempts = spark.range(3).selectExpr("id AS case", "'t' AS template", "1.0D AS score", "CAST(NULL AS string) AS stage", "0L AS errors", "0L AS warnings", "0.1D AS rmse", "0.1D AS bad", "'pass' AS status")
    assert "BroadcastExchange" not in plan(candidates.choose(attempts, spark.range(3).selectExpr("id AS case")))


def test_a_colour_is_parsed_once_for_the_palette(spark):
    d = spark.sql("SELECT concat('#', lpad(hex(id * 7919 % 16777216), 6, '0')) AS c FROM range(500)").select("c", colors.snapped(F.col("c")).alias("s"))
    assert plan(d).lower().count("conv(") <= 6
    rgb = lambda h: [int(h[k : k + 2], 16) for k in (1, 3, 5)]
    for r in d.collect():
        assert r.s == min(colors.PALETTE, key=lambda h: sum((x - y) ** 2 for x, y in zip(rgb(r.c), rgb(h), strict=True)))


def shuffles(df):
    """Numbers of partitions of the plan's shuffles on keys."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(df))]


@pytest.fixture
def few_rows(monkeypatch):
    """A task is to hold about 300 rows."""
    monkeypatch.setattr(store, "ROWS", 300)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, last, least", [("rule_codes", 1, 20), ("rule_report", 1, 20), ("position_clusters", 0, 5), ("dash_arrays", 0, 20), ("panel_issues", 1, 20), ("normal_flows", 0, 20)])
def test_tasks_do_not_grow_with_the_table(spark, few_rows, name, last, least):
    """All shuffles are dealt by rows, but for the last one on a handful of codes."""
    done = plans.QUERIES[name](spark, SF)
    dealt = sorted(shuffles(done))
    assert "BroadcastExchange" not in plan(done)
    assert dealt[last:] and all(n >= least for n in dealt[last:]) and len(dealt[:last]) == last


def test_interpolated_positions_in_proportion(spark):
    """Neighbours are found among the values, not once more for every position between them."""
    series = spark.createDataFrame([(1, 1, None), (1, 3, 2.0), (1, 4, None), (1, 7, 6.0), (1, 9, None), (2, 5, 1.5), (None, 1, 1.0), (None, 3, 2.0), (3, None, 4.0)], "k int, p long, v double")
    got = sorted(((r.k or 0, r.p, r.v, r.made) for r in sequence.interpolate(series, ["k"], "p", "v").collect()))
    want = [(0, p, None, True) for p in (1, 2, 3)] + [(1, 1, None, True), (1, 2, None, True), (1, 3, 2.0, False), (1, 4, 3.0, True), (1, 5, 4.0, True), (1, 6, 5.0, True), (1, 7, 6.0, False), (1, 8, None, True), (1, 9, None, True), (2, 5, 1.5, False)]
    assert got == want
    p = plan(sequence.interpolate(series, ["k"], "p", "v"))
    assert "Join" not in p and "unboundedfollowing" not in p


def test_means_half_way_between_two_roundings_are_the_sqls(spark, tmp_path):
    """Hours are added in their order, and the mean is rounded by its product with 10: each of these users' means lies right beside a half."""
    users = {1: ([0, 2, 8], [103.57, 113.47, 102.49]), 2: ([0, 5, 7, 10], [82.28, 7.04, 113.62, 23.91]), 3: ([0, 4, 8], [154.64, 15.35, 197.54]), 4: ([0, 3, 7], [139.83, 46.59, 12.83])}
    rows = [(k, 1704067200 + 3600 * h, v) for k, (hours, values) in users.items() for h, v in zip(hours, values, strict=True)] + [(None, 1704067200, 1.0), (5, 1704067200, None)]
    events = spark.createDataFrame(rows, "user_id long, s long, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "value")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    order = lambda r: r[0] or 0
    want = sorted(con.execute(plans.SQL["centerline"]).fetchall(), key=order)
    assert [r[3] for r in want] == [None, 107.6, 54.9, 104.7, 59.4, None]
    assert sorted(map(tuple, plans.QUERIES["centerline"](spark, f"file://{tmp_path}").collect()), key=order) == want


def test_hours_before_1970_end_with_their_last_part_of_a_second(spark, tmp_path):
    """13:59:59.75 is in the hour from 13:00 on, before 1970 too."""
    at = ["1950-06-30 10:00:00.25", "1950-06-30 13:59:59.75", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-01-01 00:59:59.999999", "2024-01-01 02:00:00"]
    events = spark.createDataFrame([(k // 2, t, k + 0.25) for k, t in enumerate(at)], "user_id long, t string, value double").select("user_id", F.to_timestamp_ntz("t").alias("ts"), "value")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(plans.SQL["centerline"]).fetchall())
    assert [r[1:3] for r in want] == [(4, 2), (2, 0), (3, 1)]
    assert sorted(map(tuple, plans.QUERIES["centerline"](spark, f"file://{tmp_path}").collect())) == want


def test_sums_do_not_hang_on_the_order_of_rows(spark):
    values = [0.1, 1e16, None, -1e16, 0.3, 0.2]
    rows = [(1, p, v) for p, v in enumerate(values)] + [(2, 0, None)]
    for d in (rows, rows[::-1]):
        got = sequence.mean_in_order(spark.createDataFrame(d, "k int, p int, v double").coalesce(1), ["k"], "p", "v", F.count("*").alias("n")).collect()
        assert sorted(map(tuple, got)) == [(1, 6, (0.1 + 1e16 - 1e16 + 0.3 + 0.2) / 5), (2, 1, None)]
    d = spark.createDataFrame([(1, 104.64999999999999), (2, -0.35), (3, 1.04), (4, 1e308), (5, float("inf")), (6, None)], "k int, x double")
    assert [r[1] for r in sorted(d.select("k", X.round_product(F.col("x"), 1)).collect())] == [104.7, -0.4, 1.0, 1e308, float("inf"), None]


def test_edges_meet_nodes_as_a_join_does(spark):
    """Two nodes of one name give an edge each; an end without a node keeps its point."""
    nodes = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "a", 100.0, 0.0, 10.0, 10.0), (1, "b", 50.0, 50.0, 20.0, 20.0)], "k int, id string, x double, y double, width double, height double")
    edge = "array(named_struct('x', 1D, 'y', 2D), named_struct('x', 31D, 'y', 42D))"
    edges = spark.sql(f"SELECT k, a, b, {edge} AS points, false AS dashed, CAST(NULL AS array<double>) AS dasharray, 2D AS stroke_width FROM VALUES (1, 'a', 'b'), (1, 'gone', NULL), (2, 'a', 'b') t(k, a, b)")
    got = sorted((r.k, r.a, [(p.x, p.y) for p in r.points]) for r in normal.normal_flow(nodes, edges, "k", 5.0)[1].collect())
    assert got == [(1, "a", [(5.0, 5.0), (60.0, 60.0)]), (1, "a", [(105.0, 5.0), (60.0, 60.0)]), (1, "gone", [(0.0, 0.0), (30.0, 40.0)]), (2, "a", [(0.0, 0.0), (30.0, 40.0)])]
