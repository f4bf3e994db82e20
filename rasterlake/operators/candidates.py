"""The candidate loop (ORC-01, ORC-04): several templates a case go through extraction, rendering, validation and a quality gate.

An attempt is a row (case, template, score). Each stage takes the attempts that are still alive; what fails in it becomes a
row of failures (stage, code, message), and an anti join takes it out of the next stage. The winner of a case is the
least composite key over its attempts. Cases, templates and stages are rows and joins; nothing loops over cases.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import batch, classify, convert, extract, figures, packed, panels, render, rules, scoring, templates
from rasterlake.sources import markup, store

#: Codes of a conversion.
CODES = {"E5104": "no candidates", "E5105": "no candidate passed validation", "E5107": "template unknown", "E5108": "no candidate passed the gate", "E5198": "over the time limit", "E5199": "rendering failed"}
#: The contract that rendered figures are held to unless another is given.
CONTRACT = {
    "forbid_elements": ["image"], "required_groups": ["figure_root", *render.LAYERS], "max_colors": 12, "max_path_commands": 400, "max_polyline_points": 400, "require_text": False, "generic_font_families": [],
}


class Figure(NamedTuple):
    """What extraction reads: lines (packed), sizes (image, width, height) and texts (image, item, text, conf, x, y, width, height) of
    the attempts of one template; image is the attempt."""

    lines: DataFrame
    sizes: DataFrame
    texts: DataFrame


class Made(NamedTuple):
    """Element rows (image, layer, o, body) of attempts, and failures (image, code, message) of those without any."""

    rows: DataFrame
    failures: DataFrame | None = None


Builder = Callable[[Figure], Made]


def ranked(features: DataFrame, key: str, top: int, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Attempts (case, template, score, rank) and failures (case, code): the top templates by score of each case (SRT-01, SRT-02), or the
    one that forced (case, template) names, with a score of 0. Without a forced one, a case whose decision is the
    fallback is E5107. features: key and what classify.template_scores() takes."""
    d = features.withColumnRenamed(key, "case")
    scores = classify.template_scores(d).select("case", F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.col(t).cast("double").alias("score")) for t in classify.RULES])).alias("s")).select("case", "s.*")
    named = forced if forced is not None else d.select("case", F.lit(None).cast("string").alias("template")).limit(0)
    unknown = classify.classify(d, ["case"]).filter(F.col("decision") == classify.FALLBACK).select("case").join(named, "case", "left_anti")
    free = scoring.top_n(scores.join(named, "case", "left_anti").join(unknown, "case", "left_anti"), ["case"], [F.desc("score"), F.col("template")], top)
    chosen = named.join(d.select("case"), "case", "left_semi").select("case", "template", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return free.select("case", "template", "score", "rank").unionByName(chosen), unknown.select("case", F.lit("E5107").alias("code"))


def _id(case: str = "case", template: str = "template") -> Column:
    return F.concat_ws("|", F.col(case).cast("string"), F.col(template))


def run(attempts: DataFrame, lines: DataFrame, texts: DataFrame, builders: dict[str, Builder], gates: tuple[float, float, float] | None = (0.75, 0.65, 10.0), contract: dict | None = None, expected_texts: DataFrame | None = None, seconds: float | None = 60) -> DataFrame:
    """One row an attempt: case, template, score, stage and code of its failure (null where every stage ran), errors, warnings, rmse, bad,
    gate ('pass', 'fail:...', 'skipped'), status ('pass' or 'fail') and svg.

    attempts: case, template, score; lines: packed lines with image as the case; texts: image (the case), item, text,
    conf, x, y, width, height. builders: extraction and rendering by template; an attempt of another template fails with E5107. gates:
    largest rmse and share of bad pixels, and tolerance; none leaves the gate out. expected_texts: case and texts_detected."""
    a = render.many(store.saved(attempts.select("case", "template", "score").withColumn("attempt", _id()), "attempts"))
    sizes = render.many(lines.groupBy(F.col("image").alias("case")).agg(F.max("width").alias("width"), F.max("height").alias("height")))
    failed = [a.filter(~F.col("template").isin(*builders)).select("attempt", F.lit("extract").alias("stage"), F.lit("E5107").alias("code"), F.concat(F.lit("no driver for "), "template").alias("message"))]
    failed.append(a.join(sizes, "case", "left_anti").filter(F.col("template").isin(*builders)).select("attempt", F.lit("extract").alias("stage"), F.lit("E1000").alias("code"), F.lit("no figure").alias("message")))
    live = render.many(a.join(reduce(DataFrame.unionByName, failed), "attempt", "left_anti"))
    own = lambda df, mine, key="image": df.withColumnRenamed(key, "case").join(render.many(mine.select("case", "attempt")), "case").drop("case").withColumnRenamed("attempt", "image")
    # extract and render, template by template: there are as many as builders, whatever the number of cases
    made = []
    for name in sorted(r.template for r in live.select("template").distinct().collect()):
        mine = live.filter(F.col("template") == name)
        built = builders[name](Figure(own(lines, mine), own(sizes, mine, "case"), own(texts, mine)))
        made.append(built.rows.select(F.col("image").cast("string").alias("attempt"), "layer", "o", "body"))
        if built.failures is not None:
            failed.append(built.failures.select(F.col("image").cast("string").alias("attempt"), F.lit("extract").alias("stage"), "code", "message"))
    failures = render.many(store.saved(reduce(DataFrame.unionByName, failed).groupBy("attempt").agg(F.min(F.struct("stage", "code", "message")).alias("f")).select("attempt", "f.*"), "failures"))
    none = a.select("attempt", F.lit("").alias("layer"), F.lit(0.0).alias("o"), F.lit("").alias("body")).limit(0)
    rows = render.many(store.saved(reduce(DataFrame.unionByName, [*made, none]).join(failures, "attempt", "left_anti"), "elements"))
    live = render.many(live.join(failures, "attempt", "left_anti"))
    placed = rows.join(live.join(sizes, "case").select("attempt", "width", "height"), "attempt")
    svg = render.many(store.saved(render.documents(placed, "attempt", "layer", ["o"], "body", F.col("width"), F.col("height")), "svg"))
    failures = failures.unionByName(live.join(svg, "attempt", "left_anti").select("attempt", F.lit("render").alias("stage"), F.lit("E5199").alias("code"), F.lit("nothing was drawn").alias("message")))
    # validate
    elements = render.many(store.saved(markup.elements(svg, "attempt", "svg"), "parsed"))
    expected = None if expected_texts is None else expected_texts.join(a, "case").select(F.col("attempt").alias("doc"), "texts_detected")
    report = rules.report(elements, rules.validate_elements(elements, CONTRACT | (contract or {}), expected)).select(F.col("doc").alias("attempt"), "errors", "warnings")
    out = a.join(failures, "attempt", "left").join(svg, "attempt", "left").join(render.many(report), "attempt", "left")
    # gate
    if gates is None:
        out = out.withColumns({"rmse": F.lit(None).cast("double"), "bad": F.lit(None).cast("double"), "gate": F.lit("skipped")})
    else:
        drawn = render.many(store.saved(convert.raster_lines(svg, "attempt", "svg", seconds), "rasters"))
        broken = drawn.filter("error IS NOT NULL").select(F.col("image").alias("attempt"), F.col("error").alias("raster_error"))
        metrics = packed.diff(drawn.filter("error IS NULL").drop("error"), own(lines, live), gates[2]).withColumnRenamed("image", "attempt")
        late = F.when(F.startswith("raster_error", F.lit("TimedOut")), "E5198").otherwise("E3001")
        out = out.join(render.many(metrics), "attempt", "left").join(broken, "attempt", "left").withColumn("gate", scoring.gate(F.col("rmse"), F.col("bad"), gates[0], gates[1]))
        hurt = F.col("raster_error").isNotNull()
        out = out.withColumns({"stage": F.when(hurt, "gate").otherwise(F.col("stage")), "code": F.when(hurt, late).otherwise(F.col("code")), "message": F.coalesce("raster_error", "message")})
    good = F.col("stage").isNull() & (F.col("errors") == 0) & (F.lit(gates is None) | (F.col("gate") == "pass"))
    return out.withColumn("status", F.when(good, "pass").otherwise("fail")).select("case", "template", "score", "stage", "code", "message", "errors", "warnings", "rmse", "bad", "gate", "status", "svg")


def choose(attempts: DataFrame, cases: DataFrame, unknown: DataFrame | None = None, gated: bool = True, allow_failed_gate: bool = False) -> DataFrame:
    """One row a case: case, template, status, code, rmse, bad, warnings, score of the winner (SRT-03). Of attempts that passed, else of those
    without validation errors, the least by (rmse, bad, warnings, -score, template), without a gate by (warnings, rmse, bad, ...).
    E5104: a case without attempts; E5105: none passed validation; E5107: in unknown (case); E5108: none passed the gate, in which case
    there is a template only with allow_failed_gate. attempts: as run() gives them."""
    valid = attempts.filter("stage IS NULL OR stage = 'gate'").filter("errors = 0")
    best = render.many(batch.select(valid, "case", "metrics" if gated else "warnings"))
    seen = render.many(attempts.select("case").distinct().withColumn("tried", F.lit(True)))
    d = cases.select("case").join(best, "case", "left").join(seen, "case", "left")
    if unknown is not None:
        d = d.join(render.many(unknown.select("case", F.col("code").alias("known")).distinct()), "case", "left")
    else:
        d = d.withColumn("known", F.lit(None).cast("string"))
    code = F.coalesce("known", F.when(F.col("tried").isNull(), "E5104").when(F.col("template").isNull(), "E5105").when(F.col("status") != "pass", "E5108" if gated else "E5105"))
    shown = F.col("known").isNull() & ((F.col("status") == "pass") | F.lit(allow_failed_gate))
    only = lambda c: F.when(shown, F.col(c)).alias(c)
    return d.withColumn("code", code).select("case", only("template"), F.when(F.col("code").isNull(), "pass").otherwise("fail").alias("status"), "code", *map(only, ("rmse", "bad", "warnings", "score")))


# -- builders ------------------------------------------------------------------------------------


def _pixels(f: Figure) -> DataFrame:
    return store.saved(packed.unpack(f.lines), "pixels")


def _events(f: Figure) -> Made:
    d = store.saved(extract.event_panels(_pixels(f), f.sizes, f.texts), "events")
    ratio = lambda c: F.round((F.col(c) - F.col("x")) / F.col("width"), 4)
    times = d.groupBy("image").agg(F.min(ratio("t_start_x")).alias("t_start"), F.max(ratio("t_trigger_x")).alias("t_trigger")).withColumn("title", F.lit(None).cast("string"))
    title = extract.role_texts(f.texts, panels.event_roles(f.texts, d.withColumn("ord", F.col("x")), f.sizes), "title")
    times = times.drop("title").join(title, "image", "left")
    curves = d.select("image", "panel", F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.lit(c).alias("stroke"), F.col(n).alias("points")) for n, c, _ in extract.PANEL_CURVES])).alias("c")).select("image", "panel", "c.*").filter("points IS NOT NULL")
    thresholds = d.select("image", "panel", F.explode("thresholds").alias("y_ratio")).withColumn("label", F.lit("Th"))
    bad = figures.panel_issues(times.join(f.sizes, "image"), d.select("image", "panel", "x", "y", "width", "height"), curves.select("image", "curve", "points"), "image")
    lost = f.sizes.select("image").join(d.select("image").distinct(), "image", "left_anti").select("image", F.lit("E2101").alias("code"))
    failures = bad.filter("code IN ('E2101', 'E2105')").unionByName(lost).withColumn("message", F.lit("no three panels"))
    return Made(figures.event_panels(times, d.withColumn("label", F.col("panel")), curves, thresholds, "image"), failures)


def _plots(f: Figure) -> Made:
    boxes = extract.default_plot(f.sizes)
    series = store.saved(extract.line_plot(_pixels(f), f.sizes), "series")
    roles = panels.plot_roles(f.texts, boxes, f.sizes)
    labels = reduce(lambda a, b: a.join(b, "image", "left"), [extract.role_texts(f.texts, roles, r) for r in ("title", "axis_label_x", "axis_label_y")], f.sizes.select("image"))
    return Made(figures.line_plot(f.sizes, boxes, series, labels))


def _flows(f: Figure) -> Made:
    nodes = store.saved(extract.flow_nodes(f.sizes, f.texts), "nodes")
    edges = extract.flow_edges(_pixels(f), nodes).withColumn("label", F.lit(None).cast("string"))
    named = nodes.select("image", F.col("node").alias("id"), "x", "y", "width", "height", F.when(F.col("texts") != "", F.col("texts")).otherwise(F.col("label")).alias("text"))
    return Made(templates.flow(named, edges.select("image", "a", "b", "label"), "image"))


def _architecture(f: Figure) -> Made:
    fields = extract.architecture_fields(f.sizes.select("image"), extract.texts_in_regions(f.texts, extract.architecture_layout(f.sizes)))
    wrong = f.sizes.filter("width <> 1920 OR height <> 1080").select("image", F.lit("E2301").alias("code"), F.lit("not 1920 x 1080").alias("message"))
    return Made(figures.architecture(f.sizes, fields), wrong)


def _loops(f: Figure) -> Made:
    fields = extract.loop_fields(f.sizes.select("image"), extract.texts_in_regions(f.texts, extract.loop_layout(f.sizes), "box_"))
    return Made(figures.agent_loop(f.sizes, fields))


def _grids(f: Figure) -> Made:
    cells, series = extract.grid_panels(_pixels(f), f.sizes, f.texts)
    return Made(figures.performance_grid(f.sizes, cells, series, 2, 2))


def _layouts(f: Figure) -> Made:
    return Made(figures.auto_layout(f.sizes, extract.auto_layout(_pixels(f), f.texts)))


#: Extraction and rendering by template.
BUILDERS: dict[str, Builder] = {
    "t_3gpp_events_3panel": _events, "t_performance_lineplot": _plots, "t_procedure_flow": _flows, "t_project_architecture_v1": _architecture, "t_rl_agent_loop_v1": _loops, "t_performance_grid_v1": _grids, "t_auto_layout": _layouts,
}
