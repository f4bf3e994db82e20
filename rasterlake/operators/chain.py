"""The extraction chain (EXT-01): regions to read by template, words to items, roles, layout; geometry without near duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import extract, normal, panels, text


def regions(decisions: DataFrame, sizes: DataFrame, boxes: DataFrame, text_boxes: DataFrame | None = None, most: int = 40, pad: int = 0) -> DataFrame:
    """image, region, x, y, width, height, image_width, image_height of what a recogniser reads, by template (SRC-13, SRT-04): title and the upper,
    middle and lower parts of panels; title and axes of line plots; boxes of architecture figures, loops and grids; of other templates the
    largest text boxes, most of them. decisions: image, template; boxes: image, panel, x, y, width, height of figures of panels;
    text_boxes: image, ord, x, y, width, height."""
    from rasterlake.operators import render

    s = decisions.join(sizes, "image")
    of = lambda *names: s.filter(F.col("template").isin(*names))
    row = lambda df, name, x, y, w, h: df.select("image", name.alias("region"), *[F.floor(v).cast("double").alias(c) for v, c in zip((x, y, w, h), ("x", "y", "width", "height"), strict=True)])
    n = lambda v: F.lit(float(v))
    events = of("t_3gpp_events_3panel")
    p = boxes.join(events.select("image"), "image", "left_semi")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    plots = extract.default_plot(of("t_performance_lineplot"))
    tall = plots.join(sizes.select("image", F.col("height").alias("ih")), "image")
    cells = render.grid_cells(of("t_performance_grid_v1").select("image", "width", "height"), "width", "height", 2, 2)
    out = [
        row(of("t_3gpp_events_3panel", "t_performance_lineplot"), F.lit("title"), n(0), n(0), w, h * 0.18),
        *[row(p, F.concat(F.lit(f"panel_{name}_"), "panel"), x, y + h * low, w, h * part) for name, low, part in (("top", 0.0, 0.25), ("mid", 0.3, 0.4), ("bottom", 0.75, 0.25))],
        row(tall, F.lit("axis_x"), x, y + h, w, F.col("ih") * 0.2), row(tall, F.lit("axis_y"), n(0), y, x, h),
        extract.architecture_layout(of("t_project_architecture_v1")), extract.loop_layout(of("t_rl_agent_loop_v1")),
        row(cells.withColumnsRenamed({"width": "iw", "height": "ih", "w": "width", "h": "height"}), F.concat(F.lit("cell_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string")), x, y, w, h),
    ]
    if text_boxes is not None:
        fixed = ("t_3gpp_events_3panel", "t_performance_lineplot", "t_project_architecture_v1", "t_rl_agent_loop_v1", "t_performance_grid_v1")
        rest = text_boxes.join(decisions.filter(~F.col("template").isin(*fixed)).select("image"), "image", "left_semi").filter("width > 0 AND height > 0")
        rank = F.row_number().over(Window.partitionBy("image").orderBy((-F.col("width") * F.col("height")), "y", "x"))
        out.append(row(rest.withColumn("__r", rank).filter(F.col("__r") <= most), F.concat(F.lit("text_box_"), F.col("ord").cast("string")), x, y, w, h))
    d = reduce(DataFrame.unionByName, out).join(sizes.select("image", F.col("width").alias("image_width"), F.col("height").alias("image_height")), "image")
    low_x, low_y = F.greatest(x - pad, F.lit(0.0)), F.greatest(y - pad, F.lit(0.0))
    return d.select("image", "region", low_x.alias("x"), low_y.alias("y"), (F.least(x + w + pad, F.col("image_width")) - low_x).alias("width"), (F.least(y + h + pad, F.col("image_height")) - low_y).alias("height"), "image_width", "image_height")


def clean_items(words: DataFrame, noise: list[str], valid: list[str], least: Column | float = 0.4) -> DataFrame:
    """Words that are texts (FLT-04 to FLT-07, SET-06): those that validation_reason() finds valid, collapsed, and of equal ones in a cell of ten
    pixels the surest (ties: the first item). words: image, item, text, conf, x, y, width, height."""
    d = words.withColumn("text", X.collapse(F.coalesce("text", F.lit(""))))
    bound = least if isinstance(least, Column) else F.lit(least)
    d = d.filter(text.validation_reason(F.col("text"), F.coalesce("conf", F.lit(0.0)), bound, noise, valid) == "valid")
    cell = ["image", F.lower("text").alias("t"), F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy")]
    row = F.struct(*[F.col(c) for c in d.columns if c != "image"])
    kept = d.groupBy(*cell).agg(F.min_by(row, F.struct((-F.coalesce("conf", F.lit(0.0))).alias("c"), F.col("item"))).alias("r"))
    return kept.select("image", "r.*").select(*d.columns)


def roles(items: DataFrame, decisions: DataFrame, sizes: DataFrame, boxes: DataFrame) -> DataFrame:
    """image, item, role of texts by their figure's template (JON-03 to JON-05, CLS-05): by panels, around the plot, in nodes of a flow, else by place
    in the whole figure."""
    t = items.join(decisions.select("image", "template"), "image")
    of = lambda name: t.filter(F.col("template") == name).drop("template")
    events = panels.event_roles(of("t_3gpp_events_3panel"), boxes, sizes).select("image", "item", "role")
    plots = panels.plot_roles(of("t_performance_lineplot"), extract.default_plot(sizes), sizes)
    flows = of("t_procedure_flow")
    nodes = extract.flow_nodes(sizes, flows).select("image", F.col("node").alias("panel"), F.col("node").alias("ord"), "x", "y", "width", "height")
    held = panels.panel_of(flows, nodes, ["image", "item"], panels.center_x(), panels.center_y()).select("image", "item", F.when(F.col("panel").isNotNull(), "node_label").otherwise("annotation").alias("role"))
    rest = t.filter(~F.col("template").isin("t_3gpp_events_3panel", "t_performance_lineplot", "t_procedure_flow")).join(sizes.select("image", F.col("width").alias("iw"), F.col("height").alias("ih")), "image")
    other = rest.select("image", "item", panels.region_role(F.col("x"), F.col("y"), F.col("iw"), F.col("ih")).alias("role"))
    return events.unionByName(plots).unionByName(held).unionByName(other)


def figure_texts(words: DataFrame, decisions: DataFrame, sizes: DataFrame, boxes: DataFrame, noise: list[str], valid: list[str], least: Column | float = 0.4) -> DataFrame:
    """image, item, role, text, conf, x, y, box, font and baseline_group of a figure's texts, from recognised words to laid-out items: cleaned, given
    roles by template, and laid out by role (EXT-01, NRM-03)."""
    items = clean_items(words, noise, valid, least)
    d = items.join(roles(items, decisions, sizes, boxes), ["image", "item"])
    d = d.select("image", "item", "role", "text", "conf", "x", (F.col("y") + F.col("height")).alias("y"), F.col("x").alias("box_x"), F.col("y").alias("box_y"), F.col("width").alias("box_width"), F.col("height").alias("box_height"))
    return normal.text_layout(d, sizes)
