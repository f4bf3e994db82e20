"""Rules over an element table: every rule gives issue rows (doc, severity, code, subject).

Elements have: doc, node, parent, tag, attrs map<string,string>, text, groups array<string>, inherited map<string,string>. Codes are the public contract of the
validator: E... are errors, W... warnings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.functions import labels
from rasterlake.operators import render
from rasterlake.sources import store

#: The codes and what they mean (VAL-20).
CODES = {
    "E1000": "unreadable document", "E1001": "unreadable contract", "E1002": "unreadable thresholds",
    "E2001": "forbidden element", "E2002": "forbidden element prefix", "E2003": "missing group", "E2004": "font family not allowed",
    "E2005": "too many colours", "E2006": "stroke width not allowed", "E2007": "path too complex", "E2008": "text missing",
    "E2009": "text without id", "E2010": "text outlined as path", "E2011": "tspan without id", "E2012": "newline in text",
    "E2013": "dashed without dasharray", "E2014": "too few texts", "E2015": "generic font missing", "E2016": "text anchor missing",
    "E2017": "no texts", "E3001": "not rasterised", "E3002": "not comparable", "E3003": "diff over a limit",
    "W2101": "line nearly axis-aligned", "W2102": "simulated dashes", "W2103": "text outside its group", "W2104": "polyline too long",
    "W2105": "polyline not snapped", "W2106": "baseline misaligned",
}


#: Attributes that rules read as text.
READ = ("id", "class", "d", "points", "fill", "stroke", "stroke-dasharray", "text-anchor", "font-family")


def payload(code: Column, context: Column, hint: Column | None = None) -> Column:
    """An issue as canonical JSON (PRJ-25): code, context, hint and message, of which those without a value are left out. context: map of text."""
    messages = F.create_map(*[F.lit(v) for pair in CODES.items() for v in pair])
    full = F.when(F.size(F.coalesce(context, F.create_map().cast("map<string,string>"))) > 0, context)
    return F.to_json(F.struct(code.alias("code"), full.alias("context"), (hint if hint is not None else F.lit(None).cast("string")).alias("hint"), F.try_element_at(messages, code).alias("message")))


def issue(df: DataFrame, doc: str, code: str, subject: Column) -> DataFrame:
    return df.select(F.col(doc).alias("doc"), F.lit("error" if code[0] == "E" else "warning").alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def where(df: DataFrame, doc: str, code: str, condition: Column, subject: str) -> DataFrame:
    """An issue for each element that meets the condition (E2001, E2009, E2010 to E2013, W2101, W2103, W2104)."""
    return issue(df.filter(condition), doc, code, F.col(subject))


def _each(elements: DataFrame, doc: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """The issues of all rules (code, condition, subject) on single elements, in one pass."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))) for code, cond, subject in rules]))
    d = elements.select(F.col(doc).alias("doc"), F.explode(hit).alias("i"))
    return d.select("doc", F.when(F.startswith("i.code", F.lit("E")), "error").otherwise("warning").alias("severity"), "i.code", "i.subject")


def missing(docs: DataFrame, doc: str, required: list[str], present: DataFrame, name: str) -> DataFrame:
    """E2003: required names that a document doesn't have. One aggregation of what is present; no pair is built
    beyond documents times the fixed list."""
    have = present.filter(F.col(name).isin(required)).groupBy(doc).agg(F.collect_set(name).alias("__have"))
    d = docs.select(doc).distinct().join(have, doc, "left")
    lost = F.array_except(F.array(*map(F.lit, required)), F.coalesce("__have", F.array().cast("array<string>")))
    d = d.select(doc, F.explode(lost).alias("__name"))
    return issue(d, doc, "E2003", F.col("__name"))


def without(df: DataFrame, doc: str, required: list[str], name: Column) -> DataFrame:
    """E2003 where the rows of documents themselves hold the names (null: none): one flag a required name, no join."""
    names = list(dict.fromkeys(required))
    d = df.select(doc, name.alias("__name")).groupBy(doc).agg(*[F.coalesce(F.bool_or(F.col("__name") == r), F.lit(False)).alias(f"__{i}") for i, r in enumerate(names)])
    lost = F.array_compact(F.array(*[F.when(~F.col(f"__{i}"), r) for i, r in enumerate(names)]).cast("array<string>"))
    return issue(d.select(doc, F.explode(lost).alias("__name")), doc, "E2003", F.col("__name"))


def off_set(df: DataFrame, doc: str, value: str, allowed: list[float], tolerance: float) -> DataFrame:
    """E2006: one issue for each distinct value further than tolerance from all allowed ones."""
    near = reduce(lambda a, b: a | b, [F.abs(F.col(value) - v) <= tolerance for v in allowed])
    return issue(df.filter(~near).select(doc, value).distinct(), doc, "E2006", F.col(value))


def too_many(df: DataFrame, doc: str, value: str, most: int, code: str = "E2005") -> DataFrame:
    """Documents with over so many distinct values (E2005)."""
    d = df.groupBy(doc).agg(F.countDistinct(value).alias("__n")).filter(F.col("__n") > most)
    return issue(d, doc, code, F.col("__n"))


def simulated_dashes(df: DataFrame, doc: str, keys: list[str], least: int = 6) -> DataFrame:
    """W2102: groups of at least so many segments on one line with one stroke and width (AGG-23)."""
    d = df.groupBy(doc, *keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return issue(d, doc, "W2102", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("__n").cast("string")))


def nearly_aligned(delta: Column, tolerance: float = 0.5) -> Column:
    """W2101: off the axis, but by no more than tolerance."""
    return (F.abs(delta) > 0) & (F.abs(delta) <= tolerance)


def text_count(docs: DataFrame, doc: str, expected: str, actual: str, ratio: float = 0.7, may_miss: int = 1) -> DataFrame:
    """E2014 and E2017: fewer texts than expected (AGG-34), or none at all."""
    need = required_texts(F.col(expected), ratio, may_miss)
    d = docs.filter((F.col(expected) > 0) & (F.col(actual) < need))
    return issue(d.filter(F.col(actual) > 0), doc, "E2014", F.col(actual)).union(issue(d.filter(F.col(actual) == 0), doc, "E2017", F.col(actual)))


def required_texts(n: Column, ratio: float = 0.7, may_miss: int = 1) -> Column:
    """ceil(max(min(n * ratio, n - may_miss), 1)); 0 where n is not positive (AGG-34)."""
    return F.when(n <= 0, 0).otherwise(F.ceil(F.greatest(F.least(n * ratio, (n - may_miss).cast("double")), F.lit(1.0)))).cast("int")


def path_commands(d: Column) -> Column:
    """Number of drawing commands of a path (AGG-24)."""
    return F.regexp_count(d, F.lit("[MmLlHhVvCcSsQqTtAaZz]"))


def font_allowed(value: Column, allowed: list[str]) -> Column:
    """Whether one of a comma-separated list of families is allowed (STR-25)."""
    names = F.transform(F.split(F.lower(value), ","), lambda n: F.regexp_replace(F.trim(n), "^['\"]|['\"]$", ""))
    return F.arrays_overlap(names, F.array(*[F.lit(a.lower()) for a in allowed]))


def has_generic(value: Column, generic: list[str]) -> Column:
    """Whether a font list names a generic family (E2015)."""
    return font_allowed(value, generic)


def coordinates(points: Column) -> Column:
    """Numbers of a point list, x and y in turn; empty where one is no number or they don't pair up (STR-24)."""
    numbers = F.transform(F.split(F.trim(F.regexp_replace(F.coalesce(points, F.lit("")), r"[,\s]+", " ")), " "), lambda t: t.try_cast("double"))
    return F.when((F.size(numbers) % 2 == 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers).otherwise(F.array().cast("array<double>"))


def unsnapped(numbers: Column, axis: int, tolerance: float = 0.5) -> Column:
    """W2105: whether a segment of a point list is nearly level (axis 1) or nearly upright (axis 0)."""
    step = lambda k: F.get(numbers, 2 * k + 2 + axis) - F.get(numbers, 2 * k + axis)
    return F.when(F.size(numbers) >= 4, F.exists(F.sequence(F.lit(0), (F.size(numbers) / 2 - 2).cast("int")), lambda k: nearly_aligned(step(k), tolerance))).otherwise(False)


def axis_segments(lines: DataFrame, doc: str, tolerance: float = 0.5) -> DataFrame:
    """Level and upright lines of x1, y1, x2, y2 with axis and coord, as W2102 groups them (AGG-23)."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    axis = F.when((dy <= tolerance) & (dx > 0), "h").when((dx <= tolerance) & (dy > 0), "v")
    coord = F.when(axis == "h", (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    return lines.withColumn("axis", axis).withColumn("coord", coord).filter("axis IS NOT NULL AND coord IS NOT NULL")


def misaligned(texts: DataFrame, doc: str, tolerance: float = 1.0) -> DataFrame:
    """W2106: lines of texts (gaps of y up to tolerance) whose y differ by over 0.001, unless they name one
    dominant baseline (WIN-09). texts: doc, node, y, dominant."""
    order = Window.partitionBy(doc).orderBy("y", "node")
    new = F.coalesce((F.col("y") - F.lag("y").over(order) > tolerance).cast("int"), F.lit(0))
    d = texts.filter("y IS NOT NULL").withColumn("__new", new)
    d = d.withColumn("__line", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(doc, "__line").agg((F.max("y") - F.min("y")).alias("__span"), F.countDistinct("dominant").alias("__names"), F.min_by("node", F.struct("y", "node")).alias("__node"))
    return issue(d.filter((F.col("__span") > 1e-3) & (F.col("__names") != 1)), doc, "W2106", F.col("__node"))


def tags(html: Column) -> Column:
    """Opening tag names of markup that need not be well formed, lower-cased (STR-21)."""
    return F.transform(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9:]*)"), F.lit(1)), lambda t: F.lower(t))


def validate_elements(elements: DataFrame, contract: dict, expected: DataFrame | None = None) -> DataFrame:
    """All issues of a table of elements under a contract (VAL-01 to VAL-18), as one union. expected: doc and
    texts_detected, for E2014 and E2017. E1000 is a document that could not be parsed; E1001 and E1002 come from reading
    configuration, E3... from diff_code().

    contract: forbid_elements, forbid_element_prefixes, required_groups, allowed_font_families, max_colors,
    max_path_commands, allowed_stroke_widths, stroke_width_tolerance, max_polyline_points, require_text, snap_tolerance,
    min_dash_segments, baseline_tolerance; generic_font_families (E2015) and text_group (W2103), where given."""
    c = {"forbid_elements": [], "forbid_element_prefixes": [], "required_groups": [], "allowed_font_families": [], "max_colors": 6, "max_path_commands": 70, "allowed_stroke_widths": [], "stroke_width_tolerance": 0.2, "max_polyline_points": 30, "require_text": True, "snap_tolerance": 0.5, "min_dash_segments": 6, "baseline_tolerance": 1.0, "generic_font_families": [], "text_group": None} | contract
    # attributes become columns once, in a written table: the rules below read it several times, a few columns each
    held = lambda name: F.try_element_at("attrs", F.lit(name))
    taken = {f"own {n}": F.coalesce(F.nullif(held(n), F.lit("")), F.try_element_at("inherited", F.lit(n))) for n in ("font-family", "dominant-baseline")}
    numbers = {f"number {n}": X.leading_number(held(n)) for n in ("x1", "y1", "x2", "y2", "y", "stroke-width")}
    e = store.saved(elements.select("doc", "node", "parent", "tag", "text", "groups", *[v.alias(k) for k, v in {**{n: held(n) for n in READ}, **taken, **numbers}.items()]), "elements")
    a = lambda name: F.col(f"`{name}`")
    number = lambda name: F.col(f"`number {name}`")
    own = lambda name: F.col(f"`own {name}`")
    tag, no = F.col("tag"), F.lit(False)
    level, upright = nearly_aligned(number("y2") - number("y1"), c["snap_tolerance"]), nearly_aligned(number("x2") - number("x1"), c["snap_tolerance"])
    pointed = e.withColumn("__numbers", F.when(tag == "polyline", coordinates(a("points"))))  # parsed once a polyline
    single: list[tuple[str, Column, str]] = [
        ("E1000", tag == "!error", "text"), ("E2001", tag.isin(c["forbid_elements"]), "tag"), ("E2002", reduce(lambda x, y: x | y, [F.startswith("tag", F.lit(p)) for p in c["forbid_element_prefixes"]], no), "tag"),
        ("E2009", (tag == "text") & a("id").isNull(), "node"), ("E2011", (tag == "tspan") & a("id").isNull(), "node"), ("E2012", tag.isin("text", "tspan") & labels.has_newline(F.col("text")), "node"),
        ("E2007", (tag == "path") & (path_commands(F.coalesce(a("d"), F.lit(""))) > c["max_path_commands"]), "node"), ("E2010", (tag == "path") & labels.looks_like_text_path(a("id"), a("class")), "node"),
        ("E2013", F.coalesce(a("class").rlike("dash"), no) & a("stroke-dasharray").isNull(), "node"), ("E2016", (tag == "text") & ~F.coalesce(a("text-anchor").isin("start", "middle", "end"), no), "node"),
        ("W2101", (tag == "line") & (level | upright), "node"), ("W2104", (tag == "polyline") & (F.size(F.split(F.trim(F.coalesce(a("points"), F.lit(""))), r"\s+")) > c["max_polyline_points"]), "node"),
        *[("W2105", (tag == "polyline") & unsnapped(F.col("__numbers"), axis, c["snap_tolerance"]), "node") for axis in (1, 0)],
    ]
    if c["text_group"]:
        single.append(("W2103", (tag == "text") & ~F.array_contains("groups", c["text_group"]), "node"))
    if c["generic_font_families"]:
        font = own("font-family")
        fine = font_allowed(font, c["allowed_font_families"]) if c["allowed_font_families"] else F.lit(True)
        single.append(("E2015", (tag == "text") & font.isNotNull() & fine & ~has_generic(font, c["generic_font_families"]), "node"))
    if c["allowed_font_families"]:
        single.append(("E2004", (tag == "text") & a("font-family").isNotNull() & ~font_allowed(a("font-family"), c["allowed_font_families"]), "node"))
    by = store.dealt(e, "doc")  # for what a whole document decides
    found = [
        _each(pointed, "doc", single),
        too_many(by.select("doc", F.explode(F.array_compact(F.array(a("fill"), a("stroke")))).alias("color")).select("doc", X.parse_color(F.col("color")).alias("color")).filter("color <> 'none'"), "doc", "color", c["max_colors"]),
    ]
    texts = by.filter("tag = 'text'")
    if c["required_groups"]:
        found.append(without(by, "doc", c["required_groups"], F.when(tag == "g", a("id"))))
    if c["require_text"]:
        d = by.groupBy("doc").agg(F.count_if(F.col("tag") == "text").alias("n"))
        found.append(where(d, "doc", "E2008", F.col("n") == 0, "n"))
    if expected is not None:
        n = texts.groupBy("doc").agg(F.count("*").alias("n"))
        d = expected.select(F.col("doc").cast("string").alias("doc"), "texts_detected").join(render.many(n), "doc", "left").fillna(0, ["n"])
        found.append(text_count(d, "doc", "texts_detected", "n"))
    lines = by.filter("tag = 'line'").select("doc", *[number(x).alias(x) for x in ("x1", "y1", "x2", "y2")], F.coalesce(a("stroke"), F.lit("")).alias("stroke"), F.coalesce(number("stroke-width"), F.lit(0.0)).alias("width"))
    found.append(simulated_dashes(axis_segments(lines, "doc", c["snap_tolerance"]), "doc", ["axis", "coord", "stroke", "width"], c["min_dash_segments"]))
    # a text without y has its first span's; spans meet their text by one grouping
    own_y = F.when(tag == "tspan", number("y"))
    told = by.filter("tag IN ('text', 'tspan')").groupBy("doc", F.when(tag == "text", F.col("node")).otherwise(F.col("parent")).alias("node"))
    told = told.agg(F.bool_or(tag == "text").alias("text"), F.max(F.when(tag == "text", number("y"))).alias("y"), F.min_by(own_y, F.when(own_y.isNotNull(), F.col("node"))).alias("span_y"), F.max(F.when(tag == "text", F.nullif(F.trim(own("dominant-baseline")), F.lit("")))).alias("dominant"))
    baselines = told.filter("text").withColumn("y", F.coalesce("y", "span_y"))
    found.append(misaligned(baselines, "doc", c["baseline_tolerance"]))
    if c["allowed_stroke_widths"]:
        stroked = by.filter(F.coalesce(a("stroke"), F.lit("none")) != "none").select("doc", number("stroke-width").alias("w")).filter("w IS NOT NULL")
        found.append(off_set(stroked, "doc", "w", c["allowed_stroke_widths"], c["stroke_width_tolerance"]))
    return reduce(DataFrame.unionByName, found)


def report(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Status and counts of each document (VAL-01): any error fails it."""
    n = issues.groupBy("doc").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    d = docs.select("doc").distinct().join(n, "doc", "left").fillna(0, ["errors", "warnings"])
    return d.withColumn("status", F.when(F.col("errors") == 0, "pass").otherwise("fail"))


def diff_code(rasterized: Column, comparable: Column, rmse: Column, bad: Column, max_rmse: Column, max_bad: Column) -> Column:
    """Code of a visual comparison (VAL-19): E3001 where there is no raster, E3002 where the sizes differ, E3003 where a metric exceeds its
    limit, else null."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(rasterized), "E3001").when(no(comparable), "E3002").when((rmse > max_rmse) | (bad > max_bad), "E3003")
