"""Scalar column builders: colour math, rounding, geometry and text predicates.

Rounding is half-even throughout (bround), hue is in degrees, luminance weights are the public BT.709
and BT.601 ones. Everything is a plain Column, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BT709 = (0.2126, 0.7152, 0.0722)
BT601 = (0.299, 0.587, 0.114)


def weighted(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = BT709) -> Column:
    return r * F.lit(weights[0]) + g * F.lit(weights[1]) + b * F.lit(weights[2])


def is_ink(r: Column, g: Column, b: Column, a: Column, preset: str = "classifier") -> Column:
    """The four ink definitions (PRJ-01, PRJ-02, PRJ-03, preprocessing)."""
    if preset == "classifier":
        return (a > 10) & (weighted(r, g, b) < 245)
    if preset == "preprocess":
        return (a > 0) & (weighted(r, g, b) < 245)
    if preset == "bold":
        return weighted(r, g, b, BT601) < 180
    if preset == "arrow":
        return (a > 10) & ((r + g + b) / 3 < 200)
    raise ValueError(f"unknown ink preset {preset!r}")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees; where channels tie for the maximum blue wins, then green, then red (PRJ-05)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    return F.when(d == 0, F.lit(0.0)).when(top == b, 60 * ((r - g) / d + 4)).when(top == g, 60 * ((b - r) / d + 2)).otherwise(60 * F.pmod((g - b) / d, F.lit(6.0)))


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b).cast("double")
    return F.when(top == 0, F.lit(0.0)).otherwise((top - F.least(r, g, b)) / top)


def hue_distance(a: Column, b: Column) -> Column:
    """Circular distance (PRJ-06)."""
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def hue_between(h: Column, low: float, high: float) -> Column:
    """Range with wrap-around where low is over high (PRJ-06)."""
    return (h >= low) & (h <= high) if low <= high else (h >= low) | (h <= high)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)]))


def from_hex(text: Column, channel: int) -> Column:
    return F.conv(F.substring(text, 2 + 2 * channel, 2), 16, 10).cast("int")


def color_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def near_white(r: Column, g: Column, b: Column, floor: int = 240) -> Column:
    return (r >= floor) & (g >= floor) & (b >= floor)


def near_black(r: Column, g: Column, b: Column, ceiling: int = 30) -> Column:
    return (r <= ceiling) & (g <= ceiling) & (b <= ceiling)


def flatten_alpha(c: Column, a: Column) -> Column:
    """A channel over white (GAT-01)."""
    return c * a / 255 + 255 * (1 - a / 255)


def snap(x: Column, grid: float) -> Column:
    """Nearest multiple of grid, halves to even (PRJ-14)."""
    return F.bround(x / grid) * grid


def round_product(x: Column, digits: int) -> Column:
    """A double to so many digits by rounding its product with 10^digits half away from zero, as C and SQL engines do; F.round() takes its shortest
    decimal instead, which is apart for doubles right beside a half. A product out of range leaves x."""
    d = F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.abs(d) < F.lit(float("inf")), d).otherwise(x)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    f = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(f(low), F.least(f(high), x))


def snap_to_edge(x: Column, edge: Column | float, tolerance: float) -> Column:
    e = edge if isinstance(edge, Column) else F.lit(edge)
    return F.when(F.abs(x - e) <= tolerance, e).otherwise(x)


def to_plot(v: Column, low: Column, high: Column, origin: float, size: float, flip: bool = False, digits: int = 4) -> Column:
    """Value to plot coordinate (PRJ-16); null where the range is empty."""
    share = F.when(high != low, (v - low) / (high - low))
    return F.bround(origin + (size - share * size if flip else share * size), digits)


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def line_distance(a: list[Column], b: list[Column]) -> Column:
    """Symmetric endpoint distance of lines given as x1, y1, x2, y2 (PRJ-21)."""
    d = lambda i, j: line_length(a[i], a[i + 1], b[j], b[j + 1])
    return F.least(d(0, 0) + d(2, 2), d(0, 2) + d(2, 0))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller area of boxes given as x, y, width, height (PRJ-22)."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    small = F.least(a[2] * a[3], b[2] * b[3])
    return F.when(small > 0, w * h / small).otherwise(F.lit(0.0))


def point_line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Perpendicular distance; distance to the point where the line has no length (PRJ-23)."""
    n = line_length(x1, y1, x2, y2)
    return F.when(n == 0, line_length(px, py, x1, y1)).otherwise(F.abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1) / n)


# -- text ------------------------------------------------------------------------------------


def collapse(s: Column) -> Column:
    """White space runs become one space, ends are trimmed (STR-01)."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def class_count(s: Column, pattern: str) -> Column:
    """Characters of a class; a lone character is sought by bytes, others are taken out run by run."""
    lone = pattern if len(pattern) == 1 else pattern[1] if len(pattern) == 3 and pattern[0] + pattern[2] == "[]" else None
    rest = F.replace(s, F.lit(lone), F.lit("")) if lone else F.regexp_replace(s, f"(?:{pattern})++", "")
    return F.length(s) - F.length(rest)


def char_stats(s: Column) -> dict[str, Column]:
    """Shares of letters, digits, both, and ASCII among characters; empty text has zeros (STR-09)."""
    n = F.length(s)
    share = lambda p: F.when(n > 0, class_count(s, p) / n).otherwise(F.lit(0.0))
    return {"alpha": share(r"\p{L}"), "digit": share(r"\p{N}"), "alnum": share(r"[\p{L}\p{N}]"), "ascii": share(r"[\x00-\x7F]")}


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, both lower-cased; 0 if either is empty (STR-07)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def random_chars(s: Column) -> Column:
    """Short mixes of lower, upper and digit, or a single odd character (FLT-02)."""
    mixed = (F.length(s) < 5) & s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]")
    return mixed | ((F.length(s) == 1) & ~s.isin(*"aAiI01"))


def suspicious(s: Column) -> Column:
    """Two short words, mostly single letters, or a character four times in a row (FLT-03)."""
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: (F.length(w) == 1) & w.rlike(r"\p{L}")))
    return s.rlike(r"(?i)^[a-z]{2,4}\s+[a-z]{2,4}$") | ((F.size(words) >= 3) & (single / F.size(words) > 0.4)) | s.rlike(r"(.)\1{3,}")


def keyword_hits(s: Column, keywords: list[str]) -> Column:
    """How many keywords occur as substrings (STR-19)."""
    return sum((F.contains(s, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def apply_case(token: Column, canonical: Column) -> Column:
    """The token's case on its canonical form: upper, lower, title, else as it is (STR-04)."""
    title = F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substring(token, 2, 1 << 20)))
    made = F.concat(F.upper(F.substring(canonical, 1, 1)), F.lower(F.substring(canonical, 2, 1 << 20)))
    return F.when(token == F.upper(token), F.upper(canonical)).when(token == F.lower(token), F.lower(canonical)).when(token == title, made).otherwise(canonical)


def sanitize(s: Column) -> Column:
    """Illegal characters go, `._/+-` are trimmed off words, single letters go unless all are (STR-02)."""
    words = F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"[^\p{L}\p{N}._/+-]", ""), r"^[._/+-]+|[._/+-]+$", ""))
    words = F.filter(words, lambda w: w != "")
    longer = F.filter(words, lambda w: ~((F.length(w) == 1) & w.rlike(r"\p{L}")))
    return F.array_join(F.when(F.size(longer) > 0, longer).otherwise(words), " ")


def leading_number(s: Column) -> Column:
    """The number that a text begins with, or null (STR-23)."""
    return F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def parse_color(s: Column) -> Column:
    """Canonical rgb(r,g,b) of #rgb, #rrggbb and rgb() with numbers or percents; keywords lower-cased; url and
    empty are null (STR-22)."""
    t = F.lower(F.trim(s))
    n = lambda i: F.conv(F.substring(t, 2 + 2 * i, 2), 16, 10)
    d = lambda i: F.conv(F.repeat(F.substring(t, 2 + i, 1), 2), 16, 10)
    part = lambda i: F.trim(F.regexp_extract(t, r"^rgb\(([^,]*),([^,]*),([^,)]*)\)$", i + 1))
    number = lambda i: F.when(part(i).endswith("%"), F.bround(F.regexp_replace(part(i), "%", "").try_cast("double") * 255 / 100)).otherwise(part(i).try_cast("double")).cast("int").cast("string")
    rgb = lambda f: F.concat(F.lit("rgb("), f(0), F.lit(","), f(1), F.lit(","), f(2), F.lit(")"))
    return F.when(t.rlike("^#[0-9a-f]{6}$"), rgb(n)).when(t.rlike("^#[0-9a-f]{3}$"), rgb(d)).when(t.startswith("rgb("), rgb(number)).when(t.startswith("url(") | (t == ""), None).otherwise(t)


def chars_per_line(width: Column | float, font: float, factor: float = 0.55) -> Column:
    w = width if isinstance(width, Column) else F.lit(width)
    return F.greatest((w / (factor * font)).cast("int"), F.lit(4))


def word_wrap(s: Column, width: int) -> Column:
    """Greedy wrap to an array of lines; words longer than width stand alone (STR-15)."""
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= width)
        joined = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])).alias("lines"), F.when(fits, joined).otherwise(w).alias("line"))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))


def truncate_lines(lines: Column, most: int, width: int) -> Column:
    """At most so many lines; the last one kept ends in an ellipsis where lines were cut (STR-16)."""
    last = F.concat(F.rtrim(F.left(F.element_at(lines, F.lit(most)), F.lit(max(width - 3, 0)))), F.lit("..."))
    return F.when(F.size(lines) <= most, lines).otherwise(F.array_append(F.slice(lines, 1, most - 1), last))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
