"""Texts of figures: label prefixes, bullets, goals and outputs, canonical wordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What curve labels are called.
CANONICAL = {"curve_label_serving": "Serving beam", "curve_label_neighbor": "Neighbor/Target beam"}
PANELS = ("A3", "A4", "A5")


def label_prefix(text: Column) -> Column:
    """The panel that a text begins with the name of, else null (STR-10)."""
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for name in reversed(PANELS):
        out = F.when(F.startswith(low, F.lit(name.lower())), name).otherwise(out)
    return out


def drop_leading_number(text: Column) -> Column:
    """Each line without a first word of digits where a later word is letters only; unchanged where no line has one (STR-11)."""
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda t: t != "")
    hit = lambda w: (F.size(w) > 1) & F.get(w, F.lit(0)).rlike(r"^\p{Nd}+$") & F.exists(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda t: t.rlike(r"^\p{L}+$"))
    lines = F.transform(F.split(text, "\r\n|\r|\n"), words)
    kept = F.filter(F.transform(lines, lambda w: F.array_join(F.when(hit(w), F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w), " ")), lambda t: t != "")
    return F.when(F.exists(lines, hit) & (F.size(kept) > 0), F.array_join(kept, "\n")).otherwise(text)


def canonical(role: Column, text: Column, wordings: dict[str, str] = CANONICAL) -> Column:
    """The fixed wording of a role, else the text (STR-12)."""
    out = text
    for name, wording in wordings.items():
        out = F.when(role == name, wording).otherwise(out)
    return out


def bullets(lines: Column) -> Column:
    """Lines without leading bullets, dashes, dots and blanks; empty ones go (STR-14)."""
    return F.filter(F.transform(lines, lambda t: F.trim(F.regexp_replace(t, "^[•\\-–· ]+", ""))), lambda t: t != "")


def goal_output(lines: Column) -> Column:
    """struct<goal, output> of a work package's lines (STR-13): what follows the colon of the last line that names each, the whole line
    without one; what isn't named is the first of the lines that name neither, in order."""
    after = lambda t: F.trim(F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, "^[^:]*:", "")).otherwise(t))
    goal = lambda t: F.contains(F.lower(t), F.lit("goal"))
    output = lambda t: F.contains(F.lower(t), F.lit("output")) & ~goal(t)
    last = lambda test: F.get(F.reverse(F.filter(lines, test)), F.lit(0))
    rest = F.filter(lines, lambda t: ~goal(t) & ~output(t))
    g, o = after(last(goal)), after(last(output))
    spare = F.when(g.isNull(), F.get(rest, F.lit(1))).otherwise(F.get(rest, F.lit(0)))
    return F.struct(F.coalesce(g, F.trim(F.get(rest, F.lit(0)))).alias("goal"), F.coalesce(o, F.trim(spare)).alias("output"))


def looks_like_text_path(node_id: Column, css_class: Column) -> Column:
    """Whether a path's id or class says that it is outlined text (STR-27)."""
    return F.coalesce(F.lower(node_id).rlike("^(txt_|text_|glyph_)"), F.lit(False)) | F.coalesce(F.lower(css_class).rlike("text|glyph|font"), F.lit(False))


def has_newline(text: Column) -> Column:
    """Whether an element's own text is broken over lines (STR-27)."""
    return F.contains(F.coalesce(text, F.lit("")), F.lit("\n"))
