"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import scoring, spatial, text
from rasterlake.plans.common import query, table

CLASSES = ("noise", "prose", "table")
KEYWORDS = ["the", "and", "que", "der", "los"]


def _document_rules():
    t = F.coalesce("text", F.lit(""))
    s = X.char_stats(t)
    n, bars, lines, stops, shouts = F.length(t), X.class_count(t, "[|]"), X.class_count(t, "\n"), X.class_count(t, "[.]"), X.class_count(t, "!")
    hits = X.keyword_hits(F.lower(t), KEYWORDS)
    return {
        "prose": [(s["alpha"] > 0.7, 3.0), (stops >= 3, 1.5), (n > 400, 1.0), (hits >= 2, 0.5)],
        "table": [(bars >= 3, 4.5), (lines > 10, 0.5)],
        "noise": [(s["alnum"] < 0.75, 3.0), (shouts >= 5, 2.0), (n < 40, 1.5)],
    }


_SCORES = """d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, lang, length(t) AS n, length(t) - length(replace(t, '|', '')) AS bars, length(t) - length(replace(t, chr(10), '')) AS lines, length(t) - length(replace(t, '.', '')) AS stops, length(t) - length(replace(t, '!', '')) AS shouts,
 CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{L}]', '', 'g')) / length(t) ELSE 0 END AS alpha, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) / length(t) ELSE 0 END AS alnum,
 (contains(lower(t), 'the'))::INT + (contains(lower(t), 'and'))::INT + (contains(lower(t), 'que'))::INT + (contains(lower(t), 'der'))::INT + (contains(lower(t), 'los'))::INT AS hits FROM d),
s AS (SELECT doc_id, lang, unnest([{'c': 'prose', 's': (CASE WHEN alpha > 0.7 THEN 3.0 ELSE 0 END + CASE WHEN stops >= 3 THEN 1.5 ELSE 0 END + CASE WHEN n > 400 THEN 1.0 ELSE 0 END + CASE WHEN hits >= 2 THEN 0.5 ELSE 0 END)::DOUBLE},
 {'c': 'table', 's': (CASE WHEN bars >= 3 THEN 4.5 ELSE 0 END + CASE WHEN lines > 10 THEN 0.5 ELSE 0 END)::DOUBLE},
 {'c': 'noise', 's': (CASE WHEN alnum < 0.75 THEN 3.0 ELSE 0 END + CASE WHEN shouts >= 5 THEN 2.0 ELSE 0 END + CASE WHEN n < 40 THEN 1.5 ELSE 0 END)::DOUBLE}]) AS u FROM f),
r AS (SELECT doc_id, lang, u.c AS c, u.s AS s, row_number() OVER (PARTITION BY doc_id ORDER BY u.s DESC, u.c) AS r, coalesce(min(u.s) FILTER (u.s > 0) OVER (PARTITION BY doc_id), 0) AS low FROM s),
x AS (SELECT doc_id, any_value(lang) AS lang, any_value(c) FILTER (r = 1) AS top, any_value(s) FILTER (r = 1) AS score, any_value(greatest(s - low, 0)) FILTER (r = 1) AS share, sum(greatest(s - low, 0)) AS total, any_value(s) FILTER (r = 1) - any_value(s) FILTER (r = 2) AS margin FROM r GROUP BY doc_id),
y AS (SELECT doc_id, lang, top, score, round_even(CASE WHEN total > 0 THEN share / total ELSE 1 / 3 END, 6) AS confidence, round_even(margin, 6) AS margin FROM x),
z AS (SELECT *, CASE WHEN confidence < 0.52 OR margin < 0.05 THEN 'unknown' ELSE top END AS decision, concat_ws(',', CASE WHEN confidence < 0.52 THEN 'LOW_CONFIDENCE' END, CASE WHEN margin < 0.05 THEN 'AMBIGUOUS_MARGIN' END, CASE WHEN confidence < 0.52 OR margin < 0.05 THEN 'FALLBACK_TO_AUTO' END) AS reasons FROM y)"""


def _decided(spark, sf):
    return scoring.decide(table(spark, sf, "documents"), ["doc_id", "lang"], _document_rules())


@query(f"WITH {_SCORES} SELECT doc_id, top, score, confidence, margin, decision, reasons FROM z")
def score_documents(spark, sf):
    """CLS-01, CLS-02, CLS-04, STR-09, STR-19, SRT-01: the flagship."""
    return _decided(spark, sf).drop("lang")


@query(f"WITH {_SCORES} SELECT lang, decision, count(*) AS n FROM z GROUP BY lang, decision")
def decision_summary(spark, sf):
    """AGG-27, SRT-08."""
    return _decided(spark, sf).groupBy("lang", "decision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "decision")


@query(f"""WITH {_SCORES} SELECT doc_id, c AS class_id, s AS score, CAST(r AS INTEGER) AS rank FROM r""")
def ranked_scores(spark, sf):
    """CLS-01, SRT-01, SRT-02: the long form, every class of every document with its rank."""
    d = scoring.rule_scores(table(spark, sf, "documents"), ["doc_id"], _document_rules())
    return scoring.top_n(d, ["doc_id"], [F.desc("score"), F.asc("class_id")], len(CLASSES))


_SANITIZE = """list_filter(list_transform(regexp_split_to_array(trim({c}), '[ \\t\\n\\r\\f\\v]+'), lambda w: regexp_replace(regexp_replace(w, '[^\\p{{L}}\\p{{N}}._/+-]', '', 'g'), '^[._/+-]+|[._/+-]+$', '', 'g')), lambda w: w <> '')"""


@query(f"""WITH t AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS s FROM part UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
w AS (SELECT kind, id, {_SANITIZE.format(c="s")} AS w FROM t), l AS (SELECT *, list_filter(w, lambda x: NOT (length(x) = 1 AND regexp_matches(x, '\\p{{L}}'))) AS l FROM w)
SELECT kind, id, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE w END, ' ') AS clean FROM l""")
def sanitize_tokens(spark, sf):
    """STR-02, STR-03."""
    a = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("s"))
    b = table(spark, sf, "benchmark").select(F.lit("benchmark"), "item_id", "text")
    return a.union(b).select("kind", "id", X.sanitize(F.col("s")).alias("clean"))


LEXICON = ["small", "large", "steel", "brass", "copper", "green", "plated", "widget", "gear", "bolt"]
_LEX = ", ".join(f"({i}, '{k}')" for i, k in enumerate(LEXICON))


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '[A-Za-z0-9_]+')) AS t FROM part), x AS (SELECT i, k FROM (VALUES {_LEX}) AS v(i, k)),
m AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY levenshtein(lower(t), k), i) AS r FROM t JOIN x ON levenshtein(lower(t), k) <= 2),
b AS (SELECT t.t, CASE WHEN k IS NULL THEN t.t WHEN t.t = upper(t.t) THEN upper(k) WHEN t.t = lower(t.t) THEN lower(k) WHEN t.t = upper(t.t[1]) || lower(t.t[2:]) THEN upper(k[1]) || lower(k[2:]) ELSE k END AS c FROM t LEFT JOIN m ON m.t = t.t AND r = 1),
e AS (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z0-9_]+')) AS t FROM part)
SELECT e.t AS token, c AS corrected, c <> e.t AS changed, count(*) AS n FROM e JOIN b ON b.t = e.t GROUP BY ALL""")
def lexicon_correct(spark, sf):
    """JON-09, STR-03 to STR-06: tokens of part names against a fixed lexicon."""
    d = table(spark, sf, "part").select("p_partkey", F.explode(F.regexp_extract_all("p_name", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("token"))
    return text.lexicon_correct(d, "token", LEXICON).groupBy("token", "corrected", "changed").agg(F.count("*").alias("n"))


VOCABULARY = ["small gear", "steel bolt", "copper plate", "green widget", "large valve"]
_SIM = "CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE 1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END"
_VOC = ", ".join(f"({i}, '{k}')" for i, k in enumerate(VOCABULARY))


@query(f"""WITH n AS (SELECT DISTINCT p_name, lower(trim(p_name)) AS s FROM part), v AS (SELECT i, k FROM (VALUES {_VOC}) AS v(i, k)),
q AS (SELECT p_name, s, i, k, CASE WHEN length(s) > 0 AND (contains(s, k) OR contains(k, s)) THEN 1.0 ELSE greatest({_SIM.format(a="s", b="k")}, coalesce(list_max(list_transform(list_filter(regexp_split_to_array(s, '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) >= 3), lambda w: {_SIM.format(a="w", b="k")})), 0)) END AS z FROM n, v),
b AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY z DESC, i) AS r FROM q)
SELECT p_name, k AS term, round(z, 6) AS similarity, z >= 0.75 OR (z > 0 AND length(s) <= 10 AND levenshtein(s, k) <= 2) AS matched FROM b WHERE r = 1""")
def vocab_fuzzy(spark, sf):
    """JON-10, STR-07: distinct part names against a vocabulary."""
    d = text.vocabulary_match(table(spark, sf, "part").select("p_name").distinct(), "p_name", VOCABULARY)
    return d.select("p_name", "term", F.round("similarity", 6).alias("similarity"), "matched")


NOISE = ["^[^a-z0-9]*$", "^[a-z]{1,3}$"]
VALID = ["licensed", "released", "[a-z]+ [a-z]+"]


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
c AS (SELECT doc_id, line, (length(line) * 37 % 100) / 100.0 AS conf, list_filter(regexp_split_to_array(trim(line), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM l),
s AS (SELECT *, regexp_matches(line, '^[a-z]{2,4}[ \\t\\n\\r\\f\\v]+[a-z]{2,4}$', 'i') OR (len(w) >= 3 AND len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '\\p{L}'))) / len(w) > 0.4)
 OR len(list_filter(range(1, length(line) - 2), lambda i: line[i] = line[i + 1] AND line[i] = line[i + 2] AND line[i] = line[i + 3])) > 0 AS odd FROM c),
r AS (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'empty_text' WHEN regexp_matches(line, '^[^a-z0-9]*$', 'i') OR regexp_matches(line, '^[a-z]{1,3}$', 'i') THEN 'noise_pattern'
 WHEN conf < 0.4 AND NOT regexp_matches(line, '^(licensed|released|[a-z]+ [a-z]+)', 'i') THEN 'low_confidence' WHEN odd THEN 'suspicious_pattern' ELSE 'valid' END AS reason FROM s)
SELECT doc_id, reason, count(*) AS n FROM r GROUP BY doc_id, reason""")
def noise_filter(spark, sf):
    """FLT-03 to FLT-07: the reason of every line of every document, counted."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    reason = text.validation_reason(F.col("line"), F.length("line") * 37 % 100 / 100.0, F.lit(0.4), NOISE, VALID)
    return d.select("doc_id", reason.alias("reason")).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, (conv_id * 7 + turn * 13) % 100 / 100.0 AS conf FROM conversations),
s AS (SELECT *, length(t) AS n, greatest(length(t), 1) AS m FROM t)
SELECT conv_id, turn, role, n >= 2 AND NOT ((n < 5 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]')) OR (n = 1 AND t NOT IN ('a', 'A', 'i', 'I', '0', '1'))) AND conf >= 0.5
 AND length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) / m >= 0.7 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) / m >= 0.35 AND NOT (length(regexp_replace(t, '[^\\p{L}]', '', 'g')) / m < 0.2 AND length(regexp_replace(t, '[^\\p{N}]', '', 'g')) / m < 0.15) AS keep FROM s""")
def text_keep(spark, sf):
    """FLT-01, FLT-02, FLT-08, STR-09."""
    conf = (F.col("conv_id") * 7 + F.col("turn") * 13) % 100 / 100.0
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", text.keep_text(F.coalesce("text", F.lit("")), conf).alias("keep"))


@query("""WITH k AS (SELECT event_type, round_even(value / 10, 0) * 10 AS cell, event_id, value, row_number() OVER (PARTITION BY event_type, round_even(value / 10, 0) ORDER BY value DESC, event_id) AS r, min(event_id) OVER (PARTITION BY event_type, round_even(value / 10, 0)) AS slot FROM events WHERE value IS NOT NULL)
SELECT event_type, event_id, value, slot FROM k WHERE r = 1""")
def grid_dedup_max(spark, sf):
    """SET-06, SET-08."""
    d = table(spark, sf, "events").filter("value IS NOT NULL").select("event_type", "event_id", "value")
    return text.grid_dedup(d, [F.col("event_type"), F.bround(F.col("value") / 10)], "event_id", "value")


@query("""WITH d AS (SELECT p_brand, p_size, p_partkey, p_name, round_even((p_partkey % 50)::DOUBLE, 0) AS x, round_even(p_retailprice % 50, 0) AS y, lower(trim(p_name)) AS low FROM part WHERE trim(p_name) <> ''),
l AS (SELECT p_brand, p_size, list([{'k': p_partkey, 'x': x, 'y': y, 'low': low}] ORDER BY p_partkey) AS c FROM d GROUP BY ALL),
o AS (SELECT list_reduce(c, lambda a, b: CASE WHEN len(list_filter(a, lambda e: sqrt((e.x - b[1].x) ** 2 + (e.y - b[1].y) ** 2) < 30 AND (e.low = b[1].low OR 1 - levenshtein(e.low, b[1].low) / greatest(length(e.low), length(b[1].low))::DOUBLE > 0.85))) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM l)
SELECT p_brand, p_size, p_partkey, p_name, (p_partkey % 50)::DOUBLE AS x, p_retailprice % 50 AS y FROM part WHERE p_partkey IN (SELECT unnest(kept).k FROM o)""")
def fuzzy_dedup(spark, sf):
    """SET-05: part names of each brand and size, at positions derived from key and price."""
    d = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", "p_name", (F.col("p_partkey") % 50).cast("double").alias("x"), (F.col("p_retailprice") % 50).alias("y"))
    return spatial.text_dedup(d, ["p_brand", "p_size"], "p_name", "x", "y", "p_partkey", distance=30.0)


@query("""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, 1 AS i, 0::BIGINT AS lines, 0::BIGINT AS width, 0::BIGINT AS widest FROM w WHERE len(w) > 0 UNION ALL
SELECT doc_id, w, i + 1, CASE WHEN i = 1 OR width + 1 + length(w[i]) > 40 THEN lines + 1 ELSE lines END, CASE WHEN i = 1 OR width + 1 + length(w[i]) > 40 THEN length(w[i]) ELSE width + 1 + length(w[i]) END,
 greatest(widest, CASE WHEN i = 1 OR width + 1 + length(w[i]) > 40 THEN length(w[i]) ELSE width + 1 + length(w[i]) END) FROM p WHERE i <= len(w))
SELECT d.doc_id, CAST(coalesce(max(lines), 0) AS INTEGER) AS lines, CAST(coalesce(max(widest), 0) AS INTEGER) AS widest FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def word_wrap(spark, sf):
    """STR-15: every whole text wrapped at 40. Widths are folded, not the text itself, so long texts stay linear."""
    words = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(0).alias("m"))

    def step(a, w):
        new = (a["n"] == 0) | (a["w"] + 1 + F.length(w) > 40)
        width = F.when(new, F.length(w)).otherwise(a["w"] + 1 + F.length(w))
        return F.struct(F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"), width.alias("w"), F.greatest(a["m"], width).alias("m"))

    d = table(spark, sf, "documents").select("doc_id", F.aggregate(words, start, step).alias("a"))
    return d.select("doc_id", F.col("a.n").alias("lines"), F.col("a.m").alias("widest"))


@query("""WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, w, 1 AS i, []::VARCHAR[] AS lines, '' AS line FROM w UNION ALL
SELECT item_id, w, i + 1, CASE WHEN line <> '' AND length(line) + 1 + length(w[i]) > 30 THEN list_append(lines, line) ELSE lines END, CASE WHEN line = '' THEN w[i] WHEN length(line) + 1 + length(w[i]) > 30 THEN w[i] ELSE line || ' ' || w[i] END FROM p WHERE i <= len(w)),
l AS (SELECT item_id, CASE WHEN line = '' THEN lines ELSE list_append(lines, line) END AS l FROM p WHERE i = len(w) + 1)
SELECT item_id, array_to_string(CASE WHEN len(l) <= 3 THEN l ELSE list_append(l[1:2], rtrim(left(l[3], 27)) || '...') END, chr(10)) AS body FROM l""")
def truncate_lines(spark, sf):
    """STR-15 to STR-17: benchmark passages wrapped at 30, at most three lines."""
    lines = X.word_wrap(F.col("text"), 30)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.truncate_lines(lines, 3, 30), "\n").alias("body"))


@query()
def ratcliff(spark, sf):
    """STR-08: each benchmark passage against the next."""
    b = table(spark, sf, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    d = text.sequence_similarity(b.join(nxt, "item_id").select("item_id", "text", "other"), "text", "other")
    return d.select("item_id", F.round("ratio", 6).alias("ratio"))


@query("""WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT h, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM t GROUP BY h HAVING count(*) > 1""")
def hash_duplicates(spark, sf):
    """AGG-31: groups of equal texts. Counts and ends are aggregated before the shuffle; ids aren't gathered."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("""WITH l AS (SELECT conv_id, role, count(*) AS n, string_agg(trim(text), ' ' ORDER BY turn, trim(text)) AS text FROM conversations GROUP BY conv_id, role) SELECT conv_id, role, n, md5(text) AS digest FROM l""")
def roi_text(spark, sf):
    """STR-18, SRT-05: what each role says, in order."""
    d = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.trim("text").alias("text"), F.lit(0).alias("x"), F.lit(1.0).alias("conf"))
    out = text.reading_order(d, ["conv_id", "role"], "x", "turn", "text", "conf")
    return out.join(d.groupBy("conv_id", "role").agg(F.count("*").alias("n")), ["conv_id", "role"]).select("conv_id", "role", "n", F.md5("text").alias("digest"))
