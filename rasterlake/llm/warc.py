"""Operator 4: resolving not-modified revisit records, in DataFrame functions only.

A revisit has no body: it says that a capture equals an earlier response. Each is joined, by canonical URL
and as of its time, to the latest earlier full response; its validators are checked against that response,
and the response's headers are updated with those that a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm import work

RANGE_ROWS = 200_000  # records a range of time, over all URLs
MAX_RANGES = 4096  # 32 KB of bounds in the plan
#: Headers that describe the stored body or the connection: a not-modified answer never replaces them (fixed values).
KEPT_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
INDEX_PAGE = "index[.](?:[xs]?html?|php[0-9]?|aspx?|jspx?|cgi)|default[.](?:html?|aspx?)"
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: F.Column) -> F.Column:
    """Scheme, user, www. or m. prefix, default port, fragment, tracking parameters, index page suffix and
    closing slashes go; letters A-Z of the host become small, path and query stay as they are. Null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.translate(F.regexp_extract(u, "^[^/?]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    u = F.regexp_replace(F.concat(host, F.regexp_replace(u, "^[^/?]*", "")), "^(www[.]|m[.])", "")
    u = F.regexp_replace(u, "^([^/?:]+):(80|443)([/?]|$)", "$1$3")
    u = F.regexp_replace(u, f"([?&])({TRACKING})=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "&&+", "&"), "[?]&+", "?"), "[?&]+$", "")
    u = F.regexp_replace(u, f"^([^?]*/)(?i:{INDEX_PAGE})([?]|$)", "$1$2")
    return F.regexp_replace(u, "/+$", "")


def _lowered(headers: F.Column) -> F.Column:
    """Headers with small names and without nulls; of names that then repeat, the value that sorts last."""
    pairs = F.array_sort(F.filter(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["value"].isNotNull()))
    last = F.filter(pairs, lambda e, i: (i == F.size(pairs) - 1) | (F.try_element_at(pairs, i + 2)["key"] != e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _time_ranges(known: DataFrame, rows: int) -> list[int]:
    """Times that cut the records into ranges of about as many rows each (approximate percentiles, which are
    aggregated before the shuffle): a burst of captures gets as many ranges as its rows ask for."""
    n = known.count()
    ranges = min(MAX_RANGES, -(-n // rows))
    if ranges < 2:
        return []
    at = [k / ranges for k in range(1, ranges)]
    return sorted(set(known.select(F.percentile_approx("ts", at, 10 * ranges)).first()[0]))


def _range_of(ts: Column, bounds: list[int]) -> Column:
    """How many bounds are at or before ts, by halving."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    fits = lambda place: (place <= len(bounds)) & (F.try_element_at(table, place) <= ts)
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(fits(i + step), i + step).otherwise(i))


def resolve_revisits(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, target_id, verdict, status, headers, digest.

    records: record_id long, url string, ts long, kind ('response' or 'revisit'; others play no part),
    status int, headers map<string,string>, digest string (of the body). A full response has status 200.
    verdict: 'resolved' (at least one validator, etag or last-modified, is on both sides and none
    differs; weak etags compare without W/), 'unvalidated' (none on both sides), 'mismatch', or 'orphan' (no earlier
    full response, or a null url or ts). Only 'resolved' carries status, merged headers and digest of the
    target. Equal times aren't earlier; of responses at one time the largest record_id is the latest. Repeated
    revisits are resolved each. Other columns aren't read.

    One URL may hold most rows, and most of these in a burst: times are cut into ranges of about range_rows records
    (at most MAX_RANGES of them), the latest response of each (URL, range) is aggregated before the shuffle and
    carried on, and each (URL, range) is ordered by itself. Only records of one URL and one time stay together."""
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("kind").alias("kind"),
        F.col("status").cast("int").alias("status"), _lowered(F.col("headers")).alias("headers"), F.col("digest").alias("digest"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    r = r.filter((F.col("kind") == "revisit") | full)
    bounds = _time_ranges(records.select(F.col("ts").cast("long").alias("ts"), "kind", "status").filter("ts IS NOT NULL AND (kind = 'revisit' OR kind = 'response' AND status = 200)"), range_rows)
    r = r.withColumn("bucket", _range_of(F.col("ts"), bounds))
    known = r.filter(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    body = F.struct("ts", "record_id", "headers", "digest", "status")
    key = F.struct("ts", "record_id")
    latest = known.filter(full).groupBy("url_key", "bucket").agg(F.max_by(body, key).alias("own"))
    # ranges without responses but with revisits need what was carried too
    ranges = known.select("url_key", "bucket").groupBy("url_key", "bucket").agg(F.count("*").alias("c")).join(latest, ["url_key", "bucket"], "left")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("url_key", "bucket", F.last("own", ignorenulls=True).over(before).alias("carried"))
    near = Window.partitionBy("url_key", "bucket").orderBy("ts", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    # at one time revisits come first, so a response at the same time isn't seen
    seen = known.withColumn("near", F.last(F.when(full, body), ignorenulls=True).over(near)).filter("kind = 'revisit'")
    seen = seen.join(carried, ["url_key", "bucket"], "left").withColumn("target", F.coalesce("near", "carried")).drop("near", "carried")
    lost = r.filter("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)").withColumn("target", F.lit(None).cast(seen.schema["target"].dataType))
    both = seen.select("record_id", "url_key", "ts", "headers", "target").unionByName(lost.select("record_id", "url_key", "ts", "headers", "target"))
    mine, theirs = F.col("headers"), F.col("target.headers")

    def same(name: str, clean) -> F.Column:
        return clean(F.try_element_at(mine, F.lit(name))) == clean(F.try_element_at(theirs, F.lit(name)))

    tag = same("etag", lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    date = same("last-modified", F.trim)
    verdict = F.when(F.col("target").isNull(), "orphan").when(~tag | ~date, "mismatch").when(tag | date, "resolved").otherwise("unvalidated")
    changes = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(changes, k)), changes)
    good = F.col("verdict") == "resolved"
    return both.withColumn("verdict", verdict).select(
        "record_id", "url_key", "ts", F.col("target.record_id").alias("target_id"), "verdict", F.when(good, F.col("target.status")).alias("status"), F.when(good, merged).alias("headers"), F.when(good, F.col("target.digest")).alias("digest")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records of pages: a full response for each, and a revisit some time after it. Two of three
    revisits name the body by etag (every fifth of them an outdated one), the others by date."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("md5"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    day = F.col("id").cast("string")
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("ETag"), text('"', F.col("md5"), '"'), F.lit("Last-Modified"), text("day ", day), F.lit("Date"), text("at ", day), F.lit("Server"), F.lit("one"))
    old = F.when(F.col("id") % 5 == 4, F.lit('"old"')).otherwise(text('W/"', F.col("md5"), '"'))
    named = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("last-modified"), text("day ", day))).otherwise(F.create_map(F.lit("etag"), old))
    revisit = F.map_concat(named, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), text("later than ", day), F.lit("cache-control"), F.lit("max-age=60")))
    a = p.select((2 * F.col("id")).alias("record_id"), "url", (10 * F.col("id")).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), response.alias("headers"), F.col("md5").alias("digest"))
    b = p.select((2 * F.col("id") + 1).alias("record_id"), "url", (10 * F.col("id") + 5 + 10 * (F.col("id") % 7)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), revisit.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return a.union(b)


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's revisit, resolved against all pages' responses."""
    out = resolve_revisits(page_records(work.read(spark, sf_dir, "pages")))
    head = lambda name: F.try_element_at("headers", F.lit(name)).alias(name.replace("-", "_"))
    return out.select("record_id", "url_key", "ts", "target_id", "verdict", F.coalesce("status", F.lit(0)).alias("status"), "digest", head("content-length"), head("etag"), head("date"), head("cache-control"), head("server"), F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"))


ORACLE = rf"""
WITH s AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM pages),
u AS (SELECT page_id AS id, md5(coalesce(html, '')) AS h, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  translate(regexp_extract(bare, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(bare, '^[^/?]*', ''), '^(www[.]|m[.])', ''), '^([^/?:]+):(80|443)([/?]|$)', '\1\3'),
  '([?&])({TRACKING})=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+$', ''), '/+$', '') AS k FROM s),
a AS (SELECT k, 10 * id AS ts, 2 * id AS record_id, h, size, id FROM u),
b AS (SELECT k, 10 * id + 5 + 10 * (id % 7) AS ts, 2 * id + 1 AS record_id, h, id, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 5 = 4 THEN '"old"' ELSE '"' || h || '"' END END AS tag FROM u),
j AS (SELECT b.record_id, b.k, b.ts, b.id, b.tag, b.h, a.record_id AS target_id, a.h AS ah, a.size, a.id AS aid FROM b ASOF LEFT JOIN a ON b.k = a.k AND b.ts > a.ts),
v AS (SELECT *, CASE WHEN target_id IS NULL THEN 'orphan' WHEN tag IS NOT NULL AND tag <> '"' || ah || '"' OR tag IS NULL AND id <> aid THEN 'mismatch' ELSE 'resolved' END AS verdict FROM j)
SELECT record_id, k AS url_key, ts, target_id, verdict, CASE WHEN verdict = 'resolved' THEN 200 ELSE 0 END AS status, CASE WHEN verdict = 'resolved' THEN ah END AS digest,
  CASE WHEN verdict = 'resolved' THEN size END AS content_length, CASE WHEN verdict = 'resolved' THEN CASE WHEN tag IS NOT NULL THEN 'W/' || tag ELSE '"' || ah || '"' END END AS etag,
  CASE WHEN verdict = 'resolved' THEN 'later than ' || id END AS date, CASE WHEN verdict = 'resolved' THEN 'max-age=60' END AS cache_control,
  CASE WHEN verdict = 'resolved' THEN 'one' END AS server, CAST(CASE WHEN verdict = 'resolved' THEN 7 ELSE 0 END AS INTEGER) AS n_headers FROM v
"""
