"""Queries over the drawn figures: features, panels, axes, shapes and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import colors, layout, packed, raster, shapes
from rasterlake.plans.common import query
from rasterlake.plans.drawn import HEIGHT, SQL_PIXELS, WIDTH, figure_lines, figure_pixels

_INK = "k AS (SELECT *, a > 10 AND 0.2126 * r + 0.7152 * g + 0.0722 * b < 245 AS ink, (r + g + b) / 3.0::DOUBLE / 255 AS g0, greatest(r, g, b) AS t, least(r, g, b) AS l FROM f)"


def _ink(spark, sf):
    p = figure_pixels(spark, sf)
    return p.select("image", "y", "x", X.is_ink(F.col("r"), F.col("g"), F.col("b"), F.col("a")).cast("int").alias("ink"))


def _sizes(spark, sf):
    return figure_pixels(spark, sf).filter(f"y = {HEIGHT - 1} AND x = {WIDTH - 1}").select("image", (F.col("x") + 1).alias("width"), (F.col("y") + 1).alias("height"))


def _runs(line: str, along: str) -> str:
    return f"SELECT image, {line} AS pos, min({along}) AS s, count(*) AS n FROM (SELECT image, x, y, {along} - row_number() OVER (PARTITION BY image, {line} ORDER BY {along}) AS g FROM k WHERE ink) GROUP BY image, {line}, g"


def _centers(table: str, gap: int, centre: str) -> str:
    return f"SELECT image, {centre} AS pos FROM (SELECT image, pos, sum(new) OVER (PARTITION BY image ORDER BY pos) AS c FROM (SELECT image, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY image ORDER BY pos) <= {gap} THEN 0 ELSE 1 END AS new FROM {table})) GROUP BY image, c"


@query(f"""WITH {SQL_PIXELS}, {_INK},
d AS (SELECT *, abs(lead(g0) OVER (PARTITION BY image, y ORDER BY x) - g0) AS dx, abs(lead(g0) OVER (PARTITION BY image, x ORDER BY y) - g0) AS dy, (r // 32) * 64 + (g // 32) * 8 + b // 32 AS code FROM k),
e AS (SELECT *, ink AND dx + dy > 0.08 AS edge FROM d),
m AS (SELECT image, max(x) + 1 AS width, max(y) + 1 AS height, avg(ink::INT) AS ink, sum((ink AND (t - l) / 255.0 / (t / 255.0 + 1e-6) > 0.25 AND t / 255.0 > 0.2)::INT) / greatest(sum(ink::INT), 1) AS saturated,
  coalesce(sum((edge AND (dx > dy * 2 OR dy > dx * 2))::INT) / nullif(sum(edge::INT), 0), 0) AS aligned, count(DISTINCT code) FILTER (ink) AS codes, bool_or(ink AND code = 511) AS white, sum(ink::INT) AS n,
  (max(y) FILTER (ink) - min(y) FILTER (ink) + 1) * (max(x) FILTER (ink) - min(x) FILTER (ink) + 1) AS box FROM e GROUP BY image),
v AS ({_runs('x', 'y')}), h AS ({_runs('y', 'x')}),
vl AS (SELECT image, pos FROM v GROUP BY image, pos HAVING max(n) >= floor({HEIGHT} * 0.45)), hl AS (SELECT image, pos FROM h GROUP BY image, pos HAVING max(n) >= floor({WIDTH} * 0.45)),
vc AS ({_centers('vl', 1, 'round_even(avg(pos), 0)')}), hc AS ({_centers('hl', 1, 'round_even(avg(pos), 0)')})
SELECT image, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, round(ink, 6) AS ink, round(saturated, 6) AS saturated, round(aligned, 6) AS aligned, codes + CASE WHEN box > n AND NOT white THEN 1 ELSE 0 END AS colors,
  (SELECT count(*) FROM vc WHERE vc.image = m.image) AS long_v, (SELECT count(*) FROM hc WHERE hc.image = m.image) AS long_h,
  (SELECT count(*) FROM v WHERE v.image = m.image AND v.n BETWEEN 2 AND floor({HEIGHT} * 0.08)) AS short_v, (SELECT count(*) FROM h WHERE h.image = m.image AND h.n BETWEEN 2 AND floor({WIDTH} * 0.08)) AS short_h FROM m""")
def figure_features(spark, sf):
    """AGG-01, AGG-04, AGG-05, PRJ-01: the feature vector of each drawn figure."""
    d = packed.features(figure_lines(spark, sf))
    return d.select("image", "width", "height", *[F.round(c, 6).alias(c) for c in ("ink", "saturated", "aligned")], "colors", "long_v", "long_h", "short_v", "short_h")


_PANELS = f"""s AS (SELECT image, x, sum(ink::INT) AS v FROM k GROUP BY image, x),
w AS (SELECT a.image, a.x, sum(b.v) / 32.0 AS v FROM s a, range(-16, 16) o(d), s b WHERE b.image = a.image AND b.x = greatest(0, least({WIDTH - 1}, a.x + o.d)) GROUP BY a.image, a.x),
q AS (SELECT image, min_by(x, (v, x)) FILTER (x >= {WIDTH // 3 - 76} AND x < {WIDTH // 3 + 76}) AS s1, min_by(x, (v, x)) FILTER (x >= {WIDTH * 2 // 3 - 76} AND x < {WIDTH * 2 // 3 + 76}) AS s2 FROM w GROUP BY image),
t AS (SELECT image, 'A3' AS panel, 1 AS p_ord, 0 AS lo, s1 AS up FROM q UNION ALL SELECT image, 'A4', 2, s1, s2 FROM q UNION ALL SELECT image, 'A5', 3, s2, {WIDTH} FROM q),
y AS (SELECT k.image, panel, lo, up, y FROM k JOIN t ON t.image = k.image AND k.x >= lo AND k.x < up WHERE ink AND y >= {int(HEIGHT * 0.15)} AND y < {int(HEIGHT * 0.9)} GROUP BY k.image, panel, lo, up, y HAVING count(*) > greatest(floor((up - lo) * 0.02), 4)),
panels AS (SELECT image, panel, p_ord, lo + greatest(floor((up - lo) * 0.04), 10)::DOUBLE AS x, min(y)::DOUBLE AS y, (up - lo - 2 * greatest(floor((up - lo) * 0.04), 10))::DOUBLE AS width, (max(y) - min(y))::DOUBLE AS height FROM y JOIN t USING (image, panel, lo, up) GROUP BY image, panel, p_ord, lo, up)"""


@query(f"WITH {SQL_PIXELS}, {_INK}, {_PANELS} SELECT image, panel, x, y, width, height, 'detected' AS source FROM panels")
def figure_panels(spark, sf):
    """ALG-11, AGG-02, WIN-03, WIN-05: the panels of each drawn figure."""
    return layout.detect_panels(_ink(spark, sf))


def _axis_sql(line: str, along: str) -> str:
    return f"""i{line} AS (SELECT k.image, p.panel, k.x AS kx, k.y AS ky, k.{line} AS pos, k.{along} AS v, floor(p.height * 0.5) AS least FROM k JOIN panels p ON p.image = k.image AND k.x >= floor(p.x) AND k.x < floor(p.x + p.width) AND k.y >= floor(p.y) AND k.y < floor(p.y + p.height) WHERE ink),
l{line} AS (SELECT image, panel, pos, min(v) AS a, max(v) AS b, max(n) AS longest, max(least) AS least FROM (SELECT *, count(*) OVER (PARTITION BY image, panel, pos, g) AS n FROM (SELECT *, v - row_number() OVER (PARTITION BY image, panel, pos ORDER BY v) AS g FROM i{line})) GROUP BY image, panel, pos),
m{line} AS (SELECT image, panel, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY image, panel ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM l{line} WHERE longest >= least),
c{line} AS (SELECT image, panel, CAST(floor(avg(pos)) AS BIGINT) AS pos FROM (SELECT *, sum(new) OVER (PARTITION BY image, panel ORDER BY pos) AS c FROM m{line}) GROUP BY image, panel, c)"""


@query(f"""WITH {SQL_PIXELS}, {_INK}, {_PANELS}, {_axis_sql('x', 'y')}, {_axis_sql('y', 'x')}
SELECT image, panel, 'axis_y' AS role, pos::DOUBLE AS x1, a::DOUBLE AS y1, pos::DOUBLE AS x2, b::DOUBLE AS y2 FROM cx JOIN lx USING (image, panel, pos) UNION ALL SELECT image, panel, 'axis_x', a::DOUBLE, pos::DOUBLE, b::DOUBLE, pos::DOUBLE FROM cy JOIN ly USING (image, panel, pos)""")
def figure_axes(spark, sf):
    """ALG-12, AGG-06, AGG-08, WIN-02: axis lines in the panels of each drawn figure."""
    ink = _ink(spark, sf)
    return layout.axis_lines(ink, layout.detect_panels(ink))


def _cut_sql(k: int) -> str:
    """One level of the recursive cut: tables p (profiles), g (empty stretches), w (the way that is cut) and b of the next level."""
    n = "CASE t.way WHEN 'ROW' THEN b.height ELSE b.width END"
    return f"""p{k} AS (SELECT b.image, b.path, t.way, n.pos, coalesce(v, 0) AS v, {n} AS n, by_rows FROM b{k} b CROSS JOIN (VALUES ('ROW'), ('COL')) t(way) JOIN range({max(HEIGHT, WIDTH)}) n(pos) ON n.pos < {n}
  LEFT JOIN (SELECT b.image, b.path, 'ROW' AS way, k.y - b.y AS pos, count(*) AS v FROM b{k} b JOIN k ON k.image = b.image AND k.ink AND k.x >= b.x AND k.x < b.x + b.width AND k.y >= b.y AND k.y < b.y + b.height GROUP BY ALL
    UNION ALL SELECT b.image, b.path, 'COL', k.x - b.x, count(*) FROM b{k} b JOIN k ON k.image = b.image AND k.ink AND k.x >= b.x AND k.x < b.x + b.width AND k.y >= b.y AND k.y < b.y + b.height GROUP BY ALL) c
    ON c.image = b.image AND c.path = b.path AND c.way = t.way AND c.pos = n.pos WHERE b.width >= 20 AND b.height >= 20),
q{k} AS (SELECT *, floor(quantile_cont(v, 0.1) OVER (PARTITION BY image, path, way)) + 2 AS least FROM p{k}),
r{k} AS (SELECT image, path, way, n, by_rows, min(pos) AS a, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY image, path, way ORDER BY pos) AS grp FROM q{k} WHERE v <= least) GROUP BY image, path, way, n, by_rows, grp),
g{k} AS (SELECT *, unnest(CASE WHEN n > 500 THEN [1, 2] ELSE [1] END) AS try FROM r{k} WHERE a > greatest(5, floor(n * 0.01)) AND e < n - greatest(5, floor(n * 0.01))),
h{k} AS (SELECT * FROM g{k} WHERE e - a >= CASE try WHEN 1 THEN greatest(10, floor(n * 0.02)) ELSE greatest(5, floor(n * 0.005)) END),
w{k} AS (SELECT image, path, arg_min(way, CASE WHEN (way = 'ROW') = by_rows THEN 0 ELSE 1 END) AS way FROM h{k} GROUP BY image, path),
t{k} AS (SELECT h.image, h.path, h.way, min(try) AS try FROM h{k} h JOIN w{k} w ON w.image = h.image AND w.path = h.path AND w.way = h.way GROUP BY ALL),
m{k} AS (SELECT h.image, h.path, h.way, list((a + e) // 2 ORDER BY a) AS mid, any_value(n) AS n FROM h{k} h JOIN t{k} t ON t.image = h.image AND t.path = h.path AND t.way = h.way AND t.try = h.try GROUP BY h.image, h.path, h.way),
c{k} AS (SELECT image, path, way, unnest(list_concat([0], mid)) AS a, unnest(list_concat(mid, [n])) AS e, unnest(range(len(mid) + 1)) AS i FROM m{k}),
b{k + 1} AS (SELECT c.image, list_append(c.path, c.i) AS path, c.way <> 'ROW' AS by_rows, CASE c.way WHEN 'ROW' THEN b.x ELSE b.x + c.a END AS x, CASE c.way WHEN 'ROW' THEN b.y + c.a ELSE b.y END AS y, CASE c.way WHEN 'ROW' THEN b.width ELSE c.e - c.a END AS width, CASE c.way WHEN 'ROW' THEN c.e - c.a ELSE b.height END AS height FROM c{k} c JOIN b{k} b ON b.image = c.image AND b.path = c.path)"""


_TREE = " UNION ALL ".join([*[f"SELECT b.image, b.path, {k} AS depth, coalesce(w.way, 'LEAF') AS type, x, y, width, height FROM b{k} b LEFT JOIN w{k} w ON w.image = b.image AND w.path = b.path" for k in range(5)], "SELECT image, path, 5, 'LEAF', x, y, width, height FROM b5"])


@query(f"""WITH {SQL_PIXELS}, {_INK}, b0 AS (SELECT DISTINCT image, []::BIGINT[] AS path, true AS by_rows, 0::BIGINT AS x, 0::BIGINT AS y, {WIDTH}::BIGINT AS width, {HEIGHT}::BIGINT AS height FROM k), {", ".join(map(_cut_sql, range(5)))},
tree AS ({_TREE}), numbered AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY path) - 1 AS node FROM tree)
SELECT n.image, CAST(n.node AS INTEGER) AS node, CAST(coalesce(u.node, -1) AS INTEGER) AS parent, n.type, CAST(n.depth AS INTEGER) AS depth, CAST(n.x AS INTEGER) AS x, CAST(n.y AS INTEGER) AS y, CAST(n.width AS INTEGER) AS width, CAST(n.height AS INTEGER) AS height
FROM numbered n LEFT JOIN numbered u ON u.image = n.image AND len(n.path) > 0 AND u.path = n.path[:len(n.path) - 1]""")
def figure_layout(spark, sf):
    """ALG-10, WIN-06: the tree of each drawn figure's recursive cut, level by level."""
    return packed.xy_cut(figure_lines(spark, sf))


def components_sql(source: str, keys: str = "image") -> str:
    """Recursive SQL for the 4-connected components of a table of ink pixels (keys, y, x): runs with their root."""
    return f"""runs AS (SELECT row_number() OVER (ORDER BY {keys}, y, s) AS id, * FROM (SELECT {keys}, y, min(x) AS s, max(x) AS e FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS g FROM {source}) GROUP BY {keys}, y, g)),
links AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b USING ({keys}) WHERE b.y = a.y + 1 AND a.s <= b.e AND b.s <= a.e), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS root FROM runs UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id WHERE ways.b > reach.root), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
parts AS (SELECT {keys}, root, min(s) AS x, min(y) AS y, max(e) - min(s) + 1 AS width, max(y) - min(y) + 1 AS height, sum(e - s + 1) AS area FROM runs JOIN roots USING (id) GROUP BY {keys}, root)"""


@query(f"""WITH RECURSIVE {SQL_PIXELS}, red AS (SELECT image, y, x FROM f WHERE r > 150 AND g < 100 AND b < 100 AND a > 10), {components_sql('red')}
SELECT image, x + width / 2.0::DOUBLE AS x, y + height / 2.0::DOUBLE AS y, greatest(width, height) / 2.0::DOUBLE AS radius FROM parts WHERE area >= 6 AND width BETWEEN 2 AND 30 AND height BETWEEN 2 AND 30""")
def figure_markers(spark, sf):
    """FLT-10: red markers."""
    return shapes.markers(figure_pixels(spark, sf))


@query(f"""WITH RECURSIVE {SQL_PIXELS}, {_INK}, i AS (SELECT image, y, x FROM k WHERE ink), {components_sql('i')}
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY y, x, width, height) AS INTEGER) AS ord, x, y, width, height, CAST(area AS BIGINT) AS area FROM parts WHERE area BETWEEN {int(WIDTH * HEIGHT * 0.00005)} AND {int(WIDTH * HEIGHT * 0.02)}
AND least(width, height) >= 3 AND width <= {WIDTH * 0.6} AND height <= {HEIGHT * 0.4} AND width / height BETWEEN 0.2 AND 12""")
def figure_text_boxes(spark, sf):
    """FLT-09, ALG-01: boxes of lettering, in reading order."""
    ink = _ink(spark, sf)
    return shapes.text_boxes(raster.components(ink, "ink"), _sizes(spark, sf))


@query(f"""WITH {SQL_PIXELS}, e AS (SELECT CAST(r_regionkey AS BIGINT) AS image, e, CASE e WHEN 0 THEN 190 WHEN 1 THEN 20 WHEN 2 THEN 317 ELSE 60 END AS ex, CASE e WHEN 0 THEN 300 WHEN 1 THEN 60 WHEN 2 THEN 184 ELSE 30 END AS ey FROM region, range(4) t(e)),
n AS (SELECT e.image, e, y, x FROM e JOIN f ON f.image = e.image AND x >= ex - 12 AND x < ex + 12 AND y >= ey - 12 AND y < ey + 12 WHERE a > 10 AND (r + g + b) / 3.0 < 200),
o AS (SELECT image, e, y, unnest(CASE WHEN min(x) = max(x) THEN [min(x)] ELSE [min(x), max(x)] END) AS x FROM n GROUP BY image, e, y),
s AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS cy FROM o WINDOW w AS (PARTITION BY image, e ORDER BY y, x)),
c AS (SELECT image, e, count(*) AS points, count(*) FILTER (degrees(acos(greatest(-1, least(1, (ax * bx + ay * cy) / sqrt(ax * ax + ay * ay) / sqrt(bx * bx + cy * cy))))) > 30) AS turns FROM s GROUP BY image, e),
d AS (SELECT image, e, count(*) AS area, greatest(max(x) - min(x), 1) AS w, greatest(max(y) - min(y), 1) AS h FROM n GROUP BY image, e),
v AS (SELECT e.image, e.e, coalesce(area, 0) AS area, coalesce(w / h, 1.0::DOUBLE) AS aspect, coalesce(area / (w * h), 0.0::DOUBLE) AS solidity, coalesce(CASE WHEN points < 4 THEN points ELSE least(turns + 2, 8) END, 0) AS v FROM e LEFT JOIN d USING (image, e) LEFT JOIN c USING (image, e)),
k AS (SELECT *, CASE WHEN area < 6 THEN 'none' WHEN v = 3 OR v = 4 AND solidity > 0.4 THEN CASE WHEN solidity > 0.6 THEN 'triangle' ELSE 'triangle_open' END WHEN aspect > 0.8 AND aspect < 1.2 AND solidity > 0.7 THEN 'dot'
  WHEN v = 2 OR solidity < 0.3 AND aspect > 1.5 THEN 'line' WHEN v = 4 AND aspect > 0.7 AND aspect < 1.3 AND solidity > 0.5 THEN 'diamond' ELSE 'plain' END AS kind FROM v)
SELECT image, CAST(e AS INTEGER) AS "end", replace(kind, 'plain', 'triangle') AS kind, round(CASE WHEN area < 6 THEN 0 ELSE sqrt(area) * 1.5 END, 4) AS size,
  round(CASE kind WHEN 'none' THEN 0.9 WHEN 'triangle' THEN 0.8 + 0.1 * solidity WHEN 'triangle_open' THEN 0.7 WHEN 'dot' THEN 0.75 WHEN 'line' THEN 0.6 WHEN 'diamond' THEN 0.65 ELSE 0.5 END, 4) AS confidence FROM k""")
def figure_arrow_heads(spark, sf):
    """ALG-14, AGG-32, WIN-20, PRJ-03: what stands at an axis's ends, on a marker and in lettering."""
    places = F.array(*[F.struct(F.lit(e).alias("end"), F.lit(x).alias("x"), F.lit(y).alias("y")) for e, (x, y) in enumerate(((190, 300), (20, 60), (317, 184), (60, 30)))])
    ends = _sizes(spark, sf).select("image", F.explode(places).alias("p")).select("image", "p.*")
    d = shapes.arrow_heads(figure_pixels(spark, sf), ends)
    return d.select("image", "end", "kind", F.round("size", 4).alias("size"), F.round("confidence", 4).alias("confidence"))


_HUE = "u AS (SELECT *, CASE WHEN t = l THEN 0 WHEN t = b THEN 60 * ((r - g) / (t - l) + 4) WHEN t = g THEN 60 * ((b - r) / (t - l) + 2) ELSE 60 * ((g - b) / (t - l) + CASE WHEN g < b THEN 6 ELSE 0 END) END AS hue, CASE WHEN t = 0 THEN 0 ELSE (t - l) / t END AS sat, t / 255 AS val FROM k)"


@query(f"""WITH {SQL_PIXELS}, {_INK}, {_HUE}, n AS (SELECT image, CAST(floor(hue / 10) AS INTEGER) AS bin, count(*) AS n FROM u WHERE sat > 0.25 AND val > 0.2 AND val < 0.95 GROUP BY image, bin),
b AS (SELECT a.image, i AS bin, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT image FROM n) a CROSS JOIN range(36) t(i) LEFT JOIN n ON n.image = a.image AND n.bin = i),
p AS (SELECT x.image, x.bin FROM b x JOIN b y ON y.image = x.image AND y.bin = (x.bin + 1) % 36 JOIN b z ON z.image = x.image AND z.bin = (x.bin + 35) % 36 JOIN (SELECT image, sum(n) AS total FROM n GROUP BY image) s ON s.image = x.image WHERE total >= 50 AND x.n >= greatest(50, total * 0.05) AND x.n >= y.n AND x.n >= z.n),
g AS (SELECT image, list_reduce(list([bin * 10.0::DOUBLE + 5] ORDER BY bin), lambda found, c: CASE WHEN len(list_filter(found, lambda e: least(abs(e - c[1]), 360 - abs(e - c[1])) < 20)) > 0 THEN found ELSE list_concat(found, c) END) AS hues FROM p GROUP BY image)
SELECT image, unnest(hues) AS hue FROM g""")
def figure_hues(spark, sf):
    """WIN-19, AGG-10, PRJ-05: the dominant hues of each drawn figure."""
    return colors.dominant_hues(figure_pixels(spark, sf), ["image"])


@query(f"""WITH RECURSIVE {SQL_PIXELS}, {_INK}, {_HUE}, t AS (SELECT unnest(['serving', 'neighbor', 'none']) AS curve, unnest([220, 30, 120]) AS target),
base AS (SELECT u.*, lim FROM u CROSS JOIN (SELECT unnest([1, 2]) AS lim) WHERE a > 10 AND sat >= CASE lim WHEN 1 THEN 0.25 ELSE 0.25 * 0.6 END AND val >= CASE lim WHEN 1 THEN 0.2 ELSE 0.2 * 0.6 END),
bins AS (SELECT image, lim, floor(hue / 10) % 36 AS bin, count(*) AS n FROM base GROUP BY ALL), tol AS (SELECT unnest([1, 2]) AS lim, unnest([22.0, 30.8]) AS tol),
ctr AS (SELECT r_regionkey AS image, t.curve, tol.lim, tol, coalesce(min_by(bin * 10 + 5, (-n, bin)) FILTER (least(abs(bin * 10 + 5 - target), 360 - abs(bin * 10 + 5 - target)) <= 2 * tol), any_value(target)) AS c FROM region CROSS JOIN t CROSS JOIN tol LEFT JOIN bins ON bins.image = r_regionkey AND bins.lim = tol.lim GROUP BY ALL),
hit AS (SELECT base.image, ctr.curve, base.lim, y, x FROM base JOIN ctr ON ctr.image = base.image AND ctr.lim = base.lim WHERE least(abs(hue - c), 360 - abs(hue - c)) <= tol),
few AS (SELECT r_regionkey AS image, t.curve, count(hit.x) < {int(WIDTH * HEIGHT * 0.0005)} AS few FROM region CROSS JOIN t LEFT JOIN hit ON hit.image = r_regionkey AND hit.curve = t.curve AND lim = 1 GROUP BY ALL),
mask AS (SELECT hit.image, hit.curve, y, x FROM hit JOIN few USING (image, curve) WHERE lim = CASE WHEN few THEN 2 ELSE 1 END),
grown AS (SELECT DISTINCT image, curve, y + dy AS y, x + dx AS x FROM mask, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1}),
closed AS (SELECT g.image, g.curve, g.y, g.x FROM grown g JOIN grown o ON o.image = g.image AND o.curve = g.curve AND o.y BETWEEN g.y - 1 AND g.y + 1 AND o.x BETWEEN g.x - 1 AND g.x + 1 GROUP BY ALL HAVING count(*) = (3 - (g.y = 0)::INT - (g.y = {HEIGHT - 1})::INT) * (3 - (g.x = 0)::INT - (g.x = {WIDTH - 1})::INT)),
{components_sql('closed', 'image, curve')}
SELECT runs.image, runs.curve, CAST(sum(e - s + 1) AS BIGINT) AS n, CAST(sum(runs.y * (e - s + 1)) AS BIGINT) AS ys, CAST(sum((s + e) * (e - s + 1)) AS BIGINT) AS xs FROM runs JOIN roots USING (id) JOIN parts ON parts.root = roots.root WHERE area >= 30 GROUP BY runs.image, runs.curve""")
def figure_curve_masks(spark, sf):
    """ALG-04, ALG-03, SET-10, PRJ-06: masks of two curves' colours and of one that no figure has."""
    sizes = figure_lines(spark, sf).select("image").distinct()
    curves = sizes.select("image", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.lit(h).alias("target")) for c, h in (("serving", 220.0), ("neighbor", 30.0), ("none", 120.0))])).alias("c")).select("image", "c.*")
    runs = packed.curve_runs(figure_lines(spark, sf), curves)
    return runs.groupBy("image", "curve").agg(F.sum("len").alias("n"), F.sum(F.col("y") * F.col("len")).alias("ys"), F.sum((2 * F.col("start") + F.col("len") - 1) * F.col("len")).alias("xs"))


def _hex(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"printf('#%02x%02x%02x', {r}, {g}, {b})"


@query(f"""WITH {SQL_PIXELS}, c AS (SELECT image, {_hex()} AS color, count(*) AS n FROM f WHERE (x BETWEEN 20 AND 59 AND (x - 20) % 3 = 0 OR x BETWEEN {WIDTH - 60} AND {WIDTH - 21} AND (x - {WIDTH - 60}) % 3 = 0) AND (y BETWEEN 20 AND 59 AND (y - 20) % 3 = 0 OR y BETWEEN {HEIGHT - 60} AND {HEIGHT - 21} AND (y - {HEIGHT - 60}) % 3 = 0) GROUP BY ALL)
SELECT image, max_by(color, (n, color)) AS color FROM c GROUP BY image""")
def figure_background(spark, sf):
    """AGG-16, AGG-15: the colour of the paper."""
    return colors.background(figure_pixels(spark, sf), _sizes(spark, sf))


_SAMPLED = "c AS (SELECT p.image, p.panel, r, g, b, count(*) AS n FROM f JOIN {box} p ON p.image = f.image AND f.x >= p.x AND f.x < p.x + p.width AND f.y >= p.y AND f.y < p.y + p.height AND (f.x - p.x) % {step} = 0 AND (f.y - p.y) % {step} = 0 GROUP BY ALL)"


@query(f"""WITH {SQL_PIXELS}, {_INK}, {_PANELS}, pf AS (SELECT image, panel, floor(x) AS x, floor(y) AS y, floor(width) AS width, floor(height) AS height FROM panels),
inner_ AS (SELECT image, panel, x + floor(width * 0.1) AS x, y + floor(height * 0.1) AS y, width - 2 * floor(width * 0.1) AS width, height - 2 * floor(height * 0.1) AS height FROM pf),
fills AS (WITH {_SAMPLED.format(box='inner_', step=10)} SELECT image, panel, max_by({_hex()}, (n, -r, -g, -b)) FILTER (NOT (r <= 30 AND g <= 30 AND b <= 30)) AS fill FROM c GROUP BY ALL),
curves AS (WITH {_SAMPLED.format(box='pf', step=5)} SELECT image, panel, string_agg({_hex()}, ',' ORDER BY n DESC, r, g, b) AS curves FROM c WHERE NOT (r >= 245 AND g >= 245 AND b >= 245) AND NOT (r <= 30 AND g <= 30 AND b <= 30) AND r + g + b <= 700 GROUP BY ALL)
SELECT image, panel, fill, curves FROM fills JOIN curves USING (image, panel)""")
def figure_panel_colors(spark, sf):
    """AGG-17, PRJ-09: fill and curve colours of each panel."""
    p, boxes = figure_pixels(spark, sf), layout.detect_panels(_ink(spark, sf))
    fills, curves = colors.panel_fills(p, boxes), colors.curve_colors(p, boxes)
    return fills.select("image", "panel", F.col("color").alias("fill")).join(curves.select("image", "panel", F.array_join("colors", ",").alias("curves")), ["image", "panel"])


@query(f"""WITH {SQL_PIXELS}, {_INK}, {_PANELS}, st AS (SELECT image, panel, floor(x) AS x, floor(y) AS y, floor(width) AS w, floor(height) AS h, greatest(5, floor(floor(height) / 50)) AS s FROM panels),
c AS (SELECT st.image, panel, h, s, floor((f.y - st.y) / s) AS k, r, g, b, count(*) AS n FROM f JOIN st ON st.image = f.image AND f.x >= st.x AND f.x < st.x + w AND (f.x - st.x) % 5 = 0 AND f.y >= st.y AND f.y < st.y + h WHERE NOT (r >= 250 AND g >= 250 AND b >= 250) AND NOT (r <= 30 AND g <= 30 AND b <= 30) GROUP BY ALL),
led AS (SELECT image, panel, h, s, k, arg_max(r, (n, -r, -g, -b)) AS r, arg_max(g, (n, -r, -g, -b)) AS g, arg_max(b, (n, -r, -g, -b)) AS b FROM c WHERE k * s < h - s GROUP BY ALL),
m AS (SELECT *, CASE WHEN k - lag(k) OVER w = 1 AND sqrt((r - lag(r) OVER w) ** 2 + (g - lag(g) OVER w) ** 2 + (b - lag(b) OVER w) ** 2) < 30 THEN 0 ELSE 1 END AS new FROM led WINDOW w AS (PARTITION BY image, panel ORDER BY k)),
o AS (SELECT *, sum(new) OVER (PARTITION BY image, panel ORDER BY k) AS band FROM m)
SELECT image, panel, CAST(min(k * s) AS BIGINT) AS y, CAST((max(k) - min(k) + 1) * any_value(s) AS BIGINT) AS height, min_by({_hex()}, k) AS fill FROM o GROUP BY image, panel, band HAVING (max(k) - min(k) + 1) * any_value(s) >= any_value(h) * 0.05""")
def figure_bands(spark, sf):
    """WIN-14: colour bands over the strips of each panel."""
    return colors.bands(figure_pixels(spark, sf), layout.detect_panels(_ink(spark, sf)))


@query(f"""WITH {SQL_PIXELS}, d AS (SELECT image, panel, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM f JOIN (SELECT unnest(['A3', 'A4', 'A5']) AS panel, unnest([85, 303, 450]) AS x0, unnest([140, 351, 470]) AS x1) ON x >= x0 AND x < x1 WHERE y >= 62 AND y < 298 GROUP BY ALL),
t AS (SELECT image, panel, CASE WHEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) < 0.05 THEN NULL WHEN b - r > 0.05 AND b >= g THEN '#d9d3e8' ELSE '#f2e6b8' END AS fill FROM d),
n AS (SELECT image, fill, count(*) AS n, min(panel) AS p FROM t WHERE fill IS NOT NULL GROUP BY ALL)
SELECT image, panel, fill, (SELECT min_by(fill, (-n, p)) FROM n WHERE n.image = t.image) AS common FROM t""")
def figure_time_fills(spark, sf):
    """AGG-13, AGG-19: bucket of the mean colour of a region of each panel, and the most frequent one of the figure."""
    places = F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(a).alias("x0"), F.lit(62).alias("y0"), F.lit(b).alias("x1"), F.lit(298).alias("y1")) for p, a, b in (("A3", 85, 140), ("A4", 303, 351), ("A5", 450, 470))])
    fills = colors.time_fill(figure_pixels(spark, sf), _sizes(spark, sf).select("image", F.explode(places).alias("p")).select("image", "p.*"))
    return fills.join(colors.common_fill(fills), ["image", "panel"])


@query(f"""WITH {SQL_PIXELS}, {_INK}, {_HUE}, t AS (SELECT item, 30 + 37 * item AS x0, 40 + 53 * (item % 5) AS y0 FROM range(16) t(item)), m AS (SELECT image, item, count(*) AS n, median(hue) AS hue FROM u JOIN t ON x >= x0 AND x < x0 + 24 AND y >= y0 AND y < y0 + 30 WHERE sat > 0.3 AND val > 0.2 AND val < 0.9 GROUP BY ALL),
c AS (SELECT r_regionkey AS image, t.item, CASE WHEN n < 6 THEN NULL WHEN abs(hue - 220) <= 25 THEN '#2b6cb0' WHEN abs(hue - 30) <= 20 THEN '#dd6b20' END AS estimated FROM region CROSS JOIN t LEFT JOIN m ON m.image = r_regionkey AND m.item = t.item)
SELECT CAST(image AS BIGINT) AS image, item, CASE item % 4 WHEN 1 THEN '#2b6cb0' WHEN 2 THEN '#dd6b20' WHEN 3 THEN '#000000' ELSE coalesce(estimated, '#000000') END AS fill, coalesce(estimated, '-') AS estimated FROM c""")
def figure_text_colors(spark, sf):
    """AGG-14, CLS-06: colours of lettering in sixteen boxes, some of them curve labels or not drawn."""
    texts = _sizes(spark, sf).select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("item")).select("image", "item", (30 + 37 * F.col("item")).alias("x"), (40 + 53 * (F.col("item") % 5)).alias("y"), F.lit(24).alias("width"), F.lit(30).alias("height"))
    kind = F.col("item") % 4
    role = F.when(kind == 1, "curve_label_serving").when(kind == 2, "curve_label_neighbor").otherwise("annotation")
    d = colors.text_color(figure_pixels(spark, sf), texts)
    return d.select("image", "item", colors.label_color(role, kind != 3, F.col("color"), F.lit("#000000")).alias("fill"), F.coalesce("color", F.lit("-")).alias("estimated"))


def _dash_sql(line: str, along: str, extent: int) -> str:
    return f"""SELECT image, '{line}' AS axis, pos, min(s) AS a, max(s + n) AS b, count(*) AS n, round(sum(n) / count(*), 4) AS dash, round((max(s + n) - min(s) - sum(n)) / greatest(count(*) - 1, 1), 4) AS gap FROM ({_runs(line, along)}) WHERE n BETWEEN 6 AND 40 GROUP BY image, pos
HAVING count(*) >= 6 AND max(s + n) - min(s) >= {extent} * 0.6 AND sum(n) / (max(s + n) - min(s)) BETWEEN 0.02 AND 0.35 AND (max(s + n) - min(s) - sum(n)) / (count(*) - 1) > 3"""


@query(f"WITH {SQL_PIXELS}, {_INK} {_dash_sql('x', 'y', HEIGHT)} UNION ALL {_dash_sql('y', 'x', WIDTH)}")
def figure_dashes(spark, sf):
    """FLT-11, AGG-09: lines of dashes, by run length, count, span, coverage and gap."""
    d = colors.dash_lines(_ink(spark, sf))
    return d.select("image", "axis", F.col("at").alias("pos"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n", F.round("dash", 4).alias("dash"), F.round("gap", 4).alias("gap"))


@query(f"""WITH {SQL_PIXELS}, w AS (SELECT image, y, x, CASE WHEN a = 0 THEN 255 ELSE r END AS r, CASE WHEN a = 0 THEN 255 ELSE g END AS g, CASE WHEN a = 0 THEN 255 ELSE b END AS b FROM f),
h AS (SELECT p.image, p.y, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS heat FROM w p JOIN w q ON q.image = p.image + 1 AND q.x = p.x AND q.y = p.y)
SELECT image, y, CAST(sum(heat) AS BIGINT) AS heat, count(*) FILTER (heat > 10) AS bad FROM h GROUP BY image, y""")
def figure_heat(spark, sf):
    """GAT-04, GAT-01: heat of the difference between each figure and the next, by line."""
    p = figure_pixels(spark, sf)
    d = raster.heat_map(p, p.withColumn("image", F.col("image") - 1), 10)
    return d.groupBy("image", "y").agg(F.sum("heat").alias("heat"), F.count_if("bad").alias("bad"))


_SIGMA = 1.2


def _blur_sql(source: str, line: str, along: str) -> str:
    weights = packed.kernel(_SIGMA)
    reach = len(weights) // 2
    part = lambda c, i, w: f"{w} * coalesce({'lag' if i < 0 else 'lead'}({c}, {abs(i)}) OVER o, {'first' if i < 0 else 'last'}_value({c}) OVER e)"
    each = [f"(({' + '.join(part(c, i - reach, w) for i, w in enumerate(weights))}) + 32768) // 65536 AS {c}" for c in "rgba"]
    return f"SELECT image, y, x, {', '.join(each)} FROM {source} WINDOW o AS (PARTITION BY image, {line} ORDER BY {along}), e AS (PARTITION BY image, {line} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"""WITH {SQL_PIXELS}, l AS ({_blur_sql('f', 'y', 'x')}), m AS ({_blur_sql('l', 'x', 'y')}), u AS (SELECT * FROM m WHERE image % 2 = 0 UNION ALL SELECT * FROM f WHERE image % 2 = 1)
SELECT image, CAST(y AS INTEGER) AS y, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g * (x % 97)) AS BIGINT) AS g, CAST(sum(b * (x % 89)) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM u GROUP BY image, y""")
def figure_blur(spark, sf):
    """PRJ-12, ORC-07: every second drawn figure under a Gaussian blur, by line."""
    lines = figure_lines(spark, sf)
    sigmas = lines.select("image").distinct().select("image", F.when(F.col("image") % 2 == 0, _SIGMA).alias("sigma"))
    p = packed.unpack(packed.blurred(lines, sigmas, 2.0))
    return p.groupBy("image", "y").agg(F.sum("r").alias("r"), F.sum(F.col("g") * (F.col("x") % 97)).alias("g"), F.sum(F.col("b") * (F.col("x") % 89)).alias("b"), F.sum("a").alias("a"))


@query(f"""WITH {SQL_PIXELS}, s AS (SELECT image, y, sum(r + g + b + a) AS total, count(*) AS n FROM f GROUP BY image, y) SELECT image, y, CAST(total AS BIGINT) AS total, n FROM s""")
def figure_png(spark, sf):
    """SRC-01 to SRC-03, SRC-19: the drawn figures written as PNG files and read again, by line of pixels."""
    from rasterlake.sources import images

    path = images.write_figures(figure_pixels(spark, sf), images.work_folder(spark))
    d = images.pixels(spark, path).withColumn("image", F.regexp_extract("image", r"(\d+)[.]png$", 1).cast("long"))
    return d.groupBy("image", F.col("y").cast("long").alias("y")).agg(F.sum(F.col("r") + F.col("g") + F.col("b") + F.col("a")).cast("long").alias("total"), F.count("*").alias("n"))
