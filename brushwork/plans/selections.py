"""Selections over line items and events: brushes, lassos, series tests, cubes."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ..operators import grid
from ..operators.ordered import once
from ..selection import cube as cubes, degree, lasso, log, series
from ..selection import views as view_counts
from ..selection import values as v
from ..selection.model import All, Any, Not, Selections, Use, columns, cross_filter, membership, predicate, producer
from ..selection.model import degree as soft_degree
from ..selection.pixels import PixelGrid
from .data import FEED, POINTS, feed, points, r
from .grids import ring_open_sql, ring_sql

# Three views of the same points, with 2 px cells on 500 px plots.
QUANTITY = PixelGrid((0.0, 50.0), (0.0, 500.0), 0.0, 2.0)
PRICE = PixelGrid((0.0, 105000.0), (500.0, 0.0), 0.0, 2.0)  # drawn upwards: decreasing
DAY = PixelGrid((0.0, 2500.0), (20.0, 520.0), 0.0, 4.0)

P_QUANTITY = producer("brush", "quantity", "interval", {"q": "y"}, {"q": QUANTITY})
P_PRICE = producer("brush", "price", "interval", {"p": "x"}, {"p": PRICE})
P_DAY = producer("brush", "day", "interval", {"d": "z"}, {"d": DAY})

BRUSHES = (
    Selections({"brush": "intersect"})
    .set(P_QUANTITY, [{"q": v.range_(10.0, 30.5)}])
    .set(P_PRICE, [{"p": v.range_(20000.0, 61234.5, "both")}])
    .set(P_DAY, [{"d": v.range_(400.0, 1500.0), }, {"d": v.range_(1800.0, 2000.0, "neither")}])
)


def sql_cell(c: str, g: PixelGrid) -> str:
    """The pixel cell as SQL, with the same operations in the same order."""
    (d0, d1), (r0, r1) = g.domain, g.range
    p = f"CAST(CAST((({c}) - {d0!r}::DOUBLE) / {d1 - d0!r}::DOUBLE * {r1 - r0!r}::DOUBLE + {r0!r}::DOUBLE AS FLOAT) AS DOUBLE)"
    return f"CAST(floor(({p} - {g.origin!r}::DOUBLE) / {g.size!r}::DOUBLE) AS BIGINT)"


def sql_range(c: str, g: PixelGrid, lo, hi, lo_in=True, hi_in=False) -> str:
    """A brush on cells: ends map through the same SQL; a decreasing grid swaps them."""
    cell, a, b = sql_cell(c, g), sql_cell(repr(lo) + "::DOUBLE", g), sql_cell(repr(hi) + "::DOUBLE", g)
    if g.decreasing:
        a, b, lo_in, hi_in = b, a, hi_in, lo_in
    return f"({cell} >{'=' if lo_in else ''} {a} AND {cell} <{'=' if hi_in else ''} {b})"


Q_SQL = sql_range("y", QUANTITY, 10.0, 30.5)
P_SQL = sql_range("x", PRICE, 20000.0, 61234.5, True, True)
D_SQL = f"({sql_range('z', DAY, 400.0, 1500.0)} OR {sql_range('z', DAY, 1800.0, 2000.0, False, False)})"
VIEWS = {"quantity": ("y", 5.0), "price": ("x", 5000.0), "day": ("z", 100.0)}


def crossfilter_hist(spark, d):
    """Three histograms, each filtered by the two other brushes, from one scan."""
    at = {view: (c, step, 0.0) for view, (c, step) in VIEWS.items()}
    return view_counts.histograms(points(spark, d), at, cross_filter("brush"), BRUSHES)


CROSSFILTER = f"""WITH {POINTS}
SELECT 'quantity' AS view, CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS n FROM p WHERE {P_SQL} AND {D_SQL} GROUP BY ALL
UNION ALL SELECT 'price', CAST(floor(x / 5000) AS BIGINT), count(*) FROM p WHERE {Q_SQL} AND {D_SQL} GROUP BY ALL
UNION ALL SELECT 'day', CAST(floor(z / 100) AS BIGINT), count(*) FROM p WHERE {Q_SQL} AND {P_SQL} GROUP BY ALL"""


def membership_counts(spark, d):
    """Membership of the brush, its cross-filter and statuses of unused selections, per label."""
    s = Selections({**BRUSHES.resolutions, "idle": "union", "own": "intersect"}, BRUSHES.active)
    own = producer("own", "table", "point", {"l": "label"})
    s = s.set(own, [])
    uses = {"member": membership("brush"), "idle_all": Use("idle", empty="all"), "idle_none": Use("idle", empty="none"),
            "own_excluded": Use("own"), "own_member": membership("own")}
    p = points(spark, d)
    return p.groupBy("label").agg(*[F.count_if(predicate(u, "table", s)).alias(n) for n, u in uses.items()])


MEMBERSHIP = f"""WITH {POINTS} SELECT label, count(*) FILTER (WHERE {Q_SQL} AND {P_SQL} AND {D_SQL}) AS member, count(*) AS idle_all,
0::BIGINT AS idle_none, count(*) AS own_excluded, 0::BIGINT AS own_member FROM p GROUP BY 1"""


def _odd_values(spark, d):
    """Prices with NULL, NaN, infinities and both zeros among them."""
    k = F.pmod(F.col("order_key"), F.lit(11))
    odd = (F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf")))
           .when(k == 3, F.lit(-0.0)).when(k == 4, F.lit(0.0)).when(k == 5, F.lit(float("-inf"))).otherwise(F.col("x")))
    return points(spark, d).withColumn("odd", odd).withColumn("tag", F.when(k == 0, F.lit(None).cast("string")).otherwise(F.col("label")))


ODD = f"""{POINTS}, o AS (SELECT *, CASE order_key % 11 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN -0.0::DOUBLE
  WHEN 4 THEN 0.0 WHEN 5 THEN '-Infinity'::DOUBLE ELSE x END AS odd, CASE order_key % 11 WHEN 0 THEN NULL ELSE label END AS tag FROM p)"""


def value_tests(spark, d):
    nan = float("nan")
    tests = {
        "zero": v.holds(F.col("odd"), v.equal(0.0)), "nan": v.holds(F.col("odd"), v.equal(nan)), "null": v.holds(F.col("odd"), v.equal(None)),
        "some": v.holds(F.col("odd"), v.one_of([0.0, nan, None])), "tags": v.holds(F.col("tag"), v.one_of(["A", None]), False),
        "left": v.holds(F.col("odd"), v.range_(5000.0, 40000.0)), "open": v.holds(F.col("odd"), v.range_(0.0, 40000.0, "neither")),
        "from": v.holds(F.col("odd"), v.range_(40000.0)), "upto": v.holds(F.col("odd"), v.range_(None, 40000.0, "both")),
        "any": v.holds(F.col("odd"), v.range_()),
        "pairs": v.tuples_hold([{"a": v.range_(0.0, 30000.0, "both"), "b": v.equal("A")}, {"a": v.range_(60000.0), "b": v.equal(None)},
                                {"a": v.range_(60000.0), "b": v.equal("R")}], {"a": F.col("odd"), "b": F.col("tag")}),
    }
    o = _odd_values(spark, d)
    return o.groupBy("status").agg(*[F.count_if(t).alias(n) for n, t in tests.items()],
                                   *[F.count_if(~t).alias(f"not_{n}") for n, t in tests.items()])


FINITE = "(odd IS NOT NULL AND NOT isnan(odd) AND abs(odd) < 'Infinity'::DOUBLE)"
TESTS = {"zero": "coalesce(odd = 0, false)", "nan": "coalesce(isnan(odd), false)", "null": "odd IS NULL",
         "some": "(odd IS NULL OR isnan(odd) OR odd = 0)", "tags": "(tag IS NULL OR tag = 'A')",
         "left": f"({FINITE} AND odd >= 5000 AND odd < 40000)", "open": f"({FINITE} AND odd > 0 AND odd < 40000)",
         "from": f"({FINITE} AND odd >= 40000)", "upto": f"({FINITE} AND odd <= 40000)", "any": FINITE,
         "pairs": f"({FINITE} AND ((odd >= 0 AND odd <= 30000 AND coalesce(tag = 'A', false)) OR (odd >= 60000 AND (tag IS NULL OR tag = 'R'))))"}
VALUE_TESTS = f"WITH {ODD} SELECT status, " + ", ".join(
    f'count(*) FILTER (WHERE {t}) AS "{n}", count(*) FILTER (WHERE NOT ({t})) AS "not_{n}"' for n, t in TESTS.items()) + " FROM o GROUP BY 1"

P_ODD = producer("flags", "table", "points", {"t": "tag"})
P_BAND = producer("band", "plot", "interval", {"o": "odd"})
P_BAND2 = producer("band", "map", "interval", {"m": "y"})


def selection_algebra(spark, d):
    """All, Any and Not over three selections, with NULL and NaN among the values."""
    s = (Selections({"flags": "union", "band": "union", "brush": "intersect"}, BRUSHES.active)
         .set(P_ODD, [{"t": v.equal("A")}, {"t": v.equal(None)}])
         .set(P_BAND, [{"o": v.range_(10000.0, 50000.0)}]).set(P_BAND2, [{"m": v.range_(40.0, 50.0, "both")}]))
    a, b, c = membership("flags"), membership("band"), membership("brush")
    kinds = {"all": All((a, b, c)), "any": Any((a, b, c)), "none": Not(Any((a, b, c))), "mixed": All((Any((a, Not(b))), Not(c))),
             "empty_all": All(()), "empty_any": Any(())}
    o = _odd_values(spark, d)
    return o.groupBy("status").agg(*[F.count_if(predicate(f, "table", s)).alias(n) for n, f in kinds.items()])


A_SQL = "(tag IS NULL OR tag = 'A')"
B_SQL = f"(({FINITE} AND odd >= 10000 AND odd < 50000) OR (y >= 40 AND y <= 50))"
C_SQL = f"({Q_SQL} AND {P_SQL} AND {D_SQL})"
ALGEBRA = f"""WITH {ODD} SELECT status, count(*) FILTER (WHERE {A_SQL} AND {B_SQL} AND {C_SQL}) AS "all",
count(*) FILTER (WHERE {A_SQL} OR {B_SQL} OR {C_SQL}) AS "any", count(*) FILTER (WHERE NOT ({A_SQL} OR {B_SQL} OR {C_SQL})) AS "none",
count(*) FILTER (WHERE ({A_SQL} OR NOT {B_SQL}) AND NOT {C_SQL}) AS mixed, count(*) AS empty_all, 0::BIGINT AS empty_any FROM o GROUP BY 1"""


def mapped_view(spark, d):
    """A view over another relation: cells of quantity stand for the brushed quantity."""
    cells = points(spark, d).select((grid.cell("y", 5.0) * 5 + 2).cast("double").alias("mid"), "label").groupBy("mid", "label").agg(F.count("*").alias("n"))
    maps = {(P_QUANTITY.address, "q"): "mid"}
    only = Selections({"brush": "intersect"}).set(P_QUANTITY, [{"q": v.range_(10.0, 30.5)}])
    return cells.where(predicate(membership("brush"), "cells", only, maps))


MAPPED = f"""WITH {POINTS}, c AS (SELECT CAST(floor(y / 5) * 5 + 2 AS DOUBLE) AS mid, label, count(*) AS n FROM p GROUP BY 1, 2)
SELECT * FROM c WHERE {sql_range('mid', QUANTITY, 10.0, 30.5)}"""

TIME = PixelGrid((datetime(2024, 1, 1), datetime(2024, 1, 31)), (0.0, 600.0), 0.5, 3.0, "time")


def pixel_brush(spark, d):
    """Cells of a UTC time scale and a decreasing, clamped value scale; counts under a brush on both."""
    t, y = TIME, PixelGrid((0.0, 300.0), (400.0, 0.0), 0.0, 5.0, clamp=True)
    p = producer("b", "timeline", "box", {"t": "ts", "v": "value"}, {"t": t, "v": y})
    s = Selections({"b": "intersect"}).set(p, [{"t": v.range_(datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 20)), "v": v.range_(20.0, 150.0)}])
    e = feed(spark, d)
    cells = columns(p)
    return e.where(predicate(membership("b"), "other", s)).groupBy(cells["t"].alias("ct"), cells["v"].alias("cv")).agg(F.count("*").alias("n"))


def _ms(c):
    return f"(CAST(floor(epoch_us({c}) / 1000) AS DOUBLE))"


TCELL = lambda c: f"CAST(floor((CAST(CAST(({_ms(c)} - 1704067200000.0::DOUBLE) / 2592000000.0::DOUBLE * 600.0::DOUBLE + 0.0::DOUBLE AS FLOAT) AS DOUBLE) - 0.5::DOUBLE) / 3.0::DOUBLE) AS BIGINT)"
VCELL = lambda c: f"CAST(floor(CAST(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c}) / 300.0::DOUBLE)) * -400.0::DOUBLE + 400.0::DOUBLE AS FLOAT) AS DOUBLE) / 5.0::DOUBLE) AS BIGINT)"
PIXEL_BRUSH = f"""SELECT {TCELL('ts')} AS ct, {VCELL('value')} AS cv, count(*) AS n FROM events
WHERE {TCELL('ts')} >= {TCELL("TIMESTAMP '2024-01-05 06:30:00'")} AND {TCELL('ts')} < {TCELL("TIMESTAMP '2024-01-20 00:00:00'")}
AND {VCELL('value')} > {VCELL('150.0::DOUBLE')} AND {VCELL('value')} <= {VCELL('20.0::DOUBLE')} GROUP BY 1, 2"""

# A lasso in the (price, day) plot, with 4 px cells.
LX, LY = PixelGrid((0.0, 105000.0), (0.0, 500.0), 0.0, 4.0), PixelGrid((0.0, 2500.0), (400.0, 0.0), 0.0, 4.0)
LASSO = [(60.0, 60.0), (300.0, 40.0), (420.0, 200.0), (260.0, 170.0), (240.0, 330.0), (110.0, 350.0), (180.0, 190.0)]
P_LASSO = producer("area", "plot", "lasso", {"u": "x", "v": "z"}, {"u": LX, "v": LY})
RUNS = lasso.runs(LASSO, LX, LY)


def lasso_tuples():
    """The lasso as tuples of data ranges, one per run of cells, as a brush would give them."""
    mid = lambda g, c: g.domain[0] + (g.centre(c) - g.range[0]) / (g.range[1] - g.range[0]) * (g.domain[1] - g.domain[0])

    def ends(g, c0, c1):
        a, b = sorted((mid(g, c0), mid(g, c1)))
        return v.range_(a, b, "both")

    return [{"u": ends(LX, *u), "v": ends(LY, *w)} for u, w in RUNS]


SELECTED_AREA = Selections({"area": "intersect"}).set(P_LASSO, lasso_tuples())
CENTRES = f"(({sql_cell('x', LX)} + 0.5::DOUBLE) * 4.0::DOUBLE) AS u, (({sql_cell('z', LY)} + 0.5::DOUBLE) * 4.0::DOUBLE) AS v"


def lasso_hist(spark, d):
    """Quantities under a lasso, through tables of run ends."""
    p = points(spark, d)
    return grid.histogram(p, "y", 5.0, where=predicate(membership("area"), "hist", SELECTED_AREA), by=["label"])


LASSO_HIST = f"""WITH {POINTS}, c AS (SELECT *, {CENTRES} FROM p)
SELECT label, CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS n FROM c WHERE {ring_open_sql(LASSO)} GROUP BY 1, 2"""


def lasso_boxes(spark, d):
    """The same lasso through a joined table of runs."""
    cols = columns(P_LASSO)
    p = points(spark, d).withColumn("cu", cols["u"]).withColumn("cv", cols["v"])
    hit = lasso.match_boxes(p, ["cu", "cv"], RUNS)
    return grid.histogram(hit, "y", 5.0, where=F.col("in_boxes"), by=["label"])


def exact_ring(spark, d):
    """Points, not cells, inside the ring."""
    p = once(points(spark, d), u=F.col("x") / 210.0, v=400.0 - F.col("z") * 0.16)
    return p.where(lasso.in_ring(F.col("u"), F.col("v"), LASSO)).groupBy("label").agg(F.count("*").alias("n"))


EXACT_RING = f"""WITH {POINTS}, c AS (SELECT label, x / 210.0::DOUBLE AS u, 400.0 - z * 0.16::DOUBLE AS v FROM p)
SELECT label, count(*) AS n FROM c WHERE {ring_sql(LASSO)} GROUP BY 1"""

WIDTH = 30.0


def soft_hist(spark, d):
    """A histogram of days weighted by the degree of the quantity and price brushes."""
    s = Selections({"brush": "intersect"}, {k: c for k, c in BRUSHES.active.items() if k[1] != "day"})
    p = points(spark, d).withColumn("w", soft_degree(cross_filter("brush"), "day", s, WIDTH))
    return grid.histogram(p, "z", 100.0, weight="w").select("bin", r("weight", 4).alias("weight"))


def sql_gap(c, g, lo, hi, lo_in=True, hi_in=False):
    cell, a, b = sql_cell(c, g), sql_cell(repr(lo) + "::DOUBLE", g), sql_cell(repr(hi) + "::DOUBLE", g)
    if g.decreasing:
        a, b, lo_in, hi_in = b, a, hi_in, lo_in
    return f"(greatest({a} + {0 if lo_in else 1} - {cell}, {cell} - ({b} - {0 if hi_in else 1}), 0) * {g.size})"


def sql_fall(dist):
    return f"greatest(0.0::DOUBLE, 1 - ({dist}) / {WIDTH}::DOUBLE)"


SOFT_HIST = f"""WITH {POINTS}, k AS (SELECT z, least({sql_fall(sql_gap('y', QUANTITY, 10.0, 30.5))}, {sql_fall(sql_gap('x', PRICE, 20000.0, 61234.5, True, True))}) AS w FROM p)
SELECT CAST(floor(z / 100) AS BIGINT) AS bin, round(sum(w), 4) AS weight FROM k GROUP BY 1"""


def soft_lasso(spark, d):
    """Weights by distance to the lasso, through a table of cells near it."""
    cols = columns(P_LASSO)
    p = points(spark, d).withColumn("cu", cols["u"]).withColumn("cv", cols["v"])
    w = degree.with_degree(p, ["cu", "cv"], [LX.size, LY.size], RUNS, WIDTH)
    return w.groupBy("label").agg(r(F.sum("degree"), 4).alias("weight"), F.count_if(F.col("degree") == 1).alias("inside"),
                                  F.count_if(F.col("degree") > 0).alias("near"))


SOFT_LASSO = f"""WITH {POINTS}, c AS (SELECT label, {sql_cell('x', LX)} AS cu, {sql_cell('z', LY)} AS cv FROM p),
g AS (SELECT a AS cu, b AS cv FROM (SELECT unnest(range(0, 125)) AS a), (SELECT unnest(range(0, 100)) AS b)),
i AS (SELECT cu, cv FROM (SELECT cu, cv, (cu + 0.5::DOUBLE) * 4 AS u, (cv + 0.5::DOUBLE) * 4 AS v FROM g) WHERE {ring_open_sql(LASSO)}),
t AS (SELECT g.cu, g.cv, min((g.cu - i.cu) ** 2 + (g.cv - i.cv) ** 2) AS d2 FROM (SELECT DISTINCT cu, cv FROM c) g, i GROUP BY 1, 2),
k AS (SELECT label, greatest(0.0::DOUBLE, 1 - sqrt(d2) * 4 / {WIDTH}::DOUBLE) AS w FROM c JOIN t USING (cu, cv))
SELECT label, round(sum(w), 4) AS weight, count(*) FILTER (WHERE w = 1) AS inside, count(*) FILTER (WHERE w > 0) AS near FROM k GROUP BY 1"""

# -- series -------------------------------------------------------------------------


def _series(spark, d):
    """Per user the number of events on each day."""
    return feed(spark, d).select("user_id", F.floor(F.col("t") / 86400).cast("double").alias("day")) \
        .groupBy("user_id", "day").agg(F.count("*").cast("double").alias("n"))


SERIES = f"""{FEED}, s AS (SELECT user_id, floor(t / 86400) AS day, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2)"""
START, END = (4.5, 6.0), (9.0, 4.5)


def line_brush(spark, d):
    """Raw events of the users whose daily counts cross a segment."""
    keys = series.crossing_keys(_series(spark, d), "user_id", "day", "n", START, END)
    kept = series.select_rows(feed(spark, d).select("user_id", "event_type", "value", "event_id"), keys, "user_id")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _turn(a, b, c):
    return f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _on(a, b, c):
    return f"({c[0]} >= least({a[0]}, {b[0]}) AND {c[0]} <= greatest({a[0]}, {b[0]}) AND {c[1]} >= least({a[1]}, {b[1]}) AND {c[1]} <= greatest({a[1]}, {b[1]}))"


def meets_sql(p1, p2, q1, q2):
    q1, q2 = tuple(f"{c!r}::DOUBLE" for c in q1), tuple(f"{c!r}::DOUBLE" for c in q2)
    d1, d2, d3, d4 = _turn(q1, q2, p1), _turn(q1, q2, p2), _turn(p1, p2, q1), _turn(p1, p2, q2)
    return (f"coalesce(({d1} * {d2} < 0 AND {d3} * {d4} < 0) OR ({d1} = 0 AND {_on(q1, q2, p1)}) OR ({d2} = 0 AND {_on(q1, q2, p2)}) "
            f"OR ({d3} = 0 AND {_on(p1, p2, q1)}) OR ({d4} = 0 AND {_on(p1, p2, q2)}), false)")


CROSSING = f"""g AS (SELECT *, lag(day) OVER w AS px, lag(n) OVER w AS py FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day, n)),
hits AS (SELECT DISTINCT user_id FROM g WHERE px IS NOT NULL AND {meets_sql(('px', 'py'), ('day', 'n'), START, END)})"""
LINE_BRUSH = f"""WITH {SERIES}, {CROSSING}
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM f WHERE user_id IN (SELECT user_id FROM hits) GROUP BY 1"""

RAW_START, RAW_END = (5.0 * 86400, 120.0), (5.1 * 86400, 20.0)


def raw_line_brush(spark, d):
    """Types whose raw polylines (every event a vertex) cross a steep segment,
    with how many events they have."""
    e = feed(spark, d)
    keys = series.crossing_keys(e, "user_id", "t", "value", RAW_START, RAW_END)
    return series.select_rows(e.select("user_id", "event_id"), keys, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


RAW_LINE = f"""WITH {FEED}, g AS (SELECT *, lag(t) OVER w AS px, lag(value) OVER w AS py FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, value)),
hits AS (SELECT DISTINCT user_id FROM g WHERE px IS NOT NULL AND {meets_sql(('px', 'py'), ('t', 'value'), RAW_START, RAW_END)})
SELECT user_id, count(*) AS n FROM f WHERE user_id IN (SELECT user_id FROM hits) GROUP BY 1"""


def timebox(spark, d):
    keys = series.timebox_keys(_series(spark, d), "user_id", "day", "n", (3.0, 9.0), (1.0, 4.0))
    kept = series.select_rows(feed(spark, d).select("user_id", "event_type", "event_id"), keys, "user_id")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


TIMEBOX = f"""WITH {SERIES}, k AS (SELECT user_id FROM s WHERE day BETWEEN 3 AND 9 GROUP BY 1 HAVING bool_and(n BETWEEN 1 AND 4))
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM f WHERE user_id IN (SELECT user_id FROM k) GROUP BY 1"""

SCALE, SOFT = (1 / 30, 1 / 12), 0.15


def soft_series(spark, d):
    """Events weighted by their user's degree under a soft line brush and a soft timebox."""
    s = _series(spark, d)
    lines = series.crossing_degrees(s, "user_id", "day", "n", START, END, SCALE, SOFT).withColumnRenamed("degree", "line")
    boxes = series.timebox_degrees(s, "user_id", "day", "n", (3.0, 9.0), (1.0, 3.0)).withColumnRenamed("degree", "box")
    e = feed(spark, d).select("user_id", "event_type", "event_id")
    e = degree.with_key_degree(e, "user_id", lines, "line")
    e = degree.with_key_degree(e, "user_id", boxes, "box")
    return e.groupBy("event_type").agg(r(F.sum("line"), 4).alias("line"), r(F.sum("box"), 4).alias("box"))


def distance_sql(x, y, a, b, scale):
    sx, sy = scale
    ax, ay, vx, vy = a[0] * sx, a[1] * sy, (b[0] - a[0]) * sx, (b[1] - a[1]) * sy
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} * {sx!r}::DOUBLE - {ax!r}::DOUBLE) * {vx!r}::DOUBLE + ({y} * {sy!r}::DOUBLE - {ay!r}::DOUBLE) * {vy!r}::DOUBLE) / {vx * vx + vy * vy!r}::DOUBLE))"
    return f"sqrt(({x} * {sx!r}::DOUBLE - ({ax!r}::DOUBLE + {t} * {vx!r}::DOUBLE)) ** 2 + ({y} * {sy!r}::DOUBLE - ({ay!r}::DOUBLE + {t} * {vy!r}::DOUBLE)) ** 2)"


SOFT_SERIES = f"""WITH {SERIES}, {CROSSING},
near AS (SELECT user_id, min({distance_sql('day', 'n', START, END, SCALE)}) AS dist FROM s GROUP BY 1),
line AS (SELECT near.user_id, CASE WHEN hits.user_id IS NOT NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - dist / {SOFT}::DOUBLE) END AS line FROM near LEFT JOIN hits ON near.user_id = hits.user_id),
box AS (SELECT user_id, count(*) FILTER (WHERE n BETWEEN 1 AND 3) / count(*)::DOUBLE AS box FROM s WHERE day BETWEEN 3 AND 9 GROUP BY 1)
SELECT event_type, round(sum(coalesce(line, 0)), 4) AS line, round(sum(coalesce(box, 0)), 4) AS box
FROM f LEFT JOIN line ON f.user_id = line.user_id LEFT JOIN box ON f.user_id = box.user_id GROUP BY 1"""


def key_members(spark, d):
    """Rows of listed keys, and the degrees of a few more."""
    p = producer("users", "lines", "point", {"k": "user_id"})
    s = Selections({"users": "intersect"}).set(p, [{"k": v.one_of([3, 5, 8, 13, 21])}], partial={2: 0.5, 34: 0.25})
    e = feed(spark, d)
    e = e.withColumn("w", soft_degree(membership("users"), "x", s, 10.0)).withColumn("m", predicate(membership("users"), "x", s))
    return e.groupBy("event_type").agg(F.count_if("m").alias("members"), r(F.sum("w"), 4).alias("weight"))


KEY_MEMBERS = """SELECT event_type, count(*) FILTER (WHERE user_id IN (3, 5, 8, 13, 21)) AS members,
sum(CASE WHEN user_id IN (3, 5, 8, 13, 21) THEN 1.0::DOUBLE WHEN user_id = 2 THEN 0.5 WHEN user_id = 34 THEN 0.25 ELSE 0 END) AS weight FROM events GROUP BY 1"""

# -- stored states ------------------------------------------------------------------

MEASURES = [("rows", None, "n"), ("sum", "x", "total"), ("mean", "x", "mean"), ("max", "z", "top"), ("stddev_samp", "x", "sd")]
MOVES = [(5.0, 20.0), (12.0, 33.0), (30.0, 48.0)]


def _cube(spark, d):
    return cubes.cube(points(spark, d), {"label": F.col("label"), "bin": grid.cell("x", 10000.0)}, MEASURES,
                      cross_filter("brush"), P_QUANTITY, "price", BRUSHES)


def cube_rollup(spark, d):
    """A brush on quantity at three places, from one table of stored states."""
    c = _cube(spark, d).stored()
    out = None
    for i, (lo, hi) in enumerate(MOVES):
        at = c.rollup(BRUSHES.set(P_QUANTITY, [{"q": v.range_(lo, hi)}]))
        at = at.select(F.lit(i).alias("move"), "label", "bin", "n", r("total", 2).alias("total"), r("mean").alias("mean"), "top", r("sd", 3).alias("sd"))
        out = at if out is None else out.unionByName(at)
    return out


CUBE = f"WITH {POINTS} " + " UNION ALL ".join(
    f"""SELECT {i} AS move, label, CAST(floor(x / 10000) AS BIGINT) AS bin, count(*) AS n, round(sum(x), 2) AS total, round(avg(x), 6) AS mean, max(z) AS top,
    round(stddev_samp(x), 3) AS sd FROM p WHERE {D_SQL} AND {sql_range('y', QUANTITY, lo, hi)} GROUP BY ALL""" for i, (lo, hi) in enumerate(MOVES))


def cube_fallback(spark, d):
    """What lies outside a brush can't be split around it, so the same call answers from the rows."""
    now = Selections({"brush": "intersect"}).set(P_QUANTITY, [{"q": v.range_(12.0, 33.0)}])
    chart = cubes.prepared(points(spark, d), {"label": F.col("label")}, [("rows", None, "n"), ("max", "x", "top")], Not(Use(P_QUANTITY.selection)), P_QUANTITY, "beside", now)
    return chart.rollup(now)


FALLBACK = f"""WITH {POINTS} SELECT label, count(*) AS n, max(x) AS top FROM p WHERE NOT coalesce({sql_range('y', QUANTITY, 12.0, 33.0)}, false) GROUP BY 1"""


def cube_soft(spark, d):
    """The same stored states under a fading brush."""
    c = _cube(spark, d)
    s = BRUSHES.set(P_QUANTITY, [{"q": v.range_(12.0, 33.0)}])
    return c.soft(s, WIDTH).select("label", "bin", r("weight", 4).alias("weight"))


CUBE_SOFT = f"""WITH {POINTS} SELECT label, CAST(floor(x / 10000) AS BIGINT) AS bin, round(sum({sql_fall(sql_gap('y', QUANTITY, 12.0, 33.0))}), 4) AS weight
FROM p WHERE {D_SQL} GROUP BY ALL"""


def cube_lasso(spark, d):
    """A lasso as the focus: hard counts and faded weights from one table of cells."""
    c = cubes.cube(points(spark, d), {"label": F.col("label")}, [("rows", None, "n")], membership("area"), P_LASSO, "hist", SELECTED_AREA)
    hard = c.rollup(SELECTED_AREA)
    faded = c.degree_rows(SELECTED_AREA, WIDTH).select("label", r("weight", 4).alias("weight"))
    return hard.join(faded, "label")


CUBE_LASSO = SOFT_LASSO[: SOFT_LASSO.rindex("SELECT label")] + "SELECT label, count(*) FILTER (WHERE w = 1) AS n, round(sum(w), 4) AS weight FROM k GROUP BY 1"

# -- the update log -----------------------------------------------------------------


def _log(spark, d):
    """Events read as updates: types are selections, users producers, rounded values tuples."""
    e = feed(spark, d)
    k = F.pmod(F.col("event_id"), F.lit(97))
    op = F.when(k == 0, "clear").when(k == 1, "clear_all").when(k.isin(2, 3, 4), "set").otherwise("toggle")
    tup = F.when(op.isin("clear", "clear_all") | (k == 4), F.lit(None).cast("string")).otherwise(F.floor(F.col("value") / 5).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("selection"),
                    F.when(op != "clear_all", F.concat(F.lit("p"), F.pmod(F.col("user_id"), F.lit(7)))).alias("producer"),
                    op.alias("op"), tup.alias("tuple"))


def active_tuples(spark, d):
    return log.active_tuples(_log(spark, d))


ACTIVE = """WITH l AS (SELECT event_id AS seq, event_type AS selection, CASE WHEN event_id % 97 <> 1 THEN 'p' || (user_id % 7) END AS producer,
  CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 97 = 1 THEN 'clear_all' WHEN event_id % 97 IN (2, 3, 4) THEN 'set' ELSE 'toggle' END AS op,
  CASE WHEN event_id % 97 IN (0, 1, 4) THEN NULL ELSE CAST(floor(value / 5) AS BIGINT)::VARCHAR END AS tuple FROM events),
c AS (SELECT selection, max(seq) AS at FROM l WHERE op = 'clear_all' GROUP BY 1),
o AS (SELECT selection, producer, max(seq) AS at FROM l WHERE op IN ('set', 'clear') GROUP BY 1, 2),
e AS (SELECT l.*, greatest(coalesce(o.at, -1), coalesce(c.at, -1)) AS since FROM l LEFT JOIN o ON l.selection = o.selection AND l.producer = o.producer
  LEFT JOIN c ON l.selection = c.selection WHERE op IN ('set', 'toggle')),
v AS (SELECT * FROM e WHERE seq > since OR (op = 'set' AND seq = since))
SELECT selection, producer, tuple FROM v WHERE tuple IS NOT NULL GROUP BY ALL HAVING count(*) % 2 = 1
UNION ALL SELECT selection, producer, NULL FROM v GROUP BY ALL HAVING NOT bool_or(op = 'toggle') AND bool_or(tuple IS NULL)"""


def active_global(spark, d):
    return log.active_global(_log(spark, d))


# Per selection and tuple a fold over its updates in order. The state is "owner#everyone who added it since the last reset".
GLOBAL = ACTIVE[: ACTIVE.index("c AS (SELECT")] + """u AS (SELECT DISTINCT selection, seq, op, producer FROM l WHERE op <> 'toggle'),
k AS (SELECT DISTINCT selection, tuple FROM l WHERE tuple IS NOT NULL),
x AS (SELECT k.selection, k.tuple, u.seq, CASE WHEN u.op = 'clear' THEN 'C:' || u.producer WHEN m.tuple IS NOT NULL THEN 'S:' || u.producer ELSE 'R:' END AS e
    FROM k JOIN u ON k.selection = u.selection LEFT JOIN l m ON m.op = 'set' AND m.selection = u.selection AND m.seq = u.seq AND m.tuple = k.tuple
  UNION ALL SELECT selection, tuple, seq, 'T:' || producer FROM l WHERE op = 'toggle'),
g AS (SELECT selection, tuple, list_prepend('#', list(e ORDER BY seq)) AS es FROM x GROUP BY 1, 2),
s AS (SELECT selection, tuple, list_reduce(es, lambda a, e: CASE
    WHEN e[1] = 'R' THEN '#' WHEN e[1] = 'S' THEN substr(e, 3) || '#' || substr(e, 3) || ','
    WHEN e[1] = 'C' THEN CASE WHEN split_part(a, '#', 1) = substr(e, 3) THEN '#' || split_part(a, '#', 2) ELSE a END
    WHEN split_part(a, '#', 1) = '' THEN substr(e, 3) || '#' || split_part(a, '#', 2) || substr(e, 3) || ','
    ELSE '#' || split_part(a, '#', 2) END) AS st FROM g),
z AS (SELECT selection, max(seq) AS at FROM l WHERE op IN ('set', 'clear_all') GROUP BY 1),
q AS (SELECT DISTINCT l.selection, l.producer, l.seq FROM l JOIN z ON l.selection = z.selection AND l.seq = z.at WHERE l.op = 'set' AND l.tuple IS NULL)
SELECT selection, split_part(st, '#', 1) AS producer, tuple FROM s WHERE split_part(st, '#', 1) <> ''
UNION ALL SELECT selection, producer, NULL FROM q
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.op = 'clear' AND l.selection = q.selection AND l.producer = q.producer AND l.seq > q.seq)
AND NOT EXISTS (SELECT 1 FROM s WHERE s.selection = q.selection AND contains(',' || split_part(s.st, '#', 2), ',' || q.producer || ','))"""


QUERIES = {
    "crossfilter_hist": (crossfilter_hist, CROSSFILTER),
    "membership_counts": (membership_counts, MEMBERSHIP),
    "value_tests": (value_tests, VALUE_TESTS),
    "selection_algebra": (selection_algebra, ALGEBRA),
    "mapped_view": (mapped_view, MAPPED),
    "pixel_brush": (pixel_brush, PIXEL_BRUSH),
    "lasso_hist": (lasso_hist, LASSO_HIST),
    "lasso_boxes": (lasso_boxes, LASSO_HIST),
    "exact_ring": (exact_ring, EXACT_RING),
    "soft_hist": (soft_hist, SOFT_HIST),
    "soft_lasso": (soft_lasso, SOFT_LASSO),
    "line_brush": (line_brush, LINE_BRUSH),
    "raw_line_brush": (raw_line_brush, RAW_LINE),
    "timebox": (timebox, TIMEBOX),
    "soft_series": (soft_series, SOFT_SERIES),
    "key_members": (key_members, KEY_MEMBERS),
    "cube_fallback": (cube_fallback, FALLBACK),
    "cube_rollup": (cube_rollup, CUBE),
    "cube_soft": (cube_soft, CUBE_SOFT),
    "cube_lasso": (cube_lasso, CUBE_LASSO),
    "active_tuples": (active_tuples, ACTIVE),
    "active_global": (active_global, GLOBAL),
}
