"""Chart transforms over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, grid, layouts, transforms as tr
from ..session import materialise
from ..sources import tables
from .data import FEED, POINTS, feed, load, points, r

FLAGS = {"A": "Accepted", "N": "Not returned"}


def truthy_filter(spark, d):
    """Rows whose discount is truthy: 0 is false."""
    return tr.where(load(spark, d, "lineitem"), F.col("l_discount")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def formula(spark, d):
    t = tr.calc(load(spark, d, "lineitem"), "net", "l_extendedprice * (1 - l_discount)")
    t = tr.calc(t, "held", tr.clip(F.col("net"), 5000.0, 60000.0))
    return t.groupBy("l_linestatus").agg(r(F.min("held"), 4).alias("lo"), r(F.max("held"), 4).alias("hi"),
                                         r(F.sum("held"), 2).alias("total"))


def sql_step(spark, d):
    """SQL over the chain so far, with typed parameters."""
    kept = load(spark, d, "lineitem").where("l_quantity < 30")
    return tables.run_sql(
        kept, "SELECT l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS q FROM input "
              "WHERE l_discount >= :lo AND l_discount < :hi GROUP BY ALL", lo=0.03, hi=0.07)


def structured_predicate(spark, d):
    p = tr.compare("l_quantity", gte=10, lt=25) & tr.compare("l_returnflag", one_of=["A", "R"]) \
        & tr.compare("l_tax", range=(0.02, 0.06))
    return load(spark, d, "lineitem").where(p).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def label_counts(spark, d):
    code = F.col("l_returnflag")
    t = load(spark, d, "lineitem").select(tr.labels(code, FLAGS).alias("label"), tr.label_order(code, FLAGS).alias("o"))
    return t.groupBy("label").agg(F.min("o").alias("o"), F.count("*").alias("n")).orderBy("o")


def class_band_heatmap(spark, d):
    p = points(spark, d).where((F.col("z") >= 200) & (F.col("z") < 2000))
    return p.select(tr.labels(F.col("label"), FLAGS).alias("label"), grid.cell("z", 100.0, 200.0).alias("b")) \
        .groupBy("label", (F.col("b") * 100 + 200).alias("band")).agg(F.count("*").alias("n"))


def filtered_cells(spark, d):
    p = points(spark, d).where((F.col("label") == "R") & (F.col("x") < 50000))
    keyed = p.select(grid.cell("x", 5000.0).alias("i"), grid.cell("y", 5.0).alias("j"), "z")
    return keyed.groupBy((F.col("i") * 5000).alias("cx"), (F.col("j") * 5).alias("cy")).agg(F.max("z").alias("h"))


def nice_bins(spark, d):
    b = tr.bin_rows(load(spark, d, "lineitem"), "l_extendedprice", ("b0", "b1"), maxbins=30)
    return b.groupBy("b0", "b1").agg(F.count("*").alias("n"))


NICE_BINS = """WITH x AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, max(l_extendedprice) - min(l_extendedprice) AS span FROM lineitem),
p AS (SELECT *, pow(10.0, round(ln(span) / ln(10)) - ceil(ln(30) / ln(10))) AS s0 FROM x),
w AS (SELECT *, CASE WHEN ceil(span / s0) > 30 THEN s0 * 10 ELSE s0 END AS s1 FROM p),
q AS (SELECT *, CASE WHEN ceil(span / s1) > 30 THEN s1 * 10 ELSE s1 END AS s2 FROM w),
f AS (SELECT *, CASE WHEN span / (s2 / 5) <= 30 THEN s2 / 5 ELSE s2 END AS s3 FROM q),
h AS (SELECT *, CASE WHEN span / (s3 / 2) <= 30 THEN s3 / 2 ELSE s3 END AS step FROM f),
n AS (SELECT step, floor(lo / step) * step AS start, ceil(hi / step) * step AS stop FROM h),
b AS (SELECT step, start + step * floor(1e-14 + (greatest(start, least(l_extendedprice, stop - step)) - start) / step) AS b0 FROM lineitem, n)
SELECT b0, b0 + step AS b1, count(*) AS n FROM b GROUP BY ALL"""


def bin_options(spark, d):
    """Four ways to ask for bins of the same field, as one table."""
    t = load(spark, d, "events")
    ways = {"step": dict(step=40.0), "steps": dict(steps=[5.0, 25.0, 100.0], maxbins=12),
            "extent": dict(extent=(0.0, 300.0), maxbins=12, divide=(5, 2)), "anchor": dict(step=50.0, anchor=10.0)}
    out = None
    for name, options in ways.items():
        part = tr.bin_rows(t, "value", ("b0", "b1"), **options).groupBy("b0", "b1").agg(F.count("*").alias("n")) \
            .select(F.lit(name).alias("way"), F.when(F.abs("b0") < float("inf"), F.col("b0")).alias("b0"),
                    F.when(F.abs("b1") < float("inf"), F.col("b1")).alias("b1"), "n")
        out = part if out is None else out.unionByName(part)
    return out


BIN_OPTIONS = """WITH x AS (SELECT min(value) AS lo, max(value) AS hi, CASE WHEN (max(value) - min(value)) / 12 >= 100 THEN 100.0
  WHEN (max(value) - min(value)) / 12 >= 25 THEN 25.0 ELSE 5.0 END::DOUBLE AS chosen FROM events),
w AS (
  SELECT 'step' AS way, 40.0::DOUBLE AS step, floor(lo / 40) * 40 AS start, ceil(hi / 40) * 40 AS stop FROM x
  UNION ALL SELECT 'steps', chosen, floor(lo / chosen) * chosen, ceil(hi / chosen) * chosen FROM x
  UNION ALL SELECT 'extent', 50.0, 0.0, 300.0
  UNION ALL SELECT 'anchor', 50.0, floor(lo / 50) * 50 + 10, ceil(hi / 50) * 50 + 10 FROM x),
b AS (SELECT way, step, CASE WHEN value < start OR value > stop THEN NULL
  ELSE start + step * floor(1e-14 + (greatest(start, least(value, stop - step)) - start) / step) END AS b0 FROM events, w)
SELECT way, b0, b0 + step AS b1, count(*) AS n FROM b GROUP BY ALL"""


def vl_aggregate(spark, d):
    ops = [("count", None, "n"), ("valid", "l_tax", "valid"), ("missing", "l_tax", "missing"), ("sum", "l_quantity", "q"),
           ("min", "l_extendedprice", "lo"), ("max", "l_extendedprice", "hi"), ("mean", "l_quantity", "mean"),
           ("variance", "l_quantity", "var"), ("variancep", "l_quantity", "varp"), ("stdev", "l_quantity", "sd"),
           ("stdevp", "l_quantity", "sdp"), ("distinct", "l_suppkey", "suppliers")]
    a = tr.aggregate(load(spark, d, "lineitem"), ops, ["l_returnflag", "l_linestatus"])
    return a.select("l_returnflag", "l_linestatus", "n", "valid", "missing", r("q", 2).alias("q"), "lo", "hi",
                    *[r(c).alias(c) for c in ("mean", "var", "varp", "sd", "sdp")], "suppliers")


def stack_shares(spark, d):
    p = points(spark, d).select("label", grid.cell("y", 5.0).alias("bin"), F.lit(1).alias("one"))
    s = tr.stack(p, "bin", "one", ["label"])
    return s.select("label", "bin", "value", "start", "total", r("x0", 9).alias("x0"), r("x1", 9).alias("x1"))


def _histogram(df):
    h = grid.histogram(df, "y", 5.0)
    return h.select("bin", grid.centre("bin", 0.0).alias("_"), (F.col("bin") * 5.0).alias("lo"),
                    (F.col("bin") * 5.0 + 5.0).alias("hi"), "n").drop("_")


def bin_positions(spark, d):
    """Where quantities lie in bars and in the stack, and back from the stack."""
    p = points(spark, d)
    bins = materialise(_histogram(p), "bins")
    u = layouts.position(layouts.position(p, "y", bins, stacked=False, name="bar"), "y", bins, stacked=True, name="stack")
    back = layouts.value_at(u.select("y", "bar", "stack").distinct(), "stack", bins, stacked=True, name="back")
    return back.select("y", r("bar", 9).alias("bar"), r("stack", 9).alias("stack"), r("back", 6).alias("back"))


BINS = """h AS (SELECT CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT bin, bin * 5.0::DOUBLE AS lo, bin * 5.0::DOUBLE + 5 AS hi, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h)"""

BIN_POSITIONS = f"""WITH {POINTS}, {BINS}, v AS (SELECT DISTINCT y FROM p),
e AS (SELECT min(lo) AS lo0, max(hi) AS hi1 FROM s)
SELECT y, round(least(1.0, greatest(0.0, (y - lo0) / (hi1 - lo0))), 9) AS bar,
round((upto - n + (y - lo) / (hi - lo) * n) / total, 9) AS stack,
round(y, 6) AS back FROM v JOIN s ON y >= lo AND y < hi, e"""


def context_layer(spark, d):
    """Quantities of returned items inside all quantities, clipped to 12..33."""
    p = points(spark, d)
    c = layouts.context(_histogram(p), _histogram(p.where("label = 'R'")).select("bin", "n"))
    return layouts.clip(layouts.shares(c), 12.0, 33.0).select(
        "bin", "n", "layer", r("share", 9).alias("share"), r("x0", 9).alias("x0"), r("x1", 9).alias("x1"), "clip_lo", "clip_hi")


CONTEXT = f"""WITH {POINTS}, {BINS}, k AS (SELECT CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS m FROM p WHERE label = 'R' GROUP BY 1)
SELECT s.bin, n, coalesce(m, 0) AS layer, round(coalesce(m, 0) / n, 9) AS share, round((upto - n) / total, 9) AS x0,
round(upto / total, 9) AS x1, greatest(lo, 12.0::DOUBLE) AS clip_lo, least(hi, 33.0::DOUBLE) AS clip_hi
FROM s LEFT JOIN k ON s.bin = k.bin WHERE greatest(lo, 12) < least(hi, 33)"""


def robust_norm(spark, d):
    c = grid.cells(points(spark, d), "x", "y", "z", "label", (1000.0, 5.0), means=["x"])
    return tr.robust_unit(c, "mean_x").select("cx", "cy", r("u").alias("u"))


ROBUST = f"""WITH {POINTS}, c AS (SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, avg(x) AS m FROM p GROUP BY 1, 2),
k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM c),
e AS (SELECT max(CASE WHEN i = n // 200 THEN m END) AS lo, max(CASE WHEN i = n * 995 // 1000 THEN m END) AS hi FROM k)
SELECT cx, cy, round(greatest(0.0, least(1.2, (m - lo) / (hi - lo))), 6) AS u FROM c, e"""


def domains(spark, d):
    """Nice and logarithmic domains of four measures, and a middle value's place in them."""
    t = load(spark, d, "orders")
    e = t.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    e = e.withColumn("nice", tr.nice_domain(F.col("lo"), F.col("hi"))).withColumn("log", tr.log_domain(F.col("lo"), F.col("hi")))
    mid = F.lit(50000.0)
    return e.select("o_orderstatus", F.col("nice.lo").cast("double").alias("nice_lo"), F.col("nice.hi").cast("double").alias("nice_hi"),
                    F.col("log.lo").alias("log_lo"), F.col("log.hi").alias("log_hi"),
                    r(tr.unit_linear(mid, F.col("nice.lo"), F.col("nice.hi"))).alias("linear"),
                    r(tr.unit_log(mid, F.col("log.lo"), F.col("log.hi"))).alias("logarithmic"))


DOMAINS = """WITH e AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
t AS (SELECT *, greatest(hi - lo, 1e-9) AS span, pow(10, floor(log10(greatest(hi - lo, 1e-9) / 5))) AS ten FROM e),
s AS (SELECT *, CASE WHEN span / ten <= 6 THEN ten WHEN span / (ten * 2) <= 6 THEN ten * 2 WHEN span / (ten * 5) <= 6 THEN ten * 5 ELSE ten * 10 END AS step FROM t),
n AS (SELECT o_orderstatus, floor(lo / step) * step AS nice_lo, ceil(hi / step) * step AS nice_hi,
  pow(10, floor(log10(greatest(lo, 1)))) AS log_lo, pow(10, ceil(log10(greatest(hi, 1)))) AS log_hi FROM s)
SELECT *, round((50000 - nice_lo) / (nice_hi - nice_lo), 6) AS linear,
round(least(1.0, greatest(0.0, (log10(greatest(50000, log_lo)) - log10(log_lo)) / (log10(log_hi) - log10(log_lo)))), 6) AS logarithmic FROM n"""


def log_tints(spark, d):
    c = grid.density(points(spark, d), {"i": ("z", 30.0, 0.0), "j": ("x", 5000.0, 0.0)})
    c = tr.log_tint(tr.log_tint(c, "n", "tint"), "n", "tint1", plus_one=True)
    return c.select("i", "j", r("tint").alias("tint"), r("tint1").alias("tint1"))


LOG_TINTS = f"""WITH {POINTS}, c AS (SELECT CAST(floor(z / 30) AS BIGINT) AS i, CAST(floor(x / 5000) AS BIGINT) AS j, count(*) AS n FROM p GROUP BY 1, 2)
SELECT i, j, round(ln(n) / ln(max(n) OVER ()), 6) AS tint, round(ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + max(n) OVER ()), 6) AS tint1 FROM c"""


def field_extents(spark, d):
    t = load(spark, d, "lineitem")
    return tr.extent(t, "l_extendedprice").select(F.lit("points").alias("mark"), "lo", "hi").unionByName(
        tr.extent(t, "l_extendedprice", zero=True).select(F.lit("bar").alias("mark"), "lo", "hi"))


def zoom_quarter(spark, d):
    out = None
    for region in ("north_east", "north_west", "south_east", "south_west"):
        q = tr.quarters(points(spark, d), "x", "y", region).agg(F.count("*").alias("n")).select(F.lit(region).alias("region"), "n")
        out = q if out is None else out.unionByName(q)
    return out


ZOOM = f"""WITH {POINTS}, m AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM p)
SELECT 'north_east' AS region, count(*) AS n FROM p, m WHERE x >= mx AND y >= my
UNION ALL SELECT 'north_west', count(*) FROM p, m WHERE x <= mx AND y >= my
UNION ALL SELECT 'south_east', count(*) FROM p, m WHERE x >= mx AND y <= my
UNION ALL SELECT 'south_west', count(*) FROM p, m WHERE x <= mx AND y <= my"""


def weighted_histogram(spark, d):
    """Quantities weighted by discount: the shape of a degree-weighted histogram."""
    h = grid.histogram(points(spark, d), "y", 5.0, weight="intensity")
    return h.select("bin", r("weight", 4).alias("weight"))


def hour_means(spark, d):
    """Mean value per type and hour, for hours with enough events."""
    t = feed(spark, d).withColumn("hour", F.pmod(F.floor(F.col("t") / 3600), F.lit(24)).cast("long"))
    return t.groupBy("event_type", "hour").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total")) \
        .where("n >= 10").select("event_type", "hour", "n", "total")


HOUR_MEANS = f"""WITH {FEED} SELECT event_type, CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, count(*) AS n, round(sum(value), 2) AS total
FROM f GROUP BY 1, 2 HAVING count(*) >= 10"""


def frame_update(spark, d):
    """Nations with suppliers in credit, then nations with customers well in
    credit, with regions as parents: what updates, enters and exits."""
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("parent"))
    region = load(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"),
                                             F.lit(-1).cast("long").alias("n"))

    def frame(table, key, balance, least):
        c = load(spark, d, table).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.avg(balance).alias("mean"))
        return c.join(nation, "k").where(F.col("mean") > least).select(F.concat(F.lit("nation:"), F.col("k")).alias("key"), "parent", "n")

    a = frame("supplier", "s_nationkey", "s_acctbal", 4000.0).unionByName(region)
    b = frame("customer", "c_nationkey", "c_acctbal", 4500.0).unionByName(region.where("key <> 'region:2'"))
    out = frames.frame_diff(a, b, "key", "parent", ["n"])
    return out.select("key", "status", "a_n", "b_n", "from_parent", "to_parent")


FRAME = """WITH a AS (SELECT 'nation:' || n_nationkey AS key, 'region:' || n_regionkey AS parent, count(*) AS n
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING avg(s_acctbal) > 4000
  UNION ALL SELECT 'region:' || r_regionkey, NULL, -1 FROM region),
b AS (SELECT 'nation:' || n_nationkey AS key, 'region:' || n_regionkey AS parent, count(*) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING avg(c_acctbal) > 4500
  UNION ALL SELECT 'region:' || r_regionkey, NULL, -1 FROM region WHERE r_regionkey <> 2),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ka, b.key AS kb, a.n AS an, b.n AS bn, a.parent AS pa, b.parent AS pb FROM a FULL JOIN b ON a.key = b.key)
SELECT j.key, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN 'update' WHEN kb IS NOT NULL THEN 'enter' ELSE 'exit' END AS status,
CASE WHEN ka IS NULL THEN x.n ELSE an END AS a_n, CASE WHEN kb IS NULL THEN y.n ELSE bn END AS b_n,
ka IS NULL AND x.key IS NOT NULL AS from_parent, kb IS NULL AND y.key IS NOT NULL AS to_parent
FROM j LEFT JOIN a x ON j.ka IS NULL AND j.pb = x.key LEFT JOIN b y ON j.kb IS NULL AND j.pa = y.key"""


def previous_vertex(spark, d):
    """Each user's events with the gap to the one before, summed per type."""
    from ..operators.ordered import previous

    t = previous(feed(spark, d), ["user_id"], "t", {"pt": "t", "pv": "value"}, tie=["event_id"])
    return t.groupBy("event_type").agg(F.count("pt").alias("n"), r(F.sum(F.col("t") - F.col("pt")), 3).alias("gap"),
                                       r(F.sum(F.col("value") - F.col("pv")), 2).alias("rise"))


PREVIOUS = f"""WITH {FEED}, q AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_type, count(pt) AS n, round(sum(t - pt), 3) AS gap, round(sum(value - pv), 2) AS rise FROM q GROUP BY 1"""


def running_values(spark, d):
    from ..operators.ordered import running_sum

    t = running_sum(feed(spark, d), ["event_type"], "t", "value", "upto", tie=["event_id"])
    return t.select("event_id", r("upto", 2).alias("upto"))


RUNNING = f"""WITH {FEED} SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY t, event_id), 2) AS upto FROM f"""


def running_nulls(spark, d):
    """The same where two values in three are missing, the first ones among them, in buckets of some hundred rows."""
    from ..operators.ordered import running_sum

    e = feed(spark, d).withColumn("v", F.when((F.col("event_id") % 3 == 0) & (F.col("t") > 86400.0), F.round("value")))
    return running_sum(e, ["event_type"], "t", "v", "upto", tie=["event_id"], group_rows=500).select("event_id", "upto")


RUNNING_NULLS = f"""WITH {FEED}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 AND t > 86400 THEN round(value) END AS v FROM f)
SELECT event_id, sum(v) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM v"""


def running_ties(spark, d):
    """Rows of three times only, ordered within a time by their id, in buckets of some hundred rows."""
    from ..operators.ordered import previous, running_sum

    e = feed(spark, d).select("event_id", (F.col("event_id") % 3).cast("double").alias("t"), F.round("value").alias("v"))
    return previous(running_sum(e, [], "t", "v", "upto", tie=["event_id"], group_rows=500), [], "t", {"before": "event_id"}, tie=["event_id"], group_rows=500) \
        .select("event_id", "upto", "before")


RUNNING_TIES = """SELECT event_id, sum(round(value)) OVER w AS upto, lag(event_id) OVER (ORDER BY event_id % 3, event_id) AS before
FROM events WINDOW w AS (ORDER BY event_id % 3, event_id ROWS UNBOUNDED PRECEDING)"""


def column_types(spark, d):
    """An array column as rows: a histogram of every component per label, with its highest value per bin."""
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("label", F.col("k").cast("long").alias("k"), grid.cell("x", 0.1).alias("i")).agg(F.count("*").alias("n"), r(F.max("x")).alias("top"))


COLUMN_TYPES = """SELECT label, k, CAST(floor(x / 0.1) AS BIGINT) AS i, count(*) AS n, round(max(x), 6) AS top FROM (
SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL"""

QUERIES = {
    "running_nulls": (running_nulls, RUNNING_NULLS),
    "running_ties": (running_ties, RUNNING_TIES),
    "truthy_filter": (truthy_filter, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount <> 0 GROUP BY 1"),
    "formula": (formula, """SELECT l_linestatus, round(min(h), 4) AS lo, round(max(h), 4) AS hi, round(sum(h), 2) AS total FROM (
        SELECT l_linestatus, least(60000.0, greatest(5000.0, l_extendedprice * (1 - l_discount))) AS h FROM lineitem) GROUP BY 1"""),
    "sql_step": (sql_step, """SELECT l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem
        WHERE l_quantity < 30 AND l_discount >= 0.03 AND l_discount < 0.07 GROUP BY 1"""),
    "structured_predicate": (structured_predicate, """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25
        AND l_returnflag IN ('A', 'R') AND l_tax BETWEEN 0.02 AND 0.06 GROUP BY 1"""),
    "label_counts": (label_counts, """SELECT CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Not returned' ELSE 'Other' END AS label,
        min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS o, count(*) AS n FROM lineitem GROUP BY 1"""),
    "class_band_heatmap": (class_band_heatmap, f"""WITH {POINTS} SELECT CASE label WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'Not returned' ELSE 'Other' END AS label,
        CAST(floor((z - 200) / 100) * 100 + 200 AS BIGINT) AS band, count(*) AS n FROM p WHERE z >= 200 AND z < 2000 GROUP BY 1, 2"""),
    "filtered_cells": (filtered_cells, f"""WITH {POINTS} SELECT CAST(floor(x / 5000) * 5000 AS BIGINT) AS cx, CAST(floor(y / 5) * 5 AS BIGINT) AS cy,
        max(z) AS h FROM p WHERE label = 'R' AND x < 50000 GROUP BY 1, 2"""),
    "nice_bins": (nice_bins, NICE_BINS),
    "bin_options": (bin_options, BIN_OPTIONS),
    "vl_aggregate": (vl_aggregate, """SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS valid, count(*) - count(l_tax) AS missing,
        round(sum(l_quantity), 2) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_quantity), 6) AS mean,
        round(var_samp(l_quantity), 6) AS var, round(var_pop(l_quantity), 6) AS varp, round(stddev_samp(l_quantity), 6) AS sd,
        round(stddev_pop(l_quantity), 6) AS sdp, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2"""),
    "stack_shares": (stack_shares, f"""WITH {POINTS}, h AS (SELECT label, CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS value FROM p GROUP BY 1, 2),
        s AS (SELECT *, CAST(sum(value) OVER (PARTITION BY label ORDER BY bin) - value AS BIGINT) AS start,
          CAST(sum(value) OVER (PARTITION BY label) AS BIGINT) AS total FROM h)
        SELECT *, round(start / total, 9) AS x0, round((start + value) / total, 9) AS x1 FROM s"""),
    "bin_positions": (bin_positions, BIN_POSITIONS),
    "context_layer": (context_layer, CONTEXT),
    "robust_norm": (robust_norm, ROBUST),
    "domains": (domains, DOMAINS),
    "log_tints": (log_tints, LOG_TINTS),
    "field_extents": (field_extents, """SELECT 'points' AS mark, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem
        UNION ALL SELECT 'bar', least(0.0::DOUBLE, min(l_extendedprice)), greatest(0.0::DOUBLE, max(l_extendedprice)) FROM lineitem"""),
    "zoom_quarter": (zoom_quarter, ZOOM),
    "weighted_histogram": (weighted_histogram, f"""WITH {POINTS} SELECT CAST(floor(y / 5) AS BIGINT) AS bin, round(sum(intensity), 4) AS weight FROM p GROUP BY 1"""),
    "hour_means": (hour_means, HOUR_MEANS),
    "frame_update": (frame_update, FRAME),
    "previous_vertex": (previous_vertex, PREVIOUS),
    "running_values": (running_values, RUNNING),
    "column_types": (column_types, COLUMN_TYPES),
}
