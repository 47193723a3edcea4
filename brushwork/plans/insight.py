"""Profiles, drift, facts, outliers, fits and lenses over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, grid, lens, ordered, profile as prof, ranks, transforms as tr
from .data import FEED, POINTS, TABLES, feed, load, points, r

# Columns of the SQL side, in table order: name, whether numeric.
LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def _rounded(p):
    return p.select("position", "column", "type", "rows", "distinct", "nulls", "min", "max",
                    r("p90", 4).alias("p90"), r("p999", 4).alias("p999"), "role")


def profile_lineitem(spark, d):
    return _rounded(prof.profile(load(spark, d, "lineitem")))


def profile_documents(spark, d):
    return _rounded(prof.profile(load(spark, d, "documents")))


def _profile_sql(table, columns, where="", suffix=""):
    parts = []
    for i, (c, kind) in enumerate(columns):
        number = kind in ("bigint", "int", "double")
        stats = (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.9), 4) AS p90, "
                 f"round(quantile_cont(CAST({c} AS DOUBLE), 0.999), 4) AS p999, 'measure' AS role") if number else (
                 "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS p90, NULL::DOUBLE AS p999, "
                 f"CASE WHEN min(CAST({c} AS VARCHAR)) LIKE 'POINT%' OR min(CAST({c} AS VARCHAR)) LIKE 'POLYGON%' OR min(CAST({c} AS VARCHAR)) LIKE 'LINESTRING%' "
                 f"THEN 'geometry' WHEN count(DISTINCT {c}) <= 50 THEN 'category' ELSE 'text' END AS role")
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS \"rows\", count(DISTINCT {c}) AS \"distinct\", "
                     f"count(*) - count({c}) AS nulls, {stats} FROM {table} {where}")
    return " UNION ALL ".join(parts)


def tables_overview(spark, d):
    o = prof.overview({t: load(spark, d, t) for t in TABLES})
    return o.select("table", "position", "column", "type", "rows", "min", "max", "distinct")


ALL_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": LINEITEM,
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": DOCUMENTS,
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}


def _overview_sql():
    parts = []
    for t, columns in ALL_COLUMNS.items():
        for i, (c, kind) in enumerate(columns):
            none = "NULL::DOUBLE AS min, NULL::DOUBLE AS max"
            stats = f"{none}, count(DISTINCT {c}) AS \"distinct\"" if kind == "string" else \
                f"{none}, NULL::BIGINT AS \"distinct\"" if kind in ("timestamp_ntz", "array<float>") else \
                f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, NULL::BIGINT AS \"distinct\""
            parts.append(f"SELECT '{t}' AS \"table\", {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS \"rows\", {stats} FROM {t}")
    return " UNION ALL ".join(parts)


def _half():
    return F.when(F.col("l_shipdate") < "1998-01-01", "old").when(F.month("l_shipdate") <= 6, "first").otherwise("second")


def _early(spark, d):
    """Line items of the years before 1998, all columns but their tax."""
    return load(spark, d, "lineitem").where("l_shipdate < '1998-01-01'").drop("l_tax").withColumn("half", _half()).withColumn("note", F.lit("early"))


def _late(spark, d):
    """All others, with tax; the highest order key is a thousand times larger."""
    t = load(spark, d, "lineitem").where("l_shipdate >= '1998-01-01'")
    top = t.agg(F.max("l_orderkey")).scalar()
    return t.withColumn("l_orderkey", F.when(F.col("l_orderkey") == top, F.col("l_orderkey") * 1000).otherwise(F.col("l_orderkey"))).withColumn("half", _half())


def drift(spark, d):
    """What changed between the profiles of early and late line items, over all their rows and columns."""
    out = prof.drift(prof.profile(_early(spark, d)), prof.profile(_late(spark, d)))
    return out.select("column", "change", "was", "now", r("percent", 4).alias("percent"))


def _drift_sql():
    parts, far = [], lambda c, t: f"(SELECT max({c}) - quantile_cont({c}::DOUBLE, 0.999) > 0.5 * greatest(abs(quantile_cont({c}::DOUBLE, 0.999) - min({c})), 1e-9) FROM {t})"
    for c, kind in LINEITEM:
        if c == "l_tax":
            continue
        if kind in ("bigint", "int", "double"):
            parts.append(f"""SELECT '{c}' AS "column", 'extreme value' AS change, (SELECT max({c}) FROM a)::DOUBLE AS was, (SELECT max({c}) FROM b)::DOUBLE AS now, NULL AS percent
WHERE {far(c, 'b')} AND NOT {far(c, 'a')}""")
    for c in [c for c, kind in LINEITEM if kind not in ("bigint", "int", "double")] + ["half"]:
        count = lambda t: f"(SELECT count(DISTINCT {c}) FROM {t})"
        parts.append(f"SELECT '{c}', 'new categories', {count('a')}::DOUBLE, {count('b')}::DOUBLE, NULL WHERE {count('b')} <= 50 AND {count('b')} > {count('a')}")
    return """WITH n AS (SELECT *, CASE WHEN l_shipdate < '1998-01-01' THEN 'old' WHEN month(l_shipdate) <= 6 THEN 'first' ELSE 'second' END AS half FROM lineitem),
a AS (SELECT * FROM n WHERE l_shipdate < '1998-01-01'),
b AS (SELECT * REPLACE (CASE WHEN l_orderkey = max(l_orderkey) OVER () THEN l_orderkey * 1000 ELSE l_orderkey END AS l_orderkey) FROM n WHERE l_shipdate >= '1998-01-01'),
s AS (SELECT (SELECT count(*) FROM a) AS ra, (SELECT count(*) FROM b) AS rb)
SELECT '*' AS "column", 'rows' AS change, ra::DOUBLE AS was, rb::DOUBLE AS now, round((rb::DOUBLE - ra) / ra * 100, 4) AS percent FROM s WHERE ra <> rb
UNION ALL SELECT 'note', 'removed column', 1.0, NULL, NULL
UNION ALL SELECT 'l_tax', 'new column', NULL, (SELECT count(DISTINCT l_tax) FROM b)::DOUBLE, NULL
UNION ALL """ + "\nUNION ALL ".join(parts)


DRIFT = _drift_sql()


def facts_rank(spark, d):
    t = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    f = facts.rank_facts(t, ["c_nationkey"], "n")
    return f.select("fact", F.col("rank").cast("long").alias("rank"), "c_nationkey", "value", r("share", 9).alias("share"))


FACTS = """WITH t AS (SELECT c_nationkey, count(*)::DOUBLE AS value FROM customer GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY value DESC, c_nationkey) AS rank, row_number() OVER (ORDER BY value, c_nationkey) AS low, sum(value) OVER () AS total FROM t)
SELECT CASE WHEN rank = 1 THEN 'proportion' ELSE 'rank' END AS fact, rank, c_nationkey, value, round(value / total, 9) AS share FROM k WHERE rank <= 3
UNION ALL SELECT 'fewest', 1, c_nationkey, value, round(value / total, 9) FROM k WHERE low = 1"""


def top_orders(spark, d):
    """The two dearest orders of each status."""
    return tr.top_k(load(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, ["o_orderstatus"]) \
        .select("o_orderstatus", F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


TOP = """SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice
FROM orders QUALIFY rank <= 2"""


def _daily(spark, d):
    return feed(spark, d).select("event_type", F.floor(F.col("t") / 86400).alias("day"), "value") \
        .groupBy("event_type", "day").agg(F.count("*").alias("n"))


def trend(spark, d):
    t = facts.trend(_daily(spark, d), "event_type", "day", "n")
    return t.select("event_type", "n", "peak_x", "peak_y", r("slope").alias("slope"), "direction")


TREND = f"""WITH {FEED}, s AS (SELECT event_type, floor(t / 86400) AS day, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2),
g AS (SELECT event_type, count(*) AS n, max(struct_pack(y := n, x := day)) AS top, coalesce(regr_slope(n, day), 0) AS slope, max(day) - min(day) AS span, avg(n) AS mean FROM s GROUP BY 1)
SELECT event_type, n, (top).x AS peak_x, (top).y AS peak_y, round(slope, 6) AS slope,
CASE WHEN abs(slope) * span < 0.1 * mean THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM g"""


def heat_peaks(spark, d):
    t = load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return facts.peaks(t, "p_brand", "p_size", "n")


PEAKS = """WITH t AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, (max(struct_pack(v := n, c := p_size))).c AS p_size, max(n) AS peak FROM t GROUP BY 1"""


def _shown(f):
    return f.select("fact", "rank", "key", "at", "value", *[r(c, 6).alias(c) for c in ("share", "slope")], "direction", *[r(c, 4).alias(c) for c in ("lo", "hi")])


def facts_bars(spark, d):
    """What a bar chart of customers per nation says."""
    return _shown(facts.chart(load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "bar", ["c_nationkey"], "n"))


def facts_lines(spark, d):
    """What a line chart of events per type and day says."""
    return _shown(facts.chart(_daily(spark, d).withColumn("day", F.col("day").cast("long")), "line", ["event_type", "day"], "n"))


def facts_heatmap(spark, d):
    """What a heatmap of parts per brand and size says."""
    return _shown(facts.chart(load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")), "heatmap", ["p_brand", "p_size"], "n"))


def _fact_sql(fact, rows="t", rank="1", key="NULL", at="NULL", value="NULL", share="NULL", slope="NULL", direction="NULL", lo="NULL", hi="NULL"):
    return f"""SELECT '{fact}' AS fact, CAST({rank} AS BIGINT) AS rank, CAST({key} AS VARCHAR) AS key, CAST({at} AS VARCHAR) AS at,
CAST({value} AS DOUBLE) AS value, round(CAST({share} AS DOUBLE), 6) AS share, round(CAST({slope} AS DOUBLE), 6) AS slope,
CAST({direction} AS VARCHAR) AS direction, round(CAST({lo} AS DOUBLE), 4) AS lo, round(CAST({hi} AS DOUBLE), 4) AS hi FROM {rows}"""


def _facts_sql(rows, keys, parts):
    """`parts` follow the rows `t` (keys, n), their quartile fences `e` and their ranks `k`."""
    order = ", ".join(keys)
    outlier = _fact_sql("outlier", "t, e GROUP BY lo, hi", value="count(*) FILTER (WHERE n < lo OR n > hi)", lo="lo", hi="hi")
    return f"""WITH {rows}, q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, count(*) AS many FROM t),
e AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE many >= 4),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, {order}) AS high, row_number() OVER (ORDER BY n, {order}) AS low, sum(n) OVER () AS total FROM t)
{" UNION ALL ".join([*parts, outlier])}"""


FACTS_BARS = _facts_sql("t AS (SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1)", ["c_nationkey"], [
    _fact_sql("proportion", "k WHERE high = 1", key="c_nationkey", value="n", share="n / total"),
    _fact_sql("rank", "k WHERE high IN (2, 3)", rank="high", key="c_nationkey", value="n", share="n / total"),
    _fact_sql("extreme", "k WHERE low = 1", key="c_nationkey", value="n", share="n / total")])
FACTS_LINES = _facts_sql(f"""{FEED}, t AS (SELECT event_type, CAST(floor(t / 86400) AS BIGINT) AS day, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2),
g AS (SELECT event_type, max(struct_pack(y := n, x := day)) AS top, coalesce(regr_slope(n, day), 0) AS slope, max(day) - min(day) AS span, avg(n) AS mean FROM t GROUP BY 1)""",
                         ["event_type", "day"], [
    _fact_sql("extreme", "k WHERE high = 1", key="event_type || ' \u00b7 ' || day", value="n"),
    _fact_sql("trend", "g", key="event_type", at="CAST((top).x AS DOUBLE)", value="(top).y", slope="slope",
              direction="CASE WHEN abs(slope) * span < 0.1 * mean THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END")])
FACTS_HEATMAP = _facts_sql("t AS (SELECT p_brand, p_size, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2)", ["p_brand", "p_size"], [
    _fact_sql("extreme", "k WHERE high = 1", key="p_brand || ' \u00b7 ' || p_size", value="n"),
    _fact_sql("distribution", "(SELECT p_brand, max(struct_pack(v := n, c := p_size)) AS top FROM t GROUP BY 1)", key="p_brand", at="(top).c", value="(top).v")])


def outliers(spark, d):
    t = load(spark, d, "events").select("event_id", "value")
    o = facts.outliers_iqr(t, "value")
    return o.select("event_id", "value", r("fence_lo", 4).alias("fence_lo"), r("fence_hi", 4).alias("fence_hi"))


OUTLIERS = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, round(q1 - 1.5 * (q3 - q1), 4) AS fence_lo, round(q3 + 1.5 * (q3 - q1), 4) AS fence_hi FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


def group_percentiles(spark, d):
    p = ranks.percentiles(load(spark, d, "lineitem"), "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p999": 0.999}, ["l_returnflag"])
    return p.select("l_returnflag", "n", *[r(c, 4).alias(c) for c in ("p10", "p50", "p999")])


def nearest_rank(spark, d):
    return ranks.nearest_rank(load(spark, d, "events"), "value", {"p25": 0.25, "p90": 0.9}, ["event_type"])


NEAREST = """WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(CASE WHEN i = floor((n - 1) * 0.25::DOUBLE + 0.5) THEN value END) AS p25,
max(CASE WHEN i = floor((n - 1) * 0.9::DOUBLE + 0.5) THEN value END) AS p90 FROM k GROUP BY 1"""


def highlight(spark, d):
    out = None
    for subset in ("top", "outliers"):
        h = prof.highlight(load(spark, d, "lineitem"), "l_extendedprice", subset)
        h = h.agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least")).select(F.lit(subset).alias("subset"), "n", "least")
        out = h if out is None else out.unionByName(h)
    return out


HIGHLIGHT = """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem)
SELECT 'top' AS subset, count(*) AS n, min(l_extendedprice) AS least FROM lineitem, q WHERE l_extendedprice > p90
UNION ALL SELECT 'outliers', count(*), min(l_extendedprice) FROM lineitem, q WHERE l_extendedprice > p999"""


def rate_series(spark, d):
    """Events per user and half hour since the user's first event."""
    t = feed(spark, d)
    first = t.groupBy("user_id").agg(F.min("t").alias("t0"))
    since = ordered.lookup(t.select("user_id", "t", "event_id"), first, "user_id", how="inner")
    return since.select("user_id", (grid.cell(F.col("t") - F.col("t0"), 1800.0) / 2.0).alias("hours")) \
        .groupBy("user_id", "hours").agg(F.count("*").cast("double").alias("n"))


RATE = f"""WITH {FEED}, m AS (SELECT user_id, min(t) AS t0 FROM f GROUP BY 1)
SELECT f.user_id, floor((t - t0) / 1800) / 2 AS hours, count(*)::DOUBLE AS n FROM f JOIN m ON f.user_id = m.user_id GROUP BY 1, 2"""

XD, YD = (0.0, 105000.0), (0.0, 51.0)
FOCUS, RADIUS = (0.5, 0.55), 0.3


def _under():
    return lens.inside(lens.unit(F.col("x"), XD), lens.unit(F.col("y"), YD), FOCUS, RADIUS)


UNDER = "sqrt((x / 105000.0 - 0.5) ** 2 + (y / 51.0 - 0.55) ** 2) <= 0.3"


def lens_regression(spark, d):
    f = lens.regression(points(spark, d), _under(), "label", "x", "y")
    return f.select("label", "n", r("slope", 9).alias("slope"), r("intercept").alias("intercept"), r("r2").alias("r2"))


LENS_FIT = f"""WITH {POINTS} SELECT label, CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept,
round(regr_r2(y, x), 6) AS r2 FROM p WHERE {UNDER} GROUP BY 1 HAVING regr_count(y, x) >= 3"""


def lens_sample(spark, d):
    p = points(spark, d)
    key = F.concat_ws(":", "order_key", "line_number")
    return lens.sample(p, _under(), key, 0.25).groupBy("label").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("x"))


LENS_SAMPLE = f"""WITH {POINTS} SELECT label, count(*) AS n, round(sum(x), 2) AS x FROM p
WHERE NOT ({UNDER}) OR ('0x' || substr(md5(order_key || ':' || line_number), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25 GROUP BY 1"""


def lens_mole(spark, d):
    return lens.mole(points(spark, d), _under(), "z", 0.6).groupBy("label").agg(F.count("*").alias("n"), F.max("z").alias("z"))


LENS_MOLE = f"""WITH {POINTS}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM p)
SELECT label, count(*) AS n, max(z) AS z FROM p, e WHERE NOT ({UNDER}) OR (z - lo) / (hi - lo) <= 0.6 GROUP BY 1"""


def soft_interval(spark, d):
    """A soft box in unit space: rows kept at a degree of a half, and the faded weight of all."""
    p = points(spark, d)
    deg = lens.interval_degree(lens.unit(F.col("x"), XD), (0.3, 0.5), lens.unit(F.col("y"), YD), (0.2, 0.6), 0.2)
    p = p.withColumn("degree", deg)
    kept = lens.keep(p, F.col("degree")).groupBy("label").agg(F.count("*").alias("kept"))
    weight = p.groupBy("label").agg(r(F.sum(lens.fade(F.col("degree"))), 4).alias("weight"))
    return kept.join(weight, "label")


SOFT_INTERVAL = f"""WITH {POINTS}, g AS (SELECT label, greatest(0.3 - x / 105000.0, x / 105000.0 - 0.5, 0) AS gx, greatest(0.2 - y / 51.0, y / 51.0 - 0.6, 0) AS gy FROM p),
k AS (SELECT label, greatest(0.0, least(1.0, 1 - sqrt(gx * gx + gy * gy) / 0.2::DOUBLE)) AS dg FROM g)
SELECT label, count(*) FILTER (WHERE dg >= 0.5) AS kept, round(sum(0.15 + 0.85::DOUBLE * dg), 4) AS weight FROM k GROUP BY 1"""


def similarity(spark, d):
    """Points and their turned, scaled and slightly disturbed copy."""
    p = points(spark, d).select(F.col("x").alias("ax"), (F.col("y") * 1000).alias("ay"), "z")
    p = p.withColumn("bx", F.col("ax") * 0.6 - F.col("ay") * 0.8 + 100 + F.col("z") * 0.01) \
        .withColumn("by", F.col("ax") * 0.8 + F.col("ay") * 0.6 - 50)
    f = facts.similarity_fit(p, ("ax", "ay"), ("bx", "by"))
    return f.select(r("scale").alias("scale"), r("rotation").alias("rotation"), r("residual", 4).alias("residual"))


SIMILARITY = f"""WITH {POINTS}, q AS (SELECT x AS ax, y * 1000 AS ay, x * 0.6::DOUBLE - y * 1000 * 0.8::DOUBLE + 100 + z * 0.01::DOUBLE AS bx, x * 0.8::DOUBLE + y * 1000 * 0.6::DOUBLE - 50 AS bw FROM p),
m AS (SELECT avg(ax) AS mx, avg(ay) AS my, avg(bx) AS mu, avg(bw) AS mv FROM q),
c AS (SELECT ax - mx AS x, ay - my AS y, bx - mu AS u, bw - mv AS v FROM q, m),
s AS (SELECT sum(u * x + v * y) / sum(x * x + y * y) AS sr, sum(v * x - u * y) / sum(x * x + y * y) AS si FROM c)
SELECT round(sqrt(sr * sr + si * si), 6) AS scale, round(degrees(atan2(si, sr)), 6) AS rotation,
round((SELECT max(sqrt((sr * x - si * y - u) ** 2 + (si * x + sr * y - v) ** 2)) FROM c), 4) AS residual FROM s"""

QUERIES = {
    "profile": (profile_lineitem, _profile_sql("lineitem", LINEITEM)),
    "profile_documents": (profile_documents, _profile_sql("documents", DOCUMENTS)),
    "overview": (tables_overview, _overview_sql()),
    "drift": (drift, DRIFT),
    "facts_rank": (facts_rank, FACTS),
    "facts_bars": (facts_bars, FACTS_BARS),
    "facts_lines": (facts_lines, FACTS_LINES),
    "facts_heatmap": (facts_heatmap, FACTS_HEATMAP),
    "top_orders": (top_orders, TOP),
    "trend": (trend, TREND),
    "heat_peaks": (heat_peaks, PEAKS),
    "outliers_iqr": (outliers, OUTLIERS),
    "group_percentiles": (group_percentiles, """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY 1"""),
    "nearest_rank": (nearest_rank, NEAREST),
    "highlight": (highlight, HIGHLIGHT),
    "rate_series": (rate_series, RATE),
    "lens_regression": (lens_regression, LENS_FIT),
    "lens_sample": (lens_sample, LENS_SAMPLE),
    "lens_mole": (lens_mole, LENS_MOLE),
    "soft_interval": (soft_interval, SOFT_INTERVAL),
    "similarity_fit": (similarity, SIMILARITY),
}
