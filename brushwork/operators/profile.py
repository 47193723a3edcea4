"""What a table holds: column statistics, roles, overviews, drift, highlights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import ranks

# Names taken as coordinates, prefixes of WKT geometry, and the
# most distinct texts a category may have.
COORDINATE_NAMES = ("x", "y", "cx", "cy", "lon", "lat", "easting", "northing", "gx", "gy")
WKT_PREFIXES = ("POINT", "POLYGON", "LINESTRING")
MAX_CATEGORIES = 50


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _distinct_key(c: Column) -> Column:
    """A short stand-in for a text in distinct counts: itself, or its SHA-256
    where it is longer than the digest."""
    return F.when(F.length(c) <= 64, c).otherwise(F.sha2(c, 256))


def _text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, distinct, nulls, and for
    numbers min, max and exact p90 and p99.9; with the column's role.

    Columns are unpivoted and merged to (column, value, count) on the map side,
    so one shuffle of distinct values serves every statistic."""
    fields = list(enumerate(df.schema.fields))
    numbers = [(i, f) for i, f in fields if _numeric(f.dataType)]
    texts = [(i, f) for i, f in fields if not _numeric(f.dataType)]
    parts = []
    if numbers:
        # Doubles order the values; whole numbers beyond 2^53 stay distinct by their text.
        entry = lambda i, f: F.struct(
            F.lit(i).alias("pos"), F.col(f"`{f.name}`").cast("double").alias("num"),
            (F.lit(None).cast("string") if isinstance(f.dataType, (T.DoubleType, T.FloatType))
             else F.when(F.abs(F.col(f"`{f.name}`").cast("double")) >= 2.0**53, F.col(f"`{f.name}`").cast("string"))).alias("key"))
        long = df.select(F.inline(F.array(*[entry(i, f) for i, f in numbers])))
        # Written once: the percentiles of a large table run over it several times, and the table itself is many times longer.
        counts = materialise(long.groupBy("pos", "num", "key").agg(F.count(F.lit(1)).alias("c")), "profile")
        stats = counts.groupBy("pos").agg(
            F.sum("c").alias("rows"), F.count("num").alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("num").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
            F.min("num").alias("min"), F.max("num").alias("max"))
        tails = ranks.percentiles(counts, "num", {"p90": 0.9, "p999": 0.999}, by=["pos"], weight="c").drop("n")
        parts.append(stats.join(tails, "pos", "left").withColumn("sample", F.lit(None).cast("string")))
    if texts:
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("pos"), _distinct_key(_text(f)).alias("key")) for i, f in texts])))
        counts = long.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("c"))
        stats = counts.groupBy("pos").agg(
            F.sum("c").alias("rows"), F.count("key").alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("c"))), F.lit(0)).alias("nulls"))
        # The least text of each column, to recognise WKT geometry.
        least = df.agg(*[F.min(_text(f)).alias(f"m{i}") for i, f in texts])
        least = least.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.col(f"m{i}").alias("sample")) for i, _ in texts])))
        none = F.lit(None).cast("double")
        parts.append(stats.join(least, "pos").select(
            "pos", "rows", "distinct", "nulls", none.alias("min"), none.alias("max"),
            none.alias("p90"), none.alias("p999"), "sample"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name, kind, numeric = F.element_at(F.array(*[F.lit(f.name) for _, f in fields]), F.col("pos") + 1), \
        F.element_at(F.array(*[F.lit(f.dataType.simpleString()) for _, f in fields]), F.col("pos") + 1), \
        F.element_at(F.array(*[F.lit(_numeric(f.dataType)) for _, f in fields]), F.col("pos") + 1)
    out = out.withColumn("column", name).withColumn("type", kind).withColumn("_numeric", numeric)
    return out.withColumn("role", role(F.col("column"), F.col("_numeric"), F.col("distinct"), F.col("sample"))).select(
        F.col("pos").alias("position"), "column", "type", "rows", "distinct", "nulls", "min", "max", "p90", "p999", "role")


def role(name: Column, numeric: Column, distinct: Column, sample: Column) -> Column:
    wkt = F.lit(False)
    for prefix in WKT_PREFIXES:
        wkt = wkt | sample.startswith(prefix)
    return (F.when(numeric & F.lower(name).isin(*COORDINATE_NAMES), "coordinate")
            .when(F.coalesce(wkt, F.lit(False)), "geometry")
            .when(~numeric & (distinct <= MAX_CATEGORIES), "category")
            .when(numeric, "measure").otherwise("text"))


def overview(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every table: its type, the table's row count, and
    its range, or for text its number of distinct values."""
    out = None
    for table, df in frames.items():
        aggs, rows = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(df.schema.fields):
            lo = hi = F.lit(None).cast("double")
            distinct = F.lit(None).cast("long")
            if _numeric(f.dataType):
                aggs += [F.min(f"`{f.name}`").cast("double").alias(f"lo{i}"), F.max(f"`{f.name}`").cast("double").alias(f"hi{i}")]
                lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
            elif isinstance(f.dataType, T.StringType):
                aggs.append(F.count_distinct(_distinct_key(F.col(f"`{f.name}`"))).alias(f"d{i}"))
                distinct = F.col(f"d{i}")
            rows.append(F.struct(F.lit(table).alias("table"), F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                 F.lit(f.dataType.simpleString()).alias("type"), F.col("rows").alias("rows"),
                                 lo.alias("min"), hi.alias("max"), distinct.alias("distinct")))
        part = df.agg(*aggs).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("overview needs at least one table")
    return out


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two profiles, one row per change: `column, change,
    was, now`. A changed row count has the column '*' and its percentage in
    `percent`; a measure drifts when its maximum jumped far beyond its own
    99.9th percentile and had not before."""
    a = before.select("column", *[F.col(c).alias(f"a_{c}") for c in ("rows", "distinct", "role", "min", "max", "p999")])
    b = after.select("column", *[F.col(c).alias(f"b_{c}") for c in ("rows", "distinct", "role", "min", "max", "p999")])
    both = materialise(a.join(b, "column", "full_outer"), "drift")  # a row per column, read twice

    def far(side: str) -> Column:
        top, p, low = (F.col(f"{side}_{c}") for c in ("max", "p999", "min"))
        return F.coalesce(top - p > F.greatest(F.abs(p - low), F.lit(1e-9)) * 0.5, F.lit(False))

    num = lambda c: F.col(c).cast("double")
    none = F.lit(None).cast("double")
    known = F.col("a_role").isNotNull() & F.col("b_role").isNotNull()
    change = lambda kind, when, was, now: F.when(when, F.struct(
        F.lit(kind).alias("change"), was.alias("was"), now.alias("now")))
    found = F.array_compact(F.array(
        change("new column", F.col("a_role").isNull(), none, num("b_distinct")),
        change("removed column", F.col("b_role").isNull(), num("a_distinct"), none),
        change("new categories", known & (F.col("b_role") == "category") & (F.col("b_distinct") > F.col("a_distinct")),
               num("a_distinct"), num("b_distinct")),
        change("extreme value", known & (F.col("b_role") == "measure") & far("b") & ~far("a"), num("a_max"), num("b_max")),
    ))
    columns = both.select("column", F.inline(found)).withColumn("percent", none)
    count = both.agg(F.max("a_rows").cast("double").alias("was"), F.max("b_rows").cast("double").alias("now")) \
        .where(F.col("was") != F.col("now")) \
        .select(F.lit("*").alias("column"), F.lit("rows").alias("change"), "was", "now",
                ((F.col("now") - F.col("was")) / F.greatest(F.col("was"), F.lit(1.0)) * 100).alias("percent"))
    return count.unionByName(columns)


def highlight(df: DataFrame, field: str, subset: str = "top") -> DataFrame:
    """Rows above an exact percentile of a measure: `top` is the upper tenth
    (p90), `outliers` what lies above p99.9. The threshold is a scalar subquery
    the scan can use."""
    share = {"top": 0.9, "outliers": 0.999}[subset]
    at = ranks.percentiles(df, field, {"t": share}).select("t").scalar()
    return df.where(F.col(field) > at)
