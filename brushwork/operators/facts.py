"""Facts a chart's rows state: shares, ranks, extremes, trends, outliers, fits."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import ranks
from .transforms import top_k


def rank_facts(df: DataFrame, keys: Sequence[str], value: str, k: int = 3) -> DataFrame:
    """The k largest rows with their share of the whole, and the smallest row,
    as `fact, rank, <keys>, value, share`. Ties go to the lesser key."""
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    total = rows.agg(F.sum("value")).scalar()
    largest = top_k(rows, [F.col("value").desc(), *[F.col(c) for c in keys]], k) \
        .select(F.when(F.col("rank") == 1, "proportion").otherwise("rank").alias("fact"), "rank", *keys, "value")
    least = rows.agg(F.min(F.struct("value", *keys)).alias("m")).select(
        F.lit("fewest").alias("fact"), F.lit(1).alias("rank"), *[F.col(f"m.{c}").alias(c) for c in keys],
        F.col("m.value").alias("value"))
    return largest.unionByName(least).withColumn("share", F.col("value") / total)


def trend(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per series: count, peak (the last of equal ones), least-squares slope
    and its direction: flat where the fitted change over the span is under a
    tenth of the mean."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(F.col(key).alias(key), xs.alias("x"), ys.alias("y")).where(F.col("y").isNotNull())
    fit = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("y", "x")).alias("_peak"),
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
        (F.max("x") - F.min("x")).alias("_span"), F.avg("y").alias("_mean"))
    way = F.when(F.abs("slope") * F.col("_span") < F.col("_mean") * 0.1, "flat") \
        .when(F.col("slope") > 0, "rising").otherwise("falling")
    return fit.select(key, "n", F.col("_peak.x").alias("peak_x"), F.col("_peak.y").alias("peak_y"), "slope", way.alias("direction"))


def peaks(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Heatmap distribution: per row key, the column of its peak (the greatest
    of equal ones) and the peak."""
    return df.groupBy(row).agg(F.max(F.struct(F.col(value).alias("v"), F.col(column).alias("c"))).alias("_m")) \
        .select(row, F.col("_m.c").alias(column), F.col("_m.v").alias("peak"))


def extreme(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The largest row; of equal ones that of the least keys. No row where there is no value."""
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    return top_k(rows, [F.col("value").desc(), *[F.col(c) for c in keys]], 1).drop("rank")


FACT = {"fact": "string", "rank": "long", "key": "string", "at": "string", "value": "double", "share": "double", "slope": "double",
        "direction": "string", "lo": "double", "hi": "double"}


def _facts(df: DataFrame, **columns: Column) -> DataFrame:
    """Facts in the common shape, NULL where a column does not apply."""
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FACT.items()])


def chart(df: DataFrame, mark: str, keys: Sequence[str], value: str) -> DataFrame:
    """All facts of a chart by its mark, in the columns of FACT; `key` joins several keys by a dot.

    Bars and arcs state the share of the largest row, the ranks after it and the fewest; lines the highest point and
    the trend of every series (first key) over the second key; heatmaps the largest cell and where each row (first
    key) peaks; other marks the highest. From four rows up, the number of outliers and the fences follow."""
    if mark in ("line", "heatmap") and len(keys) != 2:
        raise ValueError(f"facts of a {mark} need two keys")
    rows = materialise(df.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull()), "facts")
    named = F.concat_ws(" \u00b7 ", *[F.col(k).cast("string") for k in keys])
    one, v = F.lit(1), F.col("value")
    if mark in ("bar", "arc"):
        ranked = rank_facts(rows, keys, "value")
        name = F.when(F.col("fact") == "fewest", "extreme").otherwise(F.col("fact"))
        out = [_facts(ranked, fact=name, rank=F.col("rank"), key=named, value=v, share=F.col("share"))]
    else:
        out = [_facts(extreme(rows, keys, "value"), fact=F.lit("extreme"), rank=one, key=named, value=v)]
    if mark == "line":
        t = trend(rows, keys[0], keys[1], "value")
        out.append(_facts(t, fact=F.lit("trend"), rank=one, key=F.col(keys[0]), at=F.col("peak_x"), value=F.col("peak_y"),
                          slope=F.col("slope"), direction=F.col("direction")))
    elif mark == "heatmap":
        p = peaks(rows, keys[0], keys[1], "value")
        out.append(_facts(p, fact=F.lit("distribution"), rank=one, key=F.col(keys[0]), at=F.col(keys[1]), value=F.col("peak")))
    lo, hi = fences()
    q = ranks.percentiles(rows, "value", {"q1": 0.25, "q3": 0.75}).where(F.col("n") >= 4).select(F.struct(lo.alias("lo"), hi.alias("hi")))
    far = rows.withColumn("_f", q.scalar()).groupBy("_f").agg(F.count_if((v < F.col("_f.lo")) | (v > F.col("_f.hi"))).alias("n")).where(F.col("_f").isNotNull())
    out.append(_facts(far, fact=F.lit("outlier"), rank=one, value=F.col("n"), lo=F.col("_f.lo"), hi=F.col("_f.hi")))
    return reduce(DataFrame.unionByName, out)


def fences(whisker: float = 1.5) -> tuple[Column, Column]:
    """The two fences, from the columns q1 and q3."""
    reach = (F.col("q3") - F.col("q1")) * whisker
    return F.col("q1") - reach, F.col("q3") + reach


def outliers_iqr(df: DataFrame, value: str, whisker: float = 1.5) -> DataFrame:
    """Rows outside `whisker` interquartile ranges of the quartiles, with the
    two fences. Fewer than four values have no outliers."""
    q = ranks.percentiles(df, value, {"q1": 0.25, "q3": 0.75})
    lo, hi = fences(whisker)
    fence = q.where(F.col("n") >= 4).select(F.struct(lo.alias("lo"), hi.alias("hi"))).scalar()
    out = df.withColumn("_f", fence)
    return out.where((F.col(value) < F.col("_f.lo")) | (F.col(value) > F.col("_f.hi"))) \
        .withColumn("fence_lo", F.col("_f.lo")).withColumn("fence_hi", F.col("_f.hi")).drop("_f")


def similarity_fit(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Best similarity transform of points a to points b: scale, rotation in
    degrees and the largest residual. All sums are centred moments of one
    pass; the residual takes a second."""
    (x, y), (u, v) = a, b
    n = F.count(F.lit(1))
    re = (F.covar_pop(u, x) + F.covar_pop(v, y)) * n
    im = (F.covar_pop(v, x) - F.covar_pop(u, y)) * n
    den = (F.var_pop(x) + F.var_pop(y)) * n
    fit = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"), F.avg(v).alias("mv"),
                 (re / den).alias("sr"), (im / den).alias("si"))
    f = lambda c: F.col(f"_f.{c}")
    px, py = F.col(x) - f("mx"), F.col(y) - f("my")
    du = f("sr") * px - f("si") * py + f("mu") - F.col(u)
    dv = f("si") * px + f("sr") * py + f("mv") - F.col(v)
    pts = df.withColumn("_f", fit.select(F.struct("*")).scalar())
    return pts.agg(F.max(F.hypot(du, dv)).alias("residual"), F.max("_f").alias("_f")).select(
        F.hypot(f("sr"), f("si")).alias("scale"), F.degrees(F.atan2(f("si"), f("sr"))).alias("rotation"), "residual")
