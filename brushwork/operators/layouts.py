"""Histograms laid out as bars or as one stack, and what moves between layouts.

A histogram here is a table `bin, lo, hi, n` (one row per chart bin). Up to FEW
bins are read by every row through one scalar array; more are met by an as-of
join, sorted with the values. Both give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import GROUP_ROWS, as_of, running_sum

FEW = 256  # bins that every row reads as one array


def shares(bins: DataFrame, order: str = "bin", count: str = "n", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Stacked-share layout: bin i spans [before / total, (before + n) / total].
    Beyond `group_rows` bins, running counts are taken per range of bins."""
    total = bins.agg(F.greatest(F.sum(count).cast("double"), F.lit(2.2250738585072014e-308))).scalar()
    out = running_sum(bins, [], order, count, "_to", group_rows=group_rows).withColumn("_total", total)
    return out.withColumn("x0", (F.col("_to") - F.col(count)) / F.col("_total")).withColumn("x1", F.col("_to") / F.col("_total")) \
        .drop("_to", "_total")


def _bin() -> Column:
    return F.struct(*[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "n", "x0", "x1")])


def _few(bins: DataFrame, few: int) -> bool:
    return bins.limit(few + 1).count() <= few


def _layout(bins: DataFrame) -> Column:
    """The bins in order, as an array of structs."""
    return shares(bins, "lo").agg(F.sort_array(F.collect_list(_bin()))).scalar()


def _ends(df: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds where the first bin begins and the last one ends."""
    first, last = F.min(F.struct("lo", "hi")), F.max(F.struct("lo", "hi"))
    ends = bins.agg(F.struct(first["lo"].cast("double").alias("lo"), last["hi"].cast("double").alias("hi"))).scalar()
    return df.withColumn("_e", ends)


def _hold(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def position(df: DataFrame, value: str, bins: DataFrame, stacked: bool, name: str = "u", few: int = FEW,
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """Unit x of each value in the bars, or in the stack, held to the ends."""
    v = F.col(value).cast("double")
    if not stacked:
        e = F.col("_e")
        u = _hold((v - e["lo"]) / (e["hi"] - e["lo"]))
        return _ends(df, bins).withColumn(name, F.when(v.isNotNull(), u)).drop("_e")
    at, b = F.col("_at"), F.col("_b")
    # The last bin whose edge is not beyond the value; the first one at least.
    if _few(bins, few):
        later = F.size(F.filter(F.slice(b, 2, 1 << 30), lambda e: e["lo"] <= v))
        met = df.withColumn("_b", _layout(bins)).withColumn("_at", F.get(b, later)).drop("_b")
    else:
        placed = shares(bins, "lo", group_rows=group_rows)
        met = as_of(df, v, placed, F.col("lo"), _bin(), "_at", group_rows) \
            .withColumn("_b", placed.agg(F.min(_bin())).scalar()).withColumn("_at", F.coalesce(at, b)).drop("_b")
    inside = _hold((v - at["lo"]) / (at["hi"] - at["lo"]))
    return met.withColumn(name, F.when(v.isNotNull(), at["x0"] + inside * (at["x1"] - at["x0"]))).drop("_at")


def value_at(df: DataFrame, u: str, bins: DataFrame, stacked: bool, name: str = "value", few: int = FEW,
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """The inverse of `position`. No x falls in an empty bin of the stack; NULL has no value."""
    x = _hold(F.col(u).cast("double"))
    e, hit, b = F.col("_e"), F.col("_hit"), F.col("_b")
    df = _ends(df, bins)
    if not stacked:
        return df.withColumn(name, F.when(F.col(u).isNotNull(), e["lo"] + x * (e["hi"] - e["lo"]))).drop("_e")
    if _few(bins, few):
        first = F.get(F.filter(b, lambda one: (one["n"] > 0) & (x <= one["x1"])), F.lit(0))
        met = df.withColumn("_b", _layout(bins)).withColumn("_hit", first).drop("_b")
    else:
        # The first bin that ends at x or beyond is the last one from the other end; of bins that end alike, the lowest.
        full = shares(bins, "lo", group_rows=group_rows).where(F.col("n") > 0)
        back = F.struct((-F.col("lo").cast("double")).alias("back"), _bin().alias("bin"))
        met = as_of(df, -x, full, -F.col("x1"), back, "_hit", group_rows).withColumn("_hit", hit["bin"])
    share = _hold((x - hit["x0"]) / (hit["x1"] - hit["x0"]))
    v = F.when(hit.isNull(), e["hi"]).otherwise(hit["lo"] + share * (hit["hi"] - hit["lo"]))
    return met.withColumn(name, F.when(F.col(u).isNotNull(), v)).drop("_hit", "_e")


def context(bins: DataFrame, layer: DataFrame, on: str = "bin", count: str = "n") -> DataFrame:
    """A filtered layer inside its context: every bin with both counts and the
    layer's share of the bin."""
    part = layer.select(on, F.col(count).alias("_part"))
    joined = bins.join(part, on, "left").withColumn("layer", F.coalesce("_part", F.lit(0)))
    share = F.when(F.col(count) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("layer") / F.col(count)))) \
        .otherwise(F.lit(0.0))
    return joined.drop("_part").withColumn("share", share)


def clip(bins: DataFrame, lo: float, hi: float) -> DataFrame:
    """The part of each bin within a range; bins that do not meet it go."""
    a, b = F.greatest(F.col("lo"), F.lit(float(lo))), F.least(F.col("hi"), F.lit(float(hi)))
    return bins.withColumn("clip_lo", a).withColumn("clip_hi", b).where(F.col("clip_lo") < F.col("clip_hi"))
