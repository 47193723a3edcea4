"""Exact order statistics of columns too large to sort in one task.

While the largest group is one a task can sort, a window ranks its values.
Beyond that, equal values are first merged into (value, count); buckets from
`ordered` locate the wanted ranks by counts alone, and only the buckets that
hold one are sorted. Both are exact; where buckets begin only balances them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import ordered

Rank = Callable[[Column], Column]
BINS = 1 << 12  # of one histogram of `lowest`, which the driver reads
ROUNDS = 8  # histograms of `lowest` at most
EDGE_ROWS = 1 << 14  # rows that one task of `lowest` may sort


def order_statistics(df: DataFrame, value: str, ranks: Mapping[str, Rank], by: Sequence[str] = (),
                     weight: str | None = None, largest: int | None = None,
                     group_rows: int = ordered.GROUP_ROWS) -> DataFrame:
    """Per group, the value at each 0-based rank; a rank is a function of the
    group's count `n` of non-null values. Also returns `n`. Groups without
    values are left out. `weight` names a count column of rows already merged;
    `largest` bounds the rows of a group, where the caller knows it."""
    by = list(by)
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    grouping = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    many = F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.select(*grouping, F.col(value).alias("_v"), many.alias("_c")).where(F.col("_v").isNotNull())
    if largest is None:
        largest = ordered.largest_group(rows, keys)
    group = Window.partitionBy(*keys)
    if largest <= group_rows:
        upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumn("_n", F.sum("_c").over(group)).withColumn("_to", F.sum("_c").over(upto))
    else:
        placed = _placed(rows, keys, ranks, group_rows)
    at = lambda r: r(F.col("_n")).cast("long")
    hit = lambda r: (at(r) >= F.col("_to") - F.col("_c")) & (at(r) < F.col("_to"))
    out = placed.groupBy(*keys).agg(F.max("_n").alias("n"),
                                    *[F.max(F.when(hit(r), F.col("_v"))).alias(name) for name, r in ranks.items()])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "n", *ranks)


def _placed(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank], group_rows: int) -> DataFrame:
    """The merged values of every bucket that holds a wanted rank, with the
    group's count `_n` and the count `_to` of values up to and with each."""
    counts = rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    counts = ordered.dealt(counts, ["_v", *keys], group_rows)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    tally = (
        counts.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_m"))
        .select(*keys, "_bucket", F.sum("_m").over(group).alias("_n"), F.sum("_m").over(upto).alias("_end"),
                (F.sum("_m").over(upto) - F.col("_m")).alias("_start"))
    )
    wanted = F.lit(False)
    for r in ranks.values():
        at = r(F.col("_n")).cast("long")
        wanted = wanted | ((at >= F.col("_start")) & (at < F.col("_end")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.same_key_join(counts, tally.where(wanted).drop("_end"), [*keys, "_bucket"]) \
        .withColumn("_to", F.col("_start") + F.sum("_c").over(inside))


def percentiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (),
                weight: str | None = None, largest: int | None = None,
                group_rows: int = ordered.GROUP_ROWS) -> DataFrame:
    """Exact percentiles with linear interpolation (the SQL `percentile_cont`)."""
    ranks: dict[str, Rank] = {}
    for name, p in shares.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    at = order_statistics(df, value, ranks, by, weight, largest, group_rows)
    cols = []
    for name, p in shares.items():
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        share = (F.col("n") - 1) * F.lit(float(p))
        cols.append((lo + (hi - lo) * (share - F.floor(share))).alias(name))
    return at.select(*by, "n", *cols)


def nearest_rank(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The value at rank round((n - 1) p), halves rounding up."""
    ranks = {name: (lambda n, p=p: F.floor((n - 1) * F.lit(float(p)) + F.lit(0.5))) for name, p in shares.items()}
    return order_statistics(df, value, ranks, by)


def lowest(df: DataFrame, order: Sequence[str], k: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The first k rows in the order of the columns `order` (NULL first, NaN last), in no order themselves.

    Histograms of the first column, each of the bin of the one before that holds the k-th row, find a range of values
    with few rows: all rows below it are in, and the range alone is sorted. Where the range stays large, because many rows
    share a value or the column is no number, its rows are range-partitioned by the whole order and the part that
    holds the k-th row alone is sorted. Rows that tie in all of `order` are told apart by a hash. No task sees
    more than some `edge_rows` rows, whatever k is."""
    if k <= 0:
        return df.limit(0)
    first, numeric = F.col(f"`{order[0]}`"), isinstance(df.schema[order[0]].dataType, NumericType)
    sure, edge, need, size = [], df, k, None
    if numeric:
        sure, edge, need, size = _edge(df, first.cast("double"), k, edge_rows)
    else:
        size = df.count()
    if size <= need:
        return _all([*sure, edge])
    rank = [*order, "_tie"]
    edge = ordered.with_tie(edge)
    if size > edge_rows:
        rows = ordered.dealt(edge, rank, edge_rows, size)
        tally = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("_bucket").collect()  # a row per partition
        last = 0
        for last, n in tally:
            if n >= need:
                break
            need -= n
        sure.append(rows.where(F.col("_bucket") < last).select(*df.columns))
        edge = rows.where(F.col("_bucket") == last)
    return _all([*sure, edge.orderBy(*rank).limit(need).select(*df.columns)])


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _edge(df: DataFrame, v: Column, k: int, edge_rows: int) -> tuple[list[DataFrame], DataFrame, int, int]:
    """The rows surely among the first k, and a range of `v` with the wanted number of its first rows and its size."""
    finite = F.abs(v) < F.lit(math.inf)
    kinds = [v.isNull(), v == F.lit(-math.inf), finite, v == F.lit(math.inf), F.isnan(v)]
    seen = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(kinds)], F.min(F.when(finite, v)).alias("lo"),
                  F.max(F.when(finite, v)).alias("hi")).first()
    sure, need = [], k
    for i, kind in enumerate(kinds):
        if seen[i] >= need or i == len(kinds) - 1:
            break
        need -= seen[i]
        if seen[i]:
            sure.append(df.where(kind))
    size, lo, hi = seen[i], seen.lo, seen.hi
    if i != 2:
        return sure, df.where(kind), need, size
    below = lo
    for _ in range(ROUNDS):
        width = hi - lo
        if size <= max(edge_rows, need) or not 0 < width < math.inf:
            break
        at = F.least(F.floor((v - F.lit(lo)) / F.lit(width) * BINS), F.lit(BINS - 1))
        bins = df.where((v >= F.lit(lo)) & (v <= F.lit(hi))).groupBy(at.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("bin").collect()  # BINS rows
        for b in bins:
            if b.n >= need:
                break
            need -= b.n
        size, lo, hi = b.n, b.lo, b.hi
    if lo > below:
        sure.append(df.where(v < F.lit(lo)).where(finite))
    return sure, df.where((v >= F.lit(lo)) & (v <= F.lit(hi))), need, size
