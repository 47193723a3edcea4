"""Order-dependent work that stays parallel when one key holds most rows.

A plain window sorts a whole key in one task. That is kept for keys whose
largest has at most `GROUP_ROWS` rows, which one aggregate finds out. Beyond that
rows are ordered by their whole rank (order, ties, a hash of the row, and a
number for rows equal in everything) into buckets of at most about as many rows,
by range partitions and, where those hold more, by places in them; windows run
per (key, bucket), and a small table of one row per (key, bucket) carries what
passes from one bucket to the next. Results do not depend on where the bounds
fall, nor on which of the two ways is taken: rows that tie are ordered by the
hash in both.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions

GROUP_ROWS = 1 << 20  # rows of one key that one task may sort
MAX_HOT = 1 << 20  # keys that can be called hot at once
PART_ROWS = 1 << 17  # rows of one partition, where buckets are smaller


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row. A filter on a plain computed
    column is pushed below it with the whole expression repeated at every
    mention; a generated column stays where it is."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))


def dealt(df: DataFrame, rank: Sequence[str], rows_each: int, total: int | None = None) -> DataFrame:
    """The rows, written once, with a `_bucket` that grows with their rank. Rows of one rank are dealt over buckets too.

    A partition is a bucket, but where buckets of `rows_each` rows are small, a sorted partition holds many: tasks, files and
    the driver's sample for the bounds grow with the rows of PART_ROWS, not with the buckets."""
    n = shuffle_partitions(df.sparkSession)
    if rows_each > 0:
        total = df.count() if total is None else total
        n = max(n, math.ceil(total / max(rows_each, PART_ROWS)))
    placed = df.withColumn("_number", F.monotonically_increasing_id()).repartitionByRange(n, *rank, "_number")
    if 0 < rows_each < PART_ROWS and total > n * rows_each:
        # The id after the sort is the partition's number times 2^33 and the row's place.
        placed = placed.sortWithinPartitions(*rank, "_number").withColumn("_number", F.monotonically_increasing_id())
        place = F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
        bucket = F.col("_number") - place + F.floor(place / F.lit(rows_each))
    else:
        bucket = F.spark_partition_id()
    return materialise(placed.withColumn("_bucket", bucket).drop("_number"), "ordered")


def with_tie(df: DataFrame) -> DataFrame:
    """Adds a hash of the row, which orders rows that tie in all else."""
    return df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """The rows of the largest key, and of all."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else df.agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """The rows of the largest key."""
    return group_sizes(df, by)[0]


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: str, name: str,
                tie: Sequence[str] = (), group_rows: int = GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """The sum of `value` up to and with each row, per key, in (order, tie) order.
    `largest` bounds the rows of a key, where the caller knows it."""
    by, columns, total = list(by), df.columns, None
    if largest is None:
        largest, total = group_sizes(df, by)
    df, rank = with_tie(df), [order, *tie, "_tie"]
    if largest <= group_rows:
        w = Window.partitionBy(*by).orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w)).select(*columns, name)
    rows = dealt(df, rank, group_rows, total)
    cell = [*by, "_bucket"]
    totals = rows.groupBy(*cell).agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*cell, F.sum("_total").over(ahead).alias("_ahead"))  # NULL while no value came
    inside = Window.partitionBy(*cell).orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside))
    so_far = F.coalesce(F.col("_inside") + F.col("_ahead"), F.col("_inside"), F.col("_ahead"))
    return same_key_join(summed, offsets, cell).withColumn(name, so_far).select(*columns, name)


def previous(df: DataFrame, by: Sequence[str], order: str, columns: Mapping[str, str],
             tie: Sequence[str] = (), group_rows: int = GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """`columns` maps new names to columns whose previous value, per key in
    (order, tie) order, they receive. `largest` bounds the rows of a key, where
    the caller knows it."""
    by, rank, own, total = list(by), [order, *tie, "_tie"], df.columns, None
    if largest is None:
        largest, total = group_sizes(df, by)
    df = with_tie(df)
    if largest <= group_rows:
        w = Window.partitionBy(*by).orderBy(*rank)
        return df.select(*own, *[F.lag(c, 1).over(w).alias(name) for name, c in columns.items()])
    rows = dealt(df, rank, group_rows, total)
    cell = [*by, "_bucket"]
    carried = list(dict.fromkeys(columns.values()))
    last = rows.groupBy(*cell).agg(
        F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(rank)],
                       *[F.col(c).alias(f"v{i}") for i, c in enumerate(carried)])).alias("_last"))
    before = last.select(*cell, F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_prev"))
    inside = Window.partitionBy(*cell).orderBy(*rank)
    lagged = rows.withColumn("_first", F.row_number().over(inside) == 1)
    for i, c in enumerate(carried):
        lagged = lagged.withColumn(f"_v{i}", F.lag(c).over(inside))
    joined = same_key_join(lagged, before, cell)
    for name, c in columns.items():
        i = carried.index(c)
        joined = joined.withColumn(
            name, F.when(F.col("_first"), F.col("_prev").getField(f"v{i}")).otherwise(F.col(f"_v{i}")))
    return joined.select(*own, *columns)


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows with a table of one row per key; NULL keys meet."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Join rows to a table of one row per key, safe against keys that most rows
    share, NULL included.

    One aggregate counts the rows per key. Where none has more than
    `group_rows`, this is a plain join and Spark picks its kind. Else the rows
    of each larger key are dealt over as many shares as it needs, and only
    those keys' rows of the right side are copied. There are at most MAX_HOT
    such keys, and about as many copies, so both are broadcast."""
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    most = sizes.agg(F.max("_rows").alias("top"), F.sum("_rows").alias("total")).first()
    if (most.top or 0) <= group_rows:
        return left.join(right, key, how)
    share = max(group_rows, 1, -(-most.total // MAX_HOT))
    hot = sizes.where(F.col("_rows") > share).select(
        F.col(key).alias("_hot"), F.ceil(F.col("_rows") / F.lit(share)).alias("_shares"))
    hot = F.broadcast(materialise(hot, "hot"))
    spread = lambda df: df.join(hot, df[key].eqNullSafe(hot["_hot"]), "left").drop("_hot")
    others = [F.col(f"`{c}`") for c in left.columns if c != key]
    # By what else a row holds, so that a task run again deals it as before.
    dealt = F.pmod(F.xxhash64(*others), F.col("_shares")) if others else F.lit(0)
    none = F.lit(0).cast("long")
    rows = spread(left).withColumn("_share", F.coalesce(dealt, none)).drop("_shares")
    copies = spread(right).withColumn(
        "_share", F.explode(F.sequence(none, F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return rows.join(copies, [key, "_share"], how).drop("_share")


def as_of(left: DataFrame, at: Column, right: DataFrame, key: Column, hit: Column, name: str, rows_each: int = GROUP_ROWS) -> DataFrame:
    """Each row of `left` with the struct `hit` of the last row of `right` whose `key` is not beyond `at`, as column `name`; NULL
    where there is none. Of equal keys the greatest `hit` is taken.

    Both sides are range-partitioned and sorted together, so a row meets its hit in its own bucket, or takes the one
    that the buckets before carry on: a table of one row per bucket. Values that many rows share are dealt over
    buckets, and no side has to fit a task."""
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    values = left.select(at.cast("double").alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    marks = right.select(key.cast("double").alias("_at"), F.lit(0).alias("_side"), hit.alias("_hit")).where(F.col("_at").isNotNull())
    both = marks.unionByName(values, allowMissingColumns=True)
    rows = dealt(both, ["_at", "_side", "_hit"], rows_each)
    inside = Window.partitionBy("_bucket").orderBy("_at", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_met", F.last("_hit", ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    ends = rows.groupBy("_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_hit"))).alias("_end"))
    ahead = Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = ends.select("_bucket", F.last("_end", ignorenulls=True).over(ahead).alias("_ahead"))
    found = F.coalesce("_met", F.col("_ahead")["_hit"])
    return same_key_join(met, carried, ["_bucket"]).select("_row.*", F.when(F.col("_at").isNotNull(), found).alias(name))
