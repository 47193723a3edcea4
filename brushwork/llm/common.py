"""What the operators of this package share: tables, hashes of rows, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

SPACE = r"[\x20\x09-\x0D]+"  # white space between words
HOT_KEYS = 256  # keys that can each hold 1/256 of the rows or more


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, label: str = "input") -> DataFrame:
    """The same rows in an order that a task run again finds again. A plan that only scans files has it; what
    comes out of a shuffle is written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, label) if any(x in plan for x in ("Exchange", "ExistingRDD", "LocalTableScan", "InMemoryTableScan")) else df


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id is in fold 1 of every split."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(1))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where `size` is how many of the `total` rows a key has. Keys with a share of
    1/HOT_KEYS or more, of which there are HOT_KEYS at most, are broadcast, so no key's rows meet in one task."""
    hot = groups.where(F.col(size) * HOT_KEYS >= F.lit(max(total, 1)))
    hot_keys = hot.select(key)
    cold = rows.join(F.broadcast(hot_keys), key, "left_anti").join(groups.join(F.broadcast(hot_keys), key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).select(cold.columns).unionAll(cold)
