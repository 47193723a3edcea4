"""The given tables, and the point cloud and feed that stand on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read(spark, f"{folder}/{name}.parquet")


def day(c: str) -> Column:
    """Days since 1995-01-01, as a double."""
    return F.datediff(F.to_date(F.col(c)), F.lit("1995-01-01").cast("date")).cast("double")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as points: price, quantity, ship day; flag as class."""
    return load(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), day("l_shipdate").alias("z"),
        F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("intensity"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"))


POINTS = """p AS (
  SELECT l_extendedprice AS x, l_quantity AS y,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS z,
         l_returnflag AS label, l_linestatus AS status, l_discount AS intensity,
         l_orderkey AS order_key, l_linenumber AS line_number
  FROM lineitem)"""


def seconds(c: str = "ts") -> Column:
    """Seconds since 2024-01-01 00:00 UTC, as a double."""
    # The tables hold zone-free times; their difference knows no session zone.
    since = F.col(c) - F.lit("2024-01-01").cast("timestamp_ntz")
    return since.cast("interval second").cast("decimal(20,6)").cast("double")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumn("t", seconds())


FEED = """f AS (
  SELECT *, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e6 AS t FROM events)"""


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
