"""Sources and sinks: files, inline rows, named tables, derived-table caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise

__all__ = [
    "cached", "exists", "head", "inline", "materialise", "named", "read", "register",
    "run_sql", "tables", "write",
]


def read(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """A file or folder as a lazy plan: parquet, csv, tsv, json lines or orc.
    Text formats infer their types only where no schema is given."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {kind!r}: use parquet, csv, tsv, json or orc")


def inline(spark: SparkSession, rows: Iterable, schema) -> DataFrame:
    """Rows written in the program, such as a legend or a lookup."""
    return spark.createDataFrame(list(rows), schema)


def register(spark: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    """Name tables, so that SQL steps can refer to them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def named(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def run_sql(df: DataFrame, query: str, **params) -> DataFrame:
    """SQL over the chain so far, which the query names `input`. Named
    parameters are typed (`:lo`), never pasted into the text."""
    df.createOrReplaceTempView("input")
    return df.sparkSession.sql(query, args=params or None)


def head(df: DataFrame, n: int = 10, order: Iterable = ()) -> DataFrame:
    order = list(order)
    return (df.orderBy(*order) if order else df).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at `path`, on whatever file system."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def write(df: DataFrame, path: str, order: Iterable[str] = (), files: int | None = None,
          fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table. With `order`, rows are range-partitioned on those columns
    and sorted inside each file, so that later range filters skip row groups by
    their min/max statistics."""
    order = list(order)
    if order:
        ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        df = ranged.sortWithinPartitions(*order)
    elif files:
        df = df.repartition(files)
    df.write.mode(mode).format(fmt).save(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame],
           order: Iterable[str] = ()) -> DataFrame:
    """A derived table, built from its source once and read from its copy after."""
    if not exists(spark, path):
        write(build(), path, order=order)
    return spark.read.parquet(path)
