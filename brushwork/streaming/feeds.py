"""Feeds: files in time order as streams, and queries run to the end of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

Handler = Callable[[DataFrame, int], None]


def write_feed(df: DataFrame, path: str, t: str, files: int, tie: Sequence[str] = ()) -> None:
    """A recorded feed: `files` Parquet files, each a range of time and sorted."""
    df.repartitionByRange(files, t, *tie).sortWithinPartitions(t, *tie).write.mode("overwrite").parquet(path)


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
              since: tuple[str, object] | None = None) -> DataFrame:
    """A stream over the files at `path`. `files_per_trigger` bounds a batch;
    `since` (column, value) restarts from a point in the feed."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern matches a folder and a single file alike; a file's plain path is
    # refused by the file source.
    path = path.rstrip("/")
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return stream if since is None else stream.where(F.col(since[0]) >= F.lit(since[1]))


def event_time(df: DataFrame, column: str, name: str = "ts") -> DataFrame:
    """A zone-free time column as the timestamp that watermarks need, in UTC."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        c = F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return df.withColumn(name, c)


def run(stream: DataFrame, handler: Handler, mode: str = "append", checkpoint: str | None = None, timeout: int = 3600) -> int:
    """Process all that is there, batch by batch, and stop. With a `checkpoint`
    folder kept between calls, the next call goes on where this one ended.
    Returns how many rows came too late for a state that the watermark had closed."""
    place = checkpoint or scratch_path(stream.sparkSession, "feed")
    query = (stream.writeStream.outputMode(mode).foreachBatch(handler)
             .option("checkpointLocation", place).trigger(availableNow=True).start())
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"the feed did not end within {timeout} s")
        return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    finally:
        query.stop()


def replay(df: DataFrame, t: str, slices: int, prepare: Callable[[DataFrame], DataFrame], handler: Handler,
           mode: str = "append") -> None:
    """A recording played as a live feed: equally filled slices of time arrive
    one after another, each in as many files as it needs, and the stream takes
    each as one batch. Batches so come in time order, whatever the file system
    says of its files' ages."""
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, "recording"), scratch_path(spark, "replay")
    cuts = df.agg(F.percentile_approx(t, [i / slices for i in range(1, slices)], 100 * slices).alias("c")).first().c
    ends = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(ends, ends[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col(t) > F.lit(lo))
        if hi is not None:
            part = part.where(F.col(t) <= F.lit(hi))
        part.write.mode("append").parquet(path)
        run(prepare(read_feed(spark, path, df.schema)), handler, mode, checkpoint)


def to_table(path: str) -> Handler:
    """Append each batch under its number. A batch that is run again after a
    failure overwrites its own part and nothing else."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All parts of a table written by `to_table`, with their batch number. Without a schema, the written one."""
    if schema is None:
        return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """The numbers of the finished parts `name=<n>` in a folder, in order; none if there is no folder."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    found = [x.getPath() for x in files.listStatus(place) if x.getPath().getName().startswith(f"{name}=")]
    whole = [x for x in found if name != "batch" or files.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in whole)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a part that a later one has replaced."""
    files, place = _folder(spark, path)
    files.delete(place, True)
