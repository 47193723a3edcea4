"""Live aggregates: cell states per pane, rolling windows, rates, histograms,
series and clocks over a feed.

Two ways of holding state. `fold`, `rate` and `growing_histogram` keep it in
Spark's state store, bounded by a watermark. The `...Table` classes write each
batch's mergeable states under the batch's number and merge them when read: late
rows are never lost, and a batch that is run again replaces its own part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, states
from ..operators.clock import clock
from ..operators.ordered import lookup
from ..session import scratch_path
from . import feeds


def fold(stream: DataFrame, x: str, y: str, z: str, size: float | tuple[float, float],
         ts: str, pane: str, watermark: str) -> DataFrame:
    """Per pane of time and cell: the highest z and the count. In append and update mode state is dropped
    once the watermark passes a pane; complete mode keeps all panes."""
    sx, sy = size if isinstance(size, tuple) else (size, size)
    keyed = stream.withWatermark(ts, watermark).select(
        ts, grid.cell(x, sx).alias("cx"), grid.cell(y, sy).alias("cy"), F.col(z).alias("z"))
    return keyed.groupBy(F.window(ts, pane).alias("pane"), "cx", "cy").agg(*states.state_columns(grid.CELL_MEASURES))


def sliding(stream: DataFrame, x: str, y: str, z: str, size: float | tuple[float, float], ts: str, window: str, pane: str, watermark: str) -> DataFrame:
    """The same per window that slides by panes. In append mode each window comes once, when the watermark has passed its end,
    and its state goes; at any time the state holds the windows that are open within the watermark's delay."""
    sx, sy = size if isinstance(size, tuple) else (size, size)
    keyed = stream.withWatermark(ts, watermark).select(
        ts, grid.cell(x, sx).alias("cx"), grid.cell(y, sy).alias("cy"), F.col(z).alias("z"))
    return keyed.groupBy(F.window(ts, window, pane).alias("window"), "cx", "cy").agg(*states.state_columns(grid.CELL_MEASURES))


class RateTable:
    """A handler for `rate` in append mode: closed buckets by batch, of which those are kept that begin within `keep_seconds` of
    the newest. Older parts are removed once none of their buckets is kept."""

    def __init__(self, spark: SparkSession, keep_seconds: float, path: str | None = None):
        self.spark, self.keep, self.path = spark, keep_seconds, path or scratch_path(spark, "rates")

    def __call__(self, batch: DataFrame, number: int) -> None:
        closed = batch.select(F.unix_seconds("bucket.start").alias("start"), "n")
        closed.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        ends = feeds.read_table(self.spark, self.path).groupBy("batch").agg(F.max("start").alias("newest")).collect()  # a row a part
        newest = max((r.newest for r in ends if r.newest is not None), default=None)
        for r in ends:
            if newest is not None and r.batch != number and (r.newest is None or r.newest < newest - self.keep):
                feeds.forget(self.spark, f"{self.path}/batch={r.batch}")

    def read(self) -> DataFrame:
        held = feeds.read_table(self.spark, self.path).select("start", "n")
        return held.where(F.col("start") >= held.agg(F.max("start") - F.lit(self.keep)).scalar())


def grid_trace(held: DataFrame, window_panes: int, budget: int, most: int = 16) -> DataFrame:
    """The adaptive grid as a table: for every pane with rows, in order, the factor its picture was drawn at, the cells that the
    rolling window then held, and the factor that follows. `held` are states per (pane, cx, cy), as of a CellTable.

    Cells are counted for all factors in one shuffle; the feedback, which needs one pane after another, runs over the counts, a
    few numbers a pane."""
    factors = [1 << k for k in range(most.bit_length())]
    seen = held.select("pane", "cx", "cy").distinct()
    panes = seen.select(F.col("pane").alias("at")).distinct()
    shown = seen.withColumn("at", F.explode(F.sequence("pane", F.col("pane") + F.lit(window_panes)))).join(panes, "at", "left_semi")
    scaled = shown.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).select(
        "at", "factor", F.floor(F.col("cx") / F.col("factor")).alias("cx"), F.floor(F.col("cy") / F.col("factor")).alias("cy")).distinct()
    counts = scaled.groupBy("at", "factor").agg(F.count(F.lit(1)).alias("cells"))
    by_pane = counts.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("factor", "cells"))).alias("cells"))
    steps = by_pane.agg(F.sort_array(F.collect_list(F.struct("at", "cells"))).alias("steps"))

    def step(trace, now):
        factor = F.coalesce(F.try_element_at(trace, F.lit(-1))["next"], F.lit(1))
        cells = F.map_from_entries(now["cells"])[factor]
        follows = (F.when((cells > F.lit(budget * 3 // 2)) & (factor < most), factor * 2)
                   .when((cells < F.lit(budget // 3)) & (factor > 1), F.call_function("div", factor, F.lit(2)).cast("int")).otherwise(factor))
        return F.concat(trace, F.array(F.struct(now["at"].alias("pane"), factor.alias("factor"), cells.alias("cells"), follows.alias("next"))))

    none = F.array().cast("array<struct<pane:bigint,factor:int,cells:bigint,next:int>>")
    return steps.select(F.inline(F.aggregate("steps", none, step)))


def rate(stream: DataFrame, ts: str, bucket: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """Rows per bucket of time. With a watermark, buckets behind it are closed and their state dropped (append mode)."""
    timed = stream if watermark is None else stream.withWatermark(ts, watermark)
    return timed.groupBy(F.window(ts, bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def growing_histogram(stream: DataFrame, value: str, step: float, origin: float = 0.0) -> DataFrame:
    """A histogram over all rows so far; as many states as it has bins."""
    return grid.histogram(stream, value, step, origin)


class Latest:
    """A handler for `complete` mode: keeps each batch's whole result and reads the last."""

    def __init__(self, spark: SparkSession, label: str = "latest"):
        self.spark, self.path, self.schema, self.last = spark, scratch_path(spark, label), None, None

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.schema, self.last = batch.schema, number

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={self.last}")


def next_factor(cells: int, factor: int, budget: int, most: int = 16) -> int:
    """Coarser above one and a half budgets of cells, finer below a third."""
    if cells > budget * 3 // 2 and factor < most:
        return factor * 2
    if cells < budget // 3 and factor > 1:
        return factor // 2
    return factor


def grid_states(folded: DataFrame) -> DataFrame:
    """States of one pane and cell from several batches as one row."""
    return folded.groupBy("pane", "cx", "cy").agg(F.sum("rows__").alias("rows__"), F.max("z__hi").alias("z__hi"))


class CellTable:
    """Cell states of a feed, one row per (pane, cell) and batch, with a rolling
    picture of the last `window` time units at an adaptive grid.

    `t` is a number in the unit of `pane` and `window`. With `compact_every`,
    the states are merged and older panes let go of every so many batches. All
    state lies under `path`: parts by batch number within a generation, which
    compaction begins anew, and the grid's factor by batch number. A new object on the
    same path goes on where the last one was."""

    def __init__(self, spark: SparkSession, x: str, y: str, z: str, size: float | tuple[float, float],
                 t: str, pane: float, window: float,
                 budget: int | None = None, path: str | None = None, compact_every: int | None = None):
        self.spark, self.size, self.t, self.pane, self.window = spark, size, t, pane, window
        self.x, self.y, self.z, self.budget, self.compact_every = x, y, z, budget, compact_every
        self.path = path or scratch_path(spark, "cells")
        self.generation = max(feeds.numbers(spark, f"{self.path}/states", "generation"), default=0)
        there = feeds.numbers(spark, self.parts)
        self.last = max(there, default=-1)
        # A generation after the first begins with the merged part; what it holds is not taken again.
        self.done = min(there, default=-1) if self.generation else -1
        grids = feeds.numbers(spark, f"{self.path}/grids")
        self.factor = spark.read.parquet(f"{self.path}/grids/batch={grids[-1]}").first().next if grids else 1
        self.pictures: list[tuple[int, int, int]] = []  # (batch, factor, cells)

    @property
    def parts(self) -> str:
        return f"{self.path}/states/generation={self.generation}"

    def fold(self, batch: DataFrame) -> DataFrame:
        paned = batch.withColumn("pane", grid.cell(self.t, self.pane))
        return grid.fold_cells(paned, self.x, self.y, self.z, self.size, by=["pane"])

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.done:
            return
        again = number <= self.last
        self.last = max(self.last, number)
        self.fold(batch).write.mode("overwrite").parquet(f"{self.parts}/batch={number}")
        if self.budget is not None and not again:
            cells = self.rolling(self.factor).count()
            self.pictures.append((number, self.factor, cells))
            self.factor = next_factor(cells, self.factor, self.budget)
            self.spark.createDataFrame([(cells, self.factor)], "cells long, next int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/grids/batch={number}")
        if self.compact_every and (number + 1) % self.compact_every == 0:
            self.compact()

    def compact(self) -> None:
        """Merge the retained states into one part of a new generation, and let go of older panes and parts. Batches up to
        the last one are in that part, and are not taken again."""
        old = self.parts
        kept = grid_states(self.retained())
        kept.write.mode("overwrite").parquet(f"{self.path}/states/generation={self.generation + 1}/batch={self.last}")
        self.generation, self.done = self.generation + 1, self.last
        feeds.forget(self.spark, old)

    def states(self) -> DataFrame:
        return feeds.read_table(self.spark, self.parts)

    def retained(self) -> DataFrame:
        """States of panes not older than the window, seen from the newest pane.
        The bound is a scalar subquery on a column with file statistics."""
        held = self.states()
        oldest = held.agg(F.max("pane") - F.lit(int(self.window // self.pane))).scalar()
        return held.where(F.col("pane") >= oldest)

    def rolling(self, factor: int | None = None) -> DataFrame:
        return grid.merge_cells(self.retained(), factor or self.factor)

    def whole(self, factor: int = 1) -> DataFrame:
        return grid.merge_cells(self.states(), factor)


class SeriesTable:
    """Series (key, bucket of time, count) that grow with a feed; read them merged."""

    def __init__(self, spark: SparkSession, key: str, t: str, bucket: float, path: str | None = None):
        self.spark, self.key, self.t, self.bucket = spark, key, t, bucket
        self.path = path or scratch_path(spark, "series")

    def __call__(self, batch: DataFrame, number: int) -> None:
        counted = batch.select(self.key, grid.cell(self.t, self.bucket).alias("b")) \
            .groupBy(self.key, "b").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        """Per key and bucket the count, with t in buckets since the key's first one."""
        merged = feeds.read_table(self.spark, self.path) \
            .groupBy(self.key, "b").agg(F.sum("n").alias("n"))
        first = merged.groupBy(self.key).agg(F.min("b").alias("_first"))
        return lookup(merged, first, self.key).select(
            self.key, ((F.col("b") - F.col("_first")) * F.lit(float(self.bucket))).alias("t"), "n")


class ClockTable:
    """A gap-collapsed clock per key that goes on from batch to batch. What is
    kept between batches is one row per key: its last time and its clock, written
    under the batch's number. A batch starts from the ends before its own, so it
    can be run again, and a new object on the same path goes on."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], t: str, gap: float = 1.0, path: str | None = None):
        self.spark, self.keys, self.t, self.gap = spark, list(keys), t, gap
        self.path = path or scratch_path(spark, "clock")

    def ends(self, before: int) -> DataFrame | None:
        """One row per key (_k, _last, _clock) as of the batches before a number."""
        there = [n for n in feeds.numbers(self.spark, f"{self.path}/ends") if n < before]
        return self.spark.read.parquet(f"{self.path}/ends/batch={there[-1]}") if there else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        key = F.struct(*self.keys)
        ticked = clock(batch, self.t, self.gap, by=self.keys).withColumn("_k", key)
        ends = self.ends(number)
        if ends is not None:
            first = batch.groupBy(*self.keys).agg(F.min(self.t).cast("double").alias("_first")).withColumn("_k", key)
            gap = F.greatest(F.lit(0.0), F.least(F.lit(float(self.gap)), F.col("_first") - F.col("_last")))
            start = first.select("_k", "_first").join(ends, "_k") \
                .select("_k", (F.col("_clock") + gap).alias("_start"))
            ticked = lookup(ticked, start, "_k").withColumn("clock", F.col("clock") + F.coalesce("_start", F.lit(0.0))) \
                .drop("_start")
        out = ticked.drop("_k")
        part = f"{self.path}/rows/batch={number}"
        out.write.mode("overwrite").parquet(part)
        written = self.spark.read.schema(out.schema).parquet(part).withColumn("_k", key)
        now = written.groupBy("_k").agg(F.max(self.t).cast("double").alias("_last"), F.max("clock").alias("_clock"))
        if ends is not None:
            now = now.unionByName(ends).groupBy("_k").agg(F.max("_last").alias("_last"), F.max("_clock").alias("_clock"))
        now.write.mode("overwrite").parquet(f"{self.path}/ends/batch={number}")

    def read(self) -> DataFrame:
        return feeds.read_table(self.spark, f"{self.path}/rows").drop("batch")
