"""Stream time: a clock that follows the data but does not wait in long gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import largest_group, lookup, previous, running_sum


def clock(df: DataFrame, t: str, gap: float = 1.0, by: Sequence[str] = (), name: str = "clock") -> DataFrame:
    """Adds the cumulative sum of clamp(t - previous t, 0, gap) in t order, per
    key or over all rows. Equal times share one reading, so the clock is
    computed over distinct times and joined back; its prefix sum runs in
    buckets of time, not in one task."""
    by = list(by)
    one = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    times = base.where(F.col(t).isNotNull()).select(*one, F.col(t).cast("double").alias("_t")).distinct()
    times = materialise(times, "times")
    largest = largest_group(times, one)
    steps = previous(times, one, "_t", {"_p": "_t"}, largest=largest)
    step = F.greatest(F.lit(0.0), F.least(F.lit(float(gap)), F.col("_t") - F.col("_p")))
    steps = steps.withColumn("_d", F.when(F.col("_p").isNotNull(), step).otherwise(F.lit(0.0)))
    ticks = running_sum(steps.select(*one, "_t", "_d"), one, "_t", "_d", name, largest=largest) \
        .select(*one, "_t", name)
    # One time, or none, may hold most rows: the ticks are looked up, with hot times dealt over tasks.
    rows = base.withColumn("_at", F.struct(*one, F.col(t).cast("double").alias("_t")))
    out = lookup(rows, ticks.select(F.struct(*one, "_t").alias("_at"), name), "_at").drop("_at")
    return out if by else out.drop("_all")
