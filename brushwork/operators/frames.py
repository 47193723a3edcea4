"""Two frames of keyed items: what updates, enters and exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import lookup


def frame_diff(a: DataFrame, b: DataFrame, key: str, parent: str | None = None,
               values: Sequence[str] = ()) -> DataFrame:
    """Items matched by key: `status` is update, enter or exit, with the values
    of both frames. With `parent`, an entering item whose parent was in `a`
    starts from it, and an exiting item whose parent is in `b` ends in it:
    `from_parent` and `to_parent` say so, and the item's own missing values
    take the parent's. Many items may share one parent: the look-up is salted."""
    up = [] if parent is None else [parent]
    side = lambda df, s: df.select(F.col(key), *[F.col(c).alias(f"{s}_{c}") for c in [*up, *values]], F.lit(True).alias(f"_{s}"))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    status = F.when(F.col("_a") & F.col("_b"), "update").when(F.col("_b"), "enter").otherwise("exit")
    both = both.withColumn("status", status).drop("_a", "_b")
    if parent is None:
        return both
    origin = lambda df, s: df.select(F.col(key).alias("_parent"), F.lit(True).alias(f"_in_{s}"),
                                     *[F.col(c).alias(f"_{s}_{c}") for c in values])
    parents = origin(a, "a").join(origin(b, "b"), "_parent", "full_outer")
    wanted = F.when(F.col("status") == "enter", F.col(f"b_{parent}")).when(F.col("status") == "exit", F.col(f"a_{parent}"))
    met = lookup(both.withColumn("_parent", wanted), parents, "_parent")
    enters = (F.col("status") == "enter") & F.coalesce("_in_a", F.lit(False))
    exits = (F.col("status") == "exit") & F.coalesce("_in_b", F.lit(False))
    for c in values:
        met = met.withColumn(f"a_{c}", F.when(enters, F.col(f"_a_{c}")).otherwise(F.col(f"a_{c}")))
        met = met.withColumn(f"b_{c}", F.when(exits, F.col(f"_b_{c}")).otherwise(F.col(f"b_{c}")))
    return met.withColumn("from_parent", enters).withColumn("to_parent", exits).drop(
        "_parent", "_in_a", "_in_b", *[f"_{s}_{c}" for s in "ab" for c in values])
