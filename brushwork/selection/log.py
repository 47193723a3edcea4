"""A log of selection updates as a table, and what is active at any point of it.

Rows are (seq, selection, producer, op, tuple): `set` (one row per tuple, or one
with a NULL tuple for an empty set), `toggle`, `clear` and `clear_all` (whose
producer is NULL). Rows of one update share its seq. All steps are aggregates
and equi-joins on keys; no task sees a whole selection's log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..session import materialise


def _until(log: DataFrame, at: int | None) -> DataFrame:
    """Rows of one update are distinct tuples."""
    return (log if at is None else log.where(F.col("seq") <= at)).select(
        "seq", "selection", "producer", "op", "tuple").distinct()


def active_tuples(log: DataFrame, at: int | None = None) -> DataFrame:
    """The active tuples (selection, producer, tuple) of selections that combine
    their producers (intersect or union). A producer whose last update set no
    tuples stays active with one NULL tuple.

    Per producer the last `set`, `clear` or `clear_all` counts, with the toggles
    after it: a tuple is active when its appearances since then are odd."""
    rows = _until(log, at)
    all_clear = rows.where(F.col("op") == "clear_all").groupBy("selection").agg(F.max("seq").alias("_all"))
    own = rows.where(F.col("op").isin("set", "clear")).groupBy("selection", "producer").agg(F.max("seq").alias("_own"))
    events = rows.where(F.col("op").isin("set", "toggle")) \
        .withColumn("_k", F.struct("selection", "producer"))
    resets = own.select(F.struct("selection", "producer").alias("_k"), "_own")
    events = ordered.lookup(events, resets, "_k").drop("_k")
    events = ordered.lookup(events, all_clear, "selection")
    never = F.lit(-(2**62))
    since = F.greatest(F.coalesce("_own", never), F.coalesce("_all", never))
    # A set is its own reset, unless a clear_all came after it.
    live = events.where((F.col("seq") > since) | ((F.col("op") == "set") & (F.col("seq") == since)))
    tallied = live.groupBy("selection", "producer", "tuple").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("op") == "toggle").alias("_toggled"))
    odd = tallied.where(F.col("tuple").isNotNull() & (F.col("_n") % 2 == 1)).select("selection", "producer", "tuple")
    # An empty set without toggles after it; with them, the tuples speak.
    quiet = live.groupBy("selection", "producer").agg(
        F.max((F.col("op") == "toggle")).alias("_toggled"), F.max(F.col("tuple").isNull()).alias("_empty"))
    quiet = quiet.where(~F.col("_toggled") & F.col("_empty")) \
        .select("selection", "producer", F.lit(None).cast(dict(log.dtypes)["tuple"]).alias("tuple"))
    return odd.unionByName(quiet)


def active_global(log: DataFrame, at: int | None = None) -> DataFrame:
    """The same for global selections, where a `set` replaces every producer's
    tuples, and a toggle removes a tuple whoever holds it, else adds it for
    the toggling producer. `clear` removes what its producer holds.

    A tuple belongs to whoever set or toggled it last. So a clear matters to a
    tuple only if it comes between an event of its own producer and the
    tuple's next event; it then leaves the tuple absent, whatever it was."""
    rows = _until(log, at)
    reset = rows.where(F.col("op").isin("set", "clear_all")).groupBy("selection").agg(F.max("seq").alias("_reset"))
    events = ordered.lookup(rows.where(F.col("op").isin("set", "toggle")), reset, "selection")
    base = F.coalesce("_reset", F.lit(-(2**62)))
    live = events.where((F.col("seq") > base) | ((F.col("op") == "set") & (F.col("seq") == base))).drop("_reset")

    own = live.where(F.col("tuple").isNotNull())
    # Each event with the seq of the tuple's next event: the previous in reverse order.
    back = own.withColumn("_back", -F.col("seq"))
    # Each pass reads its input more than once, so each starts from a written table.
    chained = materialise(ordered.previous(back, ["selection", "tuple"], "_back", {"_next": "seq"}).drop("_back"), "chain")

    # How many clears of the event's producer lie before it, and before the next event.
    clears = rows.where(F.col("op") == "clear").select("selection", "producer", "seq", F.lit(1).alias("_w"),
                                                       F.lit(None).cast("string").alias("_side"),
                                                       F.lit(None).cast(dict(log.dtypes)["tuple"]).alias("tuple"),
                                                       F.lit(None).cast("long").alias("_at"))
    probe = lambda side, seq: chained.select(
        "selection", "producer", seq.cast("long").alias("seq"), F.lit(0).alias("_w"), F.lit(side).alias("_side"),
        "tuple", F.col("seq").alias("_at"))
    end = F.coalesce("_next", F.lit(2**62))
    marks = clears.unionByName(probe("start", F.col("seq"))).unionByName(probe("end", end))
    counted = ordered.running_sum(marks, ["selection", "producer"], "seq", "_w", "_cleared", tie=["_w"])
    spans = counted.where(F.col("_side").isNotNull()).groupBy("selection", "producer", "tuple", "_at").agg(
        F.max(F.when(F.col("_side") == "start", F.col("_cleared"))).alias("_from"),
        F.max(F.when(F.col("_side") == "end", F.col("_cleared"))).alias("_to"))
    spans = materialise(spans.withColumn("_gone", F.col("_to") > F.col("_from")), "spans")

    # Undone events cut a tuple's history into stretches; in each, events add and
    # remove in turn, the first one adding.
    cuts = ordered.running_sum(spans.withColumn("_g", F.col("_gone").cast("int")), ["selection", "tuple"], "_at", "_g", "_stretch")
    cuts = cuts.withColumn("_stretch", F.col("_stretch") - F.col("_g")).withColumn("_one", F.lit(1))
    cuts = materialise(cuts, "stretches")
    turns = ordered.running_sum(cuts, ["selection", "tuple", "_stretch"], "_at", "_one", "_turn")
    turns = turns.withColumn("_adds", F.col("_turn") % 2 == 1)
    turns = materialise(turns, "turns")
    last = turns.groupBy("selection", "tuple").agg(F.max(F.struct("_at", "producer", "_adds", "_gone")).alias("_last"))
    held = last.where(F.col("_last._adds") & ~F.col("_last._gone")) \
        .select("selection", F.col("_last.producer").alias("producer"), "tuple")

    # A producer that set no tuples, gained none since and was not cleared.
    empty = live.where(F.col("tuple").isNull()).select("selection", "producer", F.col("seq").alias("_set"))
    gains = turns.where("_adds").select("selection", "producer", F.col("_at").alias("seq"))
    later = rows.where(F.col("op") == "clear").select("selection", "producer", "seq").unionByName(gains) \
        .groupBy("selection", "producer").agg(F.max("seq").alias("_later"))
    quiet = ordered.same_key_join(empty, later, ["selection", "producer"], "left") \
        .where(F.col("_later").isNull() | (F.col("_later") < F.col("_set"))) \
        .select("selection", "producer", F.lit(None).cast(dict(log.dtypes)["tuple"]).alias("tuple"))
    return held.unionByName(quiet)
