"""Windows that close, rates that expire, and the clock in the state store, batch by batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brushwork.operators.clock import clock
from brushwork.streaming import feeds, keyed, live

START = datetime(2024, 3, 1)
SCHEMA = "id long, kind string, ts timestamp, at double"


def rows(spark, n=400, days=12, seed=1):
    rng = random.Random(seed)
    at = sorted(rng.uniform(0, days * 86400) for _ in range(n))
    return [(i, rng.choice(["a", "b", None]) if i % 7 else "a", START + timedelta(seconds=round(t, 3)), round(t, 3)) for i, t in enumerate(at)]


def feed_in(spark, folder, parts, checkpoint, build, handler):
    """One run of the query a part, each with a new object from the same checkpoint, as after a restart."""
    late = 0
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        late += feeds.run(build(feeds.read_feed(spark, folder, spark.createDataFrame([], SCHEMA).schema)), handler, "append", checkpoint)
    return late


def test_the_clock_goes_on_after_restarts_with_rows_out_of_order(spark, tmp_path):
    every = rows(spark)
    rng = random.Random(2)
    shuffled = sorted(every, key=lambda r: r[3] + rng.uniform(-40_000, 40_000))  # up to a day late
    cuts = [shuffled[:120], shuffled[120:130], shuffled[130:300], shuffled[300:]]
    last = (9999, "z", START + timedelta(days=40), 40 * 86400.0)  # closes all other panes
    out = f"{tmp_path}/out"
    feed_in(spark, f"{tmp_path}/in", [*cuts, [last]], f"{tmp_path}/checkpoint",
            lambda s: keyed.clocked(s, "kind", "id", "ts", "at", 3600.0, 86400, "2 days"), feeds.to_table(out))
    got = {r.id: r.clock for r in feeds.read_table(spark, out).collect()}
    want = {r.id: r.clock for r in clock(spark.createDataFrame(every, SCHEMA), "at", 3600.0, by=["kind"]).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)


def test_late_rows_are_counted_and_idle_keys_begin_anew(spark, tmp_path):
    day = 86400.0
    row = lambda i, kind, t: (i, kind, START + timedelta(seconds=t), t)
    parts = [[row(1, "a", 10.0), row(2, "a", 20.0), row(3, "b", 20 * day)], [row(4, "b", 20 * day + 1)],
             [row(5, "a", 30.0), row(6, "a", 40 * day), row(8, "a", 40 * day + 5)], [row(7, "b", 80 * day)], [row(9, "c", 80 * day + 1)]]
    out = f"{tmp_path}/out"
    late = feed_in(spark, f"{tmp_path}/in", parts, f"{tmp_path}/checkpoint",
            lambda s: keyed.clocked(s, "kind", "id", "ts", "at", 1e9, 86400, "1 day", idle_seconds=5 * 86400), feeds.to_table(out))
    clocks = {r.id: r.clock for r in feeds.read_table(spark, out).collect()}
    assert clocks[1] == 0 and clocks[2] == 10 and 5 not in clocks
    assert clocks[6] == 0 and clocks[8] == 5  # the key had been still for over five days
    assert late == 1


def test_state_of_windows_is_bounded(spark, tmp_path):
    every = [(i, k, ts, at, 1.0) for i, k, ts, at in rows(spark, 900, 60)]
    held = []
    for k in range(0, 900, 150):
        spark.createDataFrame(every[k:k + 150], SCHEMA + ", v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = feeds.read_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA + ", v double").schema)
        q = (live.sliding(s, "v", "v", "at", 1.0, "ts", "3 days", "1 day", "1 day").writeStream.outputMode("append").foreachBatch(feeds.to_table(f"{tmp_path}/out"))
             .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination(120)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 6  # windows of three days that end within a day of the newest row
    got = {r.window.start: r["rows__"] for r in feeds.read_table(spark, f"{tmp_path}/out").collect()}
    newest = max(r[2] for r in every) - timedelta(days=1)
    for start, n in got.items():
        assert n == sum(start <= r[2] < start + timedelta(days=3) for r in every) and start + timedelta(days=3) <= newest
    assert len(got) >= 55


def test_old_rates_leave_the_table(spark, tmp_path):
    every = rows(spark, 300, 30)
    table = None
    for k in range(0, 300, 100):
        spark.createDataFrame(every[k:k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table = live.RateTable(spark, 3 * 86400.0, f"{tmp_path}/rates")
        s = feeds.read_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
        feeds.run(live.rate(s, "ts", "1 hour", "1 hour"), table, "append", f"{tmp_path}/checkpoint")
    got = table.read().collect()
    newest = max(r.start for r in got)
    assert min(r.start for r in got) >= newest - 3 * 86400
    hours = {}
    for _, _, ts, _ in every:
        hours[ts.replace(minute=0, second=0, microsecond=0)] = hours.get(ts.replace(minute=0, second=0, microsecond=0), 0) + 1
    # The session's zone is UTC, as are the times here.
    assert sorted(r.n for r in got) == sorted(n for h, n in hours.items() if newest - 3 * 86400 <= (h - datetime(1970, 1, 1)).total_seconds() <= newest)
    assert len(feeds.numbers(spark, f"{tmp_path}/rates")) < 6


def test_the_trace_of_the_grid(spark):
    states = spark.createDataFrame([(p, x, y) for p in (0, 1, 2, 5, 30) for x in range(8 if p < 5 else 1) for y in range(8 if p < 5 else 1)], "pane long, cx long, cy long")
    got = [tuple(r) for r in live.grid_trace(states, 7, 12, 8).collect()]
    assert got == [(0, 1, 64, 2), (1, 2, 16, 2), (2, 2, 16, 2), (5, 2, 16, 2), (30, 2, 1, 1)]
    assert live.grid_trace(states.where(F.lit(False)), 7, 12).count() == 0
