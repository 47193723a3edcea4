"""Feeds: the events table read as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clock as clocks
from ..session import scratch_path
from ..streaming import feeds, keyed, live
from ..selection import series
from .data import FEED, feed, load, r, seconds

CELL = (25.0, 50.0)  # users and value per cell


def _stream(spark, d):
    """Events as a stream of files, in whatever number the table has, a bounded
    number of them per batch."""
    schema = load(spark, d, "events").schema
    return _prepare(feeds.read_feed(spark, f"{d}/events.parquet", schema, files_per_trigger=64))


def _prepare(stream):
    return feeds.event_time(stream, "ts").withColumn("t", seconds()).withColumn("u", F.col("user_id").cast("double"))


def _recorded(spark, d, files=4):
    """The same events as a recorded feed of several files, one per batch."""
    path = scratch_path(spark, "recorded")
    e = load(spark, d, "events")
    feeds.write_feed(e, path, "ts", files, tie=["event_id"])
    return _prepare(feeds.read_feed(spark, path, e.schema, files_per_trigger=1))


def stream_panes(spark, d):
    """Highest value and count per day and cell, from the state store."""
    panes = live.fold(_stream(spark, d), "u", "value", "value", CELL, "ts", "1 day", "3650 days")
    last = live.Latest(spark, "panes")
    feeds.run(panes, last, "complete")
    return last.read().select(F.date_format("pane.start", "yyyy-MM-dd").alias("day"), "cx", "cy", F.col("z__hi").alias("zmax"), F.col("rows__").alias("n"))


PANES = """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(user_id / 25) AS BIGINT) AS cx, CAST(floor(value / 50) AS BIGINT) AS cy,
max(value) AS zmax, count(*) AS n FROM events GROUP BY 1, 2, 3"""


def stream_cells(spark, d):
    """The last seven days of a feed, merged from the states of its batches."""
    table = live.CellTable(spark, "u", "value", "value", CELL, "t", 86400.0, 7 * 86400.0)
    feeds.replay(load(spark, d, "events"), "ts", 3, _prepare, table)
    return table.rolling(1)


ROLLING = f"""WITH {FEED}, w AS (SELECT *, floor(t / 86400) AS pane FROM f)
SELECT CAST(floor(user_id / 25) AS BIGINT) AS cx, CAST(floor(value / 50) AS BIGINT) AS cy, max(value) AS zmax, count(*) AS n
FROM w WHERE pane >= (SELECT max(pane) FROM w) - 7 GROUP BY 1, 2"""


def stream_whole(spark, d):
    """All panes merged at a grid twice as coarse."""
    table = live.CellTable(spark, "u", "value", "value", CELL, "t", 86400.0, 7 * 86400.0, budget=30)
    feeds.run(_recorded(spark, d), table)
    return table.whole(2)


WHOLE = """SELECT CAST(floor(floor(user_id / 25) / 2) AS BIGINT) AS cx, CAST(floor(floor(value / 50) / 2) AS BIGINT) AS cy, max(value) AS zmax, count(*) AS n
FROM events GROUP BY 1, 2"""


def stream_rate(spark, d):
    """Events per hour of the feed."""
    last = live.Latest(spark, "rate")
    feeds.run(live.rate(_stream(spark, d), "ts", "1 hour"), last, "complete")
    return last.read().select((F.unix_seconds("bucket.start") - 1704067200).alias("second"), "n")


RATE = """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 1704067200 AS second, count(*) AS n FROM events GROUP BY 1"""


def stream_windows(spark, d):
    """Highest value and count per cell in windows of a week that slide by a day, as they close two days behind the feed."""
    path = scratch_path(spark, "windows")
    feeds.run(live.sliding(_stream(spark, d), "u", "value", "value", CELL, "ts", "7 days", "1 day", "2 days"), feeds.to_table(path))
    return feeds.read_table(spark, path).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "cx", "cy", F.col("z__hi").alias("zmax"), F.col("rows__").alias("n"))


WINDOWS = """WITH e AS (SELECT *, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS k FROM events),
w AS (SELECT *, k - unnest(range(0, 7)) AS s FROM e)
SELECT strftime(make_timestamp(s * 86400000000), '%Y-%m-%d') AS day, CAST(floor(user_id / 25) AS BIGINT) AS cx, CAST(floor(value / 50) AS BIGINT) AS cy, max(value) AS zmax, count(*) AS n
FROM w WHERE (s + 7) * 86400000 <= (SELECT floor(max(epoch_us(ts)) / 1000) - 2 * 86400000 FROM events) GROUP BY 1, 2, 3"""


def rate_kept(spark, d):
    """Events per closed hour, of the last nine days only: what is older leaves the table."""
    table = live.RateTable(spark, 9 * 86400.0)
    feeds.run(live.rate(_stream(spark, d), "ts", "1 hour", "1 day"), table)
    return table.read().select((F.col("start") - 1704067200).alias("second"), "n")


RATE_KEPT = """WITH b AS (SELECT CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT * FROM b WHERE (h + 1) * 3600000 <= (SELECT floor(max(epoch_us(ts)) / 1000) - 86400000 FROM events))
SELECT h * 3600 - 1704067200 AS second, n FROM c WHERE h * 3600 >= (SELECT max(h) * 3600 - 9 * 86400 FROM c)"""


def grid_trace(spark, d):
    """The grid's factor and cells after each day of the feed, with a budget of 30 cells a week."""
    table = live.CellTable(spark, "u", "value", "value", CELL, "t", 86400.0, 7 * 86400.0)
    feeds.run(_stream(spark, d), table)
    return live.grid_trace(table.states(), 7, 30).select("pane", "factor", "cells", "next")


TRACE = f"""WITH RECURSIVE {FEED}, h AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS pane, CAST(floor(user_id / 25) AS BIGINT) AS cx, CAST(floor(value / 50) AS BIGINT) AS cy FROM f),
o AS (SELECT pane, row_number() OVER (ORDER BY pane) AS i FROM (SELECT DISTINCT pane FROM h)),
c AS (SELECT i, o.pane, factor, count(DISTINCT (floor(cx / factor), floor(cy / factor))) AS cells
  FROM o, h, (SELECT unnest([1, 2, 4, 8, 16]) AS factor) WHERE h.pane BETWEEN o.pane - 7 AND o.pane GROUP BY 1, 2, 3),
n AS (SELECT *, CASE WHEN cells > 45 AND factor < 16 THEN factor * 2 WHEN cells < 10 AND factor > 1 THEN factor // 2 ELSE factor END AS next FROM c),
g AS (SELECT i, pane, factor, cells, next FROM n WHERE i = 1 AND factor = 1
  UNION ALL SELECT n.i, n.pane, n.factor, n.cells, n.next FROM g JOIN n ON n.i = g.i + 1 AND n.factor = g.next)
SELECT pane, CAST(factor AS INTEGER) AS factor, cells, CAST(next AS INTEGER) AS next FROM g"""


def state_clock(spark, d):
    """A clock per event type out of Spark's state store, with late rows in their place: days closed two days behind the feed."""
    path = scratch_path(spark, "state-clock")
    feeds.run(keyed.clocked(_stream(spark, d), "event_type", "event_id", "ts", "t", 600.0, 86400, "2 days"), feeds.to_table(path))
    return feeds.read_table(spark, path).select(F.col("id").alias("event_id"), r("clock", 3).alias("clock"))


def stream_hist(spark, d):
    """A histogram over a table that grows batch by batch."""
    last = live.Latest(spark, "hist")
    feeds.run(live.growing_histogram(_recorded(spark, d), "value", 20.0), last, "complete")
    return last.read()


def stream_series(spark, d):
    """Daily series per user that grow with the feed, and who passes a timebox at its end."""
    table = live.SeriesTable(spark, "user_id", "t", 86400.0)
    feeds.run(_recorded(spark, d), table)
    s = table.read().withColumn("day", F.col("t") / 86400.0)
    keys = series.timebox_keys(s, "user_id", "day", "n", (3.0, 9.0), (1.0, 4.0))
    return series.select_rows(s, keys, "user_id").groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"))


STREAM_SERIES = f"""WITH {FEED}, b AS (SELECT user_id, floor(t / 86400) AS b, count(*) AS n FROM f GROUP BY 1, 2),
s AS (SELECT *, b - min(b) OVER (PARTITION BY user_id) AS day FROM b),
k AS (SELECT user_id FROM s WHERE day BETWEEN 3 AND 9 GROUP BY 1 HAVING bool_and(n BETWEEN 1 AND 4))
SELECT user_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM s WHERE user_id IN (SELECT user_id FROM k) GROUP BY 1"""


def stream_clock(spark, d):
    """The feed's clock with gaps over ten minutes cut to ten minutes."""
    return clocks.clock(feed(spark, d), "t", 600.0).select("event_id", r("clock", 3).alias("clock"))


CLOCK = f"""WITH {FEED}, g AS (SELECT event_id, t, greatest(0.0, least(600.0::DOUBLE, coalesce(t - lag(t) OVER (ORDER BY t), 0))) AS d FROM f)
SELECT event_id, round(sum(d) OVER (ORDER BY t), 3) AS clock FROM g"""


def keyed_clock(spark, d):
    """A clock per event type that goes on from batch to batch."""
    table = live.ClockTable(spark, ["event_type"], "t", 600.0)
    feeds.replay(load(spark, d, "events"), "ts", 3, _prepare, table)
    return table.read().select("event_id", r("clock", 3).alias("clock"))


KEYED_CLOCK = f"""WITH {FEED}, g AS (SELECT event_id, event_type, t, greatest(0.0, least(600.0::DOUBLE, coalesce(t - lag(t) OVER (PARTITION BY event_type ORDER BY t), 0))) AS d FROM f)
SELECT event_id, round(sum(d) OVER (PARTITION BY event_type ORDER BY t), 3) AS clock FROM g"""

STATE_CLOCK = f"""WITH {FEED}, g AS (SELECT event_id, event_type, t, greatest(0.0, least(600.0::DOUBLE, coalesce(t - lag(t) OVER (PARTITION BY event_type ORDER BY t), 0))) AS d FROM f
  WHERE (floor(epoch_us(ts) / 86400e6) + 1) * 86400000 <= (SELECT floor(max(epoch_us(ts)) / 1000) - 2 * 86400000 FROM events))
SELECT event_id, round(sum(d) OVER (PARTITION BY event_type ORDER BY t), 3) AS clock FROM g"""

QUERIES = {
    "stream_windows": (stream_windows, WINDOWS),
    "rate_kept": (rate_kept, RATE_KEPT),
    "grid_trace": (grid_trace, TRACE),
    "state_clock": (state_clock, STATE_CLOCK),
    "stream_panes": (stream_panes, PANES),
    "stream_cells": (stream_cells, ROLLING),
    "stream_whole": (stream_whole, WHOLE),
    "stream_rate": (stream_rate, RATE),
    "stream_hist": (stream_hist, "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1"),
    "stream_series": (stream_series, STREAM_SERIES),
    "stream_clock": (stream_clock, CLOCK),
    "keyed_clock": (keyed_clock, KEYED_CLOCK),
}
