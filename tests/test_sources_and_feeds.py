import pytest
from pyspark.sql import functions as F

from brushwork.operators import grid
from brushwork.session import materialise, scratch_path
from brushwork.sources import tables
from brushwork.streaming import feeds, live


def test_files_of_every_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b,c", None)], "k long, s string, x double")
    for kind in ("parquet", "json", "orc"):
        tables.write(df, str(tmp_path / f"t.{kind}"), fmt=kind)
        assert sorted(map(tuple, tables.read(spark, str(tmp_path / f"t.{kind}")).select("k", "s", "x").collect())) == [(1, "a", 2.5), (2, "b,c", None)]
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        df.coalesce(1).write.option("header", True).option("sep", sep).csv(str(tmp_path / f"t.{kind}"))
        got = tables.read(spark, str(tmp_path / f"t.{kind}"))
        assert dict(got.dtypes)["x"] == "double" and got.count() == 2
        assert tables.read(spark, str(tmp_path / f"t.{kind}"), schema="k string, s string, x string").schema[0].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        tables.read(spark, "somewhere.laz")


def test_named_inline_and_sql(spark):
    legend = tables.inline(spark, [("A", "Accepted"), ("N", "None")], "code string, label string")
    tables.register(spark, {"legend": legend})
    assert "legend" in tables.tables(spark) and tables.named(spark, "legend").count() == 2
    out = tables.run_sql(legend, "SELECT label FROM input WHERE code = :c UNION ALL SELECT label FROM legend WHERE code = 'N'", c="A")
    assert sorted(r.label for r in out.collect()) == ["Accepted", "None"]
    assert spark.sql("SELECT * FROM VALUES (1, 'x'), (2, 'y') AS t(k, v)").count() == 2
    assert [r.code for r in tables.head(legend, 1, ["code"]).collect()] == ["A"]


def test_a_derived_table_is_built_once(spark):
    path, built = scratch_path(spark, "derived"), []

    def build():
        built.append(1)
        return spark.range(100).select((F.col("id") * 7 % 100).alias("x"))

    for _ in range(2):
        assert tables.cached(spark, path, build, order=["x"]).count() == 100
    assert len(built) == 1 and tables.exists(spark, path)


def test_sorted_writes_let_ranges_skip_files(spark, tmp_path):
    path = str(tmp_path / "sorted")
    tables.write(spark.range(10000).select((F.col("id") * 7919 % 10000).alias("x"), F.rand(1).alias("y")), path, order=["x"], files=5)
    df = spark.read.parquet(path)
    spans = df.groupBy(F.input_file_name()).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 5 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_materialise_cuts_the_lineage(spark):
    df = materialise(spark.range(10).withColumn("r", F.rand()))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))
    assert "Scan parquet" in df._jdf.queryExecution().executedPlan().toString() or "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    return spark.range(600).select(
        F.col("id"), F.timestamp_seconds(1704067200 + F.col("id") * 10).alias("ts"), (F.col("id") * 10.0).alias("t"),
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), (F.col("id") * 13 % 40 * 1.0).alias("x"), (F.col("id") * 7 % 30 * 1.0).alias("y"),
        (F.col("id") * 31 % 101 * 1.0).alias("z"))


def recorded(spark, events, files):
    path = scratch_path(spark, "test-feed")
    feeds.write_feed(events, path, "t", files)
    return path


def test_rolling_cells_and_adaptive_grid(spark, events):
    table = live.CellTable(spark, "x", "y", "z", 2.0, "t", 600.0, 1800.0, budget=40)
    feeds.replay(events, "t", 3, lambda s: s, table)
    assert len(table.pictures) == 3 and table.pictures[0][1] == 1 and table.factor > 1  # too many cells: coarser
    newest = 5990 // 600
    want = {(r.cx, r.cy): (r.zmax, r.n) for r in events.where(F.floor(F.col("t") / 600) >= newest - 3)
            .groupBy(F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("y") / 4).alias("cy")).agg(F.max("z").alias("zmax"), F.count("*").alias("n")).collect()}
    assert {(r.cx, r.cy): (r.zmax, r.n) for r in table.rolling(2).collect()} == want
    assert table.whole().agg(F.sum("n")).first()[0] == 600
    table.compact()
    assert {(r.cx, r.cy): (r.zmax, r.n) for r in table.rolling(2).collect()} == want
    table(events, 1)  # a batch that is already in
    assert {(r.cx, r.cy): (r.zmax, r.n) for r in table.rolling(2).collect()} == want


@pytest.mark.parametrize("cells, factor, want", [(61, 1, 2), (60, 1, 1), (100, 16, 16), (12, 4, 2), (13, 4, 4), (1, 1, 1)])
def test_grid_steps(cells, factor, want):
    assert live.next_factor(cells, factor, 40) == want


def test_state_store_panes_drop_only_behind_the_watermark(spark, events):
    stream = feeds.read_feed(spark, recorded(spark, events, 4), events.schema, files_per_trigger=1)
    path = scratch_path(spark, "panes")
    panes = live.fold(stream, "x", "y", "z", 10.0, "ts", "10 minutes", "100 days")
    last = live.Latest(spark)
    feeds.run(panes, last, "complete")
    assert last.read().agg(F.sum("rows__")).first()[0] == 600
    closed = live.rate(feeds.read_feed(spark, recorded(spark, events, 1), events.schema), "ts", "10 minutes", "1 minute")
    feeds.run(closed, feeds.to_table(path), "append")
    out = spark.read.parquet(path)
    assert out.agg(F.sum("n")).first()[0] == 540 and out.count() == 9  # the last pane is still open


def test_restart_from_a_point_and_from_a_checkpoint(spark, events):
    path = recorded(spark, events, 3)
    out, place = scratch_path(spark, "rows"), scratch_path(spark, "place")
    stream = feeds.read_feed(spark, path, events.schema, since=("t", 3000.0))
    feeds.run(stream, feeds.to_table(out), checkpoint=place)
    assert spark.read.parquet(out).count() == 300
    events.withColumn("t", F.col("t") + 6000).write.mode("append").parquet(path)
    feeds.run(feeds.read_feed(spark, path, events.schema, since=("t", 3000.0)), feeds.to_table(out), checkpoint=place)
    assert spark.read.parquet(out).count() == 900


def test_a_batch_run_again_replaces_its_own_part(spark, events):
    table = live.SeriesTable(spark, "k", "t", 500.0)
    a, b = events.where("id < 250"), events.where("id >= 250")
    for number, part in ((0, a), (1, b), (1, b), (0, a)):
        table(part, number)
    assert table.read().agg(F.sum("n")).first()[0] == 600
    assert {r.k: r.t for r in table.read().groupBy("k").agg(F.min("t").alias("t")).collect()} == {"a": 0.0, "b": 0.0}


def test_keyed_clock_goes_on_from_batch_to_batch(spark, events):
    gappy = events.withColumn("t", F.when(F.col("id") >= 300, F.col("t") + 5000).otherwise(F.col("t")))
    table = live.ClockTable(spark, ["k"], "t", 25.0)
    feeds.replay(gappy, "t", 3, lambda s: s, table)
    got = {r.id: r.clock for r in table.read().collect()}
    state = {}
    for r in sorted(gappy.collect(), key=lambda r: r.t):
        prev, clock = state.get(r.k, (None, 0.0))
        clock += 0.0 if prev is None else min(25.0, max(0.0, r.t - prev))
        state[r.k] = (r.t, clock)
        assert abs(got[r.id] - clock) < 1e-9


def test_tables_go_on_after_a_restart_and_a_batch_run_again(spark, events):
    a, b, c = events.where("id < 200"), events.where("id >= 200 AND id < 400"), events.where("id >= 400")
    whole = live.ClockTable(spark, ["k"], "t", 25.0)
    whole(events, 0)
    want = {r.id: r.clock for r in whole.read().collect()}
    path = scratch_path(spark, "clock")
    for number, part in ((0, a), (1, b), (1, b), (2, c), (1, b), (2, c)):
        live.ClockTable(spark, ["k"], "t", 25.0, path=path)(part, number)  # a new object each time
    assert {r.id: r.clock for r in live.ClockTable(spark, ["k"], "t", 25.0, path=path).read().collect()} == pytest.approx(want)
    path = scratch_path(spark, "cells")
    make = lambda: live.CellTable(spark, "x", "y", "z", 2.0, "t", 600.0, 1800.0, budget=40, path=path, compact_every=2)
    for number, part in ((0, a), (1, b), (2, c), (1, b)):
        make()(part, number)
    again = make()
    assert again.generation == 1 and again.done == 1 and again.factor > 1
    newest = 5990 // 600
    want = {(r.cx, r.cy): (r.zmax, r.n) for r in events.where(F.floor(F.col("t") / 600) >= newest - 3)
            .groupBy(F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("y") / 4).alias("cy")).agg(F.max("z").alias("zmax"), F.count("*").alias("n")).collect()}
    assert {(r.cx, r.cy): (r.zmax, r.n) for r in again.rolling(2).collect()} == want
    path = scratch_path(spark, "series")
    live.SeriesTable(spark, "k", "t", 500.0, path=path)(events, 0)
    assert live.SeriesTable(spark, "k", "t", 500.0, path=path).read().agg(F.sum("n")).first()[0] == 600


def test_growing_histogram(spark, events):
    last = live.Latest(spark)
    feeds.run(live.growing_histogram(feeds.read_feed(spark, recorded(spark, events, 3), events.schema, 1), "z", 10.0), last, "complete")
    want = {(r.bin, r.n) for r in grid.histogram(events, "z", 10.0).collect()}
    assert {(r.bin, r.n) for r in last.read().collect()} == want
