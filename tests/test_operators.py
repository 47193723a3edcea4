import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brushwork.functions import geometry
from brushwork.operators import clock as clocks, facts, frames, grid, layouts, lens, ordered, profile as prof, ranks, states, terrain, transforms as tr, voxels


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), round(rng.expovariate(0.1), 1), float(rng.randint(-5, 5))) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, k string, t double, v double")


def test_bucketed_windows_equal_plain_ones(walk):
    for by in (["k"], []):
        plain = ordered.running_sum(walk, by, "t", "v", "s", tie=["id"])
        split = ordered.running_sum(walk, by, "t", "v", "s", tie=["id"], group_rows=0)
        assert sorted(map(tuple, plain.select("id", "s").collect())) == sorted(map(tuple, split.select("id", "s").collect()))
        plain = ordered.previous(walk, by, "t", {"p": "v", "pt": "t"}, tie=["id"])
        split = ordered.previous(walk, by, "t", {"p": "v", "pt": "t"}, tie=["id"], group_rows=0)
        key = lambda df: sorted(df.select("id", "p", "pt").collect(), key=lambda r: r.id)
        assert key(plain) == key(split)


def test_buckets_are_balanced_and_ordered(walk):
    b = ordered.dealt(walk, ["t"], 200)
    spans = b.groupBy("_bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).orderBy("_bucket").collect()
    assert all(a.hi <= c.lo for a, c in zip(spans, spans[1:])) and len(spans) > 8 and max(r.n for r in spans) < 900


def test_both_ways_agree_on_nulls_nan_and_ties(spark):
    rng = random.Random(2)
    values = [None, float("nan"), 1.0, -2.0, 0.5]
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice(values[:1] * 3 + values)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t double, v double").cache()
    for by in (["k"], []):
        runs = [ordered.running_sum(df, by, "t", "v", "s", group_rows=n).select("id", "s") for n in (1 << 20, 20)]
        a, b = ({r.id: str(r.s) for r in run.collect()} for run in runs)
        assert a == b
        runs = [ordered.previous(df, by, "t", {"p": "v", "q": "id"}, group_rows=n).select("id", "p", "q") for n in (1 << 20, 20)]
        a, b = ({r.id: (str(r.p), r.q) for r in run.collect()} for run in runs)
        assert a == b


def test_ties_are_dealt_over_buckets(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 3).cast("double").alias("t"))
    sizes = [r.n for r in ordered.dealt(ordered.with_tie(df), ["t", "_tie"], 1000).groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 4000
    same = spark.range(5000).select(F.lit(1.0).alias("t"))
    assert max(r["count"] for r in ordered.dealt(same, ["t"], 500).groupBy("_bucket").count().collect()) < 2500


def test_merging_keeps_a_group_with_infinite_rows_to_itself(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", float("inf")), ("b", 1.0), ("c", float("nan"))], "g string, x double")
    specs = [("var_pop", "x", "v"), ("mean", "x", "m")]
    fine = states.fold(df.withColumn("h", F.monotonically_increasing_id()), ["g", "h"], specs)
    got = {r.g: (r.v, r.m) for r in states.merge(fine, ["g"], specs).collect()}
    assert got["a"] == (0.25, 1.5) and math.isnan(got["b"][0]) and math.isnan(got["c"][1])
    assert states.merge(fine.where("g = 'a'"), [], specs).first().v == 0.25


def test_two_arms_that_meet_settle_in_few_rounds(spark):
    arm = 12  # blocks of one voxel a side, so every voxel is a component
    path = spark.createDataFrame([(i, j, 0) for i, j in {(x, y) for x in range(2 * arm) for y in (x if x < arm else 2 * arm - x,)}], "i long, j long, k long")
    assert path.count() == 2 * arm
    assert voxels.regions(path, block=1).select("region").distinct().count() == 1


def test_salted_lookup_keeps_every_row(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    left = left.unionByName(spark.range(300).select(F.lit(None).cast("long").alias("k"), (F.col("id") + 9000).alias("id")))
    for rows in (1 << 20, 100, 0):
        got = ordered.lookup(left, right, "k", group_rows=rows)
        assert got.count() == 5300 and got.where("w = k * 10 OR (w IS NULL AND (k >= 40 OR k IS NULL))").count() == 5300
        semi = ordered.lookup(left, right, "k", how="left_semi", group_rows=rows)
        assert semi.count() == left.where("k < 40").count() and semi.where("k >= 40").count() == 0
        assert ordered.lookup(left, right, "k", how="inner", group_rows=rows).count() == semi.count()


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [2.0] * 50 + [7.0], list(np.random.default_rng(4).normal(size=1500)), [1e300, -1e300, 0.0, 5.0]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    for rows in (1 << 20, 0):  # one window, and buckets
        got = ranks.percentiles(df, "x", shares, group_rows=rows).first()
        assert got.n == len(values)
        for name, p in shares.items():
            assert math.isclose(got[name], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_order_statistics_by_group_and_weight(walk, spark):
    pdf = walk.toPandas()
    got = {r.k: r for r in ranks.nearest_rank(walk, "t", {"p": 0.3}, ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        xs = sorted(part.t)
        assert got[k].p == xs[math.floor((len(xs) - 1) * 0.3 + 0.5)] and got[k].n == len(xs)
    merged = walk.groupBy("t").count()
    for rows in (1 << 20, 0):
        assert ranks.percentiles(merged, "t", {"m": 0.5}, weight="count", group_rows=rows).first().m == np.median(pdf.t)
        per = {r.k: r.m for r in ranks.percentiles(walk, "t", {"m": 0.37}, ["k"], group_rows=rows).collect()}
        assert all(math.isclose(per[k], float(np.quantile(part.t, 0.37)), rel_tol=1e-12) for k, part in pdf.groupby("k"))
    assert ranks.percentiles(walk.where("id < 0"), "t", {"m": 0.5}).count() == 0


def test_cells_arg_max_and_origin(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1.0, "a", 2.0), (0.6, 0.9, 3.0, "b", 4.0), (-0.1, 0.0, 9.0, "c", 1.0), (0.2, 0.1, 3.0, "a", 6.0), (math.nan, 0.0, 1.0, "z", 0.0)],
                               "x double, y double, z double, label string, w double")
    rows = {(r.cx, r.cy): r for r in grid.cells(df, "x", "y", "z", "label", 1.0, means=["w"]).collect()}
    assert rows[(0, 0)].top == "b" and rows[(0, 0)].zmax == 3.0 and rows[(0, 0)].mean_w == 4.0 and rows[(0, 0)].n == 3
    assert rows[(-1, 0)].top == "c" and rows[(None, 0)].n == 1
    moved = grid.local_origin(spark.createDataFrame([(657123.5,), (657999.0,)], "x double"), ["x"])
    assert sorted(r.x for r in moved.collect()) == [123.5, 999.0]


def test_level_of_detail(spark):
    assert grid.level_for(0.1, [1, 2, 4, 8, 16]) == 16 and grid.level_for(0.7, [1, 2, 4, 8, 16]) == 2 and grid.level_for(1.2, [1, 2]) == 1
    assert grid.level_for(3.0, [1, 2]) is None
    pts = spark.range(100).select((F.col("id") * 1.0).alias("x"), F.lit(0.5).alias("y"), (-F.col("id") * 1.0).alias("z"), F.lit("a").alias("label"))
    raw = grid.lod_window(None, pts, {"x": (10.0, 20.0), "y": (0.0, 1.0)}, 5.0, budget=3)
    assert [r.x for r in raw.collect()] == [21.0, 20.0, 19.0]


def test_states_at_any_grain_equal_direct(walk):
    spec = [("rows", None, "n"), ("valid", "v", "a"), ("missing", "v", "b"), ("sum", "v", "c"), ("min", "v", "d"), ("max", "v", "e"), ("mean", "v", "f"),
            ("var_samp", "v", "g"), ("var_pop", "v", "h"), ("stddev_samp", "v", "i"), ("stddev_pop", "v", "j")]
    part = walk.withColumn("pane", F.col("id") % 9).withColumn("v", F.when(F.col("id") % 4 != 0, F.col("v")))
    folded = states.fold(part.where("id < 1000"), ["k", "pane"], spec).unionByName(states.fold(part.where("id >= 1000"), ["k", "pane"], spec))
    got, want = states.merge(folded, ["k"], spec).toPandas(), states.direct(part, ["k"], spec).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("k", ignore_index=True), want.sort_values("k", ignore_index=True), rtol=1e-10)
    with pytest.raises(ValueError):
        states.Measure("median", "v", "m")


BARS = [(0, 0.0, 10.0, 5), (1, 10.0, 20.0, 0), (2, 20.0, 30.0, 15), (3, 30.0, 40.0, 20)]


def test_bars_and_stack(spark):
    bins = spark.createDataFrame(BARS, "bin long, lo double, hi double, n long")
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 5.0, 10.0, 15.0, 25.0, 40.0, 99.0)], "v double")
    at = layouts.position(layouts.position(df, "v", bins, False, "bar"), "v", bins, True, "stack")
    got = {r.v: (r.bar, r.stack) for r in at.collect()}
    want = {-5.0: (0, 0), 0.0: (0, 0), 5.0: (0.125, 0.0625), 10.0: (0.25, 0.125), 15.0: (0.375, 0.125), 25.0: (0.625, 0.125 + 7.5 / 40), 40.0: (1, 1), 99.0: (1, 1)}
    assert {k: (round(a, 12), round(b, 12)) for k, (a, b) in got.items()} == want
    back = layouts.value_at(at.where("v in (0.0, 5.0, 25.0, 40.0)"), "stack", bins, True)
    assert {r.v: round(r.value, 9) for r in back.collect()} == {0.0: 0.0, 5.0: 5.0, 25.0: 25.0, 40.0: 40.0}
    edge = layouts.value_at(spark.createDataFrame([(0.125,), (0.1251,)], "u double"), "u", bins, True)
    assert [round(r.value, 2) for r in edge.orderBy("u").collect()] == [10.0, 20.0]  # no x falls in the empty bin
    part = spark.createDataFrame([(2, 3), (3, 20)], "bin long, n long")
    layer = {r.bin: (r.layer, r.share) for r in layouts.context(bins, part).collect()}
    assert layer == {0: (0, 0.0), 1: (0, 0.0), 2: (3, 0.2), 3: (20, 1.0)}
    assert {(r.bin, r.clip_lo, r.clip_hi) for r in layouts.clip(bins, 5.0, 20.0).collect()} == {(0, 5.0, 10.0), (1, 10.0, 20.0)}


def test_a_million_bins_have_no_single_task(spark):
    """Positions among 10^6 bins against numpy, and back; running counts and values meet per bucket."""
    n = 1_000_000
    bins = spark.range(n).select(F.col("id").alias("bin"), (F.col("id") * 0.5).alias("lo"), (F.col("id") * 0.5 + 0.5).alias("hi"), (F.col("id") % 3).alias("n"))
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.rand(4) * 600_000.0 - 40_000.0).alias("v"))
    df = hot.unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),), (0.0,), (499_999.75,)], "v double"))
    got = layouts.position(df, "v", bins, True, "u", group_rows=100_000).toPandas()
    counts = np.arange(n) % 3
    upto = np.cumsum(counts)
    v = got.v.to_numpy(dtype=float)
    i = np.clip(np.floor(np.nan_to_num(v, nan=n, posinf=n, neginf=-1) * 2).astype(int), 0, n - 1)
    share = np.clip(np.where(np.isneginf(v), 0.0, np.where(np.isnan(v), 1.0, (v - i * 0.5) / 0.5)), 0, 1)
    want = (upto[i] - counts[i] + share * counts[i]) / upto[-1]
    known = got.v.notna() | got.u.notna()
    assert len(got) == 3005 and np.allclose(got.u[known], want[known], atol=1e-12)
    u = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 501)] + [(None,)], "u double")
    back = layouts.value_at(u, "u", bins, True, "v", group_rows=100_000).toPandas()
    assert back.v[back.u.isna()].isna().all()
    back = back[back.u.notna()]
    j = np.searchsorted(upto / upto[-1], back.u.to_numpy(), side="left")
    j = np.where(counts[j] > 0, j, np.searchsorted(upto, upto[j], side="left"))
    j = np.where(counts[j] > 0, j, j + 1)
    inside = (back.u - (upto[j] - counts[j]) / upto[-1]) / (counts[j] / upto[-1])
    assert np.allclose(back.v, j * 0.5 + 0.5 * np.clip(inside, 0, 1), atol=1e-6)


def test_both_layouts_agree(spark):
    rng = random.Random(9)
    edges = sorted(rng.sample(range(1000), 61))
    bins = spark.createDataFrame([(i, a / 4, b / 4, rng.choice([0, 0, 1, 7])) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin long, lo double, hi double, n long")
    v = [rng.choice([None, float("nan"), float("inf"), -1.0, rng.uniform(-10, 270), rng.choice(edges) / 4]) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    for step in (lambda **k: layouts.position(df, "v", bins, True, "u", **k), lambda **k: layouts.value_at(df.withColumn("v", F.col("v") / 250), "v", bins, True, "u", **k)):
        one, other = ({r.i: str(r.u) for r in step(**k).collect()} for k in ({}, {"few": 3, "group_rows": 50}))
        assert one == other and len(one) == 400


def test_as_of_equals_a_search(spark):
    rng = random.Random(3)
    marks = [(rng.choice([None, float(rng.randint(0, 60))]), j) for j in range(50)]
    rows = [(i, rng.choice([None, float("nan"), 5.0, rng.uniform(-5, 70)])) for i in range(500)]
    left, right = spark.createDataFrame(rows, "i int, v double"), spark.createDataFrame(marks, "k double, j int")
    got = {r.i: r.m for r in ordered.as_of(left, F.col("v"), right, F.col("k"), F.struct("k", "j"), "m", rows_each=40).collect()}
    for i, v in rows:
        met = [(k, j) for k, j in marks if v is not None and k is not None and (math.isnan(v) or k <= v)]
        assert (None if got[i] is None else tuple(got[i])) == max(met, default=None)


@pytest.mark.parametrize("k", [0, 37, 1500, 5000])
def test_the_lowest_rows_are_found_by_histograms(spark, k):
    """Exponents far apart, many ties, and values without a place in a histogram."""
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308, 5e-324]
    rows = [(rng.choice([*odd, 3.0, 3.0, 3.0, rng.expovariate(1), 10 ** rng.uniform(-300, 300)]), rng.choice("abc"), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "z double, s string, i int")
    place = lambda r: ((0, 0) if r[0] is None else (2, 0) if math.isnan(r[0]) else (1, r[0]), r[1], r[2])
    for order, key in ((["z", "s", "i"], place), (["s", "i"], lambda r: (r[1], r[2])), (["i"], lambda r: r[2])):
        got = {r.i for r in ranks.lowest(df, order, k, edge_rows=20).collect()}
        assert got == {r[2] for r in sorted(rows, key=key)[:k]}
    tied = ranks.lowest(df.select(F.lit(1).alias("one"), "i"), ["one"], k, edge_rows=50)
    assert tied.count() == tied.distinct().count() == min(k, 2000)
    assert ranks.lowest(df.limit(0), ["z"], k).count() == 0


def _rows_read(df):
    """Rows that leave the scan, what its statistics skip left out."""
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_window_reads_its_part_of_a_stored_pyramid(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 256
    i = np.arange(n * n)
    base = spark.createDataFrame(pd.DataFrame({"cx": i // n - 100, "cy": i % n - 100, "zmax": rng.random(n * n), "top": "a", "n": 1}))
    levels = grid.pyramid(base, [1, 4])
    grid.store_levels(levels, str(tmp_path / "p"), files=16, file_rows=1024)
    stored = grid.stored_levels(spark, str(tmp_path / "p"))
    key = lambda df: sorted(map(tuple, df.select("level", "cx", "cy", "zmax", "top", "n").collect()))
    assert key(stored) == key(levels)
    read = []
    for side in (8, 64, 256):
        box = {"x": (0.0, float(side)), "y": (0.0, float(side))}
        got, want = (grid.lod_window(at, None, box, 1.5, sizes=[1, 4], margin=0.0) for at in (stored, levels))
        assert key(got) == key(want) and len(key(got)) == min(side, 156) ** 2
        at = stored.where((F.col("level") == 1) & F.col("cx").between(0, side - 1) & F.col("cy").between(0, side - 1))
        read.append(_rows_read(at))
    assert read[0] <= 4096 and read[0] < read[1] < read[2] <= n * n


def test_cells_along_the_curve(spark):
    at = spark.createDataFrame([(x, y) for x in range(-4, 4) for y in range(-4, 4)] + [(2**40, 0), (-(2**40), 0)], "x long, y long")
    order = {(r.x, r.y): r.m for r in at.select("x", "y", grid.morton("x", "y").alias("m")).collect()}
    for (x, y), m in order.items():
        a, b = (max(0, min(2**31 - 1, c + 2**30)) for c in (x, y))
        assert m == sum(((a >> i & 1) << 2 * i) | ((b >> i & 1) << 2 * i + 1) for i in range(31))


def test_distinct_counts_merge(spark):
    """Sketches of parts merge to within four standard errors, and small sets to the exact count."""
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40_000).alias("a"), (F.col("id") % 20 / 4).alias("b"),
                                    F.when(F.col("id") % 3 == 0, F.lit("x")).alias("c"), (F.col("id") % 16).alias("pane"))
    specs = [("approx_distinct", c, c) for c in "abc"]
    folded = states.fold(df.where("id % 2 = 0"), ["g", "pane"], specs).unionByName(states.fold(df.where("id % 2 = 1"), ["g", "pane"], specs))
    exact = {r.g: r for r in df.groupBy("g").agg(*[F.count_distinct(c).alias(c) for c in "abc"]).collect()}
    for merged in (states.merge(folded, ["g"], specs), states.direct(df, ["g"], specs)):
        for row in merged.collect():
            assert abs(row.a - exact[row.g].a) <= 4 * states.SKETCH_ERROR * exact[row.g].a
            assert (row.b, row.c) == (exact[row.g].b, exact[row.g].c)
    none = states.merge(states.fold(df.limit(0), [], specs), [], specs).first()
    assert none.a == 0


def test_facts_of_odd_charts(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 3.0), ("c", 2, None)], "k string, x int, v double")
    got = {(r.fact, r.key, r.value) for r in facts.chart(df, "point", ["k", "x"], "v").collect()}
    assert got == {("extreme", "a \u00b7 1", 3.0)}  # ties go to the lesser key, three rows have no outliers
    assert facts.chart(df.limit(0), "heatmap", ["k", "x"], "v").count() == 0
    far = spark.createDataFrame([(i, float(i % 3)) for i in range(20)] + [(20, 99.0)], "k int, v double")
    out = {r.fact: r for r in facts.chart(far, "arc", ["k"], "v").collect()}
    assert out["outlier"].value == 1 and (out["outlier"].lo, out["outlier"].hi) == (-3.0, 5.0) and out["proportion"].key == "20" and out["extreme"].value == 0
    with pytest.raises(ValueError):
        facts.chart(df, "line", ["k"], "v")


def test_slices_of_large_groups(spark):
    rows = [(i % 2, i, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    for by in (["g"], []):
        one, other = (sorted(map(tuple, tr.stack(df, "o", "v", by, **k).collect())) for k in ({}, {"group_rows": 20}))
        assert one == other and len(one) == 500


def test_glyph_slices(spark):
    df = spark.sql("SELECT * FROM VALUES (1,4,1),(2,6,1),(3,10,1),(4,3,1),(5,7,1),(6,8,1),(1,4,2),(3,1,2) AS t(category, value, x)")
    s = {(r.x, r.category): (r.start, r.total) for r in tr.stack(df, "category", "value", ["x"]).collect()}
    assert s[(1, 1)] == (0, 38) and s[(1, 3)] == (10, 38) and s[(1, 6)] == (30, 38) and s[(2, 3)] == (4, 5)


@pytest.mark.parametrize("options, want", [
    (dict(maxbins=12, extent=(-60.0, 180.0)), (-60.0, 180.0, 20.0)), (dict(step=10.0, extent=(-60.0, 180.0)), (-60.0, 180.0, 10.0)),
    (dict(maxbins=20, extent=(0.0, 100.0)), (0.0, 100.0, 5.0)), (dict(maxbins=10, extent=(0.0, 1.0)), (0.0, 1.0, 0.1)), (dict(maxbins=10, extent=(3.0, 97.0)), (0.0, 100.0, 10.0)),
    (dict(maxbins=5, extent=(0.0, 1e6)), (0.0, 1e6, 200000.0)), (dict(maxbins=20, minstep=10.0, extent=(0.0, 100.0)), (0.0, 100.0, 10.0)),
    (dict(maxbins=10, extent=(3.0, 97.0), nice=False), (3.0, 97.0, 10.0)), (dict(steps=[1.0, 7.0, 30.0], maxbins=10, extent=(0.0, 100.0)), (0.0, 105.0, 7.0))])
def test_bin_parameters(spark, options, want):
    p = tr.bin_params(spark.range(1).select(F.lit(1.0).alias("v")), "v", **options).first()
    assert tuple(round(x, 9) for x in p) == want


def test_bins_of_rows(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 9.999, 10.0, 99.0, 100.0, None)], "v double")
    got = {r.v: (r.a, r.b) for r in tr.bin_rows(df, "v", ("a", "b"), maxbins=10).collect()}
    assert got == {0.0: (0.0, 10.0), 9.999: (0.0, 10.0), 10.0: (10.0, 20.0), 99.0: (90.0, 100.0), 100.0: (90.0, 100.0), None: (None, None)}
    one = tr.bin_rows(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v").first()
    assert one.bin0 <= 5.0 <= one.bin1 and one.bin1 > one.bin0
    for bad in (dict(maxbins=0), dict(step=-1.0), dict(base=1.0), dict(steps=[3.0, 1.0]), dict(extent=(2.0, 1.0)), dict(divide=(1,))):
        with pytest.raises(ValueError):
            tr.bin_params(df, "v", **bad)


def test_truthiness_filters(spark):
    df = spark.createDataFrame([(0.0, "", True), (math.nan, "0", False), (2.0, None, None), (None, "x", True)], "a double, s string, f boolean")
    assert tr.where(df, F.col("a")).count() == 1 and tr.where(df, "s").count() == 2 and tr.where(df, "f").count() == 2 and tr.where(df, "a > 1 AND NOT isnan(a)").count() == 1


def test_zoom_and_highlight_refusals(spark):
    df = spark.range(101).select((F.col("id") * 1.0).alias("x"))
    assert tr.zoom(df, "x", 10.0, 20.0).count() == 11
    for lo, hi in ((5.0, 5.0), (200.0, 300.0)):
        with pytest.raises(ValueError):
            tr.zoom(df, "x", lo, hi)
    assert prof.highlight(df, "x").count() == 10 and prof.highlight(df, "x", "outliers").count() == 1


def test_nulls_stay_apart_from_clamps(spark):
    df = spark.createDataFrame([(None,), (0.5,)], "x double")
    u = lens.interval_degree(F.col("x"), (0.0, 1.0), soft=0.5)
    assert [r.d for r in df.select(u.alias("d")).collect()] == [0.0, 1.0]
    assert df.select(tr.clip(F.col("x"), 1.0, 2.0).alias("c")).collect()[0].c is None
    assert tr.unit_log(F.lit(None).cast("double"), F.lit(1.0), F.lit(10.0)) is not None
    assert spark.range(1).select(tr.unit_log(F.lit(None).cast("double"), F.lit(1.0), F.lit(10.0)).alias("u")).first().u is None


@pytest.mark.parametrize("tile", [4, 64])
def test_hillshade_against_plain_loop(spark, tile):
    rng = random.Random(5)
    heights = {(i, j): rng.uniform(0, 30) for i in range(-9, 14) for j in range(-7, 9) if rng.random() < 0.8}
    df = spark.createDataFrame([(i * 2.0, j * 2.0, z) for (i, j), z in heights.items()], "x double, y double, z double")
    got = {(round(r.x / 2), round(r.y / 2)): r.hillshade for r in terrain.hillshade(df, "x", "y", "z", cell=2.0, tile=tile).collect()}
    assert got.keys() == heights.keys()
    az, alt = math.radians(315), math.radians(45)
    for (i, j), z in heights.items():
        h = lambda a, b: heights.get((i + a, j + b), z)
        gx = ((h(1, 1) + 2 * h(1, 0) + h(1, -1)) - (h(-1, 1) + 2 * h(-1, 0) + h(-1, -1))) / 16
        gy = ((h(-1, 1) + 2 * h(0, 1) + h(1, 1)) - (h(-1, -1) + 2 * h(0, -1) + h(1, -1))) / 16
        s = math.atan(math.hypot(gx, gy))
        want = max(0.0, math.sin(alt) * math.cos(s) + math.cos(alt) * math.sin(s) * math.cos(az - math.atan2(gy, -gx)))
        assert abs(got[(i, j)] - want) < 1e-9


def flood(cells):
    cells, out = set(cells), {}
    while cells:
        first = min(cells)
        todo, region = [first], set()
        cells.discard(first)
        while todo:
            c = todo.pop()
            region.add(c)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    for d in (-1, 0, 1):
                        q = (c[0] + a, c[1] + b, c[2] + d)
                        if q in cells:
                            cells.discard(q)
                            todo.append(q)
        for c in region:
            out[c] = first
    return out


@pytest.mark.parametrize("block, share", [(32, 0.08), (4, 0.08), (3, 0.15)])
def test_regions_against_flood_fill(spark, block, share):
    rng = random.Random(block)
    cells = [(i, j, k) for i in range(-8, 10) for j in range(10) for k in range(6) if rng.random() < share]
    cells += [(i, 30, 0) for i in range(-40, 40)]  # a long chain over many blocks
    df = spark.createDataFrame(cells, "i long, j long, k long")
    got = {(r.i, r.j, r.k): tuple(r.region) for r in voxels.regions(df, block).collect()}
    assert got == flood(cells)


def test_largest_region_breaks_ties_by_its_first_voxel(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (1, 1, 1, 5), (9, 9, 9, 10), (20, 0, 0, 1)], "i long, j long, k long, n long")
    rows = voxels.largest_region(df, 0.3).collect()
    assert {(r.i, r.j, r.k) for r in rows} == {(0, 0, 0), (1, 1, 1)} and {r.regions for r in rows} == {2}


def test_frames(spark):
    a = spark.createDataFrame([("p", None, 1.0), ("x", "p", 2.0), ("y", "p", 3.0)], "key string, up string, v double")
    b = spark.createDataFrame([("x", "p", 5.0), ("z", "p", 6.0), ("w", "q", 7.0), ("q", None, 8.0)], "key string, up string, v double")
    rows = {r.key: r for r in frames.frame_diff(a, b, "key", "up", ["v"]).collect()}
    assert {k: r.status for k, r in rows.items()} == {"p": "exit", "x": "update", "y": "exit", "z": "enter", "w": "enter", "q": "enter"}
    assert (rows["z"].a_v, rows["z"].from_parent) == (1.0, True) and (rows["w"].a_v, rows["w"].from_parent) == (None, False)
    assert (rows["x"].a_v, rows["x"].b_v) == (2.0, 5.0) and rows["y"].to_parent is False


def test_profile_roles_and_drift(spark):
    pdf = pd.DataFrame({"cx": [1.0, 2.0, 3.0], "n": [5, 5, None], "tag": ["a", "b", None], "place": ["POINT (1 2)", "POINT (3 4)", "POINT (5 6)"]})
    a = prof.profile(spark.createDataFrame(pdf))
    rows = {r.column: r for r in a.collect()}
    assert {c: r.role for c, r in rows.items()} == {"cx": "coordinate", "n": "measure", "tag": "category", "place": "geometry"}
    assert rows["tag"].distinct == 2 and rows["tag"].nulls == 1 and rows["cx"].p90 == pytest.approx(2.8)
    wide = spark.range(200).select(F.concat(F.lit("t"), "id").alias("s"), F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") * 1.0).alias("m"))
    assert {r.column: r.role for r in prof.profile(wide).collect()}["s"] == "text"
    calm = wide.withColumn("m", F.col("m") % 200)
    found = {(r.column, r.change) for r in prof.drift(prof.profile(calm), prof.profile(wide.unionByName(wide).withColumn("new", F.lit(1)))).collect()}
    assert ("*", "rows") in found and ("new", "new column") in found
    big = wide.unionByName(spark.range(5000).select(F.lit("t").alias("s"), (F.col("id") % 200 * 1.0).alias("m")))
    assert ("m", "extreme value") in {(r.column, r.change) for r in prof.drift(prof.profile(calm), prof.profile(big)).collect()}
    assert prof.drift(a, a).count() == 0


def test_whole_numbers_beyond_doubles_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 1,)], "k long")
    assert prof.profile(df).first().distinct == 2


def test_facts(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 3.0, 30.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("b", 3.0, 5.1)], "k string, x double, y double")
    t = {r.k: r for r in facts.trend(df, "k", "x", "y").collect()}
    assert (t["a"].direction, t["a"].slope, t["a"].peak_x) == ("rising", 10.0, 3.0) and t["b"].direction == "flat"
    assert facts.outliers_iqr(df.where("k = 'a'"), "y").count() == 0  # fewer than four values
    assert [r.y for r in facts.outliers_iqr(spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0, 50.0)], "y double"), "y").collect()] == [50.0]
    r = {(x.fact, x["rank"]): x.k for x in facts.rank_facts(df.groupBy("k").agg(F.sum("y").alias("y")), ["k"], "y").collect()}
    assert r == {("proportion", 1): "a", ("rank", 2): "b", ("fewest", 1): "b"}
    assert {(p.k, p.x, p.peak) for p in facts.peaks(df, "k", "x", "y").collect()} == {("a", 3.0, 30.0), ("b", 3.0, 5.1)}


def test_lenses(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "r", i / 100, 2.0 * i + 1 if i % 2 else 4.0) for i in range(100)], "id int, k string, u double, y double")
    under = lens.inside(F.col("u"), F.lit(0.5), (0.5, 0.5), 0.2)
    fit = {r.k: r for r in lens.regression(df, under, "k", "u", "y").collect()}
    assert fit["s"].slope == pytest.approx(200) and fit["s"].r2 == pytest.approx(1) and fit["r"].r2 == 1.0 and fit["s"].n == 20
    kept = lens.sample(df, under, F.col("id"), 0.5)
    assert kept.where(~under).count() == df.where(~under).count() and 5 < kept.where(under).count() < 36
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in lens.sample(df.repartition(7), under, F.col("id"), 0.5).collect())
    assert lens.mole(df, under, "y", 0.5).where(under & (F.col("y") > 100)).count() == 0


def test_similarity_of_a_turned_copy(spark):
    df = spark.range(50).select(F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    df = df.withColumn("u", F.col("y") * -2 + 3).withColumn("v", F.col("x") * 2 - 1)
    r = facts.similarity_fit(df, ("x", "y"), ("u", "v")).first()
    assert r.scale == pytest.approx(2) and r.rotation == pytest.approx(90) and r.residual < 1e-9


def test_geometry(spark):
    one = spark.createDataFrame([(700000.0, 6600000.0)], "x double, y double")
    g = geometry.lambert93(one, "x", "y").first()
    assert abs(g.lon - 3.0) < 1e-9 and abs(g.lat - 46.5) < 1e-7
    x, y = geometry.from_wkt(F.col("w"))
    t = spark.createDataFrame([("POINT (1.5 -2)",), ("POINT(3e2 .5)",), ("LINESTRING (0 0, 1 1)",), (None,)], "w string")
    assert [tuple(r) for r in t.select(x, y).collect()] == [(1.5, -2.0), (300.0, 0.5), (None, None), (None, None)]
    assert one.select(geometry.to_wkt(F.col("x"), F.col("y")).alias("w")).first().w == "POINT (700000.0 6600000.0)"
    u, v = geometry.fisheye(F.lit(0.5), F.lit(0.5), (0.5, 0.5), 0.3, 2.0)
    assert tuple(one.select(u, v).first()) == (0.5, 0.5)
    view = geometry.tilted((0.0, 100.0, 0.0, 100.0), (0.0, 10.0), 0.0, 90.0, 600.0)
    mid = one.select(view.u(F.lit(50.0), F.lit(50.0), F.lit(0.0)).alias("u"), view.v(F.lit(50.0), F.lit(50.0), F.lit(0.0)).alias("v")).first()
    assert mid.u == pytest.approx(300.0) and mid.v == pytest.approx(372.0)


def test_clock_over_all_and_per_key(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 9.0), ("a", 9.0), ("b", 100.0), ("b", 100.25), ("b", 400.0)], "k string, t double")
    whole = sorted((r.t, r.clock) for r in clocks.clock(df, "t").collect())
    assert whole == [(0.0, 0.0), (0.5, 0.5), (9.0, 1.5), (9.0, 1.5), (100.0, 2.5), (100.25, 2.75), (400.0, 3.75)]
    per = {(r.k, r.t): r.clock for r in clocks.clock(df, "t", 2.0, by=["k"]).collect()}
    assert per[("a", 9.0)] == 2.5 and per[("b", 100.0)] == 0.0 and per[("b", 400.0)] == 2.25


def test_small_buckets_need_no_partitions_of_their_own(spark):
    """Two thousand buckets of ten rows lie in few partitions, in order."""
    rows = ordered.dealt(spark.range(20_000).withColumn("t", F.col("id") % 3), ["t", "id"], 10)
    assert rows.select(F.input_file_name()).distinct().count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).orderBy("_bucket").collect()
    assert len(sizes) >= 2_000 and max(r.n for r in sizes) == 10
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))


def test_sums_over_missing_values_take_few_partitions(spark):
    """The first values of each key are missing; many buckets of a partition pass nothing on, and no bucket writes its own file."""
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 30 == 29, 1.0).alias("v"))
    run = ordered.running_sum(df, ["k"], "t", "v", "s", group_rows=10)
    assert len(run.inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = lambda i: float((i + 1) // 30) if i % 2 and i >= 29 else None
    assert all(r.s == want(r.id) for r in run.select("id", "s").collect())


def _counted_rows(spark, rows):
    """Numbers of so many rows, and how often rows of them were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b.assign(v=b.id * 0.5)

    return spark.range(rows).mapInPandas(run, "id long, v double"), made


def test_a_profile_reads_numbers_once(spark):
    df, made = _counted_rows(spark, 1000)
    assert [(r.distinct, r.max) for r in prof.profile(df).orderBy("position").collect()] == [(1000, 999.0), (1000, 499.5)]
    assert made.value == 1000


def test_a_drift_reads_numbers_once(spark):
    (a, made_a), (b, made_b) = _counted_rows(spark, 1000), _counted_rows(spark, 2000)
    out = prof.drift(prof.profile(a), prof.profile(b)).collect()
    assert [(r.column, r.was, r.now) for r in out] == [("*", 1000.0, 2000.0)]
    assert (made_a.value, made_b.value) == (1000, 2000)
