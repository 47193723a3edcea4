import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brushwork.operators import grid
from brushwork.selection import cube as cubes, degree, lasso, log, series
from brushwork.selection import values as v
from brushwork.selection.model import All, Any, Not, Selections, Use, columns, cross_filter, membership, predicate, producer
from brushwork.selection.model import degree as soft
from brushwork.selection.pixels import PixelGrid


@pytest.fixture(scope="module")
def flights(spark):
    rows = [(0, 0, 600, "AA", "East"), (1, 10, 600, "AA", "East"), (2, 20, 1000, "DL", "West"), (3, 30, 600, "AA", "East"),
            (4, 20, 2000, "AA", "West"), (5, 20, 600, "UA", "West"), (6, 15, 800, None, "East")]
    return spark.createDataFrame(rows, "id long, delay long, distance long, carrier string, region string")


DELAY = producer("b", "delay", "interval", {"x": "delay"})
DISTANCE = producer("b", "distance", "interval", {"x": "distance"})
CARRIER = producer("b", "carrier", "point", {"c": "carrier"})


def three():
    return (Selections({"b": "intersect"}).set(DELAY, [{"x": v.range_(10, 30)}]).set(DISTANCE, [{"x": v.range_(500, 1500)}])
            .set(CARRIER, [{"c": v.one_of(["AA", "DL"])}]))


def ids(df, p):
    return {r.id for r in df.where(p).select("id").collect()}


def test_cross_filter_views(flights):
    s = three()
    for view, want in (("delay", {0, 1, 2, 3}), ("distance", {1, 2, 4}), ("carrier", {1, 2, 5, 6}), ("other", {1, 2})):
        assert ids(flights, predicate(cross_filter("b"), view, s)) == want


def test_inactive_empty_and_cleared(flights):
    idle = Selections({"b": "intersect"})
    everyone = set(range(7))
    assert ids(flights, predicate(Use("b", empty="none"), "delay", idle)) == set()
    assert ids(flights, predicate(Use("b"), "delay", idle)) == everyone
    empty = idle.set(DELAY, [])
    assert ids(flights, predicate(Use("b", empty="none"), "delay", empty)) == everyone  # its own is left out
    assert ids(flights, predicate(membership("b"), "delay", empty)) == set()
    assert ids(flights, predicate(membership("b"), "delay", empty.clear(DELAY))) == everyone


def test_missing_name_is_an_error_in_every_branch(flights):
    for f in (Use("no"), All((Use("b"), Use("no"))), Any((Use("b"), Not(Use("no"))))):
        with pytest.raises(KeyError):
            predicate(f, "x", three())


def test_union_global_and_correlated_tuples(flights):
    pair = producer("p", "table", "rows", {"c": "carrier", "d": "distance"})
    s = Selections({"p": "union"}).set(pair, [{"c": v.equal("AA"), "d": v.equal(2000)}, {"c": v.equal(None), "d": v.range_(700)}])
    assert ids(flights, predicate(membership("p"), "x", s)) == {4, 6}
    a, b = (producer("g", n, "point", {"c": "carrier"}) for n in ("one", "two"))
    g = Selections({"g": "global"}).set(a, [{"c": v.equal("UA")}]).set(b, [{"c": v.equal("DL")}])
    assert ids(flights, predicate(membership("g"), "x", g)) == {2}


def test_toggles():
    t = lambda x: {"c": v.equal(x)}
    s = Selections({"b": "intersect"}).toggle(CARRIER, [t("AA")]).toggle(CARRIER, [t("DL")])
    assert len(s.of("b")[CARRIER.address].tuples) == 2
    s = s.toggle(CARRIER, [t("AA")])
    assert [x["c"].value for x in s.of("b")[CARRIER.address].tuples] == ["DL"]
    assert not s.toggle(CARRIER, [t("DL")]).of("b")  # the last tuple takes the contribution with it
    assert CARRIER.address in Selections({"b": "intersect"}).set(CARRIER, []).of("b")


def test_row_local_expressions_only(spark):
    for bad in ("sum(x)", "lag(x) over (order by y)", "rand()", "x + max(y)"):
        with pytest.raises(ValueError):
            producer("b", "v", "n", {"x": bad})
    producer("b", "v", "n", {"x": "floor(delay / 20)", "y": "concat('sum(', carrier)"})


def test_null_nan_and_zero(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.0), (3, -0.0), (4, math.inf), (5, -math.inf), (6, 2.5)], "id int, x double")
    at = lambda t: ids(df, v.holds(F.col("x"), t))
    assert at(v.equal(0.0)) == at(v.equal(-0.0)) == {2, 3}
    assert at(v.equal(float("nan"))) == {1} and at(v.equal(None)) == {0}
    assert at(v.one_of([None, float("nan"), 2.5])) == {0, 1, 6}
    assert at(v.range_()) == {2, 3, 6} and at(v.range_(0.0)) == {2, 3, 6} and at(v.range_(None, 0.0, "both")) == {2, 3}
    assert at(v.range_(0.0, 2.5, "neither")) == set() and at(v.range_(0.0, 2.5, "right")) == {6}
    assert at(v.range_(0.0, 2.5)) == {2, 3} and at(v.one_of([])) == set()
    for t in (v.equal(0.0), v.range_(0.0), v.one_of([1.0])):
        assert df.where(v.holds(F.col("x"), t).isNull()).count() == 0


def test_temporal_and_decimal_ranges(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,int(id)) AS t, cast(id AS decimal(10,2)) AS d FROM range(5)")
    assert ids(df, v.holds(F.col("t"), v.range_(datetime(2024, 1, 2), datetime(2024, 1, 4)), False)) == {1, 2}
    assert ids(df, v.holds(F.col("d"), v.range_(1, 3, "both"))) == {1, 2, 3}


GRIDS = [PixelGrid((0.0, 10.0), (0.0, 100.0), 0.0, 3.0), PixelGrid((0.0, 10.0), (250.0, 17.5), 0.3, 2.5), PixelGrid((5.0, -3.0), (0.0, 640.0), 1.0, 1.0),
         PixelGrid((0.0, 10.0), (0.0, 100.0), 0.0, 3.0, clamp=True), PixelGrid((1e9, 1e9 + 1.0), (0.0, 5.0), 0.0, 0.25)]


@pytest.mark.parametrize("g", GRIDS)
def test_cells_of_rows_and_of_values_agree(spark, g):
    rng = random.Random(7)
    d0, d1 = sorted(g.domain)
    xs = [rng.uniform(d0 - 2, d1 + 2) for _ in range(400)] + [d0, d1, 0.0, -0.0, 1e30, -1e30, 1e300, None, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    got = {r.id: r.c for r in df.select("id", g.cell(F.col("x")).alias("c")).collect()}
    for i, x in enumerate(xs):
        if x is None or math.isnan(x) or (math.isinf(x) and not g.clamp):
            assert got[i] is None
        elif math.isfinite(x):
            assert got[i] == g.cell_of(x), x
    cells = sorted({c for c in got.values() if c is not None and abs(c) < 10**6})
    for lo, hi in [(cells[3], cells[-4]), (cells[5], cells[5]), (cells[0], cells[2])]:
        inside = ids(df, g.between(F.col("x"), lo, hi))
        assert inside == {i for i, c in got.items() if c is not None and lo <= c <= hi}


def test_brush_snaps_to_cells_and_decreasing_scales_swap():
    up, down = PixelGrid((0.0, 10.0), (0.0, 100.0), 0.0, 10.0), PixelGrid((0.0, 10.0), (100.0, 0.0), 0.0, 10.0)
    assert up.snap(v.range_(2.5, 7.0)) == v.Range(2, 7, True, False)
    assert down.snap(v.range_(2.5, 7.0)) == v.Range(3, 7, False, True)
    with pytest.raises(ValueError):
        up.snap(v.Range(math.inf, None))
    for bad in (dict(domain=(1.0, 1.0), range=(0.0, 1.0)), dict(domain=(0.0, 1.0), range=(0.0, 1.0), size=0.0), dict(domain=(0.0, 1.0), range=(0.0, 1.0), scale="log")):
        with pytest.raises(ValueError):
            PixelGrid(**bad)


def test_time_grid(spark):
    g = PixelGrid((datetime(2024, 1, 1), datetime(2024, 1, 11)), (0.0, 1000.0), 0.0, 7.0, "time")
    df = spark.sql("SELECT id, timestamp'2023-12-30 00:00:00.123' + make_dt_interval(0, 0, int(id) * 37) AS t FROM range(450)")
    rows = df.select("id", "t", g.cell(F.col("t")).alias("c")).collect()
    assert all(r.c == g.cell_of(r.t) for r in rows)
    assert ids(df, g.between(F.col("t"), 20, 60)) == {r.id for r in rows if 20 <= r.c <= 60}


def even_odd(u, w, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        if (ay > w) != (by > w) and u < (bx - ax) * (w - ay) / (by - ay) + ax:
            inside = not inside
    return inside


RING = [(12.3, 8.1), (88.7, 21.9), (61.2, 55.4), (93.9, 90.7), (47.7, 71.3), (9.6, 93.2), (33.4, 50.8)]


@pytest.mark.parametrize("size", [1.0, 2.5])
def test_lasso_cells_are_those_with_their_centre_inside(spark, size):
    gu, gv = PixelGrid((1000.0, 1500.0), (0.0, 100.0), 0.0, size), PixelGrid((2000.0, 2400.0), (100.0, 0.0), 0.0, size)
    rng = random.Random(3)
    pts = [(i, rng.uniform(1000, 1500), rng.uniform(2000, 2400)) for i in range(4000)] + [(9000, None, 2200.0), (9001, math.nan, 2200.0), (9002, 1250.0, math.inf)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    runs = lasso.runs(RING, gu, gv)
    want = {i for i, x, y in pts[:4000] if even_odd(gu.centre(gu.cell_of(x)), gv.centre(gv.cell_of(y)), RING)}
    axes = [lasso.Axis(F.col("x"), gu), lasso.Axis(F.col("y"), gv)]
    assert ids(df, lasso.in_boxes(axes, runs)) == want
    celled = df.withColumn("cu", gu.cell(F.col("x"))).withColumn("cv", gv.cell(F.col("y")))
    assert ids(lasso.match_boxes(celled, ["cu", "cv"], runs), F.col("in_boxes")) == want
    assert ids(celled, lasso.in_boxes([lasso.Axis(F.col("cu")), lasso.Axis(F.col("cv"))], runs)) == want
    exact = {i for i, x, y in pts[:4000] if even_odd((x - 1000) / 5, 100 - (y - 2000) / 4, RING)}
    assert ids(df, lasso.in_ring((F.col("x") - 1000) / 5, F.lit(100.0) - (F.col("y") - 2000) / 4, RING)) == exact


def test_lasso_refusals_and_clamped_plots():
    g = PixelGrid((0.0, 1.0), (0.0, 100.0))
    for ring in ([(0, 0), (1, 1)], [(0, 0), (1, math.nan), (2, 2)], [(0, -1e7), (50, 1e7), (100, 0)]):
        with pytest.raises(ValueError):
            lasso.runs(ring, g, g)
    held = PixelGrid((0.0, 1.0), (0.0, 100.0), clamp=True)
    runs = lasso.runs([(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)], held, held)
    assert lasso.hull(runs) == ((0, 100), (0, 100))


def test_voxel_membership_through_a_join(spark):
    cells = [(i, j, k) for i in range(12) for j in range(12) for k in range(12) if (i * 7 + j * 3 + k) % 5 == 0]
    df = spark.createDataFrame([(n, n % 13, n // 13 % 13, n // 169) for n in range(13 * 13 * 12)], "id int, i long, j long, k long")
    boxes = [tuple((c, c) for c in cell) for cell in cells]
    got = ids(lasso.match_boxes(df, ["i", "j", "k"], boxes), F.col("in_boxes"))
    assert got == {r.id for r in df.collect() if (r.i, r.j, r.k) in set(cells)}


@pytest.mark.parametrize("seed", range(6))
def test_degree_table_equals_formula_and_is_one_where_the_predicate_holds(spark, seed):
    rng = random.Random(seed)
    dims = 2 + seed % 2
    sizes = [rng.choice([1.0, 2.0, 5.0]) for _ in range(dims)]
    boxes = []
    for _ in range(rng.randint(9, 40)):
        lo = [rng.randint(0, 20) for _ in range(dims)]
        boxes.append(tuple((a, a + rng.randint(0, 4)) for a in lo))
    width = rng.choice([0.0, 3.0, 10.0, 40.0])
    names = [f"c{d}" for d in range(dims)]
    pts = [(i, *[rng.randint(-20, 45) for _ in names]) for i in range(800)] + [(900, *[None] * dims)]
    df = spark.createDataFrame(pts, "id int, " + ", ".join(f"{n} long" for n in names))
    axes = [lasso.Axis(F.col(n)) for n in names]
    both = degree.with_degree(df, names, sizes, boxes, width, "t").withColumn("f", degree.box_degree(axes, sizes, boxes, width))
    for r in both.collect():
        cell = [r[n] for n in names]
        if cell[0] is None:
            assert r.t == r.f == 0
            continue
        d = min(math.sqrt(sum((max(lo - c, c - hi, 0) * s) ** 2 for c, (lo, hi), s in zip(cell, b, sizes))) for b in boxes)
        want = 1.0 if d == 0 else 0.0 if width == 0 else max(0.0, 1 - d / width)
        assert abs(r.t - want) < 1e-12 and abs(r.f - want) < 1e-12 and (r.t == 1.0) == (d == 0)


def test_soft_composition(flights):
    x = PixelGrid((0.0, 30.0), (0.0, 30.0))
    soft_delay = producer("b", "delay", "interval", {"x": "delay"}, {"x": x})
    s = Selections({"b": "intersect", "k": "union"}).set(soft_delay, [{"x": v.range_(20.0, 25.0)}]).set(
        producer("k", "t", "p", {"c": "carrier"}), [{"c": v.equal("DL")}], partial={"AA": 0.25})
    b, k = membership("b"), membership("k")
    got = {}
    for name, f in {"b": b, "k": k, "all": All((b, k)), "any": Any((b, k)), "not": Not(b)}.items():
        got[name] = {r.id: r.d for r in flights.select("id", soft(f, "z", s, 10.0).alias("d")).collect()}
    assert got["b"] == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.4, 4: 1.0, 5: 1.0, 6: 0.5}
    assert got["k"] == {0: 0.25, 1: 0.25, 2: 1.0, 3: 0.25, 4: 0.25, 5: 0.0, 6: 0.0}
    assert all(got["all"][i] == min(got["b"][i], got["k"][i]) and got["any"][i] == max(got["b"][i], got["k"][i]) for i in range(7))
    assert got["not"][3] == 0.6
    with pytest.raises(ValueError):  # a range without a grid has no distance
        soft(b, "z", Selections({"b": "intersect"}).set(DELAY, [{"x": v.range_(1, 2)}]), 5.0)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(0, 1, 4.0, 0.0), (1, 1, 0.0, 0.0), (2, 1, 2.0, 2.0), (3, 2, 0.0, 5.0), (4, 2, 4.0, 5.0), (5, 3, 0.0, 1.0), (6, 3, 1.0, 1.0), (7, 4, 1.0, 1.0),
            (8, 5, 1.5, None), (9, 6, 3.0, 1.0), (10, 6, 3.0, 1.0)]
    return spark.createDataFrame(rows, "id int, line int, t double, n double")


@pytest.mark.parametrize("start, end, want", [
    ((2.5, 0.0), (2.5, 3.0), {1}), ((2.0, 4.0), (2.0, 6.0), {2}), ((0.5, 0.0), (0.5, 6.0), {1, 2, 3}), ((2.0, 2.0), (2.0, 2.0), {1}),
    ((1.0, 1.0), (1.0, 1.0), {1, 3}), ((1.5, 1.0), (1.2, 1.0), set()), ((0.5, 1.0), (3.0, 1.0), {1, 3, 6}), ((5.0, 0.0), (6.0, 9.0), set())])
@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_line_brush(lines, start, end, want, rows):
    assert {r.line for r in series.crossing_keys(lines, "line", "t", "n", start, end, rows).collect()} == want


def test_timebox_and_soft_series(lines):
    keys = lambda xs, ys: {r.line for r in series.timebox_keys(lines, "line", "t", "n", xs, ys).collect()}
    assert keys((0.0, 4.0), (0.0, 2.0)) == {1, 3, 4, 6} and keys((3.5, 4.0), (4.0, 6.0)) == {2} and keys((8.0, 9.0), (0.0, 9.0)) == set()
    deg = {r.line: r.degree for r in series.timebox_degrees(lines, "line", "t", "n", (0.0, 4.0), (0.0, 1.0)).collect()}
    assert deg == {1: 2 / 3, 3: 1.0, 4: 1.0, 6: 1.0}
    soft_line = {r.line: r.degree for r in series.crossing_degrees(lines, "line", "t", "n", (2.5, 0.0), (2.5, 3.0), (1.0, 1.0), 4.0).collect()}
    assert soft_line[1] == 1.0 and soft_line[3] == 1 - 1.5 / 4 and abs(soft_line[2] - (1 - math.hypot(1.5, 2.0) / 4)) < 1e-12
    for bad in (lambda: series.timebox_keys(lines, "line", "t", "n", (2.0, 1.0), (0.0, 1.0)),
                lambda: series.crossing_keys(lines, "line", "t", "n", (math.nan, 0.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            bad()


MEASURES = [("rows", None, "n"), ("valid", "distance", "v"), ("sum", "distance", "s"), ("min", "distance", "lo"), ("max", "distance", "hi"), ("mean", "distance", "m"),
            ("var_samp", "distance", "vs"), ("var_pop", "distance", "vp"), ("stddev_samp", "distance", "ss"), ("stddev_pop", "distance", "sp")]


def test_preaggregated_equals_direct_in_every_state(spark, flights):
    x = PixelGrid((0.0, 60.0), (0.0, 60.0))
    focus = producer("b", "delay", "interval", {"x": "delay"}, {"x": x})
    rest = Selections({"b": "intersect"}).set(DISTANCE, [{"x": v.range_(500, 1900)}])
    groups = {"carrier": F.col("carrier")}
    c = cubes.cube(flights, groups, MEASURES, cross_filter("b"), focus, "map", rest).stored()
    states = [rest, rest.set(focus, [{"x": v.range_(10.0, 30.0)}]), rest.set(focus, [{"x": v.range_(11.0, 30.0)}]), rest.set(focus, []), rest.clear(focus)]
    for s in states:
        got = {r.carrier: r for r in c.rollup(s).collect()}
        want = {r.carrier: r for r in cubes.direct(flights, groups, MEASURES, cross_filter("b"), "map", s).collect()}
        assert got.keys() == want.keys()
        for k in got:
            for _, _, name in MEASURES:
                a, b = got[k][name], want[k][name]
                assert a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-10)


def test_split_refusals(flights):
    x = PixelGrid((0.0, 60.0), (0.0, 60.0))
    focus = producer("b", "delay", "interval", {"x": "delay"}, {"x": x})
    moved = producer("b", "delay", "interval", {"x": "delay"}, {"x": PixelGrid((0.0, 50.0), (0.0, 60.0))})
    s = Selections({"b": "intersect", "u": "union"})
    cases = [(cross_filter("b"), "delay", s), (Any((Use("b"), Use("u"))), "map", s), (Not(Use("b")), "map", s), (Use("u"), "map", s),
             (Use("b"), "map", s.set(moved, [{"x": v.range_(0.0, 9.0)}]))]
    for f, view, state in cases:
        with pytest.raises(cubes.NotEligible):
            cubes.split(f, focus, view, state)
    with pytest.raises(cubes.NotEligible):
        cubes.split(Use("b"), focus, "map", Selections({"b": "union"}))


def test_moments_far_from_zero_merge_stably(spark):
    from brushwork.operators import states

    df = spark.range(20000).select((F.col("id") % 50).alias("g"), (F.col("id") % 7).alias("h"), (F.lit(1e9) + F.sin("id")).alias("x"))
    spec = [("var_samp", "x", "v"), ("mean", "x", "m")]
    got = {r.h: r for r in states.merge(states.fold(df, ["g", "h"], spec), ["h"], spec).collect()}
    for h in range(7):
        xs = 1e9 + np.sin(np.arange(20000)[np.arange(20000) % 7 == h])
        assert math.isclose(got[h].v, np.var(xs, ddof=1), rel_tol=1e-6)


def run_log(rows, resolution):
    """The rules, update by update."""
    active = {}
    for (_, op, p), tuples in rows:
        if op == "clear_all":
            active = {}
        elif op == "clear":
            active.pop(p, None)
        elif op == "set":
            if resolution == "global":
                active = {}
            active[p] = set(tuples)
        else:
            for t in tuples:
                holders = [q for q in (list(active) if resolution == "global" else [p]) if t in active.get(q, ())]
                for q in holders:
                    active[q] = active[q] - {t}
                    if not active[q]:
                        del active[q]
                if not holders:
                    active[p] = active.get(p, set()) | {t}
    return {(p, t) for p, ts in active.items() for t in (ts or {None})}


@pytest.mark.parametrize("resolution", ["intersect", "global"])
@pytest.mark.parametrize("seed", range(3))
def test_update_log_as_a_table(spark, resolution, seed):
    rng = random.Random(seed * 2 + (resolution == "global"))
    logs, flat = {}, []
    for sel in range(12):
        rows = []
        for n in range(rng.randint(1, 25)):
            op = rng.choices(["toggle", "set", "clear", "clear_all"], [10, 3, 3, 1])[0]
            p = None if op == "clear_all" else rng.choice("pqr")
            tuples = sorted({rng.choice("abcd") for _ in range(rng.randint(0 if op == "set" else 1, 3))}) if op in ("set", "toggle") else []
            seq = sel * 1000 + n
            rows.append(((seq, op, p), tuples))
            flat += [(seq, f"s{sel}", p, op, t) for t in (tuples or [None])]
        logs[f"s{sel}"] = rows
    df = spark.createDataFrame(flat, "seq long, selection string, producer string, op string, tuple string")
    fn = log.active_global if resolution == "global" else log.active_tuples
    got = {}
    for r in fn(df).collect():
        got.setdefault(r.selection, set()).add((r.producer, r.tuple))
    for sel, rows in logs.items():
        assert got.get(sel, set()) == run_log(rows, resolution), (sel, rows)


def test_log_at_a_point(spark):
    df = spark.createDataFrame([(1, "s", "p", "set", "a"), (1, "s", "p", "set", "b"), (2, "s", "p", "toggle", "a"), (3, "s", "p", "clear", None)],
                               "seq long, selection string, producer string, op string, tuple string")
    at = lambda n: {r.tuple for r in log.active_tuples(df, n).collect()}
    assert at(1) == {"a", "b"} and at(2) == {"b"} and at(3) == set()


def test_histogram_of_selected_rows(flights):
    h = grid.histogram(flights, "delay", 10.0, where=predicate(cross_filter("b"), "other", three()))
    assert {(r.bin, r.n) for r in h.collect()} == {(1, 1), (2, 1)}
    assert set(columns(DELAY)) == {"x"}
