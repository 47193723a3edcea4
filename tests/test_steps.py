"""Selections as steps against a test of every box, and stored CloudLassos against direct ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brushwork.operators import grid, voxels
from brushwork.selection import steps, views
from brushwork.selection import values as v
from brushwork.selection.model import Any, Not, Selections, cross_filter, membership, predicate, producer
from brushwork.selection.pixels import PixelGrid

U, V = PixelGrid((0.0, 1000.0), (0.0, 1000.0), 0.0, 1.0), PixelGrid((0.0, 1000.0), (0.0, 1000.0), 0.0, 2.0)
P = producer("area", "plot", "lasso", {"u": "a", "v": "b"}, {"u": U, "v": V})
Q = producer("area", "other", "interval", {"w": "w"}, {"w": U})


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-50, 1050), rng.uniform(-50, 1050), rng.uniform(0, 100)) for i in range(1500)]
    rows += [(9001, None, 5.0, 1.0), (9002, math.nan, 5.0, 1.0), (9003, 5.0, None, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, w double").repartition(3)


def made(kind, seed):
    rng = random.Random(seed)
    span = {"runs": lambda: ((x := rng.randrange(1000), x + rng.choice((0, 3, 40, 700))), (y := rng.randrange(500), y)),
            "boxes": lambda: ((x := rng.randrange(1000), x + rng.choice((0, 5, 90))), (y := rng.randrange(500), y + rng.choice((0, 2, 30)))),
            "cells": lambda: ((x := rng.randrange(1000), x), (y := rng.randrange(500), y))}[kind]
    return [span() for _ in range(300)]


def distance(row, boxes):
    if row.a is None or row.b is None or math.isnan(row.a) or not (0 <= row.a <= 1000 and 0 <= row.b <= 1000):
        return None
    cu, cv = math.floor(row.a), math.floor(row.b / 2)
    gap = lambda c, lo, hi: max(lo - c, c - hi, 0)
    return min((math.hypot(gap(cu, *x), 2 * gap(cv, *y)) for x, y in boxes), default=math.inf)


@pytest.mark.parametrize("kind", ["runs", "boxes", "cells"])
@pytest.mark.parametrize("small", [True, False])
def test_boxes_against_every_box(spark, points, kind, small, monkeypatch):
    if not small:
        monkeypatch.setattr(steps, "BROADCAST", 0)
    boxes = made(kind, len(kind))
    area = Selections({"area": "intersect"}).set_boxes(P, boxes)
    held = steps.holds(points, membership("area"), "x", area)
    assert held.columns == [*points.columns, "holds"]
    far = {r.id: distance(r, boxes) for r in points.collect()}
    inside = [i for i in far if far[i] is not None]
    got = {r.id: r.holds for r in held.collect()}
    assert {i: got[i] for i in inside} == {i: far[i] == 0 for i in inside} and not any(got[i] for i in (9001, 9002, 9003))
    assert {r.id for r in steps.kept(points, membership("area"), "x", area).collect()} == {i for i in got if got[i]}
    faded = {r.id: r.degree for r in steps.fades(points, membership("area"), "x", area, 6.0).collect()}
    assert {i: faded[i] for i in inside} == pytest.approx({i: max(0.0, 1 - far[i] / 6) for i in inside})


def test_cells_of_a_table_in_a_tree_of_filters(spark, points):
    boxes = made("cells", 5)
    cells = spark.createDataFrame([(x[0], y[0]) for x, y in boxes] + [(None, 1)] + [(boxes[0][0][0], boxes[0][1][0])], "i long, j long")
    area = Selections({"area": "union"}).set_cells(P, cells).set(Q, [{"w": v.range_(10.0, 20.0)}])
    far = {r.id: distance(r, boxes) for r in points.collect()}
    brushed = {r.id: r.t for r in points.select("id", predicate(cross_filter("area"), "plot", area).alias("t")).collect()}
    for f, want in ((membership("area"), lambda i: far[i] == 0 or brushed[i]), (Not(membership("area")), lambda i: not (far[i] == 0 or brushed[i])),
                    (Any((cross_filter("area"), Not(membership("area")))), lambda i: True)):
        got = {r.id: r.holds for r in steps.holds(points, f, "x", area).collect()}
        assert got == {i: want(i) for i in got}
    assert {r.id for r in steps.kept(points, cross_filter("area"), "plot", area).collect()} == {i for i in brushed if brushed[i]}
    with pytest.raises(ValueError, match="steps"):
        predicate(membership("area"), "x", area)
    with pytest.raises(ValueError, match="grid"):
        Selections({"s": "union"}).set_cells(producer("s", "v", "p", {"u": "a"}), cells)


def test_two_hundred_thousand_runs(spark, points):
    fine = PixelGrid((0.0, 1000.0), (0.0, 1000.0), 0.0, 1 / 256)
    p = producer("area", "plot", "lasso", {"u": "a", "v": "b"}, {"u": fine, "v": fine})
    runs = [((200 * 256, 300 * 256 + k % 7), (k, k)) for k in range(200_000)]
    area = Selections({"area": "intersect"}).set_boxes(p, runs)
    shown = steps.kept(points, membership("area"), "x", area)
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000  # no term a box
    want = {r.id for r in points.collect() if r.a is not None and r.b is not None and 200 <= r.a < 300 + 1 / 256 and 0 <= r.b < 200_000 / 256}
    got = {r.id for r in shown.collect()}
    assert len(got ^ want) <= 1 and len(got) > 50


def test_a_moved_threshold_reads_no_points(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(c, 6), rng.gauss(c, 6), rng.gauss(c, 6), "ab"[i % 2]) for i in range(4000) for c in (rng.choice((30, 70)),)]
    df = spark.createDataFrame(rows, "x double, y double, z double, label string")
    grids = (PixelGrid((0.0, 100.0), (0.0, 20.0)),) * 3
    inside = F.col("x") + F.col("y") < 190
    stored = voxels.cloud_states(df, "x", "y", "z", inside, grids, {"label": F.col("label")})
    for structure in (0.05, 0.4, 0.9, None):
        direct = voxels.cloud_lasso(df.where(F.col("x").between(0, 100) & F.col("y").between(0, 100) & F.col("z").between(0, 100)), "x", "y", "z", inside, grids, structure)
        want = {(r.label, r["count"]) for r in direct.groupBy("label").count().collect()}
        got = stored.rollup(structure)
        assert {(r.label, r.n) for r in got.collect()} == want
        assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString() and "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("resolution", ["intersect", "union"])
def test_views_of_one_scan_equal_a_scan_each(spark, points, resolution):
    """A lasso of many boxes, a brush and cells of a table, in a cross-filter and in a tree of filters."""
    area = Selections({"area": resolution}).set_boxes(P, made("boxes", 8)).set(Q, [{"w": v.range_(10.0, 80.0)}])
    some = producer("area", "cells", "voxels", {"u": "a", "v": "b"}, {"u": U, "v": V})
    area = area.set_cells(some, spark.createDataFrame([(i * 7 % 1000, i % 500) for i in range(3000)], "u long, v long"))
    at = {"plot": ("a", 100.0, 0.0), "other": ("w", 10.0, 0.0), "cells": ("b", 50.0, 5.0), "none": ("a", 500.0, 0.0)}
    for f in (cross_filter("area"), Any((Not(membership("area")), cross_filter("area")))):
        got = sorted(map(str, views.histograms(points, at, f, area).select("view", "bin", "n").collect()))
        want = []
        for view, (c, size, origin) in at.items():
            h = grid.histogram(steps.kept(points, f, view, area), c, size, origin)
            want += h.select(F.lit(view).alias("view"), "bin", "n").collect()
        assert got == sorted(map(str, want)) and len(got) > 8


def test_views_without_brushes_count_all(spark, points):
    at = {"plot": ("a", 100.0, 0.0), "other": ("w", 10.0, 0.0)}
    got = views.histograms(points, at, cross_filter("area"), Selections({"area": "intersect"}))
    assert {r.view: r.n for r in got.groupBy("view").agg(F.sum("n").alias("n")).collect()} == {"plot": 1503, "other": 1503}
