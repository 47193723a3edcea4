"""Hard-negative mining against a plain loop."""

import math
import random

import pytest
from pyspark.sql import types as T

from brushwork.llm import negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
                       T.StructField("cell", T.StringType()), T.StructField("score", T.StringType()), T.StructField("anchor", T.LongType())])


def slow(rows, every=50):
    whole = [(i, [math.floor(256 * x) for x in e], y) for i, e, y, *_ in rows
             if None not in (i, e, y) and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, e, y in sorted(whole, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (e, y))
    out = []
    for a, (e, y) in anchors.items():
        others = sorted((-sum(p * q for p, q in zip(e, f)), i, z) for i, f, z in whole if i != a)
        for s, p, _ in [o for o in others if o[2] == y][:5]:
            found = [(i, -t) for t, i, z in others if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(found)]
    return sorted(out)


def mine(spark, rows, **more):
    return sorted(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, SCHEMA), **more).collect())


def table(n, width, labels, seed, values=None):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) if values else rng.gauss(0.3, 0.4) for _ in range(width)], rng.choice(labels), "x", "y", 1) for i in range(n)]


@pytest.mark.parametrize("anchors,tile", [(1 << 14, 1 << 10), (3, 7)])
def test_against_a_loop(spark, monkeypatch, anchors, tile):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = table(600, 9, [0] * 6 + [1, 2, 3], 1)
    want = slow(rows, 20)
    assert len(want) > 100 and mine(spark, rows, every=20) == want


def test_ties_repeats_and_odd_rows(spark):
    rows = table(300, 3, [0, 1], 2, [0.0, 0.5, 1.0, -1.0])
    rows += [rows[0], rows[50], rows[50], rows[3], (100, [2.0, 1.0, 0.0], 1, None, None, None)]
    rows += [(None, [1.0] * 3, 1, None, None, None), (301, None, 1, None, None, None), (302, [1.0] * 3, None, None, None, None), (350, [1.0, None, 1.0], 0, None, None, None),
             (400, [math.nan, 1.0, 1.0], 1, None, None, None), (304, [math.inf, 1.0, 1.0], 1, None, None, None), (450, [], 1, None, None, None), (305, [1.0], 0, None, None, None),
             (306, [1.0, 2.0, 3.0, 4.0], 1, None, None, None), (500, [0.1] * 7, 7, None, None, None)]
    assert mine(spark, rows) == slow(rows)


@pytest.mark.parametrize("scale", [2.0**10, 2.0**18])
def test_large_components_are_exact(spark, scale):
    rows = [(i, [x * scale for x in e], *more) for i, e, *more in table(200, 5, [0, 1], 3)]
    got = mine(spark, rows)
    assert got == slow(rows) and any(abs(r[4]) > 2**24 for r in got)


def test_nothing_and_no_negatives(spark):
    assert mine(spark, []) == []
    assert mine(spark, table(100, 4, [1], 4)) == []
    assert mine(spark, [(50, [1.0], 1, None, None, None)]) == []


def test_negative_scores_leave_windows_empty(spark):
    rows = [(0, [-1.0], 0, None, None, None), (1, [1.0], 0, None, None, None), (2, [0.7], 1, None, None, None), (3, [0.0], 0, None, None, None), (4, [0.0], 1, None, None, None)]
    assert mine(spark, rows) == slow(rows) == [(0, 3, 1, 4, 0, 0)]


def test_vectors_of_floats_and_only_read_columns(spark):
    df = spark.createDataFrame([(i, [float(x) for x in e], y) for i, e, y, *_ in table(120, 4, [0, 1], 5)], "vec_id long, embedding array<float>, label int")
    import numpy as np
    rows = [(r.vec_id, [float(np.float32(x)) for x in r.embedding], r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in negatives.mined(df).collect()) == slow(rows)
