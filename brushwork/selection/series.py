"""Tests that a whole series passes or fails: line brushes and timeboxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..session import materialise

Point = tuple[float, float]


def _finite(*values: float) -> None:
    if not all(math.isfinite(v) for v in values):
        raise ValueError("a series test needs finite coordinates")


def meets(p1: tuple[Column, Column], p2: tuple[Column, Column], q1: Point, q2: Point) -> Column:
    """Whether segment p1-p2 shares a point with the fixed segment q1-q2: their extents overlap on both axes, and neither
    segment lies wholly to one side of the other's line. Touching counts, points are segments of no length, and on one
    line the extents alone decide."""
    fixed = tuple(F.lit(float(v)) for v in q1), tuple(F.lit(float(v)) for v in q2)

    def side(of, line) -> Column:
        (x, y), ((x1, y1), (x2, y2)) = of, line
        return F.signum((x2 - x1) * (y - y1) - (x - x1) * (y2 - y1))

    def overlap(axis: int) -> Column:
        mine, theirs = (p1[axis], p2[axis]), (fixed[0][axis], fixed[1][axis])
        return F.greatest(F.least(*mine), F.least(*theirs)) <= F.least(F.greatest(*mine), F.greatest(*theirs))

    straddled = (side(p1, fixed) * side(p2, fixed) <= 0) & (side(fixed[0], (p1, p2)) * side(fixed[1], (p1, p2)) <= 0)
    return F.coalesce(overlap(0) & overlap(1) & straddled, F.lit(False))


def segment_distance(x: Column, y: Column, q1: Point, q2: Point, scale: Point = (1.0, 1.0)) -> Column:
    """Distance from a point to the segment after scaling both axes: in the segment's own frame, how far across its line
    the point lies, and how far beyond an end."""
    dx, dy = (q2[0] - q1[0]) * scale[0], (q2[1] - q1[1]) * scale[1]
    length = math.hypot(dx, dy)
    ux, uy = (dx / length, dy / length) if length else (1.0, 0.0)
    rx, ry = (x - F.lit(float(q1[0]))) * F.lit(float(scale[0])), (y - F.lit(float(q1[1]))) * F.lit(float(scale[1]))
    along = rx * F.lit(ux) + ry * F.lit(uy)
    across = ry * F.lit(ux) - rx * F.lit(uy)
    return F.hypot(across, F.greatest(F.lit(0.0), -along, along - F.lit(length)))


def _vertices(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(key), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))


def crossing_keys(df: DataFrame, key: str, x: str, y: str, start: Point, end: Point,
                  group_rows: int = ordered.GROUP_ROWS) -> DataFrame:
    """Keys of the series whose polyline, its vertices in (x, y) order, meets
    the segment start-end.

    Only vertices within the segment's x-range matter, with the last one before
    it and the first one after it per series. The range is a filter on x that
    reaches the scan for the vertices inside, and the two others are plain
    aggregates. Vertices drawn at one place are merged before they are ordered."""
    _finite(*start, *end)
    lo, hi = min(start[0], end[0]), max(start[0], end[0])
    v = _vertices(df, key, x, y).where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    inside = v.where((F.col("_x") >= lo) & (F.col("_x") <= hi)).groupBy(key, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    at = F.struct("_x", "_y")
    ends = v.groupBy(key).agg(F.max(F.when(F.col("_x") < lo, at)).alias("l"), F.min(F.when(F.col("_x") > hi, at)).alias("r"))
    ends = ends.select(key, F.inline(F.array_compact(F.array("l", "r")))).withColumn("_n", F.lit(1).cast("long"))
    # Written once: what follows reads it more than once, and it is far smaller than the rows.
    vertices = materialise(inside.unionByName(ends), "vertices")
    path = ordered.previous(vertices, [key], "_x", {"_px": "_x", "_py": "_y"}, tie=["_y"], group_rows=group_rows)
    here, before = (F.col("_x"), F.col("_y")), (F.col("_px"), F.col("_py"))
    # Two vertices at one place are a segment of no length.
    # The first vertex has none before it, and is no segment by itself.
    hit = (F.col("_px").isNotNull() & meets(before, here, start, end)) | ((F.col("_n") > 1) & meets(here, here, start, end))
    return path.where(hit).select(key).distinct()


def within_counts(df: DataFrame, key: str, x: str, y: str, xs: Point, ys: Point) -> DataFrame:
    """Per series, its vertices with x in the closed range, and those of them
    with y in the other. Series without any are left out."""
    _finite(*xs, *ys)
    if xs[0] > xs[1] or ys[0] > ys[1]:
        raise ValueError("a timebox needs ordered ranges")
    v = _vertices(df, key, x, y).where((F.col("_x") >= float(xs[0])) & (F.col("_x") <= float(xs[1])))
    inside = (F.col("_y") >= float(ys[0])) & (F.col("_y") <= float(ys[1]))
    return v.groupBy(key).agg(F.count(F.lit(1)).alias("in_x"), F.count_if(inside).alias("in_box"))


def timebox_keys(df: DataFrame, key: str, x: str, y: str, xs: Point, ys: Point) -> DataFrame:
    """Keys with at least one vertex in the x-range and every such vertex in the box."""
    return within_counts(df, key, x, y, xs, ys).where(F.col("in_box") == F.col("in_x")).select(key)


def timebox_degrees(df: DataFrame, key: str, x: str, y: str, xs: Point, ys: Point) -> DataFrame:
    """Per series the share of its vertices in the x-range that lie in the box, above 0."""
    d = (F.col("in_box") / F.col("in_x")).alias("degree")
    return within_counts(df, key, x, y, xs, ys).select(key, d).where(F.col("degree") > 0)


def crossing_degrees(df: DataFrame, key: str, x: str, y: str, start: Point, end: Point,
                     scale: Point, width: float) -> DataFrame:
    """Per series 1 where it meets the segment, else falling with its nearest
    vertex's distance to 0 at `width` (after `scale`); series at 0 are left out."""
    if not (all(math.isfinite(s) and s > 0 for s in scale) and math.isfinite(width) and width > 0):
        raise ValueError("a soft line brush needs a positive scale and width")
    v = _vertices(df, key, x, y)
    near = v.groupBy(key).agg(F.min(segment_distance(F.col("_x"), F.col("_y"), start, end, scale)).alias("_near"))
    hits = crossing_keys(df, key, x, y, start, end).withColumn("_hit", F.lit(True))
    d = F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) - F.col("_near") / F.lit(float(width)), F.lit(0.0)))
    return near.join(hits, key, "left").select(key, d.alias("degree")).where(F.col("degree") > 0)


def select_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the selected series. A key that holds most rows is dealt over
    tasks; a small key set is broadcast by Spark on its own."""
    return ordered.lookup(df, keys.select(key).distinct(), key, how="left_semi")
