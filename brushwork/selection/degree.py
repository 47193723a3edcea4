"""Soft selections: a degree of interest beside the yes-or-no predicate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import lookup
from .lasso import Axis, Box, hull
from .values import all_of

TABLE_CELLS = 1 << 21  # the widest degree table; beyond it each row is measured
FEW_BOXES = 8  # up to this many boxes a formula is as cheap as a look-up
FAR = 2**61  # range ends beyond are open


def check_width(width: float) -> None:
    if not (math.isfinite(width) and width >= 0):
        raise ValueError(f"a soft width is finite and not negative, not {width}")


def fold(degrees: Sequence[Column], least: bool) -> Column:
    """One least(...) or greatest(...) over all, not a nest that repeats them."""
    if not degrees:
        return F.lit(1.0 if least else 0.0)
    if len(degrees) == 1:
        return degrees[0]
    return F.least(*degrees) if least else F.greatest(*degrees)


def _gap(c: Column, lo: Column | int, hi: Column | int, size: float) -> Column:
    """Pixels from a cell to a range of cells, 0 inside; the cell is used once."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    low = not isinstance(lo, int) or lo > -FAR
    high = not isinstance(hi, int) or hi < FAR
    if low and high:
        twice = F.abs(c * 2 - (lit(lo) + lit(hi))) - (lit(hi) - lit(lo))
        cells = F.greatest(twice, F.lit(0)) / F.lit(2.0)
    elif low or high:
        cells = F.greatest(lit(lo) - c if low else c - lit(hi), F.lit(0)).cast("double")
    else:
        return F.lit(0.0)
    return cells * F.lit(float(size))


def _distance(gaps: Sequence[Column]) -> Column:
    out = gaps[0]
    for g in gaps[1:]:
        out = F.hypot(out, g)
    return out


def falling(d: Column, width: float) -> Column:
    if width == 0:
        return F.when(d == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1.0) - d / F.lit(float(width)), F.lit(0.0))


def box_degree(axes: Sequence[Axis], sizes: Sequence[float], boxes: Sequence[Box], width: float) -> Column:
    """The degree as a formula: distance in pixels to the nearest box. Rows
    farther than the width from the bounding box are 0 by a plain range test."""
    check_width(width)
    if not boxes:
        return F.lit(0.0)
    near = []
    for a, s, (lo, hi) in zip(axes, sizes, hull(boxes)):
        reach = math.ceil(width / s)
        near.append(a.between(max(lo - reach, -(2**63)), min(hi + reach, 2**63 - 1)))
    each = [_distance([_gap(a.index(), lo, hi, s) for a, s, (lo, hi) in zip(axes, sizes, b)]) for b in boxes]
    nearest = each[0] if len(each) == 1 else F.least(*each)
    return F.when(all_of(near), falling(nearest, width)).otherwise(F.lit(0.0))


def table_cells(sizes: Sequence[float], boxes: Sequence[Box], width: float) -> int:
    """How many cells lie within the width of the boxes' bounding box."""
    n = 1
    for d, s in enumerate(sizes):
        reach = math.ceil(width / s)
        n *= max(b[d][1] for b in boxes) - min(b[d][0] for b in boxes) + 1 + 2 * reach
    return n


def degree_table(spark: SparkSession, names: Sequence[str], sizes: Sequence[float], boxes: Sequence[Box],
                 width: float, degree: str = "degree") -> DataFrame:
    """The degree of every cell near the boxes. Each box offers the cells within
    its reach, and a cell takes its nearest."""
    ends = [c for n in names for c in (f"_lo_{n}", f"_hi_{n}")]
    rows = [tuple(e for pair in b for e in pair) for b in boxes]
    near = spark.createDataFrame(rows, ", ".join(f"{e} long" for e in ends))
    for n, s in zip(names, sizes):
        reach = math.ceil(width / s)
        near = near.withColumn(n, F.explode(F.sequence(F.col(f"_lo_{n}") - reach, F.col(f"_hi_{n}") + reach)))
    far = _distance([_gap(F.col(n), F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), s) for n, s in zip(names, sizes)])
    return near.select(*names, far.alias("_far")).groupBy(*names).agg(F.min("_far").alias("_far")) \
        .select(*names, falling(F.col("_far"), width).alias(degree)).where(F.col(degree) > 0)


def with_degree(df: DataFrame, cells: Sequence[str], sizes: Sequence[float], boxes: Sequence[Box], width: float,
                degree: str = "degree") -> DataFrame:
    """Adds each row's degree. Few boxes are measured in place; many become a
    table of cells, broadcast because it has at most TABLE_CELLS rows; where it
    would have more, every row is measured after all."""
    check_width(width)
    bounded = bool(boxes) and all(abs(e) < FAR for b in boxes for pair in b for e in pair)
    if len(boxes) <= FEW_BOXES or not bounded or table_cells(sizes, boxes, width) > TABLE_CELLS:
        return df.withColumn(degree, box_degree([Axis(F.col(c)) for c in cells], sizes, boxes, width))
    table = degree_table(df.sparkSession, cells, sizes, boxes, width, "_near")
    return df.join(F.broadcast(table), list(cells), "left") \
        .withColumn(degree, F.coalesce("_near", F.lit(0.0))).drop("_near")


def with_key_degree(df: DataFrame, key: str, degrees: DataFrame, degree: str = "degree") -> DataFrame:
    """Adds the degree of each row's key from a table (key, degree); keys
    without one get 0. Hot keys are dealt over tasks."""
    table = degrees.select(key, F.col(degree).alias("_near"))
    return lookup(df, table, key).withColumn(degree, F.coalesce("_near", F.lit(0.0))).drop("_near")
