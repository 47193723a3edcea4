"""Points to cells: grids, voxels, densities, overview pyramids, level of detail."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks, states

LIMIT = 2.0**62  # well within a 64-bit cell index
FILE_ROWS = 1 << 20  # cells a file of a stored pyramid holds at most


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(value: str | Column, size: float = 1.0, origin: float = 0.0) -> Column:
    """The integer cell floor((value - origin) / size), NULL where the value is
    not finite or its cell does not fit 64 bits."""
    x = _col(value).cast("double")
    q = x - F.lit(float(origin)) if origin else x
    if size != 1:
        q = q / F.lit(float(size))
    # The test is on the value, so the cell itself is computed once.
    return F.when(F.abs(x) < F.lit(LIMIT * min(1.0, float(size)) - abs(float(origin))), F.floor(q))


def centre(index: str | Column, size: float = 1.0, origin: float = 0.0) -> Column:
    return _col(index) * F.lit(float(size)) + F.lit(float(origin) + size / 2)


def local_origin(df: DataFrame, fields: Sequence[str], step: float = 1000.0) -> DataFrame:
    """Shift columns by their minimum rounded down to `step`, found in one pass."""
    low = df.agg(F.struct(*[(F.floor(F.min(f) / step) * step).cast("double").alias(f) for f in fields])).scalar()
    moved = df.withColumn("_low", low)
    for f in fields:
        moved = moved.withColumn(f, F.col(f) - F.col("_low").getField(f))
    return moved.drop("_low")


def window(df: DataFrame, box: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Half-open ranges on raw columns, which Parquet statistics can prune."""
    for field, (lo, hi) in box.items():
        df = df.where((F.col(field) >= F.lit(lo)) & (F.col(field) < F.lit(hi)))
    return df


def _pair(size: float | tuple[float, float]) -> tuple[float, float]:
    return size if isinstance(size, tuple) else (size, size)


def cells(df: DataFrame, x: str, y: str, z: str, label: str, size: float | tuple[float, float] = 1.0,
          origin: tuple[float, float] = (0.0, 0.0), means: Sequence[str] = ()) -> DataFrame:
    """Per cell: `cx, cy` (indices), the highest z, the label of the highest
    point, the means of other fields, and the count.

    Rows first fold per (cell, label) with a hash aggregate, so the arg-max runs
    over as few rows as there are labels in a cell, however many points it holds.
    Labels of equally high points: the greatest one."""
    sx, sy = _pair(size)
    keyed = df.select(cell(x, sx, origin[0]).alias("cx"), cell(y, sy, origin[1]).alias("cy"),
                      F.col(label).alias("label"), F.col(z).alias("z"), *means)
    fine = keyed.groupBy("cx", "cy", "label").agg(
        F.max("z").alias("z"), F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(f"{m}__s") for m in means], *[F.count(m).alias(f"{m}__n") for m in means])
    top = F.max(F.struct("z", "label"))
    return fine.groupBy("cx", "cy").agg(
        top.alias("_top"), F.sum("n").alias("n"),
        *[(F.sum(f"{m}__s") / F.sum(f"{m}__n")).alias(f"mean_{m}") for m in means],
    ).select("cx", "cy", F.col("_top.z").alias("zmax"), F.col("_top.label").alias("top"),
             *[f"mean_{m}" for m in means], "n")


def pyramid(base: DataFrame, factors: Sequence[int] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Every coarser level of a `cells` table, as one table with a `level`
    column. All levels come from one pass over the base cells and one shuffle;
    only mergeable values (highest z, its label, counts) are kept."""
    level = F.explode(F.array(*[F.lit(int(f)) for f in factors]))
    spread = base.select(level.alias("level"), "cx", "cy", F.col("zmax").alias("z"), F.col("top").alias("label"), "n")
    fold = lambda c: F.floor(F.col(c) / F.col("level")).cast("long").alias(c)
    fine = spread.select("level", fold("cx"), fold("cy"), "z", "label", "n") \
        .groupBy("level", "cx", "cy", "label").agg(F.max("z").alias("z"), F.sum("n").alias("n"))
    return fine.groupBy("level", "cx", "cy").agg(F.max(F.struct("z", "label")).alias("_top"), F.sum("n").alias("n")) \
        .select("level", "cx", "cy", F.col("_top.z").alias("zmax"), F.col("_top.label").alias("top"), "n")


def _spread_bits(c: Column) -> Column:
    """The low 31 bits of a number, a zero after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(cx: str | Column, cy: str | Column) -> Column:
    """The place of a cell along a Z-shaped curve, so that cells close in the plane are mostly close in order. Cells
    beyond 2^30 from the origin share the places of the outermost ones: the order only places rows, it selects none."""
    held = [F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), _col(c) + F.lit(1 << 30))).cast("long") for c in (cx, cy)]
    x, y = (_spread_bits(c) for c in held)
    return x.bitwiseOR(F.shiftleft(y, 1))


def store_levels(levels: DataFrame, path: str, files: int | None = None, file_rows: int = FILE_ROWS) -> None:
    """Write a pyramid once, for any number of views: a folder per level, cells along the Z curve. A file and each of its
    row groups then cover a compact patch, and a window's ranges of `cx` and `cy` skip all others by their statistics."""
    keyed = levels.withColumn("_place", morton("cx", "cy"))
    by = ["level", "_place"]
    ranged = keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).drop("_place").write.mode("overwrite").partitionBy("level") \
        .option("maxRecordsPerFile", file_rows).parquet(path)


def stored_levels(spark: SparkSession, path: str) -> DataFrame:
    """A pyramid that `store_levels` wrote."""
    return spark.read.parquet(path)


def level_for(px_per_unit: float, sizes: Sequence[float], min_px: float = 1.2, raw_from: float = 3.0) -> float | None:
    """The finest level whose cells are at least `min_px` wide on screen; None
    where the view is close enough for raw points."""
    if px_per_unit >= raw_from:
        return None
    return next((s for s in sizes if s * px_per_unit >= min_px), sizes[-1])


def lod_window(levels: DataFrame, raw: DataFrame, box: Mapping[str, tuple[float, float]], px_per_unit: float,
               sizes: Sequence[int] = (1, 2, 4, 8, 16), cell_size: float | tuple[float, float] = 1.0, margin: float = 0.2,
               budget: int = 3_000_000, order: Sequence[str] = ("z",)) -> DataFrame:
    """What a view draws: cells of the fitting level, or raw points up to a
    budget, lowest first. `box` maps the two raw columns to ranges; it is
    widened by `margin` of its span on every side. Ranges of cells that hold
    the window reach the scan of a stored pyramid."""
    wide = {f: (lo - (hi - lo) * margin, hi + (hi - lo) * margin) for f, (lo, hi) in box.items()}
    sx, sy = _pair(cell_size)
    level = level_for(px_per_unit, [s * sx for s in sizes])
    if level is None:
        return ranks.lowest(window(raw, wide), order, budget).orderBy(*order)
    factor = int(round(level / sx))
    (x0, x1), (y0, y1) = wide.values()
    near = lambda c, lo, hi, size: F.col(c).between(math.floor(lo / size) - 1, math.ceil(hi / size) + 1)
    at = levels.where((F.col("level") == factor) & near("cx", x0, x1, factor * sx) & near("cy", y0, y1, factor * sy)) \
        .withColumn("x", centre("cx", factor * sx)).withColumn("y", centre("cy", factor * sy))
    return window(at, {"x": (x0, x1), "y": (y0, y1)}).orderBy("zmax", "cx", "cy")


def density(df: DataFrame, axes: Mapping[str, tuple[str | Column, float, float]]) -> DataFrame:
    """Counts per cell of any number of axes: name -> (value, size, origin)."""
    keyed = df.select(*[cell(v, size, origin).alias(name) for name, (v, size, origin) in axes.items()])
    return keyed.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str | Column, step: float, origin: float = 0.0, where: Column | None = None,
              weight: str | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, or sum of a weight, per bin floor((value - origin) / step)."""
    if where is not None:
        df = df.where(where)
    total = F.count(F.lit(1)).alias("n") if weight is None else F.sum(F.col("_w")).alias("weight")
    keyed = df.select(*by, cell(value, step, origin).alias("bin"),
                      *([] if weight is None else [_col(weight).cast("double").alias("_w")]))
    return keyed.groupBy(*by, "bin").agg(total)


def histograms(df: DataFrame, views: Mapping[str, tuple[str | Column, float, float]], where: Mapping[str, Column]) -> DataFrame:
    """The histograms of several views, each under its own filter, from one scan: `view, bin, n`. `views` maps a name to
    (value, step, origin). A row becomes one row for each view that it counts in, and those merge before the shuffle."""
    one = [F.struct(F.lit(i).alias("_view"), cell(*at).alias("bin"), where[name].alias("_in")) for i, (name, at) in enumerate(views.items())]
    hit = df.select(F.inline(F.array(*one))).where("_in")
    counts = hit.groupBy("_view", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.get(F.array(*[F.lit(name) for name in views]), F.col("_view")).alias("view"), "bin", "n")


CELL_MEASURES = (("max", "z", "zmax"), ("rows", None, "n"))


def fold_cells(df: DataFrame, x: str, y: str, z: str, size: float | tuple[float, float],
               by: Sequence[str] = ()) -> DataFrame:
    """Per-cell states (highest z, count) of a batch, pane or any other group `by`."""
    sx, sy = _pair(size)
    keyed = df.select(*by, cell(x, sx).alias("cx"), cell(y, sy).alias("cy"), F.col(z).alias("z"))
    return states.fold(keyed, [*by, "cx", "cy"], CELL_MEASURES)


def merge_cells(folded: DataFrame, factor: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """States of any cell grid merged to a grid `factor` times coarser."""
    coarse = folded if factor == 1 else folded \
        .withColumn("cx", F.floor(F.col("cx") / factor).cast("long")) \
        .withColumn("cy", F.floor(F.col("cy") / factor).cast("long"))
    return states.merge(coarse, [*by, "cx", "cy"], CELL_MEASURES)
