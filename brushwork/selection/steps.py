"""Selections of any size as steps on a DataFrame: what is too large for an expression is joined.

`holds` adds whether a row is selected, `kept` filters, `fades` adds the degree; the filter may be any tree of uses, unions and
complements. A contribution of few ranges stays an expression. Many boxes of cells (a lasso's runs), and cells that lie in a table
(the voxels of a CloudLasso), become an interval index: on projections where every box is one cell wide boxes are found by that cell,
on the others by fixed bands of cells, and a row's cell picks its one entry by an equal key. Boxes of different sizes have bands of
different widths: each size class, of boxes up to STEP times as wide as others, has its own, as wide as its widest box. So a box
lies in two bands at most (more only by the reach of degrees), and for runs that don't overlap, as a lasso's, an entry lists STEP + 1
at most for each row of cells within reach. A row costs one look-up a size class and a handful of comparisons, whatever the number
of boxes, and no row is repeated.

An index of at most BROADCAST entries by its bound is broadcast; larger ones, and those of tables, are shuffled by
`ordered.lookup`, which deals the rows of hot cells over tasks. A row without a cell (NULL, or off its grid) is in no box, and
has degree 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import lookup
from . import degree as soft
from . import lasso
from .lasso import Axis, Box
from .model import All, Contribution, Filter, Mappings, Selections, Use, _used, axes, contribution_degree, contribution_holds, degree, predicate
from .values import Range, all_of

STEP = 16
BROADCAST = 1 << 19
FEW = 8  # boxes that stay an expression


def cell_boxes(c: Contribution) -> Sequence[Box] | None:
    """The contribution as bounded boxes of cells on all its projections; None where it is something else."""
    ids = [i for i, _ in c.producer.projections]
    if c.boxes:
        boxes = c.boxes
    elif any(c.producer.grid(i) is None for i in ids):
        return None
    else:
        boxes = [lasso.box_of([t[i] for i in ids]) for t in c.effective]
    return boxes if boxes and all(b is not None and all(abs(e) < soft.FAR for pair in b for e in pair) for b in boxes) else None


def box_table(df: DataFrame, boxes: Sequence[Box]) -> DataFrame:
    """lo0, hi0, lo1, ... of each box."""
    return df.sparkSession.createDataFrame(pa.table({f"{end}{d}": [b[d][e] for b in boxes] for d in range(len(boxes[0])) for e, end in enumerate(("lo", "hi"))}))


def narrow(boxes: Sequence[Box]) -> list[int]:
    """The projections on which every box is one cell wide."""
    return [d for d in range(len(boxes[0])) if all(b[d][0] == b[d][1] for b in boxes)]


def band_of(box: Box, keys: Sequence[int]) -> int:
    """The width of the bands of a box's size class."""
    longest, band = max([hi - lo + 1 for d, (lo, hi) in enumerate(box) if d not in keys], default=1), STEP
    while band < longest:
        band *= STEP
    return band


def index(boxes: DataFrame, sizes: Sequence[float], keys: Sequence[int], band: int, width: float = 0.0) -> tuple[DataFrame, list[int], list[int]]:
    """The interval index of a table of boxes: `_at`, `_runs`; and the projections found by cell and by band. Boxes within `width`
    pixels of a cell are listed with the square of their distance on the projections found by cell."""
    keys = list(keys)
    banded = [d for d in range(len(sizes)) if d not in keys] or [keys.pop()]
    reached = lambda c: _band(c, band)
    reach = [math.floor(width / s) for s in sizes]
    far, t = F.lit(0.0), boxes
    for d in keys:
        t = t.withColumn(f"_k{d}", F.explode(F.sequence(F.col(f"lo{d}") - reach[d], F.col(f"lo{d}") + reach[d])))
        far = far + F.pow((F.col(f"_k{d}") - F.col(f"lo{d}")) * F.lit(float(sizes[d])), F.lit(2.0))
    t = t.withColumn("far", far).where(F.col("far") <= F.lit(float(width) ** 2))
    for d in banded:
        t = t.withColumn(f"_k{d}", F.explode(F.sequence(reached(F.col(f"lo{d}") - reach[d]), reached(F.col(f"hi{d}") + reach[d]))))
    at = F.struct(*[F.col(f"_k{d}") for d in range(len(sizes))])
    ends = [F.col(f"{e}{d}") for d in banded for e in ("lo", "hi")]
    return t.groupBy(at.alias("_at")).agg(F.collect_list(F.struct(*ends, "far")).alias("_runs")), keys, banded


def _band(c: Column, band: int) -> Column:
    return F.floor(c / F.lit(band)).cast("long")


def entries(boxes: Sequence[Box], sizes: Sequence[float], keys: Sequence[int], band: int, width: float) -> int:
    """The most entries that the index of some boxes has."""
    reach = [math.floor(width / s) for s in sizes]
    per = 0
    for b in boxes:
        n = 1
        for d, (lo, hi) in enumerate(b):
            n *= 2 * reach[d] + 1 if d in keys else (hi - lo + 2 * reach[d]) // band + 2
        per += n
    return per


def nearest(df: DataFrame, cells: Sequence[str], boxes: Sequence[Box] | DataFrame, sizes: Sequence[float], width: float, name: str) -> DataFrame:
    """Adds the distance in pixels from a row's cell to the nearest box, NULL where none lies within the width."""
    if isinstance(boxes, DataFrame):
        names, keys = boxes.columns, list(range(len(boxes.columns)))
        classes = {STEP: boxes.select(*[F.col(f"`{c}`").cast("long").alias(f"{e}{d}") for d, c in enumerate(names) for e in ("lo", "hi")]).dropna().distinct()}
    else:
        keys, classes = narrow(boxes), {}
        for b in boxes:
            classes.setdefault(band_of(b, keys), []).append(b)
    cell = lambda d: F.col(f"`{cells[d]}`")
    rows, least = df, []
    for band, own in sorted(classes.items()):
        small = not isinstance(own, DataFrame) and entries(own, sizes, keys, band, width) <= BROADCAST
        found, by_cell, banded = index(own if isinstance(own, DataFrame) else box_table(df, own), sizes, keys, band, width)
        at, runs = f"{name}_at", f"{name}_runs{band}"
        found = found.select(F.col("_at").alias(at), F.col("_runs").alias(runs))
        rows = rows.withColumn(at, F.struct(*[(cell(d) if d in by_cell else _band(cell(d), band)).cast("long").alias(f"_k{d}") for d in range(len(cells))]))
        rows = (rows.join(F.broadcast(found), at, "left") if small else lookup(rows, found, at)).drop(at)

        least.append(F.array_min(F.transform(runs, _square(cell, sizes, banded))))
    nearest_ = F.least(*least) if len(least) > 1 else least[0]
    out = rows.withColumn(name, F.when(nearest_ <= F.lit(float(width) ** 2), F.sqrt(nearest_)))
    return out.drop(*[c for c in out.columns if c.startswith(f"{name}_runs")])


def _square(cell, sizes: Sequence[float], banded: Sequence[int]):
    """The squared distance from a row's cell to a listed run."""
    def of(r: Column) -> Column:
        out = r["far"]
        for d in banded:
            out = out + F.pow(F.greatest(r[f"lo{d}"] - cell(d), cell(d) - r[f"hi{d}"], F.lit(0)) * F.lit(float(sizes[d])), F.lit(2.0))
        return out
    return of


class _Joins:
    """Contributions that a filter's columns refer to, joined one after the other."""

    def __init__(self, df: DataFrame, width: float | None = None):
        self.df, self.width, self.own, self.n = df, width, df.columns, 0

    def distance(self, c: Contribution, at, boxes) -> str:
        name, self.n = f"_near{self.n}", self.n + 1
        cells = []
        for d, (i, _) in enumerate(c.producer.projections):
            cells.append(f"{name}_c{d}")
            self.df = self.df.withColumn(cells[-1], at[i].cell())
        sizes = [c.producer.grid(i).size for i, _ in c.producer.projections]
        self.df = nearest(self.df, cells, boxes, sizes, self.width or 0.0, name).drop(*cells)
        return name

    def large(self, c: Contribution) -> Sequence[Box] | DataFrame | None:
        if c.cells is not None:
            return c.cells
        boxes = cell_boxes(c) if len(c.boxes) + len(c.tuples) > FEW or c.boxes else None
        return boxes

    def holds(self, c: Contribution, at) -> Column:
        boxes = self.large(c)
        return contribution_holds(c, at) if boxes is None else F.col(self.distance(c, at, boxes)).isNotNull()

    def degree(self, c: Contribution, at, width: float) -> Column:
        boxes = self.large(c)
        return contribution_degree(c, at, width) if boxes is None else F.coalesce(soft.falling(F.col(self.distance(c, at, boxes)), width), F.lit(0.0))


def holds(df: DataFrame, f: Filter, view: str, selections: Selections, mappings: Mappings | None = None, name: str = "holds") -> DataFrame:
    """Adds whether a row is selected, never NULL."""
    joins = _Joins(df)
    test = predicate(f, view, selections, mappings, joins.holds)
    return joins.df.select(*[F.col(f"`{c}`") for c in joins.own], test.alias(name))


def fades(df: DataFrame, f: Filter, view: str, selections: Selections, width: float, mappings: Mappings | None = None,
          name: str = "degree") -> DataFrame:
    """Adds a row's degree: 1 where it is selected, falling to 0 at `width` pixels."""
    joins = _Joins(df, width)
    value = degree(f, view, selections, width, mappings, joins.degree)
    return joins.df.select(*[F.col(f"`{c}`") for c in joins.own], value.alias(name))


def kept(df: DataFrame, f: Filter, view: str, selections: Selections, mappings: Mappings | None = None) -> DataFrame:
    """The selected rows. The bounding boxes that they must lie in are tested first, as ranges that reach the scan."""
    out = holds(df.where(extent(f, view, selections, mappings)), f, view, selections, mappings, "_holds")
    return out.where("_holds").drop("_holds")


def extent(f: Filter, view: str, selections: Selections, mappings: Mappings | None = None) -> Column:
    """A test that every selected row passes, made of ranges alone."""
    if isinstance(f, All):
        return all_of([extent(x, view, selections, mappings) for x in f.of])
    if not isinstance(f, Use):
        return F.lit(True)
    status, used = _used(f, view, selections)
    if status != "active" or selections.resolutions[f.selection] != "intersect":
        return F.lit(True)
    parts = []
    for c in used:
        boxes = None if c.cells is not None else cell_boxes(c)
        at = axes(c.producer, mappings)
        parts.append(lasso.bounding([at[i] for i, _ in c.producer.projections], boxes) if boxes else F.lit(True))
    return all_of(parts)
