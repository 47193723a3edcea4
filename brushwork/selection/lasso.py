"""Lassos: polygons on the screen as runs of cells, tested on rows or joined."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pixels import PixelGrid
from .values import Range, all_of, any_of

MAX_ROWS = 1 << 20  # a polygon over more rows of cells is refused
MIN_TUPLES = 8  # fewer boxes stay an ordinary OR of ranges
FEW_BOXES = 64  # boxes without an index that an expression still tests one by one
DENSE_CELLS = 1 << 14  # the widest row table kept inside the expression
BROADCAST_BOXES = 1 << 17  # above this many boxes, the look-up is a shuffled join

Ring = Sequence[tuple[float, float]]
Box = tuple[tuple[int, int], ...]  # inclusive cell bounds per projection


def check_ring(ring: Ring) -> None:
    if len(ring) < 3 or not all(math.isfinite(c) for p in ring for c in p):
        raise ValueError("a polygon needs three or more finite points")


@dataclass(frozen=True)
class Edge:
    """A side of a ring, from its lower end; it belongs to heights low <= y < high, so sides that meet share none."""

    low: float
    high: float
    x: float
    slope: float

    def at(self, y: float) -> float:
        return self.x + (y - self.low) * self.slope


def edges(ring: Ring) -> list[Edge]:
    """The sides that rise or fall, by their lower end."""
    out = []
    for k, p in enumerate(ring):
        (x0, y0), (x1, y1) = sorted((p, ring[k - 1]), key=lambda v: v[1])
        if y0 < y1:
            out.append(Edge(y0, y1, x0, (x1 - x0) / (y1 - y0)))
    return sorted(out, key=lambda e: e.low)


def inner_cells(g: PixelGrid, lo: float, hi: float) -> tuple[int, int]:
    """The first and last cell of a grid whose centres lie strictly between two values; none if the first is greater."""
    first, last = math.floor((lo - g.origin) / g.size + 0.5), math.ceil((hi - g.origin) / g.size - 1.5)
    reach = g.reach()
    return (first, last) if reach is None else (max(first, reach[0]), min(last, reach[1]))


def runs(ring: Ring, gu: PixelGrid, gv: PixelGrid) -> list[Box]:
    """The cells whose centre lies inside the ring (even-odd), as one box per run of cells in a row: ((c0, c1), (row, row)).

    A sweep over rows of cells: sides enter the list as the sweep reaches them and leave behind it, and the centres between
    an odd and the next even of them are inside."""
    check_ring(ring)
    if any(g.scale != "linear" or g.range_offset for g in (gu, gv)):
        raise ValueError("a lasso is drawn on two linear grids, neither shifted")
    heights = [y for _, y in ring]
    first, last = inner_cells(gv, min(heights), max(heights))
    if last - first >= MAX_ROWS:
        raise ValueError(f"the lasso spans {last - first + 1} rows of cells, more than {MAX_ROWS}")
    waiting, live, out = edges(ring), [], []
    for row in range(first, last + 1):
        y = gv.centre(row)
        entering = [e for e in waiting[:next((i for i, e in enumerate(waiting) if e.low > y), len(waiting))]]
        waiting = waiting[len(entering):]
        live = [e for e in (*live, *entering) if e.high > y]
        met = sorted(e.at(y) for e in live)
        for lo, hi in zip(met[0::2], met[1::2]):
            c0, c1 = inner_cells(gu, lo, hi)
            if c0 <= c1:
                out.append(((c0, c1), (row, row)))
    return out


def box_of(tests: Sequence[Range]) -> Box | None:
    """Inclusive bounds of a tuple of cell ranges; None if a term is no such range."""
    out = []
    for t in tests:
        if not isinstance(t, Range) or not all(isinstance(e, int) or e is None for e in (t.lo, t.hi)):
            return None
        lo = -(2**63) if t.lo is None else t.lo + (not t.lo_in)
        hi = 2**63 - 1 if t.hi is None else t.hi - (not t.hi_in)
        out.append((lo, hi))
    return tuple(out)


@dataclass(frozen=True)
class Axis:
    """One projection of a row: a value on a grid, or a cell stored earlier."""

    column: Column
    grid: PixelGrid | None = None

    def cell(self) -> Column:
        return self.column if self.grid is None else self.grid.cell(self.column)

    def index(self) -> Column:
        """The cell of a row that is known to have one."""
        return self.column if self.grid is None else self.grid.index(self.column)

    def between(self, c0: int, c1: int) -> Column:
        if self.grid is not None:
            return self.grid.between(self.column, c0, c1)
        return (self.column >= F.lit(c0)) & (self.column <= F.lit(c1)) & self.column.isNotNull()

    def ends(self, c0: int, c1: int) -> tuple[float, float] | None:
        """What the column itself lies between when its cell is in c0..c1."""
        return (c0, c1) if self.grid is None else self.grid.preimage(c0, c1)


def _table(values: Sequence[float], kind: str) -> Column:
    """An array literal; Spark folds it to one constant."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def in_boxes(axes: Sequence[Axis], boxes: Sequence[Box]) -> Column | None:
    """Whether a row's cells lie in a box, never NULL. Where all boxes are one
    cell high on some projection, as a lasso's are, the row's cell there indexes
    constant tables of run ends, so a row costs a look-up per run in its row of
    cells, not a test per box. The bounding box comes first, as ranges on the
    columns, which the scan can prune by. None where the boxes are too many
    for an expression: use `match_boxes`."""
    if not boxes:
        return F.lit(False)
    key = next((d for d in range(len(axes)) if all(b[d][0] == b[d][1] for b in boxes)), None)
    timed = any(a.grid is not None and a.grid.scale == "time" for a in axes)
    if len(boxes) >= MIN_TUPLES and key is not None and not timed:
        rows: dict[int, list[Box]] = {}
        for b in boxes:
            rows.setdefault(b[key][0], []).append(b)
        first, span = min(rows), max(rows) - min(rows) + 1
        depth = max(len(r) for r in rows.values())
        if span * depth <= DENSE_CELLS:
            at = (axes[key].index() - F.lit(first)).try_cast("int")
            rest = [d for d in range(len(axes)) if d != key]
            hits = []
            for k in range(depth):
                layer = [rows.get(first + i, []) for i in range(span)]
                terms = [F.get(_table([int(k < len(r)) for r in layer], "int"), at) == 1] if not rest else []
                for d in rest:
                    kind = "bigint" if axes[d].grid is None else "double"
                    ends = [axes[d].ends(*r[k][d]) if k < len(r) else None for r in layer]
                    lo, hi = zip(*[e or (1, 0) for e in ends])
                    terms += [axes[d].column >= F.get(_table(lo, kind), at), axes[d].column <= F.get(_table(hi, kind), at)]
                hits.append(all_of(terms))
            # Inside the bounding box every look-up finds its entry, so nothing is NULL.
            return bounding(axes, boxes) & any_of(hits)
    if len(boxes) <= FEW_BOXES:
        each = [all_of([a.between(lo, hi) for a, (lo, hi) in zip(axes, b)]) for b in boxes]
        return any_of(each)
    return None


def bounding(axes: Sequence[Axis], boxes: Sequence[Box]) -> Column:
    """The range of each axis that holds all boxes."""
    return all_of([a.between(lo, hi) for a, (lo, hi) in zip(axes, hull(boxes))])


def match_boxes(df: DataFrame, cells: Sequence[str], boxes: Sequence[Box], name: str = "in_boxes") -> DataFrame:
    """Adds whether a row's cells lie in one of many boxes, by a join on the
    projection where boxes are one cell wide. All boxes of a cell travel as one
    array, so no row is repeated. The box table is broadcast while it is small
    and shuffled beyond that."""
    spark = df.sparkSession
    key = next((d for d in range(len(cells)) if all(b[d][0] == b[d][1] for b in boxes)), None)
    if key is None:
        raise ValueError("boxes to join need a projection on which each is one cell wide")
    rest = [d for d in range(len(cells)) if d != key]
    schema = "_k long, " + ", ".join(f"lo{d} long, hi{d} long" for d in rest) if rest else "_k long"
    rows = [(b[key][0], *[e for d in rest for e in b[d]]) for b in boxes]
    ends = [c for d in rest for c in (f"lo{d}", f"hi{d}")]
    table = spark.createDataFrame(rows, schema).groupBy("_k").agg(
        F.collect_list(F.struct(*ends) if ends else F.lit(True)).alias("_runs"))
    if len(boxes) <= BROADCAST_BOXES:
        joined = df.join(F.broadcast(table), df[cells[key]] == table["_k"], "left")
    else:
        from ..operators.ordered import lookup

        joined = lookup(df.withColumn("_k", F.col(cells[key])), table, "_k")
    if rest:
        def inside(r):
            return all_of([(F.col(cells[d]) >= r[f"lo{d}"]) & (F.col(cells[d]) <= r[f"hi{d}"]) for d in rest])

        hit = F.exists("_runs", inside)
    else:
        hit = F.col("_runs").isNotNull()
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_k", "_runs")


def hull(boxes: Sequence[Box]) -> Box:
    return tuple((min(b[d][0] for b in boxes), max(b[d][1] for b in boxes)) for d in range(len(boxes[0])))


def in_ring(u: Column, v: Column, ring: Ring) -> Column:
    """The exact even-odd test on points: an odd number of edges to the right.
    Points outside the ring's extent are dismissed first."""
    check_ring(ring)
    count = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        if ay == by:
            continue
        spans = (F.lit(float(ay)) > v) != (F.lit(float(by)) > v)
        x = F.lit(float(bx - ax)) * (v - F.lit(float(ay))) / F.lit(float(by - ay)) + F.lit(float(ax))
        count = count + F.when(spans & (u < x), 1).otherwise(0)
    us, vs = [p[0] for p in ring], [p[1] for p in ring]
    near = (u >= float(min(us))) & (u <= float(max(us))) & (v >= float(min(vs))) & (v <= float(max(vs)))
    return F.coalesce(near & (count % 2 == 1), F.lit(False))


def cell_table(spark: SparkSession, names: Sequence[str], cells: Sequence[Sequence[int]]) -> DataFrame:
    return spark.createDataFrame([tuple(int(c) for c in cell) for cell in cells], ", ".join(f"{n} long" for n in names))
