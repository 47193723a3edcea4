"""Producers, named selections and how a view's filter resolves to a Column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import degree as soft
from . import lasso
from .lasso import Axis, Box
from .pixels import PixelGrid
from .values import OneOf, Range, Tuple, all_of, any_of, canonical, tuple_holds, unique

# Functions whose result is drawn or depends on the session, beside those that Spark marks itself.
VOLATILE = ("randstr", "uniform", "now", "current_timestamp", "current_date", "localtimestamp", "current_user", "current_catalog", "current_database")
GROUPED = ("agg_funcs", "window_funcs", "generator_funcs")


def row_local(expr: str) -> str:
    """A SQL expression that a filter can hold: each row's value follows from that row alone. Spark's own parser and function
    registry are asked, so aggregates, windows, generators, subqueries and drawn values are refused, whatever their names."""
    if SparkSession.getActiveSession() is None:
        return expr  # checked in `axes`, where it is used
    reason = _not_row_local(expr)
    if reason:
        raise ValueError(f"{expr!r} is not row-local ({reason})")
    return expr


@lru_cache(maxsize=4096)
def _not_row_local(expr: str) -> str:
    spark = SparkSession.getActiveSession()
    state, jvm = spark._jsparkSession.sessionState(), spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    drawn = loader.loadClass("org.apache.spark.sql.catalyst.expressions.Nondeterministic")
    folded = [loader.loadClass(f"org.apache.spark.sql.catalyst.expressions.aggregate.{c}") for c in ("AggregateFunction", "AggregateExpression")]
    todo = [state.sqlParser().parseExpression(expr)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if "Window" in kind:
            return "a window"
        if "Subquery" in kind or kind in ("ListQuery", "Exists"):
            return "a subquery"
        if any(c.isAssignableFrom(node.getClass()) for c in folded):
            return "an aggregate"
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".")
            info = state.catalog().lookupFunctionInfo(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
            if info.getGroup() in GROUPED or name.lower() in VOLATILE or drawn.isAssignableFrom(loader.loadClass(info.getClassName())):
                return name
        below = node.children()
        todo += [below.apply(i) for i in range(below.length())]
    return ""


@dataclass(frozen=True)
class Producer:
    """A view's contribution to a named selection: projections are SQL
    expressions over the view's rows, some measured on a pixel grid."""

    selection: str
    view: str
    name: str
    projections: tuple[tuple[str, str], ...]
    grids: tuple[tuple[str, PixelGrid], ...] = ()

    def __post_init__(self):
        for _, e in self.projections:
            row_local(e)
        ids = [i for i, _ in self.projections]
        if len(set(ids)) != len(ids) or not ids:
            raise ValueError("a producer needs projections with distinct names")
        if any(i not in ids for i, _ in self.grids):
            raise ValueError("a pixel grid names no projection")

    @property
    def address(self) -> tuple[str, str, str]:
        return (self.selection, self.view, self.name)

    def grid(self, projection: str) -> PixelGrid | None:
        return dict(self.grids).get(projection)


def producer(selection: str, view: str, name: str, projections: Mapping[str, str],
             grids: Mapping[str, PixelGrid] | None = None) -> Producer:
    return Producer(selection, view, name, tuple(projections.items()), tuple((grids or {}).items()))


@dataclass(frozen=True)
class Contribution:
    producer: Producer
    tuples: tuple[Tuple, ...]
    partial: Mapping[object, float] = field(default_factory=dict)
    boxes: tuple[Box, ...] = ()  # cells given as boxes, such as a lasso's runs, in the order of the projections
    cells: DataFrame | None = field(default=None, compare=False)  # cells given as a table, one column a projection

    @property
    def effective(self) -> list[Tuple]:
        """What rows are tested against: ranges on gridded projections as cells."""
        out = []
        for t in self.tuples:
            row = {}
            for p, test in t.items():
                g = self.producer.grid(p)
                if g is not None and not isinstance(test, Range):
                    raise ValueError("projections on a pixel grid take ranges")
                row[p] = test if g is None else g.snap(test)
            out.append(row)
        return out


@dataclass(frozen=True)
class Selections:
    """Named selections and their active contributions. Every update gives a
    new value; an update log too large for the driver is `log.active_tuples`."""

    resolutions: Mapping[str, str]
    active: Mapping[tuple[str, str, str], Contribution] = field(default_factory=dict)

    def __post_init__(self):
        for name, r in self.resolutions.items():
            if r not in ("intersect", "union", "global"):
                raise ValueError(f"{name}: resolution is intersect, union or global")

    def of(self, selection: str) -> dict[tuple[str, str, str], Contribution]:
        if selection not in self.resolutions:
            raise KeyError(f"no selection named {selection!r}")
        return {a: c for a, c in sorted(self.active.items()) if a[0] == selection}

    def _with(self, selection: str, own: Mapping) -> "Selections":
        rest = {a: c for a, c in self.active.items() if a[0] != selection}
        return replace(self, active={**rest, **own})

    def set(self, p: Producer, tuples: Iterable[Tuple], partial: Mapping[object, float] | None = None) -> "Selections":
        """Replace a contribution; in a global selection, every contribution.
        No tuples stay active, and select nothing."""
        own = {} if self.resolutions.get(p.selection) == "global" else self.of(p.selection)
        self.of(p.selection)
        tuples = unique([_checked(p, t) for t in tuples])
        return self._with(p.selection, {**own, p.address: Contribution(p, tuple(tuples), partial or {})})

    def set_boxes(self, p: Producer, boxes: Iterable[Box]) -> "Selections":
        """Replace a contribution by boxes of cells, however many; every projection has a pixel grid."""
        own = self.set(p, [])
        _gridded(p)
        return self._with(p.selection, {**own.of(p.selection), p.address: Contribution(p, (), boxes=tuple(boxes))})

    def set_cells(self, p: Producer, cells: DataFrame) -> "Selections":
        """Replace a contribution by a table of cells, one column a projection in its order, such as the voxels of a
        CloudLasso. Applied as a join: `steps.holds`, `steps.kept` and `steps.fades`."""
        own = self.set(p, [])
        _gridded(p)
        if len(cells.columns) != len(p.projections):
            raise ValueError(f"a cell of {p.name} has {len(p.projections)} indices")
        return self._with(p.selection, {**own.of(p.selection), p.address: Contribution(p, (), cells=cells)})

    def toggle(self, p: Producer, tuples: Iterable[Tuple]) -> "Selections":
        """Whole tuples leave where they are present and join where not. The
        last tuple to leave takes its contribution with it."""
        own = self.of(p.selection)
        if p.address in own and own[p.address].producer != p:
            raise ValueError("replace a contribution before toggling with a changed definition")
        for t in unique([_checked(p, t) for t in tuples]):
            places = list(own) if self.resolutions[p.selection] == "global" else [p.address]
            gone = False
            for a in places:
                if a not in own:
                    continue
                left = tuple(o for o in own[a].tuples if canonical(o) != canonical(t))
                if len(left) < len(own[a].tuples):
                    gone = True
                    own = {k: c for k, c in own.items() if k != a} if not left else {**own, a: Contribution(own[a].producer, left)}
            if not gone:
                had = own[p.address].tuples if p.address in own else ()
                own = {**own, p.address: Contribution(p, (*had, t))}
        return self._with(p.selection, own)

    def clear(self, p: Producer) -> "Selections":
        return self._with(p.selection, {a: c for a, c in self.of(p.selection).items() if a != p.address})

    def clear_all(self, selection: str) -> "Selections":
        self.of(selection)
        return self._with(selection, {})


def _gridded(p: Producer) -> None:
    for i, _ in p.projections:
        if p.grid(i) is None:
            raise ValueError(f"{i} needs a pixel grid in the producer's definition")


def _checked(p: Producer, t: Tuple) -> Tuple:
    ids = [i for i, _ in p.projections]
    if set(t) != set(ids):
        raise ValueError(f"a tuple of {p.name} tests {', '.join(ids)}")
    return {i: t[i] for i in ids}


# -- filters -----------------------------------------------------------------------


@dataclass(frozen=True)
class Use:
    """One named selection. A cross-filter leaves out the view's own producers;
    `empty` says what an inactive selection matches."""

    selection: str
    cross: bool = True
    empty: str = "all"


@dataclass(frozen=True)
class All:
    of: tuple


@dataclass(frozen=True)
class Any:
    of: tuple


@dataclass(frozen=True)
class Not:
    of: object


Filter = Use | All | Any | Not
Mappings = Mapping[tuple[tuple[str, str, str], str], str]


def cross_filter(*names: str) -> All:
    return All(tuple(Use(n) for n in names))


def membership(name: str, empty: str = "all") -> Use:
    return Use(name, cross=False, empty=empty)


def axes(p: Producer, mappings: Mappings | None = None) -> dict[str, Axis]:
    """The producer's projections over a view's rows: its own expressions, or
    those the view maps them to, with their grids."""
    mappings = mappings or {}
    return {name: Axis(F.expr(row_local(mappings.get((p.address, name), expr))), p.grid(name)) for name, expr in p.projections}


def columns(p: Producer, mappings: Mappings | None = None) -> dict[str, Column]:
    """The same as columns: cells where a grid is configured."""
    return {name: a.cell() for name, a in axes(p, mappings).items()}


def contribution_holds(c: Contribution, at: Mapping[str, Axis]) -> Column:
    tuples, ids = c.effective, [i for i, _ in c.producer.projections]
    if c.cells is not None or c.boxes:
        found = None if c.cells is not None else lasso.in_boxes([at[i] for i in ids], c.boxes)
        if found is None:
            raise ValueError(f"{c.producer.name} selects more cells than an expression holds: use the functions of `steps`")
        return found
    if len(tuples) >= lasso.MIN_TUPLES and all(c.producer.grid(i) is not None for i in ids):
        boxes = [lasso.box_of([t[i] for i in ids]) for t in tuples]
        if all(b is not None for b in boxes):
            found = lasso.in_boxes([at[i] for i in ids], boxes)
            if found is not None:
                return found
    tested = []
    for t in tuples:
        parts = []
        for i, test in t.items():
            if c.producer.grid(i) is None:
                parts.append(tuple_holds({i: test}, {i: at[i].column}))
            else:
                ((lo, hi),) = lasso.box_of([test])
                parts.append(at[i].between(lo, hi))
        tested.append(all_of(parts))
    return any_of(tested) if tested else F.lit(False)


def _used(f: Use, view: str, selections: Selections) -> tuple[str, list[Contribution]]:
    """inactive, excluded (only the view's own producers are active) or active."""
    every = selections.of(f.selection)
    kept = [c for a, c in every.items() if not (f.cross and a[1] == view)]
    return ("inactive" if not every else "excluded" if not kept else "active"), kept


def predicate(f: Filter, view: str, selections: Selections, mappings: Mappings | None = None, leaf=None) -> Column:
    """The filter of one view as a Boolean column that is never NULL. Every
    branch is resolved, so a missing name is an error wherever it stands.
    `leaf` tests one contribution, by default `contribution_holds`."""
    leaf = leaf or contribution_holds
    if isinstance(f, All):
        return all_of([predicate(x, view, selections, mappings, leaf) for x in f.of])
    if isinstance(f, Any):
        return any_of([predicate(x, view, selections, mappings, leaf) for x in f.of])
    if isinstance(f, Not):
        return ~predicate(f.of, view, selections, mappings, leaf)
    status, kept = _used(f, view, selections)
    if status == "inactive":
        return F.lit(f.empty == "all")
    if status == "excluded":
        return F.lit(True)
    parts = [leaf(c, axes(c.producer, mappings)) for c in kept]
    return all_of(parts) if selections.resolutions[f.selection] == "intersect" else any_of(parts)


def degree(f: Filter, view: str, selections: Selections, width: float, mappings: Mappings | None = None, leaf=None) -> Column:
    """A degree in [0, 1]: 1 where the predicate holds, falling to 0 at `width`
    pixels. AND takes the least, OR the greatest, NOT the complement. `leaf`
    gives the degree of one contribution, by default `contribution_degree`."""
    soft.check_width(width)
    leaf = leaf or contribution_degree
    if isinstance(f, All):
        return soft.fold([degree(x, view, selections, width, mappings, leaf) for x in f.of], least=True)
    if isinstance(f, Any):
        return soft.fold([degree(x, view, selections, width, mappings, leaf) for x in f.of], least=False)
    if isinstance(f, Not):
        return F.lit(1.0) - degree(f.of, view, selections, width, mappings, leaf)
    status, kept = _used(f, view, selections)
    if status == "inactive":
        return F.lit(1.0 if f.empty == "all" else 0.0)
    if status == "excluded":
        return F.lit(1.0)
    parts = [leaf(c, axes(c.producer, mappings), width) for c in kept]
    return soft.fold(parts, selections.resolutions[f.selection] == "intersect")


def contribution_degree(c: Contribution, at: Mapping[str, Axis], width: float) -> Column:
    ids = [i for i, _ in c.producer.projections]
    if c.cells is not None or c.boxes:
        raise ValueError(f"{c.producer.name} selects cells: use `steps.fades`")
    tuples = c.effective
    if not any(isinstance(test, Range) for t in tuples for test in t.values()):
        rest = F.lit(0.0)
        if c.partial:
            key = at[ids[0]].column
            arms = F
            for v, d in c.partial.items():
                arms = arms.when(key == F.lit(v), F.lit(float(d)))
            rest = arms.otherwise(0.0)
        return F.when(contribution_holds(c, at), F.lit(1.0)).otherwise(rest)
    if c.partial:
        raise ValueError("partial degrees go with keys, not with ranges")
    sizes = []
    for i in ids:
        if c.producer.grid(i) is None:
            raise ValueError(f"a degree needs a pixel grid on {i}: ranges are measured in pixels")
        sizes.append(c.producer.grid(i).size)
    boxes = [lasso.box_of([t[i] for i in ids]) for t in tuples]
    if any(b is None for b in boxes):
        raise ValueError("a degree over pixel grids needs ranges on every projection")
    return soft.box_degree([at[i] for i in ids], sizes, boxes, width)


def key_set(p: Producer, keys: Sequence) -> list[Tuple]:
    """A set of keys as one tuple of a producer with one projection."""
    (name, _), = p.projections
    return [{name: OneOf(tuple(keys))}]
