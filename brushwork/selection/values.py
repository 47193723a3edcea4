"""Value tests and tuples of them: what a selection holds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Equal:
    value: object


@dataclass(frozen=True)
class OneOf:
    values: tuple


@dataclass(frozen=True)
class Range:
    """None leaves an end open; `lo_in` and `hi_in` say whether an end belongs."""

    lo: object = None
    hi: object = None
    lo_in: bool = True
    hi_in: bool = False


Test = Equal | OneOf | Range
Tuple = Mapping[str, Test]


def equal(value) -> Equal:
    return Equal(_plain(value))


def one_of(values: Iterable) -> OneOf:
    """A set: without duplicates, in one order, so that equal sets are equal."""
    plain = [_plain(v) for v in values]
    return OneOf(tuple(sorted(dict.fromkeys(plain), key=_order)))


def range_(lo=None, hi=None, closed: str = "left") -> Range:
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError("closed is left, right, both or neither")
    for end in (lo, hi):
        if isinstance(end, float) and math.isnan(end):
            raise ValueError("a range end is not NaN")
    if lo is not None and hi is not None and hi < lo:
        raise ValueError(f"range {lo}..{hi} is not ordered")
    return Range(_plain(lo), _plain(hi), closed in ("left", "both"), closed in ("right", "both"))


def _plain(v):
    if isinstance(v, (list, dict, set)):
        raise ValueError("nested values are outside selections")
    return 0.0 if isinstance(v, float) and v == 0 else v  # one zero


def _order(v):
    if isinstance(v, float) and math.isnan(v):
        return (2, "", 0)
    return (0, "", 0) if v is None else (1, type(v).__name__, v)


def canonical(t: Tuple) -> tuple:
    """A hashable form of a tuple, to compare and toggle whole tuples."""
    return tuple(sorted(t.items(), key=lambda kv: kv[0]))


def unique(tuples: Sequence[Tuple]) -> list[Tuple]:
    return list({repr(canonical(t)): t for t in tuples}.values())


def _fold(cols: Iterable[Column], both: bool) -> Column:
    cols = list(cols)
    if not cols:
        return F.lit(both)
    # A balanced tree: long chains of AND/OR would nest as deep as they are long.
    while len(cols) > 1:
        pairs = [cols[i : i + 2] for i in range(0, len(cols), 2)]
        cols = [p[0] if len(p) == 1 else (p[0] & p[1] if both else p[0] | p[1]) for p in pairs]
    return cols[0]


def all_of(cols: Iterable[Column]) -> Column:
    return _fold(cols, True)


def any_of(cols: Iterable[Column]) -> Column:
    return _fold(cols, False)


def holds(c: Column, test: Test, floating: bool = True) -> Column:
    """The test as a predicate that is never NULL. Equality is null-safe, with
    one zero and one NaN; a range leaves out NULL and non-finite rows even when
    it has no ends. Ranges keep plain comparisons of the bare column, which
    file statistics can prune."""
    if isinstance(test, Equal):
        return c.eqNullSafe(F.lit(test.value))
    if isinstance(test, OneOf):
        known = [v for v in test.values if v is not None]
        parts = [F.coalesce(c.isin(known), F.lit(False))] if known else []
        if len(known) < len(test.values):
            parts.append(c.isNull())
        return any_of(parts)
    parts = []
    if test.lo is not None:
        parts.append(c >= F.lit(test.lo) if test.lo_in else c > F.lit(test.lo))
    if test.hi is not None:
        parts.append(c <= F.lit(test.hi) if test.hi_in else c < F.lit(test.hi))
    if floating:
        # NaN sorts above every number in Spark, so a finite upper end excludes
        # it already; the bounds on both sides exclude the infinities.
        if not isinstance(test.hi, (int, float)) or isinstance(test.hi, bool) or test.hi == INF:
            parts.append(c < F.lit(INF))
        if not isinstance(test.lo, (int, float)) or isinstance(test.lo, bool) or test.lo == -INF:
            parts.append(c > F.lit(-INF))
    return all_of([*parts, c.isNotNull()])


def tuple_holds(t: Tuple, columns: Mapping[str, Column]) -> Column:
    return all_of(holds(columns[k], test, _number(test)) for k, test in t.items())


def _number(test: Test) -> bool:
    """Whether a test is over numbers: dates and texts have no infinities."""
    if isinstance(test, Range):
        ends = [e for e in (test.lo, test.hi) if e is not None]
        return all(isinstance(e, (int, float)) for e in ends)
    return True


def tuples_hold(tuples: Sequence[Tuple], columns: Mapping[str, Column]) -> Column:
    """Terms AND inside a tuple, tuples OR: correlated pairs stay correlated.
    No tuples select no rows."""
    return any_of([tuple_holds(t, columns) for t in tuples]) if tuples else F.lit(False)
