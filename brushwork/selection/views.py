"""All views of a dashboard from one scan of their rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.ordered import once
from . import steps
from .model import Filter, Mappings, Selections, predicate
from .values import any_of


def histograms(df: DataFrame, views: Mapping[str, tuple[str, float, float]], f: Filter, selections: Selections,
               mappings: Mappings | None = None) -> DataFrame:
    """Each view's histogram under the filter as that view sees it, as `view, bin, n`: of a cross-filter, under the brushes of the
    other views. `views` maps a name to (column, step, origin). Every contribution is tested once a row, into a bit that all views
    read, by a join where it is large. Rows outside the ranges of all views are left out first, by the scan where it can."""
    joins = steps._Joins(df.where(any_of([steps.extent(f, view, selections, mappings) for view in views])))
    bits: dict[tuple[str, str, str], tuple[str, Column]] = {}

    def bit(c, at):
        if c.producer.address not in bits:
            bits[c.producer.address] = (f"_bit{len(bits)}", joins.holds(c, at))
        return F.col(bits[c.producer.address][0])

    under = {view: predicate(f, view, selections, mappings, bit) for view in views}
    rows = once(joins.df, **dict(bits.values())) if bits else joins.df
    return grid.histograms(rows, views, under)
