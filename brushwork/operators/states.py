"""Aggregate states that merge: stored once per fine group, rolled up later.

A measure is (op, field, alias). Its states are plain columns, so any grouped
table can be written, unioned with others and merged again at a coarser grain.
Variance keeps count, mean and M2 (sum of squared deviations from the mean).
Exact distinct counts (`transforms.aggregate`) cannot merge; `approx_distinct` keeps a HyperLogLog
sketch of 2^SKETCH_BITS registers, whose relative standard error is
1.04 / sqrt(2^SKETCH_BITS), 1.6 %, at whatever grain the states are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import same_key_join

SPREAD = ("var_samp", "var_pop", "stddev_samp", "stddev_pop")
OPS = ("rows", "valid", "missing", "sum", "min", "max", "mean", *SPREAD, "approx_distinct")
SKETCH_BITS = 12  # a state of at most some 4 kB, small groups less
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


@dataclass(frozen=True)
class Measure:
    op: str
    field: str | None
    alias: str

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown measure {self.op!r}; one of {', '.join(OPS)}")
        if self.field is None and self.op != "rows":
            raise ValueError(f"{self.op} needs a field")


def measures(specs: Iterable) -> list[Measure]:
    return [m if isinstance(m, Measure) else Measure(*m) for m in specs]


def _needs(ms: Sequence[Measure]) -> dict[str, set[str]]:
    """The states each field has to keep."""
    parts = {"valid": {"n"}, "missing": {"n"}, "sum": {"s"}, "min": {"lo"}, "max": {"hi"},
             "mean": {"n", "s"}, "approx_distinct": {"hll"}, **{op: {"n", "avg", "m2"} for op in SPREAD}}
    out: dict[str, set[str]] = {}
    for m in ms:
        if m.field is not None:
            out.setdefault(m.field, set()).update(parts[m.op])
    return out


def _sketch(c: Column) -> Column:
    """Distinct values of any type, by their hash; NULL is no value, and both zeros are one."""
    return F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(SKETCH_BITS))


def state_columns(specs: Iterable) -> list[Column]:
    """Aggregates that build the states from rows."""
    out = [F.count(F.lit(1)).alias("rows__")]
    for f, need in _needs(measures(specs)).items():
        c = F.col(f)
        build = {
            "n": F.count(c), "s": F.sum(c), "lo": F.min(c), "hi": F.max(c), "avg": F.avg(c),
        }
        if "m2" in need:
            build["m2"] = F.var_pop(c) * F.count(c)
        if "hll" in need:
            build["hll"] = _sketch(c)
        out += [build[k].alias(f"{f}__{k}") for k in build if k in need]
    return out


def fold(df: DataFrame, groups: Sequence[str], specs: Iterable) -> DataFrame:
    """Rows to states, one row per group."""
    return df.groupBy(*groups).agg(*state_columns(specs))


def merge(states: DataFrame, groups: Sequence[str], specs: Iterable) -> DataFrame:
    """States to finished measures at the same or a coarser grain."""
    ms = measures(specs)
    spread = [f for f, need in _needs(ms).items() if "m2" in need]
    if spread:
        # A centre per group keeps the merge of M2 to plain sums without the cancellation of raw squares, and
        # leaves a group with infinite or NaN values to itself.
        centres = [(F.sum(F.col(f"{f}__avg") * F.col(f"{f}__n")) / F.sum(f"{f}__n")).alias(f"{f}__c") for f in spread]
        states = same_key_join(states, states.groupBy(*groups).agg(*centres), list(groups)) if groups else \
            states.crossJoin(F.broadcast(states.agg(*centres)))  # one row
    aggs = [F.sum("rows__").alias("rows__")]
    for f, need in _needs(ms).items():
        n, m = F.col(f"{f}__n"), lambda s, f=f: F.col(f"{f}__{s}")
        if "n" in need:
            aggs.append(F.sum(n).alias(f"{f}__n"))
        if "s" in need:
            aggs.append(F.sum(m("s")).alias(f"{f}__s"))
        if "lo" in need:
            aggs.append(F.min(m("lo")).alias(f"{f}__lo"))
        if "hi" in need:
            aggs.append(F.max(m("hi")).alias(f"{f}__hi"))
        if "hll" in need:
            aggs.append(F.hll_union_agg(m("hll")).alias(f"{f}__hll"))
        if "m2" in need:
            off = m("avg") - m("c")
            aggs += [F.sum(n * off).alias(f"{f}__d"), F.sum(m("m2") + n * off * off).alias(f"{f}__q")]
    return states.groupBy(*groups).agg(*aggs).select(*groups, *[_finish(m) for m in ms])


def _finish(m: Measure) -> Column:
    s = lambda k: F.col(f"{m.field}__{k}")
    if m.op == "rows":
        out = F.col("rows__")
    elif m.op == "valid":
        out = s("n")
    elif m.op == "missing":
        out = F.col("rows__") - s("n")
    elif m.op in ("sum", "min", "max"):
        out = s({"sum": "s", "min": "lo", "max": "hi"}[m.op])
    elif m.op == "approx_distinct":
        out = F.coalesce(F.hll_sketch_estimate(s("hll")), F.lit(0).cast("long"))
    elif m.op == "mean":
        out = F.when(s("n") > 0, s("s") / s("n"))
    else:
        pop = m.op.endswith("_pop")
        m2 = F.greatest(s("q") - s("d") * s("d") / s("n"), F.lit(0.0))
        out = F.when(s("n") > (0 if pop else 1), m2 / (s("n") if pop else s("n") - 1))
        if m.op.startswith("stddev"):
            out = F.sqrt(out)
    return out.alias(m.alias)


def direct(df: DataFrame, groups: Sequence[str], specs: Iterable) -> DataFrame:
    """The measures straight from rows, in one aggregate."""
    fns = {"valid": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg,
           "var_samp": F.var_samp, "var_pop": F.var_pop,
           "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}
    cols = []
    for m in measures(specs):
        if m.op == "rows":
            c = F.count(F.lit(1))
        elif m.op == "missing":
            c = F.count_if(F.col(m.field).isNull())
        elif m.op == "approx_distinct":
            c = F.hll_sketch_estimate(_sketch(F.col(m.field)))
        else:
            c = fns[m.op](m.field)
        cols.append(c.alias(m.alias))
    return df.groupBy(*groups).agg(*cols)
