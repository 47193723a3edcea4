"""Chart transforms: filter, formula, bin, aggregate, stack, extents, layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import ordered, ranks

EPSILON = 1e-14  # keeps a value on a bin edge in the bin it opens


def typed_truthy(c: Column, dtype: T.DataType) -> Column:
    """JavaScript truthiness by type: null, 0, NaN and '' are false."""
    if isinstance(dtype, T.BooleanType):
        yes = c
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        yes = (c != 0) & ~F.isnan(c)
    elif isinstance(dtype, T.NumericType):
        yes = c != 0
    elif isinstance(dtype, T.StringType):
        yes = c != ""
    elif isinstance(dtype, T.NullType):
        return F.lit(False)
    else:
        yes = c.isNotNull()
    return F.coalesce(yes, F.lit(False))


def truthy(df: DataFrame, c: Column) -> Column:
    return typed_truthy(c, df.select(c.alias("_")).schema[0].dataType)


def where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Filter by a predicate of any type. A Boolean one stays as written, so
    that its comparisons reach the scan."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    dtype = df.select(p.alias("_")).schema[0].dataType
    return df.where(p if isinstance(dtype, T.BooleanType) else typed_truthy(p, dtype))


def calc(df: DataFrame, name: str, expr: Column | str) -> DataFrame:
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)


def clip(c: Column, lo: float, hi: float) -> Column:
    """A measure held within [lo, hi]; NULL stays NULL, NaN stays NaN."""
    return F.when(c < lo, F.lit(float(lo))).when((c > hi) & ~F.isnan(c), F.lit(float(hi))).otherwise(c)


def _not_a_number(c: Column) -> Column:
    """NaN, which only floating-point columns can hold; the type is known when the query is planned."""
    return F.typeof(c).isin("float", "double") & F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def compare(field: str, **tests) -> Column:
    """A structured predicate, such as compare("delay", gte=10, lt=30)."""
    ops = {"equal": lambda c, v: c == v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
           "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
           "range": lambda c, v: (c >= v[0]) & (c <= v[1]), "one_of": lambda c, v: c.isin(list(v)),
           "valid": lambda c, v: (c.isNotNull() & ~_not_a_number(c)) if v else (c.isNull() | _not_a_number(c))}
    out = None
    for op, value in tests.items():
        if op not in ops:
            raise ValueError(f"unknown predicate {op!r}")
        p = ops[op](F.col(field), value)
        out = p if out is None else out & p
    if out is None:
        raise ValueError("a predicate needs at least one test")
    return out


def held(c: Column, lo: float, hi: float) -> Column:
    """c within [lo, hi]. `greatest` and `least` skip NULLs, so NULL is kept apart."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def labels(code: Column, names: Mapping, other: str = "Other") -> Column:
    """A code to its label by a short, fixed list."""
    out = F
    for k, v in names.items():
        out = out.when(code == k, v)
    return out.otherwise(other)


def label_order(code: Column, names: Mapping) -> Column:
    out = F
    for i, k in enumerate(names):
        out = out.when(code == k, i)
    return out.otherwise(len(names))


# -- extents, domains, positions ------------------------------------------------


def extent(df: DataFrame, field: str, zero: bool = False) -> DataFrame:
    """One row `lo, hi`; a bar's domain includes 0."""
    lo, hi = F.min(field).cast("double"), F.max(field).cast("double")
    if zero:
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    return df.agg(lo.alias("lo"), hi.alias("hi"))


def quarters(df: DataFrame, x: str, y: str, region: str) -> DataFrame:
    """Zoom to a quarter of the extent: rows within the closed half of each axis."""
    if region not in ("north_east", "north_west", "south_east", "south_west"):
        raise ValueError(f"no region {region!r}")
    e = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    at = lambda f: e.getField(f)
    mx, my = (at("x0") + at("x1")) / 2, (at("y0") + at("y1")) / 2
    xs = F.col(x) >= mx if region.endswith("east") else F.col(x) <= mx
    ys = F.col(y) >= my if region.startswith("north") else F.col(y) <= my
    return df.where(xs & ys)


def zoom(df: DataFrame, field: str, lo: float, hi: float) -> DataFrame:
    """Rows of an ordered range; an unordered one, or one without data, is an error."""
    if not lo < hi:
        raise ValueError(f"zoom: range {lo}..{hi} is empty")
    span = extent(df, field).first()
    if span.lo is None or hi < span.lo or lo > span.hi:
        raise ValueError(f"zoom: {lo}..{hi} holds no data ({field} runs {span.lo}..{span.hi})")
    return df.where((F.col(field) >= lo) & (F.col(field) <= hi))


def nice_domain(lo: Column, hi: Column, steps: int = 6) -> Column:
    """A domain rounded out to 1, 2, 5 or 10 times a power of ten, at most
    `steps` steps, as struct(lo, hi, step)."""
    span = F.greatest(hi - lo, F.lit(1e-9))
    ten = F.pow(F.lit(10.0), F.floor(F.log10(span / 5)).cast("double"))
    step = F
    for m in (1.0, 2.0, 5.0, 10.0):
        step = step.when(span / (ten * m) <= steps, ten * m)
    step = step.otherwise(ten * 10)
    return F.struct((F.floor(lo / step) * step).alias("lo"), (F.ceil(hi / step) * step).alias("hi"), step.alias("step"))


def unit_linear(v: Column, lo: Column, hi: Column) -> Column:
    return (v - lo) / (hi - lo)


def log_domain(lo: Column, hi: Column) -> Column:
    """Powers of ten around a positive range, as struct(lo, hi)."""
    ten = lambda c, f: F.pow(F.lit(10.0), f(F.log10(F.greatest(c, F.lit(1.0)))).cast("double"))
    return F.struct(ten(lo, F.floor).alias("lo"), ten(hi, F.ceil).alias("hi"))


def unit_log(v: Column, lo: Column, hi: Column) -> Column:
    at = (F.log10(F.greatest(v, lo)) - F.log10(lo)) / (F.log10(hi) - F.log10(lo))
    return F.when(v.isNotNull(), held(at, 0.0, 1.0))


def log_tint(df: DataFrame, value: str, name: str = "tint", plus_one: bool = False) -> DataFrame:
    """ln(v) / ln(max), or ln(1 + v) / ln(1 + max): a colour position for counts."""
    f = F.log1p if plus_one else F.log
    top = df.agg(f(F.max(value))).scalar()
    return df.withColumn(name, held(f(F.col(value)) / top, 0.0, 1.0))


def robust_unit(df: DataFrame, value: str, name: str = "u") -> DataFrame:
    """Position between the values at ranks n/200 and 995 n/1000, within [0, 1.2]."""
    at = ranks.order_statistics(df, value, {
        "lo": lambda n: F.floor(n / 200), "hi": lambda n: F.floor(n * 995 / 1000)})
    e = at.select(F.struct("lo", "hi")).scalar()
    u = (F.col(value) - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo"))
    return df.withColumn("_e", e).withColumn(name, held(u, 0.0, 1.2)).drop("_e")


# -- bins ------------------------------------------------------------------------


def _bin_step(span: Column, maxbins: float, base: float, minstep: float, divide: Sequence[float]) -> Column:
    log_base = F.log(F.lit(float(base)))
    level = F.ceil(F.log(F.lit(float(maxbins))) / log_base)
    power = F.pow(F.lit(float(base)), (F.round(F.log(span) / log_base) - level).cast("double"))
    step = F.greatest(F.lit(float(minstep)), power)
    # span / power is below base^1.5 * maxbins, so two widenings always do.
    for _ in range(2):
        step = F.when(F.ceil(span / step) > maxbins, step * base).otherwise(step)
    for d in divide:
        finer = step / d
        step = F.when((finer >= minstep) & (span / finer <= maxbins), finer).otherwise(step)
    return step


def bin_params(df: DataFrame, field: str, maxbins: int = 20, step: float | None = None,
               steps: Sequence[float] | None = None, minstep: float = 0.0, base: float = 10.0,
               divide: Sequence[float] = (5, 2), nice: bool = True, anchor: float | None = None,
               extent: tuple[float, float] | None = None) -> DataFrame:
    """One row `start, stop, step`: nice bins over the field's extent or the one
    given. An extent of one value takes its magnitude, or 1, as span."""
    if maxbins < 1 or base <= 1 or minstep < 0 or any(d <= 1 for d in divide):
        raise ValueError("maxbins >= 1, base > 1, minstep >= 0 and divide > 1 are needed")
    if step is not None and step <= 0:
        raise ValueError("step must be positive")
    if steps is not None and (not steps or list(steps) != sorted(steps) or steps[0] <= 0):
        raise ValueError("steps must be positive and ascending")
    if extent is not None:
        if not extent[0] < extent[1]:
            raise ValueError("extent must be ordered")
        one = df.agg(F.lit(float(extent[0])).alias("lo"), F.lit(float(extent[1])).alias("hi"))
    else:
        finite = F.abs(F.col(field)) < F.lit(float("inf"))
        one = df.where(finite).agg(F.min(field).cast("double").alias("lo"), F.max(field).cast("double").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) \
        .when(F.col("lo") != 0, F.abs("lo")).otherwise(F.lit(1.0))
    one = one.withColumn("span", span)
    if step is not None:
        size = F.lit(float(step))
    elif steps is not None:
        size = F.lit(float(steps[0]))
        for s in steps[1:]:
            size = F.when(F.col("span") / maxbins >= s, F.lit(float(s))).otherwise(size)
    else:
        size = _bin_step(F.col("span"), maxbins, base, minstep, divide)
    one = one.withColumn("step", size)
    lo, hi, s = F.col("lo"), F.col("hi"), F.col("step")
    start, stop = (F.floor(lo / s) * s, F.ceil(hi / s) * s) if nice else (lo, hi)
    one = one.select(start.cast("double").alias("start"), stop.cast("double").alias("stop"), "step")
    one = one.withColumn("stop", F.when(F.col("stop") == F.col("start"), F.col("start") + F.col("step")).otherwise(F.col("stop")))
    if anchor is not None:
        a = F.lit(float(anchor))
        shift = a - (F.col("start") + F.col("step") * F.floor((a - F.col("start")) / F.col("step")))
        one = one.select((F.col("start") + shift).alias("start"), (F.col("stop") + shift).alias("stop"), "step")
    return one


def bin_rows(df: DataFrame, field: str, as_: tuple[str, str] = ("bin0", "bin1"), binned: bool = False, **options) -> DataFrame:
    """Add the bin's start and end per row. `binned` data carries its own bins:
    with a step the end is start + step, else both columns must be there."""
    start_name, end_name = as_
    if binned:
        step = options.get("step")
        if step is None:
            return df
        return df.withColumn(start_name, F.col(field)).withColumn(end_name, F.col(field) + F.lit(float(step)))
    p = bin_params(df, field, **options).select(F.struct("start", "stop", "step")).scalar()
    v = F.col(field).cast("double")
    start, stop, step = F.col("_b.start"), F.col("_b.stop"), F.col("_b.step")
    held = F.greatest(start, F.least(v, stop - step))
    at = start + step * F.floor(F.lit(EPSILON) + (held - start) / step)
    inf = F.lit(float("inf"))
    lo = F.when(v.isNull() | F.isnan(v), F.lit(None)).when(v < start, -inf).when(v > stop, inf).otherwise(at)
    out = df.withColumn("_b", p).withColumn(start_name, lo.cast("double"))
    return out.withColumn(end_name, F.col(start_name) + F.col("_b.step")).drop("_b")


# -- aggregates and stacks --------------------------------------------------------

AGGREGATES = ("count", "valid", "missing", "sum", "min", "max", "mean", "average",
              "variance", "variancep", "stdev", "stdevp", "distinct")


def aggregate(df: DataFrame, ops: Sequence[tuple[str, str | None, str]], groupby: Sequence[str] = ()) -> DataFrame:
    """Chart aggregates (op, field, as) per group, in one partial + final pass."""
    fns = {"count": lambda f: F.count(F.lit(1)), "valid": F.count, "missing": lambda f: F.count_if(F.col(f).isNull()),
           "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "average": F.avg,
           "variance": F.var_samp, "variancep": F.var_pop, "stdev": F.stddev_samp, "stdevp": F.stddev_pop,
           "distinct": F.count_distinct}
    unknown = [op for op, _, _ in ops if op not in fns]
    if unknown:
        raise ValueError(f"unknown aggregate {unknown[0]!r}; one of {', '.join(AGGREGATES)}")
    return df.groupBy(*groupby).agg(*[fns[op](field).alias(name) for op, field, name in ops])


def stack(df: DataFrame, order: str, value: str, by: Sequence[str] = (), group_rows: int = ordered.GROUP_ROWS) -> DataFrame:
    """Slices per group: where each starts, its end and the group's total, and
    both as shares. Rows first merge to one per slice; a group of more than
    `group_rows` slices is summed in ranges."""
    slices = materialise(df.groupBy(*by, order).agg(F.sum(value).alias("value")), "slices")
    totals = slices.groupBy(*by).agg(F.sum("value").alias("total"))
    out = ordered.running_sum(slices, by, order, "value", "_to", group_rows=group_rows)
    out = ordered.same_key_join(out, totals, list(by)) if by else out.withColumn("total", totals.scalar())
    out = out.select(*by, order, "value", (F.col("_to") - F.col("value")).alias("start"), "total")
    share = lambda c: F.when(F.col("total") != 0, c / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("x0", share(F.col("start"))).withColumn("x1", share(F.col("start") + F.col("value")))


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first k rows, per group where `by` is given, with their rank. Spark
    keeps k rows per task and group before it shuffles, so hot groups cost
    no more than others."""
    w = Window.partitionBy(*by).orderBy(*order) if by else None
    if w is None:
        # One row set of at most k rows is left to rank.
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
