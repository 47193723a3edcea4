"""Lenses and soft effects over rows placed in the unit square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import held

Domain = tuple[float, float]


def unit(c: Column, domain: Domain) -> Column:
    return (c - F.lit(float(domain[0]))) / F.lit(float(domain[1] - domain[0]))


def inside(u: Column, v: Column, focus: tuple[float, float], radius: float) -> Column:
    return F.coalesce(F.hypot(u - F.lit(float(focus[0])), v - F.lit(float(focus[1]))) <= F.lit(float(radius)), F.lit(False))


def hash01(key: Column) -> Column:
    """A key to a number in [0, 1), the same on every run: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sample(df: DataFrame, under: Column, key: Column, keep: float) -> DataFrame:
    """Under the lens, rows stay with probability `keep` by a hash of their key."""
    return df.where(~under | (hash01(key) < F.lit(float(keep))))


def mole(df: DataFrame, under: Column, height: str, above: float) -> DataFrame:
    """Under the lens, rows above a share of the whole height range go."""
    e = df.agg(F.struct(F.min(height).alias("lo"), F.max(height).alias("hi"))).scalar()
    share = (F.col(height) - e.getField("lo")) / (e.getField("hi") - e.getField("lo"))
    return df.where(~under | (share <= F.lit(float(above))))


def regression(df: DataFrame, under: Column, key: str, x: str, y: str) -> DataFrame:
    """Per series, least squares of y on x over the rows under the lens, for
    series with three or more of them and some spread in x; r2 is 1 where y
    does not vary."""
    fit = df.where(under).groupBy(key).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("_r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    return fit.where((F.col("n") >= 3) & (F.col("_sxx") >= 1e-12)).select(
        key, "n", "slope", "intercept", F.when(F.col("_syy") < 1e-12, F.lit(1.0)).otherwise(F.col("_r2")).alias("r2"))


def interval_degree(u: Column, x: Domain, v: Column | None = None, y: Domain | None = None,
                    soft: float | None = None) -> Column:
    """Degree of a box brush in unit space: 1 inside, falling to 0 at `soft`."""
    def gap(c: Column, d: Domain) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.lit(float(d[0])) - c, c - F.lit(float(d[1])), F.lit(0.0)))


    d = gap(u, x) if v is None or y is None else F.hypot(gap(u, x), gap(v, y))
    return fall(d, soft)


def fall(distance: Column, soft: float | None) -> Column:
    if soft is None:
        hard = F.when(distance <= 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.coalesce(hard, F.lit(0.0))
    d = F.lit(1.0) - distance / F.lit(max(float(soft), 1e-9))
    return F.coalesce(held(d, 0.0, 1.0), F.lit(0.0))


def keep(df: DataFrame, degree: Column) -> DataFrame:
    return df.where(degree >= 0.5)


def fade(degree: Column) -> Column:
    """The weight of a faded row; what is not selected keeps a little."""
    return F.lit(0.15) + F.lit(0.85) * degree
