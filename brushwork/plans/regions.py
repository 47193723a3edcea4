"""Selections too large for an expression: a fine lasso, and voxels that filter other views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import grid, voxels
from ..selection import lasso, steps
from ..selection import values as v
from ..selection.model import Selections, cross_filter, membership, producer
from ..selection.pixels import PixelGrid
from .data import POINTS, points, r
from .grids import CLOUD_GRIDS, CLOUD_POINTS, RING, STRUCTURE, _screen, largest_voxels, ring_open_sql
from .selections import LASSO, sql_cell, sql_range

# The lasso of the (price, day) plot on cells of 1/256 pixel: some 79,000 rows of cells, and more runs.
FINE = 1 / 256
FX, FY = PixelGrid((0.0, 105000.0), (0.0, 500.0), 0.0, FINE), PixelGrid((0.0, 2500.0), (400.0, 0.0), 0.0, FINE)
P_FINE = producer("area", "plot", "lasso", {"u": "x", "v": "z"}, {"u": FX, "v": FY})
FADE = 3 * FINE  # pixels


def fine_area() -> Selections:
    return Selections({"area": "intersect"}).set_boxes(P_FINE, lasso.runs(LASSO, FX, FY))


def lasso_large(spark, d):
    """Points under a lasso of many runs, and their weights by distance to it, through an interval index."""
    area = fine_area()
    p = steps.holds(points(spark, d), membership("area"), "hist", area)
    w = steps.fades(p, membership("area"), "hist", area, FADE)
    return w.groupBy("label").agg(F.count_if("holds").alias("n"), r(F.sum("degree"), 4).alias("weight"), F.count_if(F.col("degree") > 0).alias("near"))


_IN = ring_open_sql(LASSO)
LASSO_LARGE = f"""WITH {POINTS}, c AS (SELECT label, {sql_cell('x', FX)} AS cu, {sql_cell('z', FY)} AS cv FROM p),
q AS (SELECT DISTINCT cu, cv FROM c),
o AS (SELECT cu, cv, du * du + dv * dv AS d2, (cu + du + 0.5::DOUBLE) * {FINE!r}::DOUBLE AS u, (cv + dv + 0.5::DOUBLE) * {FINE!r}::DOUBLE AS v
      FROM q, (SELECT unnest(range(-3, 4)) AS du), (SELECT unnest(range(-3, 4)) AS dv) WHERE du * du + dv * dv <= 9),
t AS (SELECT cu, cv, min(d2) AS d2 FROM o WHERE {_IN} GROUP BY 1, 2)
SELECT label, count(*) FILTER (WHERE d2 = 0) AS n, round(coalesce(sum(greatest(0.0::DOUBLE, 1 - sqrt(d2) / 3::DOUBLE)), 0), 4) AS weight,
count(*) FILTER (WHERE d2 < 9) AS near FROM c LEFT JOIN t USING (cu, cv) GROUP BY 1"""

# The voxels of a CloudLasso as a producer beside an ordinary brush.
P_CLOUD = producer("brush", "cloud", "cloudlasso", {"a": "x", "b": "y", "c": "z"}, dict(zip("abc", CLOUD_GRIDS)))
QUANTITIES = PixelGrid((0.0, 50.0), (0.0, 500.0), 0.0, 2.0)
P_RANGE = producer("brush", "quantity", "interval", {"q": "y"}, {"q": QUANTITIES})


def cloud_filter(spark, d):
    """Two histograms cross-filtered by a CloudLasso's voxels and a brush: the quantity's own view sees the voxels alone."""
    brushed = (Selections({"brush": "intersect"}).set_cells(P_CLOUD, largest_voxels(spark, d).select("i", "j", "k"))
               .set(P_RANGE, [{"q": v.range_(5.0, 30.0)}]))
    out = []
    for view, c, step in (("quantity", "y", 5.0), ("price", "x", 5000.0)):
        shown = steps.kept(points(spark, d), cross_filter("brush"), view, brushed)
        out.append(grid.histogram(shown, c, step).select(F.lit(view).alias("view"), "bin", "n"))
    return reduce(lambda a, b: a.unionByName(b), out)


_KEPT = CLOUD_POINTS[: CLOUD_POINTS.rindex("pts AS")]
_CELLS = ", ".join(f"{sql_cell(c, g)} AS {k}" for c, g, k in zip("xyz", CLOUD_GRIDS, "ijk"))
CLOUD_FILTER = f"""{_KEPT} a AS (SELECT x, y, {_CELLS} FROM p), h AS (SELECT x, y FROM a JOIN kept USING (i, j, k))
SELECT 'quantity' AS view, CAST(floor(y / 5) AS BIGINT) AS bin, count(*) AS n FROM h GROUP BY ALL
UNION ALL SELECT 'price', CAST(floor(x / 5000) AS BIGINT), count(*) FROM h WHERE {sql_range('y', QUANTITIES, 5.0, 30.0)} GROUP BY ALL"""

STRUCTURES = (0.15, 0.3, STRUCTURE)


def cloud_thresholds(spark, d):
    """Three thresholds of one CloudLasso, from one table of stored voxel counts."""
    s = _screen(spark, d)
    stored = voxels.cloud_states(s, "x", "y", "z", lasso.in_ring(F.col("u"), F.col("v"), RING), CLOUD_GRIDS, {"label": F.col("label")})
    out = [stored.rollup(k).select(F.lit(k).alias("structure"), "label", "n") for k in STRUCTURES]
    return reduce(lambda a, b: a.unionByName(b), out)


CLOUD_THRESHOLDS = "\nUNION ALL ".join(
    f"SELECT CAST({k} AS DOUBLE) AS structure, label, CAST(n AS BIGINT) AS n FROM ({CLOUD_POINTS.replace(f'n >= {STRUCTURE} *', f'n >= {k} *')})" for k in STRUCTURES)

QUERIES = {
    "lasso_large": (lasso_large, LASSO_LARGE),
    "cloud_filter": (cloud_filter, CLOUD_FILTER),
    "cloud_thresholds": (cloud_thresholds, CLOUD_THRESHOLDS),
}
