"""Cells, voxels, pyramids, level of detail, stencils, rasters, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import grid, states, terrain, voxels
from ..operators.ordered import once, same_key_join
from ..selection import lasso
from ..selection.pixels import PixelGrid
from ..session import scratch_path
from ..sources import tables
from .data import POINTS, load, points, r

SIZE = (1000.0, 5.0)  # price and quantity per cell


def top_cells(spark, d):
    c = grid.cells(points(spark, d), "x", "y", "z", "label", SIZE, means=["intensity"])
    return c.select("cx", "cy", "zmax", "top", r("mean_intensity", 9).alias("mean_intensity"), "n")


CELLS = """c AS (
  SELECT CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, max(z) AS zmax,
         (max(struct_pack(z := z, l := label))).l AS top, round(avg(intensity), 9) AS mean_intensity, count(*) AS n
  FROM p GROUP BY 1, 2)"""

TOP_CELLS = f"WITH {POINTS}, {CELLS} SELECT * FROM c"


def _pyramid(spark, d):
    return grid.pyramid(grid.cells(points(spark, d), "x", "y", "z", "label", SIZE))


LEVELS = """l AS (
  SELECT level, CAST(floor(cx / level) AS BIGINT) AS cx, CAST(floor(cy / level) AS BIGINT) AS cy, max(zmax) AS zmax,
         (max(struct_pack(z := zmax, l := top))).l AS top, CAST(sum(n) AS BIGINT) AS n
  FROM c, (SELECT unnest([1, 2, 4, 8, 16]) AS level) GROUP BY 1, 2, 3)"""

PYRAMID = f"WITH {POINTS}, {CELLS}, {LEVELS} SELECT * FROM l"


def lod_window(spark, d):
    """A view of 20 000 to 60 000 by 10 to 40 at 0.0005 px per unit: 4 000-unit cells."""
    at = grid.lod_window(_pyramid(spark, d), points(spark, d), {"x": (20000.0, 60000.0), "y": (10.0, 40.0)},
                         px_per_unit=0.0005, cell_size=SIZE)
    return at.select("x", "y", "zmax", "top", "n")


LOD = f"""WITH {POINTS}, {CELLS}, {LEVELS}
SELECT CAST(cx * 4000 + 2000 AS DOUBLE) AS x, CAST(cy * 20 + 10 AS DOUBLE) AS y, zmax, top, n FROM l
WHERE level = 4 AND cx * 4000.0 + 2000.0 >= 12000 AND cx * 4000.0 + 2000.0 < 68000
  AND cy * 20.0 + 10.0 >= 4 AND cy * 20.0 + 10.0 < 46"""


# Views of one stored pyramid: zoomed out, in between, and close.
VIEWS = {"far": ({"x": (0.0, 105000.0), "y": (0.0, 51.0)}, 0.00001, 16), "middle": ({"x": (20000.0, 60000.0), "y": (10.0, 40.0)}, 0.0005, 4),
         "near": ({"x": (40000.0, 42000.0), "y": (20.0, 24.0)}, 0.002, 1)}


def lod_views(spark, d):
    """A pyramid written once along a space-filling curve, read by three views."""
    path = scratch_path(spark, "pyramid")
    grid.store_levels(_pyramid(spark, d), path)
    levels = grid.stored_levels(spark, path)
    drawn = [grid.lod_window(levels, None, box, px, cell_size=SIZE).select(F.lit(name).alias("view"), "level", "x", "y", "zmax", "top", "n")
             for name, (box, px, _) in VIEWS.items()]
    return reduce(DataFrame.unionByName, drawn)


def _view_sql(name):
    (x0, x1), (y0, y1) = VIEWS[name][0].values()
    f, mx, my = VIEWS[name][2], (x1 - x0) * 0.2, (y1 - y0) * 0.2
    x, y = f"CAST(cx * {1000 * f} + {500 * f} AS DOUBLE)", f"CAST(cy * {5 * f} + {2.5 * f} AS DOUBLE)"
    return f"""SELECT '{name}' AS view, CAST(level AS INTEGER) AS level, {x} AS x, {y} AS y, zmax, top, n FROM l
WHERE level = {f} AND {x} >= {x0 - mx} AND {x} < {x1 + mx} AND {y} >= {y0 - my} AND {y} < {y1 + my}"""


LOD_VIEWS = f"WITH {POINTS}, {CELLS}, {LEVELS} " + " UNION ALL ".join(_view_sql(name) for name in VIEWS)


def lod_raw(spark, d):
    """Close enough for raw points: the lowest of them, up to the point budget."""
    p = points(spark, d)
    at = grid.lod_window(_pyramid(spark, d), p, {"x": (20000.0, 60000.0), "y": (10.0, 40.0)}, px_per_unit=4.0,
                         cell_size=SIZE, budget=2000, order=("z", "x", "y", "label", "order_key"))
    return at.select("x", "y", "z", "label")


LOD_RAW = f"""WITH {POINTS} SELECT x, y, z, label FROM p WHERE x >= 12000 AND x < 68000 AND y >= 4 AND y < 46
ORDER BY z, x, y, label, order_key LIMIT 2000"""


def map_window(spark, d):
    box = grid.window(points(spark, d), {"x": (30000.0, 45000.0), "y": (10.0, 20.0)})
    return box.groupBy("label").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("sum_x"))


MAP_WINDOW = f"""WITH {POINTS} SELECT label, count(*) AS n, round(sum(x), 2) AS sum_x FROM p
WHERE x >= 30000 AND x < 45000 AND y >= 10 AND y < 20 GROUP BY 1"""


def strip(spark, d):
    cut = grid.window(points(spark, d), {"y": (24.0, 26.0)})
    return cut.select(F.col("x").cast("float").cast("double").alias("x"), "z", "label").orderBy("label", "x", "z")


STRIP = f"""WITH {POINTS} SELECT CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, z, label FROM p
WHERE y >= 24 AND y < 26"""


def local_origin(spark, d):
    p = grid.local_origin(points(spark, d), ["x", "z"], 100.0)
    return grid.density(p, {"cx": ("x", 2000.0, 0.0), "cz": ("z", 250.0, 0.0)})


LOCAL = f"""WITH {POINTS}, o AS (SELECT floor(min(x) / 100) * 100 AS ox, floor(min(z) / 100) * 100 AS oz FROM p)
SELECT CAST(floor((x - ox) / 2000) AS BIGINT) AS cx, CAST(floor((z - oz) / 250) AS BIGINT) AS cz, count(*) AS n
FROM p, o GROUP BY 1, 2"""


def density_2d(spark, d):
    return grid.density(points(spark, d), {"i": ("z", 30.0, 0.0), "j": ("x", 5000.0, 0.0)})


DENSITY = f"""WITH {POINTS} SELECT CAST(floor(z / 30) AS BIGINT) AS i, CAST(floor(x / 5000) AS BIGINT) AS j, count(*) AS n
FROM p GROUP BY 1, 2"""


def voxel_counts(spark, d):
    return grid.density(points(spark, d), {"i": ("x", 10000.0, 0.0), "j": ("y", 10.0, 0.0), "k": ("z", 300.0, 0.0)})


VOXELS = f"""WITH {POINTS} SELECT CAST(floor(x / 10000) AS BIGINT) AS i, CAST(floor(y / 10) AS BIGINT) AS j,
CAST(floor(z / 300) AS BIGINT) AS k, count(*) AS n FROM p GROUP BY 1, 2, 3"""


def voxel_adjacency(spark, d):
    return voxels.adjacency(voxel_counts(spark, d)).groupBy("i", "j", "k").agg(F.count("*").alias("greater_neighbours"))


ADJACENCY = f"""WITH {POINTS}, v AS (
  SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) AS i, CAST(floor(y / 10) AS BIGINT) AS j, CAST(floor(z / 300) AS BIGINT) AS k FROM p)
SELECT a.i, a.j, a.k, count(*) AS greater_neighbours FROM v a JOIN v b
  ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.k BETWEEN a.k - 1 AND a.k + 1
 AND (b.i, b.j, b.k) > (a.i, a.j, a.k) GROUP BY 1, 2, 3"""


def state_merge(spark, d):
    """States per ship month, merged over the months at a grid four times coarser."""
    p = points(spark, d).withColumn("pane", F.floor(F.col("z") / 30).cast("long"))
    return grid.merge_cells(grid.fold_cells(p, "x", "y", "z", SIZE, by=["pane"]), 4)


STATE_MERGE = f"""WITH {POINTS} SELECT CAST(floor(floor(x / 1000) / 4) AS BIGINT) AS cx, CAST(floor(floor(y / 5) / 4) AS BIGINT) AS cy,
max(z) AS zmax, count(*) AS n FROM p GROUP BY 1, 2"""

SPREADS = [("rows", None, "n"), ("valid", "x", "valid"), ("missing", "x", "missing"), ("sum", "x", "total"),
           ("min", "x", "lo"), ("max", "x", "hi"), ("mean", "x", "mean"), ("var_samp", "x", "var_samp"),
           ("var_pop", "x", "var_pop"), ("stddev_samp", "x", "stddev_samp"), ("stddev_pop", "x", "stddev_pop")]


def merged_apart(spark, d):
    """One label's prices are partly infinite: its spread is NaN, and the others' are as if it were not there."""
    p = points(spark, d).withColumn("x", F.when((F.col("label") == "R") & (F.pmod(F.col("order_key"), F.lit(5)) == 0), F.lit(float("inf"))).otherwise(F.col("x")))
    specs = [("var_pop", "x", "spread"), ("mean", "x", "mean")]
    merged = states.merge(states.fold(p, ["label", "z"], specs), ["label"], specs)
    return merged.select("label", F.isnan("spread").alias("none"), r(F.nanvl("spread", F.lit(0.0)), 3).alias("spread"), F.col("mean").isin(float("inf")).alias("endless"))


MERGED_APART = f"""WITH {POINTS} SELECT label, label = 'R' AS none, CASE WHEN label = 'R' THEN 0 ELSE round(var_pop(x), 3) END AS spread,
label = 'R' AS endless FROM p GROUP BY 1"""


def merged_distinct(spark, d):
    """Distinct orders, prices and days a label, from sketches per (label, day): within four standard errors of the exact counts."""
    specs = [("approx_distinct", c, c) for c in ("order_key", "x", "z")]
    p = points(spark, d).withColumn("x", F.when(F.pmod(F.col("order_key"), F.lit(7)) != 0, F.col("x")))
    rolled = states.merge(states.fold(p, ["label", "z"], specs), ["label"], specs)
    exact = p.groupBy("label").agg(*[F.count_distinct(c).alias(f"{c}_exact") for _, c, _ in specs])
    near = lambda c: F.abs(F.col(c) - F.col(f"{c}_exact")) <= 4 * states.SKETCH_ERROR * F.col(f"{c}_exact")
    return same_key_join(rolled, exact, ["label"]).select(
        "label", *[f"{c}_exact" for _, c, _ in specs], *[near(c).alias(f"{c}_near") for _, c, _ in specs])


DISTINCT = f"""WITH {POINTS}, q AS (SELECT label, order_key, z, CASE WHEN order_key % 7 <> 0 THEN x END AS x FROM p)
SELECT label, count(DISTINCT order_key) AS order_key_exact, count(DISTINCT x) AS x_exact, count(DISTINCT z) AS z_exact,
true AS order_key_near, true AS x_near, true AS z_near FROM q GROUP BY 1"""


def merged_measures(spark, d):
    """Every mergeable measure, folded per (label, day) and merged per label.
    One price in seven is blanked."""
    p = points(spark, d).withColumn("x", F.when(F.pmod(F.col("order_key"), F.lit(7)) != 0, F.col("x")))
    merged = states.merge(states.fold(p, ["label", "z"], SPREADS), ["label"], SPREADS)
    rounded = ("mean", "var_samp", "var_pop", "stddev_samp", "stddev_pop")
    return merged.select("label", "n", "valid", "missing", r("total", 2).alias("total"), "lo", "hi",
                         *[r(c, 3).alias(c) for c in rounded])


MERGED = f"""WITH {POINTS}, q AS (SELECT label, CASE WHEN order_key % 7 <> 0 THEN x END AS x FROM p)
SELECT label, count(*) AS n, count(x) AS valid, count(*) - count(x) AS missing, round(sum(x), 2) AS total, min(x) AS lo,
max(x) AS hi, round(avg(x), 3) AS mean, round(var_samp(x), 3) AS var_samp, round(var_pop(x), 3) AS var_pop,
round(stddev_samp(x), 3) AS stddev_samp, round(stddev_pop(x), 3) AS stddev_pop FROM q GROUP BY 1"""


def hillshade(spark, d):
    c = grid.cells(points(spark, d), "x", "y", "z", "label", (1000.0, 1.0))
    s = terrain.hillshade(c.withColumn("h", F.col("zmax") / 1000.0), "cx", "cy", "h")
    return s.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), r("hillshade").alias("hillshade"))


HILLSHADE = f"""WITH {POINTS}, c AS (
  SELECT CAST(floor(x / 1000) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, max(z) / 1000.0 AS h FROM p GROUP BY 1, 2),
n AS (SELECT a.i, a.j, a.h,
  {", ".join(f"coalesce(max(CASE WHEN b.i = a.i + {di} AND b.j = a.j + {dj} THEN b.h END), a.h) AS h{di + 1}{dj + 1}" for di in (-1, 0, 1) for dj in (-1, 0, 1))}
  FROM c a JOIN c b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.i, a.j, a.h),
g AS (SELECT *, ((h22 + 2 * h21 + h20) - (h02 + 2 * h01 + h00)) / 8.0 AS gx, ((h02 + 2 * h12 + h22) - (h00 + 2 * h10 + h20)) / 8.0 AS gy FROM n),
s AS (SELECT i, j, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, -gx) AS aspect FROM g)
SELECT i AS cx, j AS cy, round(greatest(sin(radians(45)) * cos(slope)
  + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect), 0.0), 6) AS hillshade FROM s"""

VIEW_WINDOW = (0.0, 105000.0, 0.0, 51.0)
VIEW = geometry.tilted(VIEW_WINDOW, (0.0, 2500.0), yaw=30.0, elevation=35.0, plot=600.0)


def _screen(spark, d):
    at = (F.col("x"), F.col("y"), F.col("z"))
    return once(points(spark, d), u=VIEW.u(*at), v=VIEW.v(*at))


def _affine(k):
    return f"({k[0]!r}::DOUBLE + {k[1]!r}::DOUBLE * x + {k[2]!r}::DOUBLE * y + {k[3]!r}::DOUBLE * z)"


SCREEN = f"s AS (SELECT *, {_affine(VIEW.a)} AS u, {_affine(VIEW.b)} AS v FROM p)"


def tilt_raster(spark, d):
    """The tilted view counted per 10 px cell, as a grey raster."""
    c = grid.density(_screen(spark, d), {"i": ("u", 10.0, 0.0), "j": ("v", 10.0, 0.0)})
    shown = c.select(grid.centre("i", 10.0).alias("px"), grid.centre("j", 10.0).alias("py"), F.log1p("n").alias("value"))
    return terrain.raster(shown, "px", "py", "value", 10.0)


TILT_RASTER = f"""WITH {POINTS}, {SCREEN}, c AS (
  SELECT floor(u / 10) AS i, floor(v / 10) AS j, ln(1.0 + count(*)) AS value FROM s GROUP BY 1, 2),
e AS (SELECT min(i) AS i0, max(j) AS j1, min(value) AS lo, max(value) AS hi FROM c)
SELECT CAST(j1 - j AS BIGINT) AS row, CAST(i - i0 AS BIGINT) AS col,
CAST(floor(greatest(0.0, least(255.0, (value - lo) / greatest(hi - lo, 1e-12) * 255.0))) AS INTEGER) AS grey FROM c, e"""

# A lasso over the tilted view, in pixels.
RING = [(150.0, 330.0), (420.0, 180.0), (520.0, 300.0), (330.0, 330.0), (410.0, 430.0), (230.0, 470.0)]
CLOUD_GRIDS = (PixelGrid((0.0, 105000.0), (0.0, 24.0)), PixelGrid((0.0, 51.0), (0.0, 17.0)), PixelGrid((0.0, 2500.0), (0.0, 8.0)))
STRUCTURE = 0.45


def ring_sql(ring, u="u", v="v"):
    """Even-odd insideness as SQL, edge by edge."""
    terms = []
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        terms.append(f"CASE WHEN ({ay} > {v}) <> ({by} > {v}) AND {u} < ({bx} - {ax}) * ({v} - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


def ring_open_sql(ring, u="u", v="v"):
    """Insideness of a cell's centre: strictly between two crossings of its row."""
    return f"({ring_sql(ring, u, v)}) AND ({ring_sql(ring, u, v).replace(f'{u} < ', f'{u} > ')})"


def lasso_voxels(spark, d):
    """Voxel counts of the points inside a lasso drawn on the tilted view."""
    s = _screen(spark, d)
    return voxels.voxel_counts(s.where(lasso.in_ring(F.col("u"), F.col("v"), RING)), "x", "y", "z", CLOUD_GRIDS)


def _cloud_cell(c, lo, hi, n):
    return f"CAST(floor(CAST(CAST(({c} - {lo}) / {hi - lo} * {n} + 0.0 AS FLOAT) AS DOUBLE)) AS BIGINT)"


LASSO_VOXELS = f"""WITH {POINTS}, {SCREEN}, v AS (
  SELECT {_cloud_cell('x', 0.0, 105000.0, 24.0)} AS i, {_cloud_cell('y', 0.0, 51.0, 17.0)} AS j,
         {_cloud_cell('z', 0.0, 2500.0, 8.0)} AS k, count(*) AS n
  FROM s WHERE {ring_sql(RING)} GROUP BY 1, 2, 3)"""


def cloudlasso(spark, d):
    """Voxels of the largest dense region under the lasso, and how many regions there are."""
    return largest_voxels(spark, d)


def largest_voxels(spark, d):
    return voxels.largest_region(tables.materialise(lasso_voxels(spark, d)), STRUCTURE)


CLOUDLASSO = LASSO_VOXELS.replace("WITH", "WITH RECURSIVE", 1) + f""",
q AS (SELECT * FROM v WHERE n >= {STRUCTURE} * (SELECT max(n) FROM v)),
ids AS (SELECT *, row_number() OVER (ORDER BY i, j, k) AS id FROM q),
e AS (SELECT a.id AS a, b.id AS b FROM ids a JOIN ids b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
lab AS (SELECT a AS id, min(b) AS region FROM reach GROUP BY a),
size AS (SELECT region, sum(n) AS points FROM ids JOIN lab USING (id) GROUP BY region),
best AS (SELECT region FROM size ORDER BY points DESC, region LIMIT 1)
SELECT i, j, k, n, (SELECT count(*) FROM size) AS regions FROM ids JOIN lab USING (id) WHERE region = (SELECT region FROM best)"""


def cloudlasso_points(spark, d):
    """The points CloudLasso keeps, per label."""
    s = _screen(spark, d)
    kept = voxels.cloud_lasso(s, "x", "y", "z", lasso.in_ring(F.col("u"), F.col("v"), RING), CLOUD_GRIDS, STRUCTURE)
    return kept.groupBy("label").agg(F.count("*").alias("n"))


CLOUD_POINTS = CLOUDLASSO[: CLOUDLASSO.rindex("SELECT i, j, k")] + f""",
kept AS (SELECT i, j, k FROM ids JOIN lab USING (id) WHERE region = (SELECT region FROM best)),
pts AS (SELECT label, {_cloud_cell('x', 0.0, 105000.0, 24.0)} AS i, {_cloud_cell('y', 0.0, 51.0, 17.0)} AS j,
  {_cloud_cell('z', 0.0, 2500.0, 8.0)} AS k FROM s WHERE {ring_sql(RING)})
SELECT label, count(*) AS n FROM pts JOIN kept USING (i, j, k) GROUP BY 1"""


def polar(spark, d):
    """Price and quantity on a polar plot and back, averaged per label."""
    x, y = F.col("x") / 105000.0, F.col("y") / 51.0
    u, v = geometry.polar(x, y, 600.0, 500.0, 0.2)
    p = points(spark, d).withColumn("u", u).withColumn("v", v)
    bx, by = geometry.polar_inverse(F.col("u"), F.col("v"), 600.0, 500.0, 0.2)
    return p.withColumn("bx", bx).withColumn("by", by).groupBy("label").agg(
        r(F.avg("u"), 5).alias("u"), r(F.avg("v"), 5).alias("v"), r(F.avg("bx"), 5).alias("bx"), r(F.avg("by"), 5).alias("by"))


POLAR = f"""WITH {POINTS}, q AS (SELECT label, x / 105000.0 * 2 * pi() AS th, 250.0 * (0.2 + 0.8 * (y / 51.0)) AS rr FROM p),
s AS (SELECT label, 300.0 + rr * sin(th) AS u, 250.0 - rr * cos(th) AS v FROM q),
i AS (SELECT *, atan2(u - 300.0, -(v - 250.0)) AS a, sqrt((u - 300.0) ** 2 + (v - 250.0) ** 2) AS m FROM s)
SELECT label, round(avg(u), 5) AS u, round(avg(v), 5) AS v,
round(avg((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) / (2 * pi())), 5) AS bx, round(avg((m / 250.0 - 0.2) / 0.8), 5) AS by
FROM i GROUP BY 1"""


def fisheye(spark, d):
    u, v = geometry.fisheye(F.col("x") / 105000.0, F.col("y") / 51.0, (0.4, 0.5), 0.3, 3.0)
    p = points(spark, d).withColumn("u", u).withColumn("v", v)
    return p.groupBy("label").agg(r(F.avg("u")).alias("u"), r(F.avg("v")).alias("v"))


FISHEYE = f"""WITH {POINTS}, q AS (SELECT label, x / 105000.0 AS u, y / 51.0 AS v FROM p),
w AS (SELECT *, u - 0.4 AS dx, v - 0.5 AS dy, sqrt((u - 0.4) ** 2 + (v - 0.5) ** 2) AS rr FROM q),
k AS (SELECT *, CASE WHEN rr > 0 AND rr < 0.3 THEN 4.0 * (rr / 0.3) / (3.0 * (rr / 0.3) + 1) * 0.3 / rr END AS k FROM w)
SELECT label, round(avg(CASE WHEN k IS NULL THEN u ELSE 0.4 + dx * k END), 6) AS u,
round(avg(CASE WHEN k IS NULL THEN v ELSE 0.5 + dy * k END), 6) AS v FROM k GROUP BY 1"""


def lambert93(spark, d):
    """Price and ship day taken as an offset in metres from a place near Paris."""
    p = points(spark, d).select("label", (F.col("x") + 600000.0).alias("e"), (F.col("z") * 10 + 6860000.0).alias("n"))
    g = geometry.lambert93(p, "e", "n")
    return g.groupBy("label").agg(r(F.avg("lon")).alias("lon"), r(F.avg("lat")).alias("lat"), r(F.max("lat")).alias("north"))


def _lambert_sql():
    e, n, c = geometry.L93_E, geometry.L93_N, geometry.L93_C
    steps, prev = [], "g0"
    for i in range(1, 13):
        steps.append(f"g{i} AS (SELECT label, lon, iso, 2 * atan(pow((1 + {e!r} * sin(phi)) / (1 - {e!r} * sin(phi)), {e / 2!r}) * iso) - pi() / 2 AS phi FROM {prev})")
        prev = f"g{i}"
    return f"""WITH {POINTS}, q AS (SELECT label, x + 600000.0 - {geometry.L93_XS} AS dx, z * 10 + 6860000.0 - {geometry.L93_YS} AS dy FROM p),
h AS (SELECT label, {geometry.L93_LON0} + degrees(atan(dx / -dy)) / {n!r} AS lon, exp(-ln(sqrt(dx * dx + dy * dy) / {c!r}) / {n!r}) AS iso FROM q),
g0 AS (SELECT label, lon, iso, 2 * atan(iso) - pi() / 2 AS phi FROM h), {", ".join(steps)}
SELECT label, round(avg(lon), 6) AS lon, round(avg(degrees(phi)), 6) AS lat, round(max(degrees(phi)), 6) AS north FROM g12 GROUP BY 1"""


def wkt(spark, d):
    """Points to WKT and back; customer balances and nations as coordinates."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    t = c.withColumn("wkt", geometry.to_wkt(F.col("nation"), F.col("balance")))
    x, y = geometry.from_wkt(F.col("wkt"))
    return t.select("nation", "balance", x.alias("x"), y.alias("y"), F.col("wkt").startswith("POINT (").alias("is_point"))


WKT = "SELECT c_nationkey AS nation, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y, true AS is_point FROM customer"


def sorted_copy(spark, d):
    """A copy written sorted by price, and a window read back from it."""
    path = scratch_path(spark, "sorted")
    p = points(spark, d)
    copy = tables.cached(spark, path, lambda: p.select("x", "y", "label"), order=["x", "y"])
    return grid.histogram(grid.window(copy, {"x": (50000.0, 70000.0)}), "x", 1000.0, by=["label"])


SORTED = f"""WITH {POINTS} SELECT label, CAST(floor(x / 1000) AS BIGINT) AS bin, count(*) AS n FROM p
WHERE x >= 50000 AND x < 70000 GROUP BY 1, 2"""

QUERIES = {
    "top_cells": (top_cells, TOP_CELLS),
    "pyramid_levels": (lambda s, d: _pyramid(s, d), PYRAMID),
    "lod_window": (lod_window, LOD),
    "lod_views": (lod_views, LOD_VIEWS),
    "lod_raw": (lod_raw, LOD_RAW),
    "map_window": (map_window, MAP_WINDOW),
    "strip": (strip, STRIP),
    "local_origin": (local_origin, LOCAL),
    "density_2d": (density_2d, DENSITY),
    "voxels": (voxel_counts, VOXELS),
    "voxel_adjacency": (voxel_adjacency, ADJACENCY),
    "state_merge": (state_merge, STATE_MERGE),
    "merged_measures": (merged_measures, MERGED),
    "merged_distinct": (merged_distinct, DISTINCT),
    "merged_apart": (merged_apart, MERGED_APART),
    "hillshade": (hillshade, HILLSHADE),
    "tilt_raster": (tilt_raster, TILT_RASTER),
    "lasso_voxels": (lasso_voxels, LASSO_VOXELS + " SELECT i, j, k, n FROM v"),
    "cloudlasso": (cloudlasso, CLOUDLASSO),
    "cloudlasso_points": (cloudlasso_points, CLOUD_POINTS),
    "polar": (polar, POLAR),
    "fisheye": (fisheye, FISHEYE),
    "lambert93": (lambert93, _lambert_sql()),
    "wkt": (wkt, WKT),
    "sorted_copy": (sorted_copy, SORTED),
}
