"""Geometry as Column arithmetic: views, projections, lenses, WKT."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """Screen coordinates as affine columns of x, y, z."""

    a: tuple[float, float, float, float]
    b: tuple[float, float, float, float]

    def _affine(self, k, x: Column, y: Column, z: Column) -> Column:
        return F.lit(k[0]) + F.lit(k[1]) * x + F.lit(k[2]) * y + F.lit(k[3]) * z

    def u(self, x: Column, y: Column, z: Column) -> Column:
        return self._affine(self.a, x, y, z)

    def v(self, x: Column, y: Column, z: Column) -> Column:
        return self._affine(self.b, x, y, z)


def tilted(window: tuple[float, float, float, float], heights: tuple[float, float], yaw: float,
           elevation: float, plot: float) -> View:
    """A window (x0, x1, y0, y1) turned by `yaw` and seen from `elevation`
    degrees, on a square of `plot` pixels; heights take 0.35 of the plot."""
    sin_y, cos_y = math.sin(math.radians(yaw)), math.cos(math.radians(yaw))
    sin_e, cos_e = math.sin(math.radians(elevation)), math.cos(math.radians(elevation))
    scale = plot / math.sqrt(2.0) * 0.98
    x0, x1, y0, y1 = window
    w, h, dz = x1 - x0, y1 - y0, heights[1] - heights[0]
    px, py, pz = -x0 / w - 0.5, -y0 / h - 0.5, -0.35 * heights[0] / dz
    a = (scale * (px * cos_y - py * sin_y) + plot / 2, scale * cos_y / w, -scale * sin_y / h, 0.0)
    b = (-scale * ((px * sin_y + py * cos_y) * sin_e + pz * cos_e) + plot * 0.62,
         -scale * sin_y * sin_e / w, -scale * cos_y * sin_e / h, -scale * (0.35 / dz) * cos_e)
    return View(a, b)


# Fixed values of the Lambert-93 projection (EPSG:2154) on GRS80, from IGN.
L93_N = 0.725607765053267
L93_C = 11754255.426096
L93_XS = 700000.0
L93_YS = 12655612.049876
L93_E = 0.0818191910428158
L93_LON0 = 3.0


def lambert93_radius_angle(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = x - F.lit(L93_XS), y - F.lit(L93_YS)
    return F.hypot(dx, dy), F.atan(dx / -dy)


def lambert93_longitude(x: Column, y: Column) -> Column:
    _, gamma = lambert93_radius_angle(x, y)
    return F.lit(L93_LON0) + F.degrees(gamma) / F.lit(L93_N)


def lambert93_latitude(df, x: str, y: str, name: str, rounds: int = 12):
    """Adds the latitude in degrees. The fixed-point rounds run as a fold over
    a short sequence, so the expression stays small."""
    r, _ = lambert93_radius_angle(F.col(x), F.col(y))
    iso = -F.log(r / F.lit(L93_C)) / F.lit(L93_N)
    df = df.withColumn("_iso", F.exp(iso))
    half_pi = F.lit(math.pi / 2)

    def closer(phi, _):
        es = F.lit(L93_E) * F.sin(phi)
        return F.lit(2.0) * F.atan(F.pow((F.lit(1.0) + es) / (F.lit(1.0) - es), F.lit(L93_E / 2)) * F.col("_iso")) - half_pi

    start = F.lit(2.0) * F.atan(F.col("_iso")) - half_pi
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, closer)
    return df.withColumn(name, F.degrees(phi)).drop("_iso")


def lambert93(df, x: str, y: str, lon: str = "lon", lat: str = "lat"):
    return lambert93_latitude(df.withColumn(lon, lambert93_longitude(F.col(x), F.col(y))), x, y, lat)


def polar(x: Column, y: Column, width: float, height: float, inner: float = 0.0) -> tuple[Column, Column]:
    """Unit x as the angle from 12 o'clock clockwise, unit y from the inner
    radius out, on a width x height plot."""
    cx, cy, outer = width / 2, height / 2, min(width, height) / 2
    theta = x * F.lit(2 * math.pi)
    r = F.lit(outer) * (F.lit(float(inner)) + F.lit(1.0 - inner) * y)
    return F.lit(cx) + r * F.sin(theta), F.lit(cy) - r * F.cos(theta)


def polar_inverse(u: Column, v: Column, width: float, height: float, inner: float = 0.0) -> tuple[Column, Column]:
    cx, cy, outer = width / 2, height / 2, min(width, height) / 2
    dx, dy = u - F.lit(cx), v - F.lit(cy)
    turn = F.atan2(dx, -dy)
    turn = F.when(turn < 0, turn + F.lit(2 * math.pi)).otherwise(turn)
    return turn / F.lit(2 * math.pi), (F.hypot(dx, dy) / F.lit(outer) - F.lit(float(inner))) / F.lit(1.0 - inner)


def fisheye(u: Column, v: Column, focus: tuple[float, float], radius: float, distortion: float) -> tuple[Column, Column]:
    """Points within `radius` of the focus move outward; the rest stays."""
    fx, fy, rad, dist = (F.lit(float(c)) for c in (*focus, radius, distortion))
    dx, dy = u - fx, v - fy
    r = F.hypot(dx, dy)
    x = r / rad
    bent = (r > 0) & (r < rad)
    # Outside the lens the factor is not used; the guard keeps r = 0 from dividing.
    k = (dist + 1) * x / (dist * x + 1) * rad / F.when(bent, r).otherwise(F.lit(1.0))
    return F.when(bent, fx + dx * k).otherwise(u), F.when(bent, fy + dy * k).otherwise(v)


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT = rf"^POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)$"


def to_wkt(x: Column, y: Column) -> Column:
    """A point as WKT text; NULL coordinates give NULL."""
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def from_wkt(text: Column) -> tuple[Column, Column]:
    """x and y of a WKT point; other texts give NULL."""
    part = lambda i: F.when(text.rlike(POINT), F.regexp_extract(text, POINT, i).try_cast("double"))
    return part(1), part(2)
