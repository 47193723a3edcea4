"""Pixel cells: a captured scale and a grid of cells over its range.

Rows and brush ends go through the same arithmetic, in the same order: the
affine map in double, one rounding to float, then the cell in double. A brush
so selects whole cells, and stored cells answer it exactly.
"""

from __future__ import annotations

import math
import struct
import sys
from dataclasses import dataclass
from datetime import date, datetime, timezone

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Range

MAX = sys.float_info.max
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def millis(v: date | datetime | int | float) -> int:
    """Milliseconds since the epoch of a UTC or zone-free time."""
    if isinstance(v, (int, float)):
        return int(v)
    if not isinstance(v, datetime):
        v = datetime(v.year, v.month, v.day)
    if v.tzinfo is None:
        v = v.replace(tzinfo=timezone.utc)
    delta = v - EPOCH
    return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) // 1000


@dataclass(frozen=True)
class PixelGrid:
    domain: tuple
    range: tuple[float, float]
    origin: float = 0.0
    size: float = 1.0
    scale: str = "linear"  # or "time", in UTC
    clamp: bool = False
    range_offset: float = 0.0

    def __post_init__(self):
        if self.scale not in ("linear", "time"):
            raise ValueError("pixel grids take linear and UTC time scales only")
        if self.scale == "time" and (self.clamp or self.range_offset):
            raise ValueError("clamp and range_offset belong to linear scales")
        if not math.isfinite(self.origin) or not math.isfinite(self.size) or self.size <= 0:
            raise ValueError("a grid needs a finite origin and a positive cell size")
        for a, b in (self._d, self.range):
            if not (math.isfinite(a) and math.isfinite(b) and a != b and math.isfinite(b - a)):
                raise ValueError("domain and range need finite, nonzero spans")
        if not all(np.isfinite(self._pixel(v)) for v in self._d):
            raise ValueError("the scale maps its domain to non-finite pixels")

    @property
    def _d(self) -> tuple[float, float]:
        a, b = self.domain
        return (float(millis(a)), float(millis(b))) if self.scale == "time" else (float(a), float(b))

    @property
    def decreasing(self) -> bool:
        return (self._d[0] > self._d[1]) != (self.range[0] > self.range[1])

    # The two methods below must keep the same operations in the same order.

    def _pixel(self, x: float) -> float:
        (d0, d1), (r0, r1) = self._d, self.range
        t = (x - d0) / (d1 - d0)
        if self.clamp:
            t = min(max(t, 0.0), 1.0)
        p = t * (r1 - r0) + r0
        if self.range_offset:
            p = p + self.range_offset
        with np.errstate(over="ignore"):
            return float(np.float32(p))

    def pixel(self, value: Column) -> Column:
        """The screen coordinate of a value, with float rounding."""
        (d0, d1), (r0, r1) = self._d, self.range
        x = self._input(value)
        t = (x - F.lit(d0)) / F.lit(d1 - d0)
        if self.clamp:
            t = F.when(t.isNull() | F.isnan(t), t).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
        p = t * F.lit(float(r1 - r0)) + F.lit(float(r0))
        if self.range_offset:
            p = p + F.lit(float(self.range_offset))
        return p.cast("float").cast("double")

    def _input(self, value: Column) -> Column:
        if self.scale == "time":
            return F.unix_millis(value.cast("timestamp")).cast("double")
        return value.cast("double")

    def cell(self, value: Column) -> Column:
        """The 64-bit cell index; NULL where the pixel is not finite or its cell does not fit."""
        return F.when(self.between(value, -(2**63), 2**63 - 1), self.index(value))

    def index(self, value: Column) -> Column:
        """The cell of a value known to have one."""
        q = self.pixel(value)
        if self.origin:
            q = q - F.lit(float(self.origin))
        return F.floor(q / F.lit(float(self.size)))

    def between(self, value: Column, c0: int, c1: int) -> Column:
        """Whether a value's cell lies in c0..c1, as a range on the value itself.

        The map from values to cells is monotone, rounding included, so the
        values of a run of cells are exactly those between two doubles. The test
        costs two comparisons, on a bare column it reaches the scan, and like
        every predicate here it is never NULL."""
        ends = self.preimage(c0, c1)
        if ends is None:
            return F.lit(False)
        lo, hi = ends
        if self.scale == "time":
            t = value.cast("timestamp")
            return (t >= F.timestamp_millis(F.lit(int(lo)))) & (t < F.timestamp_millis(F.lit(int(hi) + 1))) & t.isNotNull()
        return (value >= F.lit(lo)) & (value <= F.lit(hi)) & value.isNotNull()

    def preimage(self, c0: int, c1: int) -> tuple[float, float] | None:
        """The least and the greatest value with a cell in c0..c1; None if none has."""
        least, most = self._bounds
        if self.decreasing:
            lo = self._first(lambda x: self._q(x) < c1 + 1)
            hi = self._last(lambda x: self._q(x) >= c0)
        else:
            lo = self._first(lambda x: self._q(x) >= c0)
            hi = self._last(lambda x: self._q(x) < c1 + 1)
        if lo is None or hi is None or lo > hi:
            return None
        if self.clamp:  # beyond the domain every value, infinities included, lands in an edge cell
            lo, hi = (-math.inf if lo == least else lo), (math.inf if hi == most else hi)
        return lo, hi

    @property
    def _bounds(self) -> tuple[float, float]:
        # Timestamps of years 1 to 9999; else every finite double.
        return (-62135596800000.0, 253402300799999.0) if self.scale == "time" else (-MAX, MAX)

    def _q(self, x: float) -> float:
        return (self._pixel(x) - self.origin) / self.size

    def _first(self, ok) -> float | None:
        """The least value for which a test holds that holds from some value on."""
        lo, hi = (self._key(v) for v in self._bounds)
        if not ok(self._value(hi)):
            return None
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(self._value(mid)) else (mid + 1, hi)
        return self._value(lo)

    def _last(self, ok) -> float | None:
        lo, hi = (self._key(v) for v in self._bounds)
        if not ok(self._value(lo)):
            return None
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if ok(self._value(mid)) else (lo, mid - 1)
        return self._value(lo)

    def _key(self, v: float) -> int:
        """Doubles in order as integers in order; times are integers already."""
        if self.scale == "time":
            return int(v)
        (bits,) = struct.unpack("<q", struct.pack("<d", v))
        return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)

    def _value(self, k: int) -> float:
        if self.scale == "time":
            return float(k)
        (v,) = struct.unpack("<d", struct.pack("<q", k if k >= 0 else -k - 2**63))
        return v

    def cell_of(self, value) -> int | None:
        """The cell of one value, computed as rows are."""
        q = self._q(float(millis(value)) if self.scale == "time" else float(value))
        return int(math.floor(q)) if math.isfinite(q) and -(2.0**63) <= math.floor(q) < 2.0**63 else None

    def snap(self, test: Range) -> Range:
        """A brush range as a range of cells; a decreasing scale swaps the ends."""
        def end(v):
            if v is None:
                return None
            c = self.cell_of(v)
            if c is None:
                raise ValueError(f"{v!r} has no cell on this grid")
            return c

        lo, hi, lo_in, hi_in = end(test.lo), end(test.hi), test.lo_in, test.hi_in
        return Range(hi, lo, hi_in, lo_in) if self.decreasing else Range(lo, hi, lo_in, hi_in)

    def centre(self, cell: int) -> float:
        return self.origin + (cell + 0.5) * self.size

    def reach(self) -> tuple[int, int] | None:
        """On a clamped grid, the only cells that data can land in."""
        if not self.clamp:
            return None
        a, b = (self.cell_of(v) for v in self.domain)
        return (min(a, b), max(a, b))
