"""Number and date formatting by the small part of the d3 patterns in use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"  # the sign d3 prints before negative numbers
SPEC = re.compile(r"^(,?)(?:\.(\d+))?([f%d])$")


def _half_up(x: Column, digits: int) -> Column:
    """|x| with an exact tie at `digits` decimals moved up, as JavaScript rounds.
    A double is such a tie only if it is a multiple of 2^-(digits + 1), which a
    product by a power of two tests without rounding."""
    a = F.abs(x)
    ten, two = F.lit(10.0**digits), F.lit(2.0 ** (digits + 1))
    whole = a * two
    tie = (whole == F.floor(whole)) & (a * ten - F.floor(a * ten) == 0.5) & (a < 1e15)
    return F.when(tie, (F.floor(a * ten) + 1) / ten).otherwise(a)


def format_number(value: Column, spec: str) -> Column:
    """`,.Nf`, `.Nf`, `,.N%`, `.N%`, `,d` and `d`; other patterns are refused."""
    m = SPEC.match(spec)
    if not m or (m.group(3) == "d" and m.group(2)):
        raise ValueError(f"unsupported number format {spec!r}")
    group, digits, kind = m.group(1), m.group(2), m.group(3)
    n = 0 if kind == "d" else int(digits or 6)
    x = value.cast("double")
    scaled = x * 100.0 if kind == "%" else x
    shown = F.format_number(_half_up(scaled, n), n)
    if not group:
        shown = F.replace(shown, F.lit(","), F.lit(""))
    shown = F.when(F.abs(scaled) == float("inf"), F.lit("Infinity")).otherwise(shown)
    # A negative number that rounds to zero prints without its sign.
    negative = (scaled < 0) & ~shown.rlike(r"^[0.,]*$")
    out = F.concat(F.when(negative, F.lit(MINUS)).otherwise(F.lit("")), shown, F.lit("%" if kind == "%" else ""))
    return F.when(F.isnan(scaled), F.lit("NaN%" if kind == "%" else "NaN")).otherwise(out)


# d3 date directives and the date patterns that print the same.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "%": "'%'"}


def date_pattern(spec: str) -> str:
    out, literal, i = [], [], 0

    def flush():
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'")
            literal.clear()

    while i < len(spec):
        if spec[i] == "%":
            d = spec[i + 1 : i + 2]
            if d not in DIRECTIVES:
                raise ValueError(f"unsupported date directive %{d}")
            flush()
            out.append(DIRECTIVES[d])
            i += 2
        else:
            literal.append(spec[i])
            i += 1
    flush()
    return "".join(out)


def format_time(instant: Column, spec: str) -> Column:
    """An instant as UTC wall time, whatever the session's time zone."""
    return F.date_format(utc_wall(instant), date_pattern(spec))


def utc_wall(instant: Column) -> Column:
    """A timestamp that shows, in the session's time zone, the UTC wall time."""
    return F.to_utc_timestamp(instant, F.current_timezone())
