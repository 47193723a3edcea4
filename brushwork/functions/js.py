"""JavaScript semantics over columns, as Vega expressions compute them.

`Js(df)` knows the column types. Its values carry a Column and a kind, so that
`+` can concatenate, comparisons can coerce, and truthiness follows the type.
With `semantics="sql"` the same expression keeps SQL's NULLs and NaN order.
Everything is built-in Column arithmetic: no UDF, no per-row Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transforms import typed_truthy
from . import formats

NAN, INF = float("nan"), float("inf")

# The constants of the expression language.
CONSTANTS = {
    "PI": math.pi, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": math.log2(math.e),
    "LOG10E": math.log10(math.e), "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2),
    "MIN_VALUE": 5e-324, "MAX_VALUE": 1.7976931348623157e308, "NaN": NAN,
}

SPACE = "[ \\t\\n\\u000b\\f\\r\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
TRIM = f"^{SPACE}+|{SPACE}+$"
DECIMAL = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
HEX = r"^0[xX][0-9a-fA-F]+$"


def _hex(t: Column) -> Column:
    """Hex digits of any number, rounded once: the first 64 bits, odd if anything but zeros follows, times a power of two."""
    digits = F.regexp_replace(t, "^0[xX]0*", "")
    head = F.conv(F.substring(digits, 1, 16), 16, 10).try_cast("decimal(20,0)")
    odd = F.substring(digits, 17, 1 << 30).rlike("[1-9a-fA-F]") & (head % 2 == 0)
    head = F.when(odd, head + 1).otherwise(head).cast("string").try_cast("double")
    return F.when(digits == "", F.lit(0.0)).otherwise(head * F.pow(F.lit(2.0), 4 * F.greatest(F.length(digits) - 16, F.lit(0))))


def number_of_text(s: Column) -> Column:
    """Number(text): trimmed; '' is 0; what does not parse is NaN; NULL stays."""
    t = F.regexp_replace(s, TRIM, "")
    return (F.when(s.isNull(), F.lit(None).cast("double"))
            .when(t == "", F.lit(0.0))
            .when(t.isin("Infinity", "+Infinity"), F.lit(INF)).when(t == "-Infinity", F.lit(-INF))
            .when(t.rlike(HEX), _hex(t))
            .when(t.rlike(DECIMAL), t.try_cast("double"))
            .otherwise(F.lit(NAN)))


def text_of_number(x: Column) -> Column:
    """String(number): whole numbers without a decimal point, plain decimals
    down to 1e-6, then an exponent as JavaScript writes it."""
    x = x.cast("double")
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 9.2e18)
    # Java writes plain decimals from 1e-3 to 1e7 and 'E' beyond.
    java = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[\d.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1)
    scientific = F.concat(mantissa, F.when(exponent.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), exponent)
    big = x.try_cast("decimal(38,0)").cast("string")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("NaN"))
            .when(x == INF, F.lit("Infinity")).when(x == -INF, F.lit("-Infinity"))
            .when(whole, F.floor(x).cast("string"))
            .when((F.abs(x) < 1e21) & (F.abs(x) >= 9.2e18), big)
            .when(java.contains("E") & ((F.abs(x) < 1e-6) | (F.abs(x) >= 1e21)), scientific)
            .when(java.contains("E"), plain)
            .otherwise(java))


@dataclass(frozen=True, eq=False)
class Value:
    """A column with its kind: number, string, boolean, date, array, struct or null."""

    js: "Js"
    col: Column
    dtype: T.DataType
    literal: object = None  # the Python value, where the column is a literal

    @property
    def kind(self) -> str:
        t = self.dtype
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "date"
        for cls, name in ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.ArrayType, "array"),
                          (T.StructType, "struct"), (T.NullType, "null")):
            if isinstance(t, cls):
                return name
        return "other"

    def __add__(self, o): return self.js.add(self, o)
    def __radd__(self, o): return self.js.add(self.js.of(o), self)
    def __sub__(self, o): return self.js.sub(self, o)
    def __rsub__(self, o): return self.js.sub(self.js.of(o), self)
    def __mul__(self, o): return self.js.mul(self, o)
    def __rmul__(self, o): return self.js.mul(self.js.of(o), self)
    def __truediv__(self, o): return self.js.div(self, o)
    def __rtruediv__(self, o): return self.js.div(self.js.of(o), self)
    def __mod__(self, o): return self.js.mod(self, o)
    def __pow__(self, o): return self.js.pow(self, o)
    def __neg__(self): return self.js.neg(self)
    def __pos__(self): return self.js.plus(self)
    def __lt__(self, o): return self.js.compare("<", self, o)
    def __le__(self, o): return self.js.compare("<=", self, o)
    def __gt__(self, o): return self.js.compare(">", self, o)
    def __ge__(self, o): return self.js.compare(">=", self, o)
    def __eq__(self, o): return self.js.compare("==", self, o)  # type: ignore[override]
    def __ne__(self, o): return self.js.compare("!=", self, o)  # type: ignore[override]
    def __getitem__(self, i): return self.js.index(self, i)
    __hash__ = None  # type: ignore[assignment]

    def member(self, name: str) -> "Value":
        if not isinstance(self.dtype, T.StructType):
            raise ValueError(f"no field {name!r} in a value of kind {self.kind}")
        return Value(self.js, self.col.getField(name), self.dtype[name].dataType)


DOUBLE, STRING, BOOL = T.DoubleType(), T.StringType(), T.BooleanType()


class Js:
    def __init__(self, df: DataFrame, semantics: str = "js"):
        if semantics not in ("js", "sql"):
            raise ValueError("semantics is 'js' or 'sql'")
        self.schema, self.exact = df.schema, semantics == "js"

    # -- values ---------------------------------------------------------------

    def field(self, name: str) -> Value:
        return Value(self, F.col(f"`{name}`"), self.schema[name].dataType)

    def of(self, v) -> Value:
        if isinstance(v, Value):
            return v
        if v is None:
            return Value(self, F.lit(None), T.NullType())
        if isinstance(v, bool):
            return Value(self, F.lit(v), BOOL, v)
        if isinstance(v, (int, float)):
            return Value(self, F.lit(float(v)), DOUBLE, float(v))
        if isinstance(v, str):
            return Value(self, F.lit(v), STRING, v)
        if isinstance(v, (list, tuple)):
            items = [self.of(x) for x in v]
            element = items[0].dtype if items else DOUBLE
            return Value(self, F.array(*[x.col for x in items]), T.ArrayType(element))
        raise ValueError(f"no value of {type(v).__name__}")

    def constant(self, name: str) -> Value:
        return self.of(CONSTANTS[name])

    def _n(self, c: Column) -> Value:
        return Value(self, c, DOUBLE)

    def _s(self, c: Column) -> Value:
        return Value(self, c, STRING)

    def _b(self, c: Column) -> Value:
        return Value(self, c, BOOL)

    # -- coercion -------------------------------------------------------------

    def raw_number(self, v) -> Column:
        """The number of a value, NULL staying NULL."""
        v = self.of(v)
        if v.kind == "string":
            return number_of_text(v.col) if self.exact else v.col.try_cast("double")
        if v.kind == "boolean":
            return F.when(v.col, F.lit(1.0)).when(~v.col, F.lit(0.0))
        if v.kind == "date":
            return F.unix_millis(self._timestamp(v)).cast("double")
        return v.col.cast("double")

    def num(self, v) -> Column:
        """A value in a numeric context: null is 0 in JavaScript."""
        c = self.raw_number(v)
        return F.coalesce(c, F.lit(0.0)) if self.exact and self.of(v).literal is None else c

    def string(self, v) -> Column:
        v = self.of(v)
        if not self.exact:
            return v.col.cast("string")
        if v.kind == "number":
            return F.coalesce(text_of_number(v.col), F.lit("null"))
        if v.kind == "null":
            return F.lit("null")
        return F.coalesce(v.col.cast("string"), F.lit("null"))

    def truthy(self, v) -> Column:
        v = self.of(v)
        return typed_truthy(v.col, v.dtype)

    def plus(self, v) -> Value:
        return self._n(self.num(v))

    def to_number(self, v) -> Value:
        """null and '' are null; otherwise Number(value)."""
        v = self.of(v)
        if not self.exact:
            return self._n(self.raw_number(v))
        empty = v.col.isNull() | (v.col == "") if v.kind == "string" else v.col.isNull()
        return self._n(F.when(empty, F.lit(None).cast("double")).otherwise(self.raw_number(v)))

    def to_string(self, v) -> Value:
        v = self.of(v)
        return self._s(F.when(v.col.isNotNull(), self.string(v)) if self.exact else self.string(v))

    def to_boolean(self, v) -> Value:
        """null and '' are null; 'false' and '0' are false."""
        v = self.of(v)
        if not self.exact:
            return self._b(self.truthy(v))
        if v.kind == "string":
            return self._b(F.when(v.col.isNull() | (v.col == ""), F.lit(None).cast("boolean"))
                           .when(v.col.isin("false", "0"), F.lit(False)).otherwise(self.truthy(v)))
        return self._b(F.when(v.col.isNotNull(), self.truthy(v)))

    def _timestamp(self, v) -> Column:
        """The instant of a date, or of epoch milliseconds."""
        v = self.of(v)
        if v.kind == "number":
            return F.timestamp_millis(self.num(v).cast("long"))
        if v.kind == "string":
            return F.try_to_timestamp(v.col)
        if isinstance(v.dtype, T.TimestampType):
            return v.col
        # Dates and zone-free timestamps are UTC, whatever the session's zone.
        return F.from_utc_timestamp(v.col.cast("timestamp"), F.current_timezone())

    def to_date(self, v) -> Value:
        v = self.of(v)
        c = F.when(v.col.isNotNull(), self._timestamp(v))
        return Value(self, c, T.TimestampType())

    def parse_float(self, v) -> Value:
        return self.plus(v)

    def parse_int(self, v) -> Value:
        return self.trunc(v)

    # -- type tests -------------------------------------------------------------

    def is_number(self, v) -> Value: return self.of(self.of(v).kind == "number")
    def is_string(self, v) -> Value: return self.of(self.of(v).kind == "string")
    def is_boolean(self, v) -> Value: return self.of(self.of(v).kind == "boolean")
    def is_date(self, v) -> Value: return self.of(self.of(v).kind == "date")
    def is_array(self, v) -> Value: return self.of(self.of(v).kind == "array")
    def is_object(self, v) -> Value: return self.of(False)
    def is_regexp(self, v) -> Value: return self.of(False)
    def is_defined(self, v) -> Value: return self.of(True)

    def is_valid(self, v) -> Value:
        v = self.of(v)
        ok = v.col.isNotNull()
        if isinstance(v.dtype, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(v.col)
        return self._b(ok)

    def is_nan(self, v) -> Value:
        return self._b(F.isnan(self.num(v)))

    def is_finite(self, v) -> Value:
        x = self.raw_number(v)
        return self._b(F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False)))

    # -- arithmetic --------------------------------------------------------------

    def add(self, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        if "string" in (a.kind, b.kind):
            return self._s(F.concat(self.string(a), self.string(b)))
        return self._n(self.num(a) + self.num(b))

    def sub(self, a, b) -> Value: return self._n(self.num(a) - self.num(b))
    def mul(self, a, b) -> Value: return self._n(self.num(a) * self.num(b))
    def neg(self, a) -> Value: return self._n(-self.num(a))

    def div(self, a, b) -> Value:
        x, y = self.num(a), self.num(b)
        if not self.exact:
            return self._n(F.try_divide(x, y))
        # The sign of a zero divisor shows only in its text.
        up = F.when(y.cast("string").startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))
        zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, up).otherwise(-up)
        # try_divide: the guarded branch may be computed before the test.
        return self._n(F.when(y == 0, zero).otherwise(F.try_divide(x, y)))

    def mod(self, a, b) -> Value:
        """The remainder keeps the dividend's sign."""
        x, y = self.num(a), self.num(b)
        safe = F.when(y == 0, F.lit(None).cast("double")).otherwise(y)
        if not self.exact:
            return self._n(x % safe)
        return self._n(F.when((y == 0) | F.isnan(x) | F.isnan(y) | (F.abs(x) == INF), F.lit(NAN))
                       .when(F.abs(y) == INF, x).otherwise(x % safe))

    def pow(self, a, b) -> Value:
        x, y = self.num(a), self.num(b)
        return self._n(F.when((F.abs(x) == 1) & (F.abs(y) == INF), F.lit(NAN)).otherwise(F.pow(x, y)) if self.exact else F.pow(x, y))

    def _int(self, v) -> Column:
        """ToInt32: truncated, modulo 2^32, NaN and infinities 0."""
        x = self.num(v)
        whole = F.when(F.abs(x) < INF, F.signum(x) * F.floor(F.abs(x))).otherwise(F.lit(0.0))
        wrapped = F.pmod(whole, F.lit(2.0**32))
        return F.when(wrapped >= 2.0**31, wrapped - 2.0**32).otherwise(wrapped).cast("int")

    def bit_and(self, a, b) -> Value: return self._n(self._int(a).bitwiseAND(self._int(b)).cast("double"))
    def bit_or(self, a, b) -> Value: return self._n(self._int(a).bitwiseOR(self._int(b)).cast("double"))
    def bit_xor(self, a, b) -> Value: return self._n(self._int(a).bitwiseXOR(self._int(b)).cast("double"))

    def _shift(self, name: str, a, b) -> Value:
        by = self._int(b).bitwiseAND(F.lit(31))
        return self._n(F.call_function(name, self._int(a), by).cast("double"))

    def shift_left(self, a, b) -> Value: return self._shift("shiftleft", a, b)
    def shift_right(self, a, b) -> Value: return self._shift("shiftright", a, b)

    # -- comparison and logic --------------------------------------------------------

    def compare(self, op: str, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        strict, op = op in ("===", "!=="), {"===": "==", "!==": "!="}.get(op, op)
        if strict and a.kind != b.kind and "null" not in (a.kind, b.kind) and "string" in (a.kind, b.kind):
            return self.of(op == "!=")
        fn = {"<": lambda l, r: l < r, "<=": lambda l, r: l <= r, ">": lambda l, r: l > r, ">=": lambda l, r: l >= r,
              "==": lambda l, r: l == r, "!=": lambda l, r: l != r}[op]
        if a.kind == b.kind and a.kind in ("string", "boolean"):
            out = fn(a.col, b.col)
            return self._b(F.coalesce(out, F.lit(False)) if self.exact else out)
        if not self.exact:
            return self._b(fn(self.num(a), self.num(b)))
        prunable = self._prunable(op, a, b)
        if prunable is not None:
            return self._b(prunable)
        l, r = self.num(a), self.num(b)
        nan = F.isnan(l) | F.isnan(r)
        return self._b((fn(l, r) | nan) if op == "!=" else (fn(l, r) & ~nan))

    def _prunable(self, op: str, a: Value, b: Value) -> Column | None:
        """`coalesce(x, 0) < c` hides x from file statistics. With a number on
        one side the same test is a comparison of the bare column, or NULL where
        0 passes, and not NaN: a form that reaches the Parquet reader."""
        swap = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}
        if isinstance(a.literal, float) and b.literal is None:
            if op not in swap:
                return None
            op, a, b = swap[op], b, a
        if not isinstance(b.literal, float) or a.literal is not None or op == "!=" or math.isnan(b.literal) or a.kind != "number":
            return None
        c, x = b.literal, a.col
        bare = {"<": x < c, "<=": x <= c, ">": x > c, ">=": x >= c, "==": x == c}[op]
        zero_passes = {"<": 0 < c, "<=": 0 <= c, ">": 0 > c, ">=": 0 >= c, "==": c == 0}[op]
        floating = isinstance(a.dtype, (T.DoubleType, T.FloatType))
        if zero_passes:
            bare = bare | x.isNull()
            # isnan is false for NULL, so the result is never NULL.
            return bare & ~F.isnan(x) if floating else bare
        bare = (bare & ~F.isnan(x)) if floating else bare
        return F.coalesce(bare, F.lit(False)) if not floating else bare & x.isNotNull()

    def and_(self, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        if a.kind == b.kind == "boolean":
            return self._b(a.col & b.col)
        return self._pick(F.when(self.truthy(a), self._common(b, a)).otherwise(self._common(a, b)), a, b)

    def or_(self, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        if a.kind == b.kind == "boolean":
            return self._b(a.col | b.col)
        return self._pick(F.when(self.truthy(a), self._common(a, b)).otherwise(self._common(b, a)), a, b)

    def coalesce(self, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        return self._pick(F.coalesce(self._common(a, b), self._common(b, a)), a, b)

    def not_(self, a) -> Value:
        return self._b(~self.truthy(a))

    def if_(self, test, a, b) -> Value:
        a, b = self.of(a), self.of(b)
        return self._pick(F.when(self.truthy(test), self._common(a, b)).otherwise(self._common(b, a)), a, b)

    def _common(self, v: Value, other: Value) -> Column:
        """Both branches need one type: mixed kinds meet as text."""
        if v.kind == other.kind or "null" in (v.kind, other.kind):
            return v.col.cast("double") if v.kind == "number" else v.col
        return F.when(v.col.isNotNull(), self.string(v))

    def _pick(self, c: Column, a: Value, b: Value) -> Value:
        kind = a if a.kind != "null" else b
        if a.kind != b.kind and "null" not in (a.kind, b.kind):
            return self._s(c)
        return self._n(c) if kind.kind == "number" else Value(self, c, kind.dtype)

    # -- mathematics ------------------------------------------------------------------

    def abs(self, v) -> Value: return self._n(F.abs(self.num(v)))
    def acos(self, v) -> Value: return self._n(F.acos(self.num(v)))
    def asin(self, v) -> Value: return self._n(F.asin(self.num(v)))
    def atan(self, v) -> Value: return self._n(F.atan(self.num(v)))
    def atan2(self, a, b) -> Value: return self._n(F.atan2(self.num(a), self.num(b)))
    def cos(self, v) -> Value: return self._n(F.cos(self.num(v)))
    def sin(self, v) -> Value: return self._n(F.sin(self.num(v)))
    def tan(self, v) -> Value: return self._n(F.tan(self.num(v)))
    def exp(self, v) -> Value: return self._n(F.exp(self.num(v)))
    def sqrt(self, v) -> Value: return self._n(F.sqrt(self.num(v)))
    def sign(self, v) -> Value: return self._n(F.signum(self.num(v)))
    def random(self) -> Value: return self._n(F.rand())

    def _whole(self, x: Column, f) -> Column:
        """floor and ceil return 64-bit integers in Spark; beyond them a double
        is whole already, and NaN and infinities stay."""
        return F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)

    def floor(self, v) -> Value: return self._n(self._whole(self.num(v), F.floor))
    def ceil(self, v) -> Value: return self._n(self._whole(self.num(v), F.ceil))

    def round(self, v) -> Value:
        x = self.num(v)
        if not self.exact:
            # Rounds by way of a decimal, which has no negative zero; what is below zero keeps its sign.
            return self._n(F.when((x < 0) & (x > -0.5), F.lit(-0.0)).otherwise(F.round(x)))
        return self._n(F.when(F.abs(x) < 2.0**52, F.floor(x + 0.5).cast("double")).otherwise(x))

    def trunc(self, v) -> Value:
        x = self.num(v)
        return self._n(F.when(x < 0, self._whole(x, F.ceil)).otherwise(self._whole(x, F.floor)))

    def log(self, v) -> Value:
        x = self.num(v)
        if not self.exact:
            return self._n(F.log(x))
        return self._n(F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(F.log(x)))

    def hypot(self, a, b) -> Value:
        x, y = self.num(a), self.num(b)
        return self._n(F.sqrt(x * x + y * y))

    def _extreme(self, fn, cols: list[Column]) -> Column:
        out = fn(*cols) if len(cols) > 1 else cols[0]
        if not self.exact:
            return out
        nan = F.lit(False)
        for c in cols:
            nan = nan | F.isnan(c)
        return F.when(nan, F.lit(NAN)).otherwise(out)

    def max(self, *vs) -> Value: return self._n(self._extreme(F.greatest, [self.num(v) for v in vs]))
    def min(self, *vs) -> Value: return self._n(self._extreme(F.least, [self.num(v) for v in vs]))

    def clamp(self, v, lo, hi) -> Value:
        held = self._extreme(F.least, [self.num(v), self.num(hi)])
        return self._n(self._extreme(F.greatest, [held, self.num(lo)]))

    # -- text -------------------------------------------------------------------------

    def length(self, v) -> Value:
        v = self.of(v)
        return self._n((F.size(v.col) if v.kind == "array" else F.length(self.string(v))).cast("double"))

    def upper(self, v) -> Value: return self._s(F.upper(self.string(v)))
    def lower(self, v) -> Value: return self._s(F.lower(self.string(v)))
    def trim(self, v) -> Value: return self._s(F.regexp_replace(self.string(v), TRIM, ""))

    def substring(self, v, start, end=None) -> Value:
        """By 0-based start and end; a start after the end swaps with it."""
        s = self.string(v)
        size = F.length(s)
        held = lambda x: F.greatest(F.lit(0), F.least(size, F.when(F.isnan(x), F.lit(0.0)).otherwise(x).cast("int")))
        a = held(F.least(self.num(start), F.lit(2e9)))
        b = size if end is None else held(F.least(self.num(end), F.lit(2e9)))
        lo, hi = F.least(a, b), F.greatest(a, b)
        return self._s(F.substring(s, lo + 1, hi - lo))

    def slice(self, v, start, end=None) -> Value:
        """As substring, with negative positions counted from the end."""
        s = self.string(v)
        size = F.length(s)
        at = lambda x: F.greatest(F.lit(0), F.least(size, F.when(x < 0, size + x).otherwise(x).cast("int")))
        a, b = at(self.num(start)), size if end is None else at(self.num(end))
        return self._s(F.substring(s, a + 1, F.greatest(b - a, F.lit(0))))

    def indexof(self, v, x) -> Value:
        v, x = self.of(v), self.of(x)
        if v.kind == "array":
            return self._n((F.array_position(v.col, x.col).cast("double") - 1))
        return self._n(F.instr(self.string(v), self.string(x)).cast("double") - 1)

    def replace(self, v, pattern, to) -> Value:
        """The first match of a literal pattern."""
        s, p, t = self.string(v), self.string(pattern), self.string(to)
        at = F.instr(s, p)
        return self._s(F.when(at == 0, s).otherwise(F.concat(
            F.substring(s, F.lit(1), at - 1), t, F.substring(s, at + F.length(p), F.length(s)))))

    def index(self, v, i) -> Value:
        v = self.of(v)
        element = v.dtype.elementType if isinstance(v.dtype, T.ArrayType) else STRING
        return Value(self, F.get(v.col, self.num(i).cast("int")), element)

    def inrange(self, v, bounds) -> Value:
        x, r = self.num(v), self.of(bounds)
        a, b = self._n(F.get(r.col, 0)), self._n(F.get(r.col, 1))
        lo, hi = F.least(self.num(a), self.num(b)), F.greatest(self.num(a), self.num(b))
        inside = (x >= lo) & (x <= hi)
        return self._b(inside & ~F.isnan(x) if self.exact else inside)

    # -- dates ------------------------------------------------------------------------

    def now(self) -> Value:
        return self._n(F.unix_millis(F.current_timestamp()).cast("double"))

    def time(self, v) -> Value:
        return self._n(F.unix_millis(self._timestamp(v)).cast("double"))

    def _part(self, v, fn) -> Value:
        return self._n(fn(formats.utc_wall(self._timestamp(v))).cast("double"))

    def year(self, v) -> Value: return self._part(v, F.year)
    def quarter(self, v) -> Value: return self._part(v, F.quarter)
    def month(self, v) -> Value: return self._part(v, lambda t: F.month(t) - 1)
    def date(self, v) -> Value: return self._part(v, F.dayofmonth)
    def day(self, v) -> Value: return self._part(v, lambda t: F.dayofweek(t) - 1)
    def dayofyear(self, v) -> Value: return self._part(v, F.dayofyear)
    def hours(self, v) -> Value: return self._part(v, F.hour)
    def minutes(self, v) -> Value: return self._part(v, F.minute)
    def seconds(self, v) -> Value: return self._part(v, F.second)
    def milliseconds(self, v) -> Value: return self._part(v, lambda t: F.pmod(F.unix_millis(t), F.lit(1000)))

    # -- formats ----------------------------------------------------------------------

    def format(self, v, spec: str) -> Value:
        out = formats.format_number(self.raw_number(v), spec)
        return self._s(F.coalesce(out, F.lit("null")) if self.exact else out)

    def time_format(self, v, spec: str) -> Value:
        v = self.of(v)
        out = F.when(v.col.isNotNull(), formats.format_time(self._timestamp(v), spec))
        return self._s(F.coalesce(out, F.lit("null")) if self.exact else out)

    utc_format = time_format
