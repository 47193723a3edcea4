"""JavaScript semantics: 52 expressions over 8 rows, expected values by the
language's own rules."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brushwork.functions import formats
from brushwork.functions.js import Js, text_of_number

NAN, INF = math.nan, math.inf
SCHEMA = "id int, a double, b double, s string, f boolean, t timestamp"
ROWS = [
    (0, 1.5, 2.0, "abc", True, datetime(2024, 3, 1, 12, 30, 5)),
    (1, 0.0, 0.0, "", False, datetime(1970, 1, 1)),
    (2, -2.5, 4.0, " 5 ", True, datetime(1999, 12, 31, 23, 59, 59)),
    (3, -3.0, 1.0, None, None, None),
    (4, NAN, 1.0, "0", False, datetime(2000, 2, 29)),
    (5, None, None, "b", True, datetime(2024, 12, 31)),
    (6, INF, -1.0, "bob", False, datetime(2010, 6, 15, 6)),
    (7, 1234.5, 0.0, "false", None, datetime(2023, 1, 1)),
]
MS = [1709296205000.0, 0.0, 946684799000.0, 0.0, 951782400000.0, 1735603200000.0, 1276581600000.0, 1672531200000.0]


@pytest.fixture(scope="module")
def js(spark):
    return Js(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CASES = {
    "a + b": (lambda j, a, b, s, f, t: a + b, [3.5, 0, 1.5, -2, NAN, 0, INF, 1234.5]),
    "a / b": (lambda j, a, b, s, f, t: a / b, [0.75, NAN, -0.625, -3, NAN, NAN, -INF, INF]),
    "a % b": (lambda j, a, b, s, f, t: a % b, [1.5, NAN, -2.5, 0, NAN, NAN, NAN, NAN]),
    "-a": (lambda j, a, b, s, f, t: -a, [-1.5, 0, 2.5, 3, NAN, 0, -INF, -1234.5]),
    "a * 2 + 1": (lambda j, a, b, s, f, t: a * 2 + 1, [4, 1, -4, -5, NAN, 1, INF, 2470]),
    "b / 0": (lambda j, a, b, s, f, t: b / 0, [INF, NAN, INF, INF, INF, NAN, -INF, NAN]),
    "t / 1000": (lambda j, a, b, s, f, t: t / 1000, [m / 1000 for m in MS]),
    "s + a": (lambda j, a, b, s, f, t: s + a, ["abc1.5", "0", " 5 -2.5", "null-3", "0NaN", "bnull", "bobInfinity", "false1234.5"]),
    "'n=' + a": (lambda j, a, b, s, f, t: j.of("n=") + a, ["n=1.5", "n=0", "n=-2.5", "n=-3", "n=NaN", "n=null", "n=Infinity", "n=1234.5"]),
    "a + s": (lambda j, a, b, s, f, t: a + s, ["1.5abc", "0", "-2.5 5 ", "-3null", "NaN0", "nullb", "Infinitybob", "1234.5false"]),
    "'v' + f": (lambda j, a, b, s, f, t: j.of("v") + f, ["vtrue", "vfalse", "vtrue", "vnull", "vfalse", "vtrue", "vfalse", "vnull"]),
    "a == b": (lambda j, a, b, s, f, t: a == b, [False, True, False, False, False, True, False, False]),
    "s == a": (lambda j, a, b, s, f, t: s == a, [False, True, False, False, False, False, False, False]),
    "s === a": (lambda j, a, b, s, f, t: j.compare("===", s, a), [False] * 8),
    "a < b": (lambda j, a, b, s, f, t: a < b, [True, False, True, True, False, False, False, False]),
    "s < 'b'": (lambda j, a, b, s, f, t: s < "b", [True, True, True, False, True, False, False, False]),
    "a ? yes : no": (lambda j, a, b, s, f, t: j.if_(a, "yes", "no"), ["yes", "no", "yes", "yes", "no", "no", "yes", "yes"]),
    "s ? yes : no": (lambda j, a, b, s, f, t: j.if_(s, "yes", "no"), ["yes", "no", "yes", "no", "yes", "yes", "yes", "yes"]),
    "f ? 1 : 0": (lambda j, a, b, s, f, t: j.if_(f, 1, 0), [1, 0, 1, 0, 0, 1, 0, 0]),
    "!a": (lambda j, a, b, s, f, t: j.not_(a), [False, True, False, False, True, True, False, False]),
    "a && b": (lambda j, a, b, s, f, t: j.and_(a, b), [2, 0, 4, 1, NAN, None, -1, 0]),
    "a || b": (lambda j, a, b, s, f, t: j.or_(a, b), [1.5, 0, -2.5, -3, 1, None, INF, 1234.5]),
    "s || 'empty'": (lambda j, a, b, s, f, t: j.or_(s, "empty"), ["abc", "empty", " 5 ", "empty", "0", "b", "bob", "false"]),
    "isValid(a)": (lambda j, a, b, s, f, t: j.is_valid(a), [True, True, True, True, False, False, True, True]),
    "isValid(s)": (lambda j, a, b, s, f, t: j.is_valid(s), [True, True, True, False, True, True, True, True]),
    "isFinite(a)": (lambda j, a, b, s, f, t: j.is_finite(a), [True, True, True, True, False, False, False, True]),
    "isNaN(a)": (lambda j, a, b, s, f, t: j.is_nan(a), [False, False, False, False, True, False, False, False]),
    "toNumber(s)": (lambda j, a, b, s, f, t: j.to_number(s), [NAN, None, 5, None, 0, NAN, NAN, NAN]),
    "+s": (lambda j, a, b, s, f, t: +s, [NAN, 0, 5, 0, 0, NAN, NAN, NAN]),
    "toString(a)": (lambda j, a, b, s, f, t: j.to_string(a), ["1.5", "0", "-2.5", "-3", "NaN", None, "Infinity", "1234.5"]),
    "toBoolean(s)": (lambda j, a, b, s, f, t: j.to_boolean(s), [True, None, True, None, False, True, True, False]),
    "round(a)": (lambda j, a, b, s, f, t: j.round(a), [2, 0, -2, -3, NAN, 0, INF, 1235]),
    "floor(a)": (lambda j, a, b, s, f, t: j.floor(a), [1, 0, -3, -3, NAN, 0, INF, 1234]),
    "log(a)": (lambda j, a, b, s, f, t: j.log(a), [math.log(1.5), -INF, NAN, NAN, NAN, -INF, INF, math.log(1234.5)]),
    "sqrt(a)": (lambda j, a, b, s, f, t: j.sqrt(a), [math.sqrt(1.5), 0, NAN, NAN, NAN, 0, INF, math.sqrt(1234.5)]),
    "pow(a, 2)": (lambda j, a, b, s, f, t: j.pow(a, 2), [2.25, 0, 6.25, 9, NAN, 0, INF, 1523990.25]),
    "max(a, b)": (lambda j, a, b, s, f, t: j.max(a, b), [2, 0, 4, 1, NAN, 0, INF, 1234.5]),
    "min(a, b)": (lambda j, a, b, s, f, t: j.min(a, b), [1.5, 0, -2.5, -3, NAN, 0, -1, 0]),
    "clamp(a, 0, 2)": (lambda j, a, b, s, f, t: j.clamp(a, 0, 2), [1.5, 0, 0, 0, NAN, 0, 2, 2]),
    "abs(a)": (lambda j, a, b, s, f, t: j.abs(a), [1.5, 0, 2.5, 3, NAN, 0, INF, 1234.5]),
    "upper(s)": (lambda j, a, b, s, f, t: j.upper(s), ["ABC", "", " 5 ", "NULL", "0", "B", "BOB", "FALSE"]),
    "length(s)": (lambda j, a, b, s, f, t: j.length(s), [3, 0, 3, 4, 1, 1, 3, 5]),
    "substring(s, 0, 2)": (lambda j, a, b, s, f, t: j.substring(s, 0, 2), ["ab", "", " 5", "nu", "0", "b", "bo", "fa"]),
    "indexof(s, 'b')": (lambda j, a, b, s, f, t: j.indexof(s, "b"), [1, -1, -1, -1, -1, 0, 0, -1]),
    "replace(s, 'b', 'B')": (lambda j, a, b, s, f, t: j.replace(s, "b", "B"), ["aBc", "", " 5 ", "null", "0", "B", "Bob", "false"]),
    "if(a > 1, ...)": (lambda j, a, b, s, f, t: j.if_(a > 1, "big", "small"), ["big", "small", "small", "small", "small", "small", "big", "big"]),
    "inrange(a, [0, 2])": (lambda j, a, b, s, f, t: j.inrange(a, [0, 2]), [True, True, False, False, False, True, False, False]),
    "format(a, ',.2f')": (lambda j, a, b, s, f, t: j.format(a, ",.2f"), ["1.50", "0.00", "−2.50", "−3.00", "NaN", "null", "Infinity", "1,234.50"]),
    "format(a, '.1%')": (lambda j, a, b, s, f, t: j.format(a, ".1%"), ["150.0%", "0.0%", "−250.0%", "−300.0%", "NaN%", "null", "Infinity%", "123450.0%"]),
    "timeFormat(t)": (lambda j, a, b, s, f, t: j.time_format(t, "%Y-%m-%d"), ["2024-03-01", "1970-01-01", "1999-12-31", "null", "2000-02-29", "2024-12-31", "2010-06-15", "2023-01-01"]),
    "year(t)": (lambda j, a, b, s, f, t: j.year(t), [2024, 1970, 1999, None, 2000, 2024, 2010, 2023]),
    "month(t)": (lambda j, a, b, s, f, t: j.month(t), [2, 0, 11, None, 1, 11, 5, 0]),
}


def same(got, want):
    if isinstance(want, float) and math.isnan(want):
        return isinstance(got, float) and math.isnan(got)
    if isinstance(want, float) and math.isfinite(want):
        return got is not None and math.isclose(got, want, rel_tol=1e-15)
    return got == want and (got is None) == (want is None)


def test_fifty_two_expressions(data, js):
    args = [js.field(c) for c in "absft"]
    cols = [fn(js, *args).col.alias(f"c{i}") for i, (fn, _) in enumerate(CASES.values())]
    rows = data.select("id", *cols).orderBy("id").collect()
    assert len(CASES) == 52
    wrong = [(name, k, rows[k][f"c{i}"], want[k]) for i, (name, (_, want)) in enumerate(CASES.items()) for k in range(8)
             if not same(rows[k][f"c{i}"], want[k])]
    assert not wrong, wrong


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("x, want", [(1e21, "1e+21"), (1e20, "100000000000000000000"), (123456789.25, "123456789.25"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"),
                                     (0.0001234, "0.0001234"), (-0.0, "0"), (1e300, "1e+300"), (12345678.9, "12345678.9"), (2.0**53, "9007199254740992"), (0.1, "0.1")])
def test_number_text(spark, x, want):
    assert one(spark, text_of_number(F.lit(x))) == want


@pytest.mark.parametrize("text, want", [("0x1F", 31.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("+7", 7.0), ("1e", NAN), ("1_000", NAN), ("Infinity", INF), ("infinity", NAN), ("\t 2\n", 2.0),
                                        ("1,5", NAN), ("12abc", NAN), ("NaN", NAN), ("1d", NAN), ("0x", NAN), ("--1", NAN), ("-0", 0.0)])
def test_text_to_number(spark, js, text, want):
    assert same(one(spark, js.raw_number(js.of(text))), want)


@pytest.mark.parametrize("x, spec, want", [(0.125, ".2f", "0.13"), (1.005, ".2f", "1.00"), (2.5, ".0f", "3"), (-2.5, ".0f", "−3"), (2.675, ".2f", "2.67"), (-0.001, ".2f", "0.00"),
                                           (1234567.891, ",.1f", "1,234,567.9"), (0.285, ".1%", "28.5%"), (99.5, "d", "100"), (1e6, ",d", "1,000,000"), (1234.5, ".2f", "1234.50")])
def test_number_formats(spark, x, spec, want):
    assert one(spark, formats.format_number(F.lit(x), spec)) == want


def test_other_formats_are_refused():
    for bad in ("s", ".2e", "$,.2f", ",.2d", "", "+.1f"):
        with pytest.raises(ValueError):
            formats.format_number(F.lit(1.0), bad)
    for bad in ("%b", "%j", "%"):
        with pytest.raises(ValueError):
            formats.date_pattern(bad)
    assert formats.date_pattern("%d.%m.%Y o'clock %H%%") == "dd'.'MM'.'yyyy' o''clock 'HH'%'"


def test_bits_and_arrays(spark, js):
    n = lambda v: one(spark, v.col)
    assert n(js.bit_or(js.of(2.0**32 + 5), 0)) == 5.0 and n(js.shift_left(1, 31)) == -(2.0**31) and n(js.bit_and(NAN, 7)) == 0.0
    assert n(js.shift_right(-8, 1)) == -4.0 and n(js.bit_xor(5.9, 1)) == 4.0 and n(js.trunc(-2.7)) == -2.0
    xs = js.of([3.0, 1.0, 2.0])
    assert n(xs[0]) == 3.0 and n(xs[9]) is None and n(js.indexof(xs, 2)) == 2.0 and n(js.indexof(xs, 8)) == -1.0 and n(js.length(xs)) == 3.0
    assert n(js.inrange(5, [9, 2])) is True and n(js.slice("hello", -3, -1)) == "ll" and n(js.substring("hello", 3, 1)) == "el"
    assert n(js.of(1) / js.of(-0.0)) == -INF and n(js.constant("SQRT2") * js.constant("SQRT1_2")) == pytest.approx(1)


def test_struct_members_and_kinds(spark):
    df = spark.sql("SELECT named_struct('a', named_struct('b', 4D)) AS o, array(1D) AS xs, date'2024-05-06' AS d, timestamp_ntz'2024-05-06 07:08:09.123' AS n, true AS f")
    j = Js(df)
    assert df.select(j.field("o").member("a").member("b").col).first()[0] == 4.0
    kinds = {c: j.field(c).kind for c in df.columns}
    assert kinds == {"o": "struct", "xs": "array", "d": "date", "n": "date", "f": "boolean"}
    n = j.field("n")
    parts = [j.hours(n), j.minutes(n), j.seconds(n), j.milliseconds(n), j.day(n), j.date(n), j.quarter(n), j.dayofyear(n), j.time(n), j.day(j.field("d"))]
    assert list(df.select(*[p.col.alias(f"p{i}") for i, p in enumerate(parts)]).first()) == [7, 8, 9, 123, 1, 6, 2, 127, 1714979289123.0, 1]


def test_dates_do_not_depend_on_the_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_ntz'2024-01-01 02:00:00' AS n, 1704074400000D AS ms")
        j = Js(df)
        got = df.select(j.hours(j.field("n")).col, j.hours(j.field("ms")).col, j.time(j.field("n")).col, j.time_format(j.field("ms"), "%Y-%m-%d %H").col).first()
        assert tuple(got) == (2.0, 2.0, 1704074400000.0, "2024-01-01 02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sql_semantics_keep_nulls(spark):
    df = spark.createDataFrame([(None, 2.0), (6.0, 0.0)], "a double, b double")
    j = Js(df, "sql")
    a, b = j.field("a"), j.field("b")
    assert [tuple(r) for r in df.select((a + b).col, (a / b).col, (a < b).col).collect()] == [(None, None, None), (6.0, None, False)]
    with pytest.raises(ValueError):
        Js(df, "es5")


def test_comparison_with_a_number_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") * 1.0).alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    j = Js(df)
    x = j.field("x")
    for p, n, needle in ((x < 5, 104, "Or(LessThan(x,5.0),IsNull(x))"), (x > 990, 9, "GreaterThan(x,990.0)"), (j.of(990) < x, 9, "GreaterThan(x,990.0)"), (x == 0, 100, "EqualTo(x,0.0)")):
        kept = df.where(p.col)
        assert kept.count() == n and needle in kept._jdf.queryExecution().executedPlan().toString()
    assert df.select((x < 5).col.alias("p")).where("p IS NULL").count() == 0
    assert isinstance(df.select(x.col).schema[0].dataType, T.DoubleType)
