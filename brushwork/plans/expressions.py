"""JavaScript-semantics expressions, number and date formats, over whole tables.

Numbers with NULL, NaN, infinities, zeros and negatives among them, and texts
with blanks, numbers in disguise and NULL, are derived from `events`. Doubles
that SQL cannot carry through a comparison (NaN, infinities) leave as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.js import Js, Value
from .data import load

ID = "event_id"


def _rows(spark, d):
    e = load(spark, d, "events")
    k, m = F.col(ID) % 12, F.col(ID) % 7
    a = (F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf")))
         .when(k == 3, F.lit(0.0)).when(k == 4, -F.col("value"))
         .when(k == 5, F.when(F.col("value") == 0, F.col("value")).otherwise(F.floor("value").cast("double")))  # -0 stays
         .when(k == 6, -F.floor("value") - 0.5).otherwise(F.col("value")))
    b = F.when(m == 0, F.lit(0.0)).when(m == 1, F.lit(None).cast("double")).when(m == 2, F.lit(-4.0)).otherwise((F.col("user_id") % 5 + 1).cast("double"))
    s = (F.when(k == 0, F.lit("")).when(k == 1, F.lit(" 5 ")).when(k == 2, F.lit("0")).when(k == 3, F.lit(None).cast("string"))
         .when(k == 4, F.lit("0x1f")).when(k == 5, F.lit("1e3")).when(k == 6, F.lit("-Infinity")).when(k == 7, F.lit("false"))
         .when(k == 8, F.lit("a.b.b")).otherwise(F.col("event_type")))
    f = F.when(m == 3, F.lit(None).cast("boolean")).otherwise(m > 3)
    return e.select(ID, "event_type", "value", "user_id", "ts", "props", a.alias("a"), b.alias("b"), s.alias("s"), f.alias("f"),
                    F.array(F.lit(2.0), F.lit(5.0), F.col("value")).alias("xs"), F.struct(F.col("value").alias("v"), F.col("event_type").alias("t")).alias("o"))


ROWS = """e AS (SELECT *, CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN -value
  WHEN 5 THEN floor(value) WHEN 6 THEN -floor(value) - 0.5 ELSE value END AS a,
  CASE event_id % 7 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN -4.0 ELSE user_id % 5 + 1 END AS b,
  CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' 5 ' WHEN 2 THEN '0' WHEN 3 THEN NULL WHEN 4 THEN '0x1f' WHEN 5 THEN '1e3' WHEN 6 THEN '-Infinity'
  WHEN 7 THEN 'false' WHEN 8 THEN 'a.b.b' ELSE event_type END AS s,
  CASE WHEN event_id % 7 = 3 THEN NULL ELSE event_id % 7 > 3 END AS f FROM events),
n AS (SELECT *, coalesce(a, 0) AS an, coalesce(b, 0) AS bn, CASE event_id % 12 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 5.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 31.0
  WHEN 5 THEN 1000.0 WHEN 6 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS sn FROM e)"""


def _show(v: Value):
    """A result as compared: numbers to 6 decimals, as text where not finite."""
    if v.kind != "number":
        return v.col
    return shown(v.col)


def shown(c):
    return (F.when(c.isNull(), F.lit("null")).when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("Infinity"))
            .when(c == float("-inf"), F.lit("-Infinity")).otherwise(F.round(c, 6).cast("decimal(38,6)").cast("string")))


def sql_shown(c):
    return (f"CASE WHEN ({c}) IS NULL THEN 'null' WHEN isnan({c}) THEN 'NaN' WHEN ({c}) = 'Infinity'::DOUBLE THEN 'Infinity' "
            f"WHEN ({c}) = '-Infinity'::DOUBLE THEN '-Infinity' ELSE CAST(CAST(round({c}, 6) AS DECIMAL(38,6)) AS VARCHAR) END")


def _query(exprs):
    def run(spark, d):
        df = _rows(spark, d)
        js = Js(df)
        cols = {name: _show(v) for name, v in exprs(js).items()}
        return df.select(ID, *[c.alias(n) for n, c in cols.items()])

    return run


INF = "'Infinity'::DOUBLE"
NAN = "'NaN'::DOUBLE"


def _arithmetic(js):
    a, b, s, f = (js.field(c) for c in "absf")
    return {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b, "mod": a % b, "neg": -a, "linear": a * 2 + 1, "by_zero": b / 0,
            "pow2": a ** 2, "flag": f + 1, "text_minus": s - 1, "plus_text": +s, "to_number": js.to_number(s)}


def sql_div(x, y):
    return (f"CASE WHEN {y} = 0 THEN CASE WHEN {x} = 0 OR isnan({x}) THEN {NAN} WHEN {x} > 0 THEN {INF} ELSE -{INF} END ELSE {x} / {y} END")


ARITHMETIC = {"add": "an + bn", "sub": "an - bn",
              "mul": f"CASE WHEN abs(an) = {INF} AND bn = 0 THEN {NAN} ELSE an * bn END", "div": sql_div("an", "bn"),
              "mod": f"CASE WHEN bn = 0 OR isnan(an) OR abs(an) = {INF} THEN {NAN} ELSE an - bn * trunc(an / bn) END", "neg": "-an", "linear": "an * 2 + 1",
              "by_zero": sql_div("bn", "0.0::DOUBLE"), "pow2": "an * an", "flag": "CASE WHEN f THEN 1.0::DOUBLE ELSE 0.0 END + 1",
              "text_minus": "sn - 1", "plus_text": "sn", "to_number": "CASE WHEN s IS NULL OR s = '' THEN NULL ELSE sn END"}


def _sql(exprs, plain=()):
    return f"WITH {ROWS} SELECT event_id, " + ", ".join(
        f'{e if n in plain else sql_shown(e)} AS "{n}"' for n, e in exprs.items()) + " FROM n"


def _compare(js):
    a, b, s, f = (js.field(c) for c in "absf")
    return {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b, "below": a < 5, "above": js.of(3) < a, "zero": a == 0,
            "text_eq": s == a, "text_strict": js.compare("===", s, a), "text_lt": s < "b", "not_a": js.not_(a), "not_s": js.not_(s),
            "valid_a": js.is_valid(a), "valid_s": js.is_valid(s), "finite": js.is_finite(a), "nan": js.is_nan(a), "truthy_f": js._b(js.truthy(f)),
            "inrange": js.inrange(a, [9, 2]), "bool_s": js.to_boolean(s), "is_number": js.is_number(a), "is_string": js.is_string(s),
            "is_date": js.is_date(js.field("ts")), "is_array": js.is_array(js.field("xs")), "defined": js.is_defined(a)}


def _guard(op, x="an", y="bn"):
    return f"(NOT isnan({x}) AND NOT isnan({y}) AND {x} {op} {y})"


COMPARE = {"lt": _guard("<"), "le": _guard("<="), "gt": _guard(">"), "ge": _guard(">="), "eq": _guard("="), "ne": "(isnan(an) OR isnan(bn) OR an <> bn)",
           "below": "(NOT isnan(an) AND an < 5)", "above": "(NOT isnan(an) AND an > 3)", "zero": "(an = 0)",
           "text_eq": _guard("=", "sn", "an"), "text_strict": "false", "text_lt": "coalesce(s < 'b', false)",
           "not_a": "(isnan(an) OR an = 0)", "not_s": "(s IS NULL OR s = '')", "valid_a": "(a IS NOT NULL AND NOT isnan(a))", "valid_s": "(s IS NOT NULL)",
           "finite": f"(a IS NOT NULL AND NOT isnan(a) AND abs(a) < {INF})", "nan": "isnan(an)", "truthy_f": "coalesce(f, false)",
           "inrange": "(NOT isnan(an) AND an >= 2 AND an <= 9)", "bool_s": "CASE WHEN s IS NULL OR s = '' THEN NULL WHEN s IN ('false', '0') THEN false ELSE true END",
           "is_number": "true", "is_string": "true", "is_date": "true", "is_array": "true", "defined": "true"}


def _logic(js):
    a, b, s, f = (js.field(c) for c in "absf")
    return {"and": js.and_(a, b), "or": js.or_(a, b), "or_text": js.or_(s, "empty"), "nullish": js.coalesce(b, -1), "cond": js.if_(a, "yes", "no"),
            "cond_s": js.if_(s, 1, 0), "cond_f": js.if_(f, 1, 0), "big": js.if_(a > 1, "big", "small")}


LOGIC = {"and": "CASE WHEN an = 0 OR isnan(an) THEN a ELSE b END", "or": "CASE WHEN an = 0 OR isnan(an) THEN b ELSE a END",
         "or_text": "CASE WHEN s IS NULL OR s = '' THEN 'empty' ELSE s END", "nullish": "coalesce(b, -1)",
         "cond": "CASE WHEN an = 0 OR isnan(an) THEN 'no' ELSE 'yes' END", "cond_s": "CASE WHEN s IS NULL OR s = '' THEN 0.0 ELSE 1.0 END",
         "cond_f": "CASE WHEN f THEN 1.0 ELSE 0.0 END", "big": "CASE WHEN NOT isnan(an) AND an > 1 THEN 'big' ELSE 'small' END"}


def _math(js):
    a, b, v = js.field("a"), js.field("b"), js.field("value")
    u = js.field("user_id")
    return {"round": js.round(a), "floor": js.floor(a), "ceil": js.ceil(a), "trunc": js.trunc(a), "abs": js.abs(a), "sign": js.sign(b), "log": js.log(a),
            "sqrt": js.sqrt(a), "exp": js.exp(b), "pow": js.pow(v, 0.5), "max": js.max(a, b), "min": js.min(a, b), "clamp": js.clamp(a, 0, 2),
            "hypot": js.hypot(v, b), "sin": js.sin(v), "cos": js.cos(v), "tan": js.tan(b), "atan": js.atan(v), "atan2": js.atan2(v, b),
            "asin": js.asin(v / 500), "acos": js.acos(v / 500), "and": js.bit_and(u, 13), "or": js.bit_or(u, 5), "xor": js.bit_xor(u, 1023),
            "left": js.shift_left(u, 3), "right": js.shift_right(-u, 2), "int": js.parse_int(a), "float": js.parse_float(b),
            "pi": js.constant("PI") * 2, "sqrt2": js.constant("SQRT2") + js.constant("LN10")}


def _whole(f):
    return f"CASE WHEN isnan(an) OR abs(an) = {INF} THEN an ELSE {f} END"


MATH = {"round": _whole("floor(an + 0.5)"), "floor": _whole("floor(an)"), "ceil": _whole("ceil(an)"), "trunc": _whole("trunc(an)"), "abs": "abs(an)",
        "sign": "sign(bn)::DOUBLE", "log": f"CASE WHEN an = 0 THEN -{INF} WHEN isnan(an) OR an < 0 THEN {NAN} ELSE ln(CASE WHEN an > 0 THEN an ELSE 1 END) END",
        "sqrt": f"CASE WHEN isnan(an) OR an < 0 THEN {NAN} ELSE sqrt(CASE WHEN an >= 0 THEN an ELSE 0 END) END", "exp": "exp(bn)", "pow": "sqrt(value)",
        "max": f"CASE WHEN isnan(an) THEN {NAN} ELSE greatest(an, bn) END", "min": f"CASE WHEN isnan(an) THEN {NAN} ELSE least(an, bn) END",
        "clamp": f"CASE WHEN isnan(an) THEN {NAN} ELSE greatest(0.0, least(an, 2.0)) END", "hypot": "sqrt(value * value + bn * bn)",
        "sin": "sin(value)", "cos": "cos(value)", "tan": "tan(bn)", "atan": "atan(value)", "atan2": "atan2(value, bn)",
        "asin": f"CASE WHEN value > 500 THEN {NAN} ELSE asin(least(value, 500) / 500) END", "acos": f"CASE WHEN value > 500 THEN {NAN} ELSE acos(least(value, 500) / 500) END",
        "and": "(user_id & 13)::DOUBLE", "or": "(user_id | 5)::DOUBLE", "xor": "xor(user_id, 1023)::DOUBLE", "left": "(user_id * 8)::DOUBLE",
        "right": "floor(-user_id / 4.0)::DOUBLE", "int": _whole("trunc(an)"), "float": "bn", "pi": "2 * pi()", "sqrt2": "sqrt(2) + ln(10)"}


def _text(js):
    s, a, e = js.field("s"), js.field("a"), js.field("event_type")
    xs, o = js.field("xs"), js.field("o")
    return {"join": s + a, "label": js.of("n=") + a, "flag": js.of("v") + js.field("f"), "string_a": js.to_string(a), "upper": js.upper(s), "lower": js.lower(s),
            "trim": js.trim(s), "length": js.length(e), "part": js.substring(s, 0, 2), "swapped": js.substring(e, 3, 1), "tail": js.slice(e, -3),
            "at": js.indexof(e, "i"), "replaced": js.replace(s, "b", "B"), "dots": js.replace(s, ".", "-"), "size": js.length(xs), "second": xs[1], "outside": xs[7],
            "where": js.indexof(xs, 5), "member": o.member("v"), "member_text": o.member("t")}


NUM_TEXT = ("CASE WHEN a IS NULL THEN 'null' WHEN isnan(a) THEN 'NaN' WHEN a = 'Infinity'::DOUBLE THEN 'Infinity' WHEN a = floor(a) THEN CAST(a AS BIGINT)::VARCHAR "
            "ELSE a::VARCHAR END")
TEXT = {"join": f"coalesce(s, 'null') || {NUM_TEXT}", "label": f"'n=' || {NUM_TEXT}", "flag": "'v' || CASE WHEN f IS NULL THEN 'null' WHEN f THEN 'true' ELSE 'false' END",
        "string_a": f"CASE WHEN a IS NOT NULL THEN {NUM_TEXT} END", "upper": "upper(coalesce(s, 'null'))", "lower": "lower(coalesce(s, 'null'))",
        "trim": "trim(coalesce(s, 'null'))", "length": "length(event_type)::DOUBLE", "part": "substr(coalesce(s, 'null'), 1, 2)", "swapped": "substr(event_type, 2, 2)",
        "tail": "right(event_type, 3)", "at": "(instr(event_type, 'i') - 1)::DOUBLE",
        "replaced": "regexp_replace(coalesce(s, 'null'), 'b', 'B')", "dots": "regexp_replace(coalesce(s, 'null'), '\\.', '-')",
        "size": "3.0::DOUBLE", "second": "5.0::DOUBLE", "outside": "NULL::DOUBLE", "where": "CASE WHEN value = 5 THEN 1.0 ELSE 1.0 END", "member": "value",
        "member_text": "event_type"}


def _dates(js):
    t, v = js.field("ts"), js.field("value")
    ms = js.time(t)
    return {"year": js.year(t), "quarter": js.quarter(t), "month": js.month(t), "date": js.date(t), "day": js.day(t), "doy": js.dayofyear(t), "hours": js.hours(t),
            "minutes": js.minutes(t), "seconds": js.seconds(t), "ms": js.milliseconds(t), "time": js.to_string(ms), "thousandth": t / 1000, "year_of_number": js.year(ms),
            "shown": js.time_format(t, "%Y-%m-%d %H:%M:%S"), "slashes": js.utc_format(ms, "%d/%m/%Y"), "null_year": js.year(js.field("b")),
            "epoch": js.time_format(v, "%Y")}


MS = "floor(epoch_us(ts) / 1000)"
DATES = {"year": "year(ts)::DOUBLE", "quarter": "quarter(ts)::DOUBLE", "month": "(month(ts) - 1)::DOUBLE", "date": "day(ts)::DOUBLE", "day": "dayofweek(ts)::DOUBLE",
         "doy": "dayofyear(ts)::DOUBLE", "hours": "hour(ts)::DOUBLE", "minutes": "minute(ts)::DOUBLE", "seconds": "floor(epoch_us(ts) / 1000000) % 60",
         "ms": f"{MS} % 1000", "time": f"CAST({MS} AS BIGINT)::VARCHAR", "thousandth": f"{MS}::DOUBLE / 1000", "year_of_number": "year(ts)::DOUBLE",
         "shown": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "slashes": "strftime(ts, '%d/%m/%Y')",
         "null_year": "CASE WHEN bn < 0 THEN 1969.0::DOUBLE ELSE 1970.0 END", "epoch": "'1970'"}


def _formats(js):
    a, v = js.field("a"), js.field("value")
    big = v * 12345
    return {"fixed": js.format(a, ",.2f"), "percent": js.format(a, ".1%"), "whole": js.format(js.floor(big), ",d"), "plain": js.format(js.floor(big), "d"),
            "long": js.format(js.floor(big) / 8, ",.3f"), "half": js.format(js.floor(v) / 2, ".0f")}


def sql_fixed(x, n, group=True, scale=1, suffix=""):
    """Fixed decimals from the decimal text of a value that has few."""
    t = f"abs(CAST({x} AS DECIMAL(30, 6)) * {scale})"
    r = f"CAST(floor({t} * {10 ** n} + 0.5) AS BIGINT)"
    whole = f"CAST({r} // {10 ** n} AS BIGINT)"
    lead = f"format('{{:,}}', {whole})" if group else f"{whole}::VARCHAR"
    tail = f" || '.' || lpad(({r} % {10 ** n})::VARCHAR, {n}, '0')" if n else ""
    return f"CASE WHEN {x} < 0 AND {r} > 0 THEN '−' ELSE '' END || {lead}{tail} || '{suffix}'"


def _special(x, body, nan):
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN isnan({x}) THEN '{nan}' WHEN {x} = {INF} THEN 'Infinity{nan[3:]}' ELSE {body} END"


FINITE_A = f"CASE WHEN a IS NULL OR isnan(a) OR a = {INF} THEN 0 ELSE a END"
BIG = "(value * 12345)"
FORMATS = {"fixed": _special("a", sql_fixed(f"({FINITE_A})", 2), "NaN"), "percent": _special("a", sql_fixed(f"({FINITE_A})", 1, False, 100, "%"), "NaN%"),
           "whole": sql_fixed(f"floor({BIG})", 0), "plain": sql_fixed(f"floor({BIG})", 0, False), "long": sql_fixed(f"(floor({BIG}) / 8)", 3),
           "half": sql_fixed("(floor(value) / 2)", 0, False)}


def js_filter(spark, d):
    """A comparison in JavaScript semantics as a filter that the scan can prune by."""
    df = load(spark, d, "events")
    js = Js(df)
    p = js.and_(js.field("value") < 20, js.field("value") >= 3.5)
    return df.where(p.col).groupBy("event_type").agg(F.count("*").alias("n"))


def sql_semantics(spark, d):
    """The same expressions with SQL semantics: NULLs stay NULL."""
    df = _rows(spark, d)
    js = Js(df, "sql")
    a, b = js.field("a"), js.field("b")
    return df.select(ID, (a + b).col.alias("add"), shown((a / b).col).alias("div"), (a < b).col.alias("lt"), js.max(a, b).col.alias("max"),
                     js.round(a).col.alias("round"), js.to_number(js.field("s")).col.isNull().alias("no_number"))


SQL_SEMANTICS = f"""WITH {ROWS} SELECT event_id, a + b AS add, {sql_shown('a / nullif(b, 0)')} AS div, a < b AS lt,
greatest(coalesce(a, b), coalesce(b, a)) AS max, CASE WHEN a < 0 THEN -floor(-a + 0.5) ELSE floor(a + 0.5) END AS round,
TRY_CAST(CASE WHEN s IN ('0x1f') THEN 'x' ELSE nullif(s, '') END AS DOUBLE) IS NULL AS no_number FROM n"""

QUERIES = {
    "js_arithmetic": (_query(_arithmetic), _sql(ARITHMETIC)),
    "js_compare": (_query(_compare), _sql(COMPARE, COMPARE)),
    "js_logic": (_query(_logic), _sql(LOGIC, ("or_text", "cond", "big"))),
    "js_math": (_query(_math), _sql(MATH)),
    "js_text": (_query(_text), _sql(TEXT, set(TEXT) - {"length", "at", "size", "second", "outside", "where", "member"})),
    "js_dates": (_query(_dates), _sql(DATES, ("shown", "slashes", "epoch", "time"))),
    "js_formats": (_query(_formats), _sql(FORMATS, FORMATS)),
    "js_filter": (js_filter, "SELECT event_type, count(*) AS n FROM events WHERE value < 20 AND value >= 3.5 GROUP BY 1"),
    "sql_semantics": (sql_semantics, SQL_SEMANTICS),
}
