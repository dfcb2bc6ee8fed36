"""XPath 1.0 values as Columns: doubles, strings and booleans that are never null.

semantics "xpath1" follows the recommendation; "compat" has floored mod, rounding half away from zero, sequential
translate, and exact lang.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
_NUMBER = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"


def lit(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else F.lit(x)


def str_of_number(x: Column) -> Column:
    """Decimal text: whole numbers without a point, NaN, Infinity, never an exponent."""
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 9e15)
    plain = F.regexp_replace(F.regexp_replace(F.when(F.abs(x) < 1, F.format_string("%.25f", x)).otherwise(F.format_string("%.1f", x)), r"0+$", ""), r"\.$", "")
    return F.when(F.isnan(x), "NaN").when(x == INF, "Infinity").when(x == -INF, "-Infinity").when(whole, x.cast("bigint").cast("string")).otherwise(F.when(x.cast("string").contains("E"), plain).otherwise(x.cast("string")))


def number_of_str(s: Column) -> Column:
    """What the text says if it is a plain decimal number, with white space around; else NaN."""
    return F.when(s.rlike(_NUMBER), F.trim(F.regexp_replace(s, r"[ \t\r\n]", "")).try_cast("double")).otherwise(F.lit(NAN))


def to_number(x: Column, kind: str) -> Column:
    if kind == "number":
        return x
    return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0)) if kind == "boolean" else F.coalesce(number_of_str(x), F.lit(NAN))


def to_string(x: Column, kind: str) -> Column:
    if kind == "string":
        return x
    return F.when(x, F.lit("true")).otherwise(F.lit("false")) if kind == "boolean" else str_of_number(x)


def to_boolean(x: Column, kind: str) -> Column:
    if kind == "boolean":
        return x
    return (F.length(x) > 0) if kind == "string" else ((x != 0.0) & ~F.isnan(x))


def compare(op: str, a: Column, b: Column) -> Column:
    """Of two numbers; NaN is unlike everything, itself included."""
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    result = {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return ~nan & result


def divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column, compat: bool = False) -> Column:
    """Remainder with the sign of a; with compat that of b."""
    d = F.when(b != 0, b)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(a - d * F.floor(a / d).cast("double") if compat else a % d)


def _whole(x: Column, f) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 9e15), x).otherwise(f(F.when(~F.isnan(x) & (F.abs(x) < 9e15), x)).cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceiling(x: Column) -> Column:
    return _whole(x, F.ceil)


def round_(x: Column, compat: bool = False) -> Column:
    """The nearest whole number; halves go up, with compat away from zero."""
    return _whole(x, lambda v: F.round(v) if compat else F.floor(v + 0.5))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """The characters at positions p with round(start) <= p < round(start) + round(length)."""
    r = round_(start)
    stop = (r + round_(length)) if length is not None else F.lit(INF)
    bad = F.isnan(r) | F.isnan(stop)
    low = F.greatest(F.coalesce(r, F.lit(1.0)), F.lit(1.0))
    n = F.greatest(F.least(stop, F.lit(2e9)) - low, F.lit(0.0))
    ok = ~bad & (low < 2e9)
    return F.when(ok, F.substr(s, F.when(ok, low).cast("int"), F.when(ok, n).cast("int"))).otherwise(F.lit(""))


def substring_before(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(F.lit(""))


def substring_after(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(at > 0, F.substr(s, at + F.char_length(t))).otherwise(F.lit(""))


def string_length(s: Column) -> Column:
    return F.char_length(s).cast("double")


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def translate(s: Column, source: str, target: str, compat: bool = False) -> Column:
    """Each character of source by that in its place in target, or by none; compat replaces one after the other."""
    if compat:
        for k, c in enumerate(dict.fromkeys(source)):
            s = F.replace(s, F.lit(c), F.lit(target[source.index(c)] if source.index(c) < len(target) else ""))
        return s
    return F.translate(s, source, target)
