"""Column builders for keys, numbers and text, shared by all operators.

Missing values are nulls only: readers turn NaN to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def trim_ws(c: Column) -> Column:
    """Without white space at both ends (trim() drops blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "null" if isinstance(dtype, T.NullType) else "text"


def num(c: Column, kind: str = "text") -> Column:
    """Double or null; text must look like a number as a whole."""
    if kind == "number":
        value = c.cast("double")
    elif kind == "bool":
        value = c.cast("int").cast("double")
    elif kind in ("date", "null"):
        return F.lit(None).cast("double")
    else:
        value = F.when(c.rlike(NUMBER), trim_ws(c).try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def number_text(c: Column) -> Column:
    """Whole numbers without a point, others in plain decimals."""
    d = c.cast("double")
    plain = F.regexp_replace(F.regexp_replace(d.cast("string").cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e18)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(F.coalesce(plain, d.cast("string")))


def text(c: Column, kind: str = "text") -> Column:
    """Text for display and comparison; null is the empty text."""
    if kind == "number":
        shown = number_text(c)
    elif kind == "date":
        shown = F.date_format(c, "yyyy-MM-dd")
    elif kind == "bool":
        shown = F.initcap(c.cast("string"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))


def key(c: Column, kind: str = "text") -> Column:
    """A label as it takes part in matching: trimmed, upper case, null as empty."""
    return F.upper(trim_ws(text(c, kind)))


def truthy(c: Column, kind: str) -> Column:
    if kind == "bool":
        value = c
    elif kind == "number":
        value = c != 0
    elif kind == "text":
        value = c != ""
    else:
        value = c.isNotNull()
    return F.coalesce(value, F.lit(False))


def norm_date(c: Column, kind: str) -> Column:
    """A date from a date, text or spreadsheet serial number."""
    if kind == "number":
        return F.when(c.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c).cast("int")))
    return c.try_cast("date") if kind == "text" else c.cast("date")


def date_serial(c: Column) -> Column:
    """Days since 1899-12-30, with the time of day as a fraction."""
    at = c.cast("timestamp")
    return F.datediff(at, F.lit("1899-12-30").cast("date")) + (F.unix_micros(at) - F.unix_micros(F.date_trunc("day", at))) / F.lit(86_400_000_000.0)


def is_blank(c: Column, kind: str) -> Column:
    return c.isNull() | (trim_ws(c) == "") if kind == "text" else c.isNull()
