"""Scalar column expressions shared by the operators.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference (feed severity, map colors, feed priority).
SEVERITY_LABELS = {"anomaly": "Critical", "delayed": "Warning", "in_transit": "Normal",
                   "delivered": "OK"}
SEVERITY_FALLBACK = "Normal"
STATUS_COLORS = {"in_transit": "#00d4ff", "delayed": "#ffaa00", "delivered": "#34d399",
                 "anomaly": "#ef4444"}
STATUS_COLOR_FALLBACK = "#94a3b8"
STATUS_PRIORITY = {"anomaly": 0, "delayed": 1, "in_transit": 2, "delivered": 3}
STATUS_PRIORITY_FALLBACK = 4
ROUTE_ARROW = " → "


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_col(as_of: str | _dt.datetime | Column | None, zoned: bool = False) -> Column:
    """The "now" of an operator: a literal, a column, or the query start time.

    String and datetime literals are wall-clock UTC. They become
    ``timestamp_ntz`` (to compare with the driver's ``timestamp_ntz`` columns)
    or, with ``zoned=True``, a ``timestamp`` instant (to compare with zoned
    columns); neither depends on the session time zone.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    naive = F.lit(str(as_of)).cast("timestamp_ntz")
    if zoned:
        # UTC wall clock -> session wall clock -> instant: the same instant in any session.
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")
    return naive


def is_zoned(df, column: str) -> bool:
    """True when ``column`` is a zoned ``timestamp`` (not ``timestamp_ntz``)."""
    return dict(df.dtypes).get(column) == "timestamp"


def as_of_for(df, column: str, as_of) -> Column:
    """``as_of`` typed like ``df[column]`` (see ``as_of_col``)."""
    return as_of_col(as_of, zoned=is_zoned(df, column))


def lookup(c: str | Column, mapping: dict, fallback) -> Column:
    """``mapping.get(c, fallback)`` as a CASE chain (null input -> fallback)."""
    c = col_of(c)
    expr = None
    for key, value in mapping.items():
        expr = (F.when(c == key, F.lit(value)) if expr is None
                else expr.when(c == key, F.lit(value)))
    return expr.otherwise(F.lit(fallback))


def python_or(c: str | Column, default: float) -> Column:
    """Python's ``x or default`` for a float: null and 0.0 both give the default.

    NaN is truthy in Python and passes through unchanged.
    """
    c = col_of(c)
    return F.when(c.isNull() | (c == 0), F.lit(float(default))).otherwise(c)


def clamp_unit(c: str | Column, null_as: float | None = 0.0) -> Column:
    """``max(0, min(1, x))``; Spark's least/greatest skip nulls, so a null is
    replaced first (``null_as``) - otherwise least(1, null) would give 1.
    NaN compares greatest in Spark, so NaN -> 1.0 as in Python."""
    c = col_of(c).cast("double")
    if null_as is not None:
        c = F.coalesce(c, F.lit(float(null_as)))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def status_priority(status: str | Column) -> Column:
    return lookup(status, STATUS_PRIORITY, STATUS_PRIORITY_FALLBACK)


def severity(status: str | Column) -> Column:
    return lookup(status, SEVERITY_LABELS, SEVERITY_FALLBACK)


def status_color(status: str | Column) -> Column:
    return lookup(status, STATUS_COLORS, STATUS_COLOR_FALLBACK)


def risk_band(risk: str | Column) -> Column:
    """> 0.75 high, > 0.5 medium, else low (strict comparisons)."""
    r = col_of(risk)
    return F.when(r > 0.75, "high").when(r > 0.5, "medium").otherwise("low")


def percent(x: str | Column) -> Column:
    """``(x * 100).toFixed(0)`` for non-negative x, as an integer-valued double."""
    return F.round(col_of(x) * 100, 0)


def route_label(waypoints: str | Column, origin: str | Column, destination: str | Column) -> Column:
    """Waypoints joined by an arrow; an empty join falls back to the upper-cased hubs.

    Null array elements join as empty text (JavaScript ``join``)."""
    joined = F.array_join(F.coalesce(col_of(waypoints), F.array().cast("array<string>")),
                          ROUTE_ARROW, "")
    fallback = F.concat(F.upper(col_of(origin)), F.lit(ROUTE_ARROW), F.upper(col_of(destination)))
    return F.when(joined != "", joined).otherwise(fallback)


def snippet(body: str | Column, max_len: int = 200) -> Column:
    """First ``max_len`` characters, with ``...`` when cut."""
    b = col_of(body)
    return F.when(F.length(b) <= max_len, b).otherwise(F.concat(F.substring(b, 1, max_len), F.lit("...")))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (works for timestamp and timestamp_ntz)."""
    return F.timestamp_diff("SECOND", col_of(start), col_of(end))
