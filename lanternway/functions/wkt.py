"""Well-known text, read into and written from arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(wkt: Column) -> Column:
    """POINT, LINESTRING or POLYGON, looked for in that order; UNKNOWN otherwise."""
    return F.when(wkt.contains("POINT"), "POINT").when(wkt.contains("LINESTRING"), "LINESTRING").when(wkt.contains("POLYGON"), "POLYGON").otherwise("UNKNOWN")


def points(wkt: Column) -> Column:
    """Array of (x, y) between the first opening and the first closing bracket; null without text."""
    inner = F.regexp_extract(wkt, r"\(+([^()]*)\)", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), " +")), lambda p: F.size(p) >= 2)
    return F.when(inner == "", F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.transform(parts, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y")))
    )


def number(v: Column) -> Column:
    return F.format_string("%.6f", v)


def linestring(points_: Column) -> Column:
    """``LINESTRING (x y,x y,)``: six decimals, and a comma before the bracket."""
    body = F.array_join(F.transform(points_, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]), F.lit(","))), "")
    return F.concat(F.lit("LINESTRING ("), body, F.lit(")"))


def point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), number(x), F.lit(" "), number(y), F.lit(")"))


def int_sequence(text: Column) -> Column:
    """Whole numbers separated by semicolons."""
    return F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p).try_cast("int")), lambda v: v.isNotNull())
