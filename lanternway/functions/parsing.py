"""Lenient typed getters for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(text: Column) -> Column:
    """The whole number a text starts with, or null: ``12.7`` and ``12abc`` give 12."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def to_double(text: Column) -> Column:
    """The number a text starts with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def to_text(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_word(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(\S+)", 1), F.lit(""))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(to_double(text), F.lit(0.0))


def positive_ints(line: Column, separator: str = ",") -> Column:
    """Whole numbers of a line that are 1 or more."""
    return F.filter(F.transform(F.split(line, separator), lambda v: F.coalesce(to_int(v), F.lit(0))), lambda v: v >= 1)
