"""Times of day, time bins and speeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternway.functions.constants import MPH, TIME_BIN


def seconds_of_day(hh: Column, mm: Column, ss: Column) -> Column:
    return F.coalesce(hh, F.lit(0)) * 3600 + F.coalesce(mm, F.lit(0)) * 60 + F.coalesce(ss, F.lit(0))


def minutes_of_day(hh: Column, mm: Column, ss: Column) -> Column:
    """Minutes in single precision, as stored."""
    return (F.coalesce(hh, F.lit(0)) * 60 + F.coalesce(mm, F.lit(0)) + F.coalesce(ss, F.lit(0)) / 60.0).cast("float")


def time_bin(minutes: Column, start: Column, bins: Column) -> Column:
    """Bin number of a time in minutes, clamped to the range."""
    raw = ((minutes - start) / F.lit(TIME_BIN) + 0.5).cast("int")
    return F.greatest(F.lit(0), F.least(bins - 1, raw))


def bin_minutes(bin_: Column, start: Column) -> Column:
    return start + bin_ * F.lit(TIME_BIN)


def bins_of_range(start: Column, end: Column) -> Column:
    """Bins of a time range in minutes: ten at least."""
    return F.greatest((end - start) / F.lit(TIME_BIN) + 1, F.lit(10.0)).cast("int")


def kmph(metres: Column, seconds: Column) -> Column:
    return metres / 1000 / F.greatest(F.lit(1 / 3600), seconds / 3600)


def mph(kmph_: Column) -> Column:
    return kmph_ * F.lit(MPH)


def clock_to_seconds(text: Column) -> Column:
    """``HHMM:SS`` by fixed places."""
    return F.substring(text, 1, 2).cast("int") * 3600 + F.substring(text, 3, 2).cast("int") * 60 + F.substring(text, 6, 2).cast("int")


def seconds_to_clock(seconds: Column) -> Column:
    """``HHMM:SS``."""
    h, rest = (seconds / 3600).cast("int"), seconds % 3600
    return F.format_string("%02d%02d:%02d", h, (rest / 60).cast("int"), rest % 60)


def clock_list(text: Column) -> Column:
    """Seconds of each ``[DD]HHMM[:SS[:sss]]`` of a list separated by ``_`` or ``;``.

    The third part adds a thousandth of a minute for each unit, as it always has.
    """

    def one(part: Column) -> Column:
        fields = F.split(part, ":")
        head = fields[0]
        days = F.when(F.length(head) > 4, F.substring(head, 1, 2).try_cast("int")).otherwise(0)
        four = F.right(head, F.lit(4))
        minutes = F.substring(four, 1, 2).try_cast("int") * 60 + F.substring(four, 3, 2).try_cast("int")
        ss = F.coalesce(F.get(fields, 1).try_cast("double"), F.lit(0.0))
        sss = F.coalesce(F.get(fields, 2).try_cast("double"), F.lit(0.0))
        return (days * 24 * 60 + minutes) * 60.0 + ss + sss / 1000 * 60

    return F.transform(F.filter(F.split(text, "[_;]"), lambda p: p != ""), one)
