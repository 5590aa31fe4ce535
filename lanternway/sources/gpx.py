"""GPX track files through Spark's XML source, and the derived trace columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternway.functions import geo
from lanternway.functions.constants import EARTH_MILES

SCHEMA = "url string, trkseg array<struct<trkpt: array<struct<_lat: double, _lon: double, time: string>>>>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per track: ``seq, url, trkseg``."""
    return spark.read.format("xml").option("rowTag", "trk").schema(SCHEMA).load(path).withColumn("seq", F.monotonically_increasing_id())


def track_points(tracks: DataFrame) -> DataFrame:
    """``agent_id, trace_no, lon, lat, time``, points in file order; agents numbered by first url seen."""
    named = tracks.withColumn("name", F.coalesce("url", F.concat(F.lit("Track_"), F.col("seq").cast("string"))))
    number = numbered(named.groupBy("name").agg(F.min("seq").alias("at")), "agent_id", "at").drop("at")
    flat = named.join(number, "name").select("agent_id", "seq", F.posexplode("trkseg").alias("s", "seg")).select("agent_id", "seq", "s", F.posexplode("seg.trkpt").alias("p", "pt"))
    return numbered(flat, "trace_no", "seq", "s", "p").select("agent_id", "seq", "s", "p", "trace_no", F.col("pt._lon").alias("lon"), F.col("pt._lat").alias("lat"), F.col("pt.time").alias("time"))


def numbered(rows: DataFrame, into: str, first: str, *then: str, block: int = 1 << 10) -> DataFrame:
    """Rows with their number from 0 by `first` (a number), then `then`.

    They are counted inside blocks of `block` values of `first`; only the blocks' sizes, one row each, meet
    in one window.
    """
    parts = rows.withColumn("_block", F.floor(F.col(first) / block))
    before = F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.groupBy("_block").agg(F.count("*").alias("n")).select("_block", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(first, *then)) - 1
    return parts.join(base, "_block").withColumn(into, (F.col("_base") + inside).cast("long")).drop("_block", "_base")


def first_segments(tracks: DataFrame) -> DataFrame:
    """Points of each track's first segment up to its first point without a time, numbered per track."""
    flat = tracks.select("seq", F.posexplode(F.get("trkseg", F.lit(0))["trkpt"]).alias("trace_point_no", "pt"))
    timed = F.sum(F.when(F.col("pt.time").isNull(), 1).otherwise(0)).over(Window.partitionBy("seq").orderBy("trace_point_no"))
    kept = flat.withColumn("_u", timed).where("_u = 0")
    clock = F.regexp_extract("pt.time", "T(.*)Z", 1)
    part = lambda i: F.get(F.split(clock, ":"), F.lit(i))
    return kept.select(F.col("seq").alias("agent_id"), "trace_point_no", F.col("pt._lon").alias("x_coord"), F.col("pt._lat").alias("y_coord"), F.col("pt.time").alias("time"), part(0).alias("hh"), part(1).alias("mm"), part(2).alias("ss"))


def speeds(points: DataFrame, order: str = "trace_no", block: int = 1 << 16) -> DataFrame:
    """Miles and miles an hour from the point before in the file, across tracks; null without progress in time.

    A point finds the one before in its block of `block` values of `order`, the first of a block in the last
    point of the block before: one row a block meets in one window, never the points themselves.
    """
    now = F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"), F.to_timestamp("time").cast("double").alias("at"))
    parts = points.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_now", now)
    ends = parts.groupBy("_block").agg(F.max_by("_now", order).alias("_end"))
    carry = ends.select("_block", F.lag("_end").over(Window.orderBy("_block")).alias("_carry"))
    was = F.coalesce(F.lag("_now").over(Window.partitionBy("_block").orderBy(order)), F.col("_carry"))
    rows = parts.join(carry, "_block").withColumn("_was", was)
    gap = (F.col("_now.at") - F.col("_was.at")) / 3600
    miles = geo.haversine(F.col("_was.lon"), F.col("_was.lat"), F.col("lon"), F.col("lat"), EARTH_MILES, 3.141592653589793)
    return rows.withColumn("miles", miles).withColumn("speed_mph", F.when(gap > 0, F.col("miles") / gap)).drop("_block", "_now", "_carry", "_was")


def local_time(points: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    return points.withColumn("local_time", F.from_utc_timestamp(F.to_timestamp("time"), zone))


def trips(points: DataFrame) -> DataFrame:
    """Per agent: miles, hours from first to last point, and their ratio."""
    when = F.to_timestamp("time").cast("double")
    found = points.groupBy("agent_id").agg(F.sum("miles").alias("miles"), ((F.max(when) - F.min(when)) / 3600).alias("hours"))
    return found.withColumn("mph", F.when(F.col("hours") > 0, F.col("miles") / F.col("hours")))


def boxes(west: float, south: float, east: float, north: float, most: float = 0.49) -> list[tuple[float, float, float, float]]:
    """A bounding box cut into boxes of at most `most` degrees a side, for paged download services."""
    from math import ceil

    nx, ny = max(1, ceil((east - west) / most)), max(1, ceil((north - south) / most))
    dx, dy = (east - west) / nx, (north - south) / ny
    return [(west + i * dx, south + j * dy, west + (i + 1) * dx, south + (j + 1) * dy) for i in range(nx) for j in range(ny)]
