"""Trace features: which points count, when agents travel, how they sample, where they dwell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions import geo, timefn
from lanternway.functions.constants import RESOLUTION, TIME_BIN
from lanternway.operators.storage import saved


def in_network(points: DataFrame, nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """Points whose cell holds a node, with ``cell_id``, and as `sequenced` their place in the agent's trace."""
    placed = points.withColumn("cell_id", geo.cell_id(F.col("x"), F.col("y"), resolution))
    kept = placed.join(nodes.select("cell_id").distinct(), "cell_id", "left_semi")
    return sequenced(kept)


def sequenced(points: DataFrame) -> DataFrame:
    """Points with their number ``g`` in the agent's trace, the point ``before`` (x, y, sec) and the first point's ``start_sec``.

    A scan in two levels, so that no task sees a whole agent: a range partitioning cuts the order of (agent, seq)
    into stretches of about one size, whoever they belong to. What an agent has in a stretch is a piece; its
    points number themselves by their place behind the piece's first. The pieces, one row each, are scanned per
    agent for what lies before: their points, their last point, the agent's first.
    """
    laid = points.repartitionByRange("agent_id", "seq").sortWithinPartitions("agent_id", "seq").withColumn("_at", F.monotonically_increasing_id())
    laid = saved(laid, "laid-out").withColumn("_stretch", F.shiftright("_at", 33))  # saved: places must not change between the two readings
    spot = F.struct("x", "y", "sec")
    pieces = laid.groupBy("agent_id", "_stretch").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.max_by(spot, "_at").alias("_end"), F.min_by("sec", "_at").alias("_begin"))
    along = Window.partitionBy("agent_id").orderBy("_stretch")  # at most one row a stretch
    carried = pieces.select("agent_id", "_stretch", "_first", (F.sum("_n").over(along) - F.col("_n")).alias("_base"), F.lag("_end").over(along).alias("_carry"), F.first("_begin").over(along).alias("start_sec"))
    inside = Window.partitionBy("agent_id", "_stretch").orderBy("_at")
    rows = laid.join(carried, ["agent_id", "_stretch"]).withColumn("before", F.coalesce(F.lag(spot).over(inside), F.col("_carry")))
    return rows.select(*points.columns, (F.col("_base") + F.col("_at") - F.col("_first")).cast("int").alias("g"), "before", "start_sec")


def given(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per agent the last valid given origin and destination node, and the last type codes."""
    ids = nodes.select(F.col("node_id").alias("_n"))
    rows = points.select("agent_id", "seq", "o_node_id", "d_node_id", "allowed", "blocked")
    ends = rows.where("o_node_id is not null or d_node_id is not null")
    valid = ends.join(ids.withColumnRenamed("_n", "o"), F.col("o_node_id") == F.col("o"), "left").join(ids.withColumnRenamed("_n", "d"), F.col("d_node_id") == F.col("d"), "left")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    nodes_ = valid.groupBy("agent_id").agg(last("o").alias("o_node_id"), last("d").alias("d_node_id"))
    codes = rows.withColumn("allowed", F.nullif("allowed", F.lit(""))).withColumn("blocked", F.nullif("blocked", F.lit(""))).groupBy("agent_id").agg(last("allowed").alias("allowed"), last("blocked").alias("blocked"))
    return codes.join(nodes_, "agent_id", "left")


def spans(kept: DataFrame) -> DataFrame:
    """Per agent: start (first kept point), end (latest), in minutes, and the number of points."""
    return kept.groupBy("agent_id").agg(
        (F.min_by("sec", "g") / 60).alias("start_min"), (F.max("sec") / 60).alias("end_min"), (F.max_by("sec", "g") / 60).alias("last_min"), F.count("*").alias("n_points"), F.min_by("sec", "g").alias("start_sec")
    )


def last_agent(kept: DataFrame) -> DataFrame:
    """One row (none without points): ``agent_id`` of the agent whose first kept point comes last in the trace."""
    first = kept.where("g = 0").agg(F.max_by("agent_id", "seq").alias("agent_id"))
    return first.where("agent_id is not null")


def time_range(kept: DataFrame) -> DataFrame:
    """One row: first and last minute of all agents, and the number of time bins between."""
    per = spans(kept).agg(F.min("start_min").alias("t0"), F.max("end_min").alias("t1"))
    return per.withColumn("bins", timefn.bins_of_range(F.col("t0"), F.col("t1")))


def deltas(kept: DataFrame) -> DataFrame:
    """Interval, relative time, metres and speeds since the point before; first points have no interval."""
    metres = geo.haversine(F.col("before.x"), F.col("before.y"), F.col("x"), F.col("y"))
    rows = kept.withColumn("interval_s", F.col("sec") - F.col("before.sec")).withColumn("relative_s", F.when(F.col("interval_s").isNotNull(), F.col("sec") - F.col("start_sec"))).withColumn("metres", metres)
    return rows.withColumn("kmph", timefn.kmph(F.col("metres"), F.col("interval_s"))).withColumn("mph", timefn.mph(F.col("kmph")))


def sampling(kept: DataFrame) -> DataFrame:
    """Sampling interval in minutes: the median if there are four intervals, 0.05 for fewer, 0.5 for none."""
    per = deltas(kept).groupBy("agent_id").agg(F.count("interval_s").alias("n"), F.percentile("interval_s", F.lit(0.5)).alias("median"))
    return per.select("agent_id", F.when(F.col("n") >= 4, F.col("median") / 60).when(F.col("n") >= 1, F.lit(TIME_BIN)).otherwise(0.5).alias("sampling_min"))


def dwells(kept: DataFrame, ratio: float = 5.0) -> DataFrame:
    """``agent_id, bin, dwell_bins``: intervals over `ratio` times the sampling, at the point before; last wins."""
    rows = kept.join(sampling(kept), "agent_id").join(F.broadcast(time_range(kept)))
    gap = F.col("sec") - F.col("before.sec")
    long_ = rows.where(gap > F.col("sampling_min") * 60 * ratio)
    bin_ = timefn.time_bin(F.col("before.sec") / 60, F.col("t0"), F.col("bins"))
    return long_.select("agent_id", bin_.alias("bin"), (gap / 60 / F.lit(TIME_BIN)).cast("int").alias("dwell_bins"), "g").groupBy("agent_id", "bin").agg(F.max_by("dwell_bins", "g").alias("dwell_bins"))


def segments(kept: DataFrame) -> DataFrame:
    """Planar length of the first, the last and all segments, and the mean, per agent."""
    length = geo.planar(F.col("before.x"), F.col("before.y"), F.col("x"), F.col("y"))
    per = kept.withColumn("d", length).groupBy("agent_id").agg(
        F.coalesce(F.min_by("d", F.when(F.col("d").isNotNull(), F.col("g"))), F.lit(0.0)).alias("first_length"), F.coalesce(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("g"))), F.lit(0.0)).alias("last_length"),
        F.coalesce(F.sum("d"), F.lit(0.0)).alias("total_length"), F.count("*").alias("n"),
    )
    return per.withColumn("mean_length", F.col("total_length") / F.greatest(F.lit(1), F.col("n") - 1)).drop("n")


def cell_dwells(kept: DataFrame, over: int = 120) -> DataFrame:
    """First and last whole minute per agent and cell, and a flag for stays of more than two hours."""
    minute = F.floor(F.col("sec") / 60).cast("int")
    per = kept.groupBy("agent_id", "cell_id").agg(F.min(minute).alias("start_min"), F.max(minute).alias("end_min"), F.count("*").alias("n_points"))
    long_ = F.col("end_min") - F.col("start_min") > over
    return per.withColumn("dwell_flag", long_.cast("int")).withColumn("dwell_min", F.when(long_, F.col("end_min") - F.col("start_min")).otherwise(0))
