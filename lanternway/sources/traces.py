"""GPS traces from text tables: point rows, wide rows, sensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions import timefn, wkt
from lanternway.functions.parsing import to_double, to_int, to_text
from lanternway.sources.tables import column


def points(raw: DataFrame, use_dd: bool = False) -> DataFrame:
    """One row per point, in file order ``seq``; rows without an agent go.

    A missing coordinate repeats that of the row before it in the file; a missing hour takes the day
    column. The day enters no time, so a trace over midnight goes back in time, unless `use_dd`: then ``sec`` counts
    from the beginning of day 0, and a missing hour is 0. Carrying coordinates forward needs the whole
    file in order: rows are cut into files, and only the last value of each file is carried on.
    """
    dd = to_int(column(raw, "dd"))
    hh = F.coalesce(to_int(column(raw, "hh")), *([] if use_dd else [dd]), F.lit(0))
    mm, ss = (F.coalesce(to_int(column(raw, c)), F.lit(0)) for c in ("mm", "ss"))
    typed = raw.select(
        to_text(F.col("agent_id")).alias("agent_id"), "seq", to_text(column(raw, "agent_name")).alias("agent_name"),
        to_double(column(raw, "x_coord")).alias("x"), to_double(column(raw, "y_coord")).alias("y"),
        to_int(column(raw, "o_node_id")).alias("o_node_id"), to_int(column(raw, "d_node_id")).alias("d_node_id"),
        to_text(column(raw, "allowed_link_type_code")).alias("allowed"), to_text(column(raw, "blocked_link_type_code")).alias("blocked"),
        to_int(column(raw, "trace_id")).alias("trace_id"), to_int(column(raw, "trace_no")).alias("trace_no"), dd.alias("dd"),
        hh.alias("hh"), mm.alias("mm"), ss.alias("ss"), (timefn.seconds_of_day(hh, mm, ss) + (F.coalesce(dd, F.lit(0)) * 86400 if use_dd else 0)).alias("sec"),
    )
    return carried_forward(typed).where("agent_id is not null")


def carried_forward(df: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``x`` and ``y`` with gaps filled from the rows before, by ``seq``.

    Gaps are filled inside blocks of `block` rows; the last value of each block is then carried over
    the few block rows, so no window spans the whole table.
    """
    part = (F.col("seq") / block).cast("long")
    parts = df.withColumn("_p", part)
    inside = Window.partitionBy("_p").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.groupBy("_p").agg(*[F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("x", "y")])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carry = ends.select("_p", *[F.last(F.when(F.col(f"_{c}.{c}").isNotNull(), F.col(f"_{c}.{c}")), ignorenulls=True).over(before).alias(f"_{c}0") for c in ("x", "y")])
    full = parts.join(carry, "_p", "left")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_{c}0")) for c in ("x", "y")}
    return full.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def wide_agents(raw: DataFrame) -> DataFrame:
    """``agent_id, g, x, y, sec, volume`` from rows with a LINESTRING and ``;``-separated times.

    Of equal agents the first row counts; a point without a time has a null one.
    """
    first = F.row_number().over(Window.partitionBy("agent_id").orderBy("seq"))
    rows = raw.where("agent_id <> ''").withColumn("_n", first).where("_n = 1")
    spots = F.posexplode(wkt.points(F.col("geometry"))).alias("g", "p")
    times = wkt.int_sequence(F.col("time_sequence"))
    return rows.select("agent_id", times.alias("times"), to_double(column(raw, "volume")).alias("volume"), spots).select(
        "agent_id", "g", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.get("times", F.col("g")).alias("sec"), "volume"
    )


def wide(points_: DataFrame) -> DataFrame:
    """The inverse of `wide_agents`: one row per agent with its line and its times."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "sec")))
    rows = points_.groupBy("agent_id").agg(ordered.alias("p"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", lambda p: F.concat(wkt.number(p["x"]), F.lit(" "), wkt.number(p["y"]))), ","), F.lit(")"))
    return rows.select("agent_id", F.array_join(F.transform("p", lambda p: p["sec"].cast("string")), ";").alias("time_sequence"), F.lit(1.0).alias("volume"), line.alias("geometry"))


def sensors(raw: DataFrame) -> DataFrame:
    """Sensor rows as traces of two points, one trace per sensor, with the sensor's type codes."""
    rows = raw.select("seq", F.col("measurement_id").alias("agent_id"), to_text(column(raw, "allowed_link_type_code")).alias("allowed"), to_text(column(raw, "blocked_link_type_code")).alias("blocked"), F.posexplode(wkt.points(F.col("geometry"))).alias("trace_no", "p"))
    return rows.select("agent_id", (F.col("seq") * 1000 + F.col("trace_no")).alias("seq"), "trace_no", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "allowed", "blocked")
