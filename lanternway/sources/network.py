"""Road network: nodes and links from text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions import geo, wkt
from lanternway.functions.constants import RESOLUTION
from lanternway.functions.parsing import to_double, to_int, to_text
from lanternway.sources.tables import column


def nodes(raw: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``node_id, seq, x, y, zone_id, cell_id``; rows without id go, of equal ids the first stays."""
    if "zone_id" not in raw.columns:
        raise ValueError("the node table needs a zone_id column")
    typed = raw.select(
        to_int(F.col("node_id")).alias("node_id"), "seq", to_double(column(raw, "x_coord")).alias("x"), to_double(column(raw, "y_coord")).alias("y"),
        F.coalesce(to_int(F.col("zone_id")), F.lit(0)).alias("zone_id"),
    ).where("node_id is not null")
    first = F.row_number().over(Window.partitionBy("node_id").orderBy("seq"))
    return typed.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("cell_id", geo.cell_id(F.col("x"), F.col("y"), resolution))


def links(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Links with both ends among `known` nodes, with the ends' coordinates and cells, shape and lengths.

    ``length`` is 1 where missing; free-flow minutes are 0.1 at least; free-flow seconds are whole.
    """
    minutes = F.greatest(F.lit(0.1), F.coalesce(to_double(column(raw, "VDF_fftt1")), F.lit(0.0)))
    typed = raw.select(
        to_int(F.col("link_id")).alias("link_id"), "seq", to_int(F.col("from_node_id")).alias("from_node_id"), to_int(F.col("to_node_id")).alias("to_node_id"),
        F.coalesce(to_text(column(raw, "osm_way_id")), F.lit("")).alias("osm_way_id"), F.coalesce(to_double(column(raw, "length")), F.lit(1.0)).alias("length"),
        to_double(column(raw, "free_speed")).alias("free_speed"), minutes.alias("fft_min"), (minutes * 60).cast("int").alias("fft_sec"),
        F.coalesce(to_text(column(raw, "link_type_code")), F.lit("")).alias("link_type_code"), column(raw, "geometry").alias("geometry"),
    ).where("link_id is not null and from_node_id is not null and to_node_id is not null")
    a = known.select(F.col("node_id").alias("from_node_id"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("cell_id").alias("from_cell"))
    b = known.select(F.col("node_id").alias("to_node_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("cell_id").alias("to_cell"))
    shape = F.coalesce(wkt.points(F.col("geometry")), F.array().cast("array<struct<x:double,y:double>>"))
    full = typed.join(a, "from_node_id").join(b, "to_node_id").withColumn("shape", shape)
    long_ = full.withColumn("link_distance", geo.polyline_length(F.col("shape")))
    return long_.withColumn("seg_distance", F.when(F.size("shape") >= 2, F.col("link_distance") / (F.size("shape") - 1)).otherwise(0.0))


def orphan_links(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Links of which an end is no known node: those that `links` leaves out."""
    typed = raw.select(to_int(F.col("link_id")).alias("link_id"), to_int(F.col("from_node_id")).alias("from_node_id"), to_int(F.col("to_node_id")).alias("to_node_id")).dropna()
    ids = known.select("node_id")
    a = typed.join(ids, typed.from_node_id == ids.node_id, "left_anti")
    b = typed.join(ids, typed.from_node_id == ids.node_id, "left_semi").join(ids, typed.to_node_id == ids.node_id, "left_anti")
    return a.unionByName(b)
