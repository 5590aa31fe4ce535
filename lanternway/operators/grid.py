"""The uniform grid: cells, their zones, and which links belong to which cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.functions import geo
from lanternway.functions.constants import RESOLUTION, RESOLUTION_STEPS
from lanternway.operators.storage import saved


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.max("y").alias("top"))


def grid_size(nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """Cells per side: the longer extent, plus two."""
    r, box = F.lit(resolution), bounding_box(nodes)
    side = F.greatest((F.col("right") - F.col("left")) / r + 2, (F.col("top") - F.col("bottom")) / r + 2)
    return box.select(side.cast("int").alias("grid_size"))


def adaptive_resolution(nodes: DataFrame) -> DataFrame:
    """A resolution that gives five to ten cells a side, rounded up to the next step."""
    box = nodes.agg(F.count("*").alias("n"), F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("b"), F.max("y").alias("t"))
    cells = F.when(F.col("n") > 40000, 10).when(F.col("n") > 10000, 8).otherwise(5)
    mean = ((F.col("r") - F.col("l")) / cells + (F.col("t") - F.col("b")) / cells) / 2
    raw = F.greatest(F.lit(RESOLUTION_STEPS[0]), mean)
    step = F.coalesce(*[F.when((raw > a + 0.000001) & (raw < b), F.lit(b)) for a, b in zip(RESOLUTION_STEPS, RESOLUTION_STEPS[1:], strict=False)], raw)
    return box.select(step.alias("resolution"))


def indexed(nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """Nodes with their signed cell column and row, counted from the lower left corner."""
    box = F.broadcast(bounding_box(nodes).select("left", "bottom"))
    return nodes.join(box).select(*nodes.columns, geo.cell_index(F.col("x"), F.col("left"), resolution).alias("x_index"), geo.cell_index(F.col("y"), F.col("bottom"), resolution).alias("y_index"))


def cell_zones(nodes: DataFrame) -> DataFrame:
    """``cell_id, zone_id, n_nodes``: the first positive zone of a cell's nodes in file order, or null."""
    zone = F.min_by("zone_id", F.when(F.col("zone_id") > 0, F.col("seq")))
    return nodes.groupBy("cell_id").agg(zone.alias("zone_id"), F.count("*").alias("n_nodes"))


def filled_zones(nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``x_index, y_index, zone_id``: cells without a zone take the nearest zoned cell's.

    Distances are between cells; ties go to the smaller (column, row). Only originally zoned cells
    give zones. They are searched through growing squares of cells, up to the extent of all cells.
    """
    cells = saved(indexed(nodes, resolution).groupBy("x_index", "y_index").agg(F.min_by("zone_id", F.when(F.col("zone_id") > 0, F.col("seq"))).alias("zone_id")), "cells")
    zoned = cells.where("zone_id is not null").select(F.col("x_index").alias("zx"), F.col("y_index").alias("zy"), F.col("zone_id").alias("z"))
    bare = cells.where("zone_id is null").select("x_index", "y_index")
    far = (F.col("x_index") - F.col("zx")) * (F.col("x_index") - F.col("zx")) + (F.col("y_index") - F.col("zy")) * (F.col("y_index") - F.col("zy"))
    extent = cells.agg(F.greatest(F.max("x_index") - F.min("x_index"), F.max("y_index") - F.min("y_index")).alias("e")).first()["e"] or 0
    return cells.where("zone_id is not null").unionByName(_zone_by_squares(bare, zoned, far, extent))


def _zone_by_squares(bare: DataFrame, zoned: DataFrame, far: Column, extent: int) -> DataFrame:
    """Nearest zoned cell by equi-joins on ever coarser squares; a hit within the square's side is final.

    A side of twice the `extent` holds every pair of cells, so the round of that side is the last.
    """
    out, side = None, 8
    while True:
        square = lambda c, s=side: F.floor(F.col(c) / s)
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asked = bare.withColumn("i", around).withColumn("j", around).withColumn("sx", square("x_index") + F.col("i")).withColumn("sy", square("y_index") + F.col("j"))
        best = asked.join(zoned.withColumn("sx", square("zx")).withColumn("sy", square("zy")), ["sx", "sy"]).groupBy("x_index", "y_index").agg(F.min_by("z", F.struct(far, F.col("zx"), F.col("zy"))).alias("zone_id"), F.min(far).alias("d"))
        sure = saved(best.where(F.col("d") <= F.lit(side).cast("long") * F.lit(side)).select("x_index", "y_index", "zone_id"), "zones")
        out = sure if out is None else out.unionByName(sure)
        bare = bare.join(sure, ["x_index", "y_index"], "left_anti")
        if side >= 2 * extent or bare.isEmpty():
            return out
        side *= 8


def node_zones(nodes: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``node_id, zone_id``: the zone of the node's cell, filled from the nearest zoned cell."""
    return indexed(nodes, resolution).drop("zone_id").join(filled_zones(nodes, resolution), ["x_index", "y_index"], "left").select("node_id", "zone_id")


def cell_links(links: DataFrame) -> DataFrame:
    """One row per link and cell of its ends (one row if both share it): column ``cell_id`` added."""
    return links.withColumn("cell_id", F.explode(F.array_distinct(F.array("from_cell", "to_cell"))))
