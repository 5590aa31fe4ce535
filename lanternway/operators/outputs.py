"""Result tables, in the columns that users of the command-line tool know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions import geo, timefn, wkt
from lanternway.functions.constants import LIKELY_BELOW, RESOLUTION, TIME_BIN


def cell2zone(zones: DataFrame) -> DataFrame:
    return zones.where("zone_id > 0").select("cell_id", "zone_id")


def grid_table(indexed_nodes: DataFrame, zones: DataFrame, kept: DataFrame, dwells: DataFrame, left: float, top: float, bottom: float, resolution: float = RESOLUTION) -> DataFrame:
    """One row per cell with nodes and agent that visits it (agent null: none does)."""
    nodes = indexed_nodes.groupBy("cell_id", "x_index", "y_index").agg(F.count("*").alias("n_nodes"))
    visits = dwells.select("agent_id", "cell_id", F.col("n_points").alias("n_GPS_points"), "dwell_flag")
    full = nodes.join(zones.select("cell_id", "zone_id"), "cell_id", "left").join(visits, "cell_id", "left")
    x, y, r = F.lit(left) + F.col("x_index") * F.lit(resolution), F.lit(bottom) + (F.col("y_index") + 1) * F.lit(resolution), F.lit(resolution)
    corner = lambda dx, dy: F.struct((x + dx * r).alias("x"), (y - dy * r).alias("y"))
    ring = wkt.linestring(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    return full.select("agent_id", "cell_id", "x_index", "y_index", F.coalesce("zone_id", F.lit(0)).alias("zone_id"), F.lit(-1).alias("origin_flag"), F.lit(-1).alias("destination_flag"), F.coalesce("dwell_flag", F.lit(0)).alias("dwell_flag"), F.coalesce("n_GPS_points", F.lit(0)).alias("n_GPS_points"), "n_nodes", x.alias("x_coord"), y.alias("y_coord"), ring.alias("geometry"))


#: Columns of the static route as written; `route` has more, for the agent table.
ROUTE = ("agent_id", "given_link_type_code", "road_sequence", "from_node_id", "to_node_id", "link_id", "trace_no", "length", "distance", "link_type_code", "label_cost", "geometry")


def last_of_pair(links: DataFrame) -> DataFrame:
    """Of parallel links (same from and to node) the last in the file."""
    return links.groupBy("from_node_id", "to_node_id").agg(F.max("seq").alias("pair_seq"))


def route(paths: DataFrame, links: DataFrame, costs: DataFrame, ends: DataFrame) -> DataFrame:
    """Static route rows; attributes are those of the last parallel link, `link_seq` is the link used.

    Besides the columns of `ROUTE`: ``link_seq``, and of the last parallel link ``osm_way_id``, ``shape`` and ends.
    """
    attributes = links.select(F.col("seq").alias("pair_seq"), "link_id", "length", "link_type_code", "shape", "osm_way_id", "fx", "fy", "tx", "ty")
    rows = paths.join(last_of_pair(links), ["from_node_id", "to_node_id"], "left").join(attributes, "pair_seq", "left")
    rows = rows.join(costs.select("agent_id", "link_seq", "trace_no"), ["agent_id", "link_seq"], "left").join(ends.select("agent_id", F.coalesce("allowed", F.lit("")).alias("given_link_type_code")), "agent_id", "left")
    run = F.sum("length").over(Window.partitionBy("agent_id").orderBy("road_sequence"))
    return rows.select("agent_id", "given_link_type_code", "road_sequence", "from_node_id", "to_node_id", "link_id", F.coalesce("trace_no", F.lit(-1)).alias("trace_no"), "length", run.alias("distance"), "link_type_code", "label_cost", wkt.linestring(F.col("shape")).alias("geometry"), "link_seq", "osm_way_id", "shape", "fx", "fy", "tx", "ty")


def td_route(paths: DataFrame, links: DataFrame, spans: DataFrame, span: DataFrame) -> DataFrame:
    """Time-dependent route rows: entry and arrival bins, travel time, delay, clock time of the entry."""
    attributes = links.select(F.col("seq").alias("link_seq"), "length", "fft_sec", "shape", "fx", "fy")
    rows = paths.join(attributes, "link_seq").join(spans.select("agent_id", "start_min"), "agent_id").join(F.broadcast(span))
    run = F.sum("length").over(Window.partitionBy("agent_id").orderBy("road_sequence"))
    minute = timefn.bin_minutes(F.col("time_index"), F.col("t0"))
    diff = F.col("time_index_t") - F.col("time_index")
    tt = (diff * F.lit(60 * TIME_BIN) + 0.5).cast("int")
    hh = (minute / 60).cast("int")
    mm = (minute - hh * 60).cast("int")
    return rows.select(
        "agent_id", "road_sequence", ((minute - F.col("start_min")) * 60 + 0.5).cast("int").alias("cumu_time_in_sec"), "time_index", "time_index_t", diff.alias("time_index_diff"), tt.alias("travel_time_in_sec"), minute.alias("timestamp_minute"),
        "from_node_id", "to_node_id", "length", F.col("fft_sec").alias("FFTT_in_sec"), (tt - F.col("fft_sec")).alias("delay_in_sec"), run.alias("cumu_distance"), "label_cost", hh.alias("hh"), mm.alias("mm"), ((minute - hh * 60 - mm) * 60).cast("int").alias("ss"),
        wkt.linestring(F.col("shape")).alias("geometry"), wkt.point(F.col("fx"), F.col("fy")).alias("geometry_from_node"),
    )


def agent_table(ends: DataFrame, spans: DataFrame, routes: DataFrame, nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per agent: ends with zones and cells, times, distance, speeds, and the path: nodes, ways of its first
    and last link, line (of the links' shapes, or of the nodes where no link has one). Without a path they are empty.
    """
    step = F.struct("road_sequence", "from_node_id", "to_node_id", "osm_way_id", "shape", "fx", "fy", "tx", "ty")
    steps = routes.groupBy("agent_id").agg(F.sum("length").alias("distance"), F.array_sort(F.collect_list(step)).alias("p"))
    place = lambda side: nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.col("cell_id").alias(f"{side}_cell_id")).join(zones.select(F.col("node_id").alias(f"{side}_node_id"), F.col("zone_id").alias(f"{side}_zone_id")), f"{side}_node_id", "left")
    rows = ends.join(spans, "agent_id").join(place("o"), "o_node_id", "left").join(place("d"), "d_node_id", "left").join(steps, "agent_id", "left")
    travel = F.col("end_min") - F.col("start_min")
    kmph = F.coalesce("distance", F.lit(0.0)) / 1000 / F.greatest(F.lit(0.01), travel / 60)
    last = F.element_at("p", -1)
    stops = F.concat(F.transform("p", lambda s: s["from_node_id"].cast("string")), F.array(last["to_node_id"].cast("string")))
    spots = F.concat(F.transform("p", lambda s: F.struct(s["fx"].alias("x"), s["fy"].alias("y"))), F.array(F.struct(last["tx"].alias("x"), last["ty"].alias("y"))))
    shapes = F.flatten(F.transform("p", lambda s: s["shape"]))
    routed = lambda c: F.when(F.col("p").isNull(), F.lit("")).otherwise(c)
    first_way, last_way = routed(F.element_at("p", 1)["osm_way_id"]), routed(last["osm_way_id"])
    start = F.col("start_sec").cast("int")
    return rows.select(
        "agent_id", "o_node_id", "d_node_id", "o_zone_id", "d_zone_id", "o_cell_id", "d_cell_id", F.lit(1.0).alias("volume"), (start / 3600).cast("int").alias("hh"), (start % 3600 / 60).cast("int").alias("mm"), (start % 60).alias("ss"),
        F.col("start_min").alias("departure_time"), F.col("end_min").alias("end_time_in_min"), travel.alias("travel_time"), F.coalesce("distance", F.lit(0.0)).alias("distance"), kmph.alias("speed_kmph"), timefn.mph(kmph).alias("speed_mph"),
        routed(F.concat(F.array_join(stops, ";"), F.lit(";"))).alias("node_sequence"), first_way.alias("o_osm_way_id"), last_way.alias("d_osm_way_id"), routed(F.concat(first_way, F.lit("T"), last_way)).alias("osm_way_id_od_key"),
        routed(wkt.linestring(F.when(F.size(shapes) > 0, shapes).otherwise(spots))).alias("geometry"),
    )


def link_likelihood(costs: DataFrame, links: DataFrame) -> DataFrame:
    rows = costs.where(F.col("cost") < LIKELY_BELOW).join(links.select(F.col("seq").alias("link_seq"), "link_id", "from_node_id", "to_node_id", "link_type_code", "length", "shape"), "link_seq")
    return rows.select("agent_id", "link_id", "from_node_id", "to_node_id", "link_type_code", "length", F.col("cost").alias("likelihood_distance"), F.col("trace_no").alias("likely_trace_no"), "hit_count", wkt.linestring(F.col("shape")).alias("geometry"))


def trace_processed(deltas: DataFrame) -> DataFrame:
    """Points with their progress. The compatible speed of a first point is -3.6; the clean one is null."""
    raw = timefn.kmph(F.coalesce("metres", F.lit(-1.0)), F.coalesce("interval_s", F.lit(0)))
    return deltas.select(F.col("g").alias("gps_trace_id"), "agent_id", F.col("x").alias("x_coord"), F.col("y").alias("y_coord"), F.col("sec").alias("global_sec"), F.coalesce("interval_s", F.lit(0)).alias("interval"), F.coalesce("relative_s", F.lit(0)).alias("relative_sec"), F.coalesce("metres", F.lit(-1.0)).alias("distance"), raw.alias("speed_kmph"), timefn.mph(raw).alias("speed_mph"), F.col("kmph").alias("clean_kmph"))


def arc_cost_log(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Debug rows: arcs with a likelihood, per agent."""
    return costs.where(F.col("cost") < LIKELY_BELOW).join(links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id"), "link_seq").select("agent_id", "from_node_id", "to_node_id", "cost", "trace_no")


def point_cell_log(kept: DataFrame, left: float, bottom: float, resolution: float = RESOLUTION) -> DataFrame:
    """Debug rows: the cell column and row of each point, with its number in the agent's trace."""
    x, y = geo.cell_index(F.col("x"), F.lit(left), resolution), geo.cell_index(F.col("y"), F.lit(bottom), resolution)
    return kept.select("agent_id", "g", "trace_no", x.alias("x_index"), y.alias("y_index"))


def bin_cost_log(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Debug rows: arcs with a cost by time bin, the bin's second, and the point that gave the cost."""
    second = (F.col("bin") * F.lit(TIME_BIN) * 60).cast("int")
    rows = costs.where(F.col("cost") < LIKELY_BELOW)
    if "from_node_id" not in costs.columns:
        rows = rows.join(links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id"), "link_seq")
    return rows.select("agent_id", "from_node_id", "to_node_id", F.col("bin").alias("time_index"), second.alias("sec"), "cost", "hit", "trace_no")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A table as CSV files with a header, range-sorted by `order`."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
