"""The registered queries of the map-matching operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternway.functions import geo, parsing, timefn, wkt
from lanternway.functions.constants import EARTH_MILES
from lanternway.operators import grid, likelihood, outputs, paths, tdpaths, trace
from lanternway.operators.storage import run_folder
from lanternway.plans import fixtures, oracle
from lanternway.plans.map_match import Matching
from lanternway.plans.oracle import B, R, d, sql
from lanternway.sources import gpx, network, pages, tables, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def matching(spark: SparkSession, sf_dir: str) -> Matching:
    return Matching(*fixtures.text_tables(spark, sf_dir))


def register(name: str, run: Callable[[Matching], DataFrame], oracle_sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(matching(spark, sf_dir))
    if oracle_sql:
        ORACLE[name] = oracle_sql


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ---------------------------------------------------------------- scalar functions over points and links
def point_links(m: Matching) -> DataFrame:
    """Each step of a trace with one link: nodes by turns, of a node its out-links by rounds."""
    w = Window.partitionBy("agent_id").orderBy("g")
    steps = m.kept.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx is not null")
    own = Window.partitionBy("from_node_id")
    lk = m.links.select("from_node_id", F.row_number().over(own.orderBy("seq")).alias("nth"), F.count("*").over(own).alias("of"), F.col("seq").alias("link_seq"), "fx", "fy", "tx", "ty", "shape", "link_distance", "geometry")
    ids = m.nodes.agg(F.min("node_id").alias("low"), (F.max("node_id") - F.min("node_id") + 1).alias("n_ids"))
    turn = F.col("trace_id").cast("long")
    asked = steps.crossJoin(F.broadcast(ids)).withColumn("at", F.col("low") + turn * 7 % F.col("n_ids")).withColumn("round", F.floor(turn / F.col("n_ids")))
    return asked.join(lk, (F.col("at") == F.col("from_node_id")) & (F.col("round") % F.col("of") == F.col("nth") - 1))


X = ("x", "y", "nx", "ny")
LINE = ("fx", "fy", "tx", "ty")


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def scalar(name: str, value: Callable[[], Column], expression: str) -> None:
    register(name, lambda m: point_links(m).select("agent_id", "trace_no", value().alias("v")), sql(f"select agent_id, trace_no, {expression} as v from pl", "pl"))


def six(value: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.round(value(), 6)


scalar("m01_cell_id", lambda: geo.cell_id(*cols("x", "y")), oracle.cell("x", "y"))
scalar("m02_cell_index", lambda: geo.cell_index(F.col("x"), F.lit(-112.0)), f"cast(floor(x/{R})-floor(-112.0::double/{R}) as bigint)")
scalar("m03_time_bin", lambda: timefn.time_bin(F.col("sec") / 60, F.lit(400.0), F.lit(3000)), f"greatest(0, least(2999, cast(trunc((sec/60-400)/{B}+{d(0.5)}) as integer)))")
scalar("m04_bin_minutes", six(lambda: timefn.bin_minutes(F.col("trace_no"), F.lit(400.0))), f"round(400.0+trace_no*{B}, 6)")
scalar("m05_angle", lambda: geo.angle(*cols(*X)), oracle.angle(*X))
scalar("m06_relative_angle", lambda: geo.relative_angle(geo.angle(*cols(*X)), geo.angle(*cols(*LINE))), f"case when {oracle.angle(*LINE)}-{oracle.angle(*X)}>180 then {oracle.angle(*LINE)}-{oracle.angle(*X)}-360 when {oracle.angle(*LINE)}-{oracle.angle(*X)}<-180 then {oracle.angle(*LINE)}-{oracle.angle(*X)}+360 else {oracle.angle(*LINE)}-{oracle.angle(*X)} end")
scalar("m07_haversine", six(lambda: geo.haversine(*cols(*X))), f"round({oracle.haversine(*X)}, 6)")
scalar("m08_planar", six(lambda: geo.planar(*cols(*X))), f"round({oracle.planar(*X)}, 6)")
scalar("m09_point_to_segment", six(lambda: geo.point_line(*cols("x", "y", *LINE), False)), f"round({oracle.beside('x', 'y')}, 6)")
scalar("m09_point_to_line", six(lambda: geo.point_line(*cols("x", "y", *LINE), True)), f"round({oracle.anywhere('x', 'y')}, 6)")
_u, _away = oracle.foot("x", "y", ("fx", "fy"), ("tx", "ty"))
scalar("m10_beside_line", lambda: geo.beside_line(*cols("x", "y", *LINE)), f"coalesce({_u}>=0 and {_u}<=1 and {_away}<{d(0.5)}*{oracle.planar('x', 'y', 'fx', 'fy')} and {_away}<{d(0.5)}*{oracle.planar('x', 'y', 'tx', 'ty')} and {_away}<{d(0.3)}*{oracle.planar(*LINE)}, false)")
scalar("m11_hit_flag", lambda: geo.hits_line(*cols(*X, *LINE)), oracle.hits(*X, ("fx", "fy"), ("tx", "ty")))
scalar("m12_conditioning", lambda: geo.well_conditioned(F.col("link_distance"), geo.planar(*cols(*X))), f"link_distance/greatest({d(1e-8)},{oracle.planar(*X)})>1.0::double/3 and link_distance/greatest({d(1e-8)},{oracle.planar(*X)})<3")
scalar("m13_wkt_parse", six(lambda: F.aggregate(wkt.points(F.col("geometry")), F.lit(0.0), lambda s, p: s + p["x"] + p["y"])), "round(((0.0::double+shape[1].x+shape[1].y)+shape[2].x+shape[2].y)+shape[3].x+shape[3].y, 6)")
scalar("m14_wkt_print", lambda: wkt.linestring(F.col("shape")), "concat('LINESTRING (', list_aggregate(list_transform(shape, lambda p: concat(printf('%.6f', p.x), ' ', printf('%.6f', p.y), ',')), 'string_agg', ''), ')')")
scalar("m15_int_sequence", lambda: F.array_join(wkt.int_sequence(F.concat_ws(";", "trace_no", F.lit("x"), "sec")).cast("array<string>"), "|"), "concat(trace_no, '|', sec)")
scalar("m17_clock_to_seconds", lambda: timefn.clock_to_seconds(timefn.seconds_to_clock(F.col("sec") % 86400)), "cast(sec % 86400 as integer)")
scalar("m18_seconds_to_clock", lambda: timefn.seconds_to_clock(F.col("sec") % 86400), "printf('%02d%02d:%02d', (sec%86400)//3600, ((sec%86400)%3600)//60, sec%60)")
scalar("m16_clock_list", lambda: F.element_at(timefn.clock_list(F.concat(F.lit("0700:00_"), timefn.seconds_to_clock(F.col("sec") % 86400), F.lit(":500"))), 2), "cast(sec % 86400 as double)+30")
scalar("m19_minutes_of_day", lambda: timefn.minutes_of_day(F.floor(F.col("sec") / 3600), F.floor(F.col("sec") % 3600 / 60), F.col("sec") % 60).cast("double"), "cast(cast(sec/60.0::double as float) as double)")
scalar("m20_speed", six(lambda: timefn.mph(timefn.kmph(geo.haversine(*cols(*X)), F.lit(5)))), f"round({oracle.haversine(*X)}/1000/greatest({d(1 / 3600)}, 5.0::double/3600)*{d(0.621371)}, 6)")
scalar("m22_polyline_length", six(lambda: geo.polyline_length(F.col("shape"))), "round(link_distance, 6)")

# ---------------------------------------------------------------- sources
register("s03_typed_getters", lambda m: m.raw_links.select(F.col("seq").alias("k"), parsing.to_int(F.concat(F.lit("  "), F.col("length"), F.lit("abc"))).alias("i"), parsing.to_double(F.concat("length", F.lit("km"))).alias("f"), parsing.first_word(F.col("geometry")).alias("w"), parsing.number_or_zero(F.lit("x")).alias("z"), parsing.to_text(F.col("link_type_code")).alias("t")), sql("select cast(link_id as bigint) as k, cast(trunc(length) as integer) as i, length as f, 'LINESTRING' as w, 0.0::double as z, link_type_code as t from links", "links"))
register("s06_positive_ints", lambda m: m.raw_nodes.select(F.col("seq").alias("k"), F.size(parsing.positive_ints(F.concat_ws(",", "node_id", "zone_id", F.lit("-3"), F.lit("7x")))).alias("n")), sql("select seq as k, cast((node_id>=1)::int+(zone_id>=1)::int+1 as integer) as n from nn", "nn"))
register("s08_nodes", lambda m: m.nodes.select("node_id", r6("x", "x"), r6("y", "y"), "zone_id", "cell_id"), sql("select cast(node_id as integer) as node_id, round(x,6) as x, round(y,6) as y, cast(zone_id as integer) as zone_id, cell_id from nn", "nn"))
register("s09_links", lambda m: m.links.select("link_id", "from_node_id", "to_node_id", "length", r6("fft_min", "fft_min"), "fft_sec", "link_type_code", r6("link_distance", "link_distance"), r6("seg_distance", "seg_distance"), "from_cell", "to_cell"), sql("select cast(link_id as integer) as link_id, cast(from_node_id as integer) as from_node_id, cast(to_node_id as integer) as to_node_id, length, round(fft_min,6) as fft_min, fft_sec, link_type_code, round(link_distance,6) as link_distance, round(link_distance/2,6) as seg_distance, from_cell, to_cell from lk", "lk"))
register("s10_orphan_links", lambda m: network.orphan_links(m.raw_links, m.nodes.where("node_id % 10 <> 3")), sql("select cast(link_id as integer) as link_id, cast(from_node_id as integer) as from_node_id, cast(to_node_id as integer) as to_node_id from links where from_node_id % 10 = 3 or to_node_id % 10 = 3", "links"))
register("s11_trace_points", lambda m: m.points.select("agent_id", "seq", "trace_no", "trace_id", r6("x", "x"), r6("y", "y"), "sec", "o_node_id", "allowed", "blocked"), sql("select agent_id, cast(seq as bigint) as seq, cast(trace_no as integer) as trace_no, cast(trace_id as integer) as trace_id, round(x,6) as x, round(y,6) as y, cast(sec as integer) as sec, cast(o_node_id as integer) as o_node_id, allowed, blocked from pts", "pts"))
def night_points(m: Matching) -> DataFrame:
    """The trace 16 hours later, most of it over midnight, with a day column."""
    at = F.expr("cast(hh as int) * 3600 + cast(mm as int) * 60 + cast(ss as int) + 57600")
    parts = {"dd": at / 86400, "hh": at % 86400 / 3600, "mm": at % 3600 / 60, "ss": at % 60}
    return traces.points(m.raw_trace.withColumns({c: v.cast("int").cast("string") for c, v in parts.items()}), use_dd=True)


register("s11_days", lambda m: night_points(m).select("agent_id", "seq", "dd", "hh", "sec"), sql("select agent_id, cast(seq as bigint) as seq, cast((sec+57600)//86400 as integer) as dd, cast((sec+57600)%86400//3600 as integer) as hh, cast(sec+57600 as integer) as sec from pts", "pts"))
register("s12_wide_agents", lambda m: traces.wide_agents(traces.wide(m.kept).withColumn("seq", F.lit(0)).withColumn("volume", F.lit("1"))).select("agent_id", F.col("g").cast("long").alias("g"), r6("x", "x"), r6("y", "y"), "sec"), sql("select agent_id, g, round(x,6) as x, round(y,6) as y, cast(sec as integer) as sec from kept", "kept"))
register("s18_sensors", lambda m: traces.sensors(m.raw_links.select("seq", F.col("link_id").alias("measurement_id"), F.col("link_type_code").alias("allowed_link_type_code"), "geometry")).select("agent_id", "trace_no", r6("x", "x"), r6("y", "y"), "allowed"), sql("select cast(link_id as varchar) as agent_id, cast(i-1 as integer) as trace_no, round(shape[i].x,6) as x, round(shape[i].y,6) as y, link_type_code as allowed from lk, range(1,4) t(i)", "lk"))
register("f08_carry_forward", lambda m: traces.carried_forward(m.points.withColumn("x", F.when(F.col("seq") % 5 != 1, F.col("x"))), 1 << 10).select("agent_id", "seq", r6("x", "x"), r6("y", "y")), sql("select agent_id, cast(seq as bigint) as seq, round(last_value(case when seq % 5 <> 1 then x end ignore nulls) over (order by seq rows unbounded preceding), 6) as x, round(y,6) as y from pts", "pts"))


def gpx_points(m: Matching) -> DataFrame:
    return m.points.select("agent_id", F.col("seq").alias("trace_no"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.timestamp_seconds(F.col("sec") + 1_600_000_000).cast("string").alias("time"))


_MILES = oracle.haversine("lag(x) over w", "lag(y) over w", "x", "y", EARTH_MILES, 3.141592653589793)
_SPEED = f"select *, {_MILES} as miles, sec - lag(sec) over w as gap from pts window w as (order by seq)"
register("s17_gpx_speeds", lambda m: gpx.speeds(gpx_points(m)).select("agent_id", F.col("trace_no").alias("seq"), r6("miles", "miles"), F.round("speed_mph", 4).alias("speed_mph")), sql(f"select agent_id, cast(seq as bigint) as seq, round(miles,6) as miles, round(case when gap>0 then miles/(gap/3600.0::double) end, 4) as speed_mph from ({_SPEED})", "pts"))
register("a20_trip_totals", lambda m: gpx.trips(gpx.speeds(gpx_points(m))).select("agent_id", F.round("miles", 4).alias("miles"), r6("hours", "hours"), F.round("mph", 3).alias("mph")), sql(f"select agent_id, round(sum(miles),4) as miles, round((max(sec)-min(sec))/3600.0::double,6) as hours, round(case when max(sec)>min(sec) then sum(miles)/((max(sec)-min(sec))/3600.0::double) end,3) as mph from ({_SPEED}) group by agent_id", "pts"))



def gpx_tracks(m: Matching) -> DataFrame:
    """A track a user, in one segment; seven urls, and the 31st point has no time."""
    when = F.when(F.col("trace_no") != 30, F.date_format(F.timestamp_seconds(F.col("sec") + 1_577_836_800), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    point = F.struct("seq", F.struct(F.col("y").alias("_lat"), F.col("x").alias("_lon"), when.alias("time")).alias("p"))
    rows = m.points.withColumn("user", F.floor(F.col("seq") / 2147483648)).groupBy("user").agg(F.array_sort(F.collect_list(point)).alias("o"))
    segment = F.struct(F.transform("o", lambda o: o["p"]).alias("trkpt"))
    return rows.select(F.col("user").alias("seq"), F.concat(F.lit("u"), F.col("user") % 7).alias("url"), F.array(segment).alias("trkseg"))


def as_files(m: Matching, df: DataFrame) -> DataFrame:
    """A table written as CSV files and read by the text source."""
    path = f"{run_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    outputs.write_csv(df, path)
    return tables.read_table(df.sparkSession, path)


_USER = "select *, seq//2147483648 as user, row_number() over (partition by seq//2147483648 order by seq)-1 as nth from pts"
register("s01_csv_open", lambda m: as_files(m, m.raw_nodes.drop("seq")).select("node_id", "zone_id"), sql("select cast(node_id as varchar) as node_id, cast(zone_id as varchar) as zone_id from nodes", "nodes"))
register("s02_csv_records", lambda m: as_files(m, m.raw_links.drop("seq")).select("link_id", "geometry", F.col("link_type_code")), sql("select cast(link_id as varchar) as link_id, geometry, link_type_code from links", "links"))
register("s05_section_lookup", lambda m: tables.lookup(m.raw_links.select("seq", "from_node_id", "to_node_id", "length"), "5", "6", "length").select(F.col("value").cast("double").alias("value")), sql("select length as value from links where from_node_id = 5 and to_node_id = 6 order by link_id limit 1", "links"))
register("s07_number_or_zero", lambda m: m.raw_links.select(F.col("seq").alias("k"), parsing.number_or_zero(F.when(F.col("seq") % 3 == 0, F.lit("none")).otherwise(F.col("length"))).alias("v")), sql("select cast(link_id as bigint) as k, case when link_id % 3 = 0 then 0.0::double else length end as v from links", "links"))
register("s14_first_segments", lambda m: gpx.first_segments(gpx_tracks(m)).select(F.col("agent_id").cast("long").alias("agent_id"), F.col("trace_point_no").cast("long").alias("trace_point_no"), r6("x_coord", "x_coord"), "hh", "mm", "ss"), sql(f"select user as agent_id, nth as trace_point_no, round(x,6) as x_coord, printf('%02d', sec//3600) as hh, printf('%02d', sec%3600//60) as mm, printf('%02d', sec%60) as ss from ({_USER}) where nth < 30", "pts"))
register("s16_track_points", lambda m: gpx.track_points(gpx_tracks(m)).select("agent_id", "trace_no", r6("lon", "lon"), r6("lat", "lat")), sql(f"select n.number as agent_id, row_number() over (order by u.seq)-1 as trace_no, round(x,6) as lon, round(y,6) as lat from ({_USER}) u join (select user%7 as url, row_number() over (order by min(user))-1 as number from ({_USER}) group by user%7) n on n.url = u.user%7", "pts"))



def paged_points(m: Matching, page: int = 500) -> DataFrame:
    """The kept points as a paged service has them, read back; a user's 31st point has no time."""
    boxes = gpx.boxes(m.box[0], m.box[2], m.box[1], m.box[3])
    when = F.when(F.col("trace_no") != 30, F.col("sec").cast("string"))
    path = f"{run_folder(m.kept.sparkSession)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(m.kept.select(pages.box_of(F.col("x"), F.col("y"), boxes).alias("box"), F.col("agent_id").alias("track"), F.col("seq").alias("place"), F.col("x").alias("lon"), F.col("y").alias("lat"), when.alias("time")), path, page)
    return pages.timed_tracks(pages.read_pages(m.kept.sparkSession, path, len(boxes)))


_SIDE = lambda v, low, high: f"cast(greatest(0, least(greatest(1, ceil(({high}-{low})/0.49::double))-1, floor(({v}-{low})/(({high}-{low})/greatest(1, ceil(({high}-{low})/0.49::double)))))) as bigint)"
register("s13_paged_points", lambda m: paged_points(m).select("agent_id", F.col("place").alias("seq"), "time", r6("lon", "lon"), r6("lat", "lat")), sql(f"""select agent_id, cast(seq as bigint) as seq, cast(sec as varchar) as time, round(x,6) as lon, round(y,6) as lat
  from (select *, count(case when trace_no = 30 then 1 end) over (partition by agent_id, i, j order by seq) as gone from (select k.*, {_SIDE('x', 'lft', 'rgt')} as i, {_SIDE('y', 'bot', 'top')} as j from kept k cross join box)) where gone = 0""", "box"))

# ---------------------------------------------------------------- grid
register("a01_bounding_box", lambda m: grid.bounding_box(m.nodes), sql("select lft as \"left\", rgt as \"right\", bot as bottom, top from box", "box"))
register("a02_grid_size", lambda m: grid.grid_size(m.nodes), sql(f"select cast(trunc(greatest((rgt-lft)/{R}+2,(top-bot)/{R}+2)) as integer) as grid_size from box", "box"))
register("a03_cell_zones", lambda m: grid.cell_zones(m.nodes), sql("select cell_id, cast(arg_min(zone_id, seq) filter (where zone_id>0) as integer) as zone_id, count(*) as n_nodes from nn group by cell_id", "nn"))
register("a04_node_zones", lambda m: grid.node_zones(m.nodes), sql("select cast(node_id as integer) as node_id, cast(fz.zone_id as integer) as zone_id from ix join fz using (x_index, y_index)", "fz"))
register("a05_filled_zones", lambda m: grid.filled_zones(m.nodes.withColumn("zone_id", F.when(F.col("node_id") % 50 == 1, F.col("node_id")).otherwise(0))), sql("select x_index, y_index, cast(zone_id as integer) as zone_id from fz", "fz").replace("then p_size else 0 end as zone_id", "then p_size else 0 end as zone_old, case when p_partkey % 50 = 1 then p_partkey else 0 end as zone_id"))
register("g05_adaptive_resolution", lambda m: grid.adaptive_resolution(m.nodes), sql(f"select {oracle.STEPS} as resolution from (select greatest({d(0.00005)}, ((rgt-lft)/5+(top-bot)/5)/2) as raw from box)", "box"))
register("g04_cell_index", lambda m: grid.indexed(m.nodes).select("node_id", "x_index", "y_index"), sql("select cast(node_id as integer) as node_id, x_index, y_index from ix", "ix"))
register("j04_cell_links", lambda m: grid.cell_links(m.links).select("link_id", "cell_id"), sql("select cast(link_seq as integer) as link_id, cell_id from cl", "cl"))
register("k01_cell2zone", lambda m: outputs.cell2zone(grid.cell_zones(m.nodes)), sql("select cell_id, cast(arg_min(zone_id, seq) filter (where zone_id>0) as integer) as zone_id from nn group by cell_id having max(zone_id)>0", "nn"))

# ---------------------------------------------------------------- traces
register("f01_in_network", lambda m: m.kept.select("agent_id", "seq", "cell_id", F.col("g").cast("long").alias("g")), sql("select agent_id, cast(seq as bigint) as seq, cell_id, g from kept", "kept"))
register("j03_given_ends", lambda m: m.given.select("agent_id", "o_node_id", "allowed", "blocked"), sql("select agent_id, cast(o_node_id as integer) as o_node_id, allowed, blocked from given", "given"))
register("a06_agent_spans", lambda m: trace.spans(m.kept).select("agent_id", r6("start_min", "start_min"), r6("end_min", "end_min"), "n_points"), sql("select agent_id, round(start_min,6) as start_min, round(end_min,6) as end_min, n_points from spans", "spans"))
register("a09_time_range", lambda m: m.span.select(r6("t0", "t0"), r6("t1", "t1"), "bins"), sql("select round(t0,6) as t0, round(t1,6) as t1, bins from span", "span"))
register("a08_point_deltas", lambda m: trace.deltas(m.kept).select("agent_id", "trace_no", "interval_s", "relative_s", r6("metres", "metres")), sql("select agent_id, cast(trace_no as integer) as trace_no, cast(interval_s as integer) as interval_s, cast(case when interval_s is not null then sec-first_value(sec) over (partition by agent_id order by g) end as integer) as relative_s, round(metres,6) as metres from deltas", "deltas"))
register("a10_sampling", lambda m: trace.sampling(m.kept).select("agent_id", r6("sampling_min", "sampling_min")), sql("select agent_id, round(sampling_min,6) as sampling_min from sampling", "sampling"))
register("a11_excessive_dwell", lambda m: trace.dwells(m.kept), sql(f"select agent_id, cast(bin as integer) as bin, arg_max(dwell_bins, g) as dwell_bins from (select k.agent_id, k.g, greatest(0, least(s.bins-1, cast(trunc(((k.sec-k.interval_s)/60-s.t0)/{B}+{d(0.5)}) as integer))) as bin, cast(trunc(k.interval_s/60/{B}) as integer) as dwell_bins from deltas k join sampling a using (agent_id) cross join span s where k.interval_s > a.sampling_min*60*5) group by agent_id, bin", "sampling"))
register("a12_segments", lambda m: trace.segments(m.kept).select("agent_id", *[r6(c, c) for c in ("first_length", "last_length", "total_length", "mean_length")]), sql("select agent_id, round(first_length,6) as first_length, round(last_length,6) as last_length, round(total_length,6) as total_length, round(mean_length,6) as mean_length from segs", "segs"))
register("a13_cell_dwell", lambda m: trace.cell_dwells(m.kept, 1), sql("select agent_id, cell_id, min(cast(sec//60 as integer)) as start_min, max(cast(sec//60 as integer)) as end_min, count(*) as n_points, cast(max(sec//60)-min(sec//60)>1 as integer) as dwell_flag, cast(case when max(sec//60)-min(sec//60)>1 then max(sec//60)-min(sec//60) else 0 end as integer) as dwell_min from kept group by agent_id, cell_id", "kept"))
register("k07_trace_processed", lambda m: outputs.trace_processed(trace.deltas(m.kept)).select(F.col("gps_trace_id").cast("long").alias("gps_trace_id"), "agent_id", "global_sec", "interval", "relative_sec", r6("distance", "distance"), r6("speed_kmph", "speed_kmph"), r6("speed_mph", "speed_mph")), sql(f"select g as gps_trace_id, agent_id, cast(sec as integer) as global_sec, cast(coalesce(interval_s,0) as integer) as interval, cast(case when interval_s is not null then sec-first_value(sec) over (partition by agent_id order by g) else 0 end as integer) as relative_sec, round(coalesce(metres,-1),6) as distance, round(coalesce(metres,-1)/1000/greatest({d(1 / 3600)}, coalesce(interval_s,0)/3600), 6) as speed_kmph, round(coalesce(metres,-1)/1000/greatest({d(1 / 3600)}, coalesce(interval_s,0)/3600)*{d(0.621371)}, 6) as speed_mph from deltas", "deltas"))

# ---------------------------------------------------------------- matching
register("g00_origin_destination", lambda m: m.ends.select("agent_id", "o_node_id", "d_node_id", r6("o_score", "o_score"), r6("d_score", "d_score")), sql("select agent_id, cast(o_node_id as integer) as o_node_id, cast(d_node_id as integer) as d_node_id, round(o_score,6) as o_score, round(d_score,6) as d_score from ends", "ends"))
register("j05_point_link_candidates", lambda m: likelihood.candidates(m.kept, m.links).groupBy("agent_id", "link_seq").count(), sql("select agent_id, link_seq, count(*) as count from cand group by all", "cand"))
register("l01_deviation_scores", lambda m: m.scored.select("agent_id", "link_seq", "cell_id", "trace_no", r6("nonhit", "nonhit"), r6("beside", "beside"), "hit"), sql("select agent_id, link_seq, cell_id, cast(trace_no as integer) as trace_no, round(nonhit,6) as nonhit, round(beside,6) as beside, hit from scored", "scored"))
register("l02_static_costs", lambda m: m.costs_of().select("agent_id", "link_seq", r6("cost", "cost"), "trace_no", "hit_count"), sql("select agent_id, link_seq, round(cost,6) as cost, cast(trace_no as integer) as trace_no, hit_count from costs", "costs"))
register("k06_link_likelihood", lambda m: outputs.link_likelihood(m.costs_of(), m.links).select("agent_id", "link_id", "from_node_id", "to_node_id", "link_type_code", "length", r6("likelihood_distance", "likelihood_distance"), "likely_trace_no", "hit_count"), sql("select c.agent_id, cast(l.link_id as integer) as link_id, cast(l.from_node_id as integer) as from_node_id, cast(l.to_node_id as integer) as to_node_id, l.link_type_code, l.length, round(c.cost,6) as likelihood_distance, cast(c.trace_no as integer) as likely_trace_no, c.hit_count from costs c join lk l using (link_seq) where c.cost<998", "costs"))
register("k06_last_agent", lambda m: m.last_likelihood.select("agent_id", "link_id", "from_node_id", "to_node_id", "link_type_code", "length", r6("likelihood_distance", "likelihood_distance"), "likely_trace_no", "hit_count"), sql("select c.agent_id, cast(l.link_id as integer) as link_id, cast(l.from_node_id as integer) as from_node_id, cast(l.to_node_id as integer) as to_node_id, l.link_type_code, l.length, round(c.cost,6) as likelihood_distance, cast(c.trace_no as integer) as likely_trace_no, c.hit_count from costs c join lk l using (link_seq) where c.cost<998 and c.agent_id=(select arg_max(agent_id, seq) from kept where g=0)", "costs"))
register("k08_arc_cost_log", lambda m: outputs.arc_cost_log(m.costs, m.links).select("agent_id", "from_node_id", "to_node_id", r6("cost", "cost"), "trace_no"), sql("select c.agent_id, cast(l.from_node_id as integer) as from_node_id, cast(l.to_node_id as integer) as to_node_id, round(c.cost,6) as cost, cast(c.trace_no as integer) as trace_no from costs c join lk l using (link_seq) where c.cost<998", "costs"))
register("k08_point_cell_log", lambda m: outputs.point_cell_log(m.kept, m.box[0], m.box[2], m.r).select("agent_id", F.col("g").cast("long").alias("g"), "trace_no", "x_index", "y_index"), sql(f"select agent_id, g, cast(trace_no as integer) as trace_no, cast(floor(x/{R})-floor((select min(x) from nn)/{R}) as bigint) as x_index, cast(floor(y/{R})-floor((select min(y) from nn)/{R}) as bigint) as y_index from kept", "kept"))
register("f07_active_links", lambda m: likelihood.candidates(m.kept, m.links).select("agent_id", "link_seq").distinct(), sql("select distinct agent_id, link_seq from cand", "cand"))
register("k02_grid", lambda m: m.grid.select("agent_id", "cell_id", "x_index", "y_index", "zone_id", "dwell_flag", "n_GPS_points", "n_nodes", r6("x_coord", "x_coord"), r6("y_coord", "y_coord")), sql(f"select v.agent_id, n.cell_id, n.x_index, n.y_index, cast(coalesce(n.zone_id,0) as integer) as zone_id, cast(coalesce(v.dwell_flag,0) as integer) as dwell_flag, coalesce(v.np,0) as \"n_GPS_points\", n.n_nodes, round(b.lft+n.x_index*{R},6) as x_coord, round(b.bot+(n.y_index+1)*{R},6) as y_coord from (select cell_id, x_index, y_index, count(*) as n_nodes, any_value(z) as zone_id from (select *, arg_min(zone_id, case when zone_id>0 then seq end) over (partition by cell_id) as z from ix) group by all) n cross join box b left join (select agent_id, cell_id, count(*) as np, (max(sec//60)-min(sec//60)>120)::int as dwell_flag from kept group by all) v using (cell_id)", "ix").replace("arg_min(zone_id, case when zone_id>0 then seq end) over (partition by cell_id) as z", "(select arg_min(q.zone_id, q.seq) filter (where q.zone_id>0) from nn q where q.cell_id=ix.cell_id) as z"))
register("k02_last_agent", lambda m: m.last_grid.select("agent_id", "cell_id", "x_index", "y_index", "zone_id", "dwell_flag", "n_GPS_points", "n_nodes", r6("x_coord", "x_coord"), r6("y_coord", "y_coord")), sql(f"select v.agent_id, n.cell_id, n.x_index, n.y_index, cast(coalesce(n.zone_id,0) as integer) as zone_id, cast(coalesce(v.dwell_flag,0) as integer) as dwell_flag, coalesce(v.np,0) as \"n_GPS_points\", n.n_nodes, round(b.lft+n.x_index*{R},6) as x_coord, round(b.bot+(n.y_index+1)*{R},6) as y_coord from (select cell_id, x_index, y_index, count(*) as n_nodes, any_value(z) as zone_id from (select *, arg_min(zone_id, case when zone_id>0 then seq end) over (partition by cell_id) as z from ix) group by all) n cross join box b left join (select agent_id, cell_id, count(*) as np, (max(sec//60)-min(sec//60)>120)::int as dwell_flag from kept where agent_id=(select arg_max(agent_id, seq) from kept where g=0) group by all) v using (cell_id)", "ix").replace("arg_min(zone_id, case when zone_id>0 then seq end) over (partition by cell_id) as z", "(select arg_min(q.zone_id, q.seq) filter (where q.zone_id>0) from nn q where q.cell_id=ix.cell_id) as z"))

# Labels are walked by rounds; one that is not below its target's is not needed. Then each step's link, last to first.
_LABELS = """lab(agent_id, node, cost) using key (agent_id, node) as (
  select agent_id, o_node_id, 0.0::double from ends where o_node_id is not null and d_node_id is not null
  union
  select agent_id, node, cost from (
    select a.agent_id, a.to_node_id as node, min(l.cost+a.w) as cost from lab l join arcs a on a.agent_id=l.agent_id and a.from_node_id=l.node group by all) n
  where cost < coalesce((select r.cost from recurring.lab r where r.agent_id=n.agent_id and r.node=n.node), 1e300)
    and cost < coalesce((select r.cost from recurring.lab r join ends e on e.agent_id=r.agent_id and e.d_node_id=r.node where r.agent_id=n.agent_id), 1e300))"""
_FROM = f"case when {oracle._FINE} then coalesce(c.cost, {d(oracle.INACTIVE)}) else {d(9999.99)} end"
_STEPS = _LABELS + f""",
pred as (select z.agent_id, z.node, min(l.link_seq) as link_seq from lab z join ends e on e.agent_id=z.agent_id join lk l on l.to_node_id=z.node join lab y on y.agent_id=z.agent_id and y.node=l.from_node_id
  left join costs c on c.agent_id=z.agent_id and c.link_seq=l.link_seq where y.cost+{_FROM} = z.cost and z.node <> e.o_node_id group by all),
walk(agent_id, node, back, link_seq) as (
  select p.agent_id, l.from_node_id, 1, p.link_seq from ends e join pred p on p.agent_id=e.agent_id and p.node=e.d_node_id join lk l on l.link_seq=p.link_seq where e.o_node_id <> e.d_node_id
  union all
  select p.agent_id, l.from_node_id, w.back+1, p.link_seq from walk w join pred p on p.agent_id=w.agent_id and p.node=w.node join lk l on l.link_seq=p.link_seq join ends e on e.agent_id=w.agent_id where w.node <> e.o_node_id),
way as (select w.agent_id, w.link_seq, row_number() over (partition by w.agent_id order by w.back desc) as road_sequence, l.from_node_id, l.to_node_id, y.cost as label_cost
  from walk w join lk l on l.link_seq=w.link_seq join lab y on y.agent_id=w.agent_id and y.node=l.from_node_id),
steps as (select w.*, e.allowed, c.trace_no, l.link_id, l.length, l.link_type_code, l.shape, sum(l.length) over (partition by w.agent_id order by w.road_sequence) as distance
  from way w join ends e on e.agent_id=w.agent_id left join costs c on c.agent_id=w.agent_id and c.link_seq=w.link_seq
  join (select from_node_id, to_node_id, max(link_seq) as link_seq from lk group by all) p on p.from_node_id=w.from_node_id and p.to_node_id=w.to_node_id join lk l on l.link_seq=p.link_seq)"""
_LINESTRING = "concat('LINESTRING (', list_aggregate(list_transform({}, lambda p: concat(printf('%.6f', p.x), ' ', printf('%.6f', p.y), ',')), 'string_agg', ''), ')')"
_TOTALS = sql("select e.agent_id, round(l.cost,6) as total_cost from ends e join lab l on l.agent_id=e.agent_id and l.node=e.d_node_id where e.o_node_id <> e.d_node_id", "arcs", _LABELS)
register("g01_shortest_path_cost", lambda m: m.paths.select("agent_id", r6("total_cost", "total_cost")).distinct(), _TOTALS)
register("g01_relaxed_path_cost", lambda m: paths.relaxed_paths(m.ends, m.costs, m.links).select("agent_id", r6("total_cost", "total_cost")).distinct(), _TOTALS)
register("k04_route", lambda m: m.route.select(*[r6("label_cost", c) if c == "label_cost" else F.col(c) for c in outputs.ROUTE]), sql(f"""select agent_id, coalesce(allowed,'') as given_link_type_code, cast(road_sequence as integer) as road_sequence, cast(from_node_id as integer) as from_node_id, cast(to_node_id as integer) as to_node_id,
  cast(link_id as integer) as link_id, cast(coalesce(trace_no,-1) as integer) as trace_no, length, distance, link_type_code, round(label_cost,6) as label_cost, {_LINESTRING.format('shape')} as geometry from steps""", "arcs", _STEPS))
register("k03_agent", lambda m: m.agents.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in m.agents.dtypes]), sql(f"""select e.agent_id, cast(e.o_node_id as integer) as o_node_id, cast(e.d_node_id as integer) as d_node_id, cast(o.zone_id as integer) as o_zone_id, cast(z.zone_id as integer) as d_zone_id, o.cell_id as o_cell_id, z.cell_id as d_cell_id, 1.0::double as volume,
  cast(s.start_sec//3600 as integer) as hh, cast(s.start_sec%3600//60 as integer) as mm, cast(s.start_sec%60 as integer) as ss, round(s.start_min,6) as departure_time, round(s.end_min,6) as end_time_in_min, round(s.end_min-s.start_min,6) as travel_time, round(coalesce(p.distance,0),6) as distance,
  round(coalesce(p.distance,0)/1000/greatest({d(0.01)},(s.end_min-s.start_min)/60),6) as speed_kmph, round(coalesce(p.distance,0)/1000/greatest({d(0.01)},(s.end_min-s.start_min)/60)*{d(0.621371)},6) as speed_mph,
  coalesce(p.node_sequence,'') as node_sequence, '' as o_osm_way_id, '' as d_osm_way_id, case when p.distance is null then '' else 'T' end as osm_way_id_od_key, coalesce(p.geometry,'') as geometry
  from ends e join spans s using (agent_id)
  left join (select n.node_id, n.cell_id, f.zone_id from ix n join fz f using (x_index, y_index)) o on o.node_id=e.o_node_id left join (select n.node_id, n.cell_id, f.zone_id from ix n join fz f using (x_index, y_index)) z on z.node_id=e.d_node_id
  left join (select agent_id, sum(length) as distance, concat(string_agg(from_node_id, ';' order by road_sequence), ';', arg_max(to_node_id, road_sequence), ';') as node_sequence, {_LINESTRING.format('flatten(list(shape order by road_sequence))')} as geometry from steps group by agent_id) p on p.agent_id=e.agent_id""", "arcs", _STEPS))
_STATIC_USES = "uses as (select link_seq, count(*) as use_count from way group by link_seq)"
register("a21_static_use_counts", lambda m: tdpaths.use_counts(m.paths), sql("select * from uses", "arcs", f"{_STEPS},\n{_STATIC_USES}"))
# One element per event, in order, with a table of the bins that its link's events can reach; folded from left to right.
_FOLD = f"""ev as (select s.agent_id, s.link_seq, x.x_index, x.y_index, s.g, s.trace_no, s.hit, case when s.hit then coalesce(s.beside,{R}) else s.nonhit*10 end as cost,
  greatest(0, least(t.bins-1, cast(trunc((s.sec/60-t.t0)/{B}+{d(0.5)}) as integer))) as bin, greatest(1, cast(trunc(a.sampling_min/{B}) as integer)) as reach, t.bins
  from scored s join cells x using (cell_id) join sampling a using (agent_id) cross join span t where s.nonhit is not null),
lim as (select agent_id, link_seq, min(greatest(0,bin-reach)) as low, max(least(bin+reach,bins)) as high from ev group by all),
fold as (select q.agent_id, q.link_seq, l.low, list_reduce(list(struct_pack(a := greatest(0,bin-reach)-low, z := least(bin+reach,bins)-low, b := bin-low, cost := cost, trace_no := trace_no, hit := hit,
    costs := list_resize([]::double[], high-low, {d(999.0)}), who := list_resize([]::bigint[], high-low, -1), hits := list_resize([]::boolean[], high-low, false)) order by x_index, y_index, g),
    lambda acc, nxt: case when nxt.cost < acc.costs[nxt.b+1] then struct_pack(a := nxt.a, z := nxt.z, b := nxt.b, cost := nxt.cost, trace_no := nxt.trace_no, hit := nxt.hit,
      costs := list_transform(acc.costs, lambda v, i: case when i > nxt.a and i <= nxt.z then nxt.cost else v end), who := list_transform(acc.who, lambda v, i: case when i > nxt.a and i <= nxt.z then nxt.trace_no else v end), hits := list_transform(acc.hits, lambda v, i: case when i > nxt.a and i <= nxt.z then nxt.hit else v end)) else acc end,
    struct_pack(a := 0::bigint, z := 0::bigint, b := 0::bigint, cost := 0.0::double, trace_no := -1::bigint, hit := false, costs := list_resize([]::double[], any_value(high-low), {d(999.0)}), who := list_resize([]::bigint[], any_value(high-low), -1), hits := list_resize([]::boolean[], any_value(high-low), false))) as s
  from ev q join lim l using (agent_id, link_seq) group by q.agent_id, q.link_seq, l.low),
bc as materialized (select agent_id, link_seq, low+i-1 as bin, s.costs[i] as cost, s.who[i] as trace_no, s.hits[i] as hit from fold, lateral (select unnest(generate_series(1, len(s.costs))) as i) where s.who[i] >= 0)"""
register("l03_bin_costs", lambda m: m.bin_rows().select("agent_id", "link_seq", "bin", r6("cost", "cost"), "trace_no", "hit"), sql("select agent_id, link_seq, bin, round(cost,6) as cost, cast(trace_no as integer) as trace_no, hit from bc", "arcs", _FOLD))
register("k08_bin_cost_log", lambda m: outputs.bin_cost_log(m.bin_rows(), m.links).select("agent_id", "from_node_id", "to_node_id", "time_index", "sec", r6("cost", "cost"), "hit", "trace_no"), sql(f"select b.agent_id, cast(l.from_node_id as integer) as from_node_id, cast(l.to_node_id as integer) as to_node_id, b.bin as time_index, cast(trunc(b.bin*{B}*60) as integer) as sec, round(b.cost,6) as cost, b.hit, cast(b.trace_no as integer) as trace_no from bc b join lk l using (link_seq) where b.cost < 998", "arcs", _FOLD))
# The (node, bin) program: a tick a round per agent; its row (node -1) holds the bin whose labels move on.
_BIN = lambda c: f"greatest(0, least(t.bins-1, cast(trunc(({c}-t.t0)/{B}+{d(0.5)}) as bigint)))"
_TD = _FOLD + f""",
who as materialized (select e.agent_id, e.o_node_id as o, e.d_node_id as dn, {_BIN('s.start_min')} as st, {_BIN('s.last_min')} as en, cast(t.bins as bigint) as bins from ends e join spans s using (agent_id) cross join span t where e.o_node_id is not null and e.d_node_id is not null),
arc as materialized (select a.agent_id, l.link_seq, l.from_node_id as f, l.to_node_id as h, greatest(1, cast(trunc(l.fft_min/{B}*{d(0.7)}+{d(0.5)}) as bigint)) as least_, greatest(1, cast(trunc(l.fft_min/{B}+{d(0.5)}) as bigint)) as usual from (select distinct agent_id, link_seq from cand) a join lk l using (link_seq)),
wait as materialized (select agent_id, bin, arg_max(dwell_bins, g) as dwell_bins from (select k.agent_id, k.g, {_BIN('(k.sec-k.interval_s)/60')} as bin, cast(trunc(k.interval_s/60/{B}) as bigint) as dwell_bins from deltas k join sampling a using (agent_id) cross join span t where k.interval_s > a.sampling_min*60*5) group by agent_id, bin),
td(agent_id, node, bin, cost, k, since) using key (agent_id, node, bin) as (
  (select agent_id, o, st, 0.0::double, -1::bigint, -1::bigint from who union all select agent_id, -1, -1, st::double, -1, -1 from who)
  union
  (select m.agent_id, m.node, m.bin, m.cost, m.k, m.since from (
     select agent_id, node, bin, min(cost) as cost, arg_min(k, struct_pack(c := cost, k := k)) as k, any_value(since) as since from (
       select r.agent_id, a.h as node, unnest(range(least(x.t+a.least_, w.bins-1), least(greatest(least(x.t+greatest(1, coalesce(v.dwell_bins,0), a.usual*10), w.bins), least(x.t+a.least_, w.bins-1)+1), w.en+1, w.bins))) as bin,
         r.cost+coalesce(b.cost, {d(oracle.INACTIVE)}) as cost, a.link_seq as k, x.t as since
       from (select agent_id, cast(cost as bigint) as t from td where node = -1) x join who w on w.agent_id=x.agent_id join recurring.td r on r.agent_id=x.agent_id and r.bin=x.t and r.node >= 0
         join arc a on a.agent_id=r.agent_id and a.f=r.node left join bc b on b.agent_id=a.agent_id and b.link_seq=a.link_seq and b.bin=x.t left join wait v on v.agent_id=x.agent_id and v.bin=x.t
       where greatest(1, coalesce(v.dwell_bins,0), a.usual*10) > a.least_) group by agent_id, node, bin) m
     where m.cost < coalesce((select r.cost from recurring.td r where r.agent_id=m.agent_id and r.node=m.node and r.bin=m.bin), {d(999999.0)})
   union all
   select x.agent_id, -1, -1, x.cost+1, -1, -1 from td x join who w on w.agent_id=x.agent_id where x.node = -1 and x.cost < w.en)),
goal as (select w.agent_id, w.dn, case when min(z.cost) < coalesce(min(z.cost) filter (where z.bin = w.en), {d(999999.0)}) then arg_min(z.bin, struct_pack(c := z.cost, b := z.bin)) else w.en end as bin
  from who w join td z on z.agent_id=w.agent_id and z.node=w.dn and z.bin between greatest(0, w.en-5) and w.en group by w.agent_id, w.dn, w.en),
back(agent_id, n, k, since, bin, cost) as (
  select g.agent_id, 1, z.k, z.since, z.bin, z.cost from goal g join td z on z.agent_id=g.agent_id and z.node=g.dn and z.bin=g.bin where z.k >= 0
  union all
  select y.agent_id, y.n+1, z.k, z.since, z.bin, z.cost from back y join lk l on l.link_seq=y.k join td z on z.agent_id=y.agent_id and z.node=l.from_node_id and z.bin=y.since where z.k >= 0),
tp as (select y.agent_id, cast(row_number() over (partition by y.agent_id order by y.n desc) as integer) as road_sequence, y.k as link_seq, cast(l.from_node_id as integer) as from_node_id, cast(l.to_node_id as integer) as to_node_id, cast(y.since as integer) as time_index, cast(y.bin as integer) as time_index_t, y.cost as label_cost from back y join lk l on l.link_seq=y.k)"""
register("g02_td_paths", lambda m: m.td_paths.select(*[r6(c, c) if c == "label_cost" else F.col(c) for c in m.td_paths.columns]), sql("select * replace (round(label_cost,6) as label_cost) from tp", "arcs", _TD))
register("g03_static_price_update", lambda m: m.updated_prices(tdpaths.use_counts(m.paths)).select("agent_id", "link_seq", "bin", r6("cost", "cost")), sql("select b.agent_id, b.link_seq, b.bin, round(case when b.hit and h.hits is not null then b.cost-100*h.hits else b.cost end, 6) as cost from bc b left join (select agent_id, link_seq, hit_count as hits from costs where hit_count >= 1 and link_seq not in (select link_seq from uses)) h using (agent_id, link_seq)", "arcs", f"{_STEPS},\n{_STATIC_USES},\n{_FOLD}"))
# the SQL of these two would walk the table of g02 again; over static paths they have some above
register("g03_price_update", lambda m: m.updated_prices(tdpaths.use_counts(m.td_paths)))
register("a21_use_counts", lambda m: tdpaths.use_counts(m.td_paths))
# two searches of g02's size: held to a plain version in the tests
register("g03_lr_rounds", lambda m: (lambda p: p.select("agent_id", "round", "road_sequence", "link_seq", "from_node_id", "to_node_id", "time_index", "time_index_t", r6("label_cost", "label_cost")))(m.price_rounds(2).paths))
_CLOCK = "select p.*, l.length, l.fft_sec, l.shape, l.fx, l.fy, s.start_min, t.t0+p.time_index*" + B + " as minute, cast(trunc((p.time_index_t-p.time_index)*" + d(60 * oracle.TIME_BIN) + "+" + d(0.5) + ") as integer) as tt from tp p join lk l using (link_seq) join spans s using (agent_id) cross join span t"
register("k05_td_route", lambda m: m.td_route.select(*[r6(c, c) if c in ("label_cost", "timestamp_minute") else F.col(c) for c in m.td_route.columns]), sql(f"""select agent_id, road_sequence, cast(trunc((minute-start_min)*60+{d(0.5)}) as integer) as cumu_time_in_sec, time_index, time_index_t, time_index_t-time_index as time_index_diff, tt as travel_time_in_sec, round(minute,6) as timestamp_minute,
  from_node_id, to_node_id, length, fft_sec as "FFTT_in_sec", tt-fft_sec as delay_in_sec, sum(length) over (partition by agent_id order by road_sequence) as cumu_distance, round(label_cost,6) as label_cost,
  cast(trunc(minute/60) as integer) as hh, cast(trunc(minute-cast(trunc(minute/60) as integer)*60) as integer) as mm, cast(trunc((minute-cast(trunc(minute/60) as integer)*60-cast(trunc(minute-cast(trunc(minute/60) as integer)*60) as integer))*60) as integer) as ss,
  {_LINESTRING.format('shape')} as geometry, concat('POINT (', printf('%.6f', fx), ' ', printf('%.6f', fy), ')') as geometry_from_node from ({_CLOCK})""", "arcs", _TD))
