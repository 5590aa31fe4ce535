"""Road network and traces derived from the ``part`` and ``events`` tables, by SQL that any engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "select p_partkey as node_id, cast(-112.0 as double) + cast(p_partkey % 12 as double) * cast(0.004 as double) as x_coord, "
    "cast(33.4 as double) + cast((p_partkey - p_partkey % 12) / 12 as double) * cast(0.004 as double) as y_coord, "
    "case when p_size % 5 = 0 then p_size else 0 end as zone_id, p_size from {part}"
)
_DEC = "cast(cast({} as decimal(10,6)) as string)"
_LINE = ", ' ', ".join(_DEC.format(c) for c in ("f.x_coord", "f.y_coord")), ", ' ', ".join(_DEC.format(c) for c in ("(f.x_coord + t.x_coord) / 2", "(f.y_coord + t.y_coord) / 2")), ", ' ', ".join(_DEC.format(c) for c in ("t.x_coord", "t.y_coord"))
LINKS = (
    "select f.node_id * 4 + d.dir as link_id, f.node_id as from_node_id, t.node_id as to_node_id, cast(300 + f.p_size * 4 as double) as length, "
    "cast(f.p_size % 5 as double) * cast(0.1 as double) as vdf_fftt1, case when f.p_size % 7 = 0 then 'f' else 'a' end as link_type_code, "
    "f.x_coord as fx, f.y_coord as fy, t.x_coord as tx, t.y_coord as ty, concat('LINESTRING (', " + ", ',', ".join(_LINE) + ", ')') as geometry "
    "from {nodes} f cross join (select 0 as dir, 1 as step union all select 1, -1 union all select 2, 12 union all select 3, -12) d join {nodes} t on t.node_id = f.node_id + d.step "
    "where not (d.dir = 0 and f.node_id % 12 = 11) and not (d.dir = 1 and f.node_id % 12 = 0)"
)
# A user's trace starts at node `col` of row `row`, any row that leaves eleven above it; one user in five goes up to 40 nodes up.
TRACE = (
    "select concat('u', cast(user_id as string)) as agent_id, user_id, r as trace_no, event_id as trace_id, "
    "case when event_id % 97 = 0 then cast(-110.0 as double) else cast(-112.0 as double) + cast(0.004 as double) * (cast(col as double) + least(cast(r as double) / 4, cast(5 as double))) + cast((event_id * 37) % 41 - 20 as double) * cast(0.00001 as double) end as x_coord, "
    "cast(33.4 as double) + cast(0.004 as double) * (cast(row_no as double) + least(greatest(cast(r as double) / 4 - 5, cast(0 as double)), cast(case when user_id % 5 = 2 then 40 else 5 end as double))) + cast((event_id * 53) % 41 - 20 as double) * cast(0.00001 as double) as y_coord, "
    "case when user_id % 10 = 3 and r = 0 then row_no * 12 + col end as o_node_id, "
    "case when user_id % 4 = 1 then 'a' else '' end as allowed_link_type_code, case when user_id % 4 = 2 then 'f' else '' end as blocked_link_type_code, "
    "25200 + (user_id % 600) * 60 + r * 5 + case when r > 20 then 60 else 0 end as sec "
    "from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as r, (user_id * 5) % 6 as col, (user_id * 7919) % greatest(n_rows - 11, 1) as row_no "
    "from {events} cross join (select cast(floor((max(p_partkey) + 1) / 12) as bigint) as n_rows from {part}) size) q"
)


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, trace) as typed columns."""
    part, events = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "events"))
    nodes = spark.sql(NODES, part=part)
    return nodes, spark.sql(LINKS, nodes=nodes), spark.sql(TRACE, events=events, part=part)


def text_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same as text columns plus ``seq``, as a reader of text files gives them.

    A point's ``seq`` leaves each user 2**31 places, so it is unique however many points a user has.
    """
    nodes, links, trace = tables(spark, sf_dir)
    text = lambda df, seq: df.select(seq.cast("long").alias("seq"), *[F.col(c).cast("string").alias(c) for c in df.columns])
    clock = trace.withColumn("hh", F.floor(F.col("sec") / 3600)).withColumn("mm", F.floor(F.col("sec") % 3600 / 60)).withColumn("ss", F.col("sec") % 60).withColumn("d_node_id", F.lit(None).cast("int"))
    return text(nodes.drop("p_size"), F.col("node_id")), text(links.withColumnRenamed("vdf_fftt1", "VDF_fftt1").drop("fx", "fy", "tx", "ty"), F.col("link_id")), text(clock.drop("sec"), F.col("user_id").cast("long") * 2147483648 + F.col("trace_no")).drop("user_id")
