"""Origin and destination: the links that fit the first and the last two points of a trace best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.functions import geo
from lanternway.functions.constants import RESOLUTION
from lanternway.operators.storage import saved


def permitted(allowed: Column, blocked: Column, code: Column) -> Column:
    """A link's type code must be part of the allowed codes and no part of the blocked ones, if both are given."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    lacks = has(allowed) & has(code) & ~F.coalesce(F.contains(allowed, code), F.lit(False))
    barred = has(blocked) & has(code) & F.coalesce(F.contains(blocked, code), F.lit(False))
    return ~lacks & ~barred


def boundary_points(kept: DataFrame) -> DataFrame:
    """Per agent the first two and the last two points; a single point stands for all four."""
    p = F.struct("x", "y")
    per = kept.groupBy("agent_id").agg(F.min_by(p, "g").alias("a0"), F.min_by(p, F.when(F.col("g") == 1, F.col("g"))).alias("a1"), F.max_by(p, "g").alias("z1"), F.max("g").alias("last"))
    before = kept.join(per.select("agent_id", "last"), "agent_id").where(F.col("g") == F.col("last") - 1).select("agent_id", p.alias("z0"))
    full = per.join(before, "agent_id", "left")
    return full.select("agent_id", "a0", F.coalesce("a1", "a0").alias("a1"), F.coalesce("z0", "z1").alias("z0"), "z1", (F.col("last") + 1).alias("n_points"))


def with_score(pairs: DataFrame) -> DataFrame:
    """Adds ``score``: how badly a link (fx, fy, tx, ty, link_distance, bearing) fits two points (p0, p1, heading).

    Smaller is better. Feet of the points are columns of their own, so the plan stays small.
    """
    link = [F.col(c) for c in ("fx", "fy", "tx", "ty")]
    p, q = [F.col("p0.x"), F.col("p0.y")], [F.col("p1.x"), F.col("p1.y")]
    rows = pairs.withColumns({"_u": geo.foot(*p, *link), "_v": geo.foot(*q, *link), "_from": geo.planar(*p, *link[:2]), "_to": geo.planar(*q, *link[2:])})
    beside = lambda u, at: F.when((F.col(u) < 0) | (F.col(u) > 1), F.lit(RESOLUTION)).otherwise(geo.to_foot(F.col(u), *at, *link))
    plain = F.when(geo.well_conditioned(F.col("link_distance"), F.col("length")), (beside("_u", p) + beside("_v", q) + F.col("_from") + F.col("_to")) / 4).otherwise(F.least("_from", "_to"))
    return rows.withColumn("score", plain * F.when(geo.turn(F.col("heading"), F.col("bearing")) > 45, 10.0).otherwise(1.0))


def best_ends(asked: DataFrame, links: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``agent_id, which, link_seq, score``: the best permitted link for each (agent, which, p0, p1, length).

    A link scores at least half of what both its from node is away from p0 and its to node from p1. So
    candidates come from an equi-join on grid cells around the two points, and a best score of at
    most half a cell is final. Agents left over are asked again on a grid four times as coarse, until
    one cell covers all: then all links are candidates. No step compares all agents with all links.
    Each round is written, so that rounds do not repeat each other's work.
    """
    asked = saved(asked.withColumn("heading", geo.angle(F.col("p0.x"), F.col("p0.y"), F.col("p1.x"), F.col("p1.y"))), "od-asked")
    box = links.agg(F.min(F.least("fx", "tx")), F.max(F.greatest("fx", "tx")), F.min(F.least("fy", "ty")), F.max(F.greatest("fy", "ty"))).first()
    if box[0] is None:
        return asked.select("agent_id", "which", F.lit(None).cast("long").alias("link_seq"), F.lit(None).cast("double").alias("score")).limit(0)
    reach = asked.agg(F.min(F.least("p0.x", "p1.x")), F.max(F.greatest("p0.x", "p1.x")), F.min(F.least("p0.y", "p1.y")), F.max(F.greatest("p0.y", "p1.y"))).first()
    if reach[0] is None:
        return asked.select("agent_id", "which", F.lit(None).cast("long").alias("link_seq"), F.lit(None).cast("double").alias("score")).limit(0)
    # who may use no link at all would be asked in every round and meet all links in the last
    codes = links.select(F.coalesce("link_type_code", F.lit("")).alias("code")).distinct()
    users = asked.select("allowed", "blocked").distinct()
    able = saved(users.join(codes, permitted(F.col("allowed"), F.col("blocked"), F.col("code"))).select(F.col("allowed").alias("_a"), F.col("blocked").alias("_b")).distinct(), "od-able")
    asked = asked.join(able, F.col("allowed").eqNullSafe(F.col("_a")) & F.col("blocked").eqNullSafe(F.col("_b")), "left_semi").where("p0.x is not null and p0.y is not null and p1.x is not null and p1.y is not null")
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs cost more than the rows they come from show
    span = max(max(box[1], reach[1]) - min(box[0], reach[0]), max(box[3], reach[3]) - min(box[2], reach[2]))
    side, out, left = resolution, None, asked
    keyed = links.select(F.col("seq").alias("link_seq"), "fx", "fy", "tx", "ty", "link_distance", "link_type_code", geo.angle(*[F.col(c) for c in ("fx", "fy", "tx", "ty")]).alias("bearing"))
    while True:
        at = lambda v, s=side: F.floor(v / F.lit(s)).cast("long")
        homes = keyed.withColumn("k", F.explode(F.array(F.struct(F.lit(0).alias("e"), at(F.col("fx")).alias("i"), at(F.col("fy")).alias("j")), F.struct(F.lit(1).alias("e"), at(F.col("tx")).alias("i"), at(F.col("ty")).alias("j"))))).select("link_seq", "fx", "fy", "tx", "ty", "link_distance", "link_type_code", "bearing", "k.e", "k.i", "k.j")
        step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        spots = left.withColumn("_k", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("p0").alias("p")), F.struct(F.lit(1).alias("e"), F.col("p1").alias("p"))))).withColumn("_i", step).withColumn("_j", step)
        spots = spots.withColumn("e", F.col("_k.e")).withColumn("i", at(F.col("_k.p.x")) + F.col("_i")).withColumn("j", at(F.col("_k.p.y")) + F.col("_j"))
        pairs = with_score(spots.join(homes.repartition(tasks, "e", "i", "j"), ["e", "i", "j"]).where(permitted(F.col("allowed"), F.col("blocked"), F.col("link_type_code"))))
        one = F.when(F.col("score").isNotNull(), F.struct("score", "link_seq"))  # asked here, not before the join, where it would be computed twice
        best = pairs.groupBy("agent_id", "which").agg(F.min(one).alias("b")).where("b is not null").select("agent_id", "which", "b.link_seq", "b.score")
        done = side > span
        sure = saved(best if done else best.where(F.col("score") <= side / 2), "od-found")
        out = sure if out is None else out.unionByName(sure)
        if done:
            return out
        left = left.join(sure.select("agent_id", "which"), ["agent_id", "which"], "left_anti")
        side *= 4
        if left.isEmpty():
            return out


def choose(kept: DataFrame, given: DataFrame, segments: DataFrame, links: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``agent_id, o_node_id, d_node_id, o_link_seq, d_link_seq, o_score, d_score`` for agents with points.

    A given node stands. Else the origin is the from node of the best link at the start, and the
    destination the to node of the best link at the end. Ties go to the first link.
    """
    base = saved(boundary_points(kept).join(segments, "agent_id").join(given, "agent_id", "left"), "od-base")
    ask = lambda which, node, p0, p1, length: base.where(F.col(node).isNull()).select("agent_id", F.lit(which).alias("which"), F.col(p0).alias("p0"), F.col(p1).alias("p1"), F.col(length).alias("length"), "allowed", "blocked")
    asked = ask("o", "o_node_id", "a0", "a1", "first_length").unionByName(ask("d", "d_node_id", "z0", "z1", "last_length"))
    found = best_ends(asked, links, resolution).join(links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id"), "link_seq")
    side = lambda w, node, out: found.where(F.col("which") == w).select("agent_id", F.col(node).alias(f"_{out}"), F.col("link_seq").alias(f"{out}_link_seq"), F.col("score").alias(f"{out}_score"))
    full = base.join(side("o", "from_node_id", "o"), "agent_id", "left").join(side("d", "to_node_id", "d"), "agent_id", "left")
    return full.select("agent_id", F.coalesce("o_node_id", "_o").alias("o_node_id"), F.coalesce("d_node_id", "_d").alias("d_node_id"), "o_link_seq", "d_link_seq", "o_score", "d_score")
