"""How well each link explains an agent's points: static costs, matched points, hits, and costs by time bin."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions import geo, timefn
from lanternway.functions.constants import INACTIVE, NONHIT_RATIO, RESOLUTION, TIME_BIN
from lanternway.operators.grid import cell_links

#: Groups of events below which a step over all of them costs more than their own folds.
FEW = 8

#: Numbers of an agent's trace that one window sees.
BLOCK = 1 << 16

#: Points and link rows of a cell that one group of the pair join holds, about.
POINTS, LINKS = 1 << 14, 1 << 10


def in_cell_pairs(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """Points with the next point of the same agent in the same cell (null for the last).

    A window sees at most `block` numbers of an agent's trace. The last point there takes the first of the next
    such block with points in the cell; only agents with more points than a block have any such rows.
    """
    w = Window.partitionBy("agent_id", "cell_id", "_block").orderBy("g")
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as that: the pairs that follow cost more than these rows show
    cut = kept.select("agent_id", "cell_id", "g", "x", "y", "sec", "trace_no", F.floor(F.col("g") / block).cast("int").alias("_block"))
    rows = cut.repartition(tasks, "agent_id", "cell_id", "_block").select("*", F.lead("x").over(w).alias("_nx"), F.lead("y").over(w).alias("_ny"), F.lead("g").over(w).isNull().alias("_last"))
    long_ = kept.where(F.col("g") >= block).select("agent_id").distinct()
    pieces = cut.join(long_, "agent_id", "left_semi").groupBy("agent_id", "cell_id", "_block").agg(F.min_by(F.struct("x", "y"), "g").alias("_spot"))
    after = pieces.select("agent_id", "cell_id", "_block", F.lit(True).alias("_last"), F.lead("_spot").over(Window.partitionBy("agent_id", "cell_id").orderBy("_block")).alias("_next")).where("_next is not null")
    joined = rows.join(after, ["agent_id", "cell_id", "_block", "_last"], "left")
    return joined.select("agent_id", "cell_id", "g", "x", "y", "sec", "trace_no", F.coalesce("_nx", "_next.x").alias("nx"), F.coalesce("_ny", "_next.y").alias("ny"))


def meeting(points: DataFrame, lists: DataFrame, counted: DataFrame, most_points: int = POINTS, most_links: int = LINKS) -> DataFrame:
    """Rows of `points` and `lists` with one cell, each pair once, however many of either share a cell.

    A cell of more than `most_points` points (of `counted`, the points as they are stored) or `most_links` rows of
    `lists` is cut into parts of about those sizes by hash, and each part of the one side is sent to all parts of
    the other: an equi-join on cell and parts, of which no group exceeds the two sizes by much.
    """
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    per = lambda df, n: df.groupBy("cell_id").agg(F.count("*").alias(n))
    dense = per(counted, "_n").join(per(lists, "_m"), "cell_id").select("cell_id", parts("_n", most_points).alias("_points"), parts("_m", most_links).alias("_links")).where("_points > 1 or _links > 1")

    def dealt(df: DataFrame, own: str, other: str, *key: str) -> DataFrame:
        of = lambda c: F.coalesce(F.col(c), F.lit(1))
        rows = df.join(dense, "cell_id", "left").withColumn("_own", F.pmod(F.xxhash64(*key), of(own)).cast("int"))
        return rows.withColumn("_other", F.explode(F.sequence(F.lit(0), of(other) - 1))).drop("_points", "_links").withColumnsRenamed({"_own": f"{own}_part", "_other": f"{other}_part"})

    places = "_points_part", "_links_part"
    left, right = dealt(points, "_points", "_links", "agent_id", "g"), dealt(lists, "_links", "_points", "link_seq", *(["p"] if "p" in lists.columns else []))
    return left.join(right, ["cell_id", *places]).drop(*places)


def candidates(kept: DataFrame, links: DataFrame) -> DataFrame:
    """Points and links that share a cell; dense cells are cut into parts."""
    lists = cell_links(links).select("cell_id", F.col("seq").alias("link_seq"))
    return meeting(in_cell_pairs(kept), lists, kept)


def shape_rows(kept: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with each shape point ``p`` (sx, sy) and the next one (ex, ey); one row for no shape.

    Links are unfolded before the join, so all arithmetic on the pairs is plain compiled expressions.
    """
    after = lambda c: F.get(F.col("shape"), F.col("p") + 1)[c]
    c = lambda *names: [F.col(n) for n in names]
    flat = cell_links(links).select("cell_id", F.col("seq").alias("link_seq"), "fx", "fy", "tx", "ty", "link_distance", "shape", F.posexplode_outer("shape").alias("p", "s"))
    lists = flat.select("cell_id", "link_seq", "fx", "fy", "tx", "ty", "link_distance", "p", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), after("x").alias("ex"), after("y").alias("ey"))
    # what depends on one side only is computed before the join, what is used twice has a column
    lists = lists.withColumn("bearing", geo.angle(*c("sx", "sy", "ex", "ey"))).withColumn("reach", geo.planar(*c("sx", "sy", "ex", "ey")))
    steps = in_cell_pairs(kept).withColumn("mx", (F.col("x") + F.col("nx")) / 2).withColumn("my", (F.col("y") + F.col("ny")) / 2).withColumn("heading", geo.angle(*c("x", "y", "nx", "ny")))
    rows = meeting(steps, lists, kept)
    line, segment = c("x", "y", "fx", "fy", "tx", "ty"), c("mx", "my", "sx", "sy", "ex", "ey")
    rows = rows.withColumns({"u": geo.foot(*line), "v": geo.foot(*segment)})
    rows = rows.withColumns({"away": geo.to_foot(F.col("u"), *line), "off": geo.to_foot(F.col("v"), *segment)})
    near = F.least(F.col("away"), geo.planar(*c("x", "y", "fx", "fy")), geo.planar(*c("x", "y", "tx", "ty")))
    deviation = (near * 10 + geo.planar(*c("x", "y", "sx", "sy")) + F.coalesce(geo.planar(*c("nx", "ny", "ex", "ey")), F.lit(0.0))) / 10
    beside = F.when((F.col("u") < 0) | (F.col("u") > 1), F.lit(RESOLUTION)).otherwise(F.col("away"))
    within = (F.col("off") < F.col("reach")) & (F.col("off") < geo.planar(*c("mx", "my", "sx", "sy"))) & (F.col("off") < geo.planar(*c("mx", "my", "ex", "ey")))
    hit = F.coalesce((F.col("v") >= -0.3) & (F.col("v") <= 1.3) & (geo.turn(F.col("heading"), F.col("bearing")) <= 45) & within, F.lit(False))
    return rows.select("agent_id", "link_seq", "cell_id", "g", "trace_no", "sec", "p", deviation.alias("deviation"), beside.alias("beside"), hit.alias("hit"), "link_distance")


def scored(kept: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates with ``nonhit`` (least deviation within twice the link's length, or null), ``beside`` and ``hit``."""
    near = F.when(F.col("deviation") <= F.col("link_distance") * 2, F.col("deviation"))
    per = shape_rows(kept, links).groupBy("agent_id", "link_seq", "cell_id", "g")
    return per.agg(F.min("trace_no").alias("trace_no"), F.min("sec").alias("sec"), F.min(near).alias("nonhit"), F.min("beside").alias("beside"), F.max("hit").alias("hit"))


def static_costs(scores: DataFrame, cells: DataFrame, resolution: float = RESOLUTION, combine: str = "last") -> DataFrame:
    """``agent_id, link_seq, cost, trace_no, hit_count`` of links in cells with points of the agent.

    Per cell the cost is the least deviation, `resolution` at most. A link of two such cells takes the
    cost of the cell scanned last (`combine="last"`: by column, then row), or the smaller (`"min"`).
    The matched point is the best below `resolution` of the last cell that has one, else the nearest
    by plain distance in the first cell. `cells`: ``cell_id, x_index, y_index``.
    """
    better = F.when(F.col("nonhit") < resolution, F.struct("nonhit", "g"))
    per = scores.groupBy("agent_id", "link_seq", "cell_id").agg(
        F.least(F.lit(resolution), F.coalesce(F.min("nonhit"), F.lit(resolution))).alias("c"), F.min_by("trace_no", better).alias("matched"),
        F.min_by("trace_no", F.struct(F.coalesce("beside", F.lit(float("inf"))), F.col("g"))).alias("nearest"), F.sum(F.col("hit").cast("int")).alias("hits"),
    ).join(cells, "cell_id")
    order = F.struct("x_index", "y_index")
    cost = F.min("c") if combine == "min" else F.max_by("c", order)
    matched = F.max_by("matched", F.when(F.col("matched").isNotNull(), order))
    return per.groupBy("agent_id", "link_seq").agg(cost.alias("cost"), F.coalesce(matched, F.min_by("nearest", order)).alias("trace_no"), F.sum("hits").alias("hit_count"))


def scan_order(kept: DataFrame, left: float, bottom: float, resolution: float = RESOLUTION) -> DataFrame:
    """``cell_id, x_index, y_index`` of the cells that hold points."""
    i, j = geo.cell_index(F.col("x"), F.lit(left), resolution), geo.cell_index(F.col("y"), F.lit(bottom), resolution)
    return kept.groupBy("cell_id").agg(F.min(i).alias("x_index"), F.min(j).alias("y_index"))


def bin_events(scores: DataFrame, cells: DataFrame, span: DataFrame, sampling: DataFrame) -> DataFrame:
    """Ordered events for costs by time bin: ``agent_id, link_seq, at, bin, reach, cost, trace_no, hit``.

    ``at`` is the order of the scan: cell column and row, then point. The shape points of a link need no
    events of their own: for one point they have the same bin and reach, so the least of their costs decides.
    ``span`` is one row (t0, t1, bins). An event counts for the bins within ``reach`` of its own.
    """
    full = scores.where("nonhit is not null").join(cells, "cell_id").join(F.broadcast(span)).join(sampling, "agent_id")
    reach = F.greatest(F.lit(1), (F.col("sampling_min") / F.lit(TIME_BIN)).cast("int"))
    return full.select(
        "agent_id", "link_seq", F.struct("x_index", "y_index", "g").alias("at"), timefn.time_bin(F.col("sec") / 60, F.col("t0"), F.col("bins")).alias("bin"),
        reach.alias("reach"), F.when(F.col("hit"), F.coalesce("beside", F.lit(RESOLUTION))).otherwise(F.col("nonhit") * NONHIT_RATIO).alias("cost"), "trace_no", "hit", "bins",
    )


def fold_bins(bin_: Iterable[int], reach: Iterable[int], cost: Iterable[float], bins: int, first: int = 0, held: dict[int, tuple[float, int]] | None = None) -> dict[int, tuple[float, int]]:
    """By bin (cost, event that wrote it, numbered from `first`) of one link after its events in order; `held` before them.

    Only the event's own bin is compared; all bins within reach are written, even if that raises them.
    """
    out = {} if held is None else held
    none = (INACTIVE, -1)
    for i, (b, k, c) in enumerate(zip(bin_, reach, cost, strict=True), first):
        if c < out.get(b, none)[0]:
            now = (c, i)
            for t in range(max(0, b - k), min(b + k, bins)):
                out[t] = now
    return out


def fold_together(bin_: np.ndarray, reach: np.ndarray, cost: np.ndarray, bins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folds of many groups at once: (group, bin, event that wrote it) of every bin written.

    Group i has the events from ``first[i]`` on, in order. All bins that a group can write stand in one row of
    cells; a step takes the next event of each group, compares its own bin, and writes its stretch of bins. Where
    fewer than `FEW` groups are left, they are folded one by one.
    """
    size = np.diff(np.append(first, len(bin_)))
    low, high = np.maximum(0, bin_ - reach), np.maximum(np.minimum(bin_ + reach, bins), bin_ + 1)
    base, top = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    offset = np.cumsum(top - base) - (top - base) - base  # of a group's bin 0 in the row of cells
    held, by = np.full(int((top - base).sum()), INACTIVE), np.full(int((top - base).sum()), -1, np.int64)
    order = np.argsort(-size, kind="stable")
    stop = np.minimum(bin_ + reach, bins)
    most = int(size.max())
    ahead = np.searchsorted(-size[order], -np.arange(1, most + 1), side="right")  # groups with more than so many events
    step = 0
    while step < most and ahead[step] >= FEW:
        groups = order[: ahead[step]]
        e = first[groups] + step
        wins = cost[e] < held[offset[groups] + bin_[e]]
        e, groups = e[wins], groups[wins]
        n = np.maximum(stop[e] - low[e], 0)
        cell = np.repeat(offset[groups] + low[e] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held[cell], by[cell] = np.repeat(cost[e], n), np.repeat(e, n)
        step += 1
    for g in order[: ahead[step]].tolist() if step < most else ():
        o, z = int(offset[g]), int(first[g] + size[g])
        a = int(first[g]) + step
        state = {b: (c, w) for b, c, w in zip(range(int(base[g]), int(top[g])), held[o + base[g] : o + top[g]].tolist(), by[o + base[g] : o + top[g]].tolist(), strict=True) if w >= 0}
        for b, (c, w) in fold_bins(bin_[a:z].tolist(), reach[a:z].tolist(), cost[a:z].tolist(), int(bins[a]), a, state).items():
            held[o + b], by[o + b] = c, w
    cells = np.flatnonzero(by >= 0)
    group = np.searchsorted(np.cumsum(top - base), cells, side="right")
    return group, cells - offset[group], by[cells]


def bin_costs(events: DataFrame) -> DataFrame:
    """``agent_id, link_seq, bin, cost, trace_no, hit``: the exact ordered fold, per agent and link.

    Events are dealt by agent and link and sorted there, in Spark. A task folds the links that lie whole in a
    batch together; of one that goes over the batch's end it holds the bins, so the points of an agent need
    not fit anywhere.
    """
    names = ["agent_id", "link_seq", "bin", "reach", "cost", "trace_no", "hit", "bins"]
    order = ["agent_id", "link_seq", "x_index", "y_index", "g"]
    flat = events.select("agent_id", "link_seq", "at.*", "bin", "reach", "cost", "trace_no", "hit", "bins")
    out_names = ["agent_id", "link_seq", "bin", "cost", "trace_no", "hit"]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, marks, seen = None, {}, {}, 0  # of the open link: bins, (trace_no, hit) of the events that wrote them, events so far

        def closed() -> pa.RecordBatch:
            rows = [(*key, b, c, *marks[i]) for b, (c, i) in held.items()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], out_names)

        for batch in batches:
            if not batch.num_rows:
                continue
            agent, link = batch.column(0), batch.column(1).to_numpy()
            bin_, reach, cost, bins = (batch.column(c).to_numpy() for c in (2, 3, 4, 7))
            other = pc.not_equal(agent[1:], agent[:-1]).to_numpy(zero_copy_only=False) | (link[1:] != link[:-1])
            new = np.append(0, np.flatnonzero(other) + 1)
            for i in sorted({0, len(new) - 1}):  # the first may go on from the batch before, the last may go on in the next
                a, z = int(new[i]), int(new[i + 1]) if i + 1 < len(new) else batch.num_rows
                now = agent[a].as_py(), int(link[a])
                if now != key:
                    if key is not None:
                        yield closed()
                    key, held, marks, seen = now, {}, {}, 0
                held = fold_bins(bin_[a:z].tolist(), reach[a:z].tolist(), cost[a:z].tolist(), int(bins[a]), seen, held)
                trace_no, hit = batch.column(5)[a:z].to_pylist(), batch.column(6)[a:z].to_pylist()
                marks |= {i: (trace_no[i - seen], hit[i - seen]) for _, i in held.values() if i >= seen}
                marks = {i: marks[i] for _, i in held.values()}
                seen += z - a
            if len(new) > 2:
                a, z = int(new[1]), int(new[-1])
                group, b, e = fold_together(bin_[a:z].astype(np.int64), reach[a:z].astype(np.int64), cost[a:z], bins[a:z].astype(np.int64), new[1:-1] - a)
                event = pa.array(e + a)
                yield pa.RecordBatch.from_arrays([agent.take(event), batch.column(1).take(event), pa.array(b), batch.column(4).take(event), batch.column(5).take(event), batch.column(6).take(event)], out_names)
        if key is not None:
            yield closed()

    sorted_ = flat.repartition("agent_id", "link_seq").sortWithinPartitions(*order).select(*names)
    return sorted_.mapInArrow(fold, "agent_id string, link_seq long, bin long, cost double, trace_no int, hit boolean")
