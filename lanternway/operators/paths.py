"""Least-cost paths per agent on the static likelihood costs.

An agent's own links (in cells with its points) cost what they deviate, all others 999, or 9999.99 where the
agent may not go. So a way over own links that costs less than 999 is the cheapest of all, and most agents need
no more of the network than that. The rest are searched on the surroundings of their own nodes: squares of a
grid, four times as wide in each round, until no node outside is nearer than the target. No step sends the
network to tasks or to the driver, and all sizes take the same plan.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternway.functions.constants import FORBIDDEN, INACTIVE, RESOLUTION
from lanternway.operators.od import permitted
from lanternway.operators.storage import saved

#: Links around one agent that a task holds (about 40 bytes each); an agent that needs more is searched as a table.
REGION = 1 << 22
PATH_SCHEMA = "agent_id string, road_sequence int, link_seq long, from_node_id int, to_node_id int, label_cost double, total_cost double"
#: `road_sequence` of the one row of an agent whose search has not ended: ask wider squares, or search it as a table.
WIDER, TABLE = 0, -1


def least_path(origin: int, target: int, seq: np.ndarray, tail: np.ndarray, head: np.ndarray, price: np.ndarray, inside: np.ndarray, limit: float = math.inf) -> list[tuple[int, float, float]] | None:
    """(place of the link, label at its from node, total) along the least-cost path, [] without one; ties to the first link.

    `inside`: whether a link's to node has all its links here. None: the search has met a node that has not, or
    a label of `limit`, before the target.
    """
    ids = np.unique(np.concatenate([tail, head, [origin, target]]))
    order = np.lexsort((seq, np.searchsorted(ids, tail)))
    tails, heads = np.searchsorted(ids, tail)[order], np.searchsorted(ids, head)[order]
    first = np.searchsorted(tails, np.arange(len(ids) + 1))
    known = np.ones(len(ids), bool)
    known[heads[~inside[order]]] = False
    seq, price = seq[order], price[order]
    o, d = (int(np.searchsorted(ids, x)) for x in (origin, target))
    label, by, done, heap = {o: 0.0}, {}, set(), [(0.0, o)]
    while heap:
        at, u = heapq.heappop(heap)
        if u in done:
            continue
        if at >= limit:
            return None
        if u == d:
            break
        if not known[u]:
            return None
        done.add(u)
        a, z = first[u], first[u + 1]
        for e, v, w in zip(range(a, z), heads[a:z].tolist(), price[a:z].tolist(), strict=True):
            if v in done:
                continue
            new, old = at + w, label.get(v)
            if old is None or new < old or (new == old and seq[e] < seq[by[v]]):
                label[v], by[v] = new, e
                heapq.heappush(heap, (new, v))
    if d not in label:
        return None if limit < math.inf else []
    out, v = [], d
    while v != o:
        e = by[v]
        v = int(tails[e])
        out.append((int(order[e]), label[v], label[d]))
    return out[::-1]


def searched(rows: DataFrame, limit: float, most: int) -> DataFrame:
    """Paths, or a row that says what to do next, of every agent in `rows` (``agent_id, kind, a, b, c, i, j, price``).

    Kind 0: origin a and target b. Kind 1: a square (i, j) whose links are all here. Kind 2: link a from node b
    to node c, which lies in square (i, j). Agents come as a sorted stream.
    """
    names = [c.split()[0] for c in PATH_SCHEMA.split(", ")]
    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())

    def answer(agent: str, held: list[pa.RecordBatch], count: int) -> list[tuple]:
        if count > most:
            return [(agent, TABLE, None, None, None, None, None)]
        table = pa.Table.from_batches(held).combine_chunks()
        kind = table.column("kind").to_numpy()
        part = lambda k, *columns: [pc.fill_null(table.column(c), 0).to_numpy()[kind == k] for c in columns]
        origin, target = (int(x[0]) for x in part(0, "a", "b"))
        seq, tail, head, i, j = part(2, "a", "b", "c", "i", "j")
        squares = np.unique(np.stack(part(1, "i", "j"), 1), axis=0)
        inside = np.ones(len(seq), bool)
        if limit == math.inf and len(seq):
            spot, at = np.unique(np.stack([i, j], 1), axis=0, return_inverse=True)
            here = set(map(tuple, squares.tolist()))
            inside = np.array([tuple(x) in here for x in spot.tolist()])[at.ravel()]
        found = least_path(origin, target, seq, tail, head, part(2, "price")[0], inside, limit)
        if found is None:
            return [(agent, WIDER, None, None, None, None, None)]
        return [(agent, n + 1, int(seq[e]), int(tail[e]), int(head[e]), label, total) for n, (e, label, total) in enumerate(found)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent, held, count, out = None, [], 0, []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            who = batch.column(0)
            ends = [0, *(np.flatnonzero(pc.not_equal(who[1:], who[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, z in zip(ends, ends[1:], strict=False):
                now = who[a].as_py()
                if now != agent:
                    if agent is not None:
                        out += answer(agent, held, count)
                    agent, held, count = now, [], 0
                count += z - a
                if count <= most:
                    held.append(batch.slice(a, z - a))
            if len(out) > 10_000:
                yield made()
                out.clear()
        if agent is not None:
            out += answer(agent, held, count)
        yield made()

    return rows.repartition("agent_id").sortWithinPartitions("agent_id", "kind", "a").mapInArrow(run, PATH_SCHEMA)


def _row(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    value = {c: given.get(c, F.lit(None)) for c in ("a", "b", "c", "i", "j", "price")}
    return df.select("agent_id", F.lit(kind).alias("kind"), *[v.cast("double" if c == "price" else "long").alias(c) for c, v in value.items()])


def shortest_paths(ends: DataFrame, costs: DataFrame, links: DataFrame, limit: int = REGION, resolution: float = RESOLUTION) -> DataFrame:
    """One row per link of each agent's path, with the label at the link's from node.

    `ends`: ``agent_id, o_node_id, d_node_id, allowed, blocked``. `costs`: ``agent_id, link_seq, cost``. Agents
    without both ends, or without a way, have no rows. `limit`: rows that a task holds for one agent; an agent
    that needs more is searched by `relaxed_paths`. A round is one table, the next one has squares four times
    as wide; a search that ends without meeting an edge of its squares is final, with or without a way.
    """
    c = F.col
    asked = ends.where("o_node_id is not null and d_node_id is not null and o_node_id <> d_node_id").select("agent_id", "o_node_id", "d_node_id", "allowed", "blocked")
    arcs = links.select(c("seq").alias("link_seq"), "from_node_id", "to_node_id", "link_type_code", "fx", "fy", "tx", "ty")
    fine = permitted(c("allowed"), c("blocked"), c("link_type_code"))
    own = saved(costs.select("agent_id", "link_seq", "cost").join(asked.select("agent_id", "allowed", "blocked"), "agent_id").join(arcs, "link_seq"), "own-links")
    link = {"a": c("link_seq"), "b": c("from_node_id"), "c": c("to_node_id")}
    header = _row(asked, 0, a=c("o_node_id"), b=c("d_node_id"))
    found = saved(searched(header.unionByName(_row(own, 2, **link, price=F.when(fine, c("cost")).otherwise(FORBIDDEN))), INACTIVE, limit), "own-paths")
    out, large = found.where("road_sequence > 0"), found.where(c("road_sequence") == TABLE).select("agent_id")
    left = found.where(c("road_sequence") == WIDER).select("agent_id")
    # nodes around which squares lie: all that own links touch, and both ends
    node = arcs.select(c("from_node_id").alias("n"), c("fx").alias("x"), c("fy").alias("y")).unionByName(arcs.select(c("to_node_id").alias("n"), c("tx").alias("x"), c("ty").alias("y"))).dropDuplicates(["n"])
    both = asked.select("agent_id", F.explode(F.array("o_node_id", "d_node_id")).alias("n")).join(node, "n").select("agent_id", "x", "y")
    touched = own.select("agent_id", F.explode(F.array(F.struct(c("fx").alias("x"), c("fy").alias("y")), F.struct(c("tx").alias("x"), c("ty").alias("y")))).alias("p")).select("agent_id", "p.x", "p.y")
    seeds, side = both.unionByName(touched), resolution
    while not left.isEmpty():
        at = lambda v, s=side: F.floor(v / F.lit(s)).cast("long")
        near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        spots = seeds.join(left, "agent_id", "left_semi").select("agent_id", at(c("x")).alias("x"), at(c("y")).alias("y")).distinct().withColumn("_i", near).withColumn("_j", near)
        squares = saved(spots.select("agent_id", (c("x") + c("_i")).alias("i"), (c("y") + c("_j")).alias("j")).distinct(), "squares")
        placed = arcs.withColumn("i", at(c("fx"))).withColumn("j", at(c("fy")))
        around = squares.join(placed, ["i", "j"]).join(asked.select("agent_id", "allowed", "blocked"), "agent_id").join(own.select("agent_id", "link_seq", "cost"), ["agent_id", "link_seq"], "left")
        around = _row(around.withColumn("price", F.when(fine, F.coalesce("cost", F.lit(INACTIVE))).otherwise(FORBIDDEN)), 2, **link, i=at(c("tx")), j=at(c("ty")), price=c("price"))
        rows = header.join(left, "agent_id", "left_semi").unionByName(_row(squares, 1, i=c("i"), j=c("j"))).unionByName(around)
        found = saved(searched(rows, math.inf, limit), "wider-paths")
        out, large = out.unionByName(found.where("road_sequence > 0")), large.unionByName(found.where(c("road_sequence") == TABLE).select("agent_id"))
        left, side = found.where(c("road_sequence") == WIDER).select("agent_id"), side * 4
    if large.isEmpty():
        return out
    return out.unionByName(relaxed_paths(ends.join(large, "agent_id", "left_semi"), costs, links, limit))


def priced_links(ends: DataFrame, costs: DataFrame, links: DataFrame) -> DataFrame:
    """Costs that differ from 999: ``agent_id, link_seq, cost`` after the type rules."""
    rows = costs.join(ends.select("agent_id", "allowed", "blocked"), "agent_id").join(links.select(F.col("seq").alias("link_seq"), "link_type_code"), "link_seq")
    fine = permitted(F.col("allowed"), F.col("blocked"), F.col("link_type_code"))
    return rows.select("agent_id", "link_seq", F.when(fine, F.col("cost")).otherwise(F.lit(FORBIDDEN)).alias("cost"))


#: Side of the pieces that a table search goes by, in cells, and links of a piece, about.
SIDE, PIECE = 3, 1 << 14
LABELS = "agent_id string, node_id int, label double, link_seq long, flat boolean, open boolean"


def settle(label: dict[int, float], by: dict[int, tuple[bool, int]], open_: set[int], inside: set[int], arcs: dict[int, list[tuple[int, int, float]]], most: float) -> set[int]:
    """Relaxes the links (seq, to node, price) of `inside` nodes from open ones with labels below `most`; gives the still open.

    `by`: whether the last link added nothing to the label, and the link. Of equal labels that of the first link stays
    whose from node has a lower label: so links followed back never go around.
    """
    heap = [(label[v], v) for v in open_ & inside if label[v] < most]
    heapq.heapify(heap)
    while heap:
        at, u = heapq.heappop(heap)
        if at > label[u] or u not in open_:
            continue
        open_.discard(u)
        for seq, v, w in arcs.get(u, ()):
            new, old = at + w, label.get(v)
            if old is None or new < old:
                label[v], by[v] = new, (new <= at, seq)
                open_.add(v)
                if v in inside and new < most:
                    heapq.heappush(heap, (new, v))
            elif new == old and at < new and v in by and (False, seq) < by[v]:
                by[v] = False, seq
    return open_


def settled(rows: DataFrame, key: list[str], limit: float = math.inf) -> DataFrame:
    """Labels of every agent and piece in `rows` (``agent_id, key, kind, a, b, c, price``), and of nodes next to it.

    Kind 0: labels from `price` on are not taken further (none is, without). Kind 1: node a has label `price` by link b,
    c is 1 if it is open and 2 more if the link added nothing. Kind 2: link a from node b to node c. Kind 3: link a has
    another price. A group of more than `limit` rows keeps its labels. With `key`, ``own`` tells nodes of the piece.
    """
    names = ["agent_id", *key, "kind", "a", "b", "c", "price"]
    out_names = [*(c.split()[0] for c in LABELS.split(", ")), "own"]
    types = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())

    def answer(agent: str, held: list[pa.RecordBatch], count: int) -> list[tuple]:
        table = pa.Table.from_batches(held)
        rows_ = list(zip(*(table.column(c).to_pylist() for c in names[-5:]), strict=True))
        label, by, open_, most = {}, {}, set(), -math.inf
        price = {a: p for k, a, _, _, p in rows_ if k == 3}
        arcs: dict[int, list[tuple[int, int, float]]] = {}
        for k, a, b, c, p in rows_:
            if k == 0:
                most = p
            elif k == 1:
                label[a] = p
                if b is not None:
                    by[a] = c >= 2, b
                if c % 2:
                    open_.add(a)
            elif k == 2:
                arcs.setdefault(b, []).append((a, c, price.get(a, p)))
        own = set(label) | set(arcs)
        if count <= limit:
            settle(label, by, open_, own if key else own | {v for x in arcs.values() for _, v, _ in x}, arcs, most)
        return [(agent, v, x, by[v][1] if v in by else None, v in by and by[v][0], v in open_, v in own) for v, x in label.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count, out = None, [], 0, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(types), types, strict=True)], out_names)
        for batch in batches:
            if not batch.num_rows:
                continue
            other = np.zeros(batch.num_rows - 1, bool)
            for c in range(len(key) + 1):
                other |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
            for a, z in zip(ends, ends[1:], strict=False):
                group = tuple(batch.column(c)[a].as_py() for c in range(len(key) + 1))
                if group != now:
                    if now is not None:
                        out += answer(now[0], held, count)
                    now, held, count = group, [], 0
                count += z - a
                if count <= limit or not held:  # the first rows are the labels
                    held.append(batch.slice(a, z - a))
            if len(out) > 10_000:
                yield made()
                out.clear()
        if now is not None:
            out += answer(now[0], held, count)
        yield made()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*names).repartition(tasks, "agent_id", *key).sortWithinPartitions("agent_id", *key, "kind", "a").mapInArrow(run, f"{LABELS}, own boolean")


def pieces(links: DataFrame, side: float, most: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``node_id, piece``, and links with the ``piece`` of their from node: squares, cut by hash where they hold over `most` links."""
    c = F.col
    at = lambda x, y: [F.floor(v / F.lit(side)).cast("long").alias(n) for v, n in ((c(x), "_i"), (c(y), "_j"))]
    node = links.select(c("from_node_id").alias("node_id"), *at("fx", "fy")).unionByName(links.select(c("to_node_id").alias("node_id"), *at("tx", "ty"))).dropDuplicates(["node_id"])
    dense = links.select(*at("fx", "fy")).groupBy("_i", "_j").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")
    cut = F.pmod(F.xxhash64("node_id"), F.coalesce("_parts", F.lit(1)))
    home = saved(node.join(dense, ["_i", "_j"], "left").select("node_id", F.concat_ws("/", "_i", "_j", cut).alias("piece")), "pieces")
    arcs = links.select(c("seq").alias("link_seq"), "from_node_id", "to_node_id", "link_type_code")
    return home, saved(arcs.join(home.withColumnRenamed("node_id", "from_node_id"), "from_node_id"), "piece-links")


def relaxed_labels(ends: DataFrame, costs: DataFrame, links: DataFrame, limit: int = REGION, side: float = SIDE * RESOLUTION) -> DataFrame:
    """Labels ``agent_id, node_id, label, link_seq`` by relaxation of tables, piece by piece.

    First an agent's own links are walked up to `INACTIVE`, in one step, if a task holds them (`limit` rows): a target that is
    met there is final. Then each round takes the pieces with open nodes, an agent and a piece at a time, and settles
    a piece in memory; only what leaves a piece waits for the next round. Of an agent's open nodes only those are taken
    whose label lies in its lowest stretch of `INACTIVE`, or a third of that ahead; and none that is not below the
    label of its target, so no round goes beyond what the path needs. It ends when no node is left.
    """
    c = F.col
    asked = saved(ends.where("o_node_id is not null and d_node_id is not null").select("agent_id", c("o_node_id").cast("int").alias("node_id"), c("d_node_id").cast("int").alias("goal"), "allowed", "blocked"), "relaxed-asked")
    priced = saved(priced_links(asked, costs, links), "priced")
    home, arcs = pieces(links, side)
    none = F.lit(None)

    def row(df: DataFrame, kind: int, price: Column, a: Column = none, b: Column = none, c: Column = none, key: tuple[str, ...] = ("piece",)) -> DataFrame:
        return df.select("agent_id", *key, F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), price.cast("double").alias("price"))

    own = priced.join(arcs.drop("piece"), "link_seq")
    first = row(asked, 0, F.lit(INACTIVE), key=()).unionByName(row(asked, 1, F.lit(0.0), c("node_id"), none, F.lit(1), ())).unionByName(row(own, 2, c("cost"), c("link_seq"), c("from_node_id"), c("to_node_id"), ()))
    labels = saved(settled(first, [], limit).drop("own"), "labels")
    # over own links all labels below `INACTIVE` are final; other links leave from all of these nodes
    met = labels.join(asked.select("agent_id", c("goal").alias("node_id")), ["agent_id", "node_id"], "left_semi").where(c("label") < INACTIVE).select("agent_id", F.lit(True).alias("_met"))
    labels = labels.join(met, "agent_id", "left").withColumn("open", c("_met").isNull()).drop("_met")
    housed = lambda df: df.join(home, "node_id", "left").withColumn("piece", F.coalesce("piece", F.lit("")))  # noqa: E731  # a node without links is in none
    labels = saved(housed(labels), "labels")
    priced = saved(priced.join(met.select("agent_id"), "agent_id", "left_anti").join(arcs.select("link_seq", "piece"), "link_seq"), "priced-pieces")
    settings = asked.select("agent_id", "goal", "allowed", "blocked")
    while True:
        known = labels.join(settings, "agent_id")
        bound = known.groupBy("agent_id").agg(F.min(F.when(c("node_id") == c("goal"), c("label"))).alias("most"), F.min(F.when(c("open"), c("label"))).alias("lowest"), F.first("allowed").alias("allowed"), F.first("blocked").alias("blocked"))
        stretch = F.floor(c("lowest") / INACTIVE)
        bound = bound.where(c("lowest").isNotNull() & (c("most").isNull() | (c("lowest") < c("most")))).select("agent_id", "allowed", "blocked", F.least(c("most"), (stretch + 1 + F.floor(stretch / 3)) * INACTIVE).alias("upto"))
        active = saved(labels.where("open").join(bound, "agent_id").where(c("label") < c("upto")).select("agent_id", "piece", "upto", "allowed", "blocked").distinct(), "active")
        if active.isEmpty():
            return labels.select("agent_id", "node_id", "label", "link_seq")
        which = active.select("agent_id", "piece")
        here = active.join(arcs, "piece")
        plain = F.when(permitted(c("allowed"), c("blocked"), c("link_type_code")), F.lit(INACTIVE)).otherwise(F.lit(FORBIDDEN))
        rows = row(active, 0, c("upto")).unionByName(row(labels.join(which, ["agent_id", "piece"], "left_semi"), 1, c("label"), c("node_id"), c("link_seq"), c("open").cast("int") + c("flat").cast("int") * 2))
        rows = rows.unionByName(row(here, 2, plain, c("link_seq"), c("from_node_id"), c("to_node_id")))
        rows = rows.unionByName(row(priced.join(which, ["agent_id", "piece"], "left_semi"), 3, c("cost"), c("link_seq")))
        found = saved(settled(rows, ["piece"]), "settled")
        rank = F.when(c("flat"), F.when(c("own"), 1).otherwise(2)).otherwise(0)
        old = labels.join(which, ["agent_id", "piece"], "left_anti").drop("piece").withColumn("own", F.lit(True))
        every = old.unionByName(found).withColumn("_b", F.struct("label", rank.alias("rank"), F.coalesce("link_seq", F.lit(-1)).alias("link_seq")))
        best = every.groupBy("agent_id", "node_id").agg(F.min("_b").alias("b"), F.min(F.when(c("own"), c("label"))).alias("was"), F.max(c("own") & c("open")).alias("open"))
        fell = c("was").isNull() | (c("b.label") < c("was"))
        now = best.select("agent_id", "node_id", "b.label", F.nullif("b.link_seq", F.lit(-1)).alias("link_seq"), (c("b.rank") > 0).alias("flat"), F.coalesce(fell | c("open"), F.lit(True)).alias("open"))
        labels = saved(housed(now), "labels", instead=labels)


def relaxed_paths(ends: DataFrame, costs: DataFrame, links: DataFrame, limit: int = REGION) -> DataFrame:
    """The same rows as `shortest_paths`, from relaxed labels; paths are followed back by pointer doubling.

    Table k leads from a node 2**k links back. Once the longest ways are covered, the tables are applied from the
    last to the first, each to all nodes found so far: so a path of n links takes 2 log2(n) tables, not n.
    """
    labels = relaxed_labels(ends, costs, links, limit)
    arcs = links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id")
    goal = ends.select("agent_id", F.col("d_node_id").cast("int").alias("node_id"), F.col("o_node_id").cast("int").alias("o")).where("node_id <> o").join(labels.select("agent_id", "node_id", F.col("label").alias("total_cost")), ["agent_id", "node_id"])
    last = saved(labels.where("link_seq is not null").join(arcs, "link_seq").join(goal.select("agent_id", "o"), "agent_id").where("node_id <> o").select("agent_id", "node_id", "link_seq", "from_node_id", "to_node_id"), "last-links")
    back = [last.select("agent_id", "node_id", F.col("from_node_id").alias("before"))]
    while True:
        half = back[-1]
        step = saved(half.join(half.select("agent_id", F.col("node_id").alias("before"), F.col("before").alias("further")), ["agent_id", "before"]).select("agent_id", "node_id", F.col("further").alias("before")), "doubled")
        if step.isEmpty():
            break
        back.append(step)
    way = goal.select("agent_id", "node_id", F.lit(0).cast("long").alias("back"))
    for k in range(len(back) - 1, -1, -1):
        more = way.join(back[k], ["agent_id", "node_id"]).select("agent_id", F.col("before").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        way = saved(way.unionByName(more), "way")
    steps = way.join(last, ["agent_id", "node_id"])
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("back")))
    before = labels.select("agent_id", F.col("node_id").alias("from_node_id"), F.col("label").alias("label_cost"))
    return steps.withColumn("road_sequence", place).join(before, ["agent_id", "from_node_id"]).join(goal.select("agent_id", "total_cost"), "agent_id").select("agent_id", "road_sequence", "link_seq", "from_node_id", "to_node_id", "label_cost", "total_cost")
