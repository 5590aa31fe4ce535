"""Time-dependent paths: a dynamic program over (node, time bin) per agent, on costs by time bin."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.functions import timefn
from lanternway.functions.constants import INACTIVE, TIME_BIN, UNREACHABLE
from lanternway.operators.storage import once, saved

#: Links times bins of agents that are searched together: 20 bytes each.
CELLS = 1 << 20

TD_SCHEMA = "agent_id string, road_sequence int, link_seq long, from_node_id int, to_node_id int, time_index int, time_index_t int, label_cost double"

TD_NAMES = [c.split()[0] for c in TD_SCHEMA.split(", ")]


def agent_states(ends: DataFrame, active: DataFrame, costs: DataFrame, dwells: DataFrame, spans: DataFrame, links: DataFrame, span: DataFrame) -> DataFrame:
    """All that the searches need, as rows of one kind each: an agent, then its links, their costs by bin, its dwells.

    ``agent_id, kind, link_seq, bin, a, b, c, cost``. Nothing is gathered into one cell: `td_paths` deals the
    rows by agent and reads them as a sorted stream. `costs` (``agent_id, link_seq, bin, cost``) are folded before.
    """
    bin_ = lambda c: timefn.time_bin(F.col(c), F.col("t0"), F.col("bins"))
    asked = ends.where("o_node_id is not null and d_node_id is not null").select("agent_id", "o_node_id", "d_node_id").join(spans, "agent_id").join(F.broadcast(span))
    asked = saved(asked.select("agent_id", "o_node_id", "d_node_id", bin_("start_min").alias("start"), bin_("last_min").alias("end"), "bins"), "td-asked")
    whole = asked.select("agent_id", "start", "end")
    none = F.lit(None)

    def rows(df: DataFrame, kind: int, **given: str) -> DataFrame:
        value = {c: F.col(given[c]) if c in given else none for c in ("link_seq", "bin", "a", "b", "c", "cost")}
        return df.select("agent_id", F.lit(kind).alias("kind"), *[v.cast("double" if c == "cost" else "long").alias(c) for c, v in value.items()])

    arcs = links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id", "fft_min")
    own = active.select("agent_id", "link_seq").distinct().join(whole, "agent_id", "left_semi").join(arcs, "link_seq")
    priced = costs.join(whole, "agent_id").where("bin between start and end")
    parts = rows(asked, 0, link_seq="o_node_id", bin="d_node_id", a="start", b="end", c="bins"), rows(own, 1, link_seq="link_seq", a="from_node_id", b="to_node_id", cost="fft_min"), rows(priced, 2, link_seq="link_seq", bin="bin", cost="cost"), rows(dwells.join(whole, "agent_id", "left_semi"), 3, bin="bin", a="dwell_bins")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def travel_bins(fft_min: float) -> tuple[int, int]:
    """(least, usual) travel time of a link in bins; up to 0.7 of the free-flow time is allowed."""
    return max(1, int(fft_min / TIME_BIN * 0.7 + 0.5)), max(1, int(fft_min / TIME_BIN + 0.5))


def search(links: list[tuple[int, int, int, float, np.ndarray]], origin: int, target: int, start: int, end: int, bins: int, dwell: dict[int, int], compat: bool = False, stages: int = 10) -> list[tuple[int, int, int, int, int, float]]:
    """The path as (link_seq, from, to, entry bin, arrival bin, label at the to node).

    `links`: (link_seq, from, to, free-flow minutes, costs by bin from `start` to `end`), in file order.
    From each bin on, a link may take from its least to `stages` times its usual bins (or the dwell of
    that bin); its cost depends on the entry bin only. The path ends at the cheapest of the last six
    bins. `compat`: predecessors are followed from `end`, and the last link is left out.
    """
    seq, tail, head = (np.array([x[i] for x in links], np.int64) for i in range(3))
    ids = np.unique(np.concatenate([tail, head, [origin, target]]))
    a, b = np.searchsorted(ids, tail), np.searchsorted(ids, head)
    times = [travel_bins(x[3]) for x in links]
    least, usual = (np.array([t[i] for t in times], np.int64) for i in range(2))
    cost = np.stack([x[4] for x in links], 1) if links else np.zeros((end - start + 1, 0))
    width = min(bins, end + 1)  # later bins cannot reach the end
    label = np.full((len(ids), width), UNREACHABLE)
    by, since = np.full((len(ids), width), -1), np.full((len(ids), width), -1)
    label[np.searchsorted(ids, origin), start] = 0.0
    # links by their place among those into the same node: those of one round have different heads
    order = np.argsort(b, kind="stable")
    place = np.empty(len(b), np.int64)
    place[order] = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    for t in range(start, min(end, width - 1) + 1):
        wait = dwell.get(t, 0)
        stop = t + np.maximum(np.maximum(1, wait), usual * stages)
        lo = np.minimum(t + least, bins - 1)
        ready = (stop > t + least) & (lo < width)
        last = t == bins - 1  # all moves stay in the last bin, so links see each other: one by one, in order
        if not last:
            ready &= label[a, t] < UNREACHABLE
        if not ready.any():
            continue
        hi = np.minimum(np.maximum(np.minimum(stop, bins), lo + 1), width)
        rounds = np.flatnonzero(ready)[:, None] if last else [np.flatnonzero(ready & (place == r)) for r in range(int(place[ready].max()) + 1)]
        for own in rounds:
            if not len(own) or last and label[a[own[0]], t] >= UNREACHABLE:
                continue
            k = np.repeat(own, hi[own] - lo[own])
            at = np.arange(len(k)) - np.repeat(np.cumsum(hi[own] - lo[own]) - (hi[own] - lo[own]) - lo[own], hi[own] - lo[own])
            new = (label[a[own], t] + cost[t - start, own]).repeat(hi[own] - lo[own])
            better = label[b[k], at] > new
            k, at = k[better], at[better]
            label[b[k], at], by[b[k], at], since[b[k], at] = new[better], k, t
    goal = int(np.searchsorted(ids, target))
    window = np.arange(max(0, end - 5), end + 1)
    best = int(window[label[goal, window].argmin()]) if label[goal, window].min() < label[goal, end] else end
    node, t, out = goal, (end if compat else best), []
    # more links than nodes and bins: moves in the last bin go around a loop of negative prices, which has no cheapest path
    while by[node, t] >= 0 and since[node, t] >= start and len(out) < len(ids) + end - start + 1:
        k, before = int(by[node, t]), int(since[node, t])
        out.append((links[k][0], links[k][1], links[k][2], before, t, float(label[node, t])))
        node, t = int(a[k]), before
    out.reverse()
    return out[:-1] if compat else out


@dataclass
class Trip:
    """One agent's search: ends, bins, links in file order, costs by link and bin, dwells by bin."""

    agent: str
    origin: int
    target: int
    start: int
    end: int
    bins: int
    seq: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    fft: np.ndarray
    priced: tuple[np.ndarray, np.ndarray, np.ndarray]
    dwell: dict[int, int]

    @property
    def cells(self) -> int:
        return len(self.seq) * (self.end - self.start + 1)

    def alone(self, compat: bool) -> list[tuple]:
        cost = np.full((len(self.seq), max(self.end - self.start + 1, 0)), INACTIVE)
        at, bin_, price = self.priced
        cost[np.searchsorted(self.seq, at), bin_ - self.start] = price
        links = list(zip(self.seq.tolist(), self.tail.tolist(), self.head.tolist(), self.fft.tolist(), cost, strict=True))
        return search(links, self.origin, self.target, self.start, self.end, self.bins, self.dwell, compat)


def search_together(trips: list[Trip], compat: bool = False, stages: int = 10) -> list[list[tuple]]:
    """The rows of `search` for many agents at once, each on its own links and its own bins from 0 on.

    A bin is one step for all. Labels of the bin are the best of what links have waiting for it, of equal ones
    the earliest entry, then the first link. Then each link that starts at a reached node offers its cost to the
    bins that it may end in, a stretch that is the same for all links of one travel time: columns of links stand
    by travel time, so an offer is one comparison of a block. Trips that meet the last bin of all, where moves
    end in the bin they begin in, are searched alone.
    """
    out: list[list[tuple]] = [[] for _ in trips]
    several = [i for i, t in enumerate(trips) if t.end + 1 < t.bins and len(t.seq) and t.end >= t.start]
    for i in set(range(len(trips))) - set(several):
        out[i] = trips[i].alone(compat)
    if not several:
        return out
    own = [trips[i] for i in several]
    first, tails, heads, origins, targets, nodes = [0], [], [], [], [], 0
    for t in own:
        ids = np.unique(np.concatenate([t.tail, t.head, [t.origin, t.target]]))
        a, b, o, d = (np.searchsorted(ids, x) + nodes for x in (t.tail, t.head, t.origin, t.target))
        tails.append(a), heads.append(b), origins.append(int(o)), targets.append(int(d))
        nodes += len(ids)
        first.append(first[-1] + len(t.seq))
    tail, head, fft = np.concatenate(tails), np.concatenate(heads), np.concatenate([t.fft for t in own])
    n, long_ = len(tail), max(t.end - t.start + 1 for t in own)
    minutes, which = np.unique(fft, return_inverse=True)
    kinds, same = np.unique([travel_bins(x) for x in minutes.tolist()], axis=0, return_inverse=True)
    kind = same.ravel()[which]
    column = np.argsort(kind, kind="stable")  # links by travel time
    place = np.empty(n, np.int64)
    place[column] = np.arange(n)
    edges = np.searchsorted(kind[column], np.arange(len(kinds) + 1))
    blocks = [(int(x), int(y), int(least), int(usual) * stages) for x, y, (least, usual) in zip(edges, edges[1:], kinds.tolist(), strict=False)]
    cost = np.full((long_, n), INACTIVE)
    stays: dict[int, list[tuple[int, int]]] = {}  # step -> (trip, dwell)
    for i, t in enumerate(own):
        at, bin_, price = t.priced
        cost[bin_ - t.start, place[first[i] + np.searchsorted(t.seq, at)]] = price
        for b, wait in t.dwell.items():
            if t.start <= b <= t.end:
                stays.setdefault(b - t.start, []).append((i, wait))
    offer, entry = np.full((long_, n), UNREACHABLE), np.full((long_, n), -1, np.int32)
    label, by, since = np.full((long_, nodes), UNREACHABLE), np.full((long_, nodes), -1, np.int32), np.full((long_, nodes), -1, np.int32)
    label[0, origins] = 0.0
    begin, into = tail[column], np.lexsort((np.arange(n), head))  # into: links by head, then file order
    met, lead = np.unique(head[into], return_index=True)
    back = np.repeat(np.arange(len(met)), np.diff(np.append(lead, n)))
    into_column = place[into]
    for s in range(long_):
        if s:
            best = offer[s, into_column]
            low = np.minimum.reduceat(best, lead)
            if (low < UNREACHABLE).any():
                equal = best == low[back]
                since_ = np.where(equal, entry[s, into_column], n + long_)
                early = np.minimum.reduceat(since_, lead)
                link = np.minimum.reduceat(np.where(equal & (since_ == early[back]), np.arange(n), n), lead)
                there = low < UNREACHABLE
                label[s, met[there]], since[s, met[there]], by[s, met[there]] = low[there], early[there], into[link[there]]
        if not (label[s] < UNREACHABLE).any():
            continue
        price = label[s, begin] + cost[s]
        for x, y, least, most in blocks:
            block = offer[s + least : s + most, x:y]
            if len(block):
                better = price[x:y] < block
                np.copyto(block, price[x:y], where=better)
                np.copyto(entry[s + least : s + most, x:y], s, where=better)
        for i, wait in stays.get(s, ()):  # a dwell lets links of this agent end later
            for k in range(first[i], first[i + 1]):
                c, usual = place[k], kinds[kind[k], 1]
                later = slice(s + int(usual) * stages, s + wait)
                better = price[c] < offer[later, c]
                offer[later, c][better], entry[later, c][better] = price[c], s
    for at, (i, t) in enumerate(zip(several, own, strict=True)):
        last = t.end - t.start
        window = np.arange(max(0, t.end - 5), t.end + 1) - t.start
        window = window[window >= 0]
        reached = label[window, targets[at]]
        best = int(window[reached.argmin()]) if reached.min() < label[last, targets[at]] else last
        node, s, rows = targets[at], (last if compat else best), []
        while by[s, node] >= 0:
            k, before = int(by[s, node]), int(since[s, node])
            j = k - first[at]
            rows.append((int(t.seq[j]), int(t.tail[j]), int(t.head[j]), before + t.start, s + t.start, float(label[s, node])))
            node, s = int(tail[k]), before
        rows.reverse()
        out[i] = rows[:-1] if compat else rows
    return out


def trips_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Trip]:
    """Agents from the rows of `agent_states`, sorted by agent, kind, link and bin."""
    held: list[pa.RecordBatch] = []

    def made() -> Trip | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        value = {c: pc.fill_null(rows.column(c), 0).to_numpy() for c in rows.column_names[1:]}
        kind = value["kind"]
        part = lambda k, *names: [value[c][kind == k] for c in names]
        head = part(0, "link_seq", "bin", "a", "b", "c")
        if not len(head[0]):
            return None
        seq, tail, to, fft = part(1, "link_seq", "a", "b", "cost")
        at, bin_, cost = part(2, "link_seq", "bin", "cost")
        waits = dict(zip(*(x.tolist() for x in part(3, "bin", "a")), strict=True))
        return Trip(rows.column(0)[0].as_py(), *(int(x[0]) for x in head), seq, tail, to, fft, (at, bin_, cost), waits)

    for batch in batches:
        if not batch.num_rows:
            continue
        agent = batch.column(0)
        ends = [0, *(np.flatnonzero(pc.not_equal(agent[1:], agent[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, z in zip(ends, ends[1:], strict=False):
            if held and held[0].column(0)[0] != agent[a]:
                if (trip := made()) is not None:
                    yield trip
                held = []
            held.append(batch.slice(a, z - a))
    if held and (trip := made()) is not None:
        yield trip


def path_rows(trips: list[Trip], compat: bool = False) -> pa.RecordBatch:
    out = [(t.agent, n + 1, *row) for t, own in zip(trips, search_together(trips, compat), strict=True) for n, row in enumerate(own)]
    cols = list(zip(*out, strict=True)) if out else [()] * 8
    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], TD_NAMES)


def td_paths(states: DataFrame, compat: bool = False) -> DataFrame:
    """Path rows of every agent, each on its own links only.

    Agents are dealt by id and come as a sorted stream; those that come after each other are searched together,
    up to `CELLS` links times bins. One agent's links times its bins are what a task must hold.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trip] = []
        for trip in trips_of(batches):
            if held and sum(t.cells for t in held) + trip.cells > CELLS:
                yield path_rows(held, compat)
                held = []
            held.append(trip)
        yield path_rows(held, compat)

    return states.repartition("agent_id").sortWithinPartitions("agent_id", "kind", "link_seq", "bin").mapInArrow(run, TD_SCHEMA)


def use_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("link_seq").agg(F.count("*").alias("use_count"))


def idle_links(hits: DataFrame, uses: DataFrame) -> DataFrame:
    """``agent_id, link_seq, balance`` of links that points hit but no path uses: less one for each hit.

    `hits`: ``agent_id, link_seq, hit_count``. `uses` with an ``agent_id`` counts each agent's own paths only.
    """
    keys = [c for c in ("agent_id", "link_seq") if c in uses.columns]
    return hits.where("hit_count >= 1").join(uses, keys, "left_anti").select("agent_id", "link_seq", (-F.col("hit_count")).alias("balance"))


def lowered(costs: DataFrame, idle: DataFrame, step: float = 100.0) -> DataFrame:
    """Costs by bin, changed by `step` times the link's balance in the bins that were hit."""
    rows = costs.join(idle, ["agent_id", "link_seq"], "left")
    return rows.select("agent_id", "link_seq", "bin", F.when(F.col("hit") & F.col("balance").isNotNull(), F.col("cost") + F.lit(step) * F.col("balance")).otherwise(F.col("cost")).alias("cost"), "hit")


def updated_prices(costs: DataFrame, hits: DataFrame, uses: DataFrame, step: float = 100.0) -> DataFrame:
    """Costs by bin of links that points hit but no path uses: lowered by `step` for each hit, in hit bins.

    `costs`: ``agent_id, link_seq, bin, cost, hit``; `hits`: ``agent_id, link_seq, hit_count``.
    """
    return lowered(costs, idle_links(hits, uses), step).drop("hit")


@dataclass
class PriceRounds:
    """``paths``: those of `td_paths` with their ``round``, every agent in every round. ``prices``: costs by bin, as the
    last search took them. ``balance``: ``agent_id, round, balance_count``, the links that a round made cheaper.
    """

    paths: DataFrame
    prices: DataFrame
    balance: DataFrame


def price_rounds(search: Callable[[DataFrame, DataFrame | None], DataFrame], costs: DataFrame, hits: DataFrame, folder: str, rounds: int = 2, step: float = 100.0) -> PriceRounds:
    """Search, then lower the prices of each agent's idle links and search again, `rounds` searches in all.

    A link that any earlier path of the agent used is never idle again. Agents without idle links keep their paths and are
    not searched again; the rounds end when no agent has any. `search` gives the paths for prices of the agents
    it is told (all, if None). Every round's tables stay in `folder`: started again with the same folder and
    input, the rounds go on after the last whole table, so a lost driver costs one table at most.
    """
    spark = costs.sparkSession
    table = lambda name, n, make: once(spark, f"{folder}/{name}-{n}", make)
    prices = table("prices", 0, lambda: costs.select("agent_id", "link_seq", "bin", "cost", "hit"))
    paths = [table("paths", 0, lambda: search(prices, None))]
    balance = table("balance", 0, lambda: hits.where("false").select("agent_id", F.lit(1).alias("balance_count")))
    made = [balance.select("agent_id", F.lit(0).alias("round"), "balance_count")]
    for n in range(1, rounds):
        used = reduce(DataFrame.unionByName, [p.select("agent_id", "link_seq") for p in paths]).distinct()
        idle = table("idle", n, lambda used=used: idle_links(hits, used))
        live = idle.groupBy("agent_id").agg(F.count("*").cast("int").alias("balance_count"))
        if live.isEmpty():
            break
        prices = table("prices", n, lambda idle=idle, prices=prices: lowered(prices, idle, step))
        again = lambda live=live, prices=prices: search(prices, live.select("agent_id")).unionByName(paths[-1].join(live, "agent_id", "left_anti"))
        paths.append(table("paths", n, again))
        made.append(live.select("agent_id", F.lit(n).alias("round"), "balance_count"))
    every = [p.withColumn("round", F.lit(n)) for n, p in enumerate(paths)]
    return PriceRounds(reduce(DataFrame.unionByName, every), prices, reduce(DataFrame.unionByName, made))


def repriced(costs: DataFrame, idle: DataFrame, step: float = 100.0) -> DataFrame:
    """Costs by bin, lowered like those of `lowered` as many times as `idle` (``agent_id, link_seq, balance, times``) says."""
    rows = costs.join(idle, ["agent_id", "link_seq"], "left")
    less = F.aggregate(F.array_repeat("balance", F.col("times").cast("int")), F.col("cost"), lambda c, b: c + F.lit(step) * b)
    return rows.withColumn("cost", F.when(F.col("hit") & F.col("balance").isNotNull(), less).otherwise(F.col("cost"))).select(costs.columns)


def idle_rounds(search: Callable[[DataFrame | None, DataFrame | None], DataFrame], prices: Callable[[DataFrame | None], DataFrame], hits: DataFrame, folder: str, rounds: int = 2) -> PriceRounds:
    """`price_rounds` without tables of prices: what is kept is which links of an agent were idle, and how often.

    Links once used are never idle again, so a round's table holds those that were idle before, with the number of
    rounds in which they were. `search` gives the paths of the agents it is told at prices so lowered (as they were, if None),
    and `prices` those prices, made when they are read.
    """
    spark = hits.sparkSession
    table = lambda name, n, make: once(spark, f"{folder}/{name}-{n}", make)
    paths = [table("paths", 0, lambda: search(None, None))]
    idle, made = None, [hits.where("false").select("agent_id", F.lit(0).alias("round"), F.lit(1).alias("balance_count"))]
    for n in range(1, rounds):
        used = reduce(DataFrame.unionByName, [p.select("agent_id", "link_seq") for p in paths]).distinct()
        if idle is None:
            make = lambda used=used: idle_links(hits, used).withColumn("times", F.lit(1))
        else:
            make = lambda used=used, idle=idle: idle.join(used.withColumn("_used", F.lit(1)), ["agent_id", "link_seq"], "left").select("agent_id", "link_seq", "balance", (F.col("times") + F.when((F.col("times") == n - 1) & F.col("_used").isNull(), 1).otherwise(0)).alias("times"))  # noqa: E731,B023
        now = table("idle", n, make)
        live = now.where(F.col("times") == n).groupBy("agent_id").agg(F.count("*").cast("int").alias("balance_count"))
        if live.isEmpty():
            break
        idle = now
        again = lambda live=live, idle=idle: search(idle, live.select("agent_id")).unionByName(paths[-1].join(live, "agent_id", "left_anti"))
        paths.append(table("paths", n, again))
        made.append(live.select("agent_id", F.lit(n).alias("round"), "balance_count"))
    every = [p.withColumn("round", F.lit(n)) for n, p in enumerate(paths)]
    return PriceRounds(reduce(DataFrame.unionByName, every), prices(idle), reduce(DataFrame.unionByName, made))
