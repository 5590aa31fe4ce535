"""Agents as a sorted stream, each with its points and the links of its cells: scores are made where they are used.

A point meets every link of its cell, so a table of all pairs is many times the input, and so are costs by bin. Here a
task reads what an agent's pairs come from, makes them in memory, and gives only what was asked for: static costs, costs by
bin, or the time-dependent path. What is shuffled is the points once, and a link once for each agent and cell.
Agents whose pairs are too many to hold (`PAIRS`) go by the tables of `likelihood` and `tdpaths` instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.functions import timefn
from lanternway.functions.constants import INACTIVE, NONHIT_RATIO, PI, RESOLUTION, TIME_BIN
from lanternway.operators import tdpaths
from lanternway.operators.grid import cell_links
from lanternway.operators.likelihood import fold_together, meeting

#: Pairs of an agent that a task holds (about 150 bytes each), and of agents that are scored together.
PAIRS, TOGETHER = 1 << 20, 1 << 18
#: Shape points of pairs that one step computes, and bins of folds that one step holds.
STEP, CELLS = 1 << 18, 1 << 21

#: Kinds of rows. Those of an agent come before those of its cells, links of a cell before its points.
AGENT, DWELL, IDLE, LINK, POINT = range(5)
_LONGS, _DOUBLES = ("k", "i", "j", "m", "n"), ("x", "y", "z", "w", "d", "e")

COSTS = "agent_id string, link_seq long, cost double, trace_no int, hit_count long"
BINS = "agent_id string, link_seq long, bin long, cost double, trace_no int, hit boolean, from_node_id int, to_node_id int"


def _row(df: DataFrame, kind: int, **given: str | Column) -> DataFrame:
    value = {c: F.col(given[c]) if isinstance(given.get(c), str) else given.get(c, F.lit(None)) for c in ("cell_id", *_LONGS, *_DOUBLES, "shape")}
    value["cell_id"] = F.coalesce(value["cell_id"], F.lit(-1))
    types = {"cell_id": "long", **dict.fromkeys(_LONGS, "long"), **dict.fromkeys(_DOUBLES, "double"), "shape": "array<double>"}
    return df.select("agent_id", value["cell_id"].cast("long").alias("cell_id"), F.lit(kind).alias("kind"), *[value[c].cast(types[c]).alias(c) for c in (*_LONGS, *_DOUBLES, "shape")])


def agent_cells(kept: DataFrame, i: Column, j: Column) -> DataFrame:
    """``agent_id, cell_id, points, i, j``: the cells of each agent; i and j are the least column and row of its points there."""
    return kept.groupBy("agent_id", "cell_id").agg(F.count("*").alias("points"), F.min(i).alias("i"), F.min(j).alias("j"))


def heavy_agents(visits: DataFrame, links: DataFrame, most: int = PAIRS) -> DataFrame:
    """``agent_id`` of agents with more than `most` pairs of points and links."""
    per = cell_links(links).groupBy("cell_id").agg(F.count("*").alias("_links"))
    pairs = visits.join(per, "cell_id").groupBy("agent_id").agg(F.sum(F.col("points") * F.col("_links")).alias("_pairs"))
    return pairs.where(F.col("_pairs") > most).select("agent_id")


def pair_rows(kept: DataFrame, visits: DataFrame, cells: DataFrame, links: DataFrame) -> DataFrame:
    """The rows that pairs are made from: each agent's links by cell, with the cell's column and row, and its points.

    `cells`: ``cell_id, x_index, y_index``.
    """
    asked = visits.select("agent_id", "cell_id", F.lit(0).alias("g")).join(cells, "cell_id")
    flat = F.flatten(F.transform("shape", lambda p: F.array(p["x"], p["y"])))
    lists = cell_links(links).select("cell_id", F.col("seq").alias("link_seq"), "fx", "fy", "tx", "ty", "link_distance", "fft_min", "from_node_id", "to_node_id", flat.alias("shape"))
    met = meeting(asked, lists, asked)
    own = _row(met, LINK, cell_id="cell_id", k="link_seq", i="x_index", j="y_index", m="from_node_id", n="to_node_id", x="fx", y="fy", z="tx", w="ty", d="link_distance", e="fft_min", shape="shape")
    return own.unionByName(_row(kept, POINT, cell_id="cell_id", k="g", m="sec", n="trace_no", x="x", y="y"))


def agent_rows(agents: DataFrame, span: DataFrame) -> DataFrame:
    """`agents`: ``agent_id, sampling_min``, and for a search ``o_node_id, d_node_id, start_min, last_min``. `span`: t0, bins."""
    full = agents.join(F.broadcast(span.select("t0", "bins")))
    given: dict[str, str | Column] = {}
    if "o_node_id" in agents.columns:
        bin_ = lambda c: timefn.time_bin(F.col(c), F.col("t0"), F.col("bins"))
        given = {"k": "o_node_id", "i": "d_node_id", "j": bin_("start_min"), "m": bin_("last_min")}
    return _row(full, AGENT, n="bins", x="sampling_min", y="t0", **given)


def dwell_rows(dwells: DataFrame) -> DataFrame:
    return _row(dwells, DWELL, k="bin", m="dwell_bins")


def idle_rows(idle: DataFrame) -> DataFrame:
    """`idle`: ``agent_id, link_seq, balance, times``: costs of hit bins change by the balance, so many times."""
    return _row(idle, IDLE, k="link_seq", m="balance", n="times")


# ---------------------------------------------------------------- arithmetic of `geo`, operation for operation
def _planar(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    return np.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _angle(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    flat = lambda d: np.where(np.abs(d) < 0.00001, 0.0, d)
    return np.mod(np.trunc(np.arctan2(flat(y2 - y1), flat(x2 - x1)) * 180 / PI + 0.5), 360)


def _foot(px: np.ndarray, py: np.ndarray, fx: np.ndarray, fy: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = fx - tx, fy - ty
    square = dx * dx + dy * dy
    u = ((px - tx) * dx + (py - ty) * dy) / np.where(square == 0, np.nan, square)
    return u, _planar(px, py, tx + u * dx, ty + u * dy)


class Rows:
    """Rows of some agents, whole and sorted, as arrays; absent numbers are nan, or `NONE` where whole."""

    NONE = -(1 << 62)

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: table.column(c).chunk(0)
        self.agent, self.kind = column("agent_id"), column("kind").to_numpy()
        self.cell = column("cell_id").to_numpy()
        for c in _LONGS:
            setattr(self, c, pc.fill_null(column(c), self.NONE).to_numpy())
        for c in _DOUBLES:
            setattr(self, c, pc.fill_null(column(c), float("nan")).to_numpy())
        shape = column("shape")
        self.shape = pc.fill_null(shape.flatten(), float("nan")).to_numpy()
        self.corners = pc.fill_null(pc.list_value_length(shape), 0).to_numpy() // 2
        self.corner = np.cumsum(self.corners) - self.corners
        new = np.append(True, pc.not_equal(self.agent[1:], self.agent[:-1]).to_numpy(zero_copy_only=False))
        self.who = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size-1 for each size."""
    return np.arange(int(size.sum())) - np.repeat(_starts(size), size)


class Pairs:
    """All pairs of points and links of a cell. Pairs of one link row are a block, in the order of the points."""

    def __init__(self, rows: Rows) -> None:
        r = self.rows = rows
        at = np.flatnonzero(r.kind >= LINK)
        new = np.append(True, (r.who[at][1:] != r.who[at][:-1]) | (r.cell[at][1:] != r.cell[at][:-1]))[: len(at)]
        run = np.cumsum(new) - 1
        runs = int(run[-1]) + 1 if len(at) else 0
        is_link = r.kind[at] == LINK
        n_links, n_points = np.bincount(run[is_link], minlength=runs), np.bincount(run[~is_link], minlength=runs)
        first = at[np.flatnonzero(new)]
        #: of each block: its link row, its size, its first point row; and where it begins
        keep = n_points[run[is_link]] > 0
        self.link = at[is_link][keep]
        own = run[is_link][keep]
        self.size, point = n_points[own], first[own] + n_links[own]
        self.begin = _starts(self.size)
        self.block = np.repeat(np.arange(len(self.link)), self.size)
        self.point = np.repeat(point, self.size) + _within(self.size)
        # next point in the cell, heading, middle
        n = len(r.kind)
        follows = np.zeros(n, bool)
        follows[:-1] = (r.kind[:-1] == POINT) & (r.kind[1:] == POINT) & (r.who[:-1] == r.who[1:]) & (r.cell[:-1] == r.cell[1:])
        after = lambda v: np.where(follows, np.append(v[1:], np.nan), np.nan)
        nx, ny = after(r.x), after(r.y)
        spot = {"x": r.x, "y": r.y, "nx": nx, "ny": ny, "mx": (r.x + nx) / 2, "my": (r.y + ny) / 2, "heading": _angle(r.x, r.y, nx, ny)}
        # shape points with the next one; one row of none for a link without shape
        corners = np.maximum(r.corners[self.link], 1)
        xs, ys = (np.append(r.shape[k::2], np.nan) for k in (0, 1))
        none = len(xs) - 1
        place = np.repeat(r.corner[self.link], corners) + _within(corners)
        bare, last = np.repeat(r.corners[self.link] == 0, corners), _within(corners) == np.repeat(corners, corners) - 1
        here, next_ = np.where(bare, none, place), np.where(bare | last, none, np.minimum(place + 1, none))
        sx, sy, ex, ey = xs[here], ys[here], xs[next_], ys[next_]
        segment = {"sx": sx, "sy": sy, "ex": ex, "ey": ey, "bearing": _angle(sx, sy, ex, ey), "reach": _planar(sx, sy, ex, ey)}
        base = _starts(corners)
        count = len(self.block)
        self.nonhit, self.beside, self.hit = np.full(count, np.nan), np.empty(count), np.zeros(count, bool)
        unfolded = np.cumsum(corners[self.block])
        a = 0
        while a < count:
            z = max(a + 1, int(np.searchsorted(unfolded, (unfolded[a - 1] if a else 0) + STEP, side="right")))
            self._score(slice(a, z), spot, segment, base, corners)
            a = z

    def _score(self, part: slice, spot: dict, segment: dict, base: np.ndarray, corners: np.ndarray) -> None:
        r, block, point = self.rows, self.block[part], self.point[part]
        link = self.link[block]
        x, y = spot["x"][point], spot["y"][point]
        fx, fy, tx, ty = (c[link] for c in (r.x, r.y, r.z, r.w))
        u, away = _foot(x, y, fx, fy, tx, ty)
        near = np.fmin(np.fmin(away, _planar(x, y, fx, fy)), _planar(x, y, tx, ty))
        self.beside[part] = np.where((u < 0) | (u > 1), RESOLUTION, away)
        n = corners[block]
        s, p = np.repeat(base[block], n) + _within(n), np.repeat(point, n)
        sx, sy, ex, ey, reach = (segment[c][s] for c in ("sx", "sy", "ex", "ey", "reach"))
        end = _planar(spot["nx"][p], spot["ny"][p], ex, ey)
        deviation = (np.repeat(near, n) * 10 + _planar(spot["x"][p], spot["y"][p], sx, sy) + np.where(np.isnan(end), 0.0, end)) / 10
        deviation = np.where(deviation <= np.repeat(r.d[link] * 2, n), deviation, np.nan)
        mx, my = spot["mx"][p], spot["my"][p]
        v, off = _foot(mx, my, sx, sy, ex, ey)
        bend = np.abs(180 - np.mod(180 - (segment["bearing"][s] - spot["heading"][p]), 360))
        hit = (v >= -0.3) & (v <= 1.3) & (bend <= 45) & (off < reach) & (off < _planar(mx, my, sx, sy)) & (off < _planar(mx, my, ex, ey))
        self.nonhit[part] = np.fmin.reduceat(deviation, _starts(n))
        self.hit[part] = np.logical_or.reduceat(hit, _starts(n))

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Blocks by agent, link and scan order of the cells, and which of them begin a link of an agent."""
        r, at = self.rows, self.link
        order = np.lexsort((r.j[at], r.i[at], r.k[at], r.who[at]))
        who, k = r.who[at][order], r.k[at][order]
        return order, np.append(True, (who[1:] != who[:-1]) | (k[1:] != k[:-1]))[: len(order)]


def _whole(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=values == Rows.NONE)


def _first(value: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the least value, and the place of the first that has it."""
    least = np.minimum.reduceat(value, begin)
    return least, np.minimum.reduceat(np.where(value == np.repeat(least, size), np.arange(len(value)), len(value)), begin)


def costs_of(pairs: Pairs, resolution: float, combine: str) -> pa.RecordBatch:
    """What `likelihood.static_costs` gives, of these agents."""
    r = pairs.rows
    names = [c.split()[0] for c in COSTS.split(", ")]
    if not len(pairs.link):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64())], names)
    least, best = _first(np.where(np.isnan(pairs.nonhit), np.inf, pairs.nonhit), pairs.begin, pairs.size)
    nearest = _first(np.where(np.isnan(pairs.beside), np.inf, pairs.beside), pairs.begin, pairs.size)[1]
    cost = np.minimum(least, resolution)
    matched = np.where(least < resolution, r.n[pairs.point[best]], Rows.NONE)
    hits = np.add.reduceat(pairs.hit.astype(np.int64), pairs.begin)
    order, new = pairs.order()
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    cost = np.minimum.reduceat(cost[order], first) if combine == "min" else cost[order][last]
    place = np.maximum.reduceat(np.where(matched[order] != Rows.NONE, np.arange(len(order)), -1), first)
    trace_no = np.where(place >= 0, matched[order][place], r.n[pairs.point[nearest]][order][first])
    at = pairs.link[order][first]
    return pa.RecordBatch.from_arrays([r.agent.take(pa.array(at)), pa.array(r.k[at]), pa.array(cost), _whole(trace_no, pa.int32()), pa.array(np.add.reduceat(hits[order], first))], names)


class Bins:
    """Costs by bin of these agents, as `likelihood.bin_costs` folds them: link row, bin, cost, point row and hit of each."""

    def __init__(self, pairs: Pairs, step: float) -> None:
        r = pairs.rows
        order, new = pairs.order()
        group = np.cumsum(new) - 1
        event = np.repeat(pairs.begin[order], pairs.size[order]) + _within(pairs.size[order])
        group = np.repeat(group, pairs.size[order])
        known = ~np.isnan(pairs.nonhit[event])
        event, group = event[known], group[known]
        at = pairs.link[order][new]  # a link row for each group
        head = np.full(len(r.first), -1)
        heads = np.flatnonzero(r.kind == AGENT)
        head[r.who[heads]] = heads
        own = head[r.who[pairs.point[event]]]
        point, hit = pairs.point[event], pairs.hit[event]
        bins, t0 = r.n[own], r.y[own]
        bin_ = np.clip(np.trunc((r.m[point] / 60 - t0) / TIME_BIN + 0.5), 0, bins - 1).astype(np.int64)
        reach = np.maximum(1, np.trunc(r.x[own] / TIME_BIN)).astype(np.int64)
        beside = pairs.beside[event]
        cost = np.where(hit, np.where(np.isnan(beside), RESOLUTION, beside), pairs.nonhit[event] * NONHIT_RATIO)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        out: list[tuple[np.ndarray, ...]] = []
        if len(first):
            low, high = np.maximum(0, bin_ - reach), np.maximum(np.minimum(bin_ + reach, bins), bin_ + 1)
            held = np.cumsum(np.maximum.reduceat(high, first) - np.minimum.reduceat(low, first))
            a = 0
            while a < len(first):  # as many folds at once as their bins can be held
                z = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + CELLS, side="right")))
                s, t = int(first[a]), int(first[z]) if z < len(first) else len(group)
                g, b, e = fold_together(bin_[s:t], reach[s:t], cost[s:t], bins[s:t], first[a:z] - s)
                out.append((at[group[first[a:z]]][g], b, cost[s + e], point[s + e], hit[s + e]))
                a = z
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool))
        self.link, self.bin, self.cost, self.point, self.hit = (np.concatenate(c) for c in zip(*out, strict=True)) if out else none
        self.rows, self.active = r, at
        self._lower(step)

    def _lower(self, step: float) -> None:
        r = self.rows
        idle = np.flatnonzero(r.kind == IDLE)
        if not len(idle) or not len(self.link):
            return
        change = {(int(r.who[t]), int(r.k[t])): (int(r.m[t]), int(r.n[t])) for t in idle}
        links, where = np.unique(self.link, return_inverse=True)
        balance, times = (np.array(c, np.int64)[where.ravel()] for c in zip(*(change.get((int(r.who[t]), int(r.k[t])), (0, 0)) for t in links), strict=True))
        for n in range(int(times.max())):
            self.cost = np.where(self.hit & (times > n), self.cost + step * balance, self.cost)

    def batch(self) -> pa.RecordBatch:
        r, names = self.rows, [c.split()[0] for c in BINS.split(", ")]
        at = self.link
        columns = [r.agent.take(pa.array(at)), pa.array(r.k[at]), pa.array(self.bin.astype(np.int64)), pa.array(self.cost), _whole(r.n[self.point], pa.int32()), pa.array(self.hit), pa.array(r.m[at], pa.int32()), pa.array(r.n[at], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names)

    def trips(self) -> Iterator[tdpaths.Trip]:
        """The search of each agent that has both ends."""
        r = self.rows
        edge = np.append(r.first, len(r.kind))
        active = np.sort(self.active)
        priced = np.argsort(self.link, kind="stable")
        rows_ = self.link[priced]
        for a, z in zip(edge, edge[1:], strict=False):
            if r.kind[a] != AGENT or r.k[a] == Rows.NONE or r.i[a] == Rows.NONE:
                continue
            own = active[np.searchsorted(active, a) : np.searchsorted(active, z)]
            own = own[np.argsort(r.k[own], kind="stable")]
            cost = priced[np.searchsorted(rows_, a) : np.searchsorted(rows_, z)]
            start, end = int(r.j[a]), int(r.m[a])
            cost = cost[(self.bin[cost] >= start) & (self.bin[cost] <= end)]
            waits = a + np.flatnonzero(r.kind[a:z] == DWELL)
            dwell = dict(zip(r.k[waits].tolist(), r.m[waits].tolist(), strict=True))
            yield tdpaths.Trip(r.agent[int(a)].as_py(), int(r.k[a]), int(r.i[a]), start, end, int(r.n[a]), r.k[own], r.m[own], r.n[own], r.e[own], (r.k[self.link[cost]], self.bin[cost], self.cost[cost]), dwell)


def groups_of(batches: Iterable[pa.RecordBatch], together: int) -> Iterator[Rows]:
    """Whole agents, as many as have about `together` pairs."""
    done: list[pa.RecordBatch] = []  # whole agents
    held: list[pa.RecordBatch] = []  # the agent that may go on
    agent, pairs, own = None, 0, 0
    cell, links = None, 0

    for batch in batches:
        if not batch.num_rows:
            continue
        who, kind, place = batch.column(0), batch.column(2).to_numpy(), batch.column(1).to_numpy()
        ends = [0, *(np.flatnonzero(pc.not_equal(who[1:], who[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, z in zip(ends, ends[1:], strict=False):
            now = who[a].as_py()
            if now != agent:
                done, held, pairs, own, cell, links = done + held, [], pairs + own, 0, None, 0
                if pairs > together:
                    yield Rows(done)
                    done, pairs = [], 0
                agent = now
            held.append(batch.slice(a, z - a))
            # pairs of this stretch: points of a cell times its links before
            new = np.append(a, a + 1 + np.flatnonzero(place[a + 1 : z] != place[a : z - 1]))
            n_links, n_rows = np.add.reduceat((kind[a:z] == LINK).astype(np.int64), new - a), np.diff(np.append(new, z))
            n_points = np.add.reduceat((kind[a:z] == POINT).astype(np.int64), new - a)
            if place[a] == cell:
                n_links[0] += links
            own += int((n_links * n_points + n_rows).sum())
            cell, links = place[z - 1], int(n_links[-1])
    if done or held:
        yield Rows(done + held)


def _streamed(rows: DataFrame) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as that: pairs cost more than these rows show
    return rows.repartition(tasks, "agent_id").sortWithinPartitions("agent_id", "cell_id", "kind", "k")


def static_costs(rows: DataFrame, resolution: float = RESOLUTION, combine: str = "last") -> DataFrame:
    """``agent_id, link_seq, cost, trace_no, hit_count`` from `pair_rows`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for group in groups_of(batches, TOGETHER):
                yield costs_of(Pairs(group), resolution, combine)

    return _streamed(rows).mapInArrow(run, COSTS)


def bin_costs(rows: DataFrame, step: float = 100.0) -> DataFrame:
    """``agent_id, link_seq, bin, cost, trace_no, hit, from_node_id, to_node_id`` from `pair_rows`, `agent_rows` and `idle_rows`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for group in groups_of(batches, TOGETHER):
                yield Bins(Pairs(group), step).batch()

    return _streamed(rows).mapInArrow(run, BINS)


def td_paths(rows: DataFrame, compat: bool = False, step: float = 100.0) -> DataFrame:
    """Rows of `tdpaths.td_paths`, from `pair_rows`, `agent_rows`, `dwell_rows` and `idle_rows`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tdpaths.Trip] = []
        with np.errstate(all="ignore"):
            for group in groups_of(batches, TOGETHER):
                for trip in Bins(Pairs(group), step).trips():
                    if held and sum(t.cells for t in held) + trip.cells > tdpaths.CELLS:
                        yield tdpaths.path_rows(held, compat)
                        held = []
                    held.append(trip)
        yield tdpaths.path_rows(held, compat)

    return _streamed(rows).mapInArrow(run, tdpaths.TD_SCHEMA)
