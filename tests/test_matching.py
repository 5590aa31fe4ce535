"""The matching plan on the derived fixtures and on small hand-written networks."""

import heapq
import random

import numpy as np
import pytest
from lanternway.functions.constants import FORBIDDEN, INACTIVE, RESOLUTION, TIME_BIN, UNREACHABLE
from lanternway.operators import likelihood, outputs, paths, tdpaths, trace
from lanternway.operators.storage import saved
from lanternway.plans import fixtures
from lanternway.plans.map_match import Matching, map_match
from lanternway.sources import gpx, network, tables, traces
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return Matching(*fixtures.text_tables(spark, SF))


def test_paths_equal_a_plain_search(run):
    links = {r["seq"]: r for r in run.links.collect()}
    ends = {r["agent_id"]: r for r in run.ends.collect()}
    cost = {}
    for r in run.costs.collect():
        cost.setdefault(r["agent_id"], {})[r["link_seq"]] = r["cost"]
    got = {}
    for r in run.paths.orderBy("agent_id", "road_sequence").collect():
        got.setdefault(r["agent_id"], []).append(r)
    for agent, e in ends.items():
        def price(k, e=e, agent=agent):
            code = links[k]["link_type_code"]
            if code and ((e["allowed"] and code not in e["allowed"]) or (e["blocked"] and code in e["blocked"])):
                return FORBIDDEN
            return cost[agent].get(k, INACTIVE)

        label, heap = {e["o_node_id"]: 0.0}, [(0.0, e["o_node_id"])]
        while heap:
            at, u = heapq.heappop(heap)
            for k, x in links.items():
                if x["from_node_id"] == u and at + price(k) < label.get(x["to_node_id"], 1e18) and at <= label[u]:
                    label[x["to_node_id"]] = at + price(k)
                    heapq.heappush(heap, (label[x["to_node_id"]], x["to_node_id"]))
        rows = got[agent]
        assert rows[0]["from_node_id"] == e["o_node_id"] and rows[-1]["to_node_id"] == e["d_node_id"]
        assert all(a["to_node_id"] == b["from_node_id"] for a, b in zip(rows, rows[1:], strict=False))
        assert rows[0]["total_cost"] == pytest.approx(label[e["d_node_id"]])
        assert sum(price(r["link_seq"]) for r in rows) == pytest.approx(label[e["d_node_id"]])


def test_relaxation_equals_grouped_search(run):
    few = run.ends.where("agent_id in ('u1', 'u2', 'u3')")
    a = {(r["agent_id"], round(r["total_cost"], 9)) for r in paths.shortest_paths(few, run.costs, run.links).collect()}
    b = paths.shortest_paths(few, run.costs, run.links, limit=0).collect()
    assert a == {(r["agent_id"], round(r["total_cost"], 9)) for r in b}
    assert {r["agent_id"] for r in b if r["road_sequence"] == 1 and r["label_cost"] == 0.0} == {r[0] for r in a}


def brute_paths(ends, costs, links):
    """(agent, place, link, label, total) by a search of the whole network; ties to the first link."""
    out = []
    for agent, o, d, allowed, blocked in ends:
        price = {}
        for k, (a, b, code) in links.items():
            barred = (allowed and code not in allowed) or (blocked and code in blocked)
            price[k] = FORBIDDEN if barred else costs.get((agent, k), INACTIVE)
        label, by, heap, done = {o: 0.0}, {}, [(0.0, o)], set()
        while heap:
            at, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for k, (a, b, _) in links.items():
                if a == u and b not in done and (at + price[k], k) < (label.get(b, 1e18), by.get(b, -1)):
                    label[b], by[b] = at + price[k], k
                    heapq.heappush(heap, (label[b], b))
        way, v = [], d
        while v != o and v in by:
            way.append(by[v])
            v = links[by[v]][0]
        if v == o:
            out += [(agent, n + 1, k, label[links[k][0]], label[d]) for n, k in enumerate(way[::-1])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_growing_squares_find_what_the_whole_network_gives(spark, seed):
    """Ends far apart, own links in islands, barred types, dead ends, no way at all."""
    rng = random.Random(seed)
    spot = {n: ((n % 15) * 0.004, (n // 15) * 0.004) for n in range(225)}
    links = {}
    for n in spot:
        for m in (n + 1, n - 1, n + 15, n - 15):
            if m in spot and abs(m % 15 - n % 15) <= 1 and rng.random() < 0.8 and n != 0:
                links[len(links)] = (n, m, rng.choice("aab"))
    links[len(links)] = (3, 221, "a")  # a long one
    ends = [(f"u{i}", rng.randrange(225), rng.randrange(225), *rng.choice([(None, None), ("a", None), (None, "b"), ("ab", "")])) for i in range(14)] + [("none", 0, 5, None, None), ("same", 4, 4, None, None)]
    costs = {(a, k): rng.choice([0.0, 0.001, rng.random() / 100]) for a, *_ in ends for k in rng.sample(sorted(links), 60)}
    frame = spark.createDataFrame([(k, a, b, c, *spot[a], *spot[b]) for k, (a, b, c) in links.items()], "seq long, from_node_id int, to_node_id int, link_type_code string, fx double, fy double, tx double, ty double")
    asked = spark.createDataFrame(ends, "agent_id string, o_node_id int, d_node_id int, allowed string, blocked string")
    priced = spark.createDataFrame([(a, k, c) for (a, k), c in costs.items()], "agent_id string, link_seq long, cost double")
    found = paths.shortest_paths(asked, priced, frame)
    want = brute_paths(ends, costs, links)
    got = sorted((r["agent_id"], r["road_sequence"], r["link_seq"], r["label_cost"], r["total_cost"]) for r in found.collect())
    assert got == want and max(r[4] for r in want) > 3 * INACTIVE


def test_paths_are_followed_back_in_few_tables(spark, monkeypatch):
    """A chain of 100 links: 2 log2(100) + 10 tables at most after the labels."""
    n = 100
    frame = spark.createDataFrame([(k, k, k + 1, "a", 0.0, 0.0, 0.0, 0.0) for k in range(n)], "seq long, from_node_id int, to_node_id int, link_type_code string, fx double, fy double, tx double, ty double")
    ends = spark.createDataFrame([("u", 0, n, None, None)], "agent_id string, o_node_id int, d_node_id int, allowed string, blocked string")
    labels = spark.createDataFrame([("u", k, 999.0 * k, k - 1 if k else None) for k in range(n + 1)], "agent_id string, node_id int, label double, link_seq long")
    made = []
    monkeypatch.setattr(paths, "saved", lambda df, label, *a: made.append(label) or saved(df, label, *a))
    monkeypatch.setattr(paths, "relaxed_labels", lambda *a: labels)
    got = [tuple(r)[1:4] for r in paths.relaxed_paths(ends, None, frame).orderBy("road_sequence").collect()]
    assert got == [(k + 1, k, k) for k in range(n)] and len(made) <= 2 * np.log2(n) + 10


def test_traces_meet_most_of_the_lattice(spark):
    """Rows of the lattice that points come near: most, at every size."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        nodes, _, points = fixtures.tables(spark, f"/root/testdata/{sf}")
        row = lambda c: F.floor((F.col(c) - 33.4) / 0.004 + 0.5)
        met = points.where("trace_id % 97 <> 0").select(row("y_coord")).distinct().count()
        assert met > nodes.select(row("y_coord")).distinct().count() / 2


def test_unreachable_and_same_node(spark, run):
    ends = spark.createDataFrame([("a", 0, 999, None, None), ("b", 5, 5, None, None), ("c", None, 3, None, None)], "agent_id string, o_node_id int, d_node_id int, allowed string, blocked string")
    assert paths.shortest_paths(ends, run.costs, run.links).collect() == []


def naive_td(links, origin, target, start, end, bins, dwell):
    """The full (node, bin) table, one travel time after the other."""
    label = {(origin, start): 0.0}
    by = {}
    for t in range(start, end + 1):
        for k, (_, a, b, fft, cost) in enumerate(links):
            here = label.get((a, t), UNREACHABLE)
            if here >= UNREACHABLE:
                continue
            least, usual = tdpaths.travel_bins(fft)
            for tt in range(least, max(1, dwell.get(t, 0), usual * 10)):
                to = (b, min(bins - 1, t + tt))
                if here + cost[t - start] < label.get(to, UNREACHABLE):
                    label[to] = here + cost[t - start]
                    by[to] = (k, t)
    best = min(range(max(0, end - 5), end + 1), key=lambda t: (label.get((target, t), UNREACHABLE), t != end, t))
    at, out = (target, best), []
    while at in by:
        k, t = by[at]
        out.append((links[k][0], links[k][1], links[k][2], t, at[1], label[at]))
        at = (links[k][1], t)
    return out[::-1]


@pytest.mark.parametrize("seed", range(8))
def test_time_dependent_search_equals_the_full_table(seed):
    rng = random.Random(seed)
    start, end = 2, 40
    bins = rng.choice([45, 60, 400])
    links = [(k, rng.randrange(6), rng.randrange(6), rng.choice([0.1, 0.2, 0.4]), np.array([rng.random() for _ in range(end - start + 1)])) for k in range(18)]
    dwell = {5: 30}
    assert tdpaths.search(links, 0, 5, start, end, bins, dwell) == naive_td(links, 0, 5, start, end, bins, dwell)


@pytest.mark.parametrize("seed", range(6))
def test_agents_searched_together_as_each_alone(seed):
    rng = random.Random(seed)
    trips = []
    for i in range(40):
        start, n = rng.randrange(30), rng.choice([0, 1, 7, 25])
        end = start + rng.randrange(60)
        bins = rng.choice([end + 1, end + 2, 500])
        seq = np.sort(np.array(rng.sample(range(90), n), np.int64))
        spots = [(k, t) for k in seq.tolist() for t in range(start, end + 1) if rng.random() < 0.5]
        priced = tuple(np.array(c, kind) for c, kind in zip(zip(*spots, strict=True) if spots else ((), ()), (np.int64, np.int64), strict=True))
        price = np.array([rng.choice([0.0, 0.25, 0.5, rng.random()]) for _ in spots])
        nodes = lambda: np.array([rng.randrange(7) for _ in range(n)], np.int64)  # noqa: B023, E731
        trips.append(tdpaths.Trip(f"u{i}", rng.randrange(7), rng.randrange(8), start, end, bins, seq, nodes(), nodes(), np.array([rng.choice([0.1, 0.15, 0.4, 1.0]) for _ in range(n)]), (*priced, price), {rng.randrange(60): rng.randrange(90) for _ in range(3)}))
    for compat in (False, True):
        assert tdpaths.search_together(trips, compat) == [t.alone(compat) for t in trips]


def test_bin_fold_compares_the_centre_only():
    held = likelihood.fold_bins([5, 6, 5], [2, 2, 2], [0.5, 0.9, 0.4], 10)
    assert held == {t: (0.4, 2) for t in range(3, 7)}
    assert {t: c for t, (c, _) in likelihood.fold_bins([5, 8], [1, 4], [0.5, 0.9], 10).items()} == dict.fromkeys(range(4, 10), 0.9)  # a later event may raise a neighbouring bin
    part = likelihood.fold_bins([5], [2], [0.5], 10)
    assert likelihood.fold_bins([6, 5], [2, 2], [0.9, 0.4], 10, 1, part) == held  # events may come in pieces


@pytest.mark.parametrize("seed", range(6))
def test_folds_together_as_each_alone(seed):
    rng = random.Random(seed)
    groups = [[(rng.randrange(12), rng.randrange(1, 4), rng.choice([0.0, 0.5, rng.random(), 1000.0])) for _ in range(rng.choice([1, 2, 9, 60]))] for _ in range(rng.choice([1, 5, 40]))]
    flat = [e for g in groups for e in g]
    first = np.cumsum([0, *map(len, groups)])[:-1]
    group, bin_, event = likelihood.fold_together(*(np.array([e[k] for e in flat], kind) for k, kind in enumerate((np.int64, np.int64, float))), np.full(len(flat), 11), first)
    got = {}
    for g, b, e in zip(group.tolist(), bin_.tolist(), event.tolist(), strict=True):
        got.setdefault(g, {})[b] = (flat[e][2], e - int(first[g]))
    assert got == {i: want for i, g in enumerate(groups) if (want := likelihood.fold_bins(*zip(*g, strict=True), 11))}


@pytest.mark.parametrize("batch", [3, 50, 10_000])
def test_bin_costs_equal_a_fold_of_each_group(run, batch):
    got = {}
    run.events.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = likelihood.bin_costs(run.events).collect()
    run.events.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in rows:
        got.setdefault((r["agent_id"], r["link_seq"]), {})[r["bin"]] = (r["cost"], r["trace_no"], r["hit"])
    groups = {}
    for r in run.events.collect():
        groups.setdefault((r["agent_id"], r["link_seq"]), []).append(r)
    assert got.keys() == groups.keys()
    for key, events in groups.items():
        want = {}
        for e in sorted(events, key=lambda e: tuple(e["at"])):
            if e["cost"] < want.get(e["bin"], (INACTIVE,))[0]:
                want |= {t: (e["cost"], e["trace_no"], e["hit"]) for t in range(max(0, e["bin"] - e["reach"]), min(e["bin"] + e["reach"], e["bins"]))}
        assert got[key] == want


def test_time_dependent_routes(run):
    rows = {}
    for r in run.td_route.orderBy("agent_id", "road_sequence").collect():
        rows.setdefault(r["agent_id"], []).append(r)
    assert rows
    for own in rows.values():
        assert all(a["to_node_id"] == b["from_node_id"] and a["time_index_t"] == b["time_index"] for a, b in zip(own, own[1:], strict=False))
        assert all(r["delay_in_sec"] == r["travel_time_in_sec"] - r["FFTT_in_sec"] for r in own)
        assert own[-1]["cumu_distance"] == pytest.approx(sum(r["length"] for r in own))
    short = {r["agent_id"]: r["n"] for r in Matching(run.raw_nodes, run.raw_links, run.raw_trace, compat=True).td_paths.groupBy("agent_id").count().withColumnRenamed("count", "n").collect()}
    assert all(n >= 0 for n in short.values())


def trips(run):
    """Each agent's search as plain values."""
    links = {r["seq"]: r for r in run.links.collect()}
    costs, active, waits = {}, {}, {}
    for r in run.bin_costs.collect():
        costs.setdefault(r["agent_id"], {})[r["link_seq"], r["bin"]] = (r["cost"], r["hit"])
    for r in run.costs.collect():
        active.setdefault(r["agent_id"], {})[r["link_seq"]] = r["hit_count"]
    for r in trace.dwells(run.kept).collect():
        waits.setdefault(r["agent_id"], {})[r["bin"]] = r["dwell_bins"]
    t0, bins = run.span.select("t0", "bins").first()
    bin_ = lambda m: max(0, min(bins - 1, int((m - t0) / TIME_BIN + 0.5)))
    spans = {r["agent_id"]: (bin_(r["start_min"]), bin_(r["last_min"])) for r in trace.spans(run.kept).collect()}
    ends = {r["agent_id"]: (r["o_node_id"], r["d_node_id"]) for r in run.ends.collect() if r["o_node_id"] is not None and r["d_node_id"] is not None}
    return links, costs, active, waits, spans, ends, bins


def test_price_rounds_equal_a_plain_loop(run, tmp_path):
    """Search, lower the prices of hit links that no path of the agent used, search again; three times."""
    links, costs, active, waits, spans, ends, bins = trips(run)
    want, counts = set(), set()
    for agent, (o, d) in ends.items():
        start, end = spans[agent]
        price, used = {k: c for k, (c, _) in costs.get(agent, {}).items()}, set()
        for n in range(3):
            idle = {k: h for k, h in active[agent].items() if h >= 1 and k not in used} if n else {}
            for k, t in price:
                if costs[agent][k, t][1] and k in idle:
                    price[k, t] -= 100.0 * idle[k]
            if idle:
                counts.add((agent, n, len(idle)))
            arcs = [(k, links[k]["from_node_id"], links[k]["to_node_id"], links[k]["fft_min"], np.array([price.get((k, t), INACTIVE) for t in range(start, end + 1)])) for k in sorted(active[agent])]
            way = tdpaths.search(arcs, o, d, start, end, bins, waits.get(agent, {}))
            used |= {row[0] for row in way}
            want |= {(agent, n, i + 1, *row[:5], round(row[5], 6)) for i, row in enumerate(way)}
    done = run.price_rounds(3, f"file://{tmp_path}/rounds")
    got = done.paths.select("agent_id", "round", *tdpaths.TD_NAMES[1:]).collect()
    assert len(got) == len(want) and {(*r[:-1], round(r[-1], 6)) for r in got} == want
    assert {tuple(r) for r in done.balance.collect()} == counts and any(n == 2 for _, n, _ in counts)
    ways = {}
    for agent, n, *row in sorted(want):
        ways.setdefault((agent, n), []).append(row[1])
    assert any(ways.get((a, 0)) != ways.get((a, 1)) for a in ends)  # prices do turn paths


def test_price_rounds_go_on_after_the_last_whole_table(run, tmp_path):
    folder, asked = f"file://{tmp_path}/rounds", []

    def search(prices, agents, lost=False):
        asked.append(agents is None)
        if lost and agents is not None:
            raise ConnectionError
        return run.td_search(prices, agents)

    with pytest.raises(ConnectionError):
        tdpaths.price_rounds(lambda p, a: search(p, a, True), run.bin_costs, run.costs, folder)
    again = tdpaths.price_rounds(search, run.bin_costs, run.costs, folder)
    assert asked == [True, False, False]  # the first search is not run twice
    whole = run.price_rounds(2)
    rows = lambda p: sorted(tuple(r) for r in p.select(*sorted(p.columns)).collect())
    assert rows(again.paths) == rows(whole.paths) and rows(again.balance) == rows(whole.balance)
    none = tdpaths.price_rounds(search, run.bin_costs, run.costs.withColumn("hit_count", F.lit(0)), f"file://{tmp_path}/none", 5)
    assert none.balance.isEmpty() and {r[0] for r in none.paths.select("round").distinct().collect()} == {0}


def test_uses_and_prices_over_time_dependent_paths(run):
    """What a21_use_counts and g03_price_update give, from the plain rows."""
    uses = {}
    for r in run.td_paths.collect():
        uses[r["link_seq"]] = uses.get(r["link_seq"], 0) + 1
    counted = tdpaths.use_counts(run.td_paths)
    assert {r["link_seq"]: r["use_count"] for r in counted.collect()} == uses
    hits = {(r["agent_id"], r["link_seq"]): r["hit_count"] for r in run.costs.collect()}
    want = {}
    for r in run.bin_costs.collect():
        lower = r["hit"] and r["link_seq"] not in uses
        want[r["agent_id"], r["link_seq"], r["bin"]] = r["cost"] - (100.0 * hits[r["agent_id"], r["link_seq"]] if lower else 0.0)
    rows = tdpaths.updated_prices(run.bin_costs, run.costs, counted).collect()
    assert len(rows) == len(want) and {tuple(r)[:3]: r["cost"] for r in rows} == want


def test_trace_has_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    _, _, points = fixtures.text_tables(spark, SF)
    assert points.count() == points.select("seq").distinct().count() == events.count()


def test_a_hot_user_keeps_its_points_and_their_order(spark, tmp_path):
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2500).selectExpr("id as event_id", "if(id < 2400, 1L, 2L) as user_id", "timestamp_seconds(id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    _, _, points = fixtures.text_tables(spark, str(tmp_path))
    rows = [(r["agent_id"], int(r["trace_no"])) for r in points.orderBy("seq").collect()]
    assert rows == [("u1", i) for i in range(2400)] + [("u2", i) for i in range(100)]


def test_a_hot_agent_is_scanned_in_pieces(spark):
    """Two thirds of all points belong to one agent: its places and points before go over the edges of stretches."""
    rows = [("hot" if i % 3 else f"u{i % 7}", i * 5, i / 1e4, (i * 37 % 11) / 1e4, 60 * i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "agent_id string, seq long, x double, y double, sec int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = trace.sequenced(frame)
    got = found.collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for agent, seq, x, y, sec in rows:
        own = want.setdefault(agent, [])
        own.append((seq, len(own), own[-1][3] if own else None, (x, y, sec)))
    assert sorted((r["agent_id"], r["seq"], r["g"], r["before"] and tuple(r["before"]), r["start_sec"]) for r in got) == sorted((a, seq, g, b, own[0][3][2]) for a, own in want.items() for seq, g, b, _ in own)
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert len(windows) == 2 and sum("_stretch" in line.split("], [")[1] for line in windows) == 1  # the other one is over pieces
    length = {r["agent_id"]: r["total_length"] for r in trace.segments(found).collect()}
    plain = {a: sum(((p[3][0] - q[3][0]) ** 2 + (p[3][1] - q[3][1]) ** 2) ** 0.5 for p, q in zip(own, own[1:], strict=False)) for a, own in want.items()}
    assert length == pytest.approx(plain)


def test_a_dense_cell_is_cut_into_parts(spark):
    """A third of all points in one cell, of one agent, and many links there: the same pairs, no large group."""
    rng = random.Random(5)
    spot = lambda i: (0.005, 0.005) if i < 1000 else (rng.randrange(8) * 0.01 + 0.005, 0.005)
    points = [("hot" if i < 1000 else f"u{i % 40}", *spot(i)) for i in range(3000)]
    nth, rows = {}, []
    for agent, x, y in points:
        g = nth[agent] = nth.get(agent, -1) + 1
        rows.append((agent, f"{x:.3f}", g, x + rng.random() / 1000, y, g * 5, g))
    kept = spark.createDataFrame(rows, "agent_id string, cell_id string, g int, x double, y double, sec int, trace_no int")
    lists = spark.createDataFrame([(f"{(k % 4) * 0.01 + 0.005 if k > 90 else 0.005:.3f}", k) for k in range(120)], "cell_id string, link_seq long")
    want = {}
    for agent, cell, g, x, y, *_ in sorted(rows, key=lambda r: (r[0], r[1], -r[2])):
        want[agent, cell, g] = want.get((agent, cell), (None, None))
        want[agent, cell] = (x, y)
    want = {k: v for k, v in want.items() if len(k) == 3}
    for block in (7, 100, 1 << 16):
        steps = likelihood.in_cell_pairs(kept, block)
        assert {(r["agent_id"], r["cell_id"], r["g"]): (r["nx"], r["ny"]) for r in steps.collect()} == want
    key = ["agent_id", "cell_id", "g", "link_seq"]
    plain = sorted(tuple(r) for r in kept.join(lists, "cell_id").select(*key).collect())
    for sizes in ((64, 16), (64, 1000), (10_000, 16), (1 << 14, 1 << 10)):
        met = likelihood.meeting(steps, lists, kept, *sizes)
        assert sorted(tuple(r) for r in met.select(*key).collect()) == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        share = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        cut, whole = share(likelihood.meeting(steps, lists, kept, 32, 8)), share(kept.join(lists, "cell_id"))
    finally:
        for c in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{c}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(cut) < 3 * np.median(cut) and max(whole) > 0.6 * sum(whole)


def test_network_has_every_part_and_steps_find_a_link(spark, run):
    from lanternway.plans import queries

    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    links = run.links.select("from_node_id", "to_node_id").collect()
    want = {(a, b) for a in range(parts) for b in (a - 12, a + 12, *([a - 1] if a % 12 else []), *([a + 1] if a % 12 < 11 else [])) if 0 <= b < parts}
    assert run.nodes.count() == parts > 144 and {tuple(r) for r in links} == want and len(links) == len(want)
    steps = queries.point_links(run).select("agent_id", "trace_no", "link_seq").collect()
    assert len(steps) == len({r[:2] for r in steps}) == run.kept.count() - run.kept.select("agent_id").distinct().count()
    assert max(r["link_seq"] for r in steps) >= 576 and len({r["link_seq"] % 4 for r in steps}) == 4


def text(spark, columns, rows):
    frame = spark.createDataFrame([(i, *map(lambda v: None if v is None else str(v), r)) for i, r in enumerate(rows)], "seq long, " + ", ".join(f"{c} string" for c in columns.split()))
    return frame


def test_network_quirks(spark):
    nodes = network.nodes(text(spark, "node_id x_coord y_coord zone_id", [(1, 0, 0, 3), (1, 9, 9, 9), (2, 0.02, 0, 0), ("x", 1, 1, 1), (3, None, 0, None)]))
    assert sorted((r["node_id"], r["x"], r["zone_id"]) for r in nodes.collect()) == [(1, 0.0, 3), (2, 0.02, 0), (3, None, 0)]
    raw = text(spark, "link_id from_node_id to_node_id length geometry", [(10, 1, 2, None, "LINESTRING (0 0, 0.02 0)"), (11, 1, 2, 7, None), (12, 1, 99, 1, None)])
    links = network.links(raw, nodes)
    got = {r["link_id"]: r for r in links.collect()}
    assert got.keys() == {10, 11} and got[10]["length"] == 1.0 and got[10]["fft_sec"] == 6 and got[11]["link_distance"] == 0.0
    assert [r["link_id"] for r in network.orphan_links(raw, nodes).collect()] == [12]
    assert outputs.last_of_pair(links).first()["pair_seq"] == 1
    with pytest.raises(ValueError):
        network.nodes(text(spark, "node_id x_coord", [(1, 0)]))


def test_nearest_zones_reach_any_distance_without_a_cross_join(spark):
    from lanternway.operators import grid

    nodes = network.nodes(text(spark, "node_id x_coord y_coord zone_id", [(1, 0, 0, 7), (2, 0.5, 0.5, 0), (3, 60, 0, 0), (4, 60, 80, 0), (5, -0.5, 0, 9)]))
    found = grid.filled_zones(nodes, 1e-5)
    rows = [tuple(r) for r in found.orderBy("x_index", "y_index").collect()]
    assert [z for *_, z in rows] == [9, 7, 7, 7, 7]
    assert "NestedLoop" not in found.select("zone_id")._jdf.queryExecution().toString()
    assert len(rows) == 5 and grid.filled_zones(nodes.withColumn("zone_id", F.lit(0)), 1e-5).count() == 0


def test_link_without_shape_costs_one_cell(spark):
    nodes = network.nodes(text(spark, "node_id x_coord y_coord zone_id", [(1, 0.001, 0.001, 0), (2, 0.004, 0.001, 0)]))
    links = network.links(text(spark, "link_id from_node_id to_node_id geometry", [(1, 1, 2, None), (2, 1, 2, "LINESTRING (0.001 0.001, 0.004 0.001)")]), nodes)
    points = traces.points(text(spark, "agent_id x_coord y_coord hh mm ss", [("a", 0.002, 0.001, 7, 0, 0), ("a", 0.003, 0.001, 7, 0, 9)]))
    kept = trace.in_network(points, nodes)
    costs = {r["link_seq"]: r["cost"] for r in likelihood.static_costs(likelihood.scored(kept, links), likelihood.scan_order(kept, 0.0, 0.0)).collect()}
    assert costs[0] == RESOLUTION and costs[1] < RESOLUTION


def test_carry_forward_and_hour_fallback(spark):
    points = traces.points(text(spark, "agent_id x_coord y_coord dd hh mm ss", [("a", 1, 2, 0, 7, 1, 2), ("b", None, 3, 5, None, None, None), (None, 4, 4, 0, 0, 0, 0)]))
    assert sorted((r["agent_id"], r["x"], r["y"], r["sec"]) for r in points.collect()) == [("a", 1.0, 2.0, 25262), ("b", 1.0, 3.0, 18000)]


def test_traces_over_midnight(spark):
    cols = "seq long, agent_id string, x_coord string, y_coord string, dd string, hh string, mm string, ss string"
    raw = spark.createDataFrame([(0, "a", "1", "1", "3", "23", "59", "50"), (1, "a", "1", "1", "4", "0", "0", "10"), (2, "a", "1", "1", "4", "", "1", ""), (3, "a", "1", "1", "", "5", "", "")], cols)
    sec = lambda **o: [r["sec"] for r in traces.points(raw, **o).orderBy("seq").collect()]
    assert sec(use_dd=True) == [3 * 86400 + 86390, 4 * 86400 + 10, 4 * 86400 + 60, 5 * 3600]
    assert sec() == [86390, 10, 4 * 3600 + 60, 5 * 3600]  # the day stands in for a missing hour
    kept = traces.points(raw, use_dd=True).where("seq < 3").withColumn("cell_id", F.lit("c"))
    assert [r["interval_s"] for r in trace.deltas(trace.sequenced(kept)).orderBy("g").collect()] == [None, 20, 50]
    assert traces.points(raw.where("false"), use_dd=True).count() == 0
    assert sec() == [r["sec"] for r in traces.points(raw.withColumn("extra", F.lit(1))).orderBy("seq").collect()]


def test_last_agent_views(spark, run):
    first = {}
    for r in run.kept.select("agent_id", "seq").collect():
        first[r["agent_id"]] = min(r["seq"], first.get(r["agent_id"], r["seq"]))
    last = max(first, key=first.get)
    mine = {r["cell_id"]: r["n_GPS_points"] for r in run.grid.where(F.col("agent_id") == last).collect()}
    rows = run.last_grid.collect()
    assert len(rows) == run.nodes.select("cell_id").distinct().count()  # every cell once
    assert {r["cell_id"]: r["n_GPS_points"] for r in rows if r["n_GPS_points"]} == mine and all(r["agent_id"] == (last if r["n_GPS_points"] else None) for r in rows)
    want = sorted(tuple(r) for r in outputs.link_likelihood(run.costs.where(F.col("agent_id") == last), run.links).collect())
    assert want and sorted(tuple(r) for r in run.last_likelihood.collect()) == want
    assert trace.last_agent(run.kept.where("false")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6])
def test_sampling_and_boundary_points(spark, n):
    nodes = network.nodes(text(spark, "node_id x_coord y_coord zone_id", [(1, 0.001, 0.001, 0)]))
    kept = trace.in_network(traces.points(text(spark, "agent_id x_coord y_coord ss", [("a", 0.001 + i / 1e4, 0.001, 6 * i) for i in range(n)] + [("z", 5, 5, 0)])), nodes)
    got = trace.sampling(kept).collect()
    want = 0.5 if n == 1 else 0.1 if n >= 5 else 0.05
    assert [round(r["sampling_min"], 6) for r in got] == ([] if n == 0 else [want])


def test_files_and_api(spark, tmp_path):
    nodes, links, points = fixtures.text_tables(spark, SF)
    for name, frame in (("node", nodes), ("link", links), ("trace", points.where("agent_id in ('u1', 'u2')"))):
        frame.drop("seq").toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    done = map_match(spark, str(tmp_path), str(tmp_path / "out"))
    assert {r["agent_id"] for r in done.route.collect()} == {"u1", "u2"}
    for name in ("route", "agent", "trace_processed", "link_likelihood", "cell2zone", "grid"):
        assert spark.read.csv(f"{tmp_path}/out/{name}", header=True).count() > 0


def test_header_rules_and_blank_line(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('time, a,b ,time\n1,"x,y",2,3\n\n9,9,9,9\n')
    all_, cut = tables.read_table(spark, str(path)), tables.read_table(spark, str(path), stop_at_blank=True)
    assert all_.columns == ["seq", "time", "a", "b "] and [r["time"] for r in all_.orderBy("seq").collect()] == ["3", "9"]
    assert [(r["time"], r["a"]) for r in cut.collect()] == [("3", "x,y")]
    assert tables.lookup(all_, "9", "9", "b ").first()["value"] == "9"


def test_rows_of_several_files_follow_their_names(spark, tmp_path):
    want = []
    for k, n in enumerate((2, 300, 1, 40)):  # sizes that Spark would read in another order
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f"{k},{i}\n" for i in range(n)))
        want += [(str(k), str(i)) for i in range(n)]
    rows = tables.read_table(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["a"], r["b"]) for r in rows] == want and [r["seq"] for r in rows] == list(range(len(want)))


def test_gpx(spark, tmp_path):
    path = tmp_path / "t.gpx"
    pt = lambda lon, t: f'<trkpt lat="33.0" lon="{lon}">' + (f"<time>{t}</time>" if t else "") + "</trkpt>"
    path.write_text("<gpx><trk><url>u</url><trkseg>" + pt(1, "2020-01-01T00:00:00Z") + pt(1.01, "2020-01-01T00:01:00Z") + pt(1.02, None) + pt(1.03, "2020-01-01T00:02:00Z") + "</trkseg><trkseg>" + pt(2, "2020-01-01T01:00:00Z") + "</trkseg></trk><trk><url>v</url><trkseg>" + pt(3, "2020-01-01T02:00:00Z") + "</trkseg></trk><trk><url>u</url><trkseg>" + pt(4, "2020-01-01T03:00:00Z") + "</trkseg></trk></gpx>")
    tracks = gpx.read_tracks(spark, str(path))
    points = gpx.track_points(tracks).orderBy("trace_no").collect()
    assert [(r["agent_id"], r["lon"]) for r in points] == [(0, 1.0), (0, 1.01), (0, 1.02), (0, 1.03), (0, 2.0), (1, 3.0), (0, 4.0)]
    first = gpx.first_segments(tracks).orderBy("agent_id", "trace_point_no").collect()
    assert [(r["trace_point_no"], r["x_coord"], r["mm"]) for r in first] == [(0, 1.0, "00"), (1, 1.01, "01"), (0, 3.0, "00"), (0, 4.0, "00")]
    speed = [r["speed_mph"] for r in gpx.speeds(gpx.track_points(tracks)).orderBy("trace_no").collect()]
    assert speed[0] is None and speed[1] == pytest.approx(34.7, abs=0.3) and speed[2] is None and speed[5] > 0
    assert gpx.local_time(gpx.track_points(tracks)).where("trace_no = 0").first()["local_time"].hour == 16
    assert len(gpx.boxes(0, 0, 1, 0.3)) == 3
    for block in (1, 2, 1 << 16):  # a point before may stand in another block
        own = gpx.speeds(gpx.track_points(tracks), block=block).orderBy("trace_no").collect()
        assert [r["speed_mph"] for r in own] == speed
    plan = gpx.speeds(gpx.track_points(tracks))
    assert plan.columns[-2:] == ["miles", "speed_mph"]


def test_pages_are_read_until_an_empty_one(spark, tmp_path):
    from lanternway.sources import pages

    boxes = gpx.boxes(0.0, 0.0, 0.9, 0.6)
    rows = [(f"t{i % 3}", i, (i % 10) / 10, (i % 7) / 10, None if i in (31, 40) else str(i)) for i in range(120)]
    frame = spark.createDataFrame(rows, "track string, place long, lon double, lat double, time string").withColumn("box", pages.box_of(F.col("lon"), F.col("lat"), boxes))
    path = f"file://{tmp_path}/pages"
    pages.write_pages(frame, path, 10)
    (tmp_path / "pages" / "box=0" / "page=99").mkdir()  # behind a gap: never asked for
    got = pages.read_pages(spark, path, len(boxes))
    assert got.rdd.getNumPartitions() == len(boxes) == 4 and pages.read_pages(spark, f"{path}-none", 2).count() == 0
    assert sorted(r["place"] for r in got.collect()) == list(range(120)) and max(r["n"] for r in got.groupBy("box", "page").agg(F.count("*").alias("n")).collect()) == 10
    where = {i: min(1, int(x / 0.45)) * 2 + min(1, int(y / 0.3)) for _, i, x, y, _ in rows}
    cut = {(where[i], t): i for t, i, *_, time in reversed(rows) if time is None}
    want = [i for t, i, *_ in rows if i < cut.get((where[i], t), 999)]
    assert sorted(r["place"] for r in pages.timed_tracks(got).collect()) == want and len(want) < 120


def test_numbers_over_blocks(spark):
    from lanternway.sources.gpx import numbered

    rows = spark.createDataFrame([((v * 37) % 1000, i) for v in range(200) for i in range(3)], "at long, i int")
    got = [(r["n"], r["at"], r["i"]) for r in numbered(rows, "n", "at", "i", block=16).orderBy("n").collect()]
    assert got == [(k, a, i) for k, (a, i) in enumerate(sorted(((v * 37) % 1000, i) for v in range(200) for i in range(3)))]


def test_time_out_follows_its_interval():
    from lanternway.streaming.points import milliseconds

    assert [milliseconds(x) for x in ("1 hour", "90 seconds", "1 hour 30 minutes", "INTERVAL 2 days")] == [3_600_000, 90_000, 5_400_000, 172_800_000]
    with pytest.raises(ValueError):
        milliseconds("hour")


def test_stream_equals_batch(spark, tmp_path, run):
    from lanternway.streaming import points as stream
    from pyspark.sql import functions as F

    rows = run.kept.select("agent_id", "seq", "x", "y", F.timestamp_seconds(F.col("sec")).alias("event_time"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream.deltas(source).writeStream.format("memory").queryName("deltas").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["agent_id"], r["seq"]): (r["interval_s"], r["metres"]) for r in spark.table("deltas").collect()}
    want = {(r["agent_id"], r["seq"]): (r["interval_s"], r["metres"]) for r in trace.deltas(run.kept).collect()}
    assert got.keys() == want.keys()
    for k, (i, m) in want.items():
        assert got[k] == ((None, None) if i is None else (float(i), pytest.approx(m)))
    visits = stream.cell_visits(source).writeStream.format("memory").queryName("visits").outputMode("complete").trigger(availableNow=True).start()
    visits.awaitTermination(120)
    assert spark.table("visits").agg(F.sum("n_points")).first()[0] == rows.count()
