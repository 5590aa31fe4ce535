"""The table search by pieces: the same paths whatever the pieces, in few rounds."""

from __future__ import annotations

import random

import pytest

from lanternway.functions.constants import INACTIVE
from lanternway.operators import paths
from lanternway.operators.storage import saved

LINKS = "seq long, from_node_id int, to_node_id int, link_type_code string, fx double, fy double, tx double, ty double"


@pytest.mark.parametrize(("side", "piece", "limit"), [(0.02, 1 << 14, paths.REGION), (0.008, 5, 0), (1.0, 1 << 14, 0)])
def test_pieces_find_what_squares_find(spark, monkeypatch, side, piece, limit):
    rng = random.Random(7)
    spot = {n: ((n % 15) * 0.004, (n // 15) * 0.004) for n in range(225)}
    links = {}
    for n in spot:
        for m in (n + 1, n - 1, n + 15, n - 15):
            if m in spot and abs(m % 15 - n % 15) <= 1 and rng.random() < 0.8 and n != 0:
                links[len(links)] = (n, m, rng.choice("aab"))
    ends = [(f"u{i}", rng.randrange(225), rng.randrange(225), *rng.choice([(None, None), ("a", None), (None, "b")])) for i in range(12)] + [("none", 0, 5, None, None), ("lost", 999, 5, None, None)]
    priced = spark.createDataFrame([(a, k, rng.random() / 100 + 1e-4) for a, *_ in ends for k in rng.sample(sorted(links), 60)], "agent_id string, link_seq long, cost double")
    frame = spark.createDataFrame([(k, a, b, c, *spot[a], *spot[b]) for k, (a, b, c) in links.items()], LINKS)
    asked = spark.createDataFrame(ends, "agent_id string, o_node_id int, d_node_id int, allowed string, blocked string")
    whole = paths.pieces
    monkeypatch.setattr(paths, "pieces", lambda links, _: whole(links, side, piece))
    rows = lambda df: sorted((r["agent_id"], r["road_sequence"], r["link_seq"], r["label_cost"], r["total_cost"]) for r in df.collect())
    want = rows(paths.shortest_paths(asked.where("agent_id <> 'lost'"), priced, frame))
    assert rows(paths.relaxed_paths(asked, priced, frame, limit)) == want and max(r[4] for r in want) > 3 * INACTIVE


@pytest.mark.parametrize("price", [0.001, None])
def test_a_long_way_takes_few_rounds(spark, monkeypatch, price):
    """60 links in a row, of the agent itself or of no price: not a round for each link."""
    n = 60
    frame = spark.createDataFrame([(k, k, k + 1, "a", k * 0.004, 0.0, k * 0.004 + 0.004, 0.0) for k in range(n)], LINKS)
    ends = spark.createDataFrame([("u", 0, n, None, None)], "agent_id string, o_node_id int, d_node_id int, allowed string, blocked string")
    costs = spark.createDataFrame([("u", k, price or 0.0) for k in range(n) if price or k < 1], "agent_id string, link_seq long, cost double")
    made = []
    monkeypatch.setattr(paths, "saved", lambda df, label, *a, **k: made.append(label) or saved(df, label, *a, **k))
    got = paths.relaxed_labels(ends, costs, frame).collect()
    assert {(r["node_id"], r["link_seq"]) for r in got} == {(k, k - 1 if k else None) for k in range(n + 1)}
    assert made.count("labels") <= 20
