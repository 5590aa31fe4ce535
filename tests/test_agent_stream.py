"""Queries that score agents where they are used: the same rows as from tables of pairs, and no such table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanternway.operators import likelihood, storage, tdpaths, trace
from lanternway.plans import queries

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def plain(spark):
    """Static costs, costs by bin and paths by tables of all pairs."""
    m = queries.matching(spark, SF)
    cells = likelihood.scan_order(m.kept, m.box[0], m.box[2], m.r)
    bins = storage.saved(likelihood.bin_costs(likelihood.bin_events(m.scored, cells, m.span, trace.sampling(m.kept))), "plain-bins")
    costs = storage.saved(likelihood.static_costs(m.scored, cells, m.r), "plain-costs")
    return costs, bins, storage.saved(m.td_search(bins), "plain-paths")


@pytest.mark.parametrize("held", [1 << 20, 3000, 0])
def test_streamed_agents_equal_tables_of_pairs(spark, plain, held):
    """Agents with few pairs in a task, those with many by tables: all, most and none of them."""
    costs, bins, paths = plain
    m = queries.matching(spark, SF)
    m.held_pairs = held
    assert (m.heavy is None) == (held > 3000) and (held or m.heavy.count() == costs.select("agent_id").distinct().count())
    assert rows(m.costs_of()) == rows(costs) and rows(m.bin_costs) == rows(bins) and rows(m.td_paths) == rows(paths)
    uses = tdpaths.use_counts(paths)
    assert rows(m.updated_prices(uses)) == rows(tdpaths.updated_prices(bins, costs, uses))


def tables(spark):
    """Kinds of tables in the run's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(storage.run_folder(spark))
    return [f.getPath().getName().rsplit("-", 1)[0] for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


PAIRED = {"scored", "bin-costs"}
FEW = {
    "l02_static_costs": PAIRED | {"costs"}, "k06_link_likelihood": PAIRED | {"costs"}, "k06_last_agent": PAIRED | {"costs"}, "l03_bin_costs": PAIRED, "k08_bin_cost_log": PAIRED, "g02_td_paths": PAIRED, "k05_td_route": PAIRED,
    "a21_use_counts": PAIRED, "g03_price_update": PAIRED, "g03_static_price_update": PAIRED, "g03_lr_rounds": PAIRED, "k03_agent": PAIRED,
}


@pytest.mark.parametrize("query", FEW)
def test_no_table_of_pairs_is_written(spark, query):
    before = tables(spark)
    found = queries.QUERIES[query](spark, SF)
    after = tables(spark)
    for name in before:
        after.remove(name)
    assert not FEW[query] & set(after) and not found.isEmpty()


def test_last_agent_has_no_pairs_of_others(spark, plain, monkeypatch):
    m = queries.matching(spark, SF)
    asked = []
    made = m.pair_rows
    monkeypatch.setattr(m, "pair_rows", lambda agents=None: asked.append(agents) or made(agents))
    last = trace.last_agent(m.kept).first()["agent_id"]
    got = {(r["link_id"], r["likelihood_distance"], r["likely_trace_no"]) for r in m.last_likelihood.collect()}
    assert got == {(r["link_seq"], r["cost"], r["trace_no"]) for r in plain[0].where((F.col("agent_id") == last) & (F.col("cost") < 998)).collect()}
    assert [[r[0] for r in a.collect()] for a in asked] == [[last]]
