"""The whole matching plan: from text tables to routes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.functions import geo
from lanternway.functions.constants import RESOLUTION
from lanternway.operators import agent_stream, grid, likelihood, od, outputs, paths, tdpaths, trace
from lanternway.operators.storage import run_folder, saved
from lanternway.sources import network, tables, traces


@dataclass
class Matching:
    """Tables of a run, made on first use; those that several others read are written once.

    `resolution`: grid cells in degrees, or None for an adaptive one. `combine`: how a link of two cells
    takes its cost. `compat`: time-dependent paths lose their last link, as they used to. `use_dd`: times count the day
    column's days too, for traces over midnight; hours in the results then go on beyond 23. `held_pairs`: pairs of points
    and links of one agent that a task holds.
    """

    raw_nodes: DataFrame
    raw_links: DataFrame
    raw_trace: DataFrame
    resolution: float | None = RESOLUTION
    combine: str = "last"
    compat: bool = False
    use_dd: bool = False
    held_pairs: int = agent_stream.PAIRS

    @cached_property
    def r(self) -> float:
        if self.resolution:
            return self.resolution
        return grid.adaptive_resolution(network.nodes(self.raw_nodes)).first()["resolution"]

    @cached_property
    def nodes(self) -> DataFrame:
        return network.nodes(self.raw_nodes, self.r)

    @cached_property
    def links(self) -> DataFrame:
        return saved(network.links(self.raw_links, self.nodes), "links")

    @cached_property
    def points(self) -> DataFrame:
        return saved(traces.points(self.raw_trace, self.use_dd), "points")

    @cached_property
    def kept(self) -> DataFrame:
        return saved(trace.in_network(self.points, self.nodes, self.r), "kept")

    @cached_property
    def box(self) -> tuple[float, float, float, float]:
        return tuple(grid.bounding_box(self.nodes).first())  # four numbers

    @cached_property
    def given(self) -> DataFrame:
        return saved(trace.given(self.points, self.nodes), "given")

    @cached_property
    def ends(self) -> DataFrame:
        """Chosen ends plus the agents' type codes."""
        chosen = od.choose(self.kept, self.given, trace.segments(self.kept), self.links, self.r)
        return saved(chosen.join(self.given.select("agent_id", "allowed", "blocked"), "agent_id", "left"), "ends")

    @cached_property
    def cells(self) -> DataFrame:
        return saved(self.visits.groupBy("cell_id").agg(F.min("i").alias("x_index"), F.min("j").alias("y_index")), "cells")

    @cached_property
    def scored(self) -> DataFrame:
        return saved(likelihood.scored(self.kept, self.links), "scored")

    @cached_property
    def visits(self) -> DataFrame:
        """The cells of each agent."""
        i, j = geo.cell_index(F.col("x"), F.lit(self.box[0]), self.r), geo.cell_index(F.col("y"), F.lit(self.box[2]), self.r)
        return saved(agent_stream.agent_cells(self.kept, i, j), "visits")

    @cached_property
    def heavy(self) -> DataFrame | None:
        """Agents with too many pairs for one task, None without any: tables of pairs are made for these alone."""
        agents = saved(agent_stream.heavy_agents(self.visits, self.links, self.held_pairs), "heavy")
        return None if agents.isEmpty() else agents

    def light(self, rows: DataFrame) -> DataFrame:
        return rows if self.heavy is None else rows.join(self.heavy, "agent_id", "left_anti")

    @cached_property
    def heavy_scored(self) -> DataFrame:
        return saved(likelihood.scored(self.kept.join(self.heavy, "agent_id", "left_semi"), self.links), "heavy-scored")

    def pair_rows(self, agents: DataFrame | None = None) -> DataFrame:
        """What the pairs of all agents but heavy ones are made from, or of `agents` alone."""
        own = lambda df: self.light(df if agents is None else df.join(agents, "agent_id", "left_semi"))
        return agent_stream.pair_rows(own(self.kept), own(self.visits), self.cells, self.links)

    def costs_of(self, agents: DataFrame | None = None) -> DataFrame:
        """Static costs of `agents` (all, if None), not written."""
        rows = agent_stream.static_costs(self.pair_rows(agents), self.r, self.combine)
        if self.heavy is None:
            return rows
        scores = self.heavy_scored if agents is None else likelihood.scored(self.kept.join(self.heavy.join(agents, "agent_id", "left_semi"), "agent_id", "left_semi"), self.links)
        return rows.unionByName(likelihood.static_costs(scores, self.cells, self.r, self.combine))

    @cached_property
    def costs(self) -> DataFrame:
        return saved(self.costs_of(), "costs")

    @cached_property
    def paths(self) -> DataFrame:
        return saved(paths.shortest_paths(self.ends, self.costs, self.links), "paths")

    @cached_property
    def route(self) -> DataFrame:
        return outputs.route(self.paths, self.links, self.costs, self.ends)

    @cached_property
    def span(self) -> DataFrame:
        return trace.time_range(self.kept)

    @cached_property
    def events(self) -> DataFrame:
        return likelihood.bin_events(self.scored, self.cells, self.span, trace.sampling(self.kept))

    def heavy_bins(self, idle: DataFrame | None = None) -> DataFrame:
        """Costs by bin of heavy agents, with the nodes of each link."""
        events = likelihood.bin_events(self.heavy_scored, self.cells, self.span, trace.sampling(self.kept))
        rows = likelihood.bin_costs(events)
        if idle is not None:
            rows = tdpaths.repriced(rows, idle.join(self.heavy, "agent_id", "left_semi"))
        return rows.join(self.links.select(F.col("seq").alias("link_seq"), "from_node_id", "to_node_id"), "link_seq")

    def bin_rows(self, idle: DataFrame | None = None) -> DataFrame:
        """Costs by bin with the nodes of each link, not written. `idle`: what makes hit bins of some links cheaper."""
        rows = self.pair_rows().unionByName(agent_stream.agent_rows(self.light(trace.sampling(self.kept)), self.span))
        if idle is not None:
            rows = rows.unionByName(agent_stream.idle_rows(self.light(idle)))
        bins = agent_stream.bin_costs(rows)
        return bins if self.heavy is None else bins.unionByName(self.heavy_bins(idle))

    @cached_property
    def bin_costs(self) -> DataFrame:
        return saved(self.bin_rows().drop("from_node_id", "to_node_id"), "bin-costs")

    def td_search(self, costs: DataFrame, agents: DataFrame | None = None) -> DataFrame:
        """Time-dependent paths of `agents` (all, if None) at the given costs by bin."""
        ends = self.ends if agents is None else self.ends.join(agents, "agent_id", "left_semi")
        active = self.costs.select("agent_id", "link_seq")  # links of cells with points: those that have a cost
        states = tdpaths.agent_states(ends, active, costs, trace.dwells(self.kept), trace.spans(self.kept), self.links, self.span)
        return tdpaths.td_paths(states, self.compat)

    @cached_property
    def td_paths(self) -> DataFrame:
        return saved(self.search(), "td-paths")

    def search(self, idle: DataFrame | None = None, agents: DataFrame | None = None) -> DataFrame:
        """Time-dependent paths of `agents` (all, if None) on costs by bin that are made where they are searched."""
        own = lambda df: df if agents is None else df.join(agents, "agent_id", "left_semi")
        ends = self.ends.where("o_node_id is not null and d_node_id is not null").select("agent_id", "o_node_id", "d_node_id")
        who = own(trace.sampling(self.kept).join(trace.spans(self.kept), "agent_id").join(ends, "agent_id", "left"))
        rows = self.pair_rows(agents).unionByName(agent_stream.agent_rows(self.light(who), self.span)).unionByName(agent_stream.dwell_rows(self.light(own(trace.dwells(self.kept)))))
        if idle is not None:
            rows = rows.unionByName(agent_stream.idle_rows(self.light(own(idle))))
        found = agent_stream.td_paths(rows, self.compat)
        if self.heavy is None:
            return found
        return found.unionByName(self.td_search(self.heavy_bins(idle).drop("from_node_id", "to_node_id"), own(self.heavy)))

    def price_rounds(self, rounds: int = 2, folder: str | None = None) -> tdpaths.PriceRounds:
        """`rounds` searches, with lower prices of idle links between; `folder` lets a lost run go on."""
        folder = folder or f"{run_folder(self.kept.sparkSession)}/price-rounds-{uuid.uuid4().hex}"
        return tdpaths.idle_rounds(self.search, lambda idle: self.bin_rows(idle).select("agent_id", "link_seq", "bin", "cost", "hit"), self.costs, folder, rounds)

    def updated_prices(self, uses: DataFrame) -> DataFrame:
        """Costs by bin, those of links that points hit but no path uses lowered."""
        idle = tdpaths.idle_links(self.costs, uses).withColumn("times", F.lit(1))
        return self.bin_rows(saved(idle, "idle")).select("agent_id", "link_seq", "bin", "cost")

    @cached_property
    def td_route(self) -> DataFrame:
        return outputs.td_route(self.td_paths, self.links, trace.spans(self.kept), self.span)

    @cached_property
    def agents(self) -> DataFrame:
        return outputs.agent_table(self.ends, trace.spans(self.kept), self.route, self.nodes, grid.node_zones(self.nodes, self.r))

    def grid_of(self, kept: DataFrame) -> DataFrame:
        return outputs.grid_table(grid.indexed(self.nodes, self.r), grid.cell_zones(self.nodes), kept, trace.cell_dwells(kept), self.box[0], self.box[3], self.box[2], self.r)

    @cached_property
    def grid(self) -> DataFrame:
        return self.grid_of(self.kept)

    def of_last(self, rows: DataFrame) -> DataFrame:
        """The rows of the last agent."""
        return rows.join(F.broadcast(trace.last_agent(self.kept)), "agent_id", "left_semi")  # one row

    @cached_property
    def last_grid(self) -> DataFrame:
        """The grid as the last agent leaves it: a row for each cell, with that agent's points alone."""
        return self.grid_of(self.of_last(self.kept))

    @cached_property
    def last_likelihood(self) -> DataFrame:
        """Links likely for the last agent; no pairs of other agents are made."""
        last = saved(trace.last_agent(self.kept), "last-agent")
        return outputs.link_likelihood(self.costs_of(last), self.links)


def map_match(spark, folder: str, out: str | None = None, time_dependent: bool = False, last_agent: bool = False, **options) -> Matching:  # noqa: ANN001, ANN003
    """Match ``trace.csv`` to ``node.csv`` and ``link.csv`` of a folder; with `out`, write all tables as CSV.

    `last_agent`: the grid and likelihood tables hold the last agent alone, not every agent.
    """
    raw = [tables.read_table(spark, f"{folder}/{name}.csv") for name in ("node", "link", "trace")]
    run = Matching(*raw, **options)
    if out:
        outputs.write_csv(run.td_route if time_dependent else run.route.select(*outputs.ROUTE), f"{out}/route", "agent_id", "road_sequence")
        outputs.write_csv(run.agents, f"{out}/agent", "agent_id")
        outputs.write_csv(outputs.trace_processed(trace.deltas(run.kept)), f"{out}/trace_processed", "agent_id", "gps_trace_id")
        outputs.write_csv(run.last_likelihood if last_agent else outputs.link_likelihood(run.costs, run.links), f"{out}/link_likelihood", "agent_id", "link_id")
        if not time_dependent:
            outputs.write_csv(outputs.cell2zone(grid.cell_zones(run.nodes)), f"{out}/cell2zone", "cell_id")
            outputs.write_csv(run.last_grid if last_agent else run.grid, f"{out}/grid", "cell_id")
    return run
