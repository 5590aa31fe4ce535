"""DuckDB SQL over the driver's tables: the same relations as the library's, written independently."""

from __future__ import annotations

from lanternway.functions.constants import INACTIVE, PI, RESOLUTION, RESOLUTION_STEPS, TIME_BIN
from lanternway.plans.fixtures import LINKS, NODES, TRACE

R, B, P = f"cast({RESOLUTION!r} as double)", f"cast({TIME_BIN!r} as double)", f"cast({PI!r} as double)"


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def planar(a: str, b: str, c: str, e: str) -> str:
    return f"sqrt(({a}-{c})*({a}-{c})+({b}-{e})*({b}-{e}))"


def cell(x: str, y: str) -> str:
    return f"(cast(floor(abs({x})/{R}) as bigint)*1000000+cast(floor(abs({y})/{R}) as bigint))"


def angle(a: str, b: str, c: str, e: str) -> str:
    flat = lambda p, q: f"case when abs({q}-{p})<0.00001 then 0.0::double else {q}-{p} end"
    raw = f"cast(trunc(atan2({flat(b, e)}, {flat(a, c)})*180/{P}+{d(0.5)}) as integer)"
    return f"(({raw}+360)%360)"


def turn(a: str, b: str) -> str:
    return f"abs(case when {b}-{a}>180 then {b}-{a}-360 when {b}-{a}<-180 then {b}-{a}+360 else {b}-{a} end)"


def haversine(a: str, b: str, c: str, e: str, radius: float = 6371000.0, pi: float = PI) -> str:
    rad = lambda v: f"({v})*{d(pi)}/180"
    h = f"(pow(sin({rad(f'{e}-{b}')}/2),2)+cos({rad(b)})*cos({rad(e)})*pow(sin({rad(f'{c}-{a}')}/2),2))"
    return f"2*{d(radius)}*atan2(sqrt({h}),sqrt(1-{h}))"


def foot(px: str, py: str, f: tuple[str, str], t: tuple[str, str]) -> tuple[str, str]:
    (fx, fy), (tx, ty) = f, t
    u = f"((({px}-{tx})*({fx}-{tx})+({py}-{ty})*({fy}-{ty}))/nullif(({fx}-{tx})*({fx}-{tx})+({fy}-{ty})*({fy}-{ty}),0))"
    return u, planar(px, py, f"({tx}+{u}*({fx}-{tx}))", f"({ty}+{u}*({fy}-{ty}))")


def beside(px: str, py: str, f: tuple[str, str] = ("fx", "fy"), t: tuple[str, str] = ("tx", "ty")) -> str:
    u, away = foot(px, py, f, t)
    return f"case when {u}<0 or {u}>1 then {R} else {away} end"


def anywhere(px: str, py: str) -> str:
    _, away = foot(px, py, ("fx", "fy"), ("tx", "ty"))
    return f"least({away},{planar(px, py, 'fx', 'fy')},{planar(px, py, 'tx', 'ty')})"


def hits(x: str, y: str, nx: str, ny: str, f: tuple[str, str], t: tuple[str, str]) -> str:
    mx, my = f"(({x}+{nx})/2)", f"(({y}+{ny})/2)"
    u, away = foot(mx, my, f, t)
    return f"coalesce({u}>={d(-0.3)} and {u}<={d(1.3)} and {turn(angle(x, y, nx, ny), angle(*f, *t))}<=45 and {away}<{planar(mx, my, *f)} and {away}<{planar(mx, my, *t)} and {away}<{planar(*f, *t)}, false)"


_POINT = "{'x': cast(split_part(trim(p),' ',1) as double), 'y': cast(split_part(trim(p),' ',2) as double)}"
#: Common tables, each built on those before it.
CHAIN = {
    "nodes": NODES.format(part="part"),
    "links": LINKS.format(nodes="nodes"),
    "trace": TRACE.format(events="events", part="part"),
    "nn": f"select node_id, cast(node_id as bigint) as seq, x_coord as x, y_coord as y, zone_id, {cell('x_coord', 'y_coord')} as cell_id from nodes",
    "ll": f"""select l.link_id, cast(l.link_id as bigint) as link_seq, l.from_node_id, l.to_node_id, l.length, greatest({d(0.1)}, l.vdf_fftt1) as fft_min,
        cast(trunc(greatest({d(0.1)}, l.vdf_fftt1)*60) as integer) as fft_sec, l.link_type_code, l.geometry, a.x as fx, a.y as fy, b.x as tx, b.y as ty, a.cell_id as from_cell, b.cell_id as to_cell,
        list_transform(string_split(regexp_extract(l.geometry, '\\(([^)]*)\\)', 1), ','), lambda p: {_POINT}) as shape
        from links l join nn a on a.node_id = l.from_node_id join nn b on b.node_id = l.to_node_id""",
    "lk": f"select *, {planar('shape[1].x', 'shape[1].y', 'shape[2].x', 'shape[2].y')}+{planar('shape[2].x', 'shape[2].y', 'shape[3].x', 'shape[3].y')} as link_distance from ll",
    "pts": "select agent_id, cast(user_id as bigint)*2147483648+trace_no as seq, trace_no, trace_id, x_coord as x, y_coord as y, sec, o_node_id, nullif(allowed_link_type_code,'') as allowed, nullif(blocked_link_type_code,'') as blocked from trace",
    "kept": f"select *, row_number() over (partition by agent_id order by seq)-1 as g from (select *, {cell('x', 'y')} as cell_id from pts) where cell_id in (select cell_id from nn)",
    "pl": "select k.*, l.* exclude (link_seq), l.link_seq from (select *, lead(x) over (partition by agent_id order by g) as nx, lead(y) over (partition by agent_id order by g) as ny from kept) k cross join (select min(node_id) as low, max(node_id)-min(node_id)+1 as n_ids from nn) i join (select *, row_number() over (partition by from_node_id order by link_seq)-1 as nth, count(*) over (partition by from_node_id) as n_out from lk) l on l.from_node_id = i.low+(k.trace_id*7) % i.n_ids and l.nth = (k.trace_id//i.n_ids) % l.n_out where k.nx is not null",
    "spans": "select agent_id, arg_min(sec,g)/60 as start_min, max(sec)/60 as end_min, arg_max(sec,g)/60 as last_min, count(*) as n_points, arg_min(sec,g) as start_sec from kept group by agent_id",
    "span": f"select min(start_min) as t0, max(end_min) as t1, cast(trunc(greatest((max(end_min)-min(start_min))/{B}+1, 10)) as integer) as bins from spans",
    "deltas": f"select *, sec-lag(sec) over w as interval_s, {haversine('lag(x) over w', 'lag(y) over w', 'x', 'y')} as metres from kept window w as (partition by agent_id order by g)",
    "sampling": f"select agent_id, case when count(interval_s)>=4 then quantile_cont(interval_s,0.5)/60 when count(interval_s)>=1 then {B} else 0.5 end as sampling_min from deltas group by agent_id",
    "segs": f"select agent_id, coalesce(arg_min(dd,g) filter (where dd is not null),0) as first_length, coalesce(arg_max(dd,g) filter (where dd is not null),0) as last_length, coalesce(sum(dd),0) as total_length, coalesce(sum(dd),0)/greatest(1,count(*)-1) as mean_length from (select *, {planar('x', 'y', 'lead(x) over w', 'lead(y) over w')} as dd from kept window w as (partition by agent_id order by g)) group by agent_id",
    "box": "select min(x) as lft, max(x) as rgt, min(y) as bot, max(y) as top from nn",
    "ix": f"select n.*, cast(floor(x/{R})-floor(lft/{R}) as bigint) as x_index, cast(floor(y/{R})-floor(bot/{R}) as bigint) as y_index from nn n cross join box",
    "gz": "select x_index, y_index, arg_min(zone_id, seq) filter (where zone_id>0) as zone_id from ix group by all",
    "fz": "select a.x_index, a.y_index, coalesce(a.zone_id, (select z.zone_id from gz z where z.zone_id is not null order by (a.x_index-z.x_index)*(a.x_index-z.x_index)+(a.y_index-z.y_index)*(a.y_index-z.y_index), z.x_index, z.y_index limit 1)) as zone_id from gz a",
    "given": "select agent_id, arg_max(o_node_id, seq) filter (where o_node_id in (select node_id from nn)) as o_node_id, arg_max(allowed, seq) filter (where allowed is not null) as allowed, arg_max(blocked, seq) filter (where blocked is not null) as blocked from pts group by agent_id",
    "bp": "select agent_id, arg_min(x,g) as x0, arg_min(y,g) as y0, coalesce(max(case when g=1 then x end), arg_min(x,g)) as x1, coalesce(max(case when g=1 then y end), arg_min(y,g)) as y1, arg_max(x,g) as x3, arg_max(y,g) as y3, coalesce(max(case when back=1 then x end), arg_max(x,g)) as x2, coalesce(max(case when back=1 then y end), arg_max(y,g)) as y2 from (select *, row_number() over (partition by agent_id order by g desc)-1 as back from kept) group by agent_id",
    "ask": "select b.*, s.first_length, s.last_length, v.o_node_id, v.allowed, v.blocked from bp b join segs s using (agent_id) left join given v using (agent_id)",
}


def _score(p0: tuple[str, str], p1: tuple[str, str], length: str) -> str:
    ratio = f"(link_distance/greatest({d(1e-8)},{length}))"
    a, z = planar(*p0, "fx", "fy"), planar(*p1, "tx", "ty")
    plain = f"case when {ratio}>1.0::double/3 and {ratio}<3 then ({beside(*p0)}+{beside(*p1)}+{a}+{z})/4 else least({a},{z}) end"
    return f"({plain})*case when {turn(angle(*p0, *p1), angle('fx', 'fy', 'tx', 'ty'))}>45 then 10 else 1 end"


_FINE = "not (coalesce(allowed,'')<>'' and link_type_code<>'' and not contains(allowed, link_type_code)) and not (coalesce(blocked,'')<>'' and link_type_code<>'' and contains(blocked, link_type_code))"
_NONHIT = ", ".join(
    f"({anywhere('x', 'y')}*10+{planar('x', 'y', f'shape[{p}].x', f'shape[{p}].y')}+{'0' if p == 3 else f'coalesce({planar("nx", "ny", f"shape[{p + 1}].x", f"shape[{p + 1}].y")},0)'})/10" for p in (1, 2, 3)
)
_HIT = f"nx is not null and ({hits('x', 'y', 'nx', 'ny', ('shape[1].x', 'shape[1].y'), ('shape[2].x', 'shape[2].y'))} or {hits('x', 'y', 'nx', 'ny', ('shape[2].x', 'shape[2].y'), ('shape[3].x', 'shape[3].y'))})"
CHAIN |= {
    "oo": f"select agent_id, arg_min(from_node_id, struct_pack(s := s, l := link_seq)) as o, min(s) as o_score from (select a.agent_id, l.*, {_score(('x0', 'y0'), ('x1', 'y1'), 'first_length')} as s from ask a cross join lk l where {_FINE} and o_node_id is null) group by agent_id",
    "dd": f"select agent_id, arg_min(to_node_id, struct_pack(s := s, l := link_seq)) as dn, min(s) as d_score from (select a.agent_id, l.*, {_score(('x2', 'y2'), ('x3', 'y3'), 'last_length')} as s from ask a cross join lk l where {_FINE}) group by agent_id",
    "ends": "select a.agent_id, coalesce(a.o_node_id, oo.o) as o_node_id, dd.dn as d_node_id, oo.o_score, dd.d_score, a.allowed, a.blocked from ask a left join oo using (agent_id) left join dd using (agent_id)",
    "cl": "select unnest(case when from_cell=to_cell then [from_cell] else [from_cell, to_cell] end) as cell_id, link_seq, fx, fy, tx, ty, shape, link_distance from lk",
    "cand": "select k.*, c.* exclude (cell_id) from (select *, lead(x) over w as nx, lead(y) over w as ny from kept window w as (partition by agent_id, cell_id order by g)) k join cl c using (cell_id)",
    "scored": f"select agent_id, link_seq, cell_id, g, trace_no, sec, list_min(list_filter([{_NONHIT}], lambda v: v <= link_distance*2)) as nonhit, {beside('x', 'y')} as beside, {_HIT} as hit from cand",
    "cells": f"select cell_id, min(cast(floor(x/{R})-floor((select lft from box)/{R}) as bigint)) as x_index, min(cast(floor(y/{R})-floor((select bot from box)/{R}) as bigint)) as y_index from kept group by cell_id",
    "percell": f"select s.agent_id, s.link_seq, c.x_index*100000+c.y_index as o, least({R}, coalesce(min(nonhit),{R})) as c, arg_min(trace_no, struct_pack(n := nonhit, g := g)) filter (where nonhit<{R}) as matched, arg_min(trace_no, struct_pack(b := beside, g := g)) as nearest, sum(hit::int) as hits from scored s join cells c using (cell_id) group by s.agent_id, s.link_seq, c.x_index, c.y_index",
    "costs": "select agent_id, link_seq, arg_max(c,o) as cost, coalesce(arg_max(matched,o) filter (where matched is not null), arg_min(nearest,o)) as trace_no, cast(sum(hits) as bigint) as hit_count from percell group by agent_id, link_seq",
    "arcs": f"select e.agent_id, l.from_node_id, l.to_node_id, min(case when {_FINE} then coalesce(c.cost, {d(INACTIVE)}) else {d(9999.99)} end) as w from ends e cross join lk l left join costs c on c.agent_id=e.agent_id and c.link_seq=l.link_seq group by all",
}


def sql(select: str, upto: str, recursive: str = "") -> str:
    """A query over the common tables up to one of them."""
    names = list(CHAIN)[: list(CHAIN).index(upto) + 1]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as ({CHAIN[n]})" for n in names) + (f",\n{recursive}" if recursive else "") + f"\n{select}"


STEPS = "coalesce(" + ",".join(f"case when raw > {d(a + 0.000001)} and raw < {d(b)} then {d(b)} end" for a, b in zip(RESOLUTION_STEPS, RESOLUTION_STEPS[1:], strict=False)) + ", raw)"
