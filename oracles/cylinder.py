"""Oracle statements over cylinder codes."""

import math

from oracles.base import MINUTIAE, deg, millionths, rad, rounded, sigmoid, wrap8, wrapped

# The share of a unit normal distribution (in steps of the direction scale) around each byte difference.
# The scale, and the root of one half in nine digits.
_AT = [[math.erf((b * 1.43239448783 * math.pi / 128 + side) * 0.707106781) for side in (-0.5, 0.5)]
       for b in range(-128, 128)]
_LUT = ", ".join(repr((1 + hi) / 2 - (1 + lo) / 2) for lo, hi in _AT)
_DIRECTIONS = (-106, -64, -21, 21, 64, 106)
_LEVELS = range(1, 7)
_WIDE = "cast(4 + floor(8 * (1 / (1 + exp(0.4e0 * (20 - {m})))) + 0.5e0) as int)"
_NP = "case when {m} < 20 then 4 else 5 end"

HULL = f"""{MINUTIAE},
pts as materialized (select distinct role, fpid, x, y from minutiae),
hull as materialized (
  select a.role, a.fpid, a.x as x1, a.y as y1, b.x as x2, b.y as y2
  from pts a join pts b on a.role = b.role and a.fpid = b.fpid and (a.x <> b.x or a.y <> b.y)
    join pts p on a.role = p.role and a.fpid = p.fpid
  group by all
  having bool_and((b.x-a.x)*(p.y-a.y) - (b.y-a.y)*(p.x-a.x) > 0
    or ((b.x-a.x)*(p.y-a.y) - (b.y-a.y)*(p.x-a.x) = 0
        and (p.x-a.x)*(b.x-a.x) + (p.y-a.y)*(b.y-a.y)
            between 0 and (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y))))"""

CELLS = f"""{HULL},
grid as (
  select i, j, (i - 1) * 8 + j - 1 as cell, i - 4.5e0 as ri, j - 4.5e0 as rj
  from range(1, 9) a(i), range(1, 9) b(j)
  where ((i - 4.5e0)*(i - 4.5e0) + (j - 4.5e0)*(j - 4.5e0)) * 306.25 <= 4900),
centres as materialized (
  select role, fpid, idx, th, x, y, cell,
    17.5e0 * (cos({rad('th')}) * ri + sin({rad('th')}) * rj) + x as px,
    17.5e0 * (cos({rad('th')}) * rj - sin({rad('th')}) * ri) + y as py
  from minutiae, grid),
edge_tests as (
  select c.role, c.fpid, c.idx, c.cell, (px-x1) as vx, (py-y1) as vy, (x2-x1) as ux, (y2-y1) as uy,
    (px-x2)*(px-x2) + (py-y2)*(py-y2) as d2b
  from centres c join hull h on c.role = h.role and c.fpid = h.fpid),
valid_cells as materialized (
  select role, fpid, idx, cell,
    bool_and(vy*ux - vx*uy >= 0) or min(
      case when vx*ux + vy*uy between 0 and ux*ux + uy*uy then abs(vy*ux - vx*uy) / sqrt(ux*ux + uy*uy)
           else sqrt(least(vx*vx + vy*vy, d2b)) end) <= 50 as ok
  from edge_tests group by role, fpid, idx, cell)"""

FEATURES = f"""{CELLS},
lut as materialized (
  select unnest(range(-128, 128)) as b, unnest([{_LUT}]) as w),
context as materialized (
  select a.role, a.fpid, a.idx, a.th, b.idx as nidx, b.x as nx, b.y as ny,
    {wrap8('a.th - b.th')} as turn
  from minutiae a join minutiae b on a.role = b.role and a.fpid = b.fpid
    and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 98*98),
weighted as materialized (
  select c.*, {", ".join(f"l{k}.w as w{k}" for k in _LEVELS)}
  from context c {" ".join(f"join lut l{k} on l{k}.b = {wrap8(f'c.turn - ({_DIRECTIONS[k - 1]})')}" for k in _LEVELS)}
  where c.idx <> c.nidx),
near as (
  select c.role, c.fpid, c.idx, c.cell,
    0.042743816e0 / exp(((px-nx)*(px-nx) + (py-ny)*(py-ny)) * 0.005739796e0) as s,
    {", ".join(f"w{k}" for k in _LEVELS)}
  from centres c join weighted w on c.role = w.role and c.fpid = w.fpid and c.idx = w.idx
  where (px-nx)*(px-nx) + (py-ny)*(py-ny) <= 784),
sums as materialized (
  select role, fpid, idx, cell, {", ".join(f"sum(s * w{k}) as s{k}" for k in _LEVELS)}
  from near group by role, fpid, idx, cell),
cells as materialized (
  select v.role, v.fpid, v.idx, v.cell, v.ok,
    {", ".join(f"case when ok then cast({sigmoid(f'coalesce(s{k}, 0)', 0.01, 400.0)} as real) else 0 end as c{k}" for k in _LEVELS)}
  from valid_cells v left join sums s
    on v.role = s.role and v.fpid = s.fpid and v.idx = s.idx and v.cell = s.cell),
counts as (select role, fpid, idx, count(*) as near_count from context group by role, fpid, idx),
cls as materialized (
  select c.role, c.fpid, c.idx as lsid, any_value(near_count) as near_count,
    sum(cast(ok as int)) as n_ok,
    {" + ".join(f"sum(cast(c{k} as double))" for k in _LEVELS)} as total,
    sqrt(sum({" + ".join(f"cast(c{k} as double) * cast(c{k} as double)" for k in _LEVELS)})) as raw_norm,
    list_concat({", ".join(f"array_agg(cast(c{k} as double) order by cell)" for k in _LEVELS)}) as codes,
    array_agg(cast(cast(ok as int) as double) order by cell) as v,
    array_agg({" + ".join(f"cast(c{k} as double) * cast(c{k} as double)" for k in _LEVELS)} order by cell) as sq
  from cells c join counts n on c.role = n.role and c.fpid = n.fpid and c.idx = n.idx
  group by c.role, c.fpid, c.idx),
cyl as materialized (
  select c.role, c.fpid, c.lsid, m.x, m.y, m.th, n_ok, total,
    case when 384 - 6 * n_ok >= 174 or near_count < 4 then -1 else raw_norm end as norm,
    cast(codes as double[312]) as a, cast(v as double[52]) as v, cast(sq as double[52]) as sq
  from cls c join minutiae m on c.role = m.role and c.fpid = m.fpid and c.lsid = m.idx),
cn as materialized (
  select role, fpid, count(*) as n from cyl where role = 'Q' or norm >= 0 group by role, fpid)"""

MATCH = f"""{FEATURES},
cpairs as (
  select t.fpid as t_fpid, i.fpid as i_fpid, t.lsid as t_ls, i.lsid as i_ls,
    t.x as tx, t.y as ty, t.th as tth, i.x as ix, i.y as iy, i.th as ith, t.norm + i.norm as norms,
    array_inner_product(t.v, i.v) * 6 as common,
    array_inner_product(t.sq, i.v) + array_inner_product(t.v, i.sq) - 2 * array_inner_product(t.a, i.a) as diff2
  from cyl t, cyl i
  where t.role = 'T' and i.role = 'Q' and t.norm >= 0 and i.norm >= 0
    and abs({wrap8('t.th - i.th')}) <= 64),
cm as materialized (
  select * exclude (norms, common, diff2),
    {millionths("1 - sqrt(greatest(diff2, 0)) / norms")} as sl
  from cpairs where common >= 230 and {millionths("1 - sqrt(greatest(diff2, 0)) / norms")} > 0),
sizes as materialized (
  select t_fpid, i_fpid, count(distinct t_ls) as matched, any_value(q.n) as n_i, any_value(t.n) as n_t
  from cm join cn q on q.role = 'Q' and q.fpid = i_fpid join cn t on t.role = 'T' and t.fpid = t_fpid
  group by t_fpid, i_fpid)"""

_DISTINCT = f"""{MATCH},
ranked as (
  select t_fpid, i_fpid, sl, row_number() over (partition by t_fpid, i_fpid order by sl desc) as r
  from (select distinct t_fpid, i_fpid, sl from cm) qualify r <= 12)"""

_LSS = f"""select t_fpid, i_fpid, {rounded("sum(sl) / (any_value(np) * 1e6)")} as score
from (select *, {_NP.format(m='least(n_i, matched)')} as np from sizes) join ranked using (t_fpid, i_fpid)
where r <= np group by t_fpid, i_fpid"""

_NB = f"""{MATCH},
ranked as (
  select t_fpid, i_fpid, sl,
    row_number() over (partition by t_fpid, i_fpid order by sl desc, t_ls desc, i_ls desc) as r
  from cm qualify r <= 12)"""

_HALF = f"""{MATCH},
half as materialized (
  select m.*, n_i, matched,
    row_number() over (partition by t_fpid, i_fpid order by sl desc, t_ls desc, i_ls desc) as r
  from cm m join sizes using (t_fpid, i_fpid) qualify r <= n_i // 2)"""


def _relaxed(nr: str, kept: str = "n_i // 2") -> str:
    def bearing(p, q):
        return wrapped(rad(f"{p}th"), f"atan2(cast({p}y - {q}y as double), cast({q}x - {p}x as double))")

    def turn(p, q):
        return wrapped(rad(f"{p}th"), rad(f"{q}th"))

    def dist(p, q):
        return f"sqrt(cast(({p}x - {q}x)*({p}x - {q}x) + ({p}y - {q}y)*({p}y - {q}y) as double))"

    rho = " * ".join([
        sigmoid("d1", 5.0, -1.6), sigmoid(f"abs({wrapped('u_t', 'u_i')})", 0.261799387799, -30.0),
        sigmoid(f"abs({wrapped('b_t', 'b_i')})", 0.261799387799, -30.0)])
    rounds = ""
    for n in range(1, 6):
        rounds += f""",
l{n} as materialized (
  select k.t_fpid, k.i_fpid, k.r, any_value(k.nr) as nr, any_value(k.start) as start,
    case when any_value(k.nr) = 1 then any_value(k.value)
         else 0.5e0 * any_value(k.value) + 0.5e0 / (any_value(k.nr) - 1) * coalesce(sum(rho * o.value), 0) end as value
  from l{n - 1} k
    left join rho p on p.t_fpid = k.t_fpid and p.i_fpid = k.i_fpid and p.ra = k.r
    left join l{n - 1} o on o.t_fpid = k.t_fpid and o.i_fpid = k.i_fpid and o.r = p.rb
  group by k.t_fpid, k.i_fpid, k.r)"""
    return f"""{_HALF.replace("n_i // 2", kept)},
nrs as (
  select t_fpid, i_fpid, cast(floor({nr}) as int) as nr, any_value(n_i) as n_i, any_value(matched) as matched
  from half group by t_fpid, i_fpid),
used as materialized (
  select half.*, nrs.nr from half join nrs using (t_fpid, i_fpid) where r <= nr),
related as (
  select a.t_fpid, a.i_fpid, a.r as ra, b.r as rb,
    abs({dist('a.t', 'b.t')} - {dist('a.i', 'b.i')}) as d1,
    {turn('a.t', 'b.t')} as u_t, {turn('a.i', 'b.i')} as u_i,
    {bearing('a.t', 'b.t')} as b_t, {bearing('a.i', 'b.i')} as b_i
  from used a join used b on a.t_fpid = b.t_fpid and a.i_fpid = b.i_fpid and a.r <> b.r),
rho as materialized (select t_fpid, i_fpid, ra, rb, {rho} as rho from related),
l0 as materialized (select t_fpid, i_fpid, r, nr, sl / 1e6 as start, sl / 1e6 as value from used){rounds},
best as (
  select l.t_fpid, l.i_fpid, value,
    least(nr, {_NP.format(m='least(n_i, matched)')}) as np,
    row_number() over (partition by l.t_fpid, l.i_fpid order by value / start desc, r desc) as e
  from l5 l join sizes using (t_fpid, i_fpid))"""


_RELAXED_SCORE = f"""select t_fpid, i_fpid, {rounded("sum(value) / any_value(np)", 4)} as score
from best where e <= np group by t_fpid, i_fpid"""

SQL = {
    "convex_hull_edges": f"with {HULL} select fpid, x1, y1, x2, y2 from hull where role = 'T'",
    "cylinder_cells": f"""with {CELLS} select fpid, idx as lsid, count(*) filter (ok) as valid_cells
from valid_cells where role = 'T' group by fpid, idx""",
    "cylinder_features": f"""with {FEATURES}
select fpid, lsid, x, y, th, cast(n_ok as bigint) as valid_cells, {rounded('norm', 4)} as norm,
  {rounded('total', 4)} as total from cyl where role = 'T'""",
    "cylinder_local_matches": f"""with {MATCH}
select t_fpid, i_fpid, count(*) as matches, count(distinct t_ls) as matched,
  cast(sum(sl) as bigint) as sl_sum, max(sl) as sl_max from cm group by t_fpid, i_fpid""",
    "np_pairs": f"""with {MATCH} select t_fpid, i_fpid, n_t, n_i, matched,
  {_NP.format(m='least(n_i, matched)')} as np_matched, {_NP.format(m='least(n_i, n_t)')} as np_all from sizes""",
    "score_lss": f"with {_DISTINCT} {_LSS}",
    "score_lss_wide": f"with {_DISTINCT} {_LSS.replace(_NP.format(m='least(n_i, matched)'), _WIDE.format(m='least(n_i, matched)'))}",
    "score_nb_wide": f"""with {_NB}
select t_fpid, i_fpid, {rounded("sum(sl) / (any_value(np) * 1e6)")} as score
from (select *, {_WIDE.format(m='least(n_i, n_t)')} as np from sizes) join ranked using (t_fpid, i_fpid)
where r <= np group by t_fpid, i_fpid""",
    "score_lss_improved": f"""with {_DISTINCT}
select t_fpid, i_fpid, {rounded("sum(sl) / 1e7")} as score from ranked where r <= 10 group by t_fpid, i_fpid""",
    "score_lss_threshold": f"""with {MATCH}
select t_fpid, i_fpid, {rounded("sum(sl) / (count(*) * 1e6)")} as score
from cm where sl > 500000 group by t_fpid, i_fpid""",
    "score_nb": f"""with {_NB}
select t_fpid, i_fpid, {rounded("sum(sl) / (any_value(np) * 1e6)")} as score
from (select *, {_NP.format(m='least(n_i, n_t)')} as np from sizes) join ranked using (t_fpid, i_fpid)
where r <= np group by t_fpid, i_fpid""",
    "lssr_top_matches": f"""with {_HALF}
select t_fpid, i_fpid, t_ls as t_lsid, i_ls as i_lsid, sl, r as rank from half""",
    "lssr_rho": f"""with {_relaxed('least(any_value(n_i), any_value(matched), 2 * count(*)) / 2')}
select t_fpid, i_fpid, any_value(nr) as nr, {rounded("sum(rho)", 3)} as rho_sum
from rho join nrs using (t_fpid, i_fpid) group by t_fpid, i_fpid""",
    "score_lssr": f"with {_relaxed('least(any_value(n_i), any_value(matched), 2 * count(*)) / 2')} {_RELAXED_SCORE}",
    "score_lssr_improved": f"with {_relaxed('least(any_value(n_i), any_value(matched), count(*))', 'n_i')} {_RELAXED_SCORE}",
}
