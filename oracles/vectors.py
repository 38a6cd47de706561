"""Oracle statements over neighbourhood vectors and their evaluation."""

from oracles.base import JIANG, JLOCAL, JMATCH, MINUTIAE, deg, folded, millionths, rounded, wrap8

_SEEDS = f"""{JMATCH},
seeds as materialized (
  select *, row_number() over (partition by t_fpid, i_fpid order by sl desc, t_ls desc, i_ls desc) as rank
  from jm qualify rank <= 5)"""


def _crn(th: str) -> str:
    return f"((180 - {deg(th)}) * 0.017453293e0)"


def _far(m: str, ref: str) -> str:
    return f"sqrt(cast(({m}.x-{ref}.x)*({m}.x-{ref}.x) + ({m}.y-{ref}.y)*({m}.y-{ref}.y) as double))"


def _bearing(m: str, ref: str) -> str:
    return folded(f"atan2(cast({m}.y - {ref}.y as double), cast({m}.x - {ref}.x as double))", _crn(f"{ref}.th"))


def _turn(m: str, ref: str) -> str:
    return folded(_crn(f"{m}.th"), _crn(f"{ref}.th"))


_TOTAL = (" + ".join(f"abs(t.d{k} - i.d{k})" for k in range(1, 5)) + " + ("
          + " + ".join(f"abs({wrap8(f't.{n}{k} - i.{n}{k}')})" for n in "rv" for k in range(1, 5))
          + ") * 0.421875e0")

_BOX = f"""{_SEEDS},
t_aligned as materialized (
  select s.t_fpid, s.i_fpid, s.rank, s.i_ls as seed, m.lsid, {_far('m', 'r')} as far, {_bearing('m', 'r')} as bearing,
    {_turn('m', 'r')} as turn
  from seeds s join jls r on r.role = 'T' and r.fpid = s.t_fpid and r.lsid = s.t_ls
    join jls m on m.role = 'T' and m.fpid = s.t_fpid),
i_aligned as materialized (
  select m.fpid as i_fpid, r.lsid as seed, m.lsid, {_far('m', 'r')} as far, {_bearing('m', 'r')} as bearing,
    {_turn('m', 'r')} as turn
  from jls r join jls m on r.role = 'Q' and m.role = 'Q' and m.fpid = r.fpid),
box as materialized (
  select a.t_fpid, a.i_fpid, nt.n as n_t, ni.n as n_i, a.rank, a.lsid as t_lsid, b.lsid as i_lsid,
    1000000 + case when abs(t.x - i.x) < 250 and abs(t.y - i.y) < 250 and abs({wrap8('t.th - i.th')}) < 96
      and {_TOTAL} < 72 then {millionths(f"1 - ({_TOTAL}) / 72e0")} else 0 end as weight
  from t_aligned a join i_aligned b on a.i_fpid = b.i_fpid and a.seed = b.seed
    and abs(a.far - b.far) < 8 and abs(a.bearing - b.bearing) < pi() / 6 and abs(a.turn - b.turn) < pi() / 6
    join jls t on t.role = 'T' and t.fpid = a.t_fpid and t.lsid = a.lsid
    join jls i on i.role = 'Q' and i.fpid = a.i_fpid and i.lsid = b.lsid
    join jn nt on nt.role = 'T' and nt.fpid = a.t_fpid join jn ni on ni.role = 'Q' and ni.fpid = a.i_fpid)"""

_GROUP = "t_fpid, i_fpid, rank"
_ORDER = "order by weight desc, t_lsid desc, i_lsid desc"

_GREEDY = f"""{_BOX},
rounds as (
  select *, 0 as state from box
  union all
  select * exclude (rt, ri, best, tb, ib), case when best then 1 else 0 end
  from (
    select *, bool_or(best) over (partition by {_GROUP}, t_lsid) as tb,
      bool_or(best) over (partition by {_GROUP}, i_lsid) as ib
    from (
      select *, rt = 1 and ri = 1 as best
      from (
        select * exclude (state), row_number() over (partition by {_GROUP}, t_lsid {_ORDER}) as rt,
          row_number() over (partition by {_GROUP}, i_lsid {_ORDER}) as ri
        from rounds where state = 0)))
  where best or not (tb or ib)),
totals as (
  select t_fpid, i_fpid, rank, greatest(any_value(n_t), any_value(n_i)) as size, sum(weight) as total
  from rounds where state = 1 group by t_fpid, i_fpid, rank)"""

_KEPT = f"{JLOCAL}, kept as materialized (select * from scores where score > 0)"
_LISTS = """genuines as (
  select 'Finger' || lpad(cast(n_nationkey as varchar), 12, '0') || '_2' as i_fpid from nation where n_regionkey <= 2)"""
_EVAL = f"""{_KEPT}, {_LISTS},
best as (
  select i_fpid, t_fpid, score from kept
  qualify row_number() over (partition by i_fpid order by score desc, t_fpid desc) = 1)"""
_SAME = "contains(t_fpid, regexp_extract(i_fpid, '^(.*_)', 1))"


def _threshold(far: float, fold: str = "max") -> str:
    return f"""impostors as (
  select i_fpid, {fold}(score) as score from kept where i_fpid not in (select i_fpid from genuines) group by i_fpid),
far_places as (
  select score, row_number() over (order by score) as p, count(*) over () as n from impostors),
far_limit as (
  select coalesce(max(score), 0) as threshold from far_places where p = floor((1 - {far!r}e0) * n))"""


SQL = {
    "fixture_minutiae": f"with {MINUTIAE} select fpid, idx, x, y, th, q from minutiae where role = 'T'",
    "fingerprint_counts": f"with {MINUTIAE} select fpid, count(*) as n from minutiae where role = 'T' group by fpid",
    "knn_neighbours": f"""with {JIANG} select fpid, idx, cast(k as int) as k, nidx as neighbour, cast(d2 as bigint) as d2
from near where role = 'T' qualify count(*) over (partition by fpid, idx) = 4""",
    "jiang_features": f"""with {JIANG} select fpid, n as n_ls, lsid, x, y, th,
  {", ".join(f"r{k}, v{k}, {rounded(f'd{k}')} as d{k}" for k in range(1, 5))}
from jls join jn using (role, fpid) where role = 'T'""",
    "jiang_local_matches": f"""with {JMATCH}
select t_fpid, i_fpid, t_ls as t_lsid, i_ls as i_lsid, t.n as n_t, i.n as n_i, sl
from jm join jn t on t.role = 'T' and t.fpid = t_fpid join jn i on i.role = 'Q' and i.fpid = i_fpid""",
    "score_jiang_local": f"with {_KEPT} select * from kept",
    "structures_round_trip": f"""with {JIANG} select fpid, lsid, x, y, th,
  {", ".join(f"r{k}, v{k}, {rounded(f'd{k}')} as d{k}" for k in range(1, 5))}
from jls where role = 'T' and lsid % 7 <> 3""",
    "minutiae_round_trip": f"with {MINUTIAE} select fpid, idx, x, y, th, q from minutiae where role = 'T'",
    "lookup_fingerprints": f"""with {JIANG} select fpid, n as n_ls, lsid, x, y, th from jls join jn using (role, fpid)
where role = 'T' and fpid in (select 'Finger' || lpad(cast(n_nationkey * 3 as varchar), 12, '0') || '_1' from nation)""",
    "scores_round_trip": f"""with {_KEPT} select t_fpid, i_fpid, score, form
from kept, (values ('parquet'), ('mapreduce'), ('rdd'), ('details')) as forms(form)""",
    "score_registered": f"""with {JMATCH}
select t_fpid, i_fpid, {rounded("(sum(sl) / count(*) + max(sl)) / 2e6")} as score from jm group by t_fpid, i_fpid""",
    "jiang_seeds": f"with {_SEEDS} select t_fpid, i_fpid, t_ls as t_lsid, i_ls as i_lsid, sl, rank from seeds",
    "jiang_box_join": f"with {_BOX} select * from box",
    "score_jiang": f"""with recursive {_GREEDY}
select t_fpid, i_fpid, {rounded("max(total) / (any_value(size) * 2e6)")} as score from totals
group by t_fpid, i_fpid having max(total) > 0""",
    "rank1_identification": f"with {_EVAL} select * from best",
    "tp_count": f"with {_EVAL} select count(*) as tp from best where {_SAME}",
    "detailed_results": f"with {_KEPT} select i_fpid, t_fpid, score, {_SAME} as genuine from kept",
    "score_positions": f"""with {_KEPT}
select t_fpid, i_fpid, score, row_number() over (order by score, i_fpid, t_fpid) - 1 as position from kept""",
    "genuine_impostor_split": f"""with {_KEPT}, {_LISTS}
select t_fpid, i_fpid, score, case when i_fpid in (select i_fpid from genuines) then 'genuine' else 'impostor' end as side
from kept""",
    "far_threshold_min": f"with {_EVAL}, {_threshold(0.2, 'min')} select threshold from far_limit",
    "score_from_text": f"with {_KEPT} select * from kept",
    "evaluate_from_text": f"""with {_EVAL}, {_threshold(0.2)},
hits as (
  select i_fpid, t_fpid from kept, far_limit
  where score > threshold and i_fpid in (select i_fpid from genuines)
  qualify row_number() over (partition by i_fpid order by score desc, t_fpid desc) = 1),
tally as (select count(*) filter ({_SAME}) as tp from hits),
size as (select count(*) as g from genuines)
select threshold, tp, g - tp as fn, (g - tp) / g as fnr from far_limit, tally, size""",
    "fnr_no_impostors": f"""with {_EVAL}, {_LISTS.replace('genuines', 'all_genuines')},
size as (select count(*) as g from all_genuines),
tally as (select count(*) filter ({_SAME}) as tp from best where i_fpid in (select i_fpid from all_genuines))
select 0e0 as threshold, tp, g - tp as fn, (g - tp) / g as fnr from tally, size""",
    "far_threshold": f"with {_EVAL}, {_threshold(0.2)} select threshold from far_limit",
    "fnr_at_far": f"""with {_EVAL}, {_threshold(0.0)},
hits as (
  select i_fpid, t_fpid from kept, far_limit
  where score > threshold and i_fpid in (select i_fpid from genuines)
  qualify row_number() over (partition by i_fpid order by score desc, t_fpid desc) = 1),
tally as (select count(*) filter ({_SAME}) as tp from hits),
size as (select count(*) as g from genuines)
select threshold, tp, g - tp as fn, (g - tp) / g as fnr from far_limit, tally, size""",
}
