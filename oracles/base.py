"""Shared common table expressions of the oracle statements."""


def wrap8(e: str) -> str:
    return f"(((({e}) + 128) % 256 + 256) % 256 - 128)"


def deg(th: str) -> str:
    return f"((({th}) + 128) * 360 // 256)"


def rad(th: str) -> str:
    return f"({deg(th)} * 0.017453293)"


def trunc(e: str) -> str:
    return f"trunc({e})"


def millionths(e: str) -> str:
    return f"cast(floor((({e}) + 1e-9) * 1e6 + 0.5e0) as bigint)"


def rounded(e: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor((({e}) + 1e-9) * {scale} + 0.5e0) / {scale}"


def wrapped(a: str, b: str) -> str:
    d = f"(({a}) - ({b}))"
    return (f"case when {d} < -pi() then 2*pi() + {d} when {d} >= pi() then {d} - 2*pi() else {d} end")


def folded(a: str, b: str) -> str:
    d = f"(({a}) - ({b}))"
    return (f"case when {d} > pi() then 2*pi() - {d} when {d} <= -pi() then 2*pi() + {d} else {d} end")


def sigmoid(v: str, mu: float, tau: float) -> str:
    return f"(1 / (1 + exp({float(tau)}e0 * ({mu!r}e0 - ({v})))))"


MINUTIAE = """
base as (
  select l_partkey as pk, l_orderkey as ok, l_suppkey as sk, l_linenumber as ln,
         cast(round(l_extendedprice * 100) as bigint) as pc, cast(l_quantity as int) as q
  from lineitem),
finger as (
  select *, (ok*7919 + sk*104729 + ln*1299709 + pc*31) % 240 as u,
    (ok*15485863 + sk*611953 + ln*7907 + pc*17) % 320 as v
  from base),
stranger as (
  select *, (ok*611953 + sk*7919 + ln*15485863 + pc*29) % 240 as u,
    (ok*1299709 + sk*7907 + ln*104729 + pc*23) % 320 as v
  from base),
placed as (
  select 'T' as role, 'Finger' || lpad(cast(pk as varchar), 12, '0') || '_1' as fpid,
         ok, sk, ln, pc, q, 20 + u as x, 20 + v as y,
         ((u + v) // 4 + (pc*13 + ok*101 + ln*37) % 24) % 180 as a
  from finger
  union all
  select 'Q', 'Finger' || lpad(cast(pk as varchar), 12, '0') || '_2', ok, sk, ln, pc, q,
    20 + u + 12 + (ln % 3) - 1, 20 + v - 9 + (sk % 3) - 1,
    (((u + v) // 4 + (pc*13 + ok*101 + ln*37) % 24) % 180 + ln % 2) % 180
  from finger join nation on pk = n_nationkey where n_regionkey <= 2
  union all
  select 'Q', 'Finger' || lpad(cast(pk as varchar), 12, '0') || '_2', ok, sk, ln, pc, q,
    20 + u, 20 + v, ((u + v) // 4 + (pc*7 + ok*53 + ln*11) % 24) % 180
  from stranger join nation on pk = n_nationkey where n_regionkey > 2),
minutiae as materialized (
  select role, fpid,
    cast(row_number() over (partition by role, fpid order by ok, ln, sk, pc, q) - 1 as int) as idx,
    cast(x as int) as x, cast(y as int) as y, cast(a as int) as a, q,
    cast(trunc((a*512 - 46080) / 360e0) as int) as th
  from placed)"""

_RAD = wrap8("trunc(atan2(y - ny, x - nx) * 128 / pi()) + th")

JIANG = f"""{MINUTIAE},
dist as (
  select a.role, a.fpid, a.idx, a.x, a.y, a.th,
    (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2,
    max(b.idx) as nidx
  from minutiae a join minutiae b on a.role = b.role and a.fpid = b.fpid and a.idx <> b.idx
  group by all),
near as (
  select d.*, row_number() over (partition by d.role, d.fpid, d.idx order by d2) as k
  from dist d qualify k <= 4),
vec as (
  select n.role, n.fpid, n.idx as lsid, n.x, n.y, n.th, n.k, sqrt(n.d2) as d,
    cast({wrap8("trunc(atan2(n.y - m.y, n.x - m.x) * 128 / pi()) + n.th")} as int) as r,
    cast({wrap8("m.th - n.th")} as int) as v
  from near n join minutiae m on m.role = n.role and m.fpid = n.fpid and m.idx = n.nidx),
jls as materialized (
  select role, fpid, lsid, x, y, th,
    {", ".join(f"max(d) filter (k = {k}) as d{k}, max(r) filter (k = {k}) as r{k}, max(v) filter (k = {k}) as v{k}" for k in range(1, 5))}
  from vec group by role, fpid, lsid, x, y, th having count(*) = 4),
jn as materialized (select role, fpid, count(*) as n from jls group by role, fpid)"""

_SUM = (" + ".join(f"abs(t.d{k} - i.d{k})" for k in range(1, 5)) + " + ("
        + " + ".join(f"abs({wrap8(f't.{n}{k} - i.{n}{k}')})" for n in "rv" for k in range(1, 5))
        + ") * 0.421875e0")

JMATCH = f"""{JIANG},
jpairs as (
  select t.fpid as t_fpid, i.fpid as i_fpid, t.lsid as t_ls, i.lsid as i_ls, {_SUM} as total
  from jls t, jls i
  where t.role = 'T' and i.role = 'Q' and abs(t.x - i.x) < 250 and abs(t.y - i.y) < 250
    and abs({wrap8("t.th - i.th")}) < 96),
jm as materialized (
  select t_fpid, i_fpid, t_ls, i_ls, {millionths("1 - total / 72e0")} as sl
  from jpairs where total < 72 and {millionths("1 - total / 72e0")} > 0)"""

JLOCAL = f"""{JMATCH},
per_t as (
  select *, row_number() over (partition by t_fpid, i_fpid, t_ls order by sl desc, i_ls desc) as rt
  from jm qualify rt = 1),
per_i as (
  select *, row_number() over (partition by t_fpid, i_fpid, i_ls order by sl desc, t_ls desc) as ri
  from per_t qualify ri = 1),
scores as materialized (
  select t_fpid, i_fpid, {rounded("sum(sl) / (any_value(n) * 1e6)")} as score
  from per_i join jn on role = 'T' and fpid = t_fpid group by t_fpid, i_fpid)"""
