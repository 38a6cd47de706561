"""Oracle statements over text lines, names and scalar functions."""

from oracles.base import deg, folded, rad, rounded, sigmoid, wrap8, wrapped
from ridgemark.catalog import KEYS, MINUTIAE_LINE, PATHS

# The path pattern of each database type, first match wins.
TYPE_PATTERNS = (
    ("nist", r"\/[f|s|F|S][0-9]*(\.xyt)?$"),
    ("sfinge", r"\/(Sfinge)?[A-Z][a-z]+[0-9]+_[0-9]+(\.xyt)?$"),
    ("fvc", r"\/[0-9]+_[0-9]+(\.xyt)?$"),
    ("mcyt", r"\/(pb|dp)+_[0-9]{4}_[0-9]_[0-9]+(\.xyt)?$"),
    ("casiav5", r"\/[0-9]{3}\/[LR]\/[0-9]{3}_[LR][0-3]_[0-9]+(\.xyt)?$"),
    ("fingerpass", r"\/[A-Za-z0-9]+_[0-9]{4}_[0-9]{2}(\.xyt)?$"),
    ("spain", r"\/[0-9]{5}[A-Z]{4}(RE|V[1-3])[0-9]{3}(_1[12])?(\.xyt)?$"),
)

_TH = "cast(trunc(({a} * 512 - 46080) / 360e0) as int)"

def _type(f: str) -> str:
    return "case " + " ".join(f"when regexp_matches({f}, '{p}') then '{n}'" for n, p in TYPE_PATTERNS) + " else 'unknown' end"


def _genuine(t1: str, t2: str, f1: str, f2: str) -> str:
    def base(f):
        return f"regexp_replace({f}, '^.*/', '')"

    def token(f, n):
        return f"string_split(regexp_replace({base(f)}, '\\.[^.]*$', ''), '_')[{n}]"

    prefix = f"regexp_extract({base(f1)}, '^(.*_)', 1)"
    return f"""coalesce(case when {t1} <> {t2} then false
  when {t1} = 'nist' then translate({f1}, 'fFsS|', 'LLLLL') = translate({f2}, 'fFsS|', 'LLLLL')
  when {t1} in ('sfinge', 'fvc') then contains({f2}, regexp_replace({prefix}, '^[^.]*\\.', ''))
  when {t1} = 'mcyt' then {token(f1, 2)} = {token(f2, 2)} and {token(f1, 3)} = {token(f2, 3)}
  when {t1} = 'fingerpass' then {token(f1, 2)} = {token(f2, 2)}
  when {t1} = 'casiav5' then contains({f2}, {prefix})
  when {t1} = 'spain' then substr({base(f1)}, 1, 7) = substr({base(f2)}, 1, 7)
  else false end, false)"""


_PATH_ROWS = " union all ".join(
    f"select p_partkey, '{name}' as shape, {a.format(**KEYS)} as f1, {b.format(**KEYS)} as f2 from part"
    for name, (a, b) in PATHS.items())

_CRN = {n: f"((180 - {deg(n)}) * 0.017453293e0)" for n in ("th", "ot")}
_D2 = "((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))"
_REJECT = "(l_returnflag = 'A' and l_linestatus = 'F') or (l_returnflag <> 'R' and l_linenumber in (6, 7))"
_FPID = "'L' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar)"

SQL = {
    "parse_minutiae_text": f"""
select {_FPID} as fpid, 0 as idx, cast(l_suppkey as int) as x, cast(l_partkey as int) as y,
  {_TH.format(a='(cast(l_quantity as int) * 3)')} as th, cast(l_quantity as int) as q
from lineitem where not ({_REJECT})
union all
select {_FPID}, 1, l_linenumber, cast(l_suppkey as int), -64, 60
from lineitem where not ({_REJECT}) and l_returnflag <> 'R'
union all
select {_FPID}, 2, 9, 9, 126, 127 from lineitem where not ({_REJECT}) and l_returnflag <> 'R'""",
    "parse_minutiae_rejects": f"select {MINUTIAE_LINE} as value from lineitem where {_REJECT}",
    "parse_scores_mr": """select 'Finger' || cast(l_partkey as varchar) || '_1' as t_fpid,
  'Finger' || cast(l_suppkey as varchar) || '_2' as i_fpid, l_discount as score from lineitem""",
    "parse_scores_tuple": """select 'Finger' || cast(l_partkey as varchar) || '_1' as t_fpid,
  'Finger' || cast(l_suppkey as varchar) || '_2' as i_fpid, l_discount as score from lineitem""",
    "probe_id_list": "select distinct 'Finger' || cast(l_partkey as varchar) || '_2' as fpid from lineitem",
    "genuine_rules": f"""
with paths as ({_PATH_ROWS}),
typed as (select *, {_type('f1')} as type1, {_type('f2')} as type2 from paths)
select p_partkey, shape, type1, type2, {_genuine('type1', 'type2', 'f1', 'f2')} as genuine,
  {_genuine('type2', 'type1', 'f2', 'f1')} as reverse from typed""",
    "angle_functions": f"""
with a as (
  select l_orderkey, l_partkey, l_linenumber,
    {_TH.format(a='((l_quantity * 7 + l_linenumber) % 180)')} as th,
    {_TH.format(a='((l_suppkey * 13 + l_linenumber) % 180)')} as ot from lineitem)
select *, cast({deg('th')} as int) as degrees, {rounded(rad('th'))} as radians, cast(360 - {deg('th')} as int) as complement,
  cast({wrap8('-th')} as int) as complement_byte, {rounded(_CRN['th'])} as complement_radians,
  cast({wrap8('th - ot')} as int) as diff256, {rounded(folded(_CRN['th'], _CRN['ot']))} as folded,
  {rounded(wrapped(rad('th'), rad('ot')))} as wrapped
from a""",
    "geometry_functions": f"""
with p as (
  select l_orderkey, l_partkey, l_linenumber, l_suppkey % 300 as cx, l_partkey % 400 as cy, l_linenumber * 10 as ax,
    cast(l_quantity as int) as ay, l_orderkey % 250 as bx, l_linenumber * 40 as by_ from lineitem),
v as (
  select *, bx - ax as ux, by_ - ay as uy, cx - ax as vx, cy - ay as vy, cx - bx as wx, cy - by_ as wy from p)
select l_orderkey, l_partkey, l_linenumber, cast({_D2} as bigint) as d2, {rounded(f"sqrt(cast({_D2} as double))")} as d,
  cast(ux * vy - uy * vx as bigint) as cross,
  {rounded('''case when ux*ux + uy*uy > 0 and vx*ux + vy*uy between 0 and ux*ux + uy*uy
    then abs(cast(vx*uy - vy*ux as double)) / sqrt(cast(ux*ux + uy*uy as double))
    else sqrt(cast(least(vx*vx + vy*vy, wx*wx + wy*wy) as double)) end''')} as segment,
  {rounded(sigmoid(f"sqrt(cast({_D2} as double))", 100.0, 0.05))} as sigmoid
from v""",
    "array_functions": """
with r as (
  select l_orderkey, l_partkey, l_linenumber,
    list_filter([l_orderkey % 50, l_partkey % 50, l_suppkey % 50, cast(l_quantity as bigint),
      case when l_returnflag = 'R' then null else cast(l_linenumber as bigint) end], lambda e: e is not null) as v
  from lineitem)
select l_orderkey, l_partkey, l_linenumber, cast(list_sum(v) as bigint) as total,
  list_position(v, list_min(v)) - 1 as min_at, list_position(v, list_max(v)) - 1 as max_at,
  array_to_string(list_reverse_sort(v)[1:3], ',') as top3,
  array_to_string(list_reverse_sort(list_distinct(v))[1:3], ',') as top3_distinct,
  array_to_string(list_transform(list_sort(list_transform(range(len(v)), lambda i: {'v': v[i + 1], 'i': i})),
    lambda s: s.i), ',') as indexes
from r""",
}
