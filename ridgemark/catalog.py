"""The registered queries: each runs over the whole given tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.functions import codec
from ridgemark.functions import numeric as N
from ridgemark.functions.names import db_type, genuine
from ridgemark.operators import consolidate as C
from ridgemark.operators import cylinder as Y
from ridgemark.operators import jiang as J
from ridgemark.operators.align import box_matches, top_matches
from ridgemark.operators.probes import shared_folder
from ridgemark.plans import enrol as P
from ridgemark.plans import evaluate as E
from ridgemark.plans import store
from ridgemark.plans.enrol import build_local_structures, enrol
from ridgemark.plans.identify import SCORES, identify
from ridgemark.sources import fixture as X
from ridgemark.sources.minutiae import parse_minutiae, parse_prints
from ridgemark.sources.scores import id_list, parse_scores


def sides(spark: SparkSession, sf_dir: str, kind: str, score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Templates and probes of the given tables, enrolled for one match."""
    return (P.enrol_for_match(X.template_minutiae(spark, sf_dir), X.ORDER, kind, score=score),
            enrol(X.probe_minutiae(spark, sf_dir), X.ORDER, kind, role="input"))


def score_query(name: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = SCORES[name][0]
        return identify(*sides(spark, sf_dir, kind, name), kind, name, **options)
    return run


local_scores = score_query("jiang_local")


def score_registered(spark, sf_dir):
    """A consolidation that is registered as init, update, merge and finish."""
    return identify(*sides(spark, sf_dir, "jiang"), "jiang", "mean_best")


def fixture_minutiae(spark, sf_dir):
    return P.number(X.template_minutiae(spark, sf_dir), X.ORDER)


def fingerprint_counts(spark, sf_dir):
    return X.template_minutiae(spark, sf_dir).groupBy("fpid").agg(F.count("*").alias("n"))


def knn_neighbours(spark, sf_dir):
    return P.neighbours(X.template_minutiae(spark, sf_dir), X.ORDER)


def jiang_features(spark, sf_dir):
    flat = J.flat_structures(enrol(X.template_minutiae(spark, sf_dir), X.ORDER, "jiang"))
    return flat.select("fpid", "n_ls", "lsid", "x", "y", "th", *J.ANGLES,
                       *[N.rounded(F.col(f"d{k}")).alias(f"d{k}") for k in J.K])


def jiang_local_matches(spark, sf_dir):
    found = J.jiang_matches(*sides(spark, sf_dir, "jiang"))
    return found.select("t_fpid", "i_fpid", "t_lsid", "i_lsid", "n_t", "n_i", "sl")


def jiang_seeds(spark, sf_dir):
    seeds = top_matches(J.jiang_matches(*sides(spark, sf_dir, "jiang")), 5)
    return seeds.select("t_fpid", "i_fpid", "t_lsid", "i_lsid", "sl", "rank")


def jiang_box_join(spark, sf_dir):
    return box_matches(*sides(spark, sf_dir, "jiang"))


def convex_hull_edges(spark, sf_dir):
    return P.hull_edges(X.template_minutiae(spark, sf_dir), X.ORDER)


def _cylinder_digests(spark, sf_dir):
    return P.cylinder_digests(X.template_minutiae(spark, sf_dir), X.ORDER)


def cylinder_cells(spark, sf_dir):
    return _cylinder_digests(spark, sf_dir).select("fpid", "lsid", "valid_cells")


def cylinder_features(spark, sf_dir):
    return _cylinder_digests(spark, sf_dir).select(
        "fpid", "lsid", "x", "y", "th", "valid_cells", *[N.rounded(F.col(n), 4).alias(n) for n in ("norm", "total")])


def cylinder_local_matches(spark, sf_dir):
    return C.summaries(*sides(spark, sf_dir, "cylinder"), top=1, sums=True).select(
        "t_fpid", "i_fpid", "matches", "matched", "sl_sum", F.get("top", F.lit(0))["sl"].alias("sl_max"))


def np_pairs(spark, sf_dir):
    df = C.summaries(*sides(spark, sf_dir, "cylinder"))
    return df.select("t_fpid", "i_fpid", "n_t", "n_i", "matched",
                     N.np_expr(F.col("n_i"), F.col("matched")).alias("np_matched"),
                     N.np_expr(F.col("n_i"), F.col("n_t")).alias("np_all"))


def lssr_top_matches(spark, sf_dir):
    df = C.summaries(*sides(spark, sf_dir, "cylinder"), top=Y.half)
    return df.select("t_fpid", "i_fpid", F.posexplode("top").alias("rank", "m")).select(
        "t_fpid", "i_fpid", "m.t_lsid", "m.i_lsid", "m.sl", (F.col("rank") + 1).alias("rank"))


def lssr_rho(spark, sf_dir):
    return C.lssr_rho(*sides(spark, sf_dir, "cylinder"))


def genuine_impostor_split(spark, sf_dir):
    own, other = E.split_scores(local_scores(spark, sf_dir), X.probe_lists(spark, sf_dir)[0])
    return own.withColumn("side", F.lit("genuine")).unionByName(other.withColumn("side", F.lit("impostor")))


def rank1_identification(spark, sf_dir):
    return E.rank1(local_scores(spark, sf_dir))


def tp_count(spark, sf_dir):
    return E.true_positives(local_scores(spark, sf_dir), "sfinge")


def detailed_results(spark, sf_dir):
    return E.detailed(local_scores(spark, sf_dir), "sfinge")


def _printed(minutiae):
    """Encoded lines of the fixture's fingerprints, one line each, minutiae in order."""
    order = [F.col(c) for c in X.ORDER]
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "a", "q")])
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return minutiae.groupBy("fpid").agg(listed.alias("m")).select(F.concat(
        "fpid", F.lit(":"), F.array_join(F.transform("m", lambda m: m["text"]), ";")).alias("value"))


def structures_round_trip(spark, sf_dir):
    """Vectors printed as lines and parsed back; lines that lost their last number are rejects."""
    lines = codec.print_vectors(J.flat_structures(enrol(X.template_minutiae(spark, sf_dir), X.ORDER, "jiang")))
    broken = F.regexp_extract("value", ";([0-9]+);", 1).cast("int") % 7 == 3
    given = lines.select(F.when(broken, F.regexp_replace("value", " [^ ]*$", "")).otherwise(F.col("value")).alias("value"))
    return codec.parse_vectors(given)[0].select(
        "fpid", "lsid", "x", "y", "th", *J.ANGLES, *[N.rounded(F.col(f"d{k}")).alias(f"d{k}") for k in J.K])


def minutiae_round_trip(spark, sf_dir):
    return codec.parse_minutia_lines(codec.print_minutiae(fixture_minutiae(spark, sf_dir)))[0]


def lookup_fingerprints(spark, sf_dir):
    """Structures of one finger per nation, from a stored table that is searched by id."""
    path = f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    store.write_lookup(enrol(X.template_minutiae(spark, sf_dir), X.ORDER, "jiang"), path)
    ids = X.table(spark, sf_dir, "nation").selectExpr("concat('Finger', lpad(cast(n_nationkey * 3 as string), 12, '0'), '_1') as fpid")
    return J.flat_structures(store.lookup(store.read_structures(spark, path), ids)).select("fpid", "n_ls", "lsid", "x", "y", "th")


def scores_round_trip(spark, sf_dir):
    """Scores written in every form of the sink and read back."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    store.write_scores(local_scores(spark, sf_dir), f"{path}/parquet")
    stored = spark.read.parquet(f"{path}/parquet")
    out = stored.withColumn("form", F.lit("parquet"))
    for form in ("mapreduce", "rdd"):
        store.write_scores(stored, f"{path}/{form}", form, ordered=form == "rdd")
        out = out.unionByName(parse_scores(spark.read.text(f"{path}/{form}"), form)[0].select(
            "t_fpid", "i_fpid", "score").withColumn("form", F.lit(form)))
    store.write_details(E.detailed(stored, "sfinge"), f"{path}/details")
    details = spark.read.csv(f"{path}/details", sep="\t", schema="i_fpid string, t_fpid string, score double, genuine boolean")
    return out.unionByName(details.select("t_fpid", "i_fpid", "score", F.lit("details").alias("form")))


def score_from_text(spark, sf_dir):
    """Text lines to fingerprints to local structures to scores."""
    t, i = (build_local_structures(parse_prints(_printed(m))[0], "jiang", role)
            for m, role in ((X.template_minutiae(spark, sf_dir), "template"), (X.probe_minutiae(spark, sf_dir), "input")))
    return identify(t, i, "jiang", "jiang_local")


def evaluate_from_text(spark, sf_dir):
    """Evaluation of scores and id lists that went through their text forms."""
    lines = local_scores(spark, sf_dir).select(F.concat(
        F.col("score").cast("string"), F.lit("\t"), "t_fpid", F.lit(".xyt;"), "i_fpid", F.lit(".xyt")).alias("value"))
    genuines = id_list(X.probe_lists(spark, sf_dir)[0].select(F.concat(F.lit("/data/"), "i_fpid", F.lit(".xyt")).alias("value")))
    return E.evaluate(parse_scores(lines, "mapreduce")[0], genuines.withColumnRenamed("fpid", "i_fpid"), "sfinge", far=0.2)


def far_threshold_min(spark, sf_dir):
    scores, genuines = local_scores(spark, sf_dir), X.probe_lists(spark, sf_dir)[0]
    return E.threshold_at_far(scores, genuines, far=0.2, agg="min")


def fnr_no_impostors(spark, sf_dir):
    scores, genuines = local_scores(spark, sf_dir), X.probe_lists(spark, sf_dir)[0]
    return E.evaluate(scores, genuines, "sfinge", far=None)


def far_threshold(spark, sf_dir):
    scores, genuines = local_scores(spark, sf_dir), X.probe_lists(spark, sf_dir)[0]
    return E.threshold_at_far(scores, genuines, far=0.2)


def score_positions(spark, sf_dir):
    return E.positions(local_scores(spark, sf_dir))


def fnr_at_far(spark, sf_dir):
    scores, genuines = local_scores(spark, sf_dir), X.probe_lists(spark, sf_dir)[0]
    return E.evaluate(scores, genuines, "sfinge", far=0.0)


# --- text and scalar functions, over every line item -------------------------

def _line_texts(spark, sf_dir, columns):
    return X.table(spark, sf_dir, "lineitem").selectExpr(*columns)


MINUTIAE_LINE = """concat('L', cast(l_orderkey as string), '_', cast(l_linenumber as string), ':',
  cast(l_suppkey as string), ' ', cast(l_partkey as string), ' ', cast(cast(l_quantity as int) * 3 as string), ' ',
  cast(cast(l_quantity as int) as string), ';',
  case when l_returnflag = 'R' then '7 8 9' when l_returnflag = 'A' and l_linestatus = 'F' then 'x 1 2 3'
       when l_linenumber = 6 then '1 2 1e30 4' when l_linenumber = 7 then '1 2 NaN 4'
       else concat(cast(l_linenumber as string), ' ', cast(l_suppkey as string), ' 45 60') end, ';;9 9 179 127')"""


def parse_minutiae_text(spark, sf_dir):
    return parse_minutiae(_line_texts(spark, sf_dir, [f"{MINUTIAE_LINE} as value"]))[0]


def parse_minutiae_rejects(spark, sf_dir):
    return parse_minutiae(_line_texts(spark, sf_dir, [f"{MINUTIAE_LINE} as value"]))[1]


def parse_scores_mr(spark, sf_dir):
    line = ("concat(cast(l_discount as string), chr(9), 'Finger', cast(l_partkey as string), '_1.xyt;Finger', "
            "cast(l_suppkey as string), '_2.xyt') as value")
    return parse_scores(_line_texts(spark, sf_dir, [line]), "mapreduce")[0]


def parse_scores_tuple(spark, sf_dir):
    line = ("concat('(cylinder;Finger', cast(l_partkey as string), '_1.xyt,(Finger', "
            "cast(l_suppkey as string), '_2.xyt,', cast(l_discount as string), '))') as value")
    return parse_scores(_line_texts(spark, sf_dir, [line]), "rdd")[0]


def probe_id_list(spark, sf_dir):
    line = "concat('/data/', l_returnflag, '/Finger', cast(l_partkey as string), '_2.xyt') as value"
    return id_list(_line_texts(spark, sf_dir, [line]))


# One path shape per database type, built from a part key.
PATHS = {
    "nist": ("concat('/nist/f', {k}, '.xyt')", "concat('/nist/s', {k}, '.xyt')"),
    "sfinge": ("concat('/db/Finger', {k}, '_1.xyt')", "concat('/db/Finger', {k}, '_2.xyt')"),
    "fvc": ("concat('/fvc/', {k}, '_1.xyt')", "concat('/fvc/1', {k}, '_2.xyt')"),
    "mcyt": ("concat('/m/dp_', {p}, '_3_11.xyt')", "concat('/m/pb_', {p}, '_', {s}, '_02.xyt')"),
    "casiav5": ("concat('/001/L/001_L', {s}, '_0.xyt')", "concat('/001/L/001_L0_3.xyt')"),
    "fingerpass": ("concat('/fp/FX3000_', {p}, '_01.xyt')", "concat('/fp/AES2501_', {p}, '_05.xyt')"),
    "spain": ("concat('/sp/0', {p}, 'ABCDRE001.xyt')", "concat('/sp/0', {p}, 'ABCEV1002.xyt')"),
    "differ": ("concat('/fvc/', {k}, '_1.xyt')", "concat('/nist/f', {k}, '.xyt')"),
}
KEYS = {"k": "cast(p_partkey as string)", "p": "lpad(cast(p_partkey % 10000 as string), 4, '0')",
        "s": "cast(p_size % 4 as string)"}


def _paths(spark, sf_dir):
    rows = ", ".join(f"struct('{name}' as shape, {a.format(**KEYS)} as f1, {b.format(**KEYS)} as f2)"
                     for name, (a, b) in PATHS.items())
    return X.table(spark, sf_dir, "part").selectExpr("p_partkey", f"inline(array({rows}))")


def genuine_rules(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "p_partkey", "shape", db_type(F.col("f1")).alias("type1"), db_type(F.col("f2")).alias("type2"),
        genuine(F.col("f1"), F.col("f2")).alias("genuine"), genuine(F.col("f2"), F.col("f1")).alias("reverse"))


def angle_functions(spark, sf_dir):
    """Encodings and differences of two directions per line item."""
    th = A.encode((F.col("l_quantity") * 7 + F.col("l_linenumber")) % 180)
    other = A.encode((F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 180)
    df = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                   th.alias("th"), other.alias("ot"))
    t, o = F.col("th"), F.col("ot")
    return df.select(
        "*", A.degrees(t).alias("degrees"), N.rounded(A.radians(t)).alias("radians"),
        A.complement(t).alias("complement"), A.complement_byte(t).alias("complement_byte"),
        N.rounded(A.complement_radians(t)).alias("complement_radians"),
        A.diff256(t, o).alias("diff256"),
        N.rounded(A.folded_diff(A.complement_radians(t), A.complement_radians(o))).alias("folded"),
        N.rounded(A.wrapped_diff(A.radians(t), A.radians(o))).alias("wrapped"))


def geometry_functions(spark, sf_dir):
    """Distances, cross product and sigmoid over integer points of each line item."""
    df = X.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey % 300 as cx", "l_partkey % 400 as cy",
        "l_linenumber * 10 as ax", "cast(l_quantity as int) as ay", "l_orderkey % 250 as bx", "l_linenumber * 40 as by")
    c = {n: F.col(n) for n in ("cx", "cy", "ax", "ay", "bx", "by")}
    d2 = N.square_distance(c["ax"], c["ay"], c["bx"], c["by"])
    return df.select(
        "l_orderkey", "l_partkey", "l_linenumber", d2.alias("d2"), N.rounded(F.sqrt(d2.cast("double"))).alias("d"),
        N.cross(c["ax"], c["ay"], c["bx"], c["by"], c["cx"], c["cy"]).alias("cross"),
        N.rounded(N.segment_distance(*[v.cast("double") for v in c.values()])).alias("segment"),
        N.rounded(N.sigmoid(F.sqrt(d2.cast("double")), 100.0, 0.05)).alias("sigmoid"))


def array_functions(spark, sf_dir):
    """Top-n and order functions over the numeric columns of each line item."""
    df = X.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber",
        "array(l_orderkey % 50, l_partkey % 50, l_suppkey % 50, cast(l_quantity as bigint), "
        "case when l_returnflag = 'R' then null else cast(l_linenumber as bigint) end) as raw")
    v = N.without_nulls(F.col("raw"))
    text = {"top3": N.top_n(v, 3), "top3_distinct": N.top_n_distinct(v, 3), "indexes": N.sort_indexes(v)}
    return df.select("l_orderkey", "l_partkey", "l_linenumber", N.array_sum(v).alias("total"),
                     N.min_position(v).alias("min_at"), N.max_position(v).alias("max_at"),
                     *[F.array_join(e.cast("array<string>"), ",").alias(n) for n, e in text.items()])


QUERIES = {f.__name__: f for f in (
    fixture_minutiae, fingerprint_counts, knn_neighbours, jiang_features, jiang_local_matches, jiang_seeds,
    jiang_box_join, convex_hull_edges, cylinder_cells, cylinder_features, cylinder_local_matches, np_pairs,
    lssr_top_matches, lssr_rho, genuine_impostor_split, rank1_identification, tp_count, detailed_results, far_threshold,
    far_threshold_min, fnr_at_far, score_positions, score_registered, structures_round_trip,
    minutiae_round_trip, lookup_fingerprints, scores_round_trip, score_from_text, evaluate_from_text, fnr_no_impostors, parse_minutiae_text, parse_minutiae_rejects, parse_scores_mr, parse_scores_tuple, probe_id_list,
    genuine_rules, angle_functions, geometry_functions, array_functions)}
QUERIES.update({f"score_{name}": score_query(name) for name in SCORES})
# The wider averages of the published method: 4 to 12 matches, by the smaller size.
WIDE = {"np_fn": lambda n: 4 + F.floor(8 * N.sigmoid(n, 20.0, 0.4) + 0.5), "np_max": 12}
QUERIES.update({f"score_{name}_wide": score_query(name, **WIDE) for name in ("lss", "nb")})
