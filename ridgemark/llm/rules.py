"""Quality rules: base counts of a text and robust multivariate outliers.

Per language and source a minimum-covariance-determinant estimate of location
and scatter is reached by concentration steps from several starts: the three
quarters of documents nearest to the centre give the next mean and covariance,
until they are stable, and the start that ends with the least determinant
counts. A document is rejected if its transformed statistics lie beyond a
chi-square bound of the Mahalanobis distance. A deviation below its floor is
replaced by the floor, so that a group of equal or few documents has a defined
result: it keeps them.

Statistics are whole steps of 1 / SCALE. So equal vectors are counted together
once, all sums are exact, quantiles are read from sorted counts, and the result
does not depend on partitions. Distances are counted in whole steps of their
logarithm; those equal at the quantile are all taken, so ties have one result.

Null texts have no words and fail the base rule. Null languages and sources are
groups of their own. Only DataFrame functions are used: the counts are one
narrow pass over the texts, everything later reads one small row per document.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8                      # words
MIN_WORDS, MAX_REPEATED = 20, 30
# Transformed statistics and the smallest standard deviation that each may have. BOUND is 4.85 deviations, so
# alone and at their floor these reject mean words of twice the usual length, symbols beyond 6 in 100 words,
# and repeated lines or words beyond 10 in 100 words; a larger spread of the group moves the limit up.
FEATURES = {"word_length": 0.15, "symbols": 0.4, "dup_lines": 0.5, "repeats": 0.5}
SCALE = 1024                    # sums of products are whole numbers and fit a long for 10**10 documents of a group
FINE = 1 << 14                  # steps of the binary logarithm of 1 + distance
SUBSET = 0.75
DRAWS = 2                       # starts from a drawn eighth of the distinct vectors
MAX_STEPS = 30                  # a start still moving after these counts with its last estimate


def _chi4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _chi6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def _quantile4(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if _chi4((low + high) / 2) < p else (low, (low + high) / 2)
    return low


BOUND = _quantile4(0.9999)
CONSISTENCY = SUBSET / _chi6(_quantile4(SUBSET))


def repeated_words(placed: str) -> Column:
    """Words covered by repeated windows, given a column of (hash, place) in the order of hashes."""
    def same(k, other):
        return F.coalesce(F.get(placed, k)["h"] == F.get(placed, other)["h"], F.lit(False))

    twins = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = F.sort_array(F.transform(twins, lambda k: F.get(placed, k)["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda acc, i: F.struct(
        i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text.

    The counts are cut off from their plan: a filter pushed below it would copy
    the repeated-window expressions into every use of them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    trimmed = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    split = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id", "lang", "source",
        F.length(F.regexp_replace("text", SPACE, "")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        lines.alias("lines"), F.split(trimmed, SPACE).alias("words"), (trimmed == "").alias("blank"))
    counted = split.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "words",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("blank"), 0).otherwise(F.size("words")).alias("n_words"))
    hashed = counted.withColumn("windows", F.when(F.col("n_words") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))).drop("words")
    kept = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    unique = F.size(F.array_distinct("windows")) == F.size("windows")
    placed = hashed.select(*kept, F.when(~unique, F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"))
    repeated = F.when(F.col("placed").isNull(), 0).otherwise(repeated_words("placed"))
    return cut(placed.select(*kept[:3], *[F.col(c).cast("long").alias(c) for c in kept[3:]],
                             repeated.cast("long").alias("n_repeat_words")))


def features(counts: DataFrame) -> DataFrame:
    """Adds the base verdict and the transformed statistics, in whole steps of 1 / SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def stepped(c):
        return F.round(c * SCALE) / SCALE

    def share(c):
        return stepped(F.log1p(100 * F.col(c) / n))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counts.withColumns({
        "base_failed": failed, "word_length": stepped(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
        "symbols": share("n_symbols"), "dup_lines": share("n_dup_lines"), "repeats": share("n_repeat_words")})


KEYS = ["lang", "source"]
SIZE = len(FEATURES)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
SUMS = ["n", *[f"s_{i}" for i in range(SIZE)], *[f"p_{i}_{j}" for i, j in PAIRS]]
ESTIMATE = [*[f"m_{i}" for i in range(SIZE)], *[f"l_{i}_{j}" for i, j in PAIRS], "size"]


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the columns of their language and source, null included."""
    named = groups.withColumnsRenamed({k: f"g_{k}" for k in KEYS})
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(named, same, "left").drop("g_lang", "g_source")


def _factor(cov) -> dict[str, Column]:
    """Cholesky factor of a covariance given as expressions, no deviation below its floor, and its log determinant."""
    floors = list(FEATURES.values())
    low: dict[tuple[int, int], Column] = {}
    for i, j in PAIRS:
        rest = cov(i, j)
        for k in range(j):
            rest = rest - low[i, k] * low[j, k]
        low[i, j] = F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2))) if i == j else rest / low[j, j]
    size = sum((F.log(low[i, i]) for i in range(1, SIZE)), F.log(low[0, 0]))
    return {**{f"l_{i}_{j}": c for (i, j), c in low.items()}, "size": size}


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the columns of an estimate."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * solved[k]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def points(rows: DataFrame) -> DataFrame:
    """Distinct vectors of each language and source in whole steps, with their number of documents."""
    steps = [F.round(F.col(c) * SCALE).cast("long").alias(f"x_{i}") for i, c in enumerate(FEATURES)]
    return rows.select(*KEYS, *steps).groupBy(*KEYS, *[f"x_{i}" for i in range(SIZE)]).agg(F.count("*").alias("w"))


def _sums(found: DataFrame, *keys: str) -> DataFrame:
    """Number of documents and exact sums of their statistics and products."""
    x = [F.col(f"x_{i}") for i in range(SIZE)]
    columns = [F.col("w"), *[F.col("w") * c for c in x], *[F.col("w") * x[i] * x[j] for i, j in PAIRS]]
    return found.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in zip(SUMS, columns)])


def _estimated(sums: DataFrame, consistency: Column) -> DataFrame:
    """Mean and factor of the covariance from sums."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s_{i}") / n for i in range(SIZE)]
    covered = sums.select(*KEYS, "start", *[(m / SCALE).alias(f"m_{i}") for i, m in enumerate(mean)], *[
        (consistency * (F.col(f"p_{i}_{j}") / n - mean[i] * mean[j]) / SCALE ** 2).alias(f"c_{i}_{j}") for i, j in PAIRS])
    return _with_factor(covered, lambda i, j: F.col(f"c_{i}_{j}"))


def _with_factor(covered: DataFrame, cov) -> DataFrame:
    return covered.select(*KEYS, "start", *[f"m_{i}" for i in range(SIZE)], *[
        c.alias(name) for name, c in _factor(cov).items()])


def _medians(values: DataFrame) -> DataFrame:
    """Median of x per language, source and statistic i, from sorted counts: a group has as many rows as values."""
    order = Window.partitionBy(*KEYS, "i").orderBy("x")
    counts = values.groupBy(*KEYS, "i", "x").agg(F.sum("w").alias("w")).select(
        *KEYS, "i", "x", F.sum("w").over(order).alias("upto"), F.sum("w").over(Window.partitionBy(*KEYS, "i")).alias("all"))
    return counts.filter("2 * upto >= all").groupBy(*KEYS, "i").agg(F.min("x").alias("middle"))


def starts(found: DataFrame) -> DataFrame:
    """First estimates: medians with their absolute deviations (0), all documents (1), drawn parts (2 and up)."""
    each = found.select(*KEYS, "w", F.posexplode(F.array(*[f"x_{i}" for i in range(SIZE)])).alias("i", "x"))
    middle = _medians(each)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*KEYS, "i")]
    away = each.alias("l").join(middle.alias("r"), same).select(
        *[f"l.{k}" for k in KEYS], "l.i", "w", F.abs(F.col("x") - F.col("middle")).alias("x"))
    both = middle.withColumn("kind", F.lit("m")).unionByName(_medians(away).withColumn("kind", F.lit("c")))
    robust = both.groupBy(*KEYS).agg(F.lit(0).alias("start"), *[
        F.max(F.when((F.col("i") == i) & (F.col("kind") == k), F.col("middle") / SCALE)).alias(f"{k}_{i}")
        for k in "mc" for i in range(SIZE)])
    first = _with_factor(robust, lambda i, j: F.pow(1.4826 * F.col(f"c_{i}"), 2) if i == j else F.lit(0.0))
    part = F.pmod(F.xxhash64(*[f"x_{i}" for i in range(SIZE)]), F.lit(8))
    chosen = F.array(F.lit(1), *[F.when(part == k, k + 2) for k in range(DRAWS)])
    others = _sums(found.withColumn("start", F.explode(F.array_compact(chosen))), *KEYS, "start")
    return first.unionByName(_estimated(others, F.lit(1.0)))


def concentrated(found: DataFrame, now: DataFrame) -> DataFrame:
    """The next estimates: the documents nearest to each, as many as SUBSET and those as near as the last of them."""
    x = [(F.col(f"x_{i}") / SCALE).alias(c) for i, c in enumerate(FEATURES)]
    near = _joined(found.select("*", *x), now).withColumn(
        "q", F.floor(F.log2(1 + distance(list(FEATURES))) * FINE))
    by_step = _sums(near, *KEYS, "start", "q")           # a group has at most FINE rows per doubling of the distance
    group = Window.partitionBy(*KEYS, "start")
    inside = by_step.withColumns({"upto": F.sum("n").over(group.orderBy("q")), "all": F.sum("n").over(group)}).filter(
        F.col("upto") - F.col("n") < SUBSET * F.col("all"))
    total = inside.groupBy(*KEYS, "start").agg(*[F.sum(c).alias(c) for c in SUMS])
    return _estimated(total, F.lit(CONSISTENCY))


def settled(found: DataFrame, now: DataFrame) -> DataFrame:
    """Estimates concentrated until none of them moves."""
    for _ in range(MAX_STEPS):
        after = cut(concentrated(found, now))
        moved = after.exceptAll(now)
        now = after
        if moved.isEmpty():
            break
    return now


def estimates(rows: DataFrame) -> DataFrame:
    """Location and scatter factor per language and source: of the starts, the stable one of least determinant."""
    found = cut(points(rows))
    now = settled(found, cut(starts(found)))
    best = F.min_by(F.struct(*ESTIMATE), F.struct("size", "start")).alias("e")
    return now.groupBy(*KEYS).agg(best).select(*KEYS, *[F.col(f"e.{c}").alias(c) for c in ESTIMATE])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict, distance and final verdict of every document."""
    rows = features(base_counts(docs))
    known = estimates(rows.filter("not base_failed"))
    judged = _joined(rows, known).withColumn("distance", F.when(~F.col("base_failed"), distance(list(FEATURES))))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "distance",
                         (~F.col("base_failed") & (F.col("distance") <= BOUND)).alias("kept"))
