"""Mixing sources to target weights by thresholds on a hash.

Sources in the order of their code points, null last, weigh 3, 1, 2 and so on,
and share one and a half times all words. A target stops at twice the words of
its source; what is over goes to the others by weight, until none is above.

A source takes each document as often as its whole share says, and once more
those whose hash lies below a threshold. The threshold comes from sums of words
per source and hash bucket: the bucket where the budget ends is found from the
running sums, and only its rows are summed again by the next bits, until it holds
one row. Rows with one hash (repeated rows) go on by their number in the stored
table, so a group of any size can be split. Nothing is sorted; the row at the
boundary is taken if that brings the sum nearer to the target.

Null texts and texts without words have size 0 and give 0 words; null doc_ids are
ids like others; repeated rows are rows of their own, and as many of equal ones
are taken in every run; an empty table gives no rows. Only doc_id, text and source
are read, so other columns do not matter. Texts of any length are one pass of a
regular expression. Only DataFrame functions are used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.llm.common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5                     # of all words
MOST = 2                        # times its words that a source may give
BITS = 10                       # key bits per round
KEY_BITS = 60                   # of a hash and of a row number
MAX_SOURCES = 100_000           # rows that a broadcast may hold
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text: each becomes one letter, with the white space around it."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, "\x20\x09\x0A\x0B\x0C\x0D", "")), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """A number of 60 bits of the id and the text."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds the weight of each source by its place in order.

    Places are counted in ranges of sources, so no task orders all of them.
    """
    order = F.asc_nulls_last("source")
    ranges = cut(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select(      # a row per partition
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("before")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return ranges.join(F.broadcast(offsets), "range").select(
        "source", "source_size", F.get(weights, F.pmod(place, F.lit(len(WEIGHTS)))).alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of ``sizes(source, source_size)``.

    Open targets are one level times their weight. Each round sets the level
    from the sums of the capped and of the open sources; a cap never opens
    again, so the rounds end.
    """
    ranked = cut(ranked_sources(sizes))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        n, fixed, weight = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, MOST * F.col("source_size"))),
                                      F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (SHARE * total - (fixed or 0)) / weight, n
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.lit(float(MOST)) * F.col("source_size")).alias("target"))


def with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with what ``sources`` says of their source, null included; rows of other sources go.

    A table of bounded size is broadcast; a larger one is copied per salt, so
    that rows of a large source spread over tasks.
    """
    named = sources.withColumnRenamed("source", "_source_")
    same = F.col("source").eqNullSafe(F.col("_source_"))
    if few:
        return rows.join(F.broadcast(named), same).drop("_source_")
    copies = named.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_at_", F.pmod(F.xxhash64("hash", "row"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, same & (F.col("_at_") == F.col("_salt_"))).drop("_source_", "_salt_", "_at_")


def edges(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """The row of each source where its budget ends, by (hash, row): source, edge_hash, edge_row and extra.

    Rows before it are within the budget; ``extra`` says whether it is taken too.
    Each round sums the rows left by the next bits of hash, then of row number,
    and keeps the bucket of each source that holds the end.
    """
    left, inside = budgets, rows.filter("size > 0")
    for key in ("hash", "row"):
        for shift in range(KEY_BITS - BITS, -1, -BITS):
            bucket = F.shiftright(F.col(key), shift)
            bucket = bucket if key == "row" and shift == KEY_BITS - BITS else bucket.bitwiseAND(F.lit((1 << BITS) - 1))
            sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
            after = sums.withColumn("after", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
            named = left.withColumnRenamed("source", "_source_")
            met = after.join(named, F.col("source").eqNullSafe(F.col("_source_")))
            end = cut(met.filter((F.col("after") > F.col("budget")) & (F.col("after") - F.col("n") <= F.col("budget"))).select(
                "source", (F.col("budget") - F.col("after") + F.col("n")).alias("budget"), F.col("bucket").alias("_bucket_"), "rows"))
            inside = cut(with_sources(inside, end.select("source", "_bucket_"), few).filter(bucket == F.col("_bucket_")).drop("_bucket_"))
            left = end.select("source", "budget")
            if (end.agg(F.max("rows")).first()[0] or 0) <= 1:
                return with_sources(inside, left, few).select(
                    "source", F.col("hash").alias("edge_hash"), F.col("row").alias("edge_row"),
                    (2 * F.col("budget") > F.col("size")).alias("extra"))
    raise AssertionError("row numbers are distinct")


def mix(docs: DataFrame, max_sources: int = MAX_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    text = F.col("text").cast("string")
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
                           hashed(F.col("doc_id"), text).alias("hash"), F.monotonically_increasing_id().alias("row")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    few = sources.count() <= max_sources
    times = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    shares = sources.withColumn("times", times)
    budgets = shares.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))
    ends = edges(rows, budgets, few).withColumnRenamed("source", "_end_")
    shares = shares.join(ends, F.col("source").eqNullSafe(F.col("_end_")), "left").drop("_end_")
    before = (F.col("hash") < F.col("edge_hash")) | ((F.col("hash") == F.col("edge_hash")) & (
        (F.col("row") < F.col("edge_row")) | ((F.col("row") == F.col("edge_row")) & F.col("extra"))))
    once_more = F.when(before, F.col("size")).otherwise(0)
    return with_sources(rows, shares, few).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + once_more).alias("taken"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL of the mix: the level from the sources in the order of their caps, the rest from running sums by hash."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, {KEY_BITS // 4}))::bigint as hash
  from {documents}),
sources as (
  select source, sum(size)::bigint as source_size,
         ([{weights}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as weight
  from sized group by source),
capped as (
  select *, {MOST} * source_size / weight as cap,
         coalesce(sum({MOST} * source_size) over before, 0)::bigint as fixed,
         (sum(weight) over () - coalesce(sum(weight) over before, 0))::bigint as open, (sum(source_size) over ())::bigint as total
  from sources
  window before as (order by {MOST} * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select max(({SHARE}::double * total - fixed) / open) filter (({SHARE}::double * total - fixed) / open <= cap) as level from capped),
aims as (
  select source, source_size, least(weight * level, {float(MOST)}::double * source_size)::double as target from capped, level),
shares as (
  select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as times from aims),
placed as (
  select d.*, s.source_size, s.target, s.times, s.target - s.times * s.source_size as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.hash rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized d join shares s on d.source is not distinct from s.source)
select doc_id, size, source_size, target,
       (times * size + case when before + size <= budget or (before <= budget and 2 * (budget - before) > size) then size else 0 end)::bigint as taken
from placed"""
