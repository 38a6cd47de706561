"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (role and text equal, null equal to null)
is rendered once as the prompt; what follows on either side is a completion,
rendered turn by turn with a mask: 1 for the content of assistant turns and
their end mark, 0 for headers and other roles. Everything is an expression
over one row per pair, so formatting neither shuffles nor runs Python.

A null conversation is an empty one. A null role or text renders as empty. Equal
conversations have the whole conversation as the prompt and empty completions.
Turns of a null conversation id belong to no conversation and are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation: its turns in order; equal turn numbers go by role, then text."""
    turn = F.struct("turn", *[F.col(c).cast("string").alias(c) for c in ("role", "text")])
    return (turns.filter(F.col(id_column).isNotNull()).groupBy(id_column)
            .agg(F.sort_array(F.collect_list(turn)).alias("all"))
            .select(id_column, F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    both = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda t: F.coalesce(t["a"].eqNullSafe(t["b"]), F.lit(False)))
    short = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.slice(both, 1, short), F.lit(False))
    return F.when(differs > 0, (differs - 1).cast("int")).otherwise(short)


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(MID))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def masked(turns: Column) -> Column:
    """Pieces of a completion with their mask; joined, the pieces are the rendered text."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(0).alias("mask")),
        F.struct(_body(t).alias("text"), (F.coalesce(t["role"], F.lit("")) == "assistant").cast("int").alias("mask")))))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds prompt_turns, prompt and the masked completions to rows with chosen and rejected."""
    rows = pairs.withColumns({c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)) for c in ("chosen", "rejected")})
    rows = rows.withColumn("prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))

    def rest(c):
        return F.slice(F.col(c), F.col("prompt_turns") + 1, F.size(c))

    return rows.withColumns({
        "prompt": render(F.slice("chosen", 1, F.col("prompt_turns"))),
        "chosen_completion": masked(rest("chosen")), "rejected_completion": masked(rest("rejected"))})


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs derived from a table of conversations.

    Conversations 2k (chosen) and 2k+1 (rejected) form the pair ``neighbour`` of
    number k. The pair ``swapped`` sets the chosen one against itself with its
    last assistant turn replaced by the last assistant turn of the other, a
    response to something else; it needs an assistant turn on both sides.
    """
    known = conversations(turns)
    number = F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")
    sides = known.groupBy(number).agg(
        *[F.max(F.when(F.pmod("conv_id", F.lit(2)) == k, F.col("turns"))).alias(c) for k, c in enumerate(("chosen", "rejected"))]
    ).filter("chosen is not null and rejected is not null")

    def last(c):
        replies = F.filter(F.transform(c, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
        return F.array_max(replies)

    at, other = last("chosen"), last("rejected")
    swapped = F.when(at.isNotNull() & other.isNotNull(), F.concat(
        F.slice("chosen", 1, at), F.slice("rejected", other + 1, 1)))
    both = F.array(F.struct(F.lit("neighbour").alias("kind"), F.col("rejected")),
                   F.struct(F.lit("swapped").alias("kind"), swapped.alias("rejected")))
    return (sides.select("pair_id", "chosen", F.explode(both).alias("p"))
            .select("pair_id", "p.kind", "chosen", "p.rejected").filter("rejected is not null"))


def digest(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt length and digests of the rendered texts and masks."""
    formatted = format_preferences(preference_pairs(turns))

    def text(c):
        return F.array_join(F.transform(c, lambda p: p["text"]), "")

    def mask(c):
        return F.array_join(F.transform(c, lambda p: F.concat(F.length(p["text"]).cast("string"), F.lit(":"), p["mask"].cast("string"))), ",")

    return formatted.select(
        "pair_id", "kind", F.col("prompt_turns").cast("long").alias("prompt_turns"),
        F.length("prompt").cast("long").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2(text("chosen_completion"), 256).alias("chosen_sha256"), mask("chosen_completion").alias("chosen_mask"),
        F.sha2(text("rejected_completion"), 256).alias("rejected_sha256"), mask("rejected_completion").alias("rejected_mask"))


ORACLE = """
WITH convs AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sides AS (
  SELECT a.conv_id // 2 AS pair_id, a.turns AS chosen, b.turns AS other
  FROM convs a JOIN convs b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
lasts AS (
  SELECT *, list_max(list_filter(range(1, len(chosen) + 1), lambda i: coalesce(chosen[i].role, '') = 'assistant')) AS k,
         list_max(list_filter(range(1, len(other) + 1), lambda i: coalesce(other[i].role, '') = 'assistant')) AS o
  FROM sides),
pairs AS (
  SELECT pair_id, 'neighbour' AS kind, chosen, other AS rejected FROM lasts
  UNION ALL
  SELECT pair_id, 'swapped', chosen, list_concat(chosen[1:k - 1], other[o:o]) FROM lasts WHERE k IS NOT NULL AND o IS NOT NULL),
cuts AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i:
      chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text)) - 1,
      least(len(chosen), len(rejected))) AS n FROM pairs),
parts AS (
  SELECT pair_id, kind, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM cuts),
texts AS (
  SELECT pair_id, kind, n, {0} AS prompt, {1} AS ct, {2} AS rt, {3} AS cm, {4} AS rm FROM parts)
SELECT pair_id, kind, n::BIGINT AS prompt_turns, length(prompt) AS prompt_chars, sha256(prompt) AS prompt_sha256,
       sha256(ct) AS chosen_sha256, cm AS chosen_mask, sha256(rt) AS rejected_sha256, rm AS rejected_mask FROM texts"""


def oracle() -> str:
    head = f"'{HEAD}' || coalesce(t.role, '') || chr(10)"
    body = "coalesce(t.text, '') || '<|im_end|>' || chr(10)"

    def text(c):
        return f"coalesce(array_to_string(list_transform({c}, lambda t: {head} || {body}), ''), '')"

    def mask(c):
        return (f"coalesce(array_to_string(list_transform({c}, lambda t: length({head})::VARCHAR || ':0,' || length({body})::VARCHAR "
                f"|| CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), ','), '')")

    return ORACLE.format(text("p"), text("c"), text("r"), mask("c"), mask("r"))
