"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a text in which ``||`` at the start stands for the start of the host
or of one of its domains, ``*`` for anything and ``^`` for a separator or the
end; everything else is literal. Rules are judged on ``host + path``. Each rule
is filed under that one of its literal tokens which the fewest URLs contain;
the tokens of a URL fetch candidate rules, and only their regular expressions
run. All of it is one narrow pass after one small count. Rules without a literal
token run on every URL. A list of more than INLINE rules is a table instead,
joined with the tokens of the distinct URLs.

Null URLs and URLs without ``://`` have an empty host and path and are allowed.
Repeated rows, null ids and other columns do not matter: each row is judged alone.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE = 2_000            # rules that travel within the plan; more are a table
BROADCAST_BYTES = 64 << 20
RULE = "struct<size:int,text:string,action:string,named:boolean,regex:string>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    text: str
    action: str                # allow or block
    named: bool = False        # a named rule decides before patterns; the longest one wins

    @property
    def regex(self) -> str:
        body, start = (self.text[2:], r"^(?:[^/]*\.)?") if self.text.startswith("||") else (self.text, "")
        parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z%_.-]|$)"}
        return "(?s)" + start + "".join(parts.get(c, re.escape(c) if c.isascii() and not c.isalnum() else c)
                                        for c in body)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand as whole tokens in every URL that the rule matches."""
        found = []
        for m in re.finditer(r"[0-9a-z]+", self.text.lower()):
            before, after = self.text[:m.start()], self.text[m.end():]
            closed = before.endswith(tuple("|^./-_~")) and after[:1] in tuple("^./-_~")
            if closed and (not before.endswith("|") or before == "||"):
                found.append(m.group())
        return found


# Host and path rules, then patterns.
NAMED = [Rule("||com/", "allow", True), Rule("||example.com/en/", "block", True),
         Rule("||www.example.com/en/", "allow", True), Rule("||net/es/", "block", True),
         Rule("||net/fr/", "block", True)]
PATTERNS = [Rule("||m.*/de/*.html^", "block"), Rule("||blog.*.org/fr/", "block"), Rule("/login/", "block"),
            Rule("/cart/", "block"), Rule("/wp-admin/", "block"), Rule("/tag/*/feed/", "block"),
            Rule("||ads.", "block"), Rule("||doubleclick.net^", "block"), Rule("/print/*.html^", "block"),
            Rule("||docs.*/login/help/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower()),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _known_tokens(subject: Column, known: list[str]) -> Column:
    return F.array_intersect(F.split(F.lower(subject), "[^0-9a-z]+"), F.array(*map(F.lit, known)))


def _fields(rule: Rule) -> tuple:
    return len(rule.text), rule.text.removeprefix("||"), rule.action, rule.named, rule.regex


def _literals(rules: list[Rule]) -> Column:
    """The rules as a constant array."""
    names = ("size", "text", "action", "named", "regex")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, _fields(r))]) for r in rules]).cast(f"array<{RULE}>")


def _indexed(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``fit``: the rules that match the subject, from an index within the plan."""
    filed, free = [r for r in rules if r.tokens], [r for r in rules if not r.tokens]
    index: dict[str, list[Rule]] = {}
    if filed:
        known = sorted({t for r in filed for t in r.tokens})
        counted = (parts.select(F.explode(_known_tokens(F.col("subject"), known)).alias("token"))
                   .groupBy("token").count())
        seen = {r["token"]: r["count"] for r in counted.collect()}        # one row per rule token at most
        for rule in filed:
            index.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(rule)
    fetched = _literals(free)
    if index:
        lookup = F.create_map(*[c for t, found in index.items() for c in (F.lit(t), _literals(found))])
        by_token = F.flatten(F.transform(_known_tokens(F.col("subject"), sorted(index)), lambda t: F.element_at(lookup, t)))
        fetched = F.concat(by_token, fetched) if free else by_token
    return parts.withColumn("fit", F.filter(fetched, lambda c: F.rlike(F.col("subject"), c["regex"])))


def _joined(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``fit`` by a join of the distinct subjects' tokens with a table of the rules, each filed under its rarest token."""
    free = [r for r in rules if not r.tokens]
    rows = [(n, r.tokens, _fields(r)) for n, r in enumerate(rules) if r.tokens]
    table = parts.sparkSession.createDataFrame(rows, f"number int, tokens array<string>, rule {RULE}")
    small = sum(sum(map(len, r.tokens)) + 3 * len(r.regex) + 100 for r in rules) <= BROADCAST_BYTES

    def side(df):
        return F.broadcast(df) if small else df

    subjects = parts.select("subject").distinct()
    tokens = subjects.select("subject", F.explode(F.array_distinct(F.split(F.lower("subject"), "[^0-9a-z]+"))).alias("token"))
    own = table.select("number", F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(side(own.select("token").distinct()), "token").groupBy("token").count()
    rarest = own.join(seen, "token", "left").groupBy("number").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    filed = table.select("number", "rule").join(rarest, "number").select("token", "rule")
    fit = tokens.join(side(filed), "token").filter(F.rlike("subject", F.col("rule.regex"))).select("subject", "rule")
    by_subject = fit.groupBy(F.col("subject").alias("fitting")).agg(F.collect_list("rule").alias("found"))
    everywhere = F.filter(_literals(free), lambda c: F.rlike(F.col("subject"), c["regex"]))
    return parts.join(by_subject, F.col("subject") == F.col("fitting"), "left").select(
        *parts.columns, F.concat(F.coalesce("found", F.array().cast(f"array<{RULE}>")), everywhere).alias("fit"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id") -> DataFrame:
    """id, url's host and path, the deciding named rule, the matching patterns and the verdict."""
    host, path = split_url(F.col("url").cast("string"))
    parts = pages.select(id_column, host.alias("host"), path.alias("path")).withColumn(
        "subject", F.concat("host", "path"))
    fitting = (_indexed if len(rules) <= INLINE else _joined)(parts, rules)
    named = F.array_max(F.filter("fit", lambda c: c["named"]))
    patterns = F.filter("fit", lambda c: ~c["named"])
    decided = fitting.withColumns({"top": named, "patterns": patterns})
    allowed = F.exists("patterns", lambda c: c["action"] == "allow")
    return decided.select(
        id_column, "host", "path", F.col("top.text").alias("rule"),
        F.coalesce(F.col("top.action"), F.when((F.size("patterns") > 0) & ~allowed, "block").otherwise("allow"))
        .alias("verdict"),
        F.array_sort(F.transform("patterns", lambda c: c["text"])).alias("patterns"))


def oracle(rules: list[Rule]) -> str:
    """The same verdicts in DuckDB: every rule's expression on every URL, without an index."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    named = sorted((r for r in rules if r.named), key=lambda r: (-len(r.text), r.text))
    rule = " ".join(f"WHEN regexp_matches(s, {quoted(r.regex)}) THEN {quoted(r.text.removeprefix('||'))}" for r in named)
    action = " ".join(f"WHEN regexp_matches(s, {quoted(r.regex)}) THEN {quoted(r.action)}" for r in named)
    hit = {a: " OR ".join(f"regexp_matches(s, {quoted(r.regex)})" for r in rules if not r.named and r.action == a)
           or "false" for a in ("allow", "block")}
    patterns = ", ".join(f"CASE WHEN regexp_matches(s, {quoted(r.regex)}) THEN {quoted(r.text.removeprefix('||'))} END"
                         for r in rules if not r.named)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
subjects AS (SELECT *, concat(host, path) AS s FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {action} WHEN {hit['allow']} THEN 'allow' WHEN {hit['block']} THEN 'block' ELSE 'allow' END AS verdict,
       list_sort(list_filter([{patterns}], lambda x: x IS NOT NULL)) AS patterns
FROM subjects"""
