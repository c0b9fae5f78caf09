"""URL filtering by rules on hosts and path prefixes.

Each URL is expanded into expressions: every suffix of its host of as many labels as some rule's host has, with every
prefix of its path whose length some rule has. Expressions meet rules by an equi-join on a short hash prefix, the full
digest then confirms the meeting, and the longest rule that fits decides (of equal length the one with the longer host).

Defined results: a null url, or one without "://", has an empty host and path; an empty host fits no rule; rows that no
rule fits get the default verdict; repeated pages are judged each on its own; rules with a null host or path are no
rules; of equal rules with several verdicts block wins; columns named host, path, rule or verdict are replaced, and all
others stay whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table

#: Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Rules up to this many go to every executor (about 200 bytes each); more are joined by shuffling distinct expressions.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without it."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text)))


def _before(text: Column, marks: str) -> Column:
    """What comes before the first of the marks, all of text without any."""
    return F.regexp_extract(text, f"(?s)^([^{marks}]*)", 1)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(_before(_after(url, "://"), "/?#"), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(_after(url, "://"), "(?s)^[^/?#]*", "")
    return F.coalesce(_before(rest, "?#"), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    """The digest's first 32 bits."""
    return F.substring(digest, 1, 8)


def rules_of(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """A few rules (host, path, verdict) as literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules])))


def _rules_by_digest(rules: DataFrame) -> DataFrame:
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
    known = known.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max(F.col("verdict")).alias("rule_verdict"))
    digest = _digest(_expression(F.col("rule_host"), F.col("rule_path")))
    return known.select(_short(digest).alias("short"), digest.alias("rule_digest"), "rule_host", "rule_path", "rule_verdict")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """df with host, path, rule (host and path of the rule that decides, else null) and verdict.

    rules: host, path, verdict. Their numbers of labels and lengths of paths are collected: at most as many as the longest
    host has labels and the longest path letters."""
    rules = _rules_by_digest(rules)
    shapes = rules.agg(F.sort_array(F.collect_set(_labels(F.col("rule_host")))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    found = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes.labels:
        return found.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.split("host", r"\.")
    up_to = lambda sizes, most: F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= most)
    suffixes = F.transform(up_to(shapes.labels, F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(up_to(shapes.lengths, F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    ways = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _expression(s, p))))
    # a join condition would take the place of the short prefix as its key, so the digest confirms in a projection after it
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.struct("rule_host", "rule_path", "rule_verdict")).alias("hit")

    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    # Hosts and paths repeat, so each pair is expanded once; combining before the shuffle keeps hot hosts out of it.
    places = found.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(ways).alias("way")).withColumn("digest", _digest(F.col("way"))).withColumn("short_url", _short(F.col("digest")))
    on_short = F.col("short_url") == F.col("short")
    if few:
        met = met.join(F.broadcast(rules), on_short).select("host", "path", hit)
    else:
        known = met.select("short_url", "digest").distinct().join(rules, on_short).select(F.col("digest").alias("known_digest"), hit)
        met = met.join(known.groupBy("known_digest").agg(F.max("hit").alias("hit")), F.col("digest") == F.col("known_digest")).select("host", "path", "hit")
    order = F.struct(F.length("hit.rule_host") + F.length("hit.rule_path"), F.length("hit.rule_host"))
    at_host, at_path, best = (fresh(found.columns, c) for c in ("at_host", "at_path", "best_rule"))
    decided = met.groupBy(F.col("host").alias(at_host), F.col("path").alias(at_path)).agg(F.max_by("hit", F.when(F.col("hit").isNotNull(), order)).alias(best))
    joined = found.join(decided, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left")
    return joined.withColumns({"rule": F.concat(f"{best}.rule_host", f"{best}.rule_path"), "verdict": F.coalesce(f"{best}.rule_verdict", F.lit(default))}).drop(at_host, at_path, best)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the contract's five rules."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_of(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


_HOST = f"coalesce(translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) END, '{UPPER}', '{LOWER}'), '')"
_PATH = "coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '')"
_VALUES = ", ".join(str(r) for r in RULES)
SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_VALUES}),
p AS (SELECT row_number() OVER () AS n, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
m AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rn
      FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
