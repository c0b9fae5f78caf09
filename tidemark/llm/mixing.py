"""Mixing sources to target weights by Poisson replication.

A source that holds n of N documents and is to make up the share w of the mix is to be repeated w N / n times on
average. Each document's number of copies is a Poisson variate with that mean, made by inverting the distribution at a
uniform number that a hash of the document's id and a seed gives, so it is the same in every run and on every cluster.
Copies are exploded and spread over the cluster by a hash of id, copy and seed. A mean above LARGEST_MEAN is split into
equal parts whose variates are added, which has the same distribution and never underflows.

Defined results: null is a source of its own; documents with equal ids (null included) get equal numbers; a source
without a weight is dropped by an explicit weight table and weighted by default otherwise; an empty table gives no
rows; other columns stay whatever their names are, but for columns named as the ones that are added, which these replace.
No source is sampled or capped: the counts are over all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table

#: Share of a source in proportion to its number of documents to this power.
TEMPERATURE = 0.5
SEED = "mix-1"
LARGEST_MEAN = 16.0
#: Counts past this have a probability under 1e-20 at the largest mean; the last entry of the table is taken as 1.
LONGEST_TABLE = 80
#: So many sources (about 1 KB each with their tables) go to every executor; more are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", temperature: float = TEMPERATURE) -> tuple[DataFrame, int]:
    """A row for each source: mix_source, n_docs, rate (mean copies of a document), parts and the Poisson table of a part; and their number."""
    counted = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        counted = counted.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "given_source string, weight double")
        counted = counted.join(F.broadcast(given), F.col("mix_source").eqNullSafe(F.col("given_source"))).drop("given_source")
    weight, n_docs, n_sources = counted.agg(F.sum("weight"), F.sum("n_docs"), F.count(F.lit(1))).first()
    rated = counted.withColumn("rate", F.col("weight") / F.lit(weight or 1.0) * F.lit(n_docs or 1) / F.col("n_docs"))
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    # p(k) = p(k - 1) * mean / k, summed as it goes
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"), (acc["below"] + acc["p"] * F.col("mean") / k).alias("below"), F.concat(acc["cdf"], F.array(acc["below"] + acc["p"] * F.col("mean") / k)).alias("cdf")
    )
    first = F.exp(-F.col("mean"))
    start = F.struct(first.alias("p"), first.alias("below"), F.array(first).alias("cdf"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST_TABLE)), start, step)
    return rated.select("mix_source", "n_docs", "rate", "parts", made["cdf"].alias("cdf")), n_sources


def copies(key: Column, seed: str, parts: str = "parts", cdf: str = "cdf") -> Column:
    """The Poisson variate of a row that has parts and cdf."""
    one = lambda i: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), key, i)))
    return F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, i: acc + one(i))


ADDED = ("mix_copies", "mix_copy", "mix_key")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", seed: str = SEED, temperature: float = TEMPERATURE, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """docs replicated to the target weights and spread over the cluster, with mix_copy (from 1), mix_copies and mix_key (the place in the shuffle)."""
    docs = docs.drop(*ADDED)
    rated, n_sources = rates(docs, weights, source, temperature)
    origin, parts, cdf, salt, its_salt = (fresh(docs.columns, c) for c in ("mix_source", "mix_parts", "mix_cdf", "mix_salt", "mix_salt_of_source"))
    rated = rated.select(F.col("mix_source").alias(origin), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    same = F.col(source).eqNullSafe(F.col(origin))
    if n_sources <= broadcast_sources:
        joined = docs.join(F.broadcast(rated), same)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        spread = rated.withColumn(its_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, same & (F.col(salt) == F.col(its_salt))).drop(salt, its_salt)
    counted = joined.withColumn("mix_copies", copies(F.col(key), seed, parts, cdf)).filter("mix_copies > 0").drop(origin, parts, cdf)
    out = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    out = out.withColumn("mix_key", F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("mix_copy"))), 1, 16))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the square root of their sources' sizes."""
    return mix(table(spark, sf_dir, "documents"))


_U = "('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(i AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"
SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_docs, pow(CAST(count(*) AS DOUBLE), {TEMPERATURE}) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(weight) AS all_weight, sum(n_docs) AS all_docs FROM n),
r AS (SELECT source, weight / all_weight * all_docs / n_docs AS rate FROM n, t),
q AS (SELECT source, greatest(CAST(ceil(rate / {LARGEST_MEAN}) AS INTEGER), 1) AS parts, rate / greatest(CAST(ceil(rate / {LARGEST_MEAN}) AS INTEGER), 1) AS mean FROM r),
c(source, k, mean, p, cdf) AS (
  SELECT source, 0, mean, exp(-mean), exp(-mean) FROM q
  UNION ALL SELECT source, k + 1, mean, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < {LONGEST_TABLE}),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT documents.*, parts, cdf FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source JOIN cdfs ON documents.source IS NOT DISTINCT FROM cdfs.source),
m AS (SELECT doc_id, text, lang, source, n_chars,
             CAST(list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x <= {_U.format(seed=SEED)})))) AS INTEGER) AS mix_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, mix_copies, CAST(mix_copy AS INTEGER) AS mix_copy,
       substr(md5('{SEED}-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(mix_copy AS VARCHAR)), 1, 16) AS mix_key
FROM (SELECT *, unnest(range(1, mix_copies + 1)) AS mix_copy FROM m WHERE mix_copies > 0)
"""
