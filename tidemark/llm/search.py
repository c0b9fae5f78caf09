"""Ranked lexical search: term at a time, rarest first, with limited accumulators.

Items are queries; documents are scored by a sum over the item's terms of a term's weight times how much the document is
about it (BM25 in integers: K1 of 0.8 and B of 0.75). One pass over the texts keeps each document's length and the counts
of terms that an item holds; term statistics are counts of these over all documents. Then each task takes postings of a
block of documents at a time and goes through an item's terms, rarest first. A document gets an accumulator when it
first has one of them, as long as one that comes new could still reach the item's threshold with the terms that remain,
by each term's largest possible share; from then on only documents that have an accumulator are updated, and exactly.

The threshold is global: a first round goes through each item's rarest terms, those that make up FIRST of all that a
document could score, over all documents; the kth largest partial score of an item is what its kth document reaches at
least. In the second round a task also knows the kth score among the documents that it is through with. An item's best of each task,
k at most, meet in one ranking. Items are taken in blocks of about BLOCK_TERMS terms, so what a task holds of them is
bounded, and no text is ever shuffled.

Defined results: a document without a term counts for nothing; an item without one has no rows; rows of documents are
documents each, so repeated rows get ranks of their own; a null doc_id comes after all others of its score; repeated rows
of items (equal id and text) are one item, and an item_id with several texts has a ranking for each. Other columns don't
matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import chunks, map_batches, row_key, settle, table, utf8

K = 10
#: Terms of the items of a block, documents and postings of a block that a task holds, and the share of an item's bound that the first round covers.
BLOCK_TERMS, BLOCK_DOCS, BLOCK_POSTINGS, FIRST = 200_000, 32_768, 4_000_000, 0.5
#: What separates terms in bytes becomes a blank, and A-Z lower case.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item (a key of id and text), item_id, term and times (its occurrences in the item)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(k, i, t) for k, i, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True) for t in terms(text)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["item", "item_id", "term"])

    once = items.select(row_key("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item"])
    return map_batches(once, f, "item long, item_id long, term binary").groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms) and, of those that numbers names, terms and counts (arrays) of each document that has a term."""

    def f(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
        for a, b in chunks(texts, 8 << 20):
            doc, n, which, times = [], [], [], []
            for i in range(a, b):
                found = terms(texts[i])
                if found:
                    own, many = np.unique(np.fromiter((x for x in map(numbers.get, found) if x is not None), np.int32), return_counts=True)
                    doc.append(ids[i])
                    n.append(len(found))
                    which.append(own)
                    times.append(many.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, which)]), pa.int32())
            whole = lambda x: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *x]), pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), whole(which), whole(times)], ["doc_id", "n", "terms", "counts"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, n long, terms array<int>, counts array<int>")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy()


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("terms").value_lengths().to_numpy()


def statistics(found: DataFrame, many: int) -> DataFrame:
    """term, df, most (its largest count in a document) and least (the fewest terms of a document with it), of many terms by number."""

    def run(batches):
        df, most, least = np.zeros(many, np.int64), np.zeros(many, np.int64), np.full(many, np.iinfo(np.int64).max)
        for batch in batches:
            which = _flat(batch, "terms")
            df += np.bincount(which, minlength=many)
            np.maximum.at(most, which, _flat(batch, "counts"))
            np.minimum.at(least, which, np.repeat(batch.column("n").to_numpy(), _lengths(batch)))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.array(most[at]), pa.array(least[at])], ["term", "df", "most", "least"])

    own = found.select("n", "terms", "counts").mapInArrow(run, "term int, df long, most long, least long")
    return own.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))


class Item:
    """An item's terms, rarest first: their numbers and weights (times occurrences), and what those from each on can give at most."""

    def __init__(self, key: int, item_id: int | None, rows: list[tuple[int, int, int]]):
        self.key, self.item_id = key, item_id
        self.terms, self.weights = [r[0] for r in rows], [r[1] for r in rows]
        self.bounds = [*np.cumsum([r[1] * r[2] for r in reversed(rows)])[::-1].tolist(), 0]
        self.first = next(j for j in range(len(rows) + 1) if self.bounds[j] <= (1 - FIRST) * self.bounds[0])


class Best:
    """The k best documents of an item so far: score, doc_id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """What a document must reach; 0 while there are fewer than k."""
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(scores) > self.k:
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, null = scores[some], ids[some], null[some]
        order = np.lexsort((ids, null, -scores))[: self.k]
        more = [(int(scores[i]), None if null[i] else int(ids[i])) for i in order]
        self.rows = sorted([*self.rows, *more], key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def _blocks(batches):
    """Batches joined to blocks of documents, by how many documents and postings they hold."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            docs, postings = docs + part.num_rows, postings + int(_lengths(part).sum())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield held
                held, docs, postings = [], 0, 0
    if held:
        yield held


def about(count, m):
    """How much a document is about a term that it holds count times, in millionths."""
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def length_mark(n, n_docs: int, all_terms: int):
    """A document's length against the mean, in hundredths, three quarters of it."""
    if int(np.max(n, initial=0)) * 75 * n_docs >= 1 << 63:
        return (25 + 75 * np.asarray(n, object) * n_docs // all_terms).astype(np.int64)
    return 25 + 75 * n * n_docs // all_terms


def scored(items: list[Item], n_docs: int, all_terms: int, k: int, thresholds: dict[int, int] | None):
    """The k best of a task's documents for each item, as rows (item, item_id, score, doc_id).

    Without thresholds: by each item's first terms only, scores as far as these go."""

    def run(batches):
        best = {item.key: Best(k) for item in items}
        for held in _blocks(batches):
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            which = np.concatenate([_flat(b, "terms") for b in held])
            count = np.concatenate([_flat(b, "counts") for b in held]).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), np.concatenate([_lengths(b) for b in held]))
            gain = about(count, length_mark(n, n_docs, all_terms)[owner])
            order = np.argsort(which, kind="stable")
            which, owner, gain = which[order], owner[order], gain[order]
            ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for item in items:
                mine = best[item.key]
                asked = max(mine.least(), thresholds.get(item.key, 0)) if thresholds is not None else 0
                ends = item.first if thresholds is None else len(item.terms)
                score, has = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                for j in range(ends):
                    a, b = np.searchsorted(which, [item.terms[j], item.terms[j] + 1])
                    docs, more = owner[a:b], gain[a:b] * item.weights[j]
                    if item.bounds[j] >= asked:
                        has[docs] = True
                        score[docs] += more
                    else:  # one that comes new can't reach the threshold any more
                        there = has[docs]
                        score[docs[there]] += more[there]
                at = np.flatnonzero(has & (score > 0) & (score >= asked))
                mine.add(score[at], ids[at], null[at])
        rows = [(item.key, item.item_id, *r) for item in items for r in best[item.key].rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["item", "item_id", "score", "doc_id"])

    return run


_FOUND = "item long, item_id long, score long, doc_id long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; Spark keeps no more of any task's before the shuffle."""
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The rankings of a block of items (rows of item_terms())."""
    numbers = {bytes(r.term): i for i, r in enumerate(wanted.select("term").distinct().orderBy("term").collect())}  # of a block: about BLOCK_TERMS
    found = settle(counted(docs, numbers))
    n_docs, all_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    known = {r.term: (r.df, r.weight, r.most, r.least) for r in statistics(found, len(numbers)).withColumn("weight", weight).collect()}
    items: dict[int, tuple[int | None, list]] = {}
    for r in wanted.collect():
        if (term := numbers[bytes(r.term)]) in known:
            df, own, most, least = known[term]
            limit = about(most, int(length_mark(np.int64(least), n_docs, all_terms)))
            items.setdefault(r.item, (r.item_id, []))[1].append((df, term, own * r.times, limit))
    made = [Item(key, item_id, [r[1:] for r in sorted(rows)]) for key, (item_id, rows) in sorted(items.items())]
    partial = found.mapInArrow(scored(made, n_docs, all_terms, k, None), _FOUND)
    thresholds = {r.item: r.score for r in _ranked(partial, k).filter(F.col("rank") == k).select("item", "score").collect()}
    return found.mapInArrow(scored(made, n_docs, all_terms, k, thresholds), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    wanted = settle(item_terms(items))
    blocks = -(-wanted.count() // block_terms)
    dealt = [wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [search_block(docs, part, k) for part in dealt]) if dealt else docs.sparkSession.createDataFrame([], _FOUND)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOLD = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH dt AS (SELECT r, doc_id, unnest({_FOLD.format("text")}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dn AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dn),
dm AS (SELECT r, 25 + ((75 * n * nd) // l) AS m FROM dn, s),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nd),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_FOLD.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
sc AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dm USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0) WHERE rank <= {K}
"""
