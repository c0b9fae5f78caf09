"""Dropping lines that many documents share.

A line's key is the line stripped of white space with A-Z in lower case; keys of MIN_CHARS code points or more count.
Occurrences (128-bit hash of the key, document, position) are range-partitioned by all of these, so a key that a third
of the documents share is spread over many partitions, and sorted by hash, then document from the largest, then
position. One pass streams each partition: a key's first document keeps its lines, the second's wait, and from a third
document on all but the first lose theirs, with one document's positions in memory at most. Only a partition's first
and last key may go on in a neighbour; their rows are passed on undecided, their documents are counted by a combining
aggregation, and the decision comes back by a join with at most two keys for each partition. The result is a compressed
keep bitmap for each document that loses lines; the text itself is never shuffled for the decision.

Defined results: null and empty texts are one empty line; rows that repeat (equal id and text) are one document and get
equal bitmaps; a null id is a document smaller than all others, and all rows with a null id are one document. Other
columns stay whatever their names are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_batches, row_key, settle, table, utf8, with_key

MIN_CHARS, MIN_DOCS = 20, 3
SMALLEST = -(1 << 63)


def long_enough(key: bytes, least: int) -> bool:
    """Whether key has that many code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or n - sum(b & 0xC0 == 0x80 for b in key) >= least)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line that counts; doc is the id, or the smallest number for null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        high, low, doc, key, pos, many = [], [], [], [], [], []
        for d, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), utf8(batch.column("text")), strict=True):
            lines = text.lower().split(b"\n")  # of bytes, so A-Z only
            for i, line in enumerate(lines):
                line = line.strip()
                if long_enough(line, min_chars):
                    h = xxhash.xxh3_128_intdigest(line)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    doc.append(SMALLEST if d is None else d)
                    key.append(k)
                    pos.append(i)
                    many.append(len(lines))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((high, low, doc, key, pos, many), kinds, strict=True)], ["high", "low", "doc", "row_key", "pos", "n_lines"])

    return map_batches(docs.select("doc_id", "row_key", "text"), run, "high long, low long, doc long, row_key long, pos int, n_lines int")


NAMES = ["high", "low", "doc", "row_key", "pos", "n_lines"]
#: Position of a row that only says that its document holds the key.
WITNESS = -1


def stream(batches, min_docs: int):
    """Rows that go (edge false), and rows of keys that may go on in a neighbouring partition (edge true)."""
    out: list[tuple] = []
    key, first_key = None, True
    seen: list[int] = []  # the key's first documents, min_docs at most
    waiting: list[tuple] = []  # rows of its second and later documents while they are too few

    def batch() -> pa.RecordBatch:
        made = [pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.int32()) for i in range(6)]
        made.append(pa.array([r[6] for r in out], pa.bool_()))
        out.clear()
        return pa.RecordBatch.from_arrays(made, [*NAMES, "edge"])

    last = None
    for b in batches:
        for r in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
            if r[:2] != key:
                first_key = key is None
                key, seen, waiting, last = r[:2], [], [], None
            if first_key:
                out.append((*r, True))
            else:
                if r[2] != last:
                    last = r[2]
                    if len(seen) < min_docs:
                        seen.append(last)
                        if len(seen) == min_docs:
                            out.extend((*x, False) for x in waiting)
                            waiting = []
                if len(seen) == min_docs > 1:
                    out.append((*r, False))
                elif len(seen) > 1:
                    waiting.append(r)
            if len(out) >= 20_000:
                yield batch()
    if key is not None and not first_key:
        out.extend((*x, True) for x in waiting)
        out.extend((*key, doc, 0, WITNESS, 0, True) for doc in seen)
    yield batch()


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """row_key, doc, pos and n_lines of each line that goes. docs has row_key; min_docs is 2 or more."""
    order = [F.col("high"), F.col("low"), F.col("doc").desc(), F.col("pos")]
    found = settle(occurrences(docs, min_chars)).repartitionByRange(*order).sortWithinPartitions(*order)
    passed = settle(found.mapInArrow(lambda batches: stream(batches, min_docs), "high long, low long, doc long, row_key long, pos int, n_lines int, edge boolean"))
    edges = passed.filter("edge")
    # a partition passes on its first and its last key, so these are two rows for each partition at most
    shared = edges.select("high", "low", "doc").distinct().groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("most")).filter(F.col("n") >= min_docs).drop("n")
    late = edges.filter(F.col("pos") > WITNESS).join(F.broadcast(shared), ["high", "low"]).filter(F.col("doc") < F.col("most"))
    columns = ["row_key", "doc", "pos", "n_lines"]
    return passed.filter("NOT edge").select(*columns).unionByName(late.select(*columns))


def bits(kept: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(kept).tobytes())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """row_key, doc, n_lines, n_dropped and keep (zlib of one bit for each line, the first one highest) of each document that loses lines."""
    gone = drops(docs, min_chars, min_docs).groupBy("row_key", "doc").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, many = [], []
        for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            kept = np.ones(n, dtype=bool)
            kept[at] = False
            keep.append(bits(kept))
            many.append(len(at))
        made = [batch.column("row_key"), batch.column("doc"), batch.column("n_lines"), pa.array(many, pa.int32()), pa.array(keep, pa.binary())]
        return pa.RecordBatch.from_arrays(made, ["row_key", "doc", "n_lines", "n_dropped", "keep"])

    return map_batches(gone, run, "row_key long, doc long, n_lines int, n_dropped int, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    """The lines of text that keep leaves; all without one."""
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join([line for line, bit in zip(lines, np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)), strict=False) if bit])


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "keep") -> DataFrame:
    """docs with the bitmap of each document in keep (no column of docs), null where all lines stay."""
    key, map_key, map_doc = (fresh([*docs.columns, keep], c) for c in ("line_key", "map_key", "map_doc"))
    maps = keep_bitmaps(with_key(docs.select("doc_id", "text"), "doc_id", "text"), min_chars, min_docs)
    maps = maps.select(F.col("row_key").alias(map_key), F.col("doc").alias(map_doc), F.col("keep").alias(keep))
    same = (F.col(key) == F.col(map_key)) & (F.coalesce("doc_id", F.lit(SMALLEST)) == F.col(map_doc))
    return docs.withColumn(key, row_key("doc_id", "text")).join(maps, same, "left").drop(key, map_key, map_doc)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its shared lines are gone."""
    docs = with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_lines, n_dropped, digest = [], [], []
        for text, keep in zip(utf8(batch.column("text")), batch.column("keep").to_pylist(), strict=True):
            kept = kept_text(text, keep)
            n_lines.append(text.count(b"\n") + 1)
            # with no line kept there is nothing, which counts as no line
            n_dropped.append(0 if keep is None else n_lines[-1] - int(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines[-1]).sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_batches(docs.select("doc_id", "text", "keep"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT n, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, most IS NOT NULL AND doc_id < most AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY n, doc_id
"""
