"""Training-data pipeline over documents. Each stage takes all that the one before it kept; all but the last return documents' columns.

Null ids, null and empty texts, repeated rows and empty tables pass through every stage as its operator defines; other
columns stay whatever their names are. Null and empty texts are not toxic, have no line to lose, are near copies of
nothing, are mixed like others and have no tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, neardup, toxicity
from tidemark.llm.common import fresh, map_batches, row_key, settle, table, utf8

#: Documents with this score or more go.
TOXIC = 0.5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic, by what the labels outside the held-out fifth teach; as they are."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    added = tuple(fresh(docs.columns, c) for c in ("toxicity", "restored"))
    return toxicity.score(docs, *model, added=added).filter(F.col(added[0]) < TOXIC).select(*docs.columns)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows, and a document that loses every line stays as an empty text."""
    columns, bits = docs.columns, fresh(docs.columns, "keep_bits")
    marked = lines.with_bitmaps(docs, keep=bits)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = batch.column(bits).to_pylist()
        texts = batch.column("text").to_pylist()
        kept = [t if k is None or t is None else lines.kept_text(raw, k).decode() for t, raw, k in zip(texts, utf8(batch.column("text")), keep, strict=True)]
        chars = [n if k is None else len(t or "") for n, t, k in zip(batch.column("n_chars").to_pylist(), kept, keep, strict=True)]
        made = {"text": pa.array(kept, pa.string()), "n_chars": pa.array(chars, batch.schema.field("n_chars").type)}
        return pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in columns], columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(marked.select(*docs.columns, bits), cut, kinds)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id (null last); rows of one id and text are one
    document, of which one row stays, whatever their other columns."""
    key, wanted, whole = (fresh(docs.columns, c) for c in ("copy_key", "wanted_key", "whole"))
    kept = neardup.near_duplicates(docs.select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))).filter("first").select(F.col("row_key").alias(wanted))
    found = docs.withColumn(key, row_key("doc_id", "text")).join(kept, F.col(key) == F.col(wanted), "left_semi")
    every = [F.col(c) for c in docs.columns]
    return found.groupBy(key).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias(whole)).select(f"{whole}.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources; copies are rows of their own."""
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each row."""
    ids = bpe.encode(docs, bpe.default_vocabulary())
    return ids.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", toxic_out), ("lines", lines_out), ("neardup", copies_out), ("mixing", mixed), ("bpe", encoded)]
#: Word shingles, classifiers and encoders are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
