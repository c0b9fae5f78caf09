"""How filters interact, counted as documents stream in: incremental retraction.

Four filters look at one document: A (under 200 words), B (less than half of the words distinct), C (more than 3 in 100
characters are A-Z), D (holds a mark of #$%&*|). The fifth, E, looks at all: the text is that of a document with a smaller
id. A document's mask has a bit for each filter that it fails.

All files are read as an available-now stream of BATCHES micro-batches. A batch's masks and text digests are made in one
pass over the text, and rows of one digest are compared in each Arrow batch: all but those with the least id fail E for
good and are dealt out evenly, so a text that a third of all documents hold brings its state a row from each task. The
rest meet the state of their text: the least id so far, and the part and mask of its rows. A smaller id takes their place, and
what they had counted without E is retracted: a row of -n without E, and one of +n with it. State is held in buckets of
digests (about ROWS_PER_BUCKET documents each, however large the input), one packed table a bucket, so that a text's
state costs its own bytes and no call of its own. Each batch's changes meet their labels and are added to the part
counters, which are written by batch number, so a batch that runs again replaces its own. State and progress are kept in
the checkpoint below the folder that driver and executors share; a stopped audit goes on from there.

Counters (part, mask, good, toxic, n) are all that the report needs: what each filter removes at each step of each of the
120 orders, what it shares with others, and its Shapley value, are sums over 32 masks.

Defined results: null texts are empty, a null lang is the part ''; a null id is neither smaller nor larger than others, so
its row never fails E nor makes others fail it, and it has no labels; rows of one id and text are copies of which none is
smaller; of several label rows of one id, one that says good or toxic is enough; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.llm.common import shared_dir, table, utf8

LETTERS = "ABCDE"
#: State beyond memory, saved as changes; its files take the disk that they need, not blocks set aside for each of many partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Limits of the filters: words, distinct words and capitals in a hundred, marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
COPY = 1 << LETTERS.index("E")
#: Micro-batches of a run, and documents that share a bucket of state.
BATCHES, ROWS_PER_BUCKET, LEAST_BUCKETS = 4, 2048, 64
_CAPITALS, _REST = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes, so at the white space of ASCII only
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text.translate(None, _REST))) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


#: A row that meets the state of its text, or counts as it is (settled). digest: 128 bits of the text; known: whether there is an id.
MARKED = "bucket int, digest binary, doc_id long, known boolean, part string, mask int, n long, settled boolean"


def marks(buckets: int):
    """From (doc_id, text, lang) to MARKED rows, combined in each Arrow batch."""

    def run(batches):
        for batch in batches:
            rows = {}
            for i, text, part in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                key = (hashlib.blake2b(text, digest_size=16).digest(), i, part or "")
                if key in rows:
                    rows[key][1] += 1
                else:
                    rows[key] = [mask_of(text), 1]
            least: dict[bytes, int] = {}
            for digest, i, _ in rows:
                if i is not None and i <= least.get(digest, i):
                    least[digest] = i
            out = []
            for at, ((digest, i, part), (mask, n)) in enumerate(rows.items()):
                meets = i is not None and i == least[digest]
                # what is settled needs no state and is dealt out evenly
                bucket = (int.from_bytes(digest[:4], "big") if meets else at) % buckets
                out.append((bucket, digest, i or 0, i is not None, part, mask if meets or i is None else mask | COPY, n, not meets))
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in MARKED.split(", ")])

    return run


CHANGES = "doc_id long, known boolean, part string, mask int, n long"
_HELD = ["digest", "doc_id", "part", "mask", "n"]


def packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (batch := pa.RecordBatch.from_pandas(held[_HELD], preserve_index=False)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_pandas()


def met(held: pd.DataFrame | None, came: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket holds after rows came, and the changes (doc_id, part, mask, n) that follow.

    Rows that came with the least id of their text count without E, and stay; others count with E. Rows held whose text
    has a smaller id now are taken back without E and count with it."""
    came = came[_HELD].groupby(["digest", "doc_id", "part", "mask"], as_index=False, sort=False)["n"].sum()
    both = came.assign(old=False) if held is None else pd.concat([held.assign(old=True), came.assign(old=False)], ignore_index=True)
    beaten = both["doc_id"] > both.groupby("digest", sort=False)["doc_id"].transform("min")
    fresh, old = both[~both["old"]], both[both["old"] & beaten]
    changes = [fresh.assign(mask=fresh["mask"] | beaten[fresh.index] * COPY), old.assign(n=-old["n"]), old.assign(mask=old["mask"] | COPY)]
    left = both[~beaten].groupby(["digest", "doc_id", "part", "mask"], as_index=False, sort=False)["n"].sum()
    return left, pd.concat(changes, ignore_index=True)[["doc_id", "part", "mask", "n"]].assign(known=True)


def bucket_changes(key, frames, state: GroupState):
    """Changes that a bucket's new rows bring, against its state."""
    held = unpacked(state.get[0]) if state.exists else None
    for rows in frames:
        now = rows["settled"]
        if now.any():
            yield rows.loc[now, ["doc_id", "known", "part", "mask", "n"]]
        if not now.all():
            held, changes = met(held, rows.loc[~now])
            yield changes[["doc_id", "known", "part", "mask", "n"]]
    if held is not None:
        state.update((packed(held),))


def counters(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n that changes come to."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("its_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    by_doc = changes.groupBy("doc_id", "known", "part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")
    at = by_doc.join(said, F.col("known") & (F.col("doc_id") == F.col("its_id")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return at.groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, folder: str, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """Counters of all documents below path; folder keeps state, progress and the counters of each batch, and a later call goes on from there."""
    docs = spark.read.parquet(path)
    files = max(1, -(-len(docs.inputFiles()) // batches))
    buckets = buckets or max(LEAST_BUCKETS, docs.count() // ROWS_PER_BUCKET)  # rows are counted by files' footers
    # a stream's path must be a folder or a pattern; as a pattern, one file will do
    pattern = path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"
    came = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(pattern).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    changes = came.mapInArrow(marks(buckets), MARKED).groupBy("bucket").applyInPandasWithState(bucket_changes, CHANGES, "held binary", "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        counters(batch, labels).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")  # a row for each part and mask

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        query = changes.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:  # the query has its own copy by now
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    rows = spark.read.schema("part string, mask int, good boolean, toxic boolean, n long, batch int").parquet(f"{folder}/counters")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the bit of its filter and the bits of those before, of all orders."""
    out = []
    for order in itertools.permutations(LETTERS):
        earlier = 0
        for k, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            out.append(("".join(order), k + 1, bit, earlier))
            earlier |= bit
    return out


def report(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    masks = range(1 << len(LETTERS))
    many = lambda name, test, mask: F.coalesce(F.sum(F.when(test & (F.col("mask") == mask), F.col("n"))), F.lit(0)).alias(f"{name}{mask}")
    kinds = {"n": F.lit(True), "g": F.col("good"), "t": F.col("toxic")}
    wide = counted.groupBy("part").agg(*[many(name, test, m) for name, test in kinds.items() for m in masks])
    arrays = wide.select("part", *[F.array(*[F.col(f"{name}{m}") for m in masks]).alias(name) for name in kinds])
    made = "array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'bit', {b}, 'earlier', {e})" for o, k, b, e in steps()) + ")"
    each = arrays.select("part", *kinds, F.inline(F.expr(made)))
    total = lambda name, test: F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m), F.get(F.col(name), m)).otherwise(0))
    bit, earlier = F.col("bit"), F.col("earlier")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    # of the orders in which the failing filters can stand, each is the first in an equal share
    orders = 120
    shares = F.array(*[F.lit(orders // max(1, m.bit_count())) for m in masks])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m), F.get(F.col("n"), m) * F.get(shares, m)).otherwise(0))
    return each.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(earlier)) == 0).alias("kept"), total("n", lambda m: fails(m) & ~gone(m)).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"), total("g", lambda m: fails(m) & ~gone(m)).alias("good_lost"), total("t", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The report on all documents below path, in a folder of its own."""
    return report(stream_counters(spark, path, labels, f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}", batches))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the five filters, by language."""
    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def _sql() -> str:
    w = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH s(filter_order, step, bit, earlier) AS (VALUES {", ".join(map(str, steps()))}),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, {w} AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[{MARKS.decode()}]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (WHERE mask & (bit | earlier) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (WHERE good AND mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE toxic AND mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (WHERE mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


SQL = _sql()
