"""Sharding by sampled splitters: shards of near equal bytes, or of counts at most one apart.

Records are ordered by a digest of their text, then by id, so equal texts (a group) lie together. A sample of keys, each
drawn with a probability in proportion to its size, gives the quantiles that cut this order into RANGES ranges; records
find their range by binary search, and are range-partitioned by it. Ranges that come out with more than OVERFULL times
their fair share of bytes or of rows are subdivided by samples of their own, drawn by bytes and rows alike, until none is
left; so a group that holds a third of all rows becomes many ranges. Sums of the ranges give each range its place in the
order, and running sums within a range give each record the exact bytes and rows before it. A record's shard is where its
middle byte falls when the total is cut into equal parts (law `bytes`), or where its place falls (law `rows`). A shard's
size is so within the largest record of the mean. Under `bytes` a group of up to WHOLE of a shard moves as one, by its own
middle byte, and stays in one shard, which moves a shard's size by WHOLE at most.

The result doesn't depend on the sample, only the evenness of the work does. Only the splitters and the sums of ranges
(MOST_RANGES at most) and of shards come together in one place.

Defined results: null texts have no bytes and are a group, apart from the empty text only in the order; null ids come
first; rows that repeat (equal id and text) get shards and slots of their own, in any order among them; an empty table
gives no rows; other columns stay whatever their names are, but for columns named as the ones that are added, which
these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import fresh, settle, table

SHARDS = 24
#: Bytes that each record costs besides its text.
RECORD = 8
RANGES, MOST_RANGES, SAMPLES, OVERFULL = 512, 4096, 16, 2.0
#: Part of a shard up to which a group stays whole under the law `bytes`.
WHOLE = 0.01
SEED = 11
LAWS = ("bytes", "rows")
#: What orders the records: a digest of the text, whether there is an id, the id, and a number that tells repeated rows apart.
KEY = ("text_key", "has_id", "id", "tie")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD)


def text_key(text: Column) -> Column:
    """60 bits of a digest of the text; null comes first."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def _key() -> Column:
    return F.struct(*KEY)


def _uniform() -> Column:
    """A number in [0, 1) that a record's key gives."""
    return F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def _range_of(splitters: DataFrame) -> Column:
    """How many of the splitters a record's key has reached, by binary search. They are MOST_RANGES at most and part of the plan, as a literal."""
    held = splitters.agg(F.to_json(F.sort_array(F.collect_list("splitter")))).first()[0]
    n = splitters.count()
    if not n:
        return F.lit(0)
    found = F.from_json(F.lit(held), "array<struct<text_key: bigint, has_id: boolean, id: bigint, tie: bigint>>")
    middle = lambda s: F.shiftright(s["low"] + s["high"], 1)

    def step(s: Column, _: Column) -> Column:
        reached = F.get(found, middle(s)) <= _key()
        more = s["low"] < s["high"]
        return F.struct(F.when(more & reached, middle(s) + 1).otherwise(s["low"]).alias("low"), F.when(more & ~reached, middle(s)).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, step, lambda s: s["low"])


def _quantiles(drawn: DataFrame, pieces: Column, by: list[str]) -> DataFrame:
    """splitter: the drawn keys that begin the second and later of pieces parts of equal weight, within each of by."""
    order = W.partitionBy(*by).orderBy(*KEY)
    seen = drawn.select(*by, *KEY, (F.sum("weight").over(order) / F.sum("weight").over(W.partitionBy(*by))).alias("part"), pieces.alias("pieces"))
    seen = seen.withColumn("piece", F.floor(F.col("part") * F.col("pieces") - 1e-9))
    return seen.groupBy(*by, "piece").agg(F.min(_key()).alias("splitter")).filter("piece > 0").select("splitter")


def splitters(rows: DataFrame, ranges: int = RANGES, whole: float = 0) -> DataFrame:
    """Splitters (column splitter) of rows (KEY and size, settled); no group of up to whole bytes is cut."""
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return rows.select(_key().alias("splitter"))
    chance = F.least(F.col("size") * F.lit(ranges * SAMPLES / total), F.lit(1.0))
    drawn = rows.filter(_uniform() < chance).withColumn("weight", F.col("size") / chance)
    found = settle(_uncut(rows, _quantiles(drawn, F.lit(ranges), []), whole))
    while (many := found.count()) < MOST_RANGES // 2:
        ranged = rows.withColumn("range", _range_of(found))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("range_rows"))
        load = F.greatest(F.col("range_size") * ranges / F.lit(total), F.col("range_rows") * ranges / F.lit(n))
        over = settle(sums.withColumn("pieces", F.least(F.ceil(load), F.col("range_rows"))).filter((load > OVERFULL) & (F.col("pieces") > 1)))
        if over.isEmpty():
            break
        share = (F.col("size") / F.col("range_size") + F.lit(1.0) / F.col("range_rows")) / 2
        chance = F.least(share * F.col("pieces") * SAMPLES, F.lit(1.0))
        again = ranged.join(F.broadcast(over), "range").filter(_uniform() < chance).withColumn("weight", share / chance)  # over has a row for each range
        more = settle(_uncut(rows, _quantiles(again, F.col("pieces"), ["range"]), whole).unionByName(found).distinct())
        if more.count() == many:  # what is left is groups that stay whole
            break
        found = more
    return found


def _uncut(rows: DataFrame, found: DataFrame, whole: float) -> DataFrame:
    """found, with splitters inside a group of up to whole bytes moved to where the group begins."""
    if not whole:
        return found.select("splitter")
    named = found.withColumn("text_key", F.col("splitter.text_key"))
    groups = rows.join(F.broadcast(named.select("text_key").distinct()), "text_key").groupBy("text_key").agg(F.sum("size").alias("group_size"))  # MOST_RANGES at most
    start = F.struct(F.col("text_key"), *[F.lit(None).cast(t).alias(c) for c, t in zip(KEY[1:], ("boolean", "long", "long"), strict=True)])
    return named.join(groups, "text_key").select(F.when(F.col("group_size") <= F.lit(whole), start).otherwise(F.col("splitter")).alias("splitter")).distinct()


def placed(rows: DataFrame, shards: int = SHARDS, law: str = "bytes", ranges: int = RANGES) -> DataFrame:
    """rows (KEY and size, settled) with shard and slot (gapless from 0 within the shard, in the order of the keys)."""
    if law not in LAWS:
        raise ValueError(f"law {law} is none of {', '.join(LAWS)}")
    if shards < 1:
        raise ValueError("there must be a shard at least")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    whole = WHOLE * total / shards if law == "bytes" else 0
    ranged = rows.withColumn("range", _range_of(splitters(rows, ranges, whole)))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes_in"), F.count(F.lit(1)).alias("rows_in"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("range", *[F.coalesce(F.sum(f"{x}_in").over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("bytes", "rows")])  # of MOST_RANGES rows at most
    order = W.partitionBy("range").orderBy(*KEY)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    at = ranged.select(*rows.columns, "range", (F.row_number().over(order) - 1).alias("row_in"), (F.sum("size").over(upto) - F.col("size")).alias("byte_in"))
    at = at.join(F.broadcast(starts), "range").withColumns({"row_at": F.col("rows_before") + F.col("row_in"), "byte_at": F.col("bytes_before") + F.col("byte_in")})
    if law == "rows":
        shard = F.expr(f"(row_at * {shards}) div {max(n, 1)}")
    else:
        # a group that isn't cut lies in one range, so what its range holds of it is the whole; the others' sizes are over the limit or part of one that is
        group = W.partitionBy("range", "text_key")
        at = at.withColumns({"group_size": F.sum("size").over(group), "group_at": F.min("byte_at").over(group)})
        cut = ranged.groupBy("range").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
        edges = cut.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("text_key")).groupBy("text_key").agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select("text_key", F.lit(True).alias("is_cut"))  # at most one for each range
        at = at.join(F.broadcast(edges), "text_key", "left")
        keep = (F.col("group_size") <= F.lit(whole)) & F.col("is_cut").isNull()
        at = at.withColumns({"from_byte": F.when(keep, F.col("group_at")).otherwise(F.col("byte_at")), "in_bytes": F.when(keep, F.col("group_size")).otherwise(F.col("size"))})
        shard = F.expr(f"least(((2 * from_byte + in_bytes) * {shards}) div {max(2 * total, 1)}, {shards - 1})")
    dealt = settle(at.select(*rows.columns, "row_at", shard.cast("int").alias("shard")))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("rows_in")).select("shard", F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("first_row"))  # a row for each shard
    return dealt.join(F.broadcast(firsts), "shard").select(*rows.columns, "shard", (F.col("row_at") - F.col("first_row")).alias("slot"))


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """KEY, size and more of each document, settled, so that the number that tells repeated rows apart is the same ever after."""
    text = F.col("text")
    return settle(docs.select(text_key(text).alias("text_key"), F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("tie"), text_size(text).alias("size"), *more))


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """docs with shard and slot. Whole rows move once, to meet their places by key."""
    docs = docs.drop("shard", "slot")
    own, its = (fresh(docs.columns, c) for c in ("own_tie", "its_tie"))
    whole = settle(docs.withColumn(own, F.monotonically_increasing_id()))
    rows = whole.select(text_key(F.col("text")).alias("text_key"), F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id").cast("long").alias("id"), F.col(own).alias("tie"), text_size(F.col("text")).alias("size"))
    places = placed(settle(rows), shards, law).select(F.col("tie").alias(its), "shard", "slot")
    return whole.join(places, F.col(own) == F.col(its)).select(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes", files: int = 1) -> None:
    """Parquet of docs below path, a folder for each shard with files parts in the order of slots."""
    out = assign(docs, shards, law)
    part = F.pmod(F.floor(F.col("slot") * files / F.max("slot").over(W.partitionBy("shard"))), F.lit(files)) if files > 1 else F.lit(0)
    out.withColumn("shard_part", part).repartition("shard", "shard_part").sortWithinPartitions("shard", "slot").drop("shard_part").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = keyed(docs, F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return placed(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_CRC = "list_reduce(list_prepend(x, list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
SQL = f"""
WITH t AS (SELECT list(c ORDER BY x) AS crc FROM (SELECT x, {_CRC} AS c FROM (SELECT unnest(range(256)) AS x))),
d AS (SELECT doc_id, text, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS k, coalesce(strlen(text), 0) + {RECORD} AS size FROM documents),
o AS (SELECT *, row_number() OVER w - 1 AS row_at, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS byte_at, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k) AS group_size FROM d WINDOW w AS (ORDER BY k, doc_id NULLS FIRST)),
g AS (SELECT *, group_size <= {WHOLE} * total / {SHARDS} AS whole, min(byte_at) OVER (PARTITION BY k) AS group_at FROM o),
s AS (SELECT *, CAST(least(((2 * CASE WHEN whole THEN group_at ELSE byte_at END + CASE WHEN whole THEN group_size ELSE size END) * {SHARDS}) // (2 * total), {SHARDS - 1}) AS INTEGER) AS shard FROM g),
b AS (SELECT *, list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)) AS bytes FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(bytes, lambda c, x: xor(t.crc[xor(c & 255, x) + 1], c >> 8)), 4294967295) AS BIGINT) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row_at) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM b, t
"""
