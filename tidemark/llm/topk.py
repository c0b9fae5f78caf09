"""Exact top-k search by inner product with a vector-approximation file.

Equal vectors are one class, with its smallest ids. The file holds classes in blocks of one dimension: a row for each
class with its exact vector, and a row for each block with the cells of its classes, CELL_BITS bits a component, packed;
a block has its own lowest value and cell width for each component. A query's inner product with a block's cells, less
or plus what the cells' widths leave open, bounds the product with each of its vectors.

The first phase reads cells only: blocks of vectors and groups of queries meet in the squares of a grid, to which both
sides are dealt by the numbers of their blocks, so no key is hot and a square streams its vectors past the queries it
holds. A square passes on what its own kth lower bound of a query doesn't exclude; the kth lower bound over all squares
then excludes more. The second phase reads exact vectors in the order of their upper bounds: those of the k best bounds
first, which give each query a score that its kth result reaches, then those whose upper bound reaches that score. With
these the kth result is certain.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; all others do, however
large; scores beyond a long count as the largest or smallest long; a query only meets vectors of its own dimension; null
ids take no part; rows with a query's own id are not its results; ties go to the smaller id; a query with fewer others
gets all of them; rows that repeat are each a result and each a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import settle, table

K, SCALE, CELL_BITS = 20, 64.0, 6
#: Vectors in a block, queries in a block and in a group that a square holds.
VECTORS, QUERIES, GROUP = 4096, 512, 8192
#: Vectors that a square sees at least, if there are so many: with few, its own kth bound excludes little.
SEEN = 16_384
#: Candidates that a square holds before it passes them on.
HELD = 1_000_000
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x (the vector as it is) of the vectors that take part."""
    fine = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False)))
    rows = vectors.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(fine)
    return rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("x"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """x and ids (id and n, by id) of each distinct vector: its k + 1 smallest ids, each with its number of rows up to k."""
    counted = rows.groupBy("x", "id").agg(F.count(F.lit(1)).alias("n"))
    few = counted.withColumn("place", F.row_number().over(W.partitionBy("x").orderBy("id"))).filter(F.col("place") <= k + 1)
    return few.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).cast("int").alias("n")))).alias("ids"))


def _pack(cells: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.unpackbits(cells[..., None], axis=-1)[..., 8 - bits :]).tobytes()


def _unpack(packed: bytes, n: int, dim: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * dim * bits).reshape(n, dim, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1)).astype(np.float32)


def _quantised(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and cell width (a power of two) of each component, and the cells."""
    low = v.min(axis=0)
    with np.errstate(divide="ignore"):
        step = np.exp2(np.maximum(0, np.floor(np.log2(v.max(axis=0) - low)) + 1 - bits))
    return low, step, np.clip((v - low) // step, 0, (1 << bits) - 1).astype(np.uint8)


FILE = "block long, at int, dim int, x array<{kind}>, ids array<struct<id: long, n: int>>, first binary, second binary, low binary, step binary, cells binary"


def packed(rows: DataFrame, most: int, bits: int | None) -> DataFrame:
    """The file of rows (x, ids): a row for each of them, and one for each block (at is null).

    A block has the smallest and second smallest (or again the smallest) id of each row, and low, step and cells; without
    bits, in cells the components as they are. No block crosses a partition."""
    kind = rows.schema["x"].dataType.elementType.simpleString()
    arrow = [pa.int64(), pa.int32(), pa.int32(), None, None, *[pa.binary()] * 5]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            one = pa.Table.from_batches(held.pop(dim)).combine_chunks()
            x, ids = (one.column(c).combine_chunks() if one.column(c).num_chunks != 1 else one.column(c).chunk(0) for c in ("x", "ids"))
            n = len(x)
            exact = np.array(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, dim)
            numbers, starts = ids.flatten().field("id").to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            first = numbers[starts[:-1]]
            second = numbers[np.minimum(starts[:-1] + 1, starts[1:] - 1)]
            if bits is None:
                described = [None, None, exact.tobytes()]
            else:
                low, step, cells = _quantised(np.clip(np.floor(exact * SCALE), -(2.0**1000), 2.0**1000), bits)
                described = [low.tobytes(), step.tobytes(), _pack(cells, bits)]
            last = [number, None, dim, None, None, first.tobytes(), second.tobytes(), *described]
            kinds = [*arrow[:3], x.type, ids.type, *arrow[5:]]
            rest = [pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, dim), pa.int32()), x, ids, *[pa.nulls(n, pa.binary())] * 5]
            made = [pa.concat_arrays([a, pa.array([b], t)]) for a, b, t in zip(rest, last, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, ["block", "at", "dim", "x", "ids", "first", "second", "low", "step", "cells"])

        for b in batches:
            dims = np.diff(b.column("x").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                mine = b.filter(pa.array(dims == dim))
                while len(mine):
                    have = held.setdefault(dim, [])
                    room = most - sum(map(len, have))
                    have.append(mine.slice(0, room))
                    if len(mine) >= room:
                        yield block(dim)
                    mine = mine.slice(room)
        for dim in list(held):
            if held[dim]:
                yield block(dim)

    return rows.select("x", "ids").mapInArrow(run, FILE.format(kind=kind))


def _bounds(q: np.ndarray, v: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of integers q with the vectors of a block (low, step, cells)."""
    low, step, cells = v
    top = np.abs(low) + step * (cells.max(axis=0) + 1)
    most = float(np.abs(q).max(initial=0)) * float(top.max(initial=0)) * q.shape[1]
    if not most < 2.0**900:
        return np.full((len(q), len(cells)), -math.inf), np.full((len(q), len(cells)), math.inf)
    stepped = q * step
    small = float(np.abs(stepped).max(initial=0)) * float(cells.max(initial=0)) * q.shape[1]
    kind = np.float32 if small < 1 << 24 else np.float64
    middle = (stepped.astype(kind) @ cells.T.astype(kind)).astype(np.float64) + (q @ low)[:, None]
    open_ = step - 1
    below, above, slack = np.minimum(q, 0) @ open_, np.maximum(q, 0) @ open_, 0.0
    if most >= 1 << 50:  # neither cells nor sums are exact any more
        wide = np.abs(q) @ (2 * step)
        below, above, slack = -wide, wide, most * q.shape[1] * 2.0**-48
    clip = lambda x: np.clip(x, *map(float, LONG))
    return clip(middle + (below - slack)[:, None]), clip(middle + (above + slack)[:, None])


class Square:
    """The queries of a square of the grid, each one's k best lower bounds, and the candidates so far."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits = k, bits
        self.blocks: dict[int, list[tuple]] = {}
        self.groups: dict[int, dict] = {}
        self.held, self.size = [], 0

    def query_block(self, dim: int, block: int, ids: bytes, exact: bytes) -> None:
        ids = np.frombuffer(ids, np.int64)
        q = np.clip(np.floor(np.frombuffer(exact).reshape(-1, dim) * SCALE), -(2.0**1000), 2.0**1000)
        self.blocks.setdefault(dim, []).append((np.full(len(ids), block), np.arange(len(ids)), ids, q))

    def group(self, dim: int) -> dict | None:
        if dim not in self.groups and dim in self.blocks:
            block, at, ids, q = (np.concatenate(x) for x in zip(*self.blocks.pop(dim), strict=True))
            self.groups[dim] = {"block": block, "at": at, "ids": ids, "q": q, "best": np.full((len(ids), self.k), -math.inf)}
        return self.groups.get(dim)

    def vector_block(self, dim: int, block: int, first: bytes, second: bytes, v: tuple) -> None:
        g = self.group(dim)
        if g is None:
            return
        first, second = np.frombuffer(first, np.int64), np.frombuffer(second, np.int64)
        v = (np.frombuffer(v[0]), np.frombuffer(v[1]), _unpack(v[2], len(first), dim, self.bits))
        for i in range(0, len(g["ids"]), QUERIES):
            part = slice(i, i + QUERIES)
            low, up = _bounds(g["q"][part], v)
            mine = g["ids"][part, None] == first
            alone = mine & (first == second)  # the class of the query itself
            low[alone] = up[alone] = -math.inf
            g["best"][part] = np.partition(np.concatenate([g["best"][part], low], axis=1), -self.k, axis=1)[:, -self.k :]
            kth = g["best"][part].min(axis=1)
            rows, at = np.nonzero((up >= kth[:, None]) & ~alone)
            ident = np.where(mine[rows, at], second[at], first[at])
            found = (np.full(len(rows), dim), rows + i, np.full(len(rows), block), at, low[rows, at], up[rows, at], ident)
            self.held.append(self.tied(found))
            self.size += len(self.held[-1][0])
        if self.size > HELD:
            self.prune()

    def tied(self, found: tuple) -> tuple:
        """found, but of a query's candidates that are exactly its kth bound only the k with the smallest ids."""
        dim, row, _, _, low, up, ident = found
        if not len(row):
            return found
        kth = self.groups[dim[0]]["best"].min(axis=1)[row]
        same = np.flatnonzero((low == up) & (up == kth) & (np.bincount(row)[row] > 2 * self.k))
        if not len(same):
            return found
        order = same[np.lexsort((ident[same], row[same]))]
        start = np.flatnonzero(np.concatenate([[True], np.diff(row[order]) != 0]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
        keep = np.ones(len(row), bool)
        keep[order[place >= self.k]] = False
        return tuple(x[keep] for x in found)

    def prune(self) -> None:
        """Drop what the bounds seen since exclude."""
        after = []
        for found in (tuple(np.concatenate(x) for x in zip(*(h for h in self.held if len(h[0]) and h[0][0] == dim), strict=True)) for dim in {int(h[0][0]) for h in self.held if len(h[0])}):
            kth = self.groups[int(found[0][0])]["best"].min(axis=1)[found[1]]
            after.append(self.tied(tuple(x[found[5] >= kth] for x in found)))
        self.held, self.size = after, sum(len(h[0]) for h in after)

    def passed_on(self):
        self.prune()
        for dim, row, block, at, low, up, ident in self.held:
            if len(row):
                g = self.groups[int(dim[0])]
                made = [g["block"][row], g["at"][row], block, at, low, up, ident]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], ["qb", "qat", "block", "at", "low", "up", "ident"])
        self.held, self.size = [], 0


def candidates(cells: DataFrame, queries: DataFrame, k: int, bits: int, group: int = GROUP) -> DataFrame:
    """qb, qat, block, at, low, up and ident (smallest id that isn't the query's) of what the squares' bounds leave."""
    spark = cells.sparkSession
    n_queries, n_vectors = (x.agg(F.sum(F.octet_length("first") / 8)).first()[0] or 0 for x in (queries, cells))
    columns = max(1, math.ceil(n_queries / group))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = max(1, min(int(n_vectors / SEEN), math.ceil(tasks / columns)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = ["dim", "block", "first", "second", "low", "step", "cells"]
    q = queries.withColumn("c", deal("block", columns)).select(every(rows).alias("r"), "c", F.lit(0).alias("side"), *held)
    v = cells.withColumn("r", deal("block", rows)).select("r", every(columns).alias("c"), F.lit(1).alias("side"), *held)
    grid = q.unionByName(v).repartition(rows * columns, "r", "c").sortWithinPartitions("r", "c", "side")

    def run(batches):
        key, square = None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["r"], r["c"]) != key:
                    if square:
                        yield from square.passed_on()
                    key, square = (r["r"], r["c"]), Square(k, bits)
                if r["side"]:
                    square.vector_block(r["dim"], r["block"], r["first"], r["second"], (r["low"], r["step"], r["cells"]))
                    if square.size > HELD:
                        yield from square.passed_on()
                else:
                    square.query_block(r["dim"], r["block"], r["first"], r["cells"])
        if square:
            yield from square.passed_on()

    return grid.mapInArrow(run, "qb long, qat int, block long, at int, low double, up double, ident long")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of integers floor(SCALE * x), row by row, within a long."""
    a, b = np.floor(q * SCALE), np.floor(v * SCALE)
    with np.errstate(over="ignore", invalid="ignore"):
        sure = np.abs(a).max(axis=1) * np.abs(b).max(axis=1) * q.shape[1] < 2.0**53
        out = np.where(sure, (a * b).sum(axis=1), 0).astype(np.int64)
    whole = lambda x: [int(t) * int(SCALE) if abs(t) >= 1 << 60 else math.floor(t * SCALE) for t in x.tolist()]
    for i in np.flatnonzero(~sure).tolist():
        out[i] = min(max(sum(s * t for s, t in zip(whole(q[i]), whole(v[i]), strict=True)), LONG[0]), LONG[1])
    return out


def exact(some: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qb, qat, query_id, ids and score of candidates, from the exact vectors."""
    v = vectors.select("block", "at", "x", "ids")
    q = queries.select(F.col("block").alias("qb"), F.col("at").alias("qat"), F.col("x").alias("qx"), F.col("ids")[0]["id"].alias("query_id"))
    met = some.select("qb", "qat", "block", "at").join(v, ["block", "at"]).join(q, ["qb", "qat"]).select("qb", "qat", "query_id", "ids", "x", "qx")

    def run(batches):
        for b in batches:
            flat = [np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), np.float64) for c in ("qx", "x")]
            dims, starts = np.diff(b.column("x").offsets.to_numpy()), b.column("x").offsets.to_numpy() - b.column("x").offsets[0].as_py()
            score = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                places = starts[at][:, None] + np.arange(dim)
                score[at] = products(flat[0][places], flat[1][places])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("qb", "qat", "query_id", "ids")), pa.array(score)], ["qb", "qat", "query_id", "ids", "score"])

    return met.mapInArrow(run, "qb long, qat int, query_id long, ids array<struct<id: long, n: int>>, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = CELL_BITS, block: int = VECTORS, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query; both sides as usable() gives them."""
    file = settle(packed(classes(vectors, k), block, bits))
    asked = settle(packed(queries.select("x", F.array(F.struct("id", F.lit(1).alias("n"))).alias("ids")), QUERIES, None))
    found = settle(candidates(file.filter("at IS NULL"), asked.filter("at IS NULL"), k, bits, group))

    query = W.partitionBy("qb", "qat")
    whole = query.orderBy(F.desc("low"), "ident").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kth = F.nth_value(F.struct("low", "ident"), k).over(whole)
    left = found.withColumn("kth", kth).filter((F.col("kth").isNull()) | (F.col("up") > F.col("kth.low")) | ((F.col("up") == F.col("kth.low")) & (F.col("ident") <= F.col("kth.ident"))))
    left = settle(left.withColumn("place", F.row_number().over(query.orderBy(F.desc("up"), "ident"))).select("qb", "qat", "block", "at", "up", "place"))

    rows, asking = file.filter("at IS NOT NULL"), asked.filter("at IS NOT NULL")
    first = settle(exact(left.filter(F.col("place") <= k), rows, asking))
    reached = first.groupBy("qb", "qat").agg(F.min("score").alias("reached"))
    second = exact(left.filter(F.col("place") > k).join(reached, ["qb", "qat"]).filter(F.col("up") >= F.col("reached").cast("double")), rows, asking)
    one = first.unionByName(second).select("qb", "qat", "query_id", "score", F.explode("ids").alias("v")).filter("v.id <> query_id")
    one = one.select("qb", "qat", "query_id", "score", F.col("v.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), "v.n")).alias("copy")).drop("copy")
    ranked = one.withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
