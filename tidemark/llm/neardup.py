"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Texts with one set of word shingles are a class; what follows is on classes. Each has SIGNS min-hashes, and in each tree
of the forest a label of LONGEST of them. A tree sorts all classes by their labels, range-partitioned so that crowded
regions spread over tasks, and neighbours in that order with a long common prefix are candidates. The depth adapts to the
region: two min-hashes where few classes share them, DEPTH in crowded regions, and more, up to LONGEST, where more than
STRETCH classes share DEPTH. Candidates whose signatures agree about as often as similar sets' do are linked, each
stretch giving a spanning forest of links only, never all pairs; what is longer than STRETCH at full depth, or goes on in
a neighbouring partition, is linked whole. There are as many trees as leave a pair at the threshold unseen with a
probability under MISS at DEPTH.

Components of these links are regions. A region's classes are dealt into blocks in the order of the first tree's labels,
so that neighbours with long common prefixes share a block. First each block's full sets meet each other and those of a
few representatives of the region; pairs that links connect already are not compared. Then only classes outside a
region's largest component so far meet the rest of their region, in wide blocks dealt by hash. So no link between different
texts is lost once its region is found, a group of near copies costs about its own size, and no group is ever whole in
one task. The components of confirmed links, by their least document id, are the result.

Defined results: null and empty texts and those of white space have no shingles, no links, and their own id as
component; texts with fewer words than a shingle are one shingle; repeated rows are in one component; rows with a null
id join components but don't name them, and a component of null ids only has a null name. Set hashes are of 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, settle, table, utf8, with_key
from tidemark.llm.graph import connected
from tidemark.llm.substrings import runs_of, word_hashes

SHINGLE, SIMILAR = 5, 0.8
SIGNS, DEPTH, LONGEST, MISS = 128, 3, 5, 1e-6
#: Classes that two shared min-hashes may bring together; classes of a stretch compared by signature, and held by a task.
CROWD, STRETCH, HELD = 256, 2048, 32_768
#: Classes of a block and of a wide block, and about how many representatives a region has.
BLOCK, WIDE, PIVOTS = 64, 256, 16
_SPREAD = np.random.default_rng(7).integers(1, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees_for(similar: float) -> int:
    return min(SIGNS // LONGEST, math.ceil(math.log(MISS) / math.log(1 - similar**DEPTH)))


def shingle_sets(texts: list[bytes], shingle: int):
    """The sorted distinct shingle hashes of each text, with A-Z in lower case."""
    for text in texts:
        words = word_hashes(text.lower().split())  # of bytes, so at the white space of ASCII and A-Z only
        yield np.unique(runs_of(words, min(shingle, len(words)))) if len(words) else np.empty(0, np.uint64)


def min_hashes(found: np.ndarray) -> np.ndarray:
    """SIGNS min-hashes of 32 bits of a set that isn't empty."""
    out = np.full(SIGNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, (found[at : at + 4096, None] * _SPREAD >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def sketches(docs: DataFrame, shingle: int, trees: int) -> DataFrame:
    """doc_id, row_key, n_shingles, class (null without shingles), signs (a byte of each min-hash) and paths (of each tree, joined)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, named, signs, path = [], [], [], []
        for found in shingle_sets(utf8(batch.column("text")), shingle):
            size.append(len(found))
            if len(found):
                least = min_hashes(found)
                named.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                signs.append(least.astype(np.uint8).tobytes())
                path.append(least[: trees * LONGEST].astype(">u4").tobytes())
            else:
                for x in (named, signs, path):
                    x.append(None)
        made = [batch.column("doc_id"), batch.column("row_key"), pa.array(size, pa.int64()), pa.array(named, pa.int64()), pa.array(signs, pa.binary()), pa.array(path, pa.binary())]
        return pa.RecordBatch.from_arrays(made, ["doc_id", "row_key", "n_shingles", "class", "signs", "paths"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "row_key", "text"), f, f"doc_id {kind}, row_key long, n_shingles long, class long, signs binary, paths binary")


class Sets:
    """Disjoint sets of places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], dtype=np.int64)


def _alike(ids: np.ndarray, signs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose signatures agree in least places or more."""
    sets, out = Sets(len(ids)), []
    for i in range(len(ids) - 1):
        for j in np.flatnonzero((signs[i + 1 :] == signs[i]).sum(axis=1) >= least) + i + 1:
            a, b = sets.find(i), sets.find(int(j))
            if a != b:
                sets.up[b] = a
                out.append((int(ids[i]), int(ids[j])))
    return out


def walk(batches, least: int):
    """Links among sorted rows (tree, path, class, signs); border rows carry the tree and DEPTH of stretches at a partition's ends."""
    out: list[tuple] = []
    pending: list[tuple[list, list]] = []  # whole stretches with the same two min-hashes so far
    crowded = False
    ids: list[int] = []  # of the stretch at hand, with signs and the rest of the labels
    signs: list[bytes] = []
    tails: list[bytes] = []
    key, first_key, rep, whole = None, None, 0, False

    def batch() -> pa.RecordBatch:
        made = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["a", "b", "tree", "border"])

    def compare(ids: list, signs: list) -> None:
        if len(ids) > 1:
            out.extend((a, b, None, None) for a, b in _alike(np.array(ids), np.frombuffer(b"".join(signs), np.uint8).reshape(len(ids), SIGNS), least))

    def descend(first: int, last: int, depth: int) -> None:
        """Compare part of the stretch, which shares depth min-hashes, at the depth that leaves few enough."""
        if last - first <= STRETCH:
            compare(ids[first:last], signs[first:last])
        elif depth == LONGEST:
            out.extend((ids[first], x, None, None) for x in ids[first + 1 : last])
        else:
            end = 4 * (depth + 1 - DEPTH)
            start = first
            for i in range(first + 1, last + 1):
                if i == last or tails[i][:end] != tails[start][:end]:
                    descend(start, i, depth + 1)
                    start = i

    def settle_pending() -> None:
        if crowded:
            for ids, signs in pending:
                compare(ids, signs)
        else:
            compare([x for ids, _ in pending for x in ids], [x for _, signs in pending for x in signs])
        pending.clear()

    def empty() -> None:
        for x in (ids, signs, tails):
            x.clear()

    def close() -> None:
        """The stretch at hand is over."""
        nonlocal crowded
        if not whole:
            if len(ids) > STRETCH:
                crowded = True
                descend(0, len(ids), DEPTH)
            else:
                pending.append((ids[:], signs[:]))
                if not crowded and sum(len(x) for x, _ in pending) > CROWD:
                    crowded = True
            if crowded:
                settle_pending()
        empty()

    def link_whole() -> None:
        nonlocal whole
        whole = True
        out.extend((rep, x, None, None) for x in ids if x != rep)
        empty()

    for b in batches:
        for tree, path, ident, sign in zip(*(b.column(n).to_pylist() for n in ("tree", "path", "class", "signs")), strict=True):
            stem = path[: 4 * DEPTH]
            if (tree, stem) != key:
                if key is not None:
                    close()
                    if (tree, path[:8]) != (key[0], key[1][:8]):
                        settle_pending()
                        crowded = False
                key, rep, whole = (tree, stem), ident, False
                if first_key is None:  # it may have begun in the partition before
                    first_key, whole = key, True
                    out.append((rep, rep, tree, stem))
            if whole:
                if ident != rep:
                    out.append((rep, ident, None, None))
            else:
                ids.append(ident)
                signs.append(sign)
                tails.append(path[4 * DEPTH :])
                if len(ids) > HELD:
                    link_whole()
            if len(out) > 20_000:
                yield batch()
    if key is not None:
        if key != first_key:  # it may go on in the next one
            if not whole:
                link_whole()
            out.append((rep, rep, *key))
        settle_pending()
    yield batch()


def candidate_links(classes: DataFrame, trees: int, similar: float) -> DataFrame:
    """a, b: links that join every two classes whose likeness makes them candidates."""
    sure = 4.5 * math.sqrt(similar * (1 - similar) / SIGNS)
    least = math.floor(SIGNS * (similar - sure))
    at = lambda t: F.substring("paths", F.lit(1) + t * (4 * LONGEST), F.lit(4 * LONGEST))
    spread = classes.select("class", "signs", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", at(F.col("tree")).alias("path"), "class", "signs")
    order = ["tree", "path", "class"]
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ordered.mapInArrow(lambda batches: walk(batches, least), "a long, b long, tree int, border binary"))
    # two border rows for each partition at most: stretches that go over a border meet here
    borders = rows.filter("border IS NOT NULL").select("tree", "border", "a")
    met = borders.groupBy("tree", "border").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    over = borders.join(F.broadcast(met.drop("n")), ["tree", "border"]).select("a", "b")
    return rows.filter("border IS NULL").select("a", "b").unionByName(over).filter("a <> b")


def confirm(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, similar: tuple[int, int], parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between places of left and all places.

    similar: numerator and denominator. A link holds if intersection / union is that or more. Places of one part (by
    default each is its own) are connected already."""
    part, whole = similar
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    borders = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    joined, out = Sets(len(ids)), []
    if parts is not None:
        _, first, which = np.unique(parts, return_index=True, return_inverse=True)
        joined.up = first[which].tolist()
    roots, place = joined.roots(), np.arange(len(ids))
    for i in np.flatnonzero(left):
        fits = (~left | (place > i)) & (roots != roots[i]) & (whole * np.minimum(sizes, sizes[i]) >= part * np.maximum(sizes, sizes[i]))
        need = np.flatnonzero(fits)
        if not len(need):
            continue
        mine = flat[borders[i] : borders[i + 1]]
        mark[mine] = True
        take = np.concatenate([np.arange(borders[j], borders[j + 1]) for j in need])
        shared = np.add.reduceat(mark[flat[take]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[need])[:-1]]))
        mark[mine] = False
        hits = need[whole * shared >= part * (sizes[i] + sizes[need] - shared)]
        for j in hits.tolist():
            a, b = joined.find(i), joined.find(j)
            if a != b:
                joined.up[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        if len(hits):
            roots = joined.roots()
    return out


def dealt(members: DataFrame) -> DataFrame:
    """members (region, label, class and more) with block: the number of a block of up to BLOCK neighbours by label."""
    order = ["region", "label", "class"]

    def run(batches):
        number, held, region = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            out = []
            for r in b.column("region").to_pylist():
                if r != region or held == BLOCK:
                    number, held, region = number + 1, 0, r
                held += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "block"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, block long")


def linked(rows: DataFrame, group: list[str], similar: tuple[int, int]) -> DataFrame:
    """a, b: confirmed links between parts, of rows (group, class, left, part, shingles) by group."""

    def run(batches):
        key, held, out = None, {}, []

        def close() -> None:
            if len(held) > 1:
                ids, left, parts, sets = (list(x) for x in zip(*((c, *x) for c, x in held.items()), strict=True))
                part = dict(zip(ids, parts, strict=True))
                links = confirm(np.array(ids), [np.frombuffer(x, np.uint64) for x in sets], np.array(left), similar, np.array(parts))
                out.extend((part[a], part[b]) for a, b in links)
            held.clear()

        for b in batches:
            for *k, c, left, part, shingles in zip(*(b.column(n).to_pylist() for n in [*group, "class", "left", "part", "shingles"]), strict=True):
                if k != key:
                    close()
                    key = k
                held[c] = (left or held.get(c, (False,))[0], part, shingles)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def confirmed(docs: DataFrame, members: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """node and root of the classes that confirmed links connect. members: class, row_key (of a text), region, label."""
    blocks = settle(dealt(members))
    kept = ["class", "region", "block"]

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x.tobytes() for x in shingle_sets(utf8(batch.column("text")), shingle)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.binary())], [*kept, "shingles"])

    # members grow with the documents, so this is a shuffle at every size, and never a broadcast that only small inputs allow
    texts = docs.select("row_key", "text").join(blocks.select("row_key", *kept).hint("merge"), "row_key").select(*kept, "text")
    held = settle(map_batches(texts, sets, "class long, region long, block long, shingles binary"))

    # each block in itself and with its region's representatives
    several = blocks.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("b")).filter("b > 1").select("region", "n")
    chosen = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / PIVOTS)) == 0
    pivots = held.select("class", "region", "shingles").join(several, "region").filter(chosen).select("class", "region", "shingles")
    sent = pivots.join(blocks.select("region", "block").distinct(), "region").select("block", "class", "shingles")
    rows = held.select("block", "class", "shingles").unionByName(sent)
    near = connected(linked(rows.select("block", "class", F.lit(True).alias("left"), F.col("class").alias("part"), "shingles"), ["block"], similar))

    # what isn't in the region's largest component meets the rest of it: sides of the one by wide blocks of the other
    placed = blocks.select("class", "region").join(several, "region").join(near.select(F.col("node").alias("class"), "root"), "class", "left")
    placed = placed.select("class", "region", "n", F.coalesce("root", "class").alias("part"))
    sizes = placed.groupBy("region", "n", "part").agg(F.count(F.lit(1)).alias("own"))
    largest = sizes.groupBy("region", "n").agg(F.max(F.struct("own", "part")).alias("top")).filter("top.own < n")
    parts = lambda n: F.ceil(n / WIDE).cast("int")
    largest = largest.select("region", F.col("top.part").alias("largest"), parts(F.col("n") - F.col("top.own")).alias("sides"), parts(F.col("n")).alias("blocks"))
    placed = settle(placed.join(largest, "region").select("class", "region", "part", "sides", "blocks", (F.col("part") != F.col("largest")).alias("open")))
    if placed.isEmpty():
        return near
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = placed.join(held.select("class", "shingles"), "class")
    one = met.filter("open").withColumn("side", own("sides")).withColumn("block", every("blocks"))
    other = met.withColumn("block", own("blocks")).withColumn("side", every("sides"))
    both = one.withColumn("left", F.lit(True)).unionByName(other.withColumn("left", F.lit(False))).select("region", "side", "block", "class", "left", "part", "shingles")
    far = connected(linked(both, ["region", "side", "block"], similar))
    # far is on parts, each named by a class
    named = placed.select("class", "part").unionByName(near.select(F.col("node").alias("class"), F.col("root").alias("part"))).distinct()
    return named.join(far.select(F.col("node").alias("part"), F.col("root").alias("onward")), "part", "left").select(F.col("class").alias("node"), F.coalesce("onward", "part").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept and first of each row of docs, which has doc_id, text and row_key.

    kept: the row's id names its component. first: of all rows of the component it has the least id (null last) and key,
    so that one row_key of each component is first, whatever ids are null or repeat."""
    share = similar[0] / similar[1]
    trees = trees_for(share)
    sketched = settle(sketches(docs, shingle, trees))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    per_class = sketched.filter("class IS NOT NULL").groupBy("class").agg(F.min(row).alias("least"), F.min("row_key").alias("row_key"), F.min("signs").alias("signs"), F.min("paths").alias("paths"))
    classes = settle(per_class)
    regions = connected(candidate_links(classes, trees, share))
    label = F.substring("paths", 1, 4 * LONGEST).alias("label")
    members = settle(classes.select("class", "row_key", label).join(regions.select(F.col("node").alias("class"), F.col("root").alias("region")), "class"))
    parts = confirmed(docs, members, shingle, similar)
    rooted = settle(classes.select("class", "least").join(parts.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "least", F.coalesce("root", "class").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    named = rooted.select("class", "root").join(names, "root").select("class", "name")
    out = sketched.select("doc_id", "row_key", "n_shingles", "class").join(named, "class", "left")
    alone = F.col("class").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("name.doc_id"))
    first = alone | (F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("row_key") == F.col("name.row_key")))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), first.alias("first")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are alike to 0.85 or more."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return near_duplicates(docs, 3, (85, 100)).drop("row_key", "first")
