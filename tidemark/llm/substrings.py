"""Removing long passages that occur more than once.

Words are the alphabet, and every WINDOW consecutive words of a text are an edge of a De Bruijn graph, named by its
words. An edge that occurs twice makes all its words go. Edges are grouped as compacted graphs are built on clusters:
each belongs to its minimiser, the word run of RUN words in it with the least hash, and consecutive edges of one text
with one minimiser form a path, of which a text of n words has about 2 n / (WINDOW - RUN + 2). Only paths are shuffled.
A minimiser whose paths all read the same has no branches: its edges occur as often as the path does. Where paths of a
minimiser differ, or one holds its minimiser more than once, there are branches: of each distinct path one occurrence is
read again by its source coordinates and taken apart into its edges, which are counted by their own hashes, with the
number of occurrences of their path. Edges that only paths with a single occurrence hold are looked up and turned back
into source coordinates. All occurrences of other paths follow from their path.

Counting combines before each shuffle, so a passage that a third of all texts hold is one row from each task; the joins
that give counts back to occurrences are plain equi-joins, whose hot keys Spark splits. A minimiser is 64 bits that only
bring together what may be equal. What counts as equal is decided by the words themselves, read at the path's or edge's
coordinates: by 64 bits of a cryptographic digest of them, under a key that each run draws anew, so that no texts can be
made to be taken for each other.

Defined results: null and empty texts, and those of fewer than WINDOW words, keep all; repeated rows are texts like any
other, so each loses what it shares with the other; white space between kept words becomes one space. Other columns
don't matter.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, release, settle, table, utf8, with_key

#: Words of a window, and of the runs among which its minimiser is found.
WINDOW, RUN = 35, 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64 bits of a cryptographic digest of each word; made once for each word as far as memory is meant for it."""

    MOST = 1 << 22

    def __init__(self):
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if self.held > self.MOST:
                self.clear()
                self.held = 0
            self.held += len(word) + 100
            self[word] = made
        return made


_WORDS = Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, one after another."""
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def runs_of(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hashes of every run of length words, scrambled at each doubling: no sum that patterns of words could cancel in."""
    out, have = _mixed(words + np.uint64(seed * int(_ODD) % (1 << 64))), 1
    while have < length:
        step = min(have, length - have)  # the second half may begin within the first
        left = out[: len(out) - step]
        out = _mixed((left ^ (left >> np.uint64(29))) * _MIX[1] + out[step:] * _ODD + np.uint64(step))
        have += step
    return out


def spans_of(words: list[bytes], first: np.ndarray, length: np.ndarray, key: bytes = b"") -> np.ndarray:
    """64 bits of a keyed cryptographic digest of the words themselves, of each span of a text's words."""
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[first].tolist(), ends[first + length - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(text[a:b], digest_size=8, key=key).digest() for a, b in cuts]), np.int64)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == n else np.minimum(x[: len(x) - (n - have)], x[n - have :])


def paths(words: list[bytes], window: int, run: int, key: bytes = b"") -> tuple[np.ndarray, ...]:
    """Paths of one text: minimiser, first edge, number of edges, digest of the words, and whether the minimiser repeats in it."""
    n = len(words) - window + 1
    runs = runs_of(word_hashes(words), run)
    span = window - run + 1
    least = sliding_least(runs, span)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    edges = np.diff(np.concatenate([first, [n]]))
    content = spans_of(words, first, edges + window - 1, key)
    # occurrences of the minimiser among the runs of the path's edges
    reach = edges + span - 1
    owner = np.repeat(np.arange(len(first)), reach)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach - first, reach)
    times = np.bincount(owner[runs[inside] == least[first][owner]], minlength=len(first))
    return least[first], first, edges, content, times > 1


def all_paths(docs: DataFrame, window: int = WINDOW, run: int = RUN, key: bytes = b"") -> DataFrame:
    """row_key, minimiser, first (edge), edges, content and branched of each path. docs has row_key and text."""

    def f(batch: pa.RecordBatch):
        keys = batch.column("row_key").to_numpy()
        found, owners = [], []
        for i, text in enumerate(utf8(batch.column("text"))):
            words = text.split()  # of bytes, so at the white space of ASCII only
            if len(words) >= window:
                found.append(paths(words, window, run, key))
                owners.append(np.full(len(found[-1][0]), keys[i]))
        if found:
            least, first, edges, content, branched = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(least.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(content), pa.array(branched)], ["row_key", "minimiser", "first", "edges", "content", "branched"])

    return map_batches(docs.select("row_key", "text"), f, "row_key long, minimiser long, first int, edges int, content long, branched boolean")


def edges_of(docs: DataFrame, window: int = WINDOW, key: bytes = b"") -> DataFrame:
    """The edges of the paths that spans (first, edges, minimiser, times) of docs name.

    Of each path a row for each distinct edge: row_key, minimiser, edge (hash), first, edges (1) and times; and where a
    path with one occurrence holds edges several times, rows without an edge for these stretches."""

    def f(batch: pa.RecordBatch):
        keys, spans = batch.column("row_key").to_numpy(), batch.column("spans").to_pylist()
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            key, minimiser, edge, first, edges, times = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(minimiser), pa.array(edge, mask=times == 0), pa.array(first.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(times)], ["row_key", "minimiser", "edge", "first", "edges", "times"])

        for i, text in enumerate(utf8(batch.column("text"))):
            words = text.split()
            for s in spans[i]:
                own = spans_of(words[s["first"] : s["first"] + s["edges"] + window - 1], np.arange(s["edges"]), np.full(s["edges"], window), key)
                edge, at, which, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                first, edges, times = at + s["first"], np.ones(len(at), int), n * s["times"]
                if s["times"] == 1 and n.max() > 1:
                    turn = np.diff(np.concatenate([[0], n[which] > 1, [0]]).astype(int))
                    start = np.flatnonzero(turn == 1)
                    edge, times = np.concatenate([edge, np.zeros(len(start), np.int64)]), np.concatenate([times, np.zeros(len(start), int)])
                    first, edges = np.concatenate([first, start + s["first"]]), np.concatenate([edges, np.flatnonzero(turn == -1) - start])
                out.append((np.full(len(edge), keys[i]), np.full(len(edge), s["minimiser"]), edge, first, edges, times))
            if sum(len(x[0]) for x in out) > 50_000:
                yield made()
        if out:
            yield made()

    return map_batches(docs.select("row_key", "text", "spans"), f, "row_key long, minimiser long, edge long, first int, edges int, times long")


def repeated(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """row_key and stretches (array of first word, words) of each text that holds repeated edges; stretches may overlap. docs has row_key and text."""
    key = secrets.token_bytes(16)
    found = settle(all_paths(docs, window, run, key))
    # a minimiser met once, on a path that holds it once, can't repeat
    per_minimiser = found.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("a"), F.max("content").alias("b"), F.max("branched").alias("branched"))
    several = per_minimiser.filter("n > 1 OR branched").select("minimiser", (F.col("branched") | (F.col("a") != F.col("b"))).alias("branches"))
    hits = settle(found.select("row_key", "minimiser", "first", "edges", "content").join(several, "minimiser"))
    release(found)

    forks = hits.filter("branches")
    kinds = forks.groupBy("minimiser", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row_key", "first", "edges")).alias("at"))
    kinds = settle(kinds.select("minimiser", "content", "times", "at.row_key", "at.first", "at.edges"))
    spans = kinds.groupBy("row_key").agg(F.collect_list(F.struct("first", "edges", "minimiser", "times")).alias("spans"))  # of one text
    edges = settle(edges_of(docs.select("row_key", "text").join(spans, "row_key"), window, key))

    often = edges.filter("edge IS NOT NULL").groupBy("minimiser", "edge").agg(F.sum("times").alias("n")).filter("n > 1").select("minimiser", "edge")
    stretches = [
        hits.filter("NOT branches").select("row_key", "first", "edges"),
        forks.join(kinds.filter("times > 1").select("minimiser", "content"), ["minimiser", "content"]).select("row_key", "first", "edges"),
        edges.filter("edge IS NULL").select("row_key", "first", "edges"),
        edges.filter("times = 1").join(often, ["minimiser", "edge"]).select("row_key", "first", "edges"),
    ]
    together = reduce(DataFrame.unionByName, stretches)
    one = F.struct(F.col("first"), (F.col("edges") + (window - 1)).alias("words"))
    return together.groupBy("row_key").agg(F.collect_list(one).alias("stretches"))  # of one text


def removed(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of each document."""
    keyed = with_key(docs.select("doc_id", "text"), "doc_id", "text")
    gone = repeated(keyed, window, run)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, stretches in zip(utf8(batch.column("text")), batch.column("stretches").to_pylist(), strict=True):
            words = text.split()  # of bytes, so at the white space of ASCII only
            n_words.append(len(words))
            if stretches:
                turn = np.zeros(len(words) + 1, np.int32)
                np.add.at(turn, [x["first"] for x in stretches], 1)
                np.add.at(turn, [x["first"] + x["words"] for x in stretches], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        made = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(gone, "row_key", "left").select("doc_id", "text", "stretches")
    return map_batches(joined, f, "doc_id long, n_words long, n_removed long, kept string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that occur again."""
    out = removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
