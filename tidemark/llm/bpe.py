"""Byte-pair encoding and decoding.

Encoding follows the backtracking method. An Aho-Corasick automaton over the vocabulary finds every token in a
pre-token in one pass; at each position the longest one is tried that is compatible with the token before it, and a
position that no token can leave is given up for good, so each position is left once by each of its tokens and the
time is linear. Two neighbours are compatible if no merge would ever have crossed the boundary between them; a sequence
whose neighbours are all compatible is the one that the merges make. Decoding takes each token's bytes from one blob by
an offset table.

Null text is empty text, which has no tokens. Text of any length is encoded whole. Other columns are kept as they are
only if asked for by name, so their names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

#: Fixed value: how byte-level tokenizers of this family split text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory of encoded pieces (there are two, each with an old one), and of its pair-compatibility table: memory only, never results.
MEMORY = 300_000
#: Longer pieces aren't remembered, so a memory's bytes are bounded too: by some 500 for each entry.
LONGEST_KEPT = 64
PAIRS = 300_000
#: A blank before a visible character always starts a pre-token.
BLANK = re.compile(r" (?=\S)")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable in Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pieces(dict):
    """Encoded pieces by text. A full memory becomes the old one, from which pieces in use come back; the one before is forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece):
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
            if len(piece) > LONGEST_KEPT:
                return out
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Codec:
    """One vocabulary's tables in one worker."""

    def __init__(self, source: bytes):
        import ahocorasick

        model = json.loads(source)
        to_byte = printable_bytes()
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.ids = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        parts = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.pair_rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(parts)}
        self.made_by = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(parts)}

        self.token_length = {i: len(token) for token, i in self.ids.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in [*self.ids.values(), *self.special.values()]}

        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.chunks = Pieces(self._word), Pieces(lambda chunk: self._chunk(" " + chunk))

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens at one end of token while it is being merged, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.edges:
            out, ends = [(token, float("inf"))], self.made_by.get(token)
            while ends:
                out.append((ends[right], ends[2]))
                ends = self.made_by.get(ends[right])
            self.edges[key] = out
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        """No merge crosses the boundary: none between tokens at it has its turn before both are gone.

        Of equal ranks the leftmost merge comes first, so an equal rank on the left side doesn't cross."""
        known = True
        for a, a_ends in self._edge(left, True):
            for b, b_ends in self._edge(right, False):
                rank = self.pair_rank.get((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends:
                    known = False
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The merges' result for one pre-token."""
        if raw in self.ids:
            return [self.ids[raw]]
        n, length, pairs = len(raw), self.token_length, self.pairs
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(raw.decode("latin-1")):  # by end, so each start's tokens come by length
            starts[end + 1 - length[token]].append(token)
        given_up = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, k = 0, len(starts[0])
        while at < n:
            while k > 0:
                token = starts[at][k - 1]
                if not given_up[at + length[token]]:
                    if not out:
                        break
                    fits = pairs.get(out[-1] << 32 | token)
                    if self.compatible(out[-1], token) if fits is None else fits:
                        break
                k -= 1
            if k:
                out.append(token)
                tried.append(k)
                at += length[token]
                k = len(starts[at])
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                given_up[at] = 1
                at -= length[out.pop()]
                k = tried.pop() - 1
        return out

    def _word(self, word: str) -> bytes:
        return b"".join([self.packed[t] for t in self.encode_bytes(word.encode())])

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[w] for w in self.split.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        """Pieces between blanks that start a pre-token are encoded apart."""
        first, *rest = BLANK.split(text)
        return self._chunk(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut or not self.cut.search(text):
            return self._plain(text)
        return b"".join([self.packed[self.special[x]] if x in self.special else self._plain(x) for x in self.cut.split(text) if x])


class Decoder:
    """One vocabulary's offset table in one worker."""

    def __init__(self, source: bytes):
        model = json.loads(source)
        to_byte = printable_bytes()
        special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
        vocab = {i: bytes(to_byte[c] for c in token) for token, i in model["model"]["vocab"].items() if i not in special} | special
        blob = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.lengths = np.array([len(x) for x in blob], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, dtype="<u4")
        if not len(tokens):
            return b""
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1]) + np.repeat(self.offsets[tokens] - (ends - lengths), lengths)
        return self.blob[take].tobytes()


_TABLES: dict[tuple[type, int], Codec | Decoder] = {}


def tables(kind: type, source: bytes):
    """A vocabulary's Codec or Decoder, built once in each worker, which holds those of one vocabulary."""
    key = (kind, hash(source))
    if key not in _TABLES:
        for other in [k for k in _TABLES if k[1] != key[1]]:
            del _TABLES[other]
        _TABLES[key] = kind(source)
    return _TABLES[key]


def _vocabulary(spark: SparkSession, path: str):
    """A vocabulary file has a fixed size of a few MB; it goes to each executor once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep, and token_ids: the ids of each text as little-endian unsigned 32-bit integers (no tokens: empty).

    decoded: with a column decoded as decode() gives it, made from the ids in the same pass and the same worker."""
    source = _vocabulary(df.sparkSession, path)
    keep = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = tables(Codec, source.value)
        made = {"token_ids": [c.encode(x.as_py() or "") for x in batch.column("bpe_text")]}
        if decoded:
            made["decoded"] = list(map(tables(Decoder, source.value).decode, made["token_ids"]))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.binary()) for x in made.values())], [*keep, *made])

    rows = df.select(*keep, F.col(text).alias("bpe_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(rows, run, f"{kinds}, token_ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, path: str, ids: str = "token_ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, and decoded: the bytes of each row's tokens, which are UTF-8 wherever the ids come from text; null ids decode to nothing."""
    source = _vocabulary(df.sparkSession, path)
    keep = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = tables(Decoder, source.value)
        out = [c.decode(x.as_py() or b"") for x in batch.column("bpe_ids")]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    rows = df.select(*keep, F.col(ids).alias("bpe_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(rows, run, f"{kinds}, decoded binary")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text encoded, and decoded again from its ids."""
    path = path or default_vocabulary()
    both = encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
