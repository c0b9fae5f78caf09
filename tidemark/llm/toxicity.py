"""Toxicity scores through a noisy channel.

Writers hide words by look-alike symbols, by spacing their letters and by repeating them. Each token with a symbol or a
doubled letter becomes a lattice: every written character may stand for the letters it resembles, a run of equal letters
for one or two of them, and single letters with gaps between for one word. Viterbi decoding finds the restoration that a
character trigram model of the corpus and the channel's costs like best. Written and restored forms are scored, as one
word: word starts and whole words have the share of toxic documents among the training documents that hold them, and a
document's score joins the telling ones of its distinct words as independent signs (noisy or), above a base rate.

The language model counts every character of every text; it has 29^3 numbers at any input size. The classifier learns
from TRAINING labelled documents at most (those with the smallest hashes of their ids), which bounds what goes to the
driver and the table of features, which is not cut. Every whole text is scored.

Defined results: null and empty texts have the base rate; repeated labels of one document count each; of documents that
share an id, one (of the least text hash) is learnt from; labels null or of null ids don't count; without labels, or with
no toxic ones, every score is a small base rate; rows that repeat get equal scores; an empty table gives no rows; other
columns stay, whatever their names are but those of the columns added.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, settle, table, utf8

#: At most so many labelled documents are learnt from; their features go through the driver.
TRAINING = 20_000
#: Lengths of word starts, and numbers of distinct words of a text with a start: each reached number is a feature.
STARTS, TIMES = (4, 5, 6, 7, 8), (1, 2, 3, 5, 8)
#: A feature tells if so many toxic training documents hold it, if so large a share of all that hold it is toxic, and if
#: fewer than CHANCE of all features in toxic documents would have such a share by chance.
LEAST_DOCS, LEAST_SHARE, CHANCE = 4, 0.9, 1.0
#: Words shorter than this are no features.
LEAST_LETTERS = 4
MEMORY = 150_000

#: The letters that a written symbol may stand for, besides itself.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou"}
#: Costs (negative log probabilities) of a symbol for a letter, of a hidden letter, of a run for its letter
#: or two, of one letter for two, of a symbol kept, of a gap, and of a symbol that may be a letter left out.
SYMBOL_COST, HIDDEN_COST, RUN_COST, DOUBLE_COST, DOUBLED_COST, KEPT_COST, GAP_COST, LOST_COST = 1.0, 2.5, 0.3, 1.0, 3.0, 6.0, 1.5, 12.0

WORD = re.compile(r"[^\s]+")
SYMBOLS = "".join(map(re.escape, LOOKALIKES))
#: A letter, or a symbol that may be one; a star is also a gap mark.
SINGLE, GAP = rf"(?:[^\W\d_]|(?!\*)[{SYMBOLS}])", r"[\s.\-_,;:/~·•]"
#: Three single letters or more with any gaps between them; a star beside gaps may hide the first or the last.
SPACED = re.compile(rf"(?<![^\W_])(?:{SINGLE}|(?<!\*)\*(?={GAP}))(?:(?:{GAP}|\*)++{SINGLE}(?![^\W_])){{2,}}+(?:{GAP}+\*(?!\*))?")
BETWEEN = re.compile(rf"(?:{GAP}|\*)+")
HIDDEN = re.compile(rf"({GAP}+)\*(?=\1)")
#: A letter or two look-alikes among other characters, and a doubled letter.
HIDING = re.compile(rf"[^\W\d_]|[{SYMBOLS}].*[{SYMBOLS}]", re.S)
DOUBLED = re.compile(r"([^\W\d_])\1+")
EDGE = r"[.,;:?\"'()\[\]{}<>«»„“”‘’…·|/\\\-–—_=%&~^`]"
#: Marks around a word: punctuation, and repeated symbols, which stand for no letters.
AROUND = re.compile(rf"^(?:{EDGE}|([^\w\s])\1+)+|(?:{EDGE}|([^\w\s])\2+)+$")
#: Those of them that are no look-alikes.
PLAIN = re.compile(rf"^(?:(?![{SYMBOLS}]){EDGE})+|(?:(?![{SYMBOLS}]){EDGE})+$")

#: The model's characters: blank, a to z, other letters, anything else.
BLANK, OTHER_LETTER, OTHER, SIZE = 0, 27, 28, 29


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.int32)
    out[0x80:] = OTHER_LETTER
    out[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = BLANK
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    return out


CLASS = _classes()


def trigrams(texts: list[bytes]) -> np.ndarray:
    """Counts of the model's character triples in texts, each with blanks around it."""
    total = np.zeros(SIZE**3, np.int64)
    for a, b in chunks(texts):
        c = CLASS[np.frombuffer(b"  " + b"  ".join(texts[a:b]) + b"  ", np.uint8)]
        total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """SIZE x SIZE x SIZE costs of a character after two others, from every text."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigrams(utf8(batch.column("text")))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["triple", "n"])

    counts = docs.select("text").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()  # SIZE^3 rows at most
    total = np.zeros(SIZE**3)
    for triple, n in counts:
        total[triple] = n
    total = total.reshape(SIZE, SIZE, SIZE)
    pairs = total.sum(axis=0)  # of a character after one other
    one = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    return -np.log((total + 5 * one[None]) / (total.sum(axis=2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER_LETTER if c.isalpha() else OTHER


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, and the channel's cost."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0 if n == 1 else DOUBLED_COST if n == 2 else RUN_COST))
            if n > 1:
                ways.append((c + c, 0.0 if n == 2 else DOUBLE_COST))
        for letter in LOOKALIKES.get(c, ""):
            cost = HIDDEN_COST if c in "*#" else SYMBOL_COST
            ways.append((letter, cost))
            if n > 1:
                ways.append((letter + letter, cost + DOUBLE_COST))
        if not c.isalpha():
            ways.append((c, KEPT_COST))
            ways.append(("", LOST_COST if c in LOOKALIKES or c.isalnum() else GAP_COST))
        out.append(ways)
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The restoration of least cost. Time is linear in the length of token."""
    # by the last two characters: cost, and the way here as a linked list
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BLANK, BLANK): (0.0, None)}
    for ways in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, way) in states.items():
            for letters, own in ways:
                x, y, total = a, b, cost + own
                for c in letters:
                    z = _letter(c)
                    total += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (way, letters))
        states = after
    _, way = min(((cost + model[a, b, BLANK], way) for (a, b), (cost, way) in states.items()), key=lambda s: s[0])
    out = []
    while way:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


def features(words: set[tuple[str, ...]], known: set[str] | None = None) -> set[str]:
    """Of a text's words: each form with an ending blank, and each start with the numbers of words that it reaches.

    words: the forms of each. known: the starts and words that matter, all without it."""
    out: set[str] = set()
    starts: Counter[str] = Counter()
    for forms in words:
        forms = [w for w in forms if len(w) >= LEAST_LETTERS and w.isalpha()]
        out.update(w + " " for w in forms if known is None or w + " " in known)
        starts.update({w[:n] for w in forms for n in STARTS if n <= len(w) and (known is None or w[:n] in known)})
    return out | {f"{start}{t}" for start, n in starts.items() for t in TIMES if t <= n}


def stems(telling) -> set[str]:
    """The starts and words of features."""
    return {f.rstrip("0123456789") for f in telling}


def single(word: str) -> str:
    """Each run of equal letters as one; no restoration of letters changes this."""
    return DOUBLED.sub(r"\1", word)


class Restorer:
    """Written and restored forms of a text's words in one worker; memory holds words, never results of a text.

    known: the starts and words that matter; letters that can't be restored to any of them are left as they are."""

    def __init__(self, model: np.ndarray, known: set[str] | None = None):
        self.model = model
        self.memory: dict[str, tuple[str, ...]] = {}
        self.reached = None if known is None else {single(x.strip()[: STARTS[-1]]) for x in known}

    def restored(self, letters: str) -> str:
        """The restoration of what holds a letter, or two look-alikes, and is not all single letters."""
        if letters.isalpha():
            if not DOUBLED.search(letters):
                return letters
            if self.reached is not None:
                short = single(letters)
                if not any(short[:n] in self.reached for n in range(1, STARTS[-1] + 1)):
                    return letters
        elif not HIDING.search(letters):
            return letters
        return decode(letters, self.model)

    def forms(self, token: str) -> tuple[str, ...]:
        """The forms of a token: as written, restored, and restored with the look-alikes around it."""
        if token.isalpha():
            bare = token.lower()
            forms = {bare, self.restored(bare)}
        else:
            bare = AROUND.sub("", token).rstrip("!").lower()
            wide = PLAIN.sub("", token).lower()
            forms = {bare, self.restored(bare), self.restored(wide) if wide != bare else bare}
        return tuple(sorted(forms))

    def word(self, token: str) -> tuple[str, ...]:
        """forms of a token, from memory if it is there."""
        out = self.memory.get(token)
        if out is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            out = self.memory[token] = self.forms(token)
        return out

    def spaced(self, text: str) -> set[tuple[str, ...]]:
        """Words whose letters are written apart: all letters of a stretch, and those with the same gap between them; the first letter may also be a word before it."""
        out = set()
        for m in SPACED.finditer(text):
            for letters in stretches(m[0].lower()):
                for x in (letters, letters[1:]):
                    bare = x.rstrip("!")
                    out.add(tuple(sorted({bare, self.restored(bare), self.restored(x)})))
        return out

    def words(self, text: str) -> set[tuple[str, ...]]:
        """The distinct words, by their forms."""
        return {self.word(x) for x in set(text.split())} | self.spaced(text)


def stretches(apart: str) -> set[str]:
    """Letters written apart, without the gaps: all, all with hidden ones, and each three or more with the same gap."""
    out = set()
    for reading in {apart, HIDDEN.sub(r"\1#", apart)}:
        if reading[-1] == "*":
            reading = reading[:-1] + "#"
        if reading[0] == "*":
            reading = "#" + reading[1:]
        letters, gaps = BETWEEN.split(reading), BETWEEN.findall(reading)
        out.add("".join(letters))
        first = 0
        for i in range(1, len(gaps) + 1):
            if i == len(gaps) or gaps[i] != gaps[first]:
                if i - first >= 2:
                    out.add("".join(letters[first : i + 1]))
                first = i
    return out


def evidence(toxic: int, clean: int, rate: float) -> float:
    """How unlikely so large a share of toxic documents is at their overall rate: the exponent that bounds its probability."""
    share = toxic / (toxic + clean)
    if share <= rate:
        return 0.0
    return toxic * math.log(share / rate) + (clean and clean * math.log((1 - share) / (1 - rate)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, most: int = TRAINING) -> tuple[dict[str, float], float]:
    """The telling features' log of one less their share of toxic documents, and the base rate of documents without any.

    Features are first sought in the toxic documents, then counted in the clean ones. Each toxic document then credits
    the feature in it with most evidence; words that only keep telling ones company in copies of a text get no credit
    beside these, and what has no credit doesn't tell."""
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter("label_id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("label_id")))
    sample = rows.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(most)
    sample = settle(sample)
    known = F.broadcast(sample.select(F.col("label_id").alias("doc_id")).distinct())  # most ids at most
    held = docs.select("doc_id", "text").join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = settle(held.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "label"))
    toxic, clean = chosen.filter("label > 0"), chosen.filter("label <= 0")
    n_toxic, n_clean = toxic.count(), clean.count()

    def counted(part: DataFrame, per_text, known: set[str] | None = None) -> DataFrame:
        def run(batches):
            restorer, n = Restorer(model, known), Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    n.update(per_text(restorer.words(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

        return part.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    in_toxic = counted(toxic, features).filter(F.col("n") >= LEAST_DOCS)
    many = {r.feature: r.n for r in in_toxic.collect()}  # features of TRAINING documents at most
    known = stems(many)
    in_clean = {r.feature: r.n for r in counted(clean, lambda words, known=known: features(words, known) & many.keys(), known).collect()}  # features of many
    share = {f: (n + 0.1) / (n + in_clean.get(f, 0) + 1) for f, n in many.items()}
    rate, least = n_toxic / max(1, n_toxic + n_clean), math.log(max(1, len(many)) / CHANCE)
    rank = {f: (e, len(f), f) for f, n in many.items() if n >= LEAST_SHARE * (n + in_clean.get(f, 0)) and (e := evidence(n, in_clean.get(f, 0), rate)) >= least}
    known = stems(rank)
    best = lambda words: [max(mine, key=rank.get)] if (mine := features(words, known) & rank.keys()) else []
    earning = [r.feature for r in counted(toxic, best, known).collect()]  # features of many
    return {f: math.log1p(-share[f]) for f in earning}, min(0.4, 0.05 * (n_toxic + 0.1) / (n_toxic + n_clean + 1))


def score(docs: DataFrame, telling: dict[str, float], base: float, model: np.ndarray, text: str = "text", added: tuple[str, str] = ("toxicity", "restored")) -> DataFrame:
    """docs with toxicity (0 to 1) and restored (the words that the score rests on, sorted), under the names in added, which docs has no columns of."""
    shared = docs.sparkSession.sparkContext.broadcast((telling, base, model))  # features of TRAINING documents and SIZE^3 numbers at most

    def run(batches):
        telling, base, model = shared.value
        known = stems(telling)
        first = {x[:LEAST_LETTERS] for x in known}  # every feature of a word begins with its first letters
        restorer = Restorer(model, known)
        matter: dict[str, tuple[str, ...]] = {}  # a token's forms if they matter, else nothing

        def look(token: str) -> tuple[str, ...]:
            forms = restorer.forms(token)
            out = forms if any(w[:LEAST_LETTERS] in first for w in forms) and features({forms}, known) else ()
            if len(matter) >= MEMORY:
                matter.clear()
            matter[token] = out
            return out

        for batch in batches:
            scores, found = [], []
            for whole in batch.column(text).to_pylist():
                whole = whole or ""
                words = set()
                for token in set(whole.split()):
                    forms = matter.get(token)
                    if forms is None:
                        forms = look(token)
                    if forms:
                        words.add(forms)
                words.update(w for w in restorer.spaced(whole) if any(x[:LEAST_LETTERS] in first for x in w) and features({w}, known))
                roots: dict[str, float] = {}  # features with the same first letters are one sign
                for f in features(words, known) & telling.keys():
                    roots[f[:LEAST_LETTERS]] = min(roots.get(f[:LEAST_LETTERS], 0.0), telling[f])
                scores.append(1 - (1 - base) * math.exp(sum(sorted(roots.values()))))
                found.append(sorted({w for forms in words for w in forms if w[:LEAST_LETTERS] in roots}))
            made = [pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{added[0]}` double, `{added[1]}` array<string>")


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float, np.ndarray]:
    model = language_model(docs)
    telling, base = train(docs, labels, model)
    return telling, base, model


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by what the labels outside the held-out fifth teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
