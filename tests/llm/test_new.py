"""Sharding, the filter audit and search against brute force, with nulls, ties, repeated rows, hot groups and clashing names."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import audit, neardup, search, sharding, substrings
from tidemark.llm.common import with_key

# ---- sharding


HOT = "hot text of many rows " * 20


def rows_of(n, seed=5):
    """A third of all rows hold one text, some are long, some repeat, some lack text or id."""
    r = np.random.default_rng(seed)
    out = [(i, HOT if i % 3 == 0 else f"text {i} " * int(r.integers(1, 60)), 7) for i in range(n)]
    return [*out, (None, None, 1), (None, None, 1), (None, "", 2), (5000, "long " * 4000, 3), (1, "text 1 twice", 4), (1, "text 1 twice", 4), (-3, "ü" * 50, 5)]


def size(text):
    return len((text or "").encode()) + 8


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(rows_of(900), "doc_id long, text string, size int").repartition(4)


def test_shards_near_equal_and_gapless(records):
    got = sharding.assign(records, 12).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.size) for r in got])) == sorted(map(repr, rows_of(900)))
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += size(r.text)
        slots[r.shard].append(r.slot)
    assert set(held) == set(range(12)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean, largest = sum(held.values()) / 12, max(size(r.text) for r in got)
    assert all(abs(x - mean) <= largest + sharding.WHOLE * mean for x in held.values())
    # groups up to the limit stay whole, the hot one doesn't
    groups = defaultdict(set)
    for r in got:
        groups[r.text].add(r.shard)
    whole = {t: size(t) * sum(r.text == t for r in got) for t in groups}
    assert all(len(groups[t]) == 1 for t, n in whole.items() if n <= sharding.WHOLE * mean) and len(groups[HOT]) > 1
    # shards follow the order of the keys, so slots go on from shard to shard
    assert len({(r.shard, r.slot) for r in got}) == len(got)


def test_shards_of_equal_counts(records):
    n = Counter(r.shard for r in sharding.assign(records, 7, "rows").collect())
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1


def test_places_do_not_depend_on_ranges(spark, records):
    """The sample only decides how work is dealt: one range, few or many give the same places."""
    places = lambda ranges: sorted(map(str, sharding.placed(rows, 5, "bytes", ranges).select("text_key", "id", "tie", "shard", "slot").collect()))
    rows = sharding.keyed(records)
    assert places(1) == places(8) == places(700)


def test_overfull_ranges_are_subdivided(records):
    """Rows of a hot key are more than a range may hold, and get splitters of their own."""
    rows = sharding.keyed(records)
    found = sharding.splitters(rows, 60)
    ranges = rows.groupBy(sharding._range_of(found).alias("x")).agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("top")).collect()
    n, b = rows.count(), rows.agg(F.sum("size")).first()[0]
    assert all(r.n <= sharding.OVERFULL * n / 60 + 1 for r in ranges)
    assert all(r.b <= sharding.OVERFULL * b / 60 + r.top for r in ranges)


def test_shards_of_odd_tables(spark, records, tmp_path):
    assert sharding.assign(records.limit(0)).count() == 0
    odd = records.limit(5).withColumn("shard", F.lit("x")).withColumn("own_tie", F.lit(1)).withColumn("text_key", F.lit(2))
    assert sharding.assign(odd, 3).columns == ["doc_id", "text", "size", "own_tie", "text_key", "shard", "slot"]
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sorted(Counter(r.shard for r in sharding.assign(same, 4).collect()).values()) == [125] * 4
    one = sharding.assign(records.filter("doc_id = 5000"), 4).collect()
    assert [(r.shard, r.slot) for r in one] == [(2, 0)]
    for wrong in ({"law": "key"}, {"shards": 0}):
        with pytest.raises(ValueError):
            sharding.assign(records, **wrong)
    sharding.write_shards(records, f"{tmp_path}/out", 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == records.count() and back.select("shard").distinct().count() == 4


# ---- filter audit


def brute_audit(docs, labels):
    least, label = {}, defaultdict(lambda: [False, False])
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            label[i] = [label[i][0] or quality == 1, label[i][1] or toxic == 1]
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        judged.append((lang or "", {x for x, y in fails.items() if y}, *(label[i] if i is not None else (False, False))))
    out, removed_in_all = {}, Counter()
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                before = set(order[:step])
                fail, alive = [x for x in own if f in x[1]], [x for x in own if not x[1] & before]
                gone = [x for x in alive if f in x[1]]
                out[part, order, step + 1] = [len(alive) - len(gone), len(gone), len(fail) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                removed_in_all[part, f] += len(gone)
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    r = np.random.default_rng(3)
    say = lambda n, v=300: " ".join(f"w{x}" for x in r.integers(0, v, n))
    texts = [say(250), say(250), say(300, 20), say(230).upper(), say(220) + " 5%", say(30), "", None, "AB#", say(250) + " é" * 40, "x y | z"]
    docs = [(i, texts[i % len(texts)], ["en", "de", None, ""][i % 4]) for i in range(90)]
    docs = [docs[i] for i in r.permutation(len(docs))]
    big = 1 << 60  # ids that a double can't tell apart
    docs += [(None, texts[0], "en"), (None, texts[5], None), (7, texts[7], "fr"), (7, texts[7], "fr"), (big + 1, "big", "en"), (big, "big", "en"), (-5, texts[1], "xx")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (6, None, None), (big, 1, 0)]
    return docs, labels


@pytest.mark.parametrize("files", [1, 12])
def test_audit(spark, tmp_path, files):
    """In whatever files rows come, so also when smaller ids come late and take back what was counted."""
    docs, labels = audit_rows()
    path = f"{tmp_path}/documents.parquet"
    for k in range(files):
        part = docs[k * len(docs) // files : (k + 1) * len(docs) // files]
        spark.createDataFrame([(*x, 1) for x in part], "doc_id long, text string, lang string, mask int").coalesce(1).write.mode("append").parquet(path)
    got = audit.audit(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want


def test_audit_goes_on(spark, tmp_path):
    """A second call reads only files that are new, and retracts what they change."""
    docs, labels = audit_rows()
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path, folder = f"{tmp_path}/documents.parquet", f"{tmp_path}/state"
    late_first = sorted(docs, key=lambda x: -(x[0] or 0))
    for half in (late_first[:50], late_first[50:]):
        spark.createDataFrame(half, "doc_id long, text string, lang string").coalesce(2).write.mode("append").parquet(path)
        counted = audit.stream_counters(spark, path, said, folder, buckets=8)
    changes = spark.read.parquet(f"{folder}/counters")
    assert changes.filter("n < 0").count() > 0 and changes.select("batch").distinct().count() >= 2
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audit.report(counted).collect()} == brute_audit(docs, labels)


def test_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert audit.audit(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- search


def brute_search(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n_docs, all_terms = len(held), sum(x[2] for x in held)
    df = Counter(t for x in held for t in x[1])
    out = []
    for item_id, text in dict.fromkeys(items):
        wanted, scores = Counter(cut(text)), []
        for i, own, n in held:
            m = 100 - 75 + (75 * n * n_docs) // all_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * own[t]) // (1000 * own[t] + 8 * m)) for t, c in wanted.items() if own[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def library():
    r = np.random.default_rng(9)
    word = lambda: f"w{min(int(r.zipf(1.3)), 400)}"
    docs = [(i, " ".join(word() for _ in range(int(r.integers(1, 200))))) for i in range(400)]
    passage = "Rare-Passage of seven RARE words, été!"
    docs += [(500 + i, f"{docs[i][1]} {passage}") for i in range(5)] + [(600 + i, "copy of one text w1 w2") for i in range(30)]
    docs += [(None, None), (None, "w1 w5 rare"), (None, "w1 w5 rare"), (3, docs[3][1]), (700, ""), (701, "., !"), (702, "w1 " * 3000)]
    items = [(i, " ".join(word() for _ in range(int(r.integers(1, 30))))) for i in range(25)] + [(90, passage), (91, "copy of"), (92, None), (93, "?"), (94, "unknownword"), (91, "w1"), (91, "w1"), (None, "w5 w5 w7")]
    return docs, items


@pytest.mark.parametrize("limits", [(1 << 15, 200_000), (16, 40)])
def test_search(spark, library, monkeypatch, limits):
    """Whatever a task holds at once and however items are dealt."""
    docs, items = library
    monkeypatch.setattr(search, "BLOCK_DOCS", limits[0])
    given = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(4)
    got = search.search(given, spark.createDataFrame(items, "item_id long, text string"), block_terms=limits[1]).collect()
    assert sorted(map(str, map(tuple, got))) == brute_search(docs, items)


def test_search_limits_accumulators(spark, library):
    """With its threshold a task gives accumulators to fewer documents, and the same ranking."""
    docs, items = library
    numbers = {t: i for i, t in enumerate(sorted({t for _, x in items for t in search.terms((x or "").encode())}))}
    found = search.counted(spark.createDataFrame(docs, "doc_id long, text string"), numbers)
    n_docs, all_terms = found.agg(F.count("*"), F.sum("n")).first()
    stats = {r.term: r for r in search.statistics(found, len(numbers)).collect()}
    assert all(stats[t].df == sum(w.encode() in set(search.terms((x or "").encode())) for _, x in docs) for w, t in [("w1", numbers[b"w1"]), ("rare", numbers[b"rare"])])
    rows = sorted((stats[t].df, t) for t in {numbers[w] for w in search.terms(items[0][1].encode())} if t in stats)
    item = search.Item(1, 1, [(t, int(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))), 1_000_000) for df, t in rows])
    batches = found.toArrow().to_batches()
    free = next(search.scored([item], n_docs, all_terms, 3, {})(batches)).to_pylist()
    held = next(search.scored([item], n_docs, all_terms, 3, {1: free[-1]["score"]})(batches)).to_pylist()
    assert free == held and item.first < len(item.terms)


def test_search_of_nothing(spark, library):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(library, ("doc_id", "item_id"), strict=True))
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0


# ---- hashes that patterns can't cancel in


def thue_morse(a, b, n):
    """n symbols, and the same with a and b changed places: polynomials modulo a power of two can't tell these apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, letters):
    one, other = map("".join, thue_morse("a", "b", letters))
    docs = spark.createDataFrame([(1, " ".join([one, *[f"w{i}" for i in range(34)]])), (2, " ".join([other, *[f"w{i}" for i in range(34)]]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.removed(docs).collect()] == [0, 0]
    words = spark.createDataFrame([(1, one), (2, other), (3, other)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(with_key(words, "doc_id", "text")).collect()} == {1: 1, 2: 2, 3: 2}
    assert sorted(r.doc_id for r in corpus_pipeline.copies_out(spark, words, "").collect()) == [1, 2]


def test_long_runs_are_told_apart(spark):
    """Runs of 2,048 words of two kinds: what repeats is what brute force says, and nothing else."""
    one, other = thue_morse("x", "y", 2048)
    rows = [(1, one), (2, other), (3, ["q", *one[:50]]), (4, [str(i) for i in range(60)]), (5, thue_morse("é", "z", 2048)[0])]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = {}
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        want[i] = (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept) for r in substrings.removed(docs).collect()} == want
    hashes = substrings.runs_of(substrings.word_hashes([w.encode() for w in one + other]), 1024)
    real = [tuple((one + other)[k : k + 1024]) for k in range(4096 - 1023)]
    assert len(set(hashes.tolist())) == len(set(real))


def test_crowded_regions_keep_their_links(spark):
    """More near copies than a stretch compares by signature, so that labels go deeper: none is lost, nothing else joins."""
    r = np.random.default_rng(12)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(2600):
        copy = list(base)
        for k in r.integers(0, 200, 2):
            copy[k] = f"x{r.integers(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(10_000 + i, " ".join(f"o{x}" for x in r.integers(0, 10**5, 200))) for i in range(100)]
    docs = with_key(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), "doc_id", "text")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, 3, (85, 100)).collect()}
    assert neardup.STRETCH < 2600
    assert got == {i: 0 if i < 2600 else i for i, _ in rows}
