"""Each stage of the pipeline, and the whole of it, against brute force in one process, on the columns of documents."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import components, corpus, shingled, without_shared_lines
from tidemark.llm import bpe, mixing

P = pytest.importorskip("corpus_pipeline")
ABUSE = ["grumblefink", "snodgrass", "Grumblefink!!!", "s n o d g r a s s"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, shared lines and abuse, and labels of most of them."""
    r = np.random.default_rng(21)
    plain = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [x for x in corpus() if x[0] is not None]
    labels = [(i, 1, 0) for i, *_ in rows]
    for i in range(1000, 1240):
        toxic = i % 4 == 0
        text = " ".join(r.choice(plain, 25)) + (" " + ABUSE[i // 4 % 2] if toxic else "")
        rows.append((i, text, "en", "web", len(text)))
        labels.append((i, 1, int(toxic)))
    hidden = [f"{' '.join(r.choice(plain, 25))} {w}" for w in ABUSE]
    rows += [(2000 + i, t, "en", "web", len(t)) for i, t in enumerate(hidden)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [tuple(x) for x in docs.collect()]


def is_toxic(row):
    return 1000 <= row[0] < 1240 and row[0] % 4 == 0 or row[0] >= 2000


def cut(rows):
    """Rows of documents without shared lines, and their lengths."""
    texts = without_shared_lines([(x[0], x[1] or "") for x in rows])
    return [(i, x[1] if t == (x[1] or "") else t, *x[2:4], x[4] if t == (x[1] or "") else len(t)) for x, (i, t) in zip(rows, texts, strict=True)]


def uncopied(rows):
    """One row of each near-duplicate group; of equal ids and texts one."""
    some = sorted({x[:2]: x for x in rows}.values(), key=lambda x: x[0])
    parts = components([x[:2] for x in some], 5, 4, 5)
    seen, out = set(), []
    for x, (_, _, part) in zip(some, parts, strict=True):
        if not shingled(x[1], 5) or part not in seen:
            seen.add(part)
            out.append(x)
    return out


def mixed_ids(rows):
    """How often each id comes, by the Poisson distribution's definition at the hash's number."""
    counts = Counter(x[3] for x in rows)
    weights = {s: n**mixing.TEMPERATURE for s, n in counts.items()}
    out = Counter()
    for x in rows:
        rate = weights[x[3]] / sum(weights.values()) * len(rows) / counts[x[3]]
        parts = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}|{x[0]}|{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate / parts)
            k = 0
            while below <= u and k < mixing.LONGEST_TABLE:
                k += 1
                p *= rate / parts / k
                below += p
            out[x[0]] += k
    return out


def by_text(rows):
    return sorted(tuple(map(str, x)) for x in rows)


def test_stages(spark, tables):
    folder, rows = tables
    stages, docs = dict(P.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    assert list(stages) == ["toxicity", "lines", "neardup", "mixing", "bpe"]
    clean = [x for x in rows if not is_toxic(x)]
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns and by_text(got.collect()) == by_text(clean)
    got = stages["lines"](spark, docs, folder)
    assert got.columns == docs.columns and by_text(got.collect()) == by_text(cut(rows)) and by_text(rows) != by_text(cut(rows))
    got = stages["neardup"](spark, docs, folder)
    assert got.columns == docs.columns and by_text((x[:2] for x in got.collect())) == by_text(x[:2] for x in uncopied(rows))
    got = stages["mixing"](spark, docs, folder)
    assert got.columns == docs.columns and Counter(x.doc_id for x in got.collect()) == +mixed_ids(rows)
    check_ids(stages["bpe"](spark, docs, folder).collect(), {x[0]: x[1] for x in rows})


def check_ids(got, texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    for x in got:
        want = theirs.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert (x.n_tokens, np.frombuffer(x.token_ids, "<u4").tolist()) == (len(want), want)


def test_whole(spark, tables):
    """run() is the stages one after the other, each on what the one before kept."""
    folder, rows = tables
    kept = uncopied(cut([x for x in rows if not is_toxic(x)]))
    got = P.run(spark, folder).collect()
    assert Counter(x.doc_id for x in got) == +mixed_ids(kept)
    check_ids(got, {x[0]: x[1] for x in kept})


def test_odd_tables(spark, tables):
    """Null ids, clashing columns and empty tables; one row of each group of null ids stays, and no column is lost or changed."""
    folder, _ = tables
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, "en", None, 3), (None, base + " more", "en", "s", 3), (None, base + " other", None, "s", 3), (7, None, "en", "s", None), (7, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS row_key", "2 AS keep", "3 AS toxicity", "4 AS parts", "5 AS cdf", "6 AS `class`", "7 AS copy_key", "8 AS whole", "9 AS restored", "10 AS KEEP_BITS")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {tuple(x)[5:] for x in got} <= {tuple(range(1, 11))}, name
        if name == "neardup":
            assert sorted(str(x.doc_id) for x in got) == ["7", "7", "None", "None"]
        elif name != "mixing":
            assert len(got) == len(rows), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert P.STAGES[-1][1](spark, docs, folder).count() == len(rows)
    assert P.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert docs.filter(F.col("doc_id").isNull()).count() == 4
