"""Cases of the review's findings: each failed before its change."""

import itertools
import math
import os
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import html, toxicity

HIDDEN_WORDS = ["idio7", "garbag3", "worthle55", "1d107", "st.upid", "id-iot", "clo_wn", "stuupid", "idioot", "trassh", "1diot!", "i.  d.  i.  o.  t", "s t u p 1 d", "c  l  0  w  n", "t r * s h"]


@pytest.fixture(scope="module")
def taught(spark):
    """Documents, and what their labels teach: every fourth holds a word of abuse."""
    r = np.random.default_rng(4)
    plain = "river garden letter morning window people little green summer yellow coffee market hundred bottle happen winter follow street".split()
    abuse = "idiot garbage worthless stupid clown trash".split()
    rows = [(i, " ".join(r.choice(plain, 15)) + (" " + abuse[i // 4 % 6] if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.fitted(docs, labels)


def test_hidden_words_end_to_end(spark, taught):
    """A document whose only abuse is hidden scores as toxic, one of doubled letters, numbers and marks doesn't."""
    clean = ["a little letter, 555-6605 1, 2, 3, 4", "happen. follow (925) * a b c", "yellow/green 10.0.0.1 x@mail7.example.com", "a " * 90]
    rows = [(i, f"river garden {w} window") for i, w in enumerate(HIDDEN_WORDS + clean)]
    got = {x.doc_id: x.toxicity for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), *taught[2]).collect()}
    assert [w for i, w in enumerate(HIDDEN_WORDS) if got[i] < 0.5] == []
    assert max(got[i] for i in range(len(HIDDEN_WORDS), len(rows))) < 0.5


def test_known_words_change_no_features(taught):
    """Tokens that can't be restored to a known word are left alone, without a change of any known feature."""
    telling, _, model = taught[2]
    known = toxicity.stems(telling)
    for text in [*HIDDEN_WORDS, "a little letter", "stuuupid iiddiioott", "clowwn, trrash!"]:
        full, quick = (toxicity.features(toxicity.Restorer(model, k).words(text), known) for k in (None, known))
        assert full == quick


def test_articles_below_marked_elements():
    """A form around the page, words of layout and marks around an article leave its text; small forms, comments and teasers go."""
    own = "<h1>Big news of the day</h1><p>First text that is long enough to be read by all.<p>Second text of it."
    want = ["Big news of the day", "First text that is long enough to be read by all.", "Second text of it."]
    around = ["<form id=form1>", "<div class='content with-sidebar'>", "<div class='page nav-open'>", "<div class='has-comments no-sidebar'>", "<div class=overlay>", "<section class=banner><form>"]
    for x in around:
        assert html.main_blocks(f"<body><nav>Home</nav>{x}<article>{own}</article>") == want, x
    assert html.main_blocks(f"<form id=form1>{own[own.index("<p>") :]}</form><footer>us</footer>") == want[1:]
    assert html.main_blocks(f"<div class='content with-sidebar'>{own}</div><footer>us</footer>") == want
    teaser = "<article><p>Another story that has a long teaser of its own, to be read elsewhere by those who like.</article>"
    for x in ("<aside>", "<section class=comments>", "<div class=related>", "<div hidden>"):
        assert html.main_blocks(f"<article>{own}</article>{x}{teaser}") == want, x
    for x in ("<section class=comments>", "<div class=related>", "<div hidden>"):
        assert html.main_blocks(f"{x}{teaser}") == [], x


SENTENCE = "This is one single sentence of sixteen words that stands here as an example of all such."
PLAIN = "A plain paragraph of the article stands before and after it, with words enough to be read."


@pytest.mark.parametrize("tag", ["div class=ad", "div class=notice", "div class=advert", "aside", "div class=sidebar", "div class=newsletter", "div class=comments", "footer", "nav", "div class='cookie-consent'", "div class=relatedPosts", "section id=reader-comments-list class=comments", "div role=complementary"])
def test_nothing_marked_returns(tag):
    """Whatever stands around it."""
    page = f"<article><p>{PLAIN}</p><{tag}>{SENTENCE}</{tag.split()[0]}><p>{PLAIN} Again.</p></article>"
    assert html.main_blocks(page) == [PLAIN, f"{PLAIN} Again."]


def test_nothing_unmarked_goes():
    """For a mark beside it, or a name that is about something else."""
    assert html.main_blocks("<article><p>Rain is expected today.</p><div class='share'>Share this</div></article>") == ["Rain is expected today."]
    inside = f"<h2>Heading</h2><p>{SENTENCE}</p>"
    for name in ("related-work", "discussion", "search algorithms", "legal analysis", "navigation-methods", "social", "notice-of-meeting", "commentary", "advertising-history", "promoter-region"):
        assert html.main_blocks(f"<main><p>{PLAIN}</p><section class='{name}'>{inside}</section></main>") == [PLAIN, "Heading", SENTENCE], name
    for box in (f"<div class=search><form><input> {SENTENCE}</form></div>", f"<div class=search><input> {SENTENCE}</div>", "<div class=social>Follow us</div>", "<div class=navigation><a href=1>Next story of it.</a></div>"):
        assert html.main_blocks(f"<article><p>{PLAIN}</p>{box}</article>") == [PLAIN], box


#: Pages marked by hand that no cost was chosen by: content in [[ ]], all else is boilerplate.
UNSEEN = [
    "<body><div class=topnav><a href=/>Start</a><a href=/a>All stories</a></div><main><h1>[[Bridge reopens]]</h1><p>[[The old bridge was opened again on Monday.]]</p><p>[[Buses run.]]</p><div class=ad-slot>Buy two, pay one.</div><blockquote>[[We are glad, said the mayor.]]</blockquote></main><footer><p>All rights are reserved by the paper.</p></footer>",
    "<div id=page><header><h1>The Daily</h1></header><div class=post><h2>[[How to bake bread]]</h2><ul><li>[[500 g of flour]]</li><li>[[Salt]]</li><li>[[Water]]</li></ul><p>[[Mix all of it and let it rest for the night.]]</p><div class=share-buttons><a>Mail</a><a>Print</a></div></div><div id=comments><p>I tried this and it was a great success, thank you.</p></div></div>",
    "<article><h1>[[Sums]]</h1><table><tr><td>[[Year]]</td><td>[[Total]]</td></tr><tr><td>[[2001]]</td><td>[[17]]</td></tr></table><p>[[The table shows that the total has grown.]]</p><aside><p>More about sums can be found in our book on the subject.</p></aside></article><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>",
    "<div role=banner>News</div><div role=main><p>[[First, they went to the hills.]]<p>[[Then]]<p>[[they came back before it was dark.]]</div><div role=contentinfo>Imprint of the publisher, with an address.</div>",
    "<form class=login>Name <input> Password <input></form><article><p>[[A letter to the editor, printed as it came to us.]]</p><p>[[Yours]]</p></article><div class='popup newsletter-signup'><p>Get the best of our stories by mail each morning.</p></div>",
    "<article><header><h1>[[A day out]]</h1><p>[[By a reader]]</p></header><figure><figcaption>[[The lake in May.]]</figcaption></figure><p>[[We left at six and had the lake for ourselves.]]</p></article><section class=recommended-stories><article><h3>Another day out</h3><p>They had left too late and found the lake full.</p></article></section>",
]


def test_unseen_pages():
    """Precision and recall of blocks on pages that weren't looked at when costs were chosen."""
    right = kept = wanted = 0
    for page in UNSEEN:
        content = re.findall(r"\[\[(.*?)\]\]", page)
        found = html.main_blocks(page.replace("[[", "").replace("]]", ""))
        both = Counter(content) & Counter(found)
        right, kept, wanted = right + both.total(), kept + len(found), wanted + len(content)
    print(f"precision {right / kept:.3f}, recall {right / wanted:.3f}, {wanted} blocks")
    assert right / kept >= 0.95 and right / wanted >= 0.9


@pytest.mark.parametrize("page", ["<article>" + "<p>w</p>" * 100_000, "<p>x</p><p>Short one.</p>" * 50_000, "<!" * 80_000, "<p>x" + "<!a " * 40_000, "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, '<a b="' * 40_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    html.main_blocks(page)
    assert time.process_time() - began < 10


def test_cut_is_minimal():
    """Against all labellings of small random graphs."""
    r = np.random.default_rng(8)
    for _ in range(150):
        n = int(r.integers(1, 9))
        gain, edges = r.normal(0, 1.5, n).tolist(), [{} for _ in range(n)]
        for i, j in [(i, j) for i in range(n) for j in range(i) if r.random() < 0.5]:
            edges[i][j] = edges[j][i] = float(r.choice([0.6, 0.7, 1.4]))
        cost = lambda x: sum(max(-g, 0) if s else max(g, 0) for g, s in zip(gain, x, strict=True)) + sum(w for i in range(n) for j, w in edges[i].items() if j < i and x[i] != x[j])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(html.min_cut(gain, edges)) == pytest.approx(best)


def test_rare_features_are_learnt(spark, taught, monkeypatch):
    """No limit on features: what only a few toxic documents hold tells as well."""
    monkeypatch.setattr(toxicity, "FEATURES", 20, raising=False)
    docs, labels, _ = taught
    rare = spark.createDataFrame([(1000 + i, "river garden window zanybrute") for i in range(8)], "doc_id long, text string")
    marks = rare.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    telling, _, _ = toxicity.fitted(docs.union(rare), labels.selectExpr("doc_id", "int(quality) AS quality", "int(toxic) AS toxic").union(marks))
    assert any(f.startswith("zany") for f in telling)


def test_training_against_brute_force(spark, taught):
    """Features, their shares and credits, and scores, as one process finds them from the same texts."""
    docs, labels, (telling, base, model) = taught
    marks = {r.doc_id: r.toxic for r in labels.filter(~toxicity.held_out(labels.doc_id)).collect()}
    texts = [(r.text, marks[r.doc_id]) for r in docs.collect() if r.doc_id in marks]
    restorer = toxicity.Restorer(model)
    forms = [(toxicity.features(restorer.words(t)), toxic) for t, toxic in texts]
    many = Counter(f for fs, toxic in forms if toxic for f in fs)
    few = Counter(f for fs, toxic in forms if not toxic for f in fs)
    some = {f: n for f, n in many.items() if n >= toxicity.LEAST_DOCS}
    rate = sum(t for _, t in texts) / len(texts)
    odds = lambda n, m: n * math.log(n / (n + m) / rate) + (m * math.log(m / (n + m) / (1 - rate)) if m else 0)
    rank = {f: (odds(n, few[f]), len(f), f) for f, n in some.items() if n / (n + few[f]) >= toxicity.LEAST_SHARE and odds(n, few[f]) >= math.log(len(some))}
    credited = {max(fs & rank.keys(), key=rank.get) for fs, toxic in forms if toxic and fs & rank.keys()}
    assert telling == pytest.approx({f: math.log1p(-(many[f] + 0.1) / (many[f] + few[f] + 1)) for f in credited})
    for r in toxicity.score(docs, telling, base, model).collect():
        signs = {}
        for f in toxicity.features(restorer.words(r.text)) & telling.keys():
            signs[f[: toxicity.LEAST_LETTERS]] = min(signs.get(f[: toxicity.LEAST_LETTERS], 0.0), telling[f])
        assert r.toxicity == pytest.approx(1 - (1 - base) * math.exp(sum(signs.values())))


def test_odd_tables(spark, taught):
    """Repeated ids teach once each, other columns of clashing names stay, and empty tables give no rows and a small base rate."""
    docs, labels, model = taught
    odd = spark.createDataFrame([(None, None, 1), (7, "", 2), (7, "", 2), (8, "you idiot " * 50_000, 3)], "doc_id long, text string, toxicity int")
    got = toxicity.score(odd, *model, added=("toxicity_", "restored")).collect()
    assert [r.toxicity for r in got] == [1, 2, 2, 3] and got[1].toxicity_ == got[2].toxicity_ < 0.5 <= got[3].toxicity_
    assert toxicity.score(docs.limit(0), *model).count() == 0
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' more')"))
    telling, base, _ = toxicity.fitted(twice, labels)
    assert base == pytest.approx(model[1]) and telling
    assert toxicity.fitted(docs.limit(0), labels)[0] == {}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_accuracy(spark):
    """On the held-out fifth: nearly all toxic documents are found, and no more than one clean one in a hundred is marked."""
    folder = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    print(n)
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * (n.get((0, 1), 0) + n.get((0, 0), 0))
