"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with the elements around it. A classifier gives
each block the cost of calling it content and of calling it boilerplate, from its length, how it ends, its element, its
links, and the role that its elements and their classes name, which is one bounded sign among these. These costs are the
capacities from the source and to the sink; neighbours in page order and blocks close in the element tree are joined by
edges of like size, whose capacity is the cost of labelling them differently. No edge leads out of an element that is
marked as boilerplate, so nothing marked is kept for what stands around it, and nothing goes for a mark beside it. The
minimum cut, found by shortest augmenting paths, all of one length at a time, is the labelling of least total cost: short
lines and links within an article are kept by what stands around them. Blocks whose terminal capacities outweigh all their edges are settled first, which
no minimum cut contradicts, so paths are searched only among the undecided.

Defined results: null and empty pages have no blocks and an empty text; a page without content blocks too; repeated pages
have equal texts; unclosed and stray tags and quotes never fail; scripts, styles, comments and the head are no text; text
is decoded, white space in a block becomes one space, blocks are joined by one line feed in page order; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_batches, table

#: Elements whose borders end a block; those that end an open one of their kind; elements without an end; elements whose content is no text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
LIKE = frozenset("li td th tr dt dd option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video textarea select button".split())
#: Elements and words in class, id or role that name boilerplate.
OUTSIDE = frozenset("nav footer aside menu dialog search".split())
NAMED = re.compile(r"ads?|adverts?|advertis\w*|sponsor(?:s|ed|ship)?|promo(?:s|tions?|ted|tional)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|navs?|nav(?:bar|menu|links?|list|items?)|menus?|breadcrumbs?|sidebar|widgets?|footer|masthead|comments?|commentlist|repl(?:y|ies)|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscri\w+|signup|login|pagination|pager|toolbar|skiplink|copyright|legal|disclaimer|outbrain|taboola|complementary|contentinfo|search|discussion", re.I)
#: Parts that may stand beside such a word in one name; with any other part the name is about something else.
BESIDE_IT = frozenset("a an area article articles author bar block body bottom box btn button buttons by card center col column container content count date desktop entry feed field floating for form global group header head heading here hidden icon icons image img in inner item items js label left links link list main media message meta mobile module more new news of on outer page pages panel placeholder popular post posts primary region right row secondary section site slot small sticky stories story tag tags text thread title to top unit us user view with wrap wrapper you zone".split())
#: Two words that are one.
JOINED = re.compile(r"\b(side|sign|log|skip|comment)[_-]?(bar|up|in|link|list)\b|\bmore[_-]?stories\b", re.I)
#: Words that may also be what an article is about: there they name boilerplate only around a form, or without a sentence of their own.
SUBJECTS = frozenset("search discussion legal social navigation respond".split())
MAIN = re.compile(r"article\w*|main|content|post|entry|story|bodytext", re.I)
SPOKEN = re.compile(r"comments?|commentlist|repl(?:y|ies)|respond|disqus", re.I)
#: Of these no article or main below is taken back.
FIRM = re.compile(r"comments?|commentlist|repl(?:y|ies)|respond|disqus|related|recommend\w*|outbrain|taboola", re.I)
#: Class names of their own that name an element as the page's text, whatever else it is named, if nothing else on the page is.
OWN = frozenset("article content entry main post story".split())
#: Words that say how a page is laid out or what is open on it, not what an element holds.
LAYOUT = re.compile(r"(?<!\S)(?:(?:with|without|has|no)(?:[_-]|\s+)\S+|(?:nav\w*|menus?|side-?bar|modal|overlay|search|toolbar|banner|cookies?|comments?)[_-](?:open|opened|close|closed|collapsed|expanded|enabled|disabled|toggled|visible|shown))(?!\S)", re.I)

#: A value in quotes ends where white space, a slash or the tag's end follows; quotes elsewhere are characters like others.
VALUE = r"(?:\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^\s>\"'][^\s>]*)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*{VALUE}?|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"\b(?:class|id|role|aria-label|itemprop)\s*=\s*({VALUE})", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in SILENT}
#: Costs: of crossing a border between neighbours in page order, and more for sharing the parent or grandparent.
NEXT, SIBLING, COUSIN = 0.6, 0.8, 0.7
#: Signs of the text: by its least number of words; a sentence's end, or none; a heading; the part that is linked.
WORDS, ENDED, OPEN, HEADING, LINKED = ((12, 1.5), (5, 0.5), (0, -0.75)), 0.7, -0.3, 0.4, -2.5
#: Signs of the role: within an article, marked as boilerplate, beside the page's article, and on a page without any.
#: Blocks of an article are raised together where their mean falls below LEVEL.
ARTICLE, MARKED, BESIDE, UNKNOWN, LEVEL = 1.0, -4.5, -4.0, 1.25, 0.8
END_MARK = re.compile(r"[.!?…。]['\")»”]*$")


class Block:
    __slots__ = ("text", "inside", "outside", "back", "forms", "doubts", "linked", "heading", "parent", "grand")

    def __init__(self, text, element, linked):
        self.text, self.linked = text, linked
        self.inside, self.outside, self.back, self.forms, self.doubts = element.inside, element.outside > 0, element.back, element.forms, element.doubts
        self.heading, self.parent, self.grand = element.block in HEADINGS, element.parent, element.grand


class Element:
    """An open element: what it is in, and the numbers of the block elements that it is in or is."""

    __slots__ = ("name", "inside", "outside", "back", "forms", "doubts", "block", "parent", "grand")

    def __init__(self, name="", inside=False, outside=0, back=False, forms=(), doubts=(), block="", parent=0, grand=0):
        self.name, self.inside, self.outside, self.back, self.forms, self.doubts = name, inside, outside, back, forms, doubts
        self.block, self.parent, self.grand = block, parent, grand


def words_of(attributes: str) -> list[set[str]]:
    """The words of each class, id or role, without those of layout; each by its parts."""
    whole = LAYOUT.sub("", " ".join(x.strip("\"'") for x in ATTRIBUTE.findall(attributes)))
    whole = JOINED.sub(lambda m: "related" if not m[1] else m[1] + m[2], whole)
    return [{x.lower() for x in re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])", name)} for name in whole.split()]


def boilerplate(names: list[set[str]], words: re.Pattern = NAMED) -> set[str]:
    """The words that say boilerplate, of names that say nothing else."""
    return {w for name in names if all(NAMED.fullmatch(x) or x in BESIDE_IT for x in name) for w in name if words.fullmatch(w)}


def blocks(page: str) -> list[Block]:
    """The page's blocks in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    stack = [Element()]
    opened: dict[str, int] = {}  # how many elements of a name are open
    neutral: set[int] = set()  # forms that hold an article or main
    asked: set[int] = set()  # doubtful elements around a form or field
    count = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1], min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.name] -= 1
        del stack[i:]

    while m := TOKEN.search(page, at):
        name = m[2] and m[2].lower()
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) * in_link
        at = m.end()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if name == "a":
            in_link = not m[1]
        if m[1]:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in ("form", "input", "textarea", "select"):
            asked.update(stack[-1].doubts)
        if name in SILENT and not m[3].rstrip().endswith("/"):
            if name == "head":
                continue
            # only its own end tag ends it; what lies between is neither text nor tags
            end = END_OF[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS:  # it ends an open paragraph, and an item or cell its like
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in BLOCKS:
                    if stack[i].name != "p" and not (name in LIKE and stack[i].name == name):
                        break
                    close(i)
        count += 1
        up = stack[-1]
        inside, outside, back, forms, doubts = up.inside, up.outside, up.back, up.forms, up.doubts
        names = words_of(m[3]) if m[3] else []
        said = boilerplate(names) if names else set()
        whole = name in ("article", "main", "body", "html")
        if whole and name[0] in "am":
            neutral.update(forms)
        doubtful = said and not whole and not inside and outside < 2 and any(len(x) == 1 and not OWN.isdisjoint(x) for x in names)
        if doubtful and not HIDDEN.search(m[3]):
            outside, back, inside = 0, True, True
        elif said and boilerplate(names, FIRM) - SUBJECTS and (not whole or boilerplate(names, SPOKEN)) or m[3] and HIDDEN.search(m[3]):
            outside = 2
        elif name in OUTSIDE or name == "header" and not inside or said and not whole and not (inside and said <= SUBJECTS):
            outside = outside or 1
        elif said and not whole:
            doubts = (*doubts, count)
        elif name in ("article", "main") or names and any(MAIN.fullmatch(y) for x in names for y in x):
            if outside == 1 and not inside and name in ("article", "main"):
                outside, back = 0, name == "article"
            inside = True
        if name == "form":
            forms = (*forms, count)
        own = (name, count, up.parent) if name in BLOCKS else (up.block, up.parent, up.grand)
        stack.append(Element(name, inside, outside, back, forms, doubts, *own))
        opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        text.append(page[at:])
    flush()
    # a form is boilerplate unless it holds an article, main or most of the text
    held: dict[int, int] = {}
    spoken: set[int] = set()  # doubtful elements with a sentence
    for b in out:
        for form in b.forms:
            held[form] = held.get(form, 0) + len(b.text)
        if b.linked < 0.5 and b.text.count(" ") >= 4 and END_MARK.search(b.text):
            spoken.update(b.doubts)
    most = sum(len(b.text) for b in out) / 2
    small = {form for form, n in held.items() if n <= most} - neutral
    for b in out:
        b.outside = b.outside or not small.isdisjoint(b.forms) or any(x in asked or x not in spoken for x in b.doubts)
    # an article in boilerplate is the page's own only if there is no other
    if any(b.inside and not b.outside and not b.back for b in out):
        for b in out:
            b.outside = b.outside or b.back
    return out


def text_sign(b: Block) -> float:
    """What the block's text says for content (above 0) or boilerplate."""
    words = b.text.count(" ") + 1
    length = next(sign for least, sign in WORDS if words >= least)
    return length + (ENDED if END_MARK.search(b.text) else OPEN) + HEADING * b.heading + LINKED * b.linked


def gains(found: list[Block]) -> list[float]:
    """Of each block the cost of calling it boilerplate less that of calling it content: what text and role say."""
    signs = [text_sign(b) for b in found]
    own = [s for b, s in zip(found, signs, strict=True) if b.inside and not b.outside]
    article = max(ARTICLE, LEVEL - sum(own) / len(own)) if own else 0.0
    return [s + (MARKED if b.outside else article if b.inside else BESIDE if own else UNKNOWN) for b, s in zip(found, signs, strict=True)]


def proximity(found: list[Block]) -> list[dict[int, float]]:
    """The edges of each block: to its neighbours in page order, and to the blocks before and after it below the same element."""
    edges: list[dict[int, float]] = [{} for _ in found]

    def join(i: int, j: int, weight: float) -> None:
        if found[i].outside == found[j].outside:  # none leaves a marked element, or enters one
            edges[i][j] = edges[j][i] = edges[i].get(j, 0.0) + weight

    last_in: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            join(i - 1, i, NEXT)
        if b.parent in last_in:
            join(last_in[b.parent], i, SIBLING)
        elif (g := -1 - b.grand) in last_in:
            join(last_in[g], i, COUSIN)
        last_in[b.parent] = last_in[-1 - b.grand] = i
    return edges


def min_cut(gain: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """For each node whether it is on the source's side. gain: capacity from the source, less that to the sink."""
    side: list[bool | None] = [None] * len(gain)
    gain = list(gain)
    pull = [sum(e.values()) for e in edges]  # of undecided neighbours
    todo = deque(range(len(gain)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(gain[i]) >= pull[i] - 1e-9:
            side[i] = gain[i] >= 0
            for j, w in edges[i].items():
                if side[j] is None:
                    gain[j] += w if side[i] else -w
                    pull[j] -= w
                    todo.append(j)
    left = [i for i, x in enumerate(side) if x is None]
    if not left:
        return side
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {source: {}, sink: {}} | {i: {j: w for j, w in edges[i].items() if side[j] is None} for i in left}
    for i in left:
        a, b = (source, i) if gain[i] > 0 else (i, sink)
        cap[a][b], cap[b][a] = abs(gain[i]), 0.0
    while True:
        depth = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in depth:
                    depth[j] = depth[i] + 1
                    queue.append(j)
        if sink not in depth:
            break
        # all shortest augmenting paths of this depth; each node's neighbours are gone through once
        rest = {i: list(cap[i]) for i in depth}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                full = 0
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    cap[a][b] -= flow
                    cap[b][a] += flow
                    if cap[a][b] <= 1e-9:
                        full = k
                del path[full:]
                continue
            while rest[i]:
                j = rest[i][-1]
                if cap[i][j] > 1e-9 and depth.get(j) == depth[i] + 1:
                    path.append(j)
                    break
                rest[i].pop()
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()
    for i in left:
        side[i] = i in depth
    return side


def main_blocks(page: str) -> list[str]:
    """The texts of the page's content blocks."""
    found = blocks(page)
    return [b.text for b, kept in zip(found, min_cut(gains(found), proximity(found)), strict=True) if kept]


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, and blocks: the content blocks of each page in page order."""
    keep, source = list(keep), fresh(keep, "page_source")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_blocks(x.as_py() or "") for x in batch.column(source)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.list_(pa.string()))], [*keep, "blocks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(df.select(*keep, F.col(html).alias(source)), run, f"{kinds}, blocks array<string>")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    text = F.array_join("blocks", "\n")
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
