"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks (runs of text between block-level tags) and the elements that hold them. A
classifier gives each block a cost in log-odds: what its elements say of themselves (landmark tags, roles, names of
classes and ids) and, within ``SHAPE`` of it either way, the shape of its text (words, links, end of sentence, kind of
tag). The costs become capacities from the source (content) or to the sink (boilerplate). Blocks that follow each other
are joined by an edge that weakens with the number of element borders between them, and every block with the element
that holds it, every element with its parent. The maximum flow then separates content from boilerplate at the
least total cost (Dinic's algorithm, on whole numbers): a block of doubtful shape goes with its surroundings.

The weights of the shape are learned: blocks under a landmark of either kind are examples for those without. Sample:
about ``SAMPLE_PAGES`` pages, chosen by hash, and of each at most ``SAMPLE_BLOCKS`` blocks spread evenly; weights are
drawn to fixed ones (``PRIOR``), which alone hold where a table has no landmarks of both kinds. Everything else is done
for whole pages, each in one task; memory is in proportion to the longest page.

Defined results: null and empty pages have the empty text and no characters; a page without any content likewise; markup
that breaks off counts up to there, a tag without an end is dropped; references without a semicolon are decoded where
HTML allows it; ``br`` is white space, white space is what Unicode calls so; hidden elements, forms, media and code have
no text; rows that repeat have a row each; only the id, url and html are read; an empty table gives no rows.
"""

from __future__ import annotations

import html as refs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import small_arrow_batches, table

SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 64
#: Log-odds: of what elements say, and the most that the shape may say against it.
SAID_CONTENT, SAID_BOILERPLATE, NAMED_CONTENT, SHAPE = 4.0, -6.0, 1.5, 3.0
#: What elements say. Forms are boilerplate unless they hold named content or a main heading; readers' comments are always so.
NOTHING, NAMED, CONTENT, BOILERPLATE, FORM, READERS, HIDDEN = range(7)
NEVER = -1000.0
#: Smoothness: between neighbours, and along the tree of elements.
NEIGHBOURS, WITHIN = 0.6, 0.4
UNIT = 1000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li"
    " main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements whose text no reader sees as text, read up to their end tag; and those that hold markup like others.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head noscript template svg math canvas audio video object select button datalist".split())
#: A start tag of the first closes an open one of the second at once.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = set("ul ol dl table html body article section div aside nav main header footer form".split())
CONTENT_TAGS, CONTENT_ROLES = {"article", "main"}, {"main", "article"}
BOILERPLATE_TAGS = set("nav footer aside form dialog menu".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets ad ads adv advert adverts advertisement"
    " advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay"
    " share sharing social related recommended recommendations trending pagination pager search toolbar disclaimer copyright legal form".split()
)
READERS_NAMES = set("comment comments commentlist disqus respond reply replies discussion".split())
CONTENT_NAMES = set("article articlebody post entry story content main text body".split())
#: Names that make a header or the like part of the article: "entry-header".
OWN = {"article", "post", "entry", "story"}
FEATURES = ("bias", "words", "links", "sentence", "heading", "paragraph", "item", "table")
PRIOR = np.array([-2.0, 0.8, -3.0, 1.0, 0.5, 1.0, -0.5, -0.3])

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Blocks (text, element, share of linked characters) in order; of each element its parent, tag and what it says."""

    texts: list[str]
    holder: list[int]
    linked: list[float]
    parent: list[int]
    tag: list[str]
    said: list[int]


def _names(value: str) -> list[set[str]]:
    return [{x.lower() for x in NAME.findall(name)} for name in value.split()]


def _says(tag: str, attributes: str, in_content: bool) -> tuple[int, bool]:
    """What an element says of itself (FRAME and so on), and whether it is hidden."""
    if tag in ("html", "body"):
        return NOTHING, False
    found: dict[str, str] = {}
    if "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), next((v for v in values if v), ""))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    role = found.get("role", "").lower()
    sets = _names(found.get("class", "")) + _names(found.get("id", "")) + _names(found.get("itemprop", "")) if found else []
    if any(s & READERS_NAMES for s in sets):
        return READERS, hidden
    if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or any(s & BOILERPLATE_NAMES and not (s & OWN and s & BOILERPLATE_NAMES == {"header"}) for s in sets):
        return (FORM if tag == "form" else BOILERPLATE), hidden
    if tag in CONTENT_TAGS or role in CONTENT_ROLES:
        return CONTENT, hidden
    if tag == "header" and not in_content:
        return BOILERPLATE, hidden
    return (NAMED if any(s & CONTENT_NAMES for s in sets) else NOTHING), hidden


def read_page(source: str) -> Page:
    """One pass over the source; every place is looked at a bounded number of times."""
    page = Page([], [], [], [-1], ["#"], [0])
    stack, run, links = [0], [], []
    in_link = 0
    unseen: list[str] = []  # open elements without visible text
    no_end: set[str] = set()  # what is not found from here on is not looked for again

    def close() -> None:
        nonlocal in_link
        text = " ".join(refs.unescape("".join(run)).split()) if run else ""
        if text:
            part = sum(len("".join(refs.unescape(x).split())) for x in links)
            page.texts.append(text)
            page.holder.append(stack[-1])
            page.linked.append(min(1.0, part / max(1, len(text.replace(" ", "")))))
        run.clear()
        links.clear()

    def pop(to: int) -> None:
        nonlocal in_link
        close()
        del stack[to:]
        in_link = 0

    at, end, lower = 0, len(source), None
    while at < end:
        open_ = source.find("<", at)
        text = source[at : open_ if open_ >= 0 else end]
        if text and not unseen:
            run.append(text)
            if in_link:
                links.append(text)
        if open_ < 0:
            break
        if source.startswith("<!--", open_):
            stop = source.find("-->", open_ + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        following = source[open_ + 1 : open_ + 2]
        if following in ("!", "?"):
            stop = source.find(">", open_)
            at = stop + 1 if stop >= 0 else end
            continue
        slash = following == "/"
        letter = source[open_ + 2 : open_ + 3] if slash else following
        if not (letter.isascii() and letter.isalpha()):
            if slash and letter:  # "</ x>" is a comment
                stop = source.find(">", open_)
                at = stop + 1 if stop >= 0 else end
            else:
                if not unseen:
                    run.append("<")
                at = open_ + 1
            continue
        m = TAG.match(source, open_)
        if not m:
            stop = source.find(">", open_)  # a quote that is never closed: the tag ends at the first bracket
            if stop < 0:
                break
            name, attributes, at = re.match(r"</?([a-zA-Z][^\s/>]*)", source[open_ : stop + 1]).group(1).lower(), "", stop + 1
        else:
            name, attributes, at = m.group(1).lower(), m.group(2), m.end()
        if unseen and not (name in RAW and not slash):
            if slash:
                if name in unseen:
                    del unseen[unseen.index(name) :]
                continue
            if unseen[0] != "head" or name not in BLOCK:
                if name == unseen[-1] and name in UNSEEN - {"head", "button", "select"}:
                    unseen.append(name)
                continue
            unseen.clear()  # the head ends where the first block begins
        if name in RAW and not slash:
            if name not in no_end:
                lower = lower if lower is not None else source.lower()
                if len(lower) != end:
                    lower = "".join(c.lower() if c.isascii() else c for c in source)
                stop = lower.find("</" + name, at)
                if stop < 0:
                    no_end.add(name)
                else:
                    bracket = source.find(">", stop)
                    at = bracket + 1 if bracket >= 0 else end
                    continue
            break  # its text goes on to the end
        if name in UNSEEN:
            if not slash and not attributes.rstrip().endswith("/"):
                unseen.append(name)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name == "a":
            in_link = 0 if slash else 1
            continue
        if name in ("input", "label", "output", "meter", "progress"):
            continue
        if name not in BLOCK:
            continue
        close()
        if name == "hr":
            continue
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] == name or (name[0] == "h" and name[1:].isdigit() and page.tag[stack[i]][0] == "h" and page.tag[stack[i]][1:].isdigit()):
                    pop(i)
                    break
                if name in ("p", "li", "dt", "dd", "td", "th", "tr") and page.tag[stack[i]] in SCOPE:
                    break
            continue
        if len(stack) > 1 and page.tag[stack[-1]] == "p":
            pop(len(stack) - 1)
        if name in CLOSES:
            i = len(stack) - 1
            while i > 0 and page.tag[stack[i]] not in CLOSES[name] and page.tag[stack[i]] not in SCOPE:
                i -= 1
            if i > 0 and page.tag[stack[i]] in CLOSES[name]:
                pop(i)
        says, hidden = _says(name, attributes, name == "header" and any(page.said[e] == CONTENT for e in stack))
        page.parent.append(stack[-1])
        page.tag.append(name)
        page.said.append(HIDDEN if hidden else says)
        stack.append(len(page.parent) - 1)
    close()
    return page


def evidence(page: Page) -> np.ndarray:
    """Log-odds of each block by what the elements around it say; the inner and any outer boilerplate decide against content.

    An element that calls itself boilerplate but holds an article or the main part is a frame of the page and says nothing.
    """
    n = len(page.parent)
    holds, frames = np.zeros(n, bool), np.zeros(n, bool)
    for e in range(n - 1, 0, -1):
        says, up = page.said[e], page.parent[e]
        if says not in (READERS, HIDDEN):
            holds[up] |= holds[e] or says == CONTENT
            frames[up] |= frames[e] or holds[up] or says == NAMED or page.tag[e] == "h1"
    value = np.zeros(n)
    for e in range(1, n):  # parents come first
        up, says = value[page.parent[e]], page.said[e]
        if says == HIDDEN or up == NEVER:
            value[e] = NEVER
        elif up == SAID_BOILERPLATE or says == READERS or (says == BOILERPLATE and not holds[e]) or (says == FORM and not frames[e]):
            value[e] = SAID_BOILERPLATE
        elif says == CONTENT:
            value[e] = SAID_CONTENT
        else:
            value[e] = max(up, NAMED_CONTENT) if says == NAMED else up
    return value[page.holder]


def shape(page: Page) -> np.ndarray:
    """(blocks, features): the shape of each block."""
    out = np.zeros((len(page.texts), len(FEATURES)))
    for i, (text, holder, linked) in enumerate(zip(page.texts, page.holder, page.linked, strict=True)):
        tag = page.tag[holder]
        out[i] = (
            1, min(4.0, np.log1p(text.count(" ") + 1)), linked, text.rstrip("\"'»”’)")[-1:] in tuple(".!?…:"), tag[0] == "h" and tag[1:].isdigit(),
            tag in ("p", "pre", "blockquote"), tag in ("li", "dt", "dd"), tag in ("td", "th", "caption"),
        )
    return out


def maximum_flow(n: int, tail: list[int], head: list[int], capacity: list[int], excess: list[int]) -> list[bool]:
    """Which of n nodes lie on the source's side of a minimum cut. Edges go both ways with one capacity; a node's excess comes from the source, a deficit goes to the sink.

    Dinic: layers from all nodes with excess left, then blocking paths along the layers to nodes with a deficit.
    """
    to, left, out = [], [], [[] for _ in range(n)]
    for a, b, c in zip(tail, head, capacity, strict=True):
        if c > 0 and a != b:
            out[a].append(len(to))
            to.append(b)
            left.append(c)
            out[b].append(len(to))
            to.append(a)
            left.append(c)
    excess = list(excess)
    while True:
        layer, front, reached = [-1] * n, [v for v in range(n) if excess[v] > 0], False
        for v in front:
            layer[v] = 0
        while front and not reached:
            behind = []
            for v in front:
                for e in out[v]:
                    w = to[e]
                    if left[e] and layer[w] < 0:
                        layer[w] = layer[v] + 1
                        behind.append(w)
                        reached |= excess[w] < 0
            front = behind
        if not reached:
            return [x >= 0 for x in layer]
        turn = [0] * n
        for source in [v for v in range(n) if excess[v] > 0]:
            path: list[int] = []
            v = source
            while excess[source] > 0:
                if excess[v] < 0 and path:
                    amount = min(excess[source], -excess[v], *(left[e] for e in path))
                    for e in path:
                        left[e] -= amount
                        left[e ^ 1] += amount
                    excess[source] -= amount
                    excess[v] += amount
                    path, v = [], source
                    continue
                while turn[v] < len(out[v]):
                    e = out[v][turn[v]]
                    if left[e] and layer[to[e]] == layer[v] + 1:
                        break
                    turn[v] += 1
                if turn[v] < len(out[v]):
                    path.append(out[v][turn[v]])
                    v = to[path[-1]]
                elif path:
                    layer[v] = -2  # leads nowhere in this round
                    v = to[path.pop() ^ 1]
                else:
                    break


def label(page: Page, cost: np.ndarray) -> np.ndarray:
    """Which blocks are content: the source's side of the least cut."""
    blocks = len(page.texts)
    whole = np.rint(cost * UNIT).astype(np.int64).tolist()
    if all(c > 0 for c in whole) or not any(c > 0 for c in whole):
        return np.array([c > 0 for c in whole], bool)  # no cut costs less than none
    # elements on the way from a block to the root; elements with one child pass its edge on
    used, up, depth = {}, [], {0: 0}
    for e in range(1, len(page.parent)):
        depth[e] = depth[page.parent[e]] + 1
    tail, head, capacity = [], [], []

    def node(e: int) -> int:
        if e not in used:
            used[e] = blocks + len(used)
            up.append(e)
        return used[e]

    for b, e in enumerate(page.holder):
        tail.append(b)
        head.append(node(e))
        capacity.append(round(WITHIN * UNIT))
    i = 0
    while i < len(up):
        e = up[i]
        if e:
            tail.append(used[e])
            head.append(node(page.parent[e]))
            capacity.append(round(WITHIN * UNIT))
        i += 1
    for b, (x, y) in enumerate(zip(page.holder[:-1], page.holder[1:], strict=True)):
        borders = 0
        while x != y and borders < 32:
            if depth[x] >= depth[y]:
                x = page.parent[x]
            else:
                y = page.parent[y]
            borders += 1
        tail.append(b)
        head.append(b + 1)
        capacity.append(round(NEIGHBOURS * UNIT / (1 + borders / 2)))
    n = blocks + len(used)
    side = maximum_flow(n, tail, head, capacity, whole + [0] * len(used))
    return np.array(side[:blocks], bool)


def main_text(source: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, one a line."""
    page = read_page(source or "")
    if not page.texts:
        return ""
    cost = evidence(page) + np.clip(shape(page) @ weights, -SHAPE, SHAPE)
    return "\n".join(t for t, good in zip(page.texts, label(page, cost), strict=True) if good)


def learned(x: np.ndarray, y: np.ndarray, strength: float = 300.0) -> np.ndarray:
    """Weights of a logistic regression drawn to PRIOR, both classes counting alike; by Newton's method."""
    if not len(y) or y.all() or not y.any():
        return PRIOR
    each = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * min(len(y), 2000)
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + strength * (w - PRIOR)
        step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + strength * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", size: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the shape from about ``size`` pages: blocks below a landmark are the examples."""
    keyed = pages.select(F.col(html_col).alias("html")).filter("html IS NOT NULL").withColumn("key", F.xxhash64("html"))
    n = pages.count()
    share = min(1.0, size / max(1, n))
    chosen = keyed.filter(F.col("key").bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(share * 2.0**63)).groupBy("key").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                page = read_page(source)
                if page.texts:
                    known = evidence(page)
                    sure = np.flatnonzero((known == SAID_CONTENT) | (known == SAID_BOILERPLATE))
                    if len(sure) > SAMPLE_BLOCKS:
                        sure = sure[np.linspace(0, len(sure) - 1, SAMPLE_BLOCKS).astype(np.int64)]
                    x = shape(page)[sure]
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()), pa.array([(known[sure] > 0).tobytes()], pa.binary())], ["x", "y"])

    small_arrow_batches(pages.sparkSession, rows=100)
    rows = sorted((bytes(r["x"]), bytes(r["y"])) for r in chosen.select("html").mapInArrow(run, "x binary, y binary").toLocalIterator())
    x = np.frombuffer(b"".join(a for a, _ in rows), np.float64).reshape(-1, len(FEATURES))
    return learned(x, np.frombuffer(b"".join(b for _, b in rows), bool))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep, text and n_chars of every page."""
    chosen = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("__html"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, weights) for source in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    small_arrow_batches(pages.sparkSession, rows=200)
    return chosen.mapInArrow(run, f"{kind}, text string, n_chars bigint")


def op12_mincut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
