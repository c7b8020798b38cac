"""Main text of web pages: gradient-boosted trees over the nodes of the page, decoded top down.

A page becomes a tree of block elements; inline markup belongs to the block around it, and
scripts, styles, comments and heads are no text at all. Each node is described by what is
below it (text, links, tags: its density), by its attribute tokens, its depth and its siblings.
The trees give each node log-odds of being main text. Decoding then chooses main, boilerplate or
mixed for every node so that the sum of log-odds is largest and no choice contradicts another: all
that is below a main node is main, all below a boilerplate node is boilerplate, and only mixed
nodes leave it to their children.

Training rows come from a bounded sample of pages whose document is known: a node is main if most
of its text stands in the document. Since one site's markup is all that a sample may show, each
sampled page is also set anew in other layouts from its own blocks.

Defined results for odd input:
- a null or empty page has an empty text; text outside any element counts as the body's;
- unclosed and stray tags are mended as browsers do; an unfinished tag or comment ends the page;
- repeated pages get a row each; extra columns are passed on.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm import boosting
from riskframe.llm.frames import column_index, numbered, pick, table, with_results

#: Most pages that the trees are fitted on, chosen by a hash of the URL, and most characters of each that are looked at for that.
FIT_PAGES, FIT_CHARS = 400, 200_000
ATTRIBUTE_BINS = 64

#: Elements whose content is no text of the page; the fields of forms among them. What else isn't the article, the trees tell.
_SKIP = frozenset("script style template svg head iframe select textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr input button object noscript "
                    "math semantics annotation mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open element of these kinds, unless a boundary stands between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDARY = frozenset("ul ol dl table td th article section div aside nav form body blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|([^<]+)|(<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "dl", "address", "dialog", "details")
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}


class Page:
    """Block elements in page order: parent, tag, attribute tokens; and pieces of text (node, text, inside a link)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.names = [-1], ["html"], [()]
        self.pieces: list[tuple[int, str, bool]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        links, at, n, endless = 0, 0, len(source), set()  # endless: kinds of elements that no end tag follows any more
        while at < n:
            m = _TOKEN.match(source, at)
            if m is None:
                break
            at = m.end()
            if m[4] is not None or m[5] is not None:
                self.pieces.append((stack[-1][1], m[0], links > 0))
            elif m[1] is not None:
                tag = m[1].lower()
                if tag in _SKIP:
                    if tag not in endless and not (m[2].endswith("/") and tag == "svg"):
                        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                        if end is None:
                            endless.add(tag)
                        at = n if end is None and tag in ("script", "style") else at if end is None else end.end()
                    continue
                if tag in _INLINE:
                    if tag == "a" and not m[2].endswith("/"):
                        links += 1
                        stack.append((tag, stack[-1][1]))
                    elif tag not in _VOID:
                        stack.append((tag, stack[-1][1]))
                    continue
                if tag == "br" or tag in _VOID:
                    self.pieces.append((stack[-1][1], " ", False))
                    continue
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                links -= self._close(stack, "p", {"p", *_HEADINGS}) if tag not in _ENDS else 0
                if tag in _ENDS:
                    links -= self._close(stack, tag, _ENDS[tag])
                names = tuple(_NAME.findall(" ".join(v for a in _ATTRIBUTE.findall(m[2]) for v in a[1:]).lower())) if m[2] else ()
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                self.names.append(names)
                stack.append((tag, len(self.tag) - 1))
            elif m[3] is not None:
                tag = m[3].lower()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), None)
                if depth is not None and (tag not in _INLINE or not any(t not in _INLINE for t, _ in stack[depth:])):
                    links -= sum(t == "a" for t, _ in stack[depth:])
                    del stack[depth:]
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                break

    @staticmethod
    def _close(stack: list[tuple[str, int]], tag: str, ends: set[str]) -> int:
        """Close an open element of the kinds, if no boundary stands between; how many links that closes."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                gone = sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return gone
            if stack[i][0] in _BOUNDARY:
                return 0
        return 0

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of each run of text without a block's edge inside, white space turned into single spaces."""
        out, last, parts = [], None, []
        for node, text, _ in [*self.pieces, (None, "", False)]:
            if node != last and parts:
                joined = " ".join(entities.unescape("".join(parts)).split())
                if joined:
                    out.append((last, joined))
                parts = []
            last = node
            parts.append(text)
        return out


def features(page: Page) -> np.ndarray:
    """One row for each node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    text, link, stops, blocks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, piece, linked in page.pieces:
        size = len(piece.strip())
        if size:
            text[node] += size
            link[node] += size * linked
            stops[node] += piece.count(". ") + piece.count(", ") + piece.rstrip().endswith((".", "!", "?"))
            blocks[node] += 1
    own = text.copy()
    tags = np.ones(n)
    paragraphs = np.array([t in ("p", "blockquote", "pre") for t in page.tag], dtype=float)
    items = np.array([t in ("li", "td", "dt", "dd") for t in page.tag], dtype=float)
    sums = np.stack([text, link, stops, blocks, tags, paragraphs, items])
    for i in range(n - 1, 0, -1):
        sums[:, parent[i]] += sums[:, i]
    text, link, stops, blocks, tags, paragraphs, items = sums
    up = np.maximum(parent, 0)
    depth = np.zeros(n)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    siblings = children[up]
    order, seen = np.zeros(n), {}
    for i in range(1, n):
        order[i] = seen.get(parent[i], 0)
        seen[parent[i]] = order[i] + 1
    names = np.zeros((n, 2 * ATTRIBUTE_BINS))
    for i, tokens in enumerate(page.names):
        for t in tokens:
            names[i, zlib.crc32(t.encode()) % ATTRIBUTE_BINS] = 1
        if i:
            np.maximum(names[i, ATTRIBUTE_BINS:], np.maximum(names[up[i], ATTRIBUTE_BINS:], names[up[i], :ATTRIBUTE_BINS]), out=names[i, ATTRIBUTE_BINS:])
    kinds = np.zeros((n, 2 * len(_TAGS)))
    for i, t in enumerate(page.tag):
        k = _TAG_NUMBER.get(t)
        if k is not None:
            kinds[i, k] = 1
        if i:
            kinds[i, len(_TAGS) :] = np.maximum(kinds[up[i], len(_TAGS) :], kinds[up[i], : len(_TAGS)])
    whole = max(text[0], 1)
    sibling_text = np.where(siblings > 1, (text[up] - text) / np.maximum(siblings - 1, 1), 0)
    shape = np.stack([
        np.log1p(text), np.log1p(own), link / np.maximum(text, 1), text / np.maximum(tags, 1), stops / np.maximum(text, 1) * 100, text / whole, text / np.maximum(text[up], 1),
        np.log1p(blocks), np.log1p(tags), paragraphs, items, depth, children, siblings, order, np.log1p(sibling_text), link[up] / np.maximum(text[up], 1), text[up] / whole,
    ], axis=1)
    return np.concatenate([shape, kinds, names], axis=1)


def decode(parent: list[int], score: np.ndarray, has_text: np.ndarray) -> np.ndarray:
    """True for nodes whose own text is main, by the best choice that contradicts nothing."""
    n = len(parent)
    whole = np.where(has_text, score, 0.0)
    main, plain = whole.copy(), -whole
    mixed = np.abs(whole) - 0.5  # the own text of a mixed node goes by its own sign; a mixed node must be worth it
    for i in range(n - 1, 0, -1):
        p = parent[i]
        main[p] += main[i]
        plain[p] += plain[i]
        mixed[p] += max(main[i], plain[i], mixed[i])
    choice = np.empty(n, dtype=np.int8)  # 1 main, 0 boilerplate, 2 mixed
    for i in range(n):
        above = choice[parent[i]] if i else 2
        choice[i] = above if above != 2 else int(np.argmax((plain[i], main[i], mixed[i])))
    return (choice == 1) | ((choice == 2) & (score > 0))


def _has_text(page: Page) -> np.ndarray:
    """Nodes whose subtree has text."""
    out = np.zeros(len(page.tag), dtype=bool)
    for node, piece, _ in page.pieces:
        if not out[node] and piece.strip():
            out[node] = True
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return out


def extract(sources: list[str], trees: boosting.Trees) -> list[str]:
    """The main texts of some pages."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    scores = trees.score(np.concatenate([features(p) for p in pages]))
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        chosen = decode(page.parent, scores[at : at + n], _has_text(page))
        at += n
        out.append(" ".join(text for node, text in page.blocks() if chosen[node]))
    return out


def label(page: Page, document: str) -> np.ndarray | None:
    """1 for nodes whose text is mostly in the document, 0 for others, -1 for nodes without text; None if the document isn't there."""
    inside = " ".join(document.split())
    n = len(page.tag)
    good, size = np.zeros(n), np.zeros(n)
    sure: dict[int, list[float]] = {}
    blocks = page.blocks()
    for node, text in blocks:
        if len(text) >= 25:
            sure.setdefault(page.parent[node], []).append(float(text in inside) * len(text))
            sure[page.parent[node]].append(-float(text not in inside) * len(text))
    short = not any(sum(v) > 0 for v in sure.values())
    part = _least_part(page, blocks, inside) if short else frozenset()
    if short and not part:
        return None
    for node, text in blocks:  # short texts may stand anywhere; they go with what stands around them
        known = sure.get(page.parent[node]) or sure.get(node)
        alike = node in part if short else text in inside and (len(text) >= 25 or bool(known) and sum(known) > 0)
        good[node] += len(text) * alike
        size[node] += len(text)
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    return np.where(size > 0, (good > 0.5 * size).astype(int), -1)


def _least_part(page: Page, blocks: list[tuple[int, str]], inside: str) -> frozenset[int]:
    """The nodes of the smallest subtree that has a short document whole; none if it is nowhere."""
    n = len(page.tag)
    below: list[list[str]] = [[] for _ in range(n)]
    for node, text in blocks:
        at = node
        while at >= 0:
            below[at].append(text)
            at = page.parent[at]
    sizes = {i: len(joined) for i in range(n) if inside and inside in (joined := " ".join(below[i]))}
    if not sizes:
        return frozenset()
    top = min(sizes, key=lambda i: (sizes[i], -i))
    kept = {top}
    for i in range(top + 1, n):
        if page.parent[i] in kept:
            kept.add(i)
    # a heading that says the document's beginning again belongs to it
    if page.parent[top] > 0 and sizes.get(page.parent[top], 1 << 60) <= 3 * sizes[top] + 20:
        return frozenset(i for i in range(n) if i in kept or page.parent[i] == page.parent[top])
    return frozenset(kept)


#: Other layouts: what may stand around the main text, as (tag, attribute). The first of each list is written around the text.
_AROUND = (
    ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("section", 'class="post entry"'), ("div", 'class="article-body"'), ("article", ""),
    ("div", 'class="story text"'), ("td", ""), ("div", ""),
)
_BESIDE = (
    ("nav", 'class="menu"'), ("div", 'id="nav"'), ("header", 'class="site-header masthead"'), ("div", 'class="header banner"'), ("aside", 'class="sidebar"'), ("div", 'class="sidebar widget"'),
    ("div", 'class="cookie notice consent"'), ("div", 'class="ad advert"'), ("div", 'class="sponsored promo"'), ("form", 'class="newsletter signup"'), ("form", 'id="search"'), ("div", 'class="breadcrumb"'),
    ("div", 'class="related links"'), ("div", 'class="share social"'), ("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="comment reply"'),
    ("footer", ""), ("div", 'class="footer copyright"'), ("div", 'id="bottom"'), ("ul", 'class="pagination"'), ("div", 'class="author bio"'), ("section", 'class="disqus responses"'), ("div", 'role="alert"'),
    ("div", 'class="popup modal subscribe"'), ("dialog", ""), ("aside", ""), ("div", 'role="navigation"'), ("div", 'role="contentinfo"'), ("div", 'role="complementary"'),
)
_AFTER = 12  # from here on in _BESIDE a part mostly stands below the text


def reset(main: list[str], rest: list[str], turn: int) -> str:
    """A page with the same main blocks in another layout, chosen by ``turn``."""
    rng = np.random.default_rng(turn)
    quote = lambda s: entities.escape(s, quote=False)
    rest = rest or ["menu"]
    def beside(k: int) -> str:
        tag, attribute = _BESIDE[k]
        count = int(rng.integers(1, 6))
        pick = [rest[int(rng.integers(len(rest)))] for _ in range(count)]
        if 14 <= k <= 17 or k == 23:  # readers write whole sentences
            pick = [main[int(rng.integers(len(main)))] for _ in range(count)]
        inner = "li" if tag in ("ol", "ul") or (k in (0, 1, 12) and rng.random() < 0.7) else ("p" if rng.random() < 0.5 else "div")
        linked = k in (0, 1, 11, 12, 13, 21, 28) or rng.random() < 0.3
        body = "".join(f"<{inner}>" + (f'<a href="#">{quote(x)}</a>' if linked else quote(x)) + f"</{inner}>" for x in pick)
        body = f"<ul>{body}</ul>" if inner == "li" and tag not in ("ol", "ul") else body
        return f"<{tag} {attribute}>{body}</{tag}>"

    tag, attribute = _AROUND[int(rng.integers(len(_AROUND)))]
    top = [beside(int(rng.integers(_AFTER))) for _ in range(int(rng.integers(1, 5)))]
    low = [beside(int(rng.integers(_AFTER - 8, len(_BESIDE)))) for _ in range(int(rng.integers(1, 6)))]
    head = f"<h1>{quote(main[0])}</h1>" if rng.random() < 0.8 else f"<h2>{quote(main[0])}</h2>"
    kinds = ("p", "p", "p", "div", "li", "blockquote")
    body = "".join(f"<{k}>{quote(x)}</{k}>" for x in main[1:] for k in (kinds[int(rng.integers(len(kinds)))] if rng.random() < 0.2 else "p",))
    text = f"<{tag} {attribute}>{head}{body}</{tag}>"
    text = f"<table><tr>{text}</tr></table>" if tag == "td" else text
    text = f'<div class="wrapper">{text}{low.pop(0)}</div>' if rng.random() < 0.4 else text
    return f"<html><body>{''.join(top)}{text}{''.join(low)}</body></html>"


def _brief(page: Page, y: np.ndarray, turn: int) -> Page:
    """The same page with a main text of a few words only."""
    out = Page("")
    out.parent, out.tag, out.names = page.parent, page.tag, page.names
    left = [2 + turn % 7] * (1 + turn % 3)
    for node, text, linked in page.pieces:
        if y[node] != 1:
            out.pieces.append((node, text, linked))
        elif left and text.strip():
            out.pieces.append((node, " ".join(text.split()[: left.pop()]), linked))
    return out


def fit(rows: list[tuple[str, str]], layouts: int = 3) -> boosting.Trees:
    """Trees from (html, text of the document)."""
    xs, ys = [np.zeros((0, 18 + 2 * len(_TAGS) + 2 * ATTRIBUTE_BINS))], [np.zeros(0)]
    for number, (source, document) in enumerate(rows):
        page = Page(source)
        y = label(page, document)
        if y is None:
            continue
        xs.append(features(page)[y >= 0]), ys.append(y[y >= 0])
        brief = _brief(page, y, number)
        y1 = np.where(_has_text(brief), y, -1)
        xs.append(features(brief)[y1 >= 0]), ys.append(y1[y1 >= 0])
        main = [t for node, t in page.blocks() if y[node] == 1]
        rest = [t for node, t in page.blocks() if y[node] == 0]
        if not main:
            continue
        for k in range(layouts):
            words = main[0].split()[: 2 + number % 7] if k == layouts - 1 else []
            other = Page(reset([" ".join(words)] * 2 if words else main, rest, layouts * number + k))
            y2 = _labels_of_layout(other, main)
            xs.append(features(other)[y2 >= 0]), ys.append(y2[y2 >= 0])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), rounds=50, depth=4)


_SIDE_TOKENS = frozenset(t for tag, a in _BESIDE for t in _NAME.findall(a.split("=", 1)[-1])) 
_SIDE_TAGS = frozenset(("nav", "header", "aside", "form", "footer", "dialog", "ol", "ul"))


def _labels_of_layout(page: Page, main: list[str]) -> np.ndarray:
    """Labels of a page that :func:`reset` wrote: the parts that it put beside the text are known by their markup."""
    n = len(page.tag)
    side = np.zeros(n, dtype=bool)
    for i in range(1, n):
        own = page.parent[i] > 0 and (page.tag[i] in _SIDE_TAGS or bool(_SIDE_TOKENS & set(page.names[i]) - {"text"}))
        side[i] = side[page.parent[i]] or own
    good, size = np.zeros(n), np.zeros(n)
    for node, text in page.blocks():
        good[node] += len(text) * (not side[node])
        size[node] += len(text)
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    return np.where(size > 0, (good > 0.5 * size).astype(int), -1)


def learn(pages: DataFrame, docs: DataFrame, fit_pages: int = FIT_PAGES) -> boosting.Trees:
    """Trees from at most ``fit_pages`` of pages (html, doc_id) whose document is in docs (doc_id, text).

    Pages and documents are read whole; one of over ``FIT_CHARS`` characters isn't fitted on."""
    known = pages.where("doc_id is not null").where(F.length("html") <= FIT_CHARS)
    chosen = known.orderBy(F.xxhash64("doc_id", "html"), "doc_id").limit(fit_pages).select("doc_id", "html")
    both = docs.join(F.broadcast(chosen), "doc_id")  # fit_pages rows of FIT_CHARS at most
    rows = both.where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS).select("doc_id", "html", "text").toPandas().sort_values(["doc_id", "html"])
    return fit(list(zip(rows["html"], rows["text"].fillna(""))))


def _run(at: int, trees, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            texts: list[str] = []
            for a in range(0, batch.num_rows, 64):
                texts += extract([s or "" for s in batch.column(at).slice(a, 64).to_pylist()], model)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], schema=schema)

    return run


def extract_pages(pages: DataFrame, trees: boosting.Trees, html: str = "html") -> DataFrame:
    """pages without their html, with text and n_chars."""
    df, names = numbered(pages)
    at = column_index(pages, html)
    df = df.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    rest = [f for i, f in enumerate(df.schema.fields) if i != at]
    shape = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = df.mapInArrow(_run(at, pages.sparkSession.sparkContext.broadcast(trees), to_arrow_schema(shape)), shape)
    kept = [(f"c{i}", n) for i, n in enumerate(names) if i != at and n.lower() not in ("text", "n_chars")]
    return out.select(*[F.col(c).alias(n) for c, n in kept], "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    """A page's path names the document that it shows."""
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    named = F.regexp_extract("url", r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[/.?#]|$)", 1).try_cast("long")
    trees = learn(pages.select("html", named.alias("doc_id")), docs)
    return extract_pages(pages, trees).select("page_id", "url", "text", "n_chars")
