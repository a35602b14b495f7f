"""Main text of web pages by tree scoring.

The page is parsed to a tree with html.parser. Parts that never hold an article (scripts, styles,
forms, navigation, asides, and elements whose class or id names nothing but menus, adverts, notices,
comments and the like) are left out, unless they hold the page's articles or most of its paragraphs. Each remaining paragraph gives points for its length and commas to its
ancestors, half as many for each step up; a container's points are discounted by its link density.
If the best container lies in an article or main element, the outermost such element is kept whole. If
not, it grows to its parent as long as nothing but headings stands beside it, and is kept with its
parent's own text and all siblings that are no lists of links, whatever their size.

Blocks of the kept part are its block elements' own runs of text; white space inside a block becomes
one space, blocks are joined by line ends in page order.

Defined cases: null and empty html give an empty text; a page without paragraphs is scored on its
other text blocks; broken markup is taken as far as html.parser reads it; repeated rows give equal
rows; an empty table gives an empty result; other columns are never read. Ties go to the container
that comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object embed canvas svg dialog menu".split())
#: Dropped unless inside the article.
PAGE_LEVEL = frozenset(["header"])
#: Elements that a start tag closes, as in the HTML standard's rules for implied ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of parts that hold no article. A class, id or role counts if it is made of such words, and of PLACES, only.
UNLIKELY = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|subscribe|newsletter|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget\w*|footer|masthead|header|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|pagination|pager|tags|login|signup|search|skip|toolbar", re.I)
PLACES = re.compile(r"\d+(?:x\d+)?|site|global|main|primary|secondary|left|right|top|bottom|upper|lower|sticky|fixed|mobile|desktop|google|area|bar|box|block|slot|unit|item|items|list|links?|buttons?|icons?|form|wrap|wrapper|container|inner|outer|col|column|panel|posts|articles|stories|to|thread|section", re.I)
#: Names of a head part, which inside an article is the article's own, and of parts that readers wrote.
HEAD, READERS = re.compile(r"header|masthead|banner", re.I), re.compile(r"comments?|commentlist|disqus|replies|respond", re.I)
#: Elements whose id is a place to jump to.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption table".split())
SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Points that a paragraph needs at least to count, in characters.
LEAST_CHARS = 25
#: Share of characters in links from which a sibling is left out.
LINKS = 0.25
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SCORED = frozenset(["p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"])


class Node:
    __slots__ = ("tag", "parent", "children", "unlikely", "score", "chars", "links", "dropped")

    def __init__(self, tag: str, parent: Node | None, hint: str = ""):
        self.tag, self.parent = tag, parent
        self.children: list = []
        self.score, self.chars, self.links = 0.0, 0, 0
        self.dropped = tag in DROPPED
        #: The names that count against the element.
        self.unlikely = [w for t in hint.split() if tag not in ("html", "body", "article", "main") for w in unlikely(t)]


@lru_cache(4096)
def unlikely(token: str) -> tuple[str, ...]:
    """Words of UNLIKELY in a class, id or role, if all its words are such or PLACES."""
    words = [w for w in re.split(r"[_-]+", token) if w]
    found = tuple(w for w in words if UNLIKELY.fullmatch(w))
    return found if all(w in found or PLACES.fullmatch(w) for w in words) else ()


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag)
        if closes or tag in BLOCK:
            n, stop = self.at, ("ul", "ol", "dl", "table", "select")
            while n.parent is not None and n.tag not in stop:
                if n.tag == "p" and tag in BLOCK or closes and n.tag in closes:
                    self.at = n.parent
                    if n.tag == "p" or n.tag in ("td", "th") and tag != "tr" or n.tag in ("li", "dt", "dd", "tr"):
                        break
                n = n.parent
        a = dict(attrs)
        node = Node(tag, self.at, " ".join(x for x in (a.get("class"), a.get("id") if tag not in ANCHORS else None, a.get("role")) if x))
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", ""):
            node.dropped = True
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def rescue(root: Node) -> None:
    """Clears the names of elements that hold the page's articles, or most of its paragraphs' text outside links."""
    order, stack = [], [(root, False, False)]
    while stack:
        n, paragraph, link = stack.pop()
        if n.dropped:
            continue
        order.append((n, paragraph or n.tag in SCORED, link or n.tag == "a"))
        stack += [(c, *order[-1][1:]) for c in reversed(n.children) if isinstance(c, Node)]
    if not any(n.unlikely for n, _, _ in order):
        return
    #: articles, characters of paragraphs, and of all text, by node; what readers wrote doesn't count for the page
    held: dict[int, tuple[int, int, int]] = {}
    for n, paragraph, link in reversed(order):  # children come after their parents
        own = 0 if link else sum(len(c.strip()) for c in n.children if isinstance(c, str))
        parts = [held[id(c)] for c in n.children if isinstance(c, Node) and id(c) in held and not from_readers(c)]
        held[id(n)] = (n.tag in ("article", "main")) + sum(p[0] for p in parts), own * paragraph + sum(p[1] for p in parts), own + sum(p[2] for p in parts)
    articles, *total = held[id(root)]
    k = 1 if total[0] else 2
    for n, _, _ in order:
        if n.unlikely:
            has, most = held[id(n)][0], 2 * held[id(n)][k] > total[k - 1]
            if not total[1] if from_readers(n) else articles and has == articles or most and (has or not articles):
                n.unlikely = []


def from_readers(n: Node) -> bool:
    return any(READERS.fullmatch(w) for w in n.unlikely)


def walk(root: Node, inside_article: bool = False) -> list[Node]:
    """Kept nodes in page order; sets what is dropped, by a stack rather than recursion."""
    out, stack = [], [(root, inside_article)]
    while stack:
        n, inside = stack.pop()
        if n.dropped or n.tag in PAGE_LEVEL and not inside or any(not (inside and HEAD.fullmatch(w)) for w in n.unlikely):
            n.dropped = True
            continue
        out.append(n)
        inside = inside or n.tag in ("article", "main")
        stack += [(c, inside) for c in reversed(n.children) if isinstance(c, Node)]
    return out


def score(nodes: list[Node]) -> None:
    """Characters, characters in links, and points of all nodes."""
    for n in reversed(nodes):  # children come after their parents
        own = sum(len(SPACE.sub(" ", c)) - (not c.strip()) for c in n.children if isinstance(c, str))
        kept = [c for c in n.children if isinstance(c, Node) and not c.dropped]
        n.chars = own + sum(c.chars for c in kept)
        n.links = n.chars if n.tag == "a" else sum(c.links for c in kept)
    for n in nodes:
        direct = n.tag in SCORED or n.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in n.children)
        if not direct or n.chars < LEAST_CHARS or any(isinstance(c, Node) and c.tag in SCORED and not c.dropped for c in n.children):
            continue
        text = plain(n)
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        points *= 1 - n.links / max(n.chars, 1)
        up, share = n.parent if n.tag in SCORED else n, 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            up, share = up.parent, share / 2


def plain(n: Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            stack += reversed(x.children)
    return SPACE.sub(" ", "".join(out)).strip()


def density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def blocks(n: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def end():
        text = SPACE.sub(" ", "".join(now)).strip(" ")
        if text:
            out.append(text)
        now.clear()

    stack: list = [n]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.dropped:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def whole(best: Node) -> Node:
    """All that belongs to the best container, as one node."""
    top, up = None, best
    while up is not None:
        top, up = up if up.tag in ("article", "main") else top, up.parent
    if top is not None:
        return top
    n = best
    while n.parent is not None and n.tag != "body" and not any(c.strip() if isinstance(c, str) else not c.dropped and c.chars and c is not n and c.tag not in HEADINGS for c in n.parent.children):
        n = n.parent
    if n.parent is None or n.tag == "body":
        return n
    out = Node("div", None)
    out.children = [c for c in n.parent.children if c is n or isinstance(c, str) or not c.dropped and (c.tag in HEADINGS or density(c) < LINKS)]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    rescue(root)
    nodes = walk(root)
    score(nodes)
    containers = [n for n in nodes if n.tag in BLOCK and n.tag not in SCORED and n.tag not in ("html", "ul", "ol", "dl", "tr", "tbody")] or [root]
    best = max(containers, key=lambda n: n.score * (1 - density(n)))
    if best.score <= 0:
        best = root
    return "\n".join(blocks(whole(best)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            text = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
