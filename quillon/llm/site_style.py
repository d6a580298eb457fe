"""Main text of HTML pages by site style trees.

The pages of a host are merged into a style tree: elements with the same path of
tags, classes and ids (but for numbers that name a page, and for attributes of
html and body) are one node.  Every element with text is in the tree, and a node
knows on how many pages it is and

* which contents it holds there: their entropy, divided by that of as many
  different contents, is 1 where every page says something else and 0 where all
  say the same;
* which sequences of children it has there: the entropy of its presentation,
  divided likewise;
* which share of the page's text it holds, on average.

A node's importance is half its content's entropy, and half the larger of its
presentation's entropy and its share.  So text that repeats is unimportant, and
so are small parts of a fixed build whatever they say, as menus, notices and
footers are, while an article varies in build or holds most of the text.

A page adds what it knows of an element itself: it favours what lies in the
article (the element article or main, or else the smallest container that holds
half of the text) and running text, and disfavours what lies outside a marked
article, and by ``NAMED`` what HTML or the name of a class or id sets apart (nav,
footer, aside, form; ad, comments ...; by the first part of a name, as in ad-slot,
only what holds a minor share of the text), unless that holds most of the page's text
and no article elsewhere.  Article elements within such parts (comments,
teasers) and small ones beside a large one aren't the article.  The amounts were
set by hand such that running text straight in an article stays whatever the
tree says, what is set apart goes even at full importance (1 + INSIDE + NAMED <
LEAST), and an unknown container stays unless something speaks against it.  Elements below ``least`` go with all that is in
them.  Running text straight in the article stays with it, since copies of an
article on many pages are still the article.

The tree is never built in one place: nodes are rows whose counts Spark adds up,
so a host with a third of all pages is no hot group.  A node seen on fewer than
``min_pages`` pages of its host is judged by the tree of all hosts, and if that
has as few, by the page alone.

Defined results: null or empty html gives an empty text; a null or malformed url
belongs to one host without name; repeated rows give a row each; tags within a
text of any length are read whole.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batch

# Element names of the HTML standard, by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp template textarea title svg".split())
NEVER = RAW | frozenset("head button select option datalist audio video canvas map".split())
#: Elements that HTML sets apart from the article; header, too, outside of it.
ASIDE = frozenset("nav footer aside form dialog menu label fieldset legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot select article section div main body html".split())
#: Running text.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption object".split()) | INLINE
#: Words of a class, an id or a role that name a part which isn't the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer masthead header topbar cookie cookies consent gdpr notice notices alert comment comments reply replies "
    "respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search pagination pager "
    "contentinfo complementary".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: Names of a class or id that set a container apart within the article too.
APART = frozenset(
    "ad ads ad-banner ad-container ad-slot advert adverts advertisement advertising sponsor sponsored promo promotion popup modal nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget cookie cookies comment comments commentlist comment-list comments-area comments-list comments-section replies disqus "
    "share share-buttons sharing social related related-articles related-content related-links related-posts related-stories newsletter newsletter-signup "
    "subscribe subscription signup pagination pager teaser teasers".split()
)
#: First parts, before - or _, of a class or id that do so where the container holds a minor share of the page's text.
APART_FIRST = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments cookie cookies breadcrumb breadcrumbs newsletter signup subscribe pagination pager teaser".split()
)
#: Of several articles one counts if it has this share of the largest one's text, or if the smaller ones together have more than that.
FAIR = 0.25
#: Roles that say the same as nav and dialog.
ROLES = frozenset("navigation search dialog alertdialog menu".split())
NAMING = frozenset("class id role hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What names one page: numbers of posts and pages, long numbers, hexadecimal keys.
_OF_A_PAGE = re.compile(
    r"\b((?:post|page|node|nid|article|entry|item|story|topic|thread|product|id)-?_?(?:id)?[-_]?)\d+\b|\d{3,}|\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{8,}\b"
)
_WORDS = re.compile(r"[a-z]+")


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _common(m: re.Match) -> str:
    return (m[1] or "") + "#"


#: What a page adds to an element's importance: in the article, outside a marked one, running text, a word of a name, what is set apart.
INSIDE, OUTSIDE, RUNNING, WORDED, NAMED = 0.15, -0.4, 0.15, -0.15, -0.6
#: Importance of an element that no tree knows, but for its share; and the lowest that stays.
UNKNOWN, LEAST = 0.75, 0.6


class Node:
    __slots__ = ("up", "tag", "style", "mark", "named", "hinted", "worded", "main", "flow", "path", "size", "children")

    def __init__(self, up: Node | None, tag: str, style: str, mark: str, named: bool, hinted: bool, worded: bool, main: bool, flow: bool):
        self.up, self.tag, self.style, self.mark, self.named, self.hinted, self.worded, self.main, self.flow = up, tag, style, mark, named, hinted, worded, main, flow
        self.path = xxhash.xxh64_intdigest(style, up.path & 0xFFFFFFFF if up else 0) >> 1
        self.size, self.children = 0, []


def _opened(tag: str, attrs: str, up: Node | None) -> Node | None:
    """The element of an opening tag; none for one that holds no text to be read."""
    name, words, tokens, hidden, role = "", set(), set(), False, ""
    if attrs.strip():
        seen = set()
        for k, a, b, c in _ATTRIBUTE.findall(attrs):
            value, k = (a or b or c).lower(), k.lower()
            if k not in NAMING or k in seen:  # of repeated attributes the first counts
                continue
            seen.add(k)
            hidden |= k == "hidden"
            if k == "hidden":
                continue
            role = value if k == "role" else role
            name += f".{_OF_A_PAGE.sub(_common, value)}" if any(map(str.isdigit, value)) else f".{value}"
            words.update(_WORDS.findall(value))
            if k in ("class", "id"):
                tokens.update(value.split())
    if tag in NEVER or hidden:
        return None
    root = tag in ("html", "body")
    mark = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
    inside = bool(mark) or bool(up and up.main)
    heading = tag in HEADINGS
    apart = not root and not heading and bool(tokens & APART)
    named = apart or not (root or mark) and (tag in ASIDE or tag == "header" or role in ROLES)
    hinted = not (root or heading or mark) and tag not in INLINE and any(re.split("[-_]", x, maxsplit=1)[0] in APART_FIRST for x in tokens)
    # within the article a word of a name says little: a section may be on sharing, a heading on a discussion
    worded = not (root or inside or heading) and bool(words & PARTS)
    return Node(up, tag, tag if root else tag + name, mark, named, hinted, worded, inside, tag in PLAIN and not name)


class Page:
    """Elements of a page that hold text, and its runs of text in order: (element, text); (None, "") where a block begins or ends."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.runs: list[tuple[Node | None, str]] = []
        self.size = 0
        stack: list[Node | None] = []  # None: an element that isn't read
        for kind, value, attrs in _tokens(page):
            if kind == "text":
                self._text(stack, value)
                continue
            tag = value
            if tag not in INLINE:
                self.runs.append((None, ""))
            if kind == "end":
                for i in range(len(stack) - 1, -1, -1):
                    if (stack[i].tag if isinstance(stack[i], Node) else stack[i]) == tag:
                        del stack[i:]
                        break
                continue
            if tag in VOID:
                continue
            drop = {"p"} if tag in CLOSES_P else SIBLING.get(tag, ())
            if drop:
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i].tag if isinstance(stack[i], Node) else stack[i]
                    if t in drop:
                        del stack[i:]
                        break
                    if t in SCOPE:
                        break
            up = stack[-1] if stack else None
            node = tag if isinstance(up, str) else _opened(tag, attrs, up) or tag
            if isinstance(node, Node):
                self.nodes.append(node)
                if up:
                    up.children.append(node)
            stack.append(node)
        self._settle()

    def _settle(self) -> None:
        """What is apart, and which marked elements are the article, now that the sizes are known.

        An article element that is apart, or lies in a part that is, isn't the
        article (a comment, a teaser), and of several beside each other the small
        ones aren't (see FAIR).  A part that is apart by its name but holds both most
        of the text and all articles is a mere wrapper.
        """
        in_article: set[int] = set()  # and the articles themselves
        home: dict[int, int] = {}  # the main element around
        apart: set[int] = set()
        wrapped: set[int] = set()  # apart, but for wrappers
        for x in self.nodes:  # parents come first
            me, up = id(x), id(x.up)
            x.named = x.named or x.hinted and 2 * x.size < self.size
            if x.mark == "article" or up in in_article:
                in_article.add(me)
            if x.up and (x.up.mark == "main" or up in home):
                home[me] = up if x.up.mark == "main" else home[up]
            # whether a header is apart depends on the articles beside it, which are settled first
            if x.named and x.tag != "header" or up in apart:
                apart.add(me)
            if x.named and (x.mark or 2 * x.size < self.size) or up in wrapped:
                wrapped.add(me)
        own = [x for x in self.nodes if x.mark and x.size]
        free = {id(x) for x in own if id(x) not in apart} or {id(x) for x in own if id(x) not in wrapped}
        outer = [x for x in own if x.mark == "article" and id(x) in free and id(x.up) not in in_article]
        largest = max((x.size for x in outer), default=0)
        small = [x for x in outer if x.size < FAIR * largest]
        if sum(x.size for x in small) < largest:
            for x in small:
                x.named = True
                free.discard(id(x))
        with_article = self._above({id(x) for x in outer})
        inside: set[int] = set()
        self.marked: list[Node] = []
        for x in self.nodes:
            if x.tag == "header" and x.named:
                x.named = id(x) not in in_article and (id(x) not in home or home[id(x)] in with_article)
            if id(x.up) in inside:
                inside.add(id(x))
            elif id(x) in free:
                inside.add(id(x))
                self.marked.append(x)
        self.holders = self._above({id(x) for x in self.marked})

    def _above(self, of: set[int]) -> set[int]:
        """All elements around the given ones."""
        out: set[int] = set()
        for x in reversed(self.nodes):
            if x.up and (id(x) in of or id(x) in out):
                out.add(id(x.up))
        return out

    def _text(self, stack: list, text: str) -> None:
        top = stack[-1] if stack else None
        if isinstance(top, str):  # within an element that isn't read
            return
        self.runs.append((top or ROOT, text))
        size = len("".join(text.split()))
        self.size += size
        while top:
            top.size += size
            top = top.up

    def core(self, marks: bool = True) -> set[int]:
        """The containers of the article: article and main elements, or (and without ``marks``) the smallest one that holds half of the text."""
        if self.marked and marks:
            return {id(x) for x in self.marked}
        at = None
        level = [x for x in self.nodes if not x.up]
        while True:
            large = next((x for x in level if 2 * x.size >= self.size and not x.flow), None)
            if large is None:
                return {id(at)} if at else set()
            at, level = large, large.children


ROOT = Node(None, "", "", "", False, False, False, False, False)


def _tokens(page: str):
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") in order."""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", html.unescape(page[at:]), ""
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not end and tag in RAW:  # its content is not markup
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            yield "start", "br", ""
            continue
        yield ("end" if end else "start"), tag, attrs


def nodes(page: str) -> dict[int, tuple[str, str, float]]:
    """Content, presentation (styles of the children) and share of the text of every node of the page's tree, by path."""
    p = Page(page)
    content: dict[int, list[str]] = {}
    build: dict[int, list[str]] = {}
    size: dict[int, int] = {}
    for x in p.nodes:
        if x.size:
            content.setdefault(x.path, [])
            build.setdefault(x.path, []).append(",".join(y.style for y in x.children))
            size[x.path] = size.get(x.path, 0) + x.size
    for x, text in p.runs:
        if x is not None and text.strip():
            while x is not None and x is not ROOT:
                content[x.path].append(text)
                x = x.up
    return {path: (" ".join("".join(content[path]).split()), ";".join(build[path]), min(1.0, size[path] / p.size)) for path in content}


def main_text(page: str, importance: dict[int, float], least: float = LEAST, names: bool = True) -> str:
    """Text of a page without the branches that are less important than ``least``; without what trees say, if nothing else would be left.

    ``importance`` need not hold nodes of UNKNOWN or more.  Without ``names``
    no tag or name says that a part is the article or isn't.
    """
    p = Page(page)
    core = p.core(names)
    gone: dict[int, bool] = {id(ROOT): bool(p.marked) and names}
    inside: dict[int, bool] = {id(ROOT): False}
    for x in p.nodes:  # parents come first
        up = id(x.up) if x.up else None
        inside[id(x)] = within = id(x) in core or bool(up and inside[up])
        if up and gone[up]:
            gone[id(x)] = True
            continue
        if x.tag in ("html", "body") or id(x) in core or within and x.flow:
            gone[id(x)] = False
            continue
        value = importance.get(x.path, UNKNOWN + (1 - UNKNOWN) * x.size / max(1, p.size))
        value += RUNNING * x.flow
        if names:
            holds = id(x) in p.holders
            most = 2 * x.size >= p.size
            if within:
                value += INSIDE
            elif p.marked and not holds and not within:
                value += OUTSIDE
            if x.named and not (holds or most and not p.marked):
                value += NAMED
            elif x.worded and not (holds or most):
                value += WORDED
        gone[id(x)] = value < least
    kept = [" " if x is None else text for x, text in p.runs if x is None or not gone[id(x)] or x.tag in ("html", "body") and not p.marked]
    text = " ".join("".join(kept).split())
    return main_text(page, {}, least, names) if importance and not text else text


def _rows(frame: pd.DataFrame) -> pd.DataFrame:
    rows = [
        (h, path, xxhash.xxh64_intdigest(text) >> 1, xxhash.xxh64_intdigest(build) >> 1, share)
        for url, page in zip(frame["url"].tolist(), frame["html"].tolist())
        for h in [host(url)]
        for path, (text, build, share) in nodes(page or "").items()
    ]
    return pd.DataFrame(rows, columns=["host", "path", "content", "build", "share"])


def _paths(frame: pd.DataFrame) -> pd.DataFrame:
    """page, host, path of the nodes with text of every page."""
    rows = [(key, host(url), path) for key, url, page in zip(frame["page"], frame["url"], frame["html"]) for path in {x.path for x in Page(page or "").nodes if x.size}]
    return pd.DataFrame(rows, columns=["page", "host", "path"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, kind, value, n, share: contents (kind 0) and presentations (1) of every node of every host's tree, on how many pages, and their shares' sum."""
    seen = pages.select("url", "html").mapInPandas(by_batch(_rows, column="html"), "host string, path long, content long, build long, share double")
    seen = seen.groupBy("host", "path", "content", "build").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    # a node's shares are summed up with its contents only
    two = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value"), F.col("share").alias("share")), F.struct(F.lit(1).alias("kind"), F.col("build").alias("value"), F.lit(0.0).alias("share")))
    seen = seen.select("host", "path", "n", F.explode(two).alias("x"))
    return seen.groupBy("host", "path", "x.kind", "x.value").agg(F.sum("n").alias("n"), F.sum("x.share").alias("share"))


def importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """pages and importance of every node: half its content's entropy, half the larger of its presentation's and its share."""
    each = counts.groupBy(*keys, "kind", "value").agg(F.sum("n").alias("n"), F.sum("share").alias("share")) if "host" not in keys else counts
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log2("n")))
    whole = each.groupBy(*keys).agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"), of(0).alias("c"), of(1).alias("b"), F.sum("share").alias("share"))
    # entropy of the values, relative to that of pages which all differ
    bits = lambda s: F.when(F.col("pages") > 1, 1 - F.col(s) / (F.col("pages") * F.log2("pages"))).otherwise(1.0)
    return whole.select(*keys, "pages", (bits("c") / 2 + F.greatest(bits("b"), F.col("share") / F.col("pages")) / 2).alias("importance"))


def low_nodes(pages: DataFrame, scratch: Scratch, min_pages: int = 8) -> DataFrame:
    """host, path, importance of the nodes under UNKNOWN; the others are as good as unknown ones."""
    counts = scratch.save(style_tree(pages), "counts")
    own = importance(counts, ["host", "path"])
    overall = importance(counts, ["path"]).where((F.col("pages") >= min_pages) & (F.col("importance") < UNKNOWN)).select("path", F.col("importance").alias("common"))
    judged = own.join(overall, "path", "left")
    value = F.when(F.col("pages") >= min_pages, F.col("importance")).otherwise(F.col("common"))
    return scratch.save(judged.select("host", "path", value.alias("importance")).where(F.col("importance") < UNKNOWN), "low")


def _texts(low: dict[str, dict[int, float]] | None, least: float, names: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if low is None:
            known = [dict(zip(a, b)) if a is not None else {} for a, b in zip(frame["paths"].tolist(), frame["values"].tolist())]
        else:
            known = [low.get(host(u), {}) for u in frame["url"].tolist()]
        texts = [main_text(p or "", x, least, names) for p, x in zip(frame["html"].tolist(), known)]
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return run


def extract(pages: DataFrame, min_pages: int = 8, least: float = LEAST, broadcast_rows: int = 100_000, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The nodes of low importance go to all tasks if there are at most
    ``broadcast_rows`` of them; else they are joined by host and path with the nodes of every page.
    """
    s = Scratch(pages.sparkSession, "site")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = low_nodes(pages, s, min_pages)
    kind = "page_id long, url string, text string, n_chars long"
    if low.count() <= broadcast_rows:
        by: dict[str, dict[int, float]] = {}
        for r in low.collect():
            by.setdefault(r.host, {})[r.path] = r.importance
        return s.close(pages.mapInPandas(by_batch(_texts(by, least, names), column="html"), kind))
    # each distinct page asks for its own nodes, so no row grows with its host
    page = F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\x00"), F.coalesce("html", F.lit(""))).cast("binary"))
    keyed = pages.withColumn("page", page)
    asked = keyed.select("page", "url", "html").mapInPandas(by_batch(_paths, column="html"), "page string, host string, path long").distinct()
    found = asked.join(low, ["host", "path"]).groupBy("page").agg(F.collect_list(F.struct("path", "importance")).alias("x"))
    lists = s.save(found.select("page", F.col("x.path").alias("paths"), F.col("x.importance").alias("values")), "lists")
    joined = keyed.join(lists, "page", "left").select("page_id", "url", "html", "paths", "values")
    return s.close(joined.mapInPandas(by_batch(_texts(None, least, names), column="html"), kind))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
