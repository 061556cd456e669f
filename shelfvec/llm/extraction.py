"""Main text of web pages by a vote over each host's pages.

1. Every page is parsed and its containers are scored by the text they hold
   outside links and page furniture. The best container's path, its tags and
   generalised classes from the root, is the page's vote.
2. Votes are summed per host in Spark; the path with the highest total wins.
3. Pages are parsed again and the containers on the host's winning path are
   extracted. A page without such a container, or where it holds far less than
   the page's own best one, uses its own.

Numbers in classes are generalised, so ``post-17`` and ``post-18`` are one
class. Votes are sums per host and path; a host with a third of all pages sends
one row per task and path.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

#: A tag's attributes by the rules of HTML: a value without quotes may hold quotes, and
#: a quote that is never closed is part of such a value.
ATTRIBUTES = r"(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
#: Elements that never hold main text.
FURNITURE = {"script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "noembed", "noframes", "xmp", "audio", "video", "map", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "search"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "blockquote", "center"}
#: Tags that close an open element of the first kind when they start.
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body"}
#: Words that mark furniture wherever they stand in a class, id or role.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "sidebar", "related", "recommended", "share", "sharing", "comment", "comments", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "toolbar", "pagination", "pager", "copyright", "disclaimer", "complementary", "contentinfo", "paywall"}
#: Words that do so only as what a name is about: "search-box", but not "search-results" or "legal-news".
WEAK_MARKS = {"promo", "promotion", "banner", "menu", "header", "aside", "widget", "social", "reply", "discussion", "notice", "notices", "subscription", "signup", "login", "form", "search", "legal", "alert", "skip", "dialog", "teaser"}
#: Words after one that say nothing about the content.
NEUTRAL = {"area", "bar", "block", "body", "box", "buttons", "col", "column", "container", "group", "holder", "icons", "inner", "item", "items", "link", "links", "list", "outer", "panel", "row", "section", "slot", "text", "unit", "wrap", "wrapper", "zone"}
#: Of these an article's own head or title may carry the word.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "body", "html"}
#: Words before a mark that speak of the page's layout, as in "has-sidebar".
LAYOUT = {"has", "with", "no", "without", "content", "wrapper", "layout"}
SPACE = re.compile(r"\s+")
WORDS_IN_NAME = re.compile(r"[a-z]+")


class Node:
    """An open or closed element; ``block`` is the nearest block around it, ``key`` stands for its path."""

    __slots__ = ("tag", "step", "key", "parent", "block", "furniture", "text", "linked")

    def __init__(self, tag: str, step: str, parent: Node | None, furniture: bool):
        self.tag, self.step, self.parent, self.furniture = tag, step, parent, furniture
        self.block = None if parent is None else parent if parent.tag in BLOCKS else parent.block
        self.key = next_key(parent.key if parent else b"", step) if step else parent.key
        self.text = self.linked = 0

    @property
    def path(self) -> str:
        """Tags and classes of the blocks from the root; built only for the few nodes that need it."""
        steps, at = [], self
        while at is not None:
            if at.step:
                steps.append(at.step)
            at = at.parent
        return ">".join(reversed(steps))


def next_key(key: bytes, step: str) -> bytes:
    return hashlib.blake2b(key + step.encode(errors="surrogatepass"), digest_size=12).digest()


def path_key(path: str | None) -> bytes | None:
    if path is None:
        return None
    key = b""
    for step in path.split(">"):
        key = next_key(key, step)
    return key


def general_class(names: str) -> str:
    """Classes in order of the alphabet, digits as one sign."""
    return ".".join(sorted({re.sub(r"\d+", "#", n) for n in names.lower().replace(">", "").split()}))


def marks_furniture(name: str) -> bool:
    """Whether a class, id or role names furniture, by its words or by its last word that tells."""
    found = WORDS_IN_NAME.findall(name)
    if LAYOUT.intersection(found):
        return False
    if any(w in MARKS for w in found):
        return True
    telling = [w for w in found if w not in NEUTRAL]
    return bool(telling) and telling[-1] in WEAK_MARKS


def is_furniture(tag: str, named: dict[str, str], marks: bool = True) -> bool:
    """Whether an element never holds main text; without ``marks`` its names do not count."""
    if tag in FURNITURE:
        return True
    if "hidden" in named or named.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.I):
        return True
    if tag in HEADINGS:
        return False
    if not marks:
        return False
    names = [n for k in ("class", "id", "role") for n in named.get(k, "").lower().split()]
    if any(LAYOUT.intersection(WORDS_IN_NAME.findall(n)) for n in names):
        return False
    return any(marks_furniture(n) for n in names)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Containers of a page, and its blocks of text with the element around each.

    Where names alone would leave no unlinked text, they do not count.
    """
    nodes, blocks = parse_with(page, True)
    if not any(n.text > n.linked for n in nodes):
        plain = parse_with(page, False)
        if any(n.text > n.linked for n in plain[0]):
            return plain
    return nodes, blocks


def parse_with(page: str, marks: bool) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The same for a given reading of classes, ids and roles.

    Furniture is walked over: its text is not kept. Tags may be missing or
    crossed; an end tag closes up to its element if that is open, else nothing.
    """
    root = Node("html", "html", None, False)
    stack, nodes = [root], [root]
    blocks: list[tuple[Node, str]] = []
    buffer: list[str] = []
    owner = [root]
    links = 0
    hidden = 0
    # Open elements by tag, so that an end tag without a partner costs nothing.
    opened: dict[str, int] = {"html": 1}

    def flush() -> None:
        text = SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            blocks.append((owner[0], text))
        buffer.clear()

    def pop() -> None:
        nonlocal links, hidden
        node = stack.pop()
        opened[node.tag] -= 1
        if node.tag == "a":
            links -= 1
        if node.furniture:
            hidden -= 1
        if node.tag in BLOCKS or node.furniture:
            flush()

    def add(raw: str) -> None:
        if hidden or not raw:
            return
        if not buffer:
            at = stack[-1]
            owner[0] = at if at.tag in BLOCKS or at.block is None else at.block
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        size = len(text.strip())
        if size:
            at = owner[0]
            at.text += size
            if links:
                at.linked += size

    position, size = 0, len(page)
    while position < size:
        found = TOKEN.search(page, position)
        if not found:
            add(page[position:])
            break
        if found.start() > position:
            add(page[position : found.start()])
        position = found.end()
        if found[0].startswith("<![CDATA["):
            continue
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if opened.get(tag) and (tag != "html" or opened[tag] > 1):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in SAME:
            closes = ({"p"} if tag in CLOSES_P else set()) | SAME.get(tag, set())
            for depth in range(len(stack) - 1, 0, -1) if any(opened.get(c) for c in closes) else ():
                if stack[depth].tag in closes:
                    while len(stack) > depth:
                        pop()
                elif stack[depth].tag in SCOPES:
                    break
        if tag in BLOCKS:
            flush()
        attributes = found[3]
        named = {}
        if attributes and attributes.strip(" /"):
            named = {
                m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "")
                for m in ATTRIBUTE.finditer(attributes)
            }
        parent = stack[-1]
        if tag in ("html", "body") and opened.get(tag):
            continue
        furniture = is_furniture(tag, named, marks)
        step = ""
        if tag in BLOCKS:
            classes = general_class(named.get("class", ""))
            step = tag + (f".{classes}" if classes else "")
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*/?>", re.I).search(page, position)
            position = end.end() if end else size
            if furniture:
                flush()
            continue
        node = Node(tag, step, parent, furniture)
        opened[tag] = opened.get(tag, 0) + 1
        if furniture:
            flush()
            hidden += 1
        if tag == "a":
            links += 1
        stack.append(node)
        if tag in BLOCKS and not furniture:
            nodes.append(node)
    while len(stack) > 1:
        pop()
    flush()
    return nodes, blocks


def scored(nodes: list[Node]) -> dict[int, float]:
    """Score of each container: unlinked text below it, less the deeper it lies.

    A container counts the text of its own paragraphs in full and that of
    containers within it by nine tenths, so the innermost one that holds
    nearly all of the text is best.
    """
    sums: dict[int, float] = {}
    for node in reversed(nodes):
        own = sums.get(id(node), 0.0) + node.text - node.linked
        sums[id(node)] = own
        at = node.block
        if at is not None:
            weight = 0.9 if node.tag in CONTAINERS else 1.0
            sums[id(at)] = sums.get(id(at), 0.0) + weight * own
    for node in nodes:
        if node.tag in ("article", "main"):
            sums[id(node)] *= 1.1
    return sums


def vote(page: str | None) -> tuple[str, float] | None:
    """The path of a page's best container and its score."""
    if not page:
        return None
    nodes, _ = parse(page)
    scores = scored(nodes)
    best = max((n for n in nodes if n.tag in CONTAINERS or n.parent is None), key=lambda n: scores[id(n)])
    score = scores[id(best)]
    return (best.path, score) if score > 0 else None


def text_on(page: str | None, path: str | None, least_share: float = 0.3) -> str:
    """Blocks of the containers on a path, or of the page's own best container."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    scores = scored(nodes)
    best = max((n for n in nodes if n.tag in CONTAINERS or n.parent is None), key=lambda n: scores[id(n)])
    key = path_key(path)
    chosen = {id(n) for n in nodes if n.key == key}
    if not chosen or sum(scores[c] for c in chosen) < least_share * scores[id(best)]:
        chosen = {id(best)}
    inside: dict[int, bool] = {}

    def within(node: Node | None) -> bool:
        trail = []
        while node is not None and id(node) not in inside and id(node) not in chosen:
            trail.append(id(node))
            node = node.parent
        found = node is not None and (id(node) in chosen or inside[id(node)])
        inside.update(dict.fromkeys(trail, found))
        return found

    return "\n".join(text for node, text in blocks if within(node))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "main_text") -> DataFrame:
    """Add the main text of every page; ``html`` itself is left out.

    A null or empty page has an empty text. A null url belongs to the host
    without a name. Repeated rows vote as often as they stand. A column with the
    new one's name is replaced. An empty table gives an empty table.
    """
    ensure_shipped(pages.sparkSession)
    ballot = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.LongType())])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            hosts = batch.column("host").to_pylist()
            for host, page in zip(hosts, batch.column("html").to_pylist(), strict=True):
                cast = vote(page)
                if cast:
                    # A page has one vote, however long; its score only tells ties apart.
                    key = (host, cast[0])
                    sums[key] = sums.get(key, 0) + 1_000_000 + min(999_999, round(cast[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.string()),
                    pa.array([k[1] for k in sums], pa.string()),
                    pa.array(list(sums.values()), pa.int64()),
                ],
                names=ballot.names,
            )

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    totals = rows.mapInArrow(votes, ballot).groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = totals.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))
    winners = materialize(winners, "host-paths")
    rest = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType(), False)])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column("_page").to_pylist(), batch.column("_path").to_pylist(), strict=True)
            row = batch.column("_in")
            yield pa.RecordBatch.from_arrays(
                [row.field(n) for n in kept] + [pa.array([text_on(p, w) for p, w in found], pa.string())],
                names=[*kept, text_col],
            )

    keyed = pages.select(
        F.struct(*kept).alias("_in"), F.col(html_col).alias("_page"), host_of(F.col(url_col)).alias("_host")
    )
    joined = keyed.join(
        winners.select(F.col("host").alias("_winner"), F.col("path").alias("_path")),
        F.col("_host") == F.col("_winner"),
        "left",
    )
    return joined.select("_in", "_page", "_path").mapInArrow(extracted, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """The registered query: each page's main text and its length; nulls and repeats as in ``main_texts``."""
    found = main_texts(pages.select("page_id", "url", "html"), text_col="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
