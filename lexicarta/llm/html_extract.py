"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Paragraphs pass points, for their length and
their commas, to the elements around them: all of them to the parent, half to its parent, and less to
those further out. An element's points are discounted by the share of its text that
lies in links. The element with most points, and those of its siblings that look like
parts of the same text, are the article; the blocks in it are its text.

Elements that hold no article text by their meaning (menus, headers, footers, sidebars,
forms, scripts, ...) or by what their class, id or role says of them are left out
before scoring.

Defined results: a null or empty page, and one without text, give an empty text. Tags that
are not closed end where their parent ends or where HTML lets them end; stray end tags,
unfinished tags and comments do no harm. A null ``page_id`` or ``url`` is kept; rows
that repeat are each extracted. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexicarta.llm.common import filled, only, text_slices

#: Elements of HTML by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "head script style template noscript nav header footer aside form button select option textarea input label "
    "fieldset iframe object embed svg canvas audio video map menu dialog noframes title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr ruby rb rp rt img label nobr".split()
)
#: Paragraph-like elements give points.
SCORED = frozenset("p pre blockquote td li dd h2 h3 h4".split())
#: A start tag of the key ends open elements of these names, up to a container.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}} | {
    k: {"td", "th"} for k in ("td", "th")
}
BOUNDARY = {
    "li": {"ul", "ol", "menu"},
    "dd": {"dl"},
    "dt": {"dl"},
    "option": {"select"},
    "tr": {"table"},
    "td": {"tr", "table"},
    "th": {"tr", "table"},
}

#: Words in class, id or role that tell what an element is for.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo|promoted|nav|navbar|"
    r"navigation|menu|breadcrumbs?|sidebar|side-bar|rail|related|recommend(?:ed|ations)?|share|sharing|social|"
    r"comments?|comment-list|respond|reply|replies|disqus|cookies?|consent|gdpr|notice|notification|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|search|footer|header|masthead|pager|pagination|"
    r"widget|toolbar|skip|tags|byline-share|complementary|contentinfo|banner|dialog|hidden)(?:$|[\s_-])",
    re.I,
)
#: Those that also name a paragraph of the article itself.
OF_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:search|notice|notification|alert|tags|skip|overlay|header|footer|rail|menu|login|signup|"
    r"widget|toolbar)(?=$|[\s_-])",
    re.I,
)
#: Elements that are a paragraph, a headline or a part of one.
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split()) | INLINE
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|comment-list|respond|repl(?:y|ies)|disqus)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    # A quote begins a value only behind an equals sign; elsewhere it is a stray character of the tag.
    r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = {"class", "id", "role", "itemprop", "style", "aria-hidden"}


class Element:
    __slots__ = ("name", "parent", "children", "dropped", "doubtful", "bonus", "own", "points", "chars", "link_chars")

    def __init__(self, name: str, parent: Element | None, dropped: bool = False, bonus: float = 0.0):
        self.name, self.parent, self.dropped, self.bonus = name, parent, dropped, bonus
        self.doubtful = False
        self.children: list[Element | str] = []
        self.points = self.chars = self.link_chars = 0.0
        self.own = False


def _described(name: str, attributes: str, in_article: bool = False) -> tuple[bool, bool, float]:
    """Whether the element is left out, whether that is doubtful, and its bonus as a container.

    Doubtful is what only the name of a part of a page says: a wrapper may be named after
    the sidebar that it makes room for. A paragraph inside an article may be named after a notice or a search.
    """
    bonus = 25.0 if name in ("article", "main") else 5.0 if name in ("div", "section") else 0.0
    if name in LEFT_OUT:
        return True, False, 0.0
    dropped = doubtful = False
    if attributes:
        for match in _ATTRIBUTE.finditer(attributes):
            key = match[1].lower()
            if key == "hidden":
                dropped = True
            if key not in _NAMES:
                continue
            value = html.unescape(match[2] or match[3] or match[4] or "")
            if key == "style":
                dropped |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "aria-hidden":
                dropped |= value.lower() == "true"
            elif name not in ("html", "body", "article", "main") or key == "role":
                if COMMENT.search(value):
                    dropped = True
                else:
                    if in_article and name in PARAGRAPHS:
                        value = OF_ARTICLE.sub(" ", value)
                    doubtful |= bool(ASIDE.search(value))
            elif COMMENT.search(value):
                dropped = True
            if CONTENT.search(value) or value.lower() in ("articlebody", "main"):
                bonus += 25.0
    return dropped or doubtful, doubtful and not dropped, bonus


def parse(page: str) -> Element:
    """The tree of a page, texts with character references decoded."""
    root = Element("#root", None)
    doubted: list[Element] = []
    headers: list[Element] = []
    top, at, end = root, 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            top.children.append(html.unescape(page[at:upto]))

    def close(names: set[str] | frozenset[str], boundary: set[str]) -> Element:
        """The parent of the innermost open element of these names, not looking past the boundary."""
        node = top
        while node is not root and node.name not in boundary:
            if node.name in names:
                return node.parent
            node = node.parent
        return top

    search = _TOKEN.search
    while at < end:
        match = search(page, at)
        if match is None:
            text(end)
            break
        text(match.start())
        at = match.end()
        if match[2] is None:
            continue
        name = match[2].lower()
        if match[1]:
            node = top
            while node is not root and node.name != name:
                node = node.parent
            if node is not root:
                top = node.parent
            elif name == "p":
                top.children.append(Element("p", top))
            continue
        if name in BLOCKS:
            top = close({"p"}, {"button", "td", "th", "table", "object", "div", "article", "section", "main", "aside"})
        if name in ENDS:
            top = close(ENDS[name], BOUNDARY[name])
            if name == "tr":
                top = close({"tr"}, {"table"})
        if name == "body" and top.name == "head":
            top = top.parent
        in_article = name in PARAGRAPHS and "=" in match[3] and _within(top, ("article", "main"))
        dropped, doubtful, bonus = _described(name, match[3], in_article)
        element = Element(name, top, dropped, bonus)
        if name == "header":
            headers.append(element)
        if doubtful:
            element.doubtful = True
            doubted.append(element)
        top.children.append(element)
        if name in VOID or match[3].endswith("/") and name not in RAW and name not in BLOCKS:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            until = stop.start() if stop else end
            if not element.dropped:
                element.children.append(html.unescape(page[at:until]))
            at = stop.end() if stop else end
            continue
        top = element
    for header in headers:
        if _within(header.parent, ("article",)) and _only_headlines(header):
            header.dropped = False
    _reconsider(root, doubted)
    return root


def _within(node: Element | None, names: tuple[str, ...]) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def _only_headlines(header: Element) -> bool:
    """Whether all text of an article's header is in headlines, and none of it is left out for another reason."""
    stack, found = list(header.children), False
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                return False
        elif node.name in HEADLINES:
            found = True
        elif node.dropped:
            return False
        else:
            stack += node.children
    return found


def _reconsider(root: Element, doubted: list[Element]) -> None:
    """Takes back what is doubtful of elements around an article, or around a headline and most of the text."""

    def chars(nodes: list[Element]) -> int:
        return sum(len(c.strip()) for n in nodes for c in n.children if isinstance(c, str))

    total = None
    for element in doubted:
        inside = _walk(element, doubtful=True)
        names = {n.name for n in inside[1:]}
        keep = not names.isdisjoint(("article", "main"))
        if not keep and "h1" in names:
            total = chars(_walk(root, doubtful=True)) if total is None else total
            keep = 2 * chars(inside) >= total
        if keep:
            element.dropped = False


def _walk(root: Element, doubtful: bool = False) -> list[Element]:
    """All elements that are not left out, parents before children; ``doubtful`` ones too if asked for."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        for child in reversed(node.children):
            if not isinstance(child, str) and (not child.dropped or doubtful and child.doubtful):
                stack.append(child)
    return found


def blocks(top: Element) -> list[str]:
    """The texts of the blocks in an element, in page order, white space as single spaces."""
    found: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        if line:
            found.append(line)
        parts.clear()

    stack: list[Element | str | None] = [top]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            parts.append(node)
        elif node.dropped and node is not top:
            continue
        elif node.name in ("br", "img"):
            parts.append(" ")
        elif node.name in INLINE:
            stack += reversed(node.children)
        else:
            flush()
            stack.append(None)
            stack += reversed(node.children)
    flush()
    return found


def article(root: Element) -> list[Element]:
    """The best container and those siblings that belong to it, in page order."""
    nodes = _walk(root)
    for node in reversed(nodes):  # children first
        texts = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if not isinstance(c, str) and not c.dropped]
        node.chars = texts + sum(c.chars for c in kids)
        node.link_chars = node.chars if node.name == "a" else sum(c.link_chars for c in kids)
    for node in nodes:
        straight = node.name not in SCORED and node.name not in INLINE and any(
            isinstance(c, str) and c.strip() for c in node.children
        )
        if not (node.name in SCORED or straight) or not node.chars or node is root:
            continue
        text = " ".join(" ".join(blocks(node)).split())
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 10)
        points *= 1 - node.link_chars / node.chars
        giver = node if straight else node.parent
        share = 1.0
        while giver is not None and share > 0.05:
            giver.points += points * share
            giver.own = True
            giver, share = giver.parent, share / 2
    candidates = [n for n in nodes if n.own and n.name not in ("#root", "html", *INLINE) and n.chars]
    if not candidates:
        whole = [n for n in nodes if n.name == "body"] or [root]
        return whole[:1]

    def rank(node: Element) -> float:
        return (node.points + node.bonus) * (1 - node.link_chars / node.chars)

    best = max(candidates, key=rank)
    # An article that surrounds the best container is the article.
    node = best.parent
    while node is not None:
        if node.name in ("article", "main") or node.bonus >= 30:
            best = node
            if node.name == "article":
                break
        node = node.parent
    if best.parent is None or best.name in ("body", "main"):
        return [best]
    # A sibling half as good as the best belongs to it, also where neither has many points.
    limit, found = max(min(10.0, 0.5 * rank(best)), 0.2 * rank(best)), []
    for node in best.parent.children:
        if isinstance(node, str) or node.dropped:
            continue
        if node is best or node.own and rank(node) >= limit:
            found.append(node)
        elif node.name in ("h1", "h2") and not found and node.chars:
            found.append(node)  # the headline above the text
        elif node.name == "p" and node.chars:
            links = node.link_chars / node.chars
            if node.chars > 80 and links < 0.25 or links == 0 and re.search(r"[.!?。]$", " ".join(blocks(node))):
                found.append(node)
    return found


def main_text(page: str) -> str:
    """The blocks of the article, joined by line feeds."""
    root = parse(page)
    text = "\n".join(line for part in article(root) for line in blocks(part))
    if not text and (doubted := [n for n in _walk(root, doubtful=True) if n.doubtful and n.dropped]):
        # Better what only its name speaks against than nothing.
        for node in doubted:
            node.dropped = False
        for node in _walk(root):
            node.points, node.own = 0.0, False
        text = "\n".join(line for part in article(root) for line in blocks(part))
    return text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html", limit=4 << 20):
        texts = [main_text(page) for page in filled(batch.column("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``."""
    rows = only(pages, page_id="bigint", url="string", html="string")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string")
