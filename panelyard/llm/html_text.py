"""Operator 6: main text of web pages by tree scoring.

Each paragraph passes points for its length and commas to its ancestors, less
with each level; a container's points are discounted by the share of its text
that lies in links. The best container and the siblings that look like its
continuation are kept, without menus, notices, forms and comments inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused

# HTML's element groups and the words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title select option datalist audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("nav footer aside button menu dialog head fieldset label".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th div section article main body html".split())
PARAGRAPH = frozenset("p pre blockquote td dd li".split())
TAG_POINTS = {"article": 25, "main": 15, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "th": -5}
BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|byline-share|consent|cookies?|disclaimer|footer|gdpr|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|popup|promo|promoted|recommended|related|search|share|sharing|sidebar|side|signup|skip|skyscraper|social|sponsor|sponsored|subscribe|tags?|toolbar|topbar|widget)(?:$|[\s_\d-])", re.I)
COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_\d-])", re.I)
LAYOUT_NAME = re.compile(r"(?:has|no|with|without|is)-\S*|\S*-(?:enabled|disabled)|side-by-side", re.I)
HEAD_NAME = re.compile(r"(?:^|[\s_-])(?:site-?header|page-?header|top-?header|header)(?:$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?/]|[a-zA-Z])")
END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)")
NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
INSIDE = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*")
PLAIN_TAG = re.compile(r"<([a-zA-Z][^\s/<>]*)([^<>]*)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("comment", "drop", "inside", "kids", "link", "links", "main", "name", "parent", "points", "size", "suspect", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.name, self.drop, self.suspect = tag, parent, [], "", False, False
        self.comment, self.inside = False, False
        self.points, self.size, self.link, self.links, self.main = 0.0, 0, 0, 0, False


def _marked(node: Node, attributes: str, inside: bool) -> None:
    """Sets name, drop, comment and suspect of an element from its attributes; inside: whether it stands in an article or main."""
    protected = node.tag in ("html", "body", "article", "main")
    node.drop = node.tag in DROP or node.tag == "header" and not inside
    node.suspect, node.inside = node.tag == "form", inside
    if attributes and not attributes.isspace():
        names = []
        for k, a, b, c in ATTRIBUTE.findall(attributes):
            k, v = k.lower(), a or b or c
            if k in ("class", "id"):
                names += v.split()
            elif k == "role":
                node.suspect |= v.strip().lower() in BAD_ROLE and not protected
            elif k == "style":
                node.drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I))
            elif k == "hidden" or v.strip().lower() == "true":
                node.drop = True
        node.name = " ".join(names)
        said = " ".join(x for x in names if not LAYOUT_NAME.fullmatch(x))
        if said and not protected:
            node.comment = bool(COMMENT_NAME.search(said))
            node.suspect |= bool(BAD_NAME.search(said)) or not inside and bool(HEAD_NAME.search(said))


@lru_cache(10_000)
def _kinds(tag: str) -> tuple[str, ...]:
    """The kinds of element that an open tag counts as."""
    return (tag, *(["*block"] if tag in BLOCK else []), *(["*scope"] if tag in SCOPE else []))


class _Open:
    """The open elements from the root down, with the places of each tag, so that no step walks the whole depth twice."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        for kind in _kinds(node.tag):
            self.places.setdefault(kind, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, *kinds: str) -> int:
        """The place of the innermost open element of these kinds (none: 0, which is the root's)."""
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=0)

    def close(self, place: int) -> None:
        """Closes the elements from that place on."""
        while len(self.stack) > place:
            node = self.stack.pop()
            for kind in _kinds(node.tag):
                self.places[kind].pop()


def _start_tag(html: str, at: int, plain: bool) -> tuple[str, str, int] | None:
    """(tag, attributes, end) of the start tag at a place, None if it never ends; plain: a tag ends at the next > before any <."""
    if plain:
        m = PLAIN_TAG.match(html, at)
        return (m.group(1).lower(), m.group(2), m.end()) if m else None
    m = NAME.match(html, at)
    end = INSIDE.match(html, m.end()).end()
    return (m.group(1).lower(), html[m.end() : end], end + 1) if html[end : end + 1] == ">" else None


def parsed(html: str) -> Node:
    """The page's elements as a tree, its text as strings among the kids, without comments and raw elements.

    The time is proportional to the length of the page: after a tag whose quotes never close, tags end at the next >.
    """
    root = Node("#", None)
    opened, at, low, plain, never = _Open(root), 0, None, False, set()

    def text(s: str) -> None:
        if s:
            opened.stack[-1].kids.append(unescape(s) if "&" in s else s)

    while (m := MARKUP.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.start()
        if m.group() == "<!--":
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if m.group() == "<![CDATA[":
            end = html.find("]]>", m.end())
            text(html[m.end() : end if end >= 0 else len(html)])
            at = end + 3 if end >= 0 else len(html)
            continue
        if m.group() in ("<!", "<?", "</"):
            e = END_TAG.match(html, at) if m.group() == "</" else None
            end = e.end() - 1 if e else html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            if e:
                tag = e.group(1).lower()
                place = opened.last(tag)
                if place and (tag in BLOCK or place > opened.last("*block")):
                    opened.close(place)
            continue
        found = _start_tag(html, at, plain)
        if found is None and not plain:
            plain, found = True, _start_tag(html, at, True)
        if found is None:  # a sign that opens no tag
            text("<")
            at += 1
            continue
        tag, attributes, at = found
        if tag in RAW:
            if not attributes.endswith("/"):
                low = low or html.lower()
                stop = low.find(f"</{tag}", at) if tag not in never else -1
                close = low.find(">", stop) if stop >= 0 else -1
                if close < 0:
                    never.add(tag)
                at = close + 1 if close >= 0 else (len(html) if tag in ("script", "style", "textarea", "title", "template", "noscript") else at)
            continue
        if tag == "br" or tag == "wbr":
            opened.stack[-1].kids.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P and opened.last("p") > opened.last("*scope"):
            opened.close(opened.last("p"))
        if tag in SAME:
            stops = ("ul", "ol", "menu") if tag == "li" else ("dl",) if tag in ("dt", "dd") else ("table",)
            place = opened.last(*SAME[tag])
            if place > opened.last(*stops):
                if tag == "tr" and opened.stack[place].tag != "tr" and opened.stack[place - 1].tag == "tr":
                    place -= 1
                opened.close(place)
        here = opened.stack[-1]
        node = Node(tag, here)
        _marked(node, attributes, bool(opened.last("article", "main")))
        here.kids.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            opened.push(node)
    text(html[at:])
    return root


def _order(root: Node) -> list[Node]:
    """All elements that are not dropped, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop)
    return out


def _sizes(nodes: list[Node]) -> None:
    """Of each element: the lengths of its text and of that in links, its links, and whether it holds an article or main."""
    for n in nodes:
        n.size = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        n.link, n.links, n.main = (n.size, 1, False) if n.tag == "a" else (0, 0, n.tag in ("article", "main"))
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.link += n.size if n.tag == "a" else n.link
            n.parent.links += n.links
            n.parent.main |= n.main


def _drop_suspects(root: Node) -> None:
    """Elements named like a menu, notice or form go, but not those that wrap the page: an article, or most of the text outside links."""
    nodes = _order(root)
    _sizes(nodes)
    for n in nodes:
        if n.suspect and not n.main and 2 * (n.size - n.link) <= root.size - root.link:
            n.drop = True


def _is_menu(n: Node) -> bool:
    """Lists and boxes of links; in an article only lists of short links, so that references stay, and never paragraphs."""
    if not n.size or n.links < 3 or n.main:
        return False
    if n.inside:
        return n.tag in ("ul", "ol", "div", "table", "section") and n.link > 0.9 * n.size and n.link < 25 * n.links
    return n.tag in ("ul", "ol", "div", "table", "section", "p") and n.link > 0.6 * n.size


def blocks(root: Node) -> Iterator[str]:
    """The text of each block below root in page order, its white space made single spaces, blanks left out."""
    out, todo, now = [], [root], []

    def flush() -> None:
        s = " ".join("".join(now).split())
        now.clear()
        if s:
            out.append(s)

    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            now.append(k)
        elif not k.drop:
            if k.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(k.kids))
    flush()
    return iter(out)


def _scores(nodes: list[Node]) -> dict[int, tuple[Node, float]]:
    """By element: its points from the paragraphs in it, discounted by its share of text in links."""
    scored: dict[int, Node] = {}
    for n in nodes:
        if n.tag not in BLOCK and n.tag != "#" or n.tag[:1] == "h" and n.tag[1:].isdigit():
            continue
        own = "".join(k if isinstance(k, str) else " " * bool(k.tag in BLOCK) or _inline(k) for k in n.kids) if n.tag in PARAGRAPH or any(isinstance(k, str) and not k.isspace() for k in n.kids) else ""
        body = own.strip()
        if not body:
            continue
        points = 1 + body.count(",") + body.count("，") + min(len(body) / 100, 3)
        up, level = n.parent if n.tag in PARAGRAPH and n.parent is not None else n, 0
        while up is not None and level < 5:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points += TAG_POINTS.get(up.tag, 0) + (25 if GOOD_NAME.search(up.name) else 0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    return {i: (n, n.points * (1 - n.link / n.size if n.size else 0)) for i, n in scored.items()}


def _story(root: Node, final: dict[int, tuple[Node, float]]) -> list[Node]:
    """The elements to keep, in page order.

    The innermost article or main that holds the best container and at least half of the prose is kept whole. Without one,
    the best container's siblings that look like its continuation are kept, and so those of its ancestors up to the body.
    """
    best, most = max(final.values(), key=lambda x: x[1])
    up = best
    while up is not None:
        if up.tag in ("article", "main") and 2 * (up.size - up.link) >= root.size - root.link:
            return [up]
        up = up.parent
    keep, here, least = [best], best, max(10.0, 0.2 * most)
    while here.parent is not None and here.tag not in ("body", "html"):
        level = []
        for k in here.parent.kids:
            if k is here:
                level += keep
            elif isinstance(k, Node) and not k.drop and k.size:
                score = final[id(k)][1] if id(k) in final else 0
                alike = k.tag == here.tag and k.name == here.name
                dense = k.link / k.size
                row = alike and dense < 0.25 and score > 0
                line = k.tag == "p" and here is best and (k.size > 80 and dense < 0.25 or k.size <= 80 and not k.link)
                title = k.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup") and dense < 0.25
                if row or line or title or score + (0.2 * most if k.name and k.name == best.name else 0) >= least:
                    level.append(k)
        keep, here = level, here.parent
    return keep


def _extracted(root: Node) -> str | None:
    """The text of the page's story; None where no paragraph passes points."""
    nodes = _order(root)
    _sizes(nodes)
    for n in nodes:
        n.points = 0.0
        if _is_menu(n):
            n.drop = True
    nodes = _order(root)
    _sizes(nodes)
    final = _scores(nodes)
    if not final:
        return None
    return "\n".join(s for k in _story(root, final) for s in blocks(k))


def main_text(html: str | None) -> str:
    """The article's blocks joined by line ends; an empty text if there is none.

    Reader comments are left out by their names, unless nothing else of the page has a paragraph. A page without any
    paragraph gives its other text outside links, such as a heading.
    """
    root = parsed(html or "")
    nodes = _order(root)
    _sizes(nodes)
    comments = [n for n in nodes if n.comment and not n.main]
    for n in comments:
        n.drop = True
    _drop_suspects(root)
    found = _extracted(root)
    if found is None and comments:
        for n in comments:
            n.drop = False
        found = _extracted(root)
    if found is None:
        _sizes(_order(root))
        found = "\n".join(blocks(root)) if root.size > root.link else ""
    return found


def _inline(node: Node) -> str:
    """Text of an inline element without blocks and dropped elements."""
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.drop and k.tag not in BLOCK:
            todo.extend(reversed(k.kids))
    return "".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text in the place of the html: the main text of each page.

    Null and empty html give an empty text, as do pages without text outside menus, notices and forms. Broken markup is
    read as far as it goes: open elements end with the page, stray end tags are passed over. Pages of any length are read
    whole, in time proportional to their length. Rows are taken one by one, so repeated rows give repeated results. Other
    columns stay, whatever their names; one named text is replaced.
    """
    others = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*others).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(len(others))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(others))] + [pa.array(texts, pa.string())], names=[*others, "text"])

    return pages.select(*others, F.col(html).alias(unused("html", others))).mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
