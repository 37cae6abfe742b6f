"""Main text of web pages by scores of the tree.

A scanner reads the page once and builds its tree as HTML says: start tags end
what HTML lets them end, end tags end what is in their scope.  Elements that
aren't main text (menus, adverts, reader comments and the like, known by their
tag or by the words of their class, id and role) are marked and cut out of the
whole tree, so that what they hold is parsed like anything else.

Each block of text then has points: one, one for each comma, and one for each
hundred characters up to three.  Its container gets them in full, the next one
above by half, the next by a quarter, and so on to the root.  A container's sum
is discounted by the share of its text that stands in links.  The best one is
kept, and other containers with enough points of their own: the way up leads to
the element that holds them all, and what else it holds is judged part by part.
"""

from __future__ import annotations

import html
import re
from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

#: What a container further up gets of the points below; share of the best one's points that makes another one part of the text.
HALF, ENOUGH = 0.5, 0.2
#: Least points of another container; share of links from which a part isn't text; characters that make a part text.
LEAST, LINKED, LONG = 3.0, 0.25, 80
#: Points for being marked as the article.
BONUS = {"article": 30.0, "main": 15.0}

#: Elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Never part of the main text.
HARD = frozenset(
    "head noscript template button select label object svg canvas audio video map datalist "
    "script style textarea title xmp iframe noembed noframes plaintext".split()
)
#: Not part of it unless they hold the article.
SOFT = frozenset("nav header footer aside form menu dialog search".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr "
    "html legend li listing main ol p pre section summary table tbody td tfoot th thead tr ul br optgroup option".split()
)
CONTAINERS = frozenset("article main section div body td th blockquote center details html dd fieldset".split())
PARAGRAPHS = CONTAINERS | frozenset("p pre li dt h1 h2 h3 h4 h5 h6 figcaption address summary caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that stop the search for what an inline end tag, or an item's start tag, may end.
SPECIAL = (BLOCKS | SOFT | HARD) - {"br", "hr", "label", "map", "canvas", "audio", "video", "datalist"}
PASSED_BY_ITEMS = frozenset("address div p".split())
#: Start tags that end an open paragraph, and the elements beyond which they don't look.
ENDS_P = (BLOCKS | SOFT) - frozenset("br td th tr tbody thead tfoot caption body html legend optgroup option".split())
SCOPE = ("td", "th", "caption", "table", "object", "template", "button")
#: What a part of a table ends, and where the search for it stops.
CELLS, GROUPS = ("td", "th"), ("tbody", "thead", "tfoot")
ENDS = {
    "td": (CELLS, ("tr", "table")),
    "th": (CELLS, ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table", *GROUPS)),
    **dict.fromkeys(GROUPS, ((*GROUPS, "caption", "colgroup"), ("table",))),
}
TABLE = frozenset("table tr tbody thead tfoot".split())
#: What a head may hold; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template".split())

#: Words of a class or id that mark what isn't the article.
ADS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner".split())
NOTES = frozenset("cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay".split())
MENUS = frozenset("nav navbar navigation menu menus menubar breadcrumb breadcrumbs pager pagination toolbar skip skiplink tags".split())
FRAMES = frozenset("footer masthead sidebar sidebars colophon widget widgets social share sharing subscribe newsletter signup login search searchform".split())
REMARKS = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())
MARKS = ADS | NOTES | MENUS | FRAMES
#: "header" marks alone, in front, or after one of these; in an ``article`` only a name that begins with one of OWN marks.
OF_PAGE = frozenset("site page main global top header".split())
OWN = ADS | frozenset("comment reply related recommended".split())
#: A name that begins or ends with one of these says something about the element, not what it is.
ABOUT = frozenset("has with no non without is not tag category cat type format status show hide".split())
ABOUT_END = frozenset("free off none less".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar".split())
HOLDERS = frozenset("main content main-content maincontent article article-body primary".split())

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(\s*+=\s*+)?)")
_BARE = re.compile(r"[^\s>]*+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMA = re.compile("[,،、，]")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_BLANKS = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?。؟][\"'”’)\]]*$")
_NO_BREAK = HARD - {"head"}


class Node:
    __slots__ = ("tag", "parent", "items", "mark", "weight", "holds", "text", "links", "points", "score", "home", "article")

    def __init__(self, tag: str, parent: "Node | None", mark: str = "", weight: float = 0.0, holds: bool = False):
        self.tag, self.parent, self.mark, self.weight, self.holds = tag, parent, mark, weight, holds
        self.items: list = []  # strings and nodes, in page order
        self.text = self.links = 0
        self.points = self.score = 0.0
        self.home = self.article = None  # the innermost container and article that hold it


def _marks(tag: str, name: str) -> str:
    """What one class or id says: "", "soft" or "remark"."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in ABOUT or words[-1] in ABOUT_END:
        return ""
    if tag == "article":
        words = [words[0]] if words[0] in OWN else []
    if not REMARKS.isdisjoint(words):
        return "remark"
    header = "header" in words and words[0] in OF_PAGE
    return "soft" if header or not MARKS.isdisjoint(words) else ""


def judge(tag: str, attributes: dict[str, str]) -> tuple[str, float, bool]:
    """(mark, points, whether it says that it holds the article) of an element."""
    weight = BONUS.get(tag, 0.0)
    if not attributes:
        return "hard" if tag in HARD else "soft" if tag in SOFT else "", weight, tag == "main"
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in HARD or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return "hard", 0.0, False
    if "display:none" in style or "visibility:hidden" in style:
        return "hard", 0.0, False
    role, item = attributes.get("role", "").lower(), attributes.get("itemprop", "").lower()
    holds = tag == "main" or role == "main" or item == "articlebody" or attributes.get("id", "").lower() in HOLDERS
    if tag in SOFT or role in ROLES:
        return "soft", 0.0, holds
    if item == "comment":
        return "remark", 0.0, holds
    if tag in ("html", "body", "main"):
        return "", weight, holds
    found = {_marks(tag, name) for c in ("class", "id") if c in attributes for name in attributes[c].split()}
    mark = "remark" if "remark" in found else "soft" if "soft" in found else ""
    return mark, weight, holds


class Tree:
    """Open elements, with the places of each tag among them."""

    def __init__(self):
        self.root = Node("html", None)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.special: list[int] = []
        self.body = False

    def last(self, *tags: str) -> int:
        """How deep the innermost open element of these tags is; 0 if there is none."""
        deepest = 0
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > deepest:
                deepest = p[-1]
        return deepest

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in SPECIAL and node.tag not in PASSED_BY_ITEMS:
            self.special.append(len(self.open))
        self.open.append(node)

    def end(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on; 0 means none."""
        while depth and len(self.open) > depth:
            node = self.open.pop()
            self.places[node.tag].pop()
            if self.special and self.special[-1] == len(self.open):
                self.special.pop()

    def implied(self, tag: str) -> None:
        """Ends what HTML ends by itself before a start tag."""
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.end(len(self.open) - 1)
        if tag in ENDS_P and (p := self.last("p")) > self.last(*SCOPE):
            self.end(p)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.end(len(self.open) - 1)
        if tag in ENDS:
            closes, stops = ENDS[tag]
            if (at := self.last(*closes)) > self.last(*stops):
                self.end(at)
        elif tag in ("li", "dt", "dd"):
            at = self.last("li") if tag == "li" else self.last("dt", "dd")
            if at and self.special and self.special[-1] == at:
                self.end(at)
        elif tag == "a" and (at := self.last("a")):
            self.unlink(at)

    def unlink(self, at: int) -> None:
        """Ends a link; one with blocks in it, which stay open, is no link any more."""
        if at > max(self.special[-1] if self.special else 0, self.last(*PASSED_BY_ITEMS)):
            self.end(at)
        else:
            self.open[at].tag = "span"
            self.places["a"].pop()
            insort(self.places.setdefault("span", []), at)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html" or tag == "body" and self.body:
            return
        self.implied(tag)
        node = self.open[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                node.items.append(Node(tag, node))
            return
        mark, weight, holds = judge(tag, attributes)
        if tag == "body":
            self.body = True
        if tag == "a" and "href" not in attributes:
            tag = "span"
        child = Node(tag, node, mark, weight, holds)
        node.items.append(child)
        self.push(child)

    def stop(self, tag: str) -> None:
        """An end tag."""
        if tag in ("html", "body", "a"):
            if tag == "a" and (at := self.last("a")):
                self.unlink(at)
            return
        if tag in HEADINGS:
            at = self.last(*HEADINGS)
        else:
            at = self.last(tag)
        if not at:
            if tag in ("p", "br"):
                self.implied("p" if tag == "p" else "br")
                self.open[-1].items.append(Node("br", self.open[-1]))
            return
        if tag in SPECIAL:
            inner = "table" if tag in TABLE or tag in CELLS else None
            stops = self.last(inner, "template") if inner and tag != "table" else 0 if inner else self.last(*SCOPE)
            if tag == "li":
                stops = max(stops, self.last("ul", "ol"))
            if at >= stops:
                self.end(at)
        elif at > max(self.special[-1] if self.special else 0, self.last(*PASSED_BY_ITEMS)):
            self.end(at)

    def text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self.end(len(self.open) - 1)
        self.open[-1].items.append(text)


def parse(page: str) -> Node:
    """The tree of a whole page.

    Each character is looked at a bounded number of times: a comment, tag or
    raw element without an end takes all the rest, as HTML says; only a quoted
    value without its second quote ends at the next ">", so that no text goes.
    """
    tree, at, n = Tree(), 0, len(page)
    quotes = {q: page.rfind(q) for q in "\"'"}
    seen = 0
    while at < n:
        hit = page.find("<", at)
        if hit < 0:
            break
        after = page[hit + 1 : hit + 3]
        name = _OPEN.match(page, hit + 1 + after.startswith("/"))
        if name is None and after[:1] not in ("!", "?", "/"):
            at = hit + 1  # not a tag
            continue
        if hit > seen:
            tree.text(page[seen:hit])
        if name is None:
            if page.startswith("<!--", hit):
                close = page.find("-->", hit + 2)
                at = n if close < 0 else close + 3
            else:
                close = page.find(">", hit)
                at = n if close < 0 else close + 1
            seen = at
            continue
        tag, attributes, at = name[0].lower(), {}, name.end()
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:  # the page ends within the tag
                return tree.root
            at = m.end()
            if m[1]:
                break
            value = ""
            if m[3]:
                quote = page[at : at + 1]
                if quote in quotes and quotes[quote] > at:
                    close = page.find(quote, at + 1)
                    value, at = page[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            attributes.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
        if after.startswith("/"):
            tree.stop(tag)
        elif tag in RAW:
            tree.implied(tag)
            close = _RAW_END[tag].search(page, at)
            close = page.find(">", close.end()) if close else -1
            at = n if close < 0 else close + 1
        else:
            tree.start(tag, attributes)
        seen = at
    if seen < n:
        tree.text(page[seen:])
    return tree.root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, children after parents, in page order among the children of one."""
    out = [root]
    for node in out:
        out += [x for x in node.items if isinstance(x, Node)]
    return out


def cut(root: Node) -> None:
    """Takes out what is marked.

    A mark is lifted from what holds the article: an element that says so, or,
    unless the mark is for remarks of readers and the like, every unmarked
    ``article`` of the page.
    """
    nodes = nodes_of(root)
    articles = {id(x): int(x.tag == "article" and not x.mark) for x in nodes}
    holds = {id(x): x.holds and x.mark != "hard" for x in nodes}
    for node in reversed(nodes):
        if node.parent is not None and node.mark != "hard":
            articles[id(node.parent)] += articles[id(node)] if node.mark != "remark" else 0
            holds[id(node.parent)] |= holds[id(node)]
    for node in nodes:
        every = node.mark == "soft" and articles[id(root)] > 0 and articles[id(node)] == articles[id(root)]
        if node.mark in ("soft", "remark") and (every or holds[id(node)]):
            node.mark = ""
        if node.mark:
            node.items = []


def own_text(node: Node) -> str:
    """Text of a node that stands in no block or link below it."""
    out, stack = [], list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in BLOCKS and x.tag != "a":
            stack += reversed(x.items)
    return "".join(out)


def points(text: str) -> float:
    """Points of the text of a block."""
    text = _BLANKS.sub(" ", html.unescape(text)).strip()
    return 1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3) if len(text) > 1 else 0.0


def density(node: Node) -> float:
    return node.links / node.text if node.text else 0.0


def measure(root: Node) -> list[Node]:
    """All nodes with lengths of texts and links, own points and scores."""
    nodes = nodes_of(root)
    for node in nodes:
        up = node.parent
        node.home = node if node.tag in CONTAINERS else up.home
        node.article = node if node.tag == "article" else up.article if up else None
        if node.tag in PARAGRAPHS and not node.mark:
            node.home.points += points(own_text(node))
    for node in reversed(nodes):
        node.text += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.links = node.text
        if node.tag in CONTAINERS:
            node.score += node.points
            if node.parent is not None:
                node.parent.home.score += HALF * node.score
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links
    return nodes


def worth(node: Node) -> float:
    """The score of a container with what it gets for being marked, discounted by its links."""
    return (node.score + (node.weight if node.score else 0.0)) * (1 - density(node))


def is_text(node: Node) -> bool:
    """Whether a part beside the best container reads like text."""
    if not node.text or density(node) >= LINKED or node.mark:
        return False
    if node.tag in HEADINGS:
        return True
    if node.tag not in ("p", "details", "pre", "blockquote", "ul", "ol", "dl", "table", "figure") and not any(
        x.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "table") for x in nodes_of(node)[1:]
    ):
        return False
    return node.text > LONG or bool(_SENTENCE.search(_joined(node)))


def _parts(node: Node) -> list[Node]:
    """The parts of an element; text that stands in no block of its own is put into paragraphs."""
    out, run = [], []
    for x in [*node.items, None]:
        if x is not None and (isinstance(x, str) or x.tag not in BLOCKS and not x.mark):
            run.append(x)
            continue
        if run:
            part = Node("p", node)
            part.items = run
            part.text = sum(len(r.strip()) if isinstance(r, str) else r.text for r in run)
            part.links = sum(0 if isinstance(r, str) else r.links for r in run)
            out.append(part)
            run = []
        if x is not None:
            out.append(x)
    return out


def chosen(root: Node) -> list[Node]:
    """The parts of a measured tree that are main text, in page order."""
    nodes = measure(root)
    if not root.text:
        return []
    found = [(worth(x), -i, x) for i, x in enumerate(nodes) if x.tag in CONTAINERS and x.text]
    best = max(found, key=lambda f: f[:2])[2]
    enough = max(LEAST, ENOUGH * best.score * (1 - density(best)))
    others = [x for x in nodes if x.points and x.points * (1 - density(x)) >= enough]
    article, top = best.article, best.article or best
    if article is not None:  # an article is kept whole, and with it other articles only
        others = list({id(x.article): x.article for x in others if x.article is not None}.values())
    below = {id(x) for x in nodes_of(top)}
    ends = [top, *[x for x in others if id(x) not in below]]
    strong = set(map(id, ends))
    # How many of them each element holds; the lowest that holds all is where the ways to them part.
    count = dict.fromkeys(map(id, nodes), 0)
    for x in ends:
        count[id(x)] += 1
    for node in reversed(nodes):
        if node.parent is not None:
            count[id(node.parent)] += count[id(node)]
    base = next(x for x in reversed(nodes) if count[id(x)] == len(ends) and (x is top or id(x) not in below))
    if article is None and top.tag in ("html", "body") and top.points < enough:  # only the way to what it holds
        base, strong = top, {id(x) for x in others if id(x) in below}
        for x in nodes:
            count[id(x)] = int(id(x) in strong)
        for node in reversed(nodes):
            if node.parent is not None:
                count[id(node.parent)] += count[id(node)]
        if not strong:
            return _without_menus(top)
    elif base is top:
        if article is not None or top.parent is None:
            return [top] if article is not None else _without_menus(top)
        base = top.parent
    elif id(base) in strong and article is None:
        return _without_menus(base)
    out, stack = [], [base]
    while stack:
        node = stack.pop()
        if node is not base and id(node) in strong:
            out.append(node)
        elif node is base or count.get(id(node)):
            stack += reversed(_parts(node) if article is None else [x for x in node.items if isinstance(x, Node)])
        elif article is None and is_text(node):
            out.append(node)
    return out


def _without_menus(node: Node) -> list[Node]:
    """A container itself, less the parts directly in it that are nothing but links."""
    for x in node.items:
        if isinstance(x, Node) and x.tag in BLOCKS and x.text and density(x) > 1 - LINKED:
            x.items = []
    return [node]


def _blocks(node: Node, out: list[list[str]]) -> None:
    stack = [(node, 0)]
    while stack:
        x, i = stack.pop()
        breaks = x.tag in BLOCKS or x.mark and x.tag not in _NO_BREAK
        if i == 0 and breaks:
            out.append([])
        if i < len(x.items):
            stack.append((x, i + 1))
            item = x.items[i]
            if isinstance(item, str):
                out[-1].append(item)
            else:
                stack.append((item, 0))
        elif breaks:
            out.append([])


def _joined(*nodes: Node) -> str:
    out: list[list[str]] = [[]]
    for node in nodes:
        out.append([])
        _blocks(node, out)
    texts = (_BLANKS.sub(" ", html.unescape("".join(b))).strip() for b in out)
    return " ".join(t for t in texts if t)


def main_text(page: str | None) -> str:
    """The main text of a whole page: its blocks in page order, joined by a space.

    Character references are decoded; white space inside a block becomes one
    space.  Null, empty and textless pages give an empty text.
    """
    if not page or not page.strip():
        return ""
    root = parse(page)
    cut(root)
    return _joined(*chosen(root))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each as ``text_col`` and its code points as n_chars.

    Columns of the two names are replaced, others pass unchanged; repeated rows
    give equal texts.
    """
    run = F.pandas_udf(lambda pages: pd.Series([main_text(p) for p in pages], dtype=object), "string")
    base = without(pages, *[c for c in (text_col, "n_chars") if c.lower() != html_col.lower()])
    return base.withColumn(text_col, run(F.col(html_col))).withColumn("n_chars", F.length(text_col).cast("long"))
