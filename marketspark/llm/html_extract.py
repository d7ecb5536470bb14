"""Main text of web pages by minimum cut.

The parsed page gives a sequence of text blocks. A linear classifier over tag, length,
link share and the names of enclosing elements gives each block a cost for either label;
the costs are the capacities to the two terminals. Smoothness edges join blocks that
follow each other (weaker the more elements open or close between them) and consecutive
blocks of the same parent. The minimum cut, found by maximum flow, separates content
from boilerplate. Blocks whose costs outweigh all of their edges are settled first,
which leaves the optimum unchanged and the graph small.

One page is one row of work; pages are spread by the scan and nothing is shuffled.

Defined cases: null or empty html gives the empty text. Unclosed and misplaced tags are
closed as browsers do for paragraphs and list items. Repeated rows give equal rows, null
ids and urls stay. White space is what Unicode calls so.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import map_batches

# Fixed word lists of HTML and of names commonly given to page regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
OUTSIDE = frozenset("nav aside footer form menu dialog search".split())
INSIDE = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer foot masthead topbar toolbar share sharing social follow"
    " related recommended recommendations trending newsletter subscribe subscription signup login register search widget widgets disqus hidden skip copyright legal disclaimer"
    " contentinfo complementary".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond responses disqus discussion".split())
HEADER_NAMES = frozenset("header head site-header".split())
INSIDE_NAMES = frozenset("article articlebody content post entry story main maincontent".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
FURNITURE = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookie|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|advertisement|sponsored", re.I)

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
#: States of an element: 1 inside the article, 0 unknown, -1 outside; below that the element's contents are outside too, with these exceptions.
FORM, NAMED, GONE = -2, -3, -4  # an article or main in a form is inside; so is a main below a comment name; nothing else is

#: Weights of the classifier; positive speaks for content.
WEIGHTS = {"base": 0.6, "long": 1.0, "sentence": 0.4, "paragraph": 0.4, "heading": 0.2, "links": -3.0, "list": -0.3, "furniture": -1.5, "inside": 6.0, "outside": -8.0}
NEXT_EDGE, PARENT_EDGE = 0.6, 0.8


class _Element:
    __slots__ = ("tag", "state", "unseen", "number")

    def __init__(self, tag, state, unseen, number):
        self.tag, self.state, self.unseen, self.number = tag, state, unseen, number


def _state(tag: str, attrs: list, above: int, forms: bool = True, strict: bool = True) -> int:
    """State of an element; inherited unless the element says otherwise. ``forms``: a form is outside; ``strict``: so is an article below a comment name."""
    if above == GONE:
        return GONE
    names, root = set(), tag in ("html", "body")
    for key, value in attrs:
        if key in ("class", "id", "role", "itemprop") and value:
            names.update(x.lower() for x in NAME.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return GONE
    if tag in OUTSIDE and tag != "form":
        return GONE
    if names & COMMENT_NAMES and not root:
        return NAMED
    if tag in INSIDE:
        if above < 0 and names & OUTSIDE_NAMES:
            return GONE
        return NAMED if above == NAMED and strict and tag != "main" else 1
    if above == NAMED:
        return NAMED
    if above == FORM or (tag == "form" and forms):
        return FORM
    if names & OUTSIDE_NAMES and not root:
        return -1
    if tag == "header" or names & HEADER_NAMES:
        return above if above == 1 else -1
    if names & INSIDE_NAMES and above >= 0 and not root:
        return 1
    return above


class _Block:
    __slots__ = ("parts", "linked", "size", "tag", "state", "parent", "moves")

    def __init__(self, element, moves):
        self.parts, self.linked, self.size, self.tag, self.state, self.parent, self.moves = [], 0, 0, element.tag, element.state, element.number, moves


class _Blocks(HTMLParser):
    """Text blocks of a page in order."""

    def __init__(self, **rules):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.stack = [_Element("", 0, False, 0)]
        self.blocks: list[_Block] = []
        self.open: _Block | None = None
        self.links = self.moves = self.numbers = 0

    def _cut(self):
        self.open = None
        self.moves += 1

    def parse_comment(self, i, report=1):
        """End of the comment at ``i``; an open comment runs to the end of the page, which is fed as a whole."""
        return COMMENT.match(self.rawdata, i).end()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "wbr"):
                if self.open is not None and tag == "br":
                    self.open.parts.append(" ")
            elif tag in BLOCK:
                self._cut()
            return
        if tag in BLOCK:
            self._close_implied(tag)
            self._cut()
        above = self.stack[-1]
        self.numbers += 1
        self.links += tag == "a"
        self.stack.append(_Element(tag, _state(tag, attrs, above.state, **self.rules), above.unseen or tag in UNSEEN, self.numbers))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag):
        """Elements that the start of ``tag`` ends: an open paragraph, and siblings of list and table items."""
        closed, scopes = CLOSES.get(tag, ()), SCOPES.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == "p" or name in closed:
                self._pop(k)
                if name != "p":
                    return
            elif name in scopes or (name in BLOCK and name not in ("p",)) and not closed:
                return

    def _pop(self, k):
        self.links -= sum(e.tag == "a" for e in self.stack[k:])
        del self.stack[k:]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._cut()
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag:
                self._pop(k)
                return
            if name in BLOCK and tag not in BLOCK:
                return  # an inline end tag does not end a block around it

    def handle_data(self, data):
        element = self.stack[-1]
        if element.unseen:
            return
        if self.open is None:
            if data.isspace():
                return
            holder = next((e for e in reversed(self.stack) if e.tag in BLOCK or e.tag == ""), element)
            self.open = _Block(holder, self.moves)
            self.blocks.append(self.open)
            self.moves = 0
        self.open.parts.append(data)
        self.open.size += len(data)
        if self.links:
            self.open.linked += len(data)


def _evidence(block: _Block, text: str) -> float:
    words, w = text.count(" ") + 1, WEIGHTS
    score = w["base"]
    score += w["long"] * min(words, 20) / 20
    score += w["sentence"] * (text[-1] in ".!?:;…。")
    score += w["paragraph"] * (block.tag in ("p", "blockquote", "pre")) + w["heading"] * (block.tag[:1] == "h" and block.tag[1:].isdigit()) + w["list"] * (block.tag == "li")
    score += w["links"] * block.linked / max(block.size, 1)
    if block.state != 1 and words < 40 and FURNITURE.search(text):
        score += w["furniture"]
    return score + (w["inside"] if block.state == 1 else w["outside"] if block.state < 0 else 0.0)


def minimum_cut(evidence: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; positive evidence is the capacity from it, negative that to the sink."""
    near: list[dict[int, float]] = [{} for _ in evidence]
    for a, b, weight in edges:
        near[a][b] = near[a].get(b, 0.0) + weight
        near[b][a] = near[b].get(a, 0.0) + weight
    value, label = list(evidence), [None] * len(evidence)
    queue = deque(range(len(value)))
    while queue:  # a node whose own evidence outweighs its edges has that label in every minimum cut
        k = queue.popleft()
        if label[k] is None and abs(value[k]) >= sum(near[k].values()):
            label[k] = value[k] > 0
            for other, weight in near[k].items():
                value[other] += weight if label[k] else -weight
                del near[other][k]
                queue.append(other)
            near[k] = {}
    rest = [k for k, x in enumerate(label) if x is None]
    if rest:
        source, sink = -1, -2
        room: dict[int, dict[int, float]] = defaultdict(dict)
        for k in rest:
            for other, weight in near[k].items():
                room[k][other] = weight
            if value[k] > 0:
                room[source][k], room[k][source] = value[k], 0.0
            else:
                room[k][sink], room[sink][k] = -value[k], 0.0
        reached = _saturate(room, source, sink)
        for k in rest:
            label[k] = k in reached
    return label


def _saturate(room, source, sink) -> set[int]:
    """Push flow along shortest paths, a level graph at a time, and return what the source still reaches."""
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, left in room[a].items():
                if left > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level)
        ways = {a: iter(list(room[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                cut = None
                for i, (x, y) in enumerate(zip(path, path[1:])):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0.0) + flow
                    if cut is None and room[x][y] <= 1e-12:
                        cut = i
                path = path[: cut + 1]
                continue
            for b in ways[a]:
                if room[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                if path:
                    level.pop(a)


def _found(html: str, **rules) -> list[tuple[_Block, str]]:
    """Blocks that hold text, and their text."""
    parser = _Blocks(**rules)
    parser.feed(html)
    parser.close()
    return [(b, t) for b in parser.blocks if (t := " ".join("".join(b.parts).split()))]


def _length(found: list[tuple[_Block, str]], *states: int) -> int:
    return sum(len(t) for b, t in found if b.state in states)


def extract(html: str | None) -> str:
    """Main text of one page, its blocks joined by newlines.

    A form that holds most of the page's text is a wrapper and says nothing. On a page
    whose text is mostly below comment names and that has no article elsewhere, an
    article below such a name is the article.
    """
    rules, html = {}, html or ""
    found = _found(html)
    if _length(found, FORM) > _length(found, 0, 1):
        rules["forms"] = False
        found = _found(html, **rules)
    if _length(found, NAMED) > _length(found, 0) and not _length(found, 1):
        found = _found(html, strict=False, **rules)
    edges, last = [], {}
    for k, (block, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, NEXT_EDGE / (1 + max(0, block.moves - 2))))
        if block.parent in last:
            edges.append((last[block.parent], k, PARENT_EDGE))
        last[block.parent] = k
    labels = minimum_cut([_evidence(b, t) for b, t in found], edges)
    return "\n".join(t for (_, t), content in zip(found, labels) if content)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    source = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_html"))
    out = T.StructType(source.schema.fields[:2] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def step(batch):
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return map_batches(source, out, step)
