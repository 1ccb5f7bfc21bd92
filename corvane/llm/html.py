"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A linear classifier over container names, class names, tag, length,
link share, punctuation, cue words and the share of the page's text that lies in the same container gives each block a cost of
being content and a cost of being boilerplate: the capacities from the source and to the sink. Blocks that follow each other,
and blocks that follow each other under the same parent, are joined by edges whose capacity falls with every container that
opens or closes between them, most of all at tags such as `nav`, `article` or `form`. No capacity is out of the edges' reach:
a sentence between the marks of a comment goes with them, a short line between paragraphs stays with them.

The minimum cut, found by maximum flow, separates content from boilerplate. Edges between neighbours in page order and among
siblings never cross, so nearly every network is reduced exactly in linear time: a block with two open neighbours at most passes
its excess on to them, and leaves between them an edge of the capacity that is left through it. What cannot be reduced goes
by shortest augmenting paths.

A cue such as `cookies` or `log in` counts in short blocks outside an article. A block without links, boilerplate name or cue
has no cost of being content. Mathematics is text, without its annotations.

What is never text (scripts, styles, templates, form controls, the head) makes no block. White space inside a block, and
a line break, is one space; character references are decoded; blocks are joined by a blank line in page order.

Defined cases: null or empty html gives an empty text; text outside any tag is a block of its own; unclosed tags end with
their parents; equal cuts go to content, so nothing is dropped without evidence; repeated rows give repeated rows; other
columns are not carried. The work is linear in the page, however long or deep it is.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, tidied

# HTML element names by role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"head", "template", "svg", "canvas", "option", "audio", "video"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
MATH_TOKENS = {"mi", "mn", "mo", "ms", "mtext"}
MATH = {"math", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "menclose", "mfenced", "maction", "semantics", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mlabeledtr", "mtd", "mspace", "mglyph", "annotation", "annotation-xml"} | MATH_TOKENS
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "article", "section", "div", "main", "body"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "fieldset", "search", "dialog"}
CONTENT_TAGS = {"article": 1.5, "main": 0.75}
TEXT_TAGS = {"p": 0.4, "h1": 0.4, "h2": 0.3, "h3": 0.25, "h4": 0.15, "h5": 0.15, "h6": 0.15, "blockquote": 0.3, "pre": 0.3, "figcaption": 0.1, "dd": 0.1, "dt": 0.1}
BOUNDARIES = BOILER_TAGS | {"header", "article", "main", "section"}
LISTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "blockquote", "figure", "hgroup", "center"}
BOILER_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adslot adbox adunit adcontainer banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation navi breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets comment comments disqus replies reply respond copyright legal disclaimer skip toc tags taglist".split())
CONTENT_NAMES = frozenset("article content post entry story body text main prose maintext articlebody postbody".split())
ROLE_NAMES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
#: A whole attribute, so that words inside another attribute's value are none.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Form controls are hidden in a line of text; other elements in a line are told by their attributes.
MUTE = {"button", "select", "datalist"}
NAME_PART = re.compile(r"[a-z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NEUTRAL_WORD = re.compile(r"(?:has|with|without|no)-", re.I)
LEGAL = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|privacy policy|terms of (?:use|service)", re.I)
CUES = re.compile(LEGAL.pattern + r"|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:up|in)\b|\blog ?in\b|\badvertisement\b|\bsponsored\b|share this|leave a (?:reply|comment)|read more|related (?:posts|articles)", re.I)
READERS = re.compile(r"\b\d+ (?:seconds?|minutes?|hours?|days?|weeks?|months?|years?) ago\b|^\d+ (?:comments?|replies|responses)\b|^(?:reply|report|permalink|comments)\b|\b(?:says|wrote|commented):?$", re.I)
LONG = 200
#: Evidence of boilerplate: tags and roles, and names.
BY_TAG, BY_NAME = 5.0, 2.5
#: Capacity between neighbours in one container, and what is left of it past a list, any other container, a named one and a boundary tag.
SMOOTHNESS, PAST_LIST, PAST_OTHER, PAST_NAMED, PAST_BOUNDARY = 1.2, 0.7, 0.5, 0.25, 0.1


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int
    drop: bool = False
    boiler: float = 0.0
    content: float = 0.0
    has_article: bool = False
    named: bool = False


@dataclass(eq=False)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    noted: int = 0  # characters in inline elements with evidence of boilerplate, and the most of it
    evidence: float = 0.0


def attribute_evidence(attributes: str, inside: bool = False) -> tuple[bool, float, float]:
    """(hidden, boilerplate, content) evidence of a tag's class, id, role and style. inside: in an article or what is named as content, whose own header is no page header."""
    hidden, boiler, content = False, 0.0, 0.0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
            hidden = True
        elif name == "role":
            boiler = max(boiler, BY_TAG if value in ROLE_NAMES else 0.0)
            content = max(content, 1.0 if value in ("main", "article") else 0.0)
        elif name in ("class", "id"):
            for word in value.split():
                if NEUTRAL_WORD.match(word):
                    continue
                parts = NAME_PART.findall(word)
                if any(p in BOILER_NAMES and not (inside and p == "header") for p in parts):
                    boiler = max(boiler, BY_NAME)
                if any(p in CONTENT_NAMES for p in parts) or "".join(parts) in CONTENT_NAMES:
                    content = max(content, 0.75)
    return hidden, boiler, content


def blocks_of(page: str) -> list[Block]:
    root = Node("", None, 0)
    at, node, out = 0, root, []
    links = 0
    open_: Block | None = None
    lines: list[tuple[str, bool, float, Node]] = []  # open inline elements with evidence: tag, hidden, boilerplate, where

    def add(text: str) -> None:
        nonlocal open_
        if node.drop or not text or any(hidden for _, hidden, _, _ in lines):
            return
        text = references.unescape(text) if "&" in text else text
        if open_ is None:
            if not text.strip():
                return
            open_ = Block(node)
        open_.parts.append(text)
        if links:
            open_.linked += len(text)
        if lines:
            open_.noted += len(text)
            open_.evidence = max(open_.evidence, *(boiler for _, _, boiler, _ in lines))

    def flush() -> None:
        nonlocal open_
        if open_ is not None:
            open_.text = " ".join("".join(open_.parts).split())
            if open_.text:
                if 2 * open_.noted > sum(map(len, open_.parts)):  # what most of a line is, the line is
                    n = open_.node
                    open_.node = Node("span", n, n.depth + 1, False, max(n.boiler, open_.evidence), n.content, n.has_article, True)
                out.append(open_)
            open_ = None

    def close(names: set[str], stop: set[str]) -> None:
        """Close the innermost open element so named, if none of `stop` is between."""
        nonlocal node
        n: Node | None = node
        while n is not None and n.parent is not None:
            if n.tag in names:
                node = n.parent
                return
            if n.tag in stop:
                return
            n = n.parent

    def leave_lines() -> None:
        """Inline elements end with the element they began in."""
        while lines and lines[-1][3] is not node:
            n: Node | None = node
            while n is not None and n is not lines[-1][3]:
                n = n.parent
            if n is not None:
                return
            lines.pop()

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(lines) - 1, -1, -1):
                if lines[i][0] == tag:
                    del lines[i:]
                    break
            if tag == "a":
                links = max(0, links - 1)
            elif tag in MUTE:
                pass
            elif tag in ("td", "th"):
                add(" ")
            elif tag not in INLINE and tag not in VOID and tag not in MATH:
                flush()
                links = 0
                close({tag}, set())
                leave_lines()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            links = 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if tag in MATH:
            if tag in MATH_TOKENS:
                add(" ")
            elif not m[3].endswith("/") and (tag.startswith("annotation") or tag == "math" and attribute_evidence(m[3])[0]):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = at if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if tag in MUTE:
            lines.append((tag, True, 0.0, node))
            continue
        if tag in INLINE or (tag in VOID and tag != "hr"):
            if tag in INLINE:
                hidden, boiler, _ = attribute_evidence(m[3]) if m[3] else (False, 0.0, 0.0)
                # Elements of the same name inside count too, so that an end tag ends its own.
                if hidden or boiler or any(x[0] == tag for x in lines):
                    lines.append((tag, hidden, boiler, node))
            continue
        if tag in ("td", "th"):
            add(" ")
            close(SELF_CLOSING[tag], SCOPES)
            leave_lines()
            continue
        flush()
        links = 0
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in SELF_CLOSING:
            close(SELF_CLOSING[tag], SCOPES - {"div"} if tag != "li" else {"ul", "ol", "menu"})
        leave_lines()
        if tag in VOID or m[3].endswith("/") and tag == "svg":
            continue
        hidden, boiler, content = attribute_evidence(m[3], node.has_article or node.content > 0) if m[3] and tag not in ("html", "body") else (False, 0.0, 0.0)
        child = Node(tag, node, node.depth + 1, node.drop or hidden or tag in DROPPED)
        child.has_article = node.has_article or tag in ("article", "main")
        own = BY_TAG if tag in BOILER_TAGS or (tag == "header" and not node.has_article) else boiler
        child.boiler = max(node.boiler, own)
        child.named = own > 0 or content > 0
        child.content = max(node.content, CONTENT_TAGS.get(tag, 0.0), content)
        node = child
    flush()
    return out


def link_share(block: Block) -> float:
    return block.linked / max(1, sum(map(len, block.parts)))


def container(block: Block) -> Node:
    """The nearest element around a block's own that is no list or table."""
    n = block.node.parent or block.node
    while n.tag in LISTS and n.parent is not None:
        n = n.parent
    return n


def shares(blocks: list[Block]) -> list[float]:
    """For each block, the unlinked text of its container over that of the container with most, boilerplate tags and names aside."""
    inside = [id(container(b)) for b in blocks]
    mass: dict[int, float] = {}
    for b, c in zip(blocks, inside, strict=True):
        if not b.node.boiler:
            mass[c] = mass.get(c, 0.0) + len(b.text) * (1 - link_share(b))
    most = max(mass.values(), default=0.0)
    return [mass.get(c, 0.0) / most if most else 0.0 for c in inside]


def costs(block: Block, share: float) -> float:
    """Log odds of content over boilerplate."""
    n, linked, text = len(block.text), link_share(block), block.text
    score = block.node.content - block.node.boiler + TEXT_TAGS.get(block.node.tag, 0.0) + share
    score += min(n, 400) / 400 - 3.0 * linked
    cue = 0.0
    if n < LONG and not block.node.has_article:
        # Beside the main text such a word is one like others, unless it is a link.
        cue = 3.0 if LEGAL.search(text) else 2.0 if READERS.search(text) else 1.5 * (1.0 if linked >= 0.5 or block.node.boiler else 1 - share) if CUES.search(text) else 0.0
    if linked or block.node.boiler or cue:
        score -= 0.2 + cue
    return score + (0.3 if text[-1] in ".!?…:;\"'”»" else 0.0)


def tie(a: Node, b: Node) -> float:
    """Capacity between two elements' blocks: less for every container between them and the element that holds both."""
    w, ends = SMOOTHNESS, (a, b)

    def past(n: Node) -> float:
        if n.tag in BOUNDARIES:
            return PAST_BOUNDARY
        if n in ends:
            return 1.0
        return PAST_NAMED if n.named else PAST_LIST if n.tag in LISTS else PAST_OTHER

    while a is not b:
        if a.depth >= b.depth:
            w *= past(a)
            a = a.parent
        else:
            w *= past(b)
            b = b.parent
    return w


def _augmented(score: dict[int, float], to: dict[int, dict[int, float]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the nodes on the sink's side of the minimum cut nearest to the sink."""
    supply = {i: max(x, 0.0) for i, x in score.items()}
    demand = {i: max(-x, 0.0) for i, x in score.items()}
    to = {i: dict(x) for i, x in to.items()}
    while True:
        came: dict[int, int] = {i: -1 for i, x in supply.items() if x > 1e-12}
        queue, end = deque(came), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, c in to[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    if demand[j] > 1e-12:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            break
        path, i = [], end
        while came[i] >= 0:
            path.append((came[i], i))
            i = came[i]
        flow = min(supply[i], demand[end], *(to[a][b] for a, b in path))
        supply[i] -= flow
        demand[end] -= flow
        for a, b in path:
            to[a][b] -= flow
            to[b][a] += flow
    back: dict[int, list[int]] = {i: [] for i in to}
    for i, others in to.items():
        for j, c in others.items():
            if c > 1e-12:
                back[j].append(i)
    out = [i for i, x in demand.items() if x > 1e-12]
    gone = set(out)
    while out:
        for i in back[out.pop()]:
            if i not in gone:
                gone.add(i)
                out.append(i)
    return gone


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (true: content) of least cost: a node pays its score's size against its sign, an edge its weight across. Of equal ones, that with most content."""
    left = dict(enumerate(score))
    to: dict[int, dict[int, float]] = {i: {} for i in left}
    for a, b, w in edges:
        if a != b and w > 0:
            to[a][b] = to[a].get(b, 0.0) + w
            to[b][a] = to[b].get(a, 0.0) + w
    gone: list[tuple[int, float, dict[int, float]]] = []
    ready = [i for i in left if len(to[i]) <= 2]
    while ready:
        v = ready.pop()
        if v not in left or len(to[v]) > 2:
            continue
        s, near = left.pop(v), to.pop(v)
        gone.append((v, s, near))
        for u in near:
            del to[u][v]
        if len(near) == 1:
            ((u, w),) = near.items()
            left[u] += min(max(s, -w), w)
        elif len(near) == 2:
            (a, wa), (b, wb) = near.items()
            zero, one = max(s, 0.0), max(-s, 0.0)
            both0, both1 = min(zero, one + wa + wb), min(one, zero + wa + wb)
            only_b, only_a = min(zero + wb, one + wa), min(zero + wa, one + wb)
            left[a] -= (only_a - both0 + both1 - only_b) / 2
            left[b] -= (only_b - both0 + both1 - only_a) / 2
            through = (only_a + only_b - both0 - both1) / 2
            if through > 1e-12:
                to[a][b] = to[a].get(b, 0.0) + through
                to[b][a] = to[b].get(a, 0.0) + through
        ready += [u for u in near if len(to[u]) <= 2]
    label = {}
    if left:
        sink = _augmented(left, to)
        label = {i: i not in sink for i in left}
    for v, s, near in reversed(gone):
        content = max(-s, 0.0) + sum(w for u, w in near.items() if not label[u])
        boiler = max(s, 0.0) + sum(w for u, w in near.items() if label[u])
        label[v] = content <= boiler + 1e-9
    return [label[i] for i in range(len(score))]


def labelled(page: str | None) -> tuple[list[Block], list[float], list[bool]]:
    """Blocks, their scores, and which of them are content."""
    blocks = blocks_of(page) if page else []
    score = [costs(b, share) for b, share in zip(blocks, shares(blocks), strict=True)]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, tie(blocks[i - 1].node, b.node)))
        parent = id(b.node.parent)
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SMOOTHNESS / 2))
        last[parent] = i
    return blocks, score, minimum_cut(score, edges)


def main_text(page: str | None) -> str:
    blocks, _, content = labelled(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    chosen = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return chosen.mapInArrow(tidied(run), "page_id bigint, url string, text string, n_chars bigint")
