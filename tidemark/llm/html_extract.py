"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier over a block's place (sections, class and
id words, roles) and text (length, links, punctuation) gives the cost of calling it content and the
cost of calling it boilerplate: the capacities to the two terminals. Neighbouring blocks are tied by
adjacency edges, blocks of one container by edges that weaken with their distance in the tree. The
minimum cut separates content from boilerplate; the content blocks in page order are the text.

Class and id words name boilerplate, but a wrapper of the whole page may have such a word too
(``search-main``, ``post comments``). So where no element speaks of content, and nearly no text is left
outside of elements that are boilerplate by their words alone (or forms), there is a wrapper: the one with an article,
a main element or a first heading in it, else that with most text, counts as any other, and what is in
it is looked at again. Inside of boilerplate everything is boilerplate, articles and headings too.

Edge cases: null or empty html gives an empty text; very long pages are read whole, batches being cut
by their size; unclosed, crossed and cut-off tags are read on
as browsers do; an empty table gives an empty result; page_id and url are carried as they are, null
or repeated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, tidy
from .packing import slices

# Names of elements and words of class, id and role, as HTML and common usage have them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody tfoot thead tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED_TAGS = frozenset("head noscript template svg math object canvas audio video select button datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"caption", "legend", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "html", "body"}
BOILERPLATE_TAGS = frozenset("nav aside footer form dialog menu search".split())
FIRM_TAGS = frozenset("nav aside footer".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead toolbar share sharing social subscribe subscription newsletter signup login "
    "related recommended recommendations comment comments disqus respond replies pagination pager search widget "
    "copyright disclaimer skip".split()
)
FIRM_WORDS = frozenset("comment comments sidebar disqus".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
MODIFIERS = ("has-", "with-", "no-", "without-", "is-", "hide-", "show-")  # of an element that is not the thing itself
CONTENT_WORDS = frozenset("article content main post entry story".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split()
)

# Parameters of the classifier (log odds of content) and of the smoothness edges.
WEIGHTS = {
    "bias": -1.0, "boilerplate": -9.0, "content": 7.0, "page_header": -9.0, "words": 0.12, "most_words": 4.0,
    "links": -6.0, "sentence": 0.8, "heading": 0.6,
}
ADJACENT, NEAR = 0.4, 1.2
# A block of prose has so many words; less than this share of an element's prose is nearly nothing.
PROSE_WORDS, NEARLY_NOTHING = 8, 0.05

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD_GAP = re.compile(r"[^a-z0-9]+")
NEUTRAL, CONTENT, BOILER, FIRM, HEADER = 0, 1, 2, 3, 4
MOST_WRAPPERS = 20


class Block:
    __slots__ = ("text", "links", "place", "heading", "container", "depth", "element")

    def __init__(self, text: str, links: int, heading: bool, container: int, depth: int, element: int):
        self.text, self.links, self.place, self.heading = text, links, NEUTRAL, heading
        self.container, self.depth, self.element = container, depth, element


class Element:
    """A block element: the one around it, what it says of its place, and whether by words alone."""

    __slots__ = ("parent", "kind", "plain", "by_words", "comments", "marks", "prose", "place")

    def __init__(self, parent: int, kind: int, plain: int, by_words: bool, comments: bool, marks: bool):
        self.parent, self.kind, self.plain, self.by_words = parent, kind, plain, by_words
        self.comments, self.marks, self.prose, self.place = comments, marks, 0, NEUTRAL


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value))
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )


def _kind(tag: str, attrs: dict[str, str]) -> tuple[int, int, bool, bool]:
    """What an element says of its place; the same without boilerplate words; whether those alone say so;
    whether they speak of comments."""
    if tag in ("html", "body"):
        return NEUTRAL, NEUTRAL, False, False
    role = attrs.get("role", "").lower()
    if tag in FIRM_TAGS:
        return FIRM, FIRM, False, False
    if role in BOILERPLATE_ROLES or tag in BOILERPLATE_TAGS and tag != "form":
        return BOILER, BOILER, False, False
    tokens = [t for t in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not t.lower().startswith(MODIFIERS)]
    whole = {t.lower() for t in tokens}
    words = set(WORD_GAP.split(CAPITAL.sub("-", " ".join(tokens)).lower()))
    if tag in CONTENT_TAGS or role in ("main", "article") or words & CONTENT_WORDS:
        plain = CONTENT
    else:
        plain = HEADER if tag == "header" or "header" in whole else NEUTRAL
    if whole & FIRM_WORDS:
        return FIRM, plain, True, bool(words & COMMENT_WORDS)
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return CONTENT, plain, False, False
    if tag == "form" or words & BOILERPLATE_WORDS:
        return BOILER, plain, True, bool(words & COMMENT_WORDS)
    return plain, plain, False, False


def _place(before: int, kind: int) -> int:
    """Place inside an element of this kind: boilerplate stays; a header counts only outside content."""
    if before in (FIRM, BOILER) or kind == NEUTRAL:
        return before
    if kind == HEADER:
        return before if before == CONTENT else HEADER
    return kind


def settle_places(blocks: list[Block], elements: list[Element]) -> None:
    """Give each block its place; elements come in page order, each after the one around it."""
    prose = [len(b.text) - b.links if b.text.count(" ") + 1 >= PROSE_WORDS else 0 for b in blocks]
    for b, n in zip(blocks, prose, strict=True):
        elements[b.element].prose += n
    for e in reversed(elements[1:]):
        elements[e.parent].prose += e.prose
        elements[e.parent].marks |= e.marks
    top = [0] * len(elements)  # the outermost boilerplate element around each, or 0
    for _ in range(MOST_WRAPPERS):
        for i, e in enumerate(elements[1:], 1):
            e.place = _place(elements[e.parent].place, e.kind)
            top[i] = top[e.parent] or (i if e.kind in (BOILER, FIRM) else 0)
        if any(elements[b.element].place == CONTENT for b in blocks):
            break
        clean = sum(n for b, n in zip(blocks, prose, strict=True) if not top[b.element])
        wrappers = {i for i in top if i and elements[i].by_words and (elements[i].marks or not elements[i].comments)}
        wrappers = [i for i in wrappers if elements[i].prose * NEARLY_NOTHING > clean]
        if not wrappers:
            break
        best = max(wrappers, key=lambda i: (elements[i].marks, elements[i].prose, -i))
        elements[best].kind, elements[best].by_words = elements[best].plain, False
    for b in blocks:
        b.place = elements[b.element].place


def _inline_end(html: str, at: int, name: str) -> int:
    """Where the inline element that is open at this place ends; the place itself if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    elements = [Element(0, NEUTRAL, NEUTRAL, False, False, False)]
    # Open elements: tag, skipped, number of the element.
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    parts: list[str] = []
    never_closed: set[str] = set()
    links, in_link, heading, at = 0, 0, False, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = len(stack) - 1
                while top and stack[top][0] in ("p", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"):
                    top -= 1
                out.append(Block(text, min(links, len(text)), heading, stack[top][2], len(stack), stack[-1][2]))
        links = 0

    def close(i: int) -> None:
        nonlocal heading
        flush()
        del stack[i:]
        heading = any(len(s[0]) == 2 and s[0][0] == "h" and s[0][1].isdigit() for s in stack)

    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            text, at = html[at:], len(html)
        else:
            text, at = html[at : m.start()], m.end()
        if text and not stack[-1][1]:
            parts.append(text)
            if in_link:
                links += len(text)
        if not m:
            break
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in ("td", "th"):
                parts.append(" ")
            elif name in BLOCK_TAGS or name in SKIPPED_TAGS:
                i = len(stack) - 1
                while i and stack[i][0] != name:
                    i -= 1
                if i:
                    close(i)
                else:
                    flush()
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "a":
            in_link = 1
        elif name in ("br", "td", "th", "img", "wbr", "input"):
            if name != "wbr":
                parts.append(" ")
        if name not in BLOCK_TAGS and name not in SKIPPED_TAGS:
            attrs = m["attrs"] or m["attrs2"] or ""
            if "hidden" in attrs.lower() or "none" in attrs.lower():
                if name not in VOID_TAGS and name not in never_closed and _hidden(_attributes(attrs)):
                    end = _inline_end(html, at, name)
                    if end == at:
                        never_closed.add(name)
                    at = end
                    if name == "a":
                        in_link = 0
            continue
        flush()
        if name == "body":  # the head may be unclosed
            del stack[1:]
        if name in CLOSES_P:
            i = len(stack) - 1
            while i and stack[i][0] != "p" and stack[i][0] not in ("table", "button", "object"):
                i -= 1
            if i and stack[i][0] == "p":
                close(i)
        if name in ("li", "dd", "dt", "option", "tr"):
            same = ("dd", "dt") if name in ("dd", "dt") else (name,)
            i = len(stack) - 1
            while i and stack[i][0] not in (*same, "ul", "ol", "dl", "menu", "table", "select"):
                i -= 1
            if i and stack[i][0] in same:
                close(i)
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in VOID_TAGS or attrs.endswith("/") and name in SKIPPED_TAGS:
            continue
        found = _attributes(attrs) if attrs.strip() else {}
        skipped = stack[-1][1] or name in SKIPPED_TAGS or _hidden(found)
        marks = not skipped and (name in CONTENT_TAGS or name == "h1")
        elements.append(Element(stack[-1][2], *_kind(name, found), marks))
        stack.append((name, skipped, len(elements) - 1))
        heading = heading or len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name not in ("p", "li"):
            in_link = 0
    flush()
    settle_places(out, elements)
    return out


def log_odds(block: Block) -> float:
    w = WEIGHTS
    n_words = block.text.count(" ") + 1
    z = w["bias"] + min(w["most_words"], w["words"] * n_words) + w["links"] * block.links / len(block.text)
    z += w["sentence"] * (block.text[-1] in ".!?:;…。") + w["heading"] * block.heading
    place = {CONTENT: w["content"], BOILER: w["boilerplate"], FIRM: w["boilerplate"], HEADER: w["page_header"]}
    return z + place.get(block.place, 0.0)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacency, and DOM proximity to the next block of the same container."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            far = 0 if a.container == b.container else 1 + abs(a.depth - b.depth)
            out.append((i - 1, i, ADJACENT / (1 + far)))
        j = last.get(b.container)
        if j is not None:
            out.append((j, i, NEAR / (i - j)))
        last[b.container] = i
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's (content's) side of a minimum cut.

    The cost of calling node i boilerplate is log(1 + exp(odds)), of calling it content
    log(1 + exp(-odds)); what both have in common flows straight through, so only their
    difference, the odds, remains. Blocking flows in level graphs carry the rest.
    """
    n = len(odds)
    supply = [max(z, 0.0) for z in odds]
    demand = [max(-z, 0.0) for z in odds]
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        arcs[a].append(len(to))
        to.append(b)
        room.append(c)
        arcs[b].append(len(to))
        to.append(a)
        room.append(c)
    tiny = 1e-12
    while True:
        level = [0 if s > tiny else -1 for s in supply]
        queue = [i for i in range(n) if level[i] == 0]
        reached = False
        for i in queue:
            reached = reached or demand[i] > tiny
            for e in arcs[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in [i for i in queue if level[i] == 0]:
            path: list[int] = []
            node = start
            while supply[start] > tiny:
                if demand[node] > tiny:
                    flow = min([supply[start], demand[node], *(room[e] for e in path)])
                    supply[start] -= flow
                    demand[node] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, node = [], start
                    continue
                while turn[node] < len(arcs[node]):
                    e = arcs[node][turn[node]]
                    if room[e] > tiny and level[to[e]] == level[node] + 1:
                        path.append(e)
                        node = to[e]
                        break
                    turn[node] += 1
                else:
                    if not path:
                        break
                    level[node] = n + 1
                    node = to[path.pop() ^ 1]
                    turn[node] += 1


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    keep = minimum_cut([log_odds(b) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                texts = [main_text(h.as_py()) for h in batch.column(2)[part]]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(texts, pa.string()), sizes], schema=schema
                )

    ship(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(tidy(extract), "page_id long, url string, text string, n_chars long")
