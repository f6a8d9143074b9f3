"""Web pages as trees: tags, raw text, implied ends, and the blocks of text between them."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is text without tags, and no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Left out with all that is in them: scripts' stand-ins, drawings, controls of forms, players.
DROPPED = frozenset("noscript template svg object canvas audio video select datalist button map".split())
#: Elements that end and begin a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: Their start ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, and the elements that no implied end goes beyond.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["optgroup"])),
}
SCOPE = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

MARKUP = re.compile(
    r"<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))"  # comments
    r"|<[!?][^>]*+>?"  # declarations and the like
    r"|<(/?)([a-zA-Z][^\s/>]*+)"  # a tag: its name and attributes
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))?+)*+)>"
    r"|</[^a-zA-Z][^>]*+>?"
)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
#: Where the raw text of an element ends.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
DROPPED_TAG = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I) for tag in DROPPED}


class Node(NamedTuple):
    """An element or, without a tag, a block of text. linked: its characters inside links; parent: its place in the list."""

    tag: str
    attributes: str
    parent: int
    depth: int
    text: str
    linked: int


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of a name, character references decoded."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def after_dropped(page: str, tag: str, begin: int) -> int:
    """Where an element ends that is left out with its content; begin if it never does."""
    depth = 1
    for m in DROPPED_TAG[tag].finditer(page, begin):
        depth += -1 if m.group(1) else 1
        if not depth:
            return m.end()
    return begin


def parse(page: str) -> list[Node]:
    """The page's block elements and blocks of text, parents first, in page order; the first is the page itself.

    Inline elements are part of their block, a line break in it is a blank. Character references are decoded, runs of
    white space are one blank, and blocks without text are left out. Broken pages are read as browsers read them where
    ends are missing: a paragraph ends where a block begins, an item where the next begins, end tags without a start
    do nothing.
    """
    nodes = [Node("", "", -1, 0, "", 0)]
    stack = [0]
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    endless: set[str] = set()
    text: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                nodes.append(Node("", "", stack[-1], len(stack), " ".join(words), linked))
            text.clear()
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal in_link
        opened.subtract(nodes[k].tag for k in stack[place:])
        del stack[place:]
        in_link = False

    begin = 0
    size = len(page)
    while begin < size:
        m = MARKUP.search(page, begin)
        if m is None:
            text.append(page[begin:])
            break
        if m.start() > begin:
            run = page[begin : m.start()]
            text.append(run)
            if in_link:
                linked += len(run)
        begin = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = False
            elif tag == "p":
                flush()
                place = opened["p"] and open_before(nodes, stack, "p")
                if place:
                    pop_to(place)
            elif tag in BLOCKS and tag not in ("body", "html"):
                flush()
                place = open_heading(nodes, stack) if tag in HEADINGS else opened[tag] and open_before(nodes, stack, tag)
                if place:
                    pop_to(place)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, begin)
            begin = end.end() if end else size
            continue
        if tag in DROPPED:
            after = begin if tag in endless else after_dropped(page, tag, begin)
            if after == begin:
                endless.add(tag)
            begin = after
            text.append(" ")
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                place = opened["p"] and open_before(nodes, stack, "p")
                if place:
                    pop_to(place)
                if tag in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
                    pop_to(len(stack) - 1)
            ended = IMPLIED.get(tag)
            if ended and any(opened[t] for t in ended[0]):
                for place in range(len(stack) - 1, 0, -1):
                    kind = nodes[stack[place]].tag
                    if kind in ended[0]:
                        pop_to(place)
                        break
                    if kind in ended[1]:
                        break
            if tag not in VOID:
                nodes.append(Node(tag, m.group(3), stack[-1], len(stack), "", 0))
                stack.append(len(nodes) - 1)
                opened[tag] += 1
    flush()
    return nodes


def open_before(nodes: list[Node], stack: list[int], tag: str) -> int:
    """The place in the stack of the innermost open element of the tag; 0 if there is none within its scope."""
    for place in range(len(stack) - 1, 0, -1):
        kind = nodes[stack[place]].tag
        if kind == tag:
            return place
        if kind in SCOPE and tag not in TABLE_PARTS:
            return 0
    return 0


def open_heading(nodes: list[Node], stack: list[int]) -> int:
    """As open_before for a heading of any level, which any heading's end tag ends."""
    for place in range(len(stack) - 1, max(0, len(stack) - 9), -1):  # what stands in a heading is not deep
        kind = nodes[stack[place]].tag
        if kind in HEADINGS:
            return place
        if kind in SCOPE:
            return 0
    return 0
