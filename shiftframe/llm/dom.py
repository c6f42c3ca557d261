"""Text blocks of a web page with what the page's markup says about them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of the markup language: elements that begin a block, that hold no elements, and whose content is no text.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol
    optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article aside dialog fieldset footer form header main menu nav noscript".split())
HIDDEN = frozenset("script style title template iframe noembed noframes xmp".split())
CLOSES = {  # an element that begins while one of these is open ends it, up to the nearest of the second set
    **dict.fromkeys(BLOCKS - {"body", "head", "html", "button", "label", "option", "optgroup", "select"}, ({"p"}, {"button", "td", "th", "table", "caption"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|(\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MEMO = 20_000


@dataclass
class Block:
    text: str
    context: frozenset
    leaf: str
    in_links: int  # characters that are text of links
    truth: str | None = None


@dataclass
class Markup:
    """Remembers what start tags say, as they repeat from page to page."""

    known: dict = field(default_factory=dict)

    def read(self, tag: str, attributes: str) -> tuple[frozenset, str | None]:
        """(features of an element, its ``data-main`` if it has one)."""
        found = self.known.get((tag, attributes))
        if found is None:
            features, truth = {f"tag={tag}"} if tag in BLOCKS else set(), None
            for name, *values in ATTRIBUTE.findall(attributes):
                value = html.unescape(next((v for v in values if v), ""))
                if name.lower() == "data-main":
                    truth = value
                else:
                    features |= {f"name={part.lower().removesuffix('s')}" for part in NAME_PART.findall(value)}
            # of what names an element, that of the innermost named one counts once more
            near = {f.replace("name=", "near=") for f in features if f.startswith("name=")}
            found = frozenset(features | near | ({f"near={tag}"} if tag in SECTIONS else set())), truth
            if len(self.known) < MEMO:
                self.known[tag, attributes] = found
        return found


def blocks_of(page: str, markup: Markup) -> list[Block]:
    """The leaf blocks of a page in order: runs of text that no block element begins or ends in.

    White space inside a block is one space each, blocks without text are left out, character references are decoded.
    Markup that ends inside a tag or comment ends there. Elements left open are closed by what follows them.
    """
    found: list[Block] = []
    stack: list[tuple[str, frozenset, str | None]] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    context, truth, leaf, in_links, at = frozenset(), None, "body", 0, 0
    first: tuple[frozenset, str | None] | None = None  # what stands around the block's first text

    def flush() -> None:
        nonlocal in_links, first
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, first[0] if first else context, leaf, in_links, first[1] if first else truth))
            pieces.clear()
        in_links, first = 0, None

    def add(raw: str) -> None:
        nonlocal in_links, first
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if first is None and not text.isspace():
            first = context, truth
        if open_tags["a"]:
            in_links += len(text)

    def close(to: int) -> None:
        nonlocal context, truth, leaf
        for tag, *_ in stack[to:]:
            open_tags[tag] -= 1
        del stack[to:]
        context, truth = (stack[-1][1], stack[-1][2]) if stack else (frozenset(), None)
        leaf = next((tag for tag, *_ in reversed(stack) if tag in BLOCKS), "body")

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None or token[4] is not None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if token[1]:
            if tag == "br" or tag not in VOID and block:
                pieces.append(" ")
            if open_tags[tag] > 0:
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or not block and stack[i][0] in BLOCKS)
                if stack[place][0] == tag:
                    if block:
                        flush()
                    close(place)
            continue
        if tag in HIDDEN:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            if tag == "title" or tag == "template":
                pieces.append(" ")
            continue
        if block:
            flush()
            ends, until = CLOSES.get(tag, ((), ()))
            if any(open_tags[e] > 0 for e in ends):
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] in until:
                        break
                    if stack[place][0] in ends:
                        close(place)
                        if not any(open_tags[e] > 0 for e in ends):
                            break
        if tag in VOID:
            if tag == "br" or tag == "hr":
                pieces.append(" ")
            continue
        own, mark = markup.read(tag, token[3])
        if not own <= context:
            named = any(f.startswith("near=") for f in own)
            context = own.union(f for f in context if not f.startswith("near=")) if named else context | own
        truth = truth if mark is None else mark
        stack.append((tag, context, truth))
        open_tags[tag] += 1
        if block:
            leaf = tag
    flush()
    return found
