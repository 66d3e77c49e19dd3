"""A small HTML reader: blocks of text with the path of containers around each."""

from __future__ import annotations

import dataclasses
import html
import re

#: Fixed values of HTML: elements that hold blocks, blocks themselves, raw-text elements.
CONTAINERS = frozenset("html body div article main section aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure fieldset details dialog menu template noscript head title select button".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption legend summary hr option label center".split())
RAW = ("script", "style", "textarea", "iframe", "xmp", "noembed", "noframes", "svg", "math", "object")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Possessive, so that each character is read once; a tag, quote or comment that never ends takes the rest of the page, as in HTML.
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+(?:>|$)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?"
    rf"|<(?P<raw>{'|'.join(RAW)})\b{_INSIDE}.*?(?:</(?P=raw)\s*>|$)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_INSIDE})",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


@dataclasses.dataclass
class Block:
    """path: generalised tag-class steps from the root; tag: the block's own; links: characters inside links."""

    path: tuple[str, ...]
    tag: str
    text: str
    links: int


@dataclasses.dataclass
class Page:
    blocks: list[Block]
    links: list[str]


def step(tag: str, attrs: str) -> str:
    """tag with its classes and id, numbers generalised to #."""
    if not attrs:
        return tag
    found = {}
    for name, *values in _ATTR.findall(attrs):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    words = sorted({_DIGITS.sub("#", w.lower()) for k in ("class", "id", "role") for w in found.get(k, "").split()})
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        words.append("!hidden")
    return ".".join([tag, *words])


def read(source: str) -> Page:
    """All blocks of a page in order; white space in a block is one space, references are decoded."""
    blocks: list[Block] = []
    hrefs: list[str] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    tag, links, in_link, at = "", 0, False, 0

    def flush() -> None:
        nonlocal links
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                blocks.append(Block(tuple(s for _, s in stack), tag, " ".join(words), links))
            text.clear()
        links = 0

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        name = m["tag"]
        if name is None:
            if m["raw"]:
                text.append(" ")
            continue
        name = name.lower()
        closing = bool(m["close"])
        if name in CONTAINERS:
            flush()
            tag = ""
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif not m["attrs"].endswith("/>"):
                stack.append((name, step(name, m["attrs"])))
        elif name in BLOCKS:
            flush()
            tag = "" if closing else name
            if not closing and name not in VOID:
                s = step(name, m["attrs"])
                tag = s
        elif name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not closing
            if not closing and (h := next((v for k, *vs in _ATTR.findall(m["attrs"]) if k.lower() == "href" for v in vs if v), "")):
                hrefs.append(html.unescape(h))
    if at < len(source):
        text.append(source[at:])
    flush()
    return Page(blocks, hrefs)
