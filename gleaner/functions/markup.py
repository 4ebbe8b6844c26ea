"""Elements of html pages: tokens, attributes, and which element stands in which."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")
# Elements that have no content, and those whose content is text up to their own end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: An element of these names ends where the next of the same name begins in the same parent.
_ENDED = frozenset(("p", "li", "option", "dt", "dd", "tr", "td", "th"))


class Element(NamedTuple):
    """``inside`` is the number of the element that holds it, or -1; those that it holds have the numbers up to ``end``."""

    name: str
    attributes: dict[str, str]
    inside: int
    end: int


class Page(NamedTuple):
    elements: list[Element]
    #: Pieces of text with the number of the element that they stand in, in order; what is in scripts and styles is left out.
    texts: list[tuple[int, str]]


def attributes(source: str) -> dict[str, str]:
    """By name in lower case; of equal names the first counts, an attribute without a value is empty."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def parse(source: str | None, decoded: Callable[[str], str] = html.unescape) -> Page:
    """The elements of a page in the order of their start tags. Comments, declarations and end tags without a start are passed
    over; what is not closed ends with what holds it. Character references in texts are ``decoded``."""
    page, open_, ends, at, source = Page([], []), [], {}, 0, source or ""

    def text(low: int, high: int) -> None:
        if low < high and (not open_ or page.elements[open_[-1]].name not in ("script", "style")):
            page.texts.append((open_[-1] if open_ else -1, decoded(source[low:high])))

    def close(upto: int) -> None:
        while len(open_) > upto:
            ends[open_.pop()] = len(page.elements)

    while m := _TOKEN.search(source, at):
        text(at, m.start())
        at = m.end()
        if m[1]:
            name = m[1].lower()
            depth = next((k for k in range(len(open_) - 1, -1, -1) if page.elements[open_[k]].name == name), None)
            if depth is not None:
                close(depth)
        elif m[2]:
            name = m[2].lower()
            if open_ and name in _ENDED and page.elements[open_[-1]].name == name:
                close(len(open_) - 1)
            page.elements.append(Element(name, attributes(m[3]), open_[-1] if open_ else -1, 0))
            if name in VOID or m[3].endswith("/") and name not in RAW:
                continue
            open_.append(len(page.elements) - 1)
            if name in RAW:
                over = re.compile(rf"</{name}\b[^>]*+>", re.I).search(source, at)
                text(at, over.start() if over else len(source))
                at = over.end() if over else len(source)
                close(len(open_) - 1)
    text(at, len(source))
    close(0)
    return Page([e._replace(end=ends.get(k, k + 1)) for k, e in enumerate(page.elements)], page.texts)


def text_of(page: Page, k: int) -> str:
    """All text in an element and those that it holds."""
    return "".join(t for at, t in page.texts if k <= at < page.elements[k].end)
