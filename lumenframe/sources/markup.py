"""A page's elements in one pass each kind: where they begin and end, by a stack of those that are open."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

Selector = tuple[str, str | None]
_TAGS, _BLANKS = re.compile(r"<[^>]*>"), re.compile(r"[ \t\n\x0b\f\r]+")


class Element(NamedTuple):
    opens: int  # where its opening tag begins
    start: int
    end: int  # its inner markup: [start, end)
    attributes: str


@lru_cache(maxsize=256)
def _tag(tag: str) -> re.Pattern:
    return re.compile(rf"<(?:{tag}\b([^>]*)|(/){tag})>", re.IGNORECASE)


@lru_cache(maxsize=256)
def _class(name: str) -> re.Pattern:
    return re.compile(rf'\bclass="[^"]*\b{name}\b[^"]*"', re.IGNORECASE)


@lru_cache(maxsize=256)
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf'\b{name}="([^"]*)"')


def attribute(markup: str, name: str) -> str | None:
    """An attribute's value; None where it is missing or empty."""
    found = _attribute(name).search(markup)
    return (found[1] or None) if found else None


def plain(markup: str) -> str:
    """Text without tags, with single blanks."""
    return _BLANKS.sub(" ", _TAGS.sub("", markup)).strip(" ")


class Page:
    """A page, or the part [start, end) of it, whose elements are found once for each tag."""

    def __init__(self, html: str):
        self.html = html
        self._closed: dict[str, list[Element]] = {}
        self._opened: dict[str, list[tuple[int, int, str]]] = {}

    def _all(self, tag: str) -> list[Element]:
        """The elements of a tag that are closed, in the order in which they open; a closing tag ends the newest that is open."""
        if tag not in self._closed:
            open_: list[tuple[int, int, str]] = []
            found, opened = [], []
            for m in _tag(tag).finditer(self.html):
                if not m[2]:
                    opened.append((m.start(), m.end(), m[1] or ""))
                    open_.append(opened[-1])
                elif open_:
                    opens, start, attributes = open_.pop()
                    found.append(Element(opens, start, m.start(), attributes))
            self._closed[tag], self._opened[tag] = sorted(found), opened
        return self._closed[tag]

    def elements(self, selector: Selector, within: Element | None = None) -> list[Element]:
        """The elements of a tag, and of a class if one is given, that lie whole within another one, or in the page."""
        tag, css_class = selector
        found = self._all(tag)
        if within is not None:
            found = found[bisect_left(found, (within.start,)) : bisect_left(found, (within.end,))]
            found = [e for e in found if e.end < within.end]
        return [e for e in found if _class(css_class).search(e.attributes)] if css_class else found

    def first(self, selector: Selector, within: Element | None = None) -> Element | None:
        tag, css_class = selector
        found = self._all(tag)
        for i in range(bisect_left(found, (within.start,)) if within else 0, len(found)):
            if within and found[i].opens >= within.end:
                break
            if (not within or found[i].end < within.end) and (not css_class or _class(css_class).search(found[i].attributes)):
                return found[i]
        return None

    def text(self, element: Element | None) -> str | None:
        return None if element is None else plain(self.html[element.start : element.end])

    def value(self, selector: Selector, within: Element | None = None) -> str | None:
        """The text of the first such element; for a class of '@name' that attribute of the first opening tag."""
        tag, css_class = selector
        if not css_class or not css_class.startswith("@"):
            return self.text(self.first(selector, within))
        self._all(tag)
        opened = self._opened[tag]
        at = bisect_left(opened, (within.start,)) if within else 0
        if at == len(opened) or (within and opened[at][1] > within.end):
            return None
        return attribute(f"<{tag}{opened[at][2]}>", css_class[1:])

    def records(self, selector: Selector, fields: list[Selector]) -> list[tuple]:
        """For each element the values of its fields."""
        return [tuple(self.value(f, e) for f in fields) for e in self.elements(selector)]
