"""A small reading aid for captured pages: elements, selectors, visible text.

It runs inside tasks, on one page at a time; what the pages mean is decided by
the layouts in :mod:`rolecall.sources.extract` and by columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template title noscript".split())
RAW_TEXT = frozenset("script style title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
CLOSES_PARAGRAPH = BLOCKS - {"body", "html", "li", "dd", "dt", "tr"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*+)(?P<close>>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
#: White space that does not show as it is written; a single space does.
_SPACE = re.compile(r"[ \t\n\r\f]{2,}|[\t\n\r\f]")
_SELECTOR = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*)?(?P<classes>(?:\.[\w-]+)*)"
    r"(?:\[(?P<name>[\w-]+)(?P<op>\*?=)[\"']?(?P<value>[^\"'\]]*)[\"']?\])?\Z")


class Element:
    """``order`` and ``end`` delimit its descendants in the page's elements."""

    __slots__ = ("tag", "source", "children", "order", "end", "_attrs")

    def __init__(self, tag: str, source: str, order: int):
        self.tag, self.source, self.order = tag, source, order
        self.children, self.end, self._attrs = [], order, None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for name, *values in _ATTRIBUTE.findall(self.source):
                self._attrs.setdefault(name.lower(), unescape("".join(values)))
        return self._attrs


class Page:
    """The elements of a page in their order; the first holds all others."""

    def __init__(self, html: str):
        self.elements = [Element("#root", "", 0)]
        self._parse(html)

    @property
    def root(self) -> Element:
        return self.elements[0]

    def inside(self, element: Element) -> list[Element]:
        return self.elements[element.order + 1:element.end]

    def _parse(self, html: str) -> None:
        """End tags that nothing opened are passed over, and so is a tag that the
        page ends in. Time is linear in the page, however malformed it is."""
        elements, open_elements = self.elements, [self.root]
        self._depths = defaultdict(list)  # of the open elements, by tag
        place, search = 0, _TOKEN.search
        while token := search(html, place):
            if token.start() > place:
                open_elements[-1].children.append(html[place:token.start()])
            place = token.end()
            end_mark, tag, attrs, close = token.groups()
            if not tag or not close:
                continue
            tag = tag.lower()
            if end_mark:
                self._close(open_elements, tag)
                continue
            if tag in CLOSES_PARAGRAPH:
                self._close(open_elements, "p", within=("button", "table", "td", "th"))
            elif tag == "li":
                self._close(open_elements, "li", within=("ul", "ol"))
            elif tag == "a":
                self._close(open_elements, "a", within=("table", "td", "th"))
            element = Element(tag, attrs, len(elements))
            elements.append(element)
            element.end = len(elements)
            open_elements[-1].children.append(element)
            if tag in RAW_TEXT:
                stop = re.compile(f"</{tag}", re.I).search(html, place)
                until = stop.start() if stop else len(html)
                element.children.append(html[place:until])
                place = until
            if tag not in VOID:
                self._depths[tag].append(len(open_elements))
                open_elements.append(element)
        if place < len(html):
            open_elements[-1].children.append(html[place:])
        for element in open_elements:
            element.end = len(elements)

    def _close(self, open_elements: list[Element], tag: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of that tag, unless one of the tags
        ``within`` is open inside it."""
        depths = self._depths
        if not depths[tag] or any(depths[w] and depths[w][-1] > depths[tag][-1] for w in within):
            return
        depth = depths[tag][-1]
        for element in open_elements[depth:]:
            element.end = len(self.elements)
            depths[element.tag].pop()
        del open_elements[depth:]


def selector(css: str):
    """The tag and the test of ``tag.class[attribute=value]``, each part optional;
    ``*=`` asks for a part of the value. The test takes the tag as given."""
    parts = _SELECTOR.match(css)
    if not css or not parts:
        raise ValueError(f"cannot read selector {css!r}")
    name, op, value = (parts["name"] or "").lower(), parts["op"], parts["value"]
    classes = {c for c in parts["classes"].split(".") if c}

    def matches(element: Element) -> bool:
        # Attributes are read only where they may hold what is asked for.
        if not all(c in element.source for c in classes):
            return False
        if classes and not classes <= set(element.attrs.get("class", "").split()):
            return False
        if name:
            actual = element.attrs.get(name)
            return actual is not None and (value in actual if op == "*=" else value == actual)
        return True

    return parts["tag"] and parts["tag"].lower(), matches


class Finder:
    """Tells which of some selectors an element meets, by its tag first."""

    def __init__(self, css: list[str]):
        self.tests = [selector(c) for c in css]
        self.by_tag: dict[str, list] = {}

    def tests_for(self, tag: str) -> list:
        """(number, test) of the selectors an element with this tag may meet."""
        tests = self.by_tag.get(tag)
        if tests is None:
            tests = self.by_tag[tag] = [
                (i, test) for i, (asked, test) in enumerate(self.tests) if asked in (None, tag)]
        return tests

    def matches(self, elements: list[Element]):
        """(number of the selector, element) of all that meet one, in order."""
        for element in elements:
            for i, test in self.tests_for(element.tag):
                if test(element):
                    yield i, element


def visible_text(element: Element) -> str:
    """Text as a browser shows it: white space collapsed, a line per block, an
    empty line around paragraphs, no scripts or styles."""
    if len(element.children) == 1 and isinstance(element.children[0], str):
        return _SPACE.sub(" ", unescape(element.children[0])).strip(" ")
    lines, current, breaks = [], "", 0
    todo: list = [element]
    while todo:
        node = todo.pop()
        if isinstance(node, Element):
            if node.tag == "br":
                lines.append(current.rstrip(" "))
                current = ""
            elif node.tag not in HIDDEN:
                around = 2 if node.tag == "p" else 1 if node.tag in BLOCKS else 0
                todo.append(around)
                todo.extend(reversed(node.children))
                todo.append(around)
            continue
        if isinstance(node, int):
            breaks = max(breaks, node)
            continue
        text = _SPACE.sub(" ", unescape(node))
        if breaks and text in ("", " "):
            continue
        if breaks and (current or lines):
            lines.append(current.rstrip(" "))
            lines.extend([""] * (breaks - 1))
            current = ""
        breaks = 0
        if not current or current.endswith(" "):
            text = text.removeprefix(" ")
        current += text
    lines.append(current.rstrip(" "))
    return "\n".join(lines)
