"""A tolerant tree of markup and selectors over it, for pages that nobody has checked.

Elements that authors leave open end where the next of their kind or their parent does; an end tag without a start is
passed over, and one that closes an outer element closes those within it. Nothing that a page holds raises.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content; what an opening tag ends, up to the elements that keep it in.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {
    **{tag: ({"p"}, {"div", "li", "td", "th", "section", "article", "body", "button"}) for tag in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: What an end tag cannot close across.
_WALLS = frozenset(("table", "td", "th"))


class Markup(HTMLParser):
    """A parser for which ``<![`` of any kind is a comment."""

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def read(self, text: str | None):
        self.feed(text or "")
        self.close()
        return self


class Element:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Element | str] = []

    def children(self) -> list[Element]:
        return [x for x in self.parts if isinstance(x, Element)]

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order, without recursion."""
        waiting = self.children()[::-1]
        while waiting:
            now = waiting.pop()
            yield now
            waiting += now.children()[::-1]

    def text(self) -> str:
        """Text below this element with single spaces; scripts and styles are none."""
        found, waiting = [], self.parts[::-1]
        while waiting:
            now = waiting.pop()
            if isinstance(now, str):
                found.append(now)
            elif now.tag not in ("script", "style"):
                found.append(" " if now.tag == "br" or now.tag in _BLOCKS else "")
                waiting += now.parts[::-1]
        return " ".join("".join(found).split())

    def select(self, selector: str) -> list[Element]:
        """Elements below this one that meet the selector, each once, in document order."""
        wanted = _parsed(selector)
        return [x for x in self.walk() if any(_meets(x, steps, self) for steps in wanted)]

    def first(self, selector: str, own: bool = False) -> Element | None:
        """The first of ``select``; with ``own``, this element itself if it meets a selector of one step."""
        wanted = _parsed(selector)
        if own and any(len(steps) == 1 and _passes(self, steps[0][1]) for steps in wanted):
            return self
        return next((x for x in self.walk() if any(_meets(x, steps, self) for steps in wanted)), None)


class _Builder(Markup):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.now = self.root = Element("", {}, None)

    def _close(self, tags: set[str], walls: set[str]) -> None:
        """End the outermost open element of ``tags`` that no wall keeps in."""
        at, found = self.now, None
        while at.parent is not None and at.tag not in walls:
            if at.tag in tags:
                found = at
            at = at.parent
        if found is not None:
            self.now = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        made = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)  # of repeated attributes the first counts
        self.now.parts.append(made)
        if tag not in VOID:
            self.now = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            if at.tag in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.parts.append(data)


def tree(text: str | None) -> Element:
    """The root of ``text``; it has no tag."""
    return _Builder().read(text).root


_SIMPLE = re.compile(r"""([a-z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([~^$*]?)=["']?([^\]"']*)["']?)?\]|:nth-(child|of-type)\((\d+)\)|:(first|last)-child""", re.I)
_STEP = re.compile(r"\s*([\s>])\s*")


@functools.lru_cache(256)
def _parsed(selector: str) -> list[list[tuple[str, tuple]]]:
    """Alternatives of steps, the last one first: how the step above is reached, and its tests."""
    out = []
    for part in selector.split(","):
        cut = _STEP.split(part.strip())
        steps = []
        for how, simple in zip([" ", *cut[1::2]], cut[::2]):
            tests = [m.groups() for m in _SIMPLE.finditer(simple)]
            if not simple or "".join(m.group() for m in _SIMPLE.finditer(simple)) != simple:
                raise ValueError(f"not a selector: {selector}")
            steps.append((how.strip() or " ", tuple(tests)))
        out.append(steps[::-1])
    return out


def _place(x: Element, same_tag: bool) -> int:
    return [y for y in x.parent.children() if not same_tag or y.tag == x.tag].index(x) + 1


def _passes(x: Element, tests: tuple) -> bool:
    for tag, group, name, attr, how, value, nth, number, end in tests:
        if tag and tag not in ("*", x.tag) and tag.lower() != x.tag:
            return False
        if group and group not in x.attrs.get("class", "").split():
            return False
        if name and x.attrs.get("id") != name:
            return False
        if attr:
            held = x.attrs.get(attr.lower())
            if held is None or value is not None and not (
                held == value if not how else value in held.split() if how == "~" else bool(value) and (held.startswith(value) if how == "^" else held.endswith(value) if how == "$" else value in held)
            ):
                return False
        if nth and _place(x, nth == "of-type") != int(number):
            return False
        if end and x.parent.children()[0 if end == "first" else -1] is not x:
            return False
    return True


def _meets(x: Element, steps: list[tuple[str, tuple]], top: Element) -> bool:
    """Whether ``x`` meets the last step, and elements above it, all below ``top``, the others."""
    if not _passes(x, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    at = x.parent
    while at is not None and at is not top:
        if _meets(at, steps[1:], top):
            return True
        if steps[0][0] == ">":
            return False
        at = at.parent
    return False


class _Text(Markup):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def plain_text(markup: str | None) -> str | None:
    """The text of ``markup`` without tags, entities resolved and white space as single spaces."""
    if markup is None:
        return None
    return " ".join("".join(_Text().read(markup).parts).split())
