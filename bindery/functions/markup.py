"""HTML of one page as tokens, with the elements that are open at each.

Spark has no expression for a stack, so these helpers run inside tasks, one page at a time. Both the pattern and the stack take
time in proportion to the page, whatever is in it: groups are possessive, so nothing is tried twice, an element type that is
not open is never searched for, and elements nested over ``DEEPEST`` levels don't deepen the stack.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

from bindery.functions.text import C1, ENTITIES, ENTITY, SPACES

_WS = r"[ \t\n\f\r]"
#: What follows a tag's name up to its end: blanks and slashes, or a name with perhaps a value. A quote opens a value only after
#: ``=``; elsewhere it is a character like others, and so it is if it is never closed.
ATTRIBUTES = rf"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_WS}*+={_WS}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?+)?+)*+"""


def _raw(tag: str) -> str:
    """An element whose content is no markup: up to its own end tag."""
    named = rf"{tag}(?=[ \t\n\f\r/>]|\Z){ATTRIBUTES}"
    return rf"<{named}(?:>.*?(?:</{named}>?+|\Z)|\Z)"


TOKEN = re.compile(
    r"(?is)(?P<comment><!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?+|</(?![a-z]|\Z)[^>]*+>?+)"
    rf"|(?P<raw>{_raw('script')}|{_raw('style')})"
    rf"|(?P<tag></?[a-z][^ \t\n\f\r/>]*+{ATTRIBUTES}>?+)"
    r"|(?P<text>(?:[^<]++|<(?![a-z/!?])|</\Z)++)"
)
_NAME = re.compile(r"</?([A-Za-z][^ \t\n\f\r/>]*)")
_ENTITY = re.compile(ENTITY)
DEEPEST = 512

#: Elements without an end tag; elements that end an open paragraph; headings; marks, whose end tag leaves open what is inside.
#: Fixed values of the format.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCK = HEADING | frozenset(("address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"))
MARK = frozenset(("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"))
ROWS = frozenset(("tbody", "thead", "tfoot"))
CELL = frozenset(("td", "th"))
IN_TABLE = ROWS | CELL | frozenset(("tr", "caption", "colgroup"))
#: Borders that an end does not reach over; of paragraphs, of list items, of anything but a part of a table, of marks.
SCOPE = CELL | frozenset(("table", "caption", "html", "object", "template"))
LIST = SCOPE | frozenset(("ol", "ul"))
SPECIAL = BLOCK | IN_TABLE | SCOPE | frozenset(("body", "head", "button", "select"))


class Token(NamedTuple):
    """``kind`` is text, open, close, void, raw or comment; ``depth`` how many elements it stands in; ``hidden`` whether one of them hides it."""

    kind: str
    tag: str
    raw: str
    depth: int
    hidden: bool


class _Open:
    """The elements that are open, innermost last."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.hides: list[bool] = []
        self.count: Counter[str] = Counter()
        self.hidden = 0

    def push(self, tag: str, hides: bool) -> None:
        if len(self.tags) < DEEPEST:
            self.tags.append(tag)
            self.hides.append(hides)
            self.count[tag] += 1
            self.hidden += hides

    def _pop(self, at: int = -1) -> None:
        self.count[self.tags.pop(at)] -= 1
        self.hidden -= self.hides.pop(at)

    def find(self, wanted: frozenset[str], border: frozenset[str]) -> int:
        """Place of the innermost of ``wanted`` within the innermost ``border``, else -1."""
        if any(self.count[t] for t in wanted):
            for at in range(len(self.tags) - 1, -1, -1):
                if self.tags[at] in wanted:
                    return at
                if self.tags[at] in border:
                    break
        return -1

    def end(self, wanted: frozenset[str], border: frozenset[str], stay: bool = False) -> None:
        """Ends the innermost of ``wanted`` and all inside it; with ``stay`` only what is inside."""
        at = self.find(wanted, border)
        while at >= 0 and len(self.tags) > at + stay:
            self._pop()

    def before(self, tag: str) -> None:
        """What the start of ``tag`` ends."""
        if tag == "li":
            self.end(frozenset(("li",)), LIST)
        elif tag in ("dd", "dt"):
            self.end(frozenset(("dd", "dt")), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.end(frozenset(("option",)), SCOPE | {"select"})
        elif tag == "a":
            self.end(frozenset(("a",)), SPECIAL)
        elif tag in CELL:
            self.end(ROWS | {"tr", "table"}, frozenset(), stay=True)
        elif tag == "tr":
            self.end(ROWS | {"table"}, frozenset(), stay=True)
        elif tag in IN_TABLE:
            self.end(frozenset(("table",)), frozenset(), stay=True)
        elif tag == "body":
            self.end(frozenset(("html",)), frozenset(), stay=True)
        if tag in BLOCK:
            self.end(frozenset(("p",)), SCOPE | {"button"})
        if tag in HEADING and self.tags and self.tags[-1] in HEADING:
            self._pop()

    def after(self, tag: str) -> None:
        """What the end tag of ``tag`` ends."""
        if tag in MARK:
            at = self.find(frozenset((tag,)), SCOPE)
            if at >= 0 and any(t in SPECIAL for t in self.tags[at + 1 :]):
                self._pop(at)
            else:
                self.end(frozenset((tag,)), SCOPE)
        elif tag in HEADING:
            self.end(HEADING, SCOPE)
        elif tag == "li":
            self.end(frozenset(("li",)), LIST)
        elif tag == "table" or tag in ("body", "html"):
            self.end(frozenset((tag,)), frozenset())
        elif tag in IN_TABLE:
            self.end(frozenset((tag,)), frozenset(("table",)))
        elif tag in SPECIAL:
            self.end(frozenset((tag,)), SCOPE)
        else:
            self.end(frozenset((tag,)), SPECIAL)


def never(tag: str, raw: str) -> bool:
    return False


def code(tag: str, raw: str) -> bool:
    """Elements whose text is never translated."""
    return tag in ("code", "pre")


def walk(html: str, hides: Callable[[str, str], bool] = never) -> Iterator[Token]:
    """All of a page as tokens in order; ``hides`` says of an element's name and start tag whether what is in it is hidden."""
    now = _Open()
    for found in TOKEN.finditer(html):
        kind, raw = found.lastgroup, found.group()
        if kind in ("text", "comment"):
            yield Token(kind, "", raw, len(now.tags), now.hidden > 0)
            continue
        tag = _NAME.match(raw).group(1).lower()
        if kind == "raw":
            yield Token(kind, tag, raw, len(now.tags), True)
        elif raw.startswith("</"):
            yield Token("close", tag, raw, len(now.tags), now.hidden > 0)
            now.after(tag)
        else:
            now.before(tag)
            empty = tag in VOID or raw.endswith("/>")
            yield Token("void" if empty else "open", tag, raw, len(now.tags), now.hidden > 0)
            if not empty:
                now.push(tag, hides(tag, raw))


def _character(found: re.Match) -> str:
    name = found.group()[1:-1]
    if not name.startswith("#"):
        return ENTITIES.get(name, found.group())
    n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    if not n or n > 0x10FFFF or 0xD800 <= n < 0xE000:
        return "�"
    return C1[n - 128] if 128 <= n < 160 else chr(n)


def decoded(raw: str) -> str:
    """Numeric and named entities as characters, each once; unknown names stay."""
    return _ENTITY.sub(_character, raw) if "&" in raw else raw


def texts(html: str, hides: Callable[[str, str], bool] = never) -> Iterator[str]:
    """Decoded, trimmed, non-blank texts that nothing hides, in order."""
    for token in walk(html, hides):
        if token.kind == "text" and not token.hidden and (said := decoded(token.raw).strip(SPACES)):
            yield said


def blocks(body: str) -> Iterator[tuple[str, int]]:
    """What stands in the body itself, as (html, bytes of text): elements, and loose text that is not blank. Comments and blanks
    go with the block before them; those before the first are left out."""
    parts: list[str] = []
    size = 0
    for kind, _, raw, depth, _ in walk(body):
        said = decoded(raw).strip(SPACES) if kind == "text" else ""
        if not depth and (kind in ("open", "void", "raw") or said):
            if parts:
                yield "".join(parts), size
            parts, size = [raw], 0
        elif parts:
            parts.append(raw)
        size += len(said.encode())
    if parts:
        yield "".join(parts), size


def replaced(html: str, translations: dict[str, str], encode: Callable[[str], str]) -> str:
    """The page with translated texts in the place of those that it has; white space around them and all other tokens stay."""
    out = []
    for kind, _, raw, _, hidden in walk(html, code):
        if kind == "text" and not hidden:
            whole = decoded(raw)
            said = whole.strip(SPACES)
            new = translations.get(said) if said else None
            if new:
                at = whole.index(said)
                raw = whole[:at] + encode(new) + whole[at + len(said) :]
        out.append(raw)
    return "".join(out)
