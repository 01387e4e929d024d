"""Links of a page: which entry of its book each names, and the page with links to renamed entries following."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from urllib.parse import quote, unquote

from bindery.functions import markup

#: Attributes that hold one link, and that which holds several. Fixed values of the format.
LINKS = frozenset(("href", "src", "poster", "data", "xlink:href"))
SETS = frozenset(("srcset", "imagesrcset"))
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:([ \t\n\f\r]*+=[ \t\n\f\r]*+)("[^"]*+"|'[^']*+'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+))?+""")
_NAME = re.compile(r"<[^ \t\n\f\r/>]*+")
_CANDIDATE = re.compile(r"([\s,]*+)(\S*[^\s,])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:|//|/|\\")


def normal(path: str) -> str:
    """A path without ``.`` and empty steps, each ``..`` taking back the step before it; those that lead out stay in front."""
    steps: list[str] = []
    for step in path.replace("\\", "/").split("/"):
        if step == ".." and steps and steps[-1] != "..":
            steps.pop()
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)


def resolve(link: str, page: str) -> str | None:
    """The entry that ``link``, decoded, names in a page at the path ``page``; None for other sites, roots, and places of the page itself."""
    path = re.split("[?#]", link.strip(), maxsplit=1)[0]
    if not path or _SCHEME.match(path):
        return None
    return normal(f"{page.rpartition('/')[0]}/{unquote(path)}")


def relative(target: str, page: str) -> str:
    """``target`` as a link of the page at the path ``page``."""
    here, there = page.split("/")[:-1], target.split("/")
    same = 0
    while same < min(len(here), len(there) - 1) and here[same] == there[same]:
        same += 1
    return quote("/".join([".."] * (len(here) - same) + there[same:]), safe="/!$'()*,;=@~+")


def _changed(html: str, change: Callable[[str], str | None]) -> Iterator[str]:
    """The page's tokens, with every link that ``change`` gives another one for replaced by it; all else byte for byte."""

    def each(found: re.Match) -> str:
        name = found.group(2)
        new = change(name)
        return found.group(1) + (name if new is None else new)

    def attribute(found: re.Match) -> str:
        name, equals, value = found.groups()
        kind = name.lower()
        if not value or (kind not in LINKS and kind not in SETS):
            return found.group()
        mark = value[0] if value[0] in "\"'" else ""
        old = markup.decoded(value[1:-1] if mark else value)
        new = _CANDIDATE.sub(lambda m: each(m) if not re.fullmatch(r"[\d.]+[wxh]", m.group(2)) else m.group(), old) if kind in SETS else change(old)
        if new is None or new == old:
            return found.group()
        return f"{name}{equals}{mark or chr(34)}{escape(new, quote=False).replace(mark or chr(34), '&#34;' if (mark or chr(34)) == chr(34) else '&#39;')}{mark or chr(34)}"

    for kind, _, raw, _, _ in markup.walk(html):
        if kind in ("open", "void"):
            at = _NAME.match(raw).end()
            raw = raw[:at] + _ATTRIBUTE.sub(attribute, raw[at:])
        yield raw


def targets(html: str, page: str) -> list[str]:
    """The entries that the page's links name, each once."""
    found: dict[str, None] = {}

    def note(link: str) -> None:
        entry = resolve(link, page)
        if entry:
            found[entry] = None

    for _ in _changed(html, note):
        pass
    return list(found)


def relinked(html: str, page: str, renamed: dict[str, str]) -> str:
    """The page with its links to ``renamed`` entries (old path: new path) following; queries and fragments stay."""

    def change(link: str) -> str | None:
        new = renamed.get(resolve(link, page) or "")
        if new is None:
            return None
        rest = re.search("[?#].*", link, re.S)
        return relative(new, page) + (rest.group() if rest else "")

    return "".join(_changed(html, change))
