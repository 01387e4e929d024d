"""Column functions on text, names and paths. Sizes are UTF-8 bytes unless a name says characters."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in a form that Java's and RE2's patterns share.
SPACE = r"[\s\x{0b}\x{85}\p{Z}]"
#: The same as characters.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Language names by code; an unknown code stands for itself.
LANGUAGES = {"en": "English", "ru": "Russian", "de": "German", "fr": "French", "es": "Spanish", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "it": "Italian", "pt": "Portuguese", "pl": "Polish", "uk": "Ukrainian"}
#: Formats by lower-cased extension; anything else is plain text.
FORMATS = {"epub": "epub", "pdf": "pdf", "mobi": "mobi", "azw3": "mobi", "fb2": "fb2", "rtf": "rtf", "md": "md", "html": "html", "htm": "html", "txt": "txt"}


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows the ASCII blank alone)."""
    return F.btrim(c, F.lit(SPACES))


def rtrim_space(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def normalize_lines(c: Column, keep_ff: bool = False) -> Column:
    """Every line separator as ``\\n``; form feeds too unless they are kept."""
    return F.regexp_replace(c, r"\r\n|[\r\x{0b}\x{85}\x{2028}\x{2029}" + ("" if keep_ff else r"\f") + "]", "\n")


def html_escape(c: Column) -> Column:
    """``& < > ' "`` as entities, the ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


#: Named entities that are decoded: those of HTML 4, by Python's own table, and the apostrophe.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
#: Numeric and named entities, with their semicolon.
ENTITY = "&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});"
#: What code points 128 to 159 stand for in entities.
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _entity(e: Column) -> Column:
    """The character of what ENTITY matches; an unknown name stays, a number that is no character is U+FFFD."""
    hexa = F.lower(F.substring(e, 3, 1)) == "x"
    digits = F.when(hexa, F.conv(F.substring(e, F.lit(4), F.length(e) - 4), 16, 10)).otherwise(F.substring(e, F.lit(3), F.length(e) - 3))

    def char(code: Column) -> Column:
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.when(bad, "\ufffd").when(code.between(128, 159), F.substring(F.lit(C1), (code - 127).cast("int"), F.lit(1))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # a constant, read once
    named = F.coalesce(F.try_element_at(names, F.substring(e, F.lit(2), F.length(e) - 2)), e)
    return F.when(F.substring(e, 2, 1) == "#", _let(digits.try_cast("long"), char)).otherwise(named)


def decode_entities(c: Column) -> Column:
    """Numeric and named entities as characters, each once (``&amp;lt;`` is ``&lt;``); unknown names stay.

    A text's entities are found once, so the work grows with the text, not with the square of its entities.
    """
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({ENTITY})"), 1), _entity)
    joined = F.array_join(F.zip_with(F.split(c, ENTITY, -1), found, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def _file(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(_file(path), r"\.[^.]*$", "")


def route_format(path: Column) -> Column:
    """Format by extension; unknown ones are ``txt``."""
    ext = F.lower(F.regexp_extract(_file(path), r"\.([^.]*)$", 1))
    out = F.lit("txt")
    for e, f in FORMATS.items():
        out = F.when(ext == e, f).otherwise(out)
    return out


def sanitize_name(name: Column) -> Column:
    """A name that is a folder name on any system: trimmed, no dots or blanks at the end, not empty, not reserved."""
    base = F.regexp_replace(utrim(name), r"[. ]+$", "")
    reserved = F.upper(base).rlike(r"^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$")
    return F.when(base == "", "document").when(reserved, F.concat(base, F.lit("_"))).otherwise(base)


def book_title(title: Column, path: Column) -> Column:
    """The title of the metadata, else the file name without extension."""
    return F.coalesce(F.nullif(utrim(title), F.lit("")), stem(path))


def html_title(html: Column, path: Column) -> Column:
    """The first ``title`` with text, decoded and trimmed, else the file name without extension."""
    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), 1), lambda t: utrim(decode_entities(t))), lambda t: t != "")
    return F.coalesce(F.get(found, 0), stem(path))


#: The body's start tag; a quote opens a value, which may hold ``>``, only after ``=``. Possessive: in time linear in the page.
BODY_TAG = r"""<body(?:[ \t\n\f\r/](?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?+)?+)*+)?+>"""


def html_body(html: Column) -> Column:
    """What is inside ``body``; to the end if it isn't closed; everything if there is none."""
    open_at = F.regexp_instr(html, F.lit(f"(?i){BODY_TAG}"))
    rest = F.substring(html, open_at + F.length(F.regexp_extract(html, f"(?i){BODY_TAG}", 0)), F.length(html))
    end_at = F.regexp_instr(rest, F.lit(r"(?i)</body\s*+>"))
    return F.when(open_at == 0, html).when(end_at == 0, rest).otherwise(F.substring(rest, F.lit(1), end_at - 1))


def classify_block(text: Column, indent: Column) -> Column:
    """``h2`` for short lines in capitals or far from the margin, ``h3`` for longer ones far from it, else ``p``."""
    n = F.size(words(text))
    capitals = (F.upper(text) == text) & text.rlike("[A-Z]")
    return F.when(n == 0, "p").when((capitals | (indent > 8)) & (n <= 8), "h2").when((indent > 8) & (n <= 14), "h3").otherwise("p")


def is_garbage(text: Column) -> Column:
    """Four words or more of under three bytes on average: a font map that was not decoded."""
    ws = words(text)
    total = F.aggregate(ws, F.lit(0), lambda a, w: a + F.octet_length(w))
    return (F.size(ws) >= 4) & (total / F.size(ws) < 3.0)


def image_page_no(name: Column, total: Column) -> Column:
    """Page number in an image's file name: the first middle part that is one, else the last part, else 0."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    number = lambda p: F.when(p.rlike(r"^[+-]?[0-9]{1,9}$"), p.cast("int"))
    fits = lambda p: number(p).between(1, total)
    middle = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), fits)
    last = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: fits(p))
    at_end = F.when(F.size(parts) >= 2, F.element_at(parts, -1))
    return F.when(F.size(last) == 0, 0).otherwise(F.coalesce(number(F.get(middle, 0)), F.when(fits(at_end), number(at_end)), F.lit(0)))


def full_href(base: Column, href: Column) -> Column:
    """``base/href`` unless the base is empty or the current folder."""
    return F.when(F.coalesce(base, F.lit("")).isin("", "."), href).otherwise(F.concat_ws("/", base, href))


def folder(path: Column) -> Column:
    """Folder of a path with slashes, ``.`` without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def relative_path(from_dir: Column, target: Column) -> Column:
    """``target`` as seen from the folder ``from_dir``; both with slashes or backslashes, from one root."""
    here = F.split(F.translate(from_dir, "\\", "/"), "/")
    to = F.translate(target, "\\", "/")
    there = F.when(folder(to) == ".", F.array().cast("array<string>")).otherwise(F.split(folder(to), "/"))
    pairs = F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(pairs, False)
    common = F.when(differ == 0, F.size(pairs)).otherwise(differ - 1).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(here) - common)
    down = F.slice(there, common + 1, F.greatest(F.size(there) - common, F.lit(0)))
    return F.when(from_dir.isin("", ".") | to.isNull(), to).otherwise(F.array_join(F.concat(up, down, F.array(_file(to))), "/"))


def chapter_label(href: Column, number: Column) -> Column:
    """``n. name`` with blanks for underscores and hyphens; ``Chapter n`` without a name."""
    name = F.translate(stem(href), "_-", "  ")
    return F.when(name == "", F.concat(F.lit("Chapter "), number.cast("string"))).otherwise(F.concat(number.cast("string"), F.lit(". "), name))


#: Originals of fewer bytes may come back as they are.
ECHO_BYTES = 10


def is_echo(translated: Column, original: Column) -> Column:
    """Nothing came back, or ten bytes and more came back as they were (case and outer white space aside)."""
    said = F.coalesce(utrim(translated), F.lit(""))
    return F.when(said == "", True).when(F.octet_length(utrim(original)) < ECHO_BYTES, False).otherwise(F.lower(said) == F.lower(utrim(original)))


def echoes(translated: str | None, original: str) -> bool:
    """``is_echo`` inside a task that asks again."""
    said, meant = (translated or "").strip(SPACES), original.strip(SPACES)
    return not said or (len(meant.encode()) >= ECHO_BYTES and said.lower() == meant.lower())


def language_name(code: Column) -> Column:
    out = code
    for k, v in LANGUAGES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    """Digits with commas."""
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    """``42s`` under a minute, else ``4m5s``."""
    whole = F.floor(seconds).cast("int")
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).otherwise(F.format_string("%dm%ds", (whole / 60).cast("int"), whole % 60))
