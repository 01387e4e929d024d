"""Navigation, snippets, tables of contents and index pages, as columns and one row per page or book."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bindery.functions import markup
from bindery.functions.text import BODY_TAG, chapter_label, folder, full_href, html_body, html_escape, relative_path, rtrim_space
from bindery.operators.ranks import numbered
from bindery.operators.tokens import of_page

SNIPPET_BYTES, SNIPPET_CHARS = 300, 250
#: Chapters that a part of a contents page lists; what a book without a title is called (a fixed value).
PART_ENTRIES, NO_TITLE = 5000, "EPUB Book"
_HEADER = re.compile(r"""(?i)\bclass\s*=\s*(?:"[^"]*\bpage-header\b|'[^']*\bpage-header\b|page-header(?=[\s>]))""")


def _aside(tag: str, raw: str) -> bool:
    """Elements of which a snippet says nothing: heads, bars, buttons, and the page's own header."""
    return tag in ("head", "nav", "button") or (tag == "div" and bool(_HEADER.search(raw)))


def _beginning(body: str) -> str:
    """A page's first texts, joined by blanks, until they are over SNIPPET_BYTES."""
    out, size = [], 0
    for text in markup.texts(body, _aside):
        out.append(text)
        size += len(text.encode()) + (len(out) > 1)
        if size > SNIPPET_BYTES:
            break
    return " ".join(out)


def nav(spine: DataFrame) -> DataFrame:
    """(book_id, spine_pos, href, prev_href, next_href, index_href, current, total) from (book_id, spine_pos, href,
    base_path): links are relative to each page's folder. A book may have any number of pages."""
    pages = numbered(spine.select("book_id", "spine_pos", full_href(F.col("base_path"), F.col("href")).alias("full")), ["book_id"], ["spine_pos"], ["full"], "current", "total")
    here = folder(F.col("full"))
    return pages.select("book_id", "spine_pos", F.col("full").alias("href"), relative_path(here, F.col("prev_full")).alias("prev_href"), relative_path(here, F.col("next_full")).alias("next_href"), relative_path(here, F.lit("index.html")).alias("index_href"), F.col("current").cast("int").alias("current"), F.col("total").cast("int").alias("total"))


def nav_html(prev: Column, following: Column, index: Column, current: Column, total: Column, labels: tuple[str, str, str] = ("Previous", "Next", "Contents")) -> Column:
    """A plain bar: where the page stands, then the links that it has."""
    link = lambda rel, href, text: F.coalesce(F.concat(F.lit(f' <a rel="{rel}" href="'), html_escape(href), F.lit(f'">{text}</a>')), F.lit(""))
    place = F.concat(F.lit("<b>"), current.cast("string"), F.lit("</b> of "), total.cast("string"))
    return F.concat(F.lit('<nav class="pager">'), place, link("prev", prev, labels[0]), link("next", following, labels[1]), link("contents", index, labels[2]), F.lit("</nav>"))


def inject(html: Column, in_head: Column, in_body: Column) -> Column:
    """``in_head`` before ``</head>``, ``in_body`` after the ``body`` tag; a tag that isn't there is skipped."""
    at = F.regexp_instr(html, F.lit("(?i)</head>"))
    one = F.when(at > 0, F.concat(F.substring(html, F.lit(1), at - 1), in_head, F.substring(html, at, F.length(html)))).otherwise(html)
    start, tag = F.regexp_instr(one, F.lit(f"(?i){BODY_TAG}")), F.length(F.regexp_extract(one, f"(?i){BODY_TAG}", 0))
    return F.when(start > 0, F.concat(F.substring(one, F.lit(1), start + tag - 1), in_body, F.substring(one, start + tag, F.length(one)))).otherwise(one)


def inject_nav(pages: DataFrame, bars: DataFrame, key: list[str], css: str = "", markup: Callable[..., Column] = nav_html) -> DataFrame:
    """Pages (key, html) with the bar of ``bars`` (key and the columns of ``nav``), drawn by ``markup``; without one as they are."""
    bar = markup(F.col("prev_href"), F.col("next_href"), F.col("index_href"), F.col("current"), F.col("total"))
    own = bars.select(*key, bar.alias("__bar"))
    done = F.when(F.col("__bar").isNull(), F.col("html")).otherwise(inject(F.col("html"), F.lit(css), F.col("__bar")))
    return pages.join(own, key, "left").withColumn("html", done).drop("__bar")


def snippet(html: Column) -> Column:
    """The first two sentences of a page's visible text within 250 characters, else a cut; empty without text."""
    text = of_page(html_body(html), StringType(), _beginning)
    two = F.regexp_extract(F.substring(text, 1, SNIPPET_CHARS), r"(?s)^((?:[^.!?]*[.!?]){2})", 1)
    cut = F.concat(rtrim_space(F.substring(text, 1, SNIPPET_CHARS)), F.lit("…"))
    return F.when(two != "", rtrim_space(two)).when(F.length(text) > SNIPPET_CHARS, cut).otherwise(text)


def contents_entry(full: Column, number: Column, label: Column, text: Column) -> Column:
    """One line of a contents page: the number and the snippet, or the label where there is none."""
    said = F.when(text != "", F.concat(number.cast("string"), F.lit(". "), text)).otherwise(label)
    return F.concat(F.lit('<p><a href="'), html_escape(full), F.lit('">'), html_escape(said), F.lit("</a></p>\n"))


def part_href(part: Column) -> Column:
    """Where a part of a book's contents is: ``index.html``, then ``index_2.html`` ..."""
    return F.when(part == 1, "index.html").otherwise(F.concat(F.lit("index_"), part.cast("string"), F.lit(".html")))


def contents_html(title: Column, sheets: Column, chapters: Column, part: Column, parts: Column, entries: Column) -> Column:
    """A contents page; of several parts each links to the one before and after it."""
    links = F.array_join(F.transform(sheets, lambda h: F.concat(F.lit('<link rel="stylesheet" href="'), html_escape(h), F.lit('">'))), "")
    step = lambda when, to, rel: F.when(when, F.concat(F.lit(f'<a rel="{rel}" href="'), part_href(to), F.lit(f'">{rel}</a>'))).otherwise("")
    around = F.concat(step(part > 1, part - 1, "prev"), step(part < parts, part + 1, "next"))
    return F.concat(
        F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title>"), links, F.lit('</head>\n<body>\n<main class="contents">\n<h2>'), title,
        F.lit("</h2>\n<p>"), chapters.cast("string"), F.lit(" chapters</p>\n"), entries, around, F.lit("</main>\n</body></html>\n"),
    )


def redirect_html(to: Column) -> Column:
    """A page that leads to the only chapter."""
    return F.concat(F.lit('<!doctype html>\n<meta charset="utf-8"><meta http-equiv="refresh" content="0; url='), html_escape(to), F.lit('">\n<a href="'), html_escape(to), F.lit('">1</a>\n'))


def build_index(spine: DataFrame, titles: DataFrame, css: DataFrame | None = None, entries: int = PART_ENTRIES, markup: Callable[..., Column] = contents_html) -> DataFrame:
    """(book_id, part, chapters, html): the contents in parts of at most ``entries`` chapters, or a redirect for a book of one page.

    ``spine`` has book_id, spine_pos, href, base_path and snippet; ``titles`` book_id and title; ``css`` book_id and href of
    style sheets. Parts are as large for a book of any size, and no task sees a whole book; ``markup`` draws a part.
    """
    rows = spine.select("book_id", "spine_pos", "href", full_href(F.col("base_path"), F.col("href")).alias("full"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    rows = numbered(rows, ["book_id"], ["spine_pos"], number="n", total="chapters")
    entry = contents_entry(F.col("full"), F.col("n"), chapter_label(F.col("href"), F.col("n")), F.col("snippet"))
    rows = rows.withColumn("part", (F.floor((F.col("n") - 1) / entries) + 1).cast("int"))
    parts = rows.groupBy("book_id", "part", "chapters").agg(F.min(F.struct("n", "full"))["full"].alias("first"), F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))).alias("es"))
    parts = parts.join(titles.select("book_id", "title"), "book_id", "left")
    if css is not None:
        parts = parts.join(css.groupBy("book_id").agg(F.array_sort(F.collect_set("href")).alias("sheets")), "book_id", "left")
    else:
        parts = parts.withColumn("sheets", F.lit(None).cast("array<string>"))
    title = html_escape(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(NO_TITLE)))
    page = markup(title, F.coalesce("sheets", F.array().cast("array<string>")), F.col("chapters"), F.col("part"), F.ceil(F.col("chapters") / entries).cast("int"), F.array_join("es.e", ""))
    return parts.select("book_id", "part", "chapters", F.when(F.col("chapters") == 1, redirect_html(F.col("first"))).otherwise(page).alias("html"))
