"""HTML as rows of tokens: text lengths, body blocks, translatable segments and their way back into the page.

Texts, blocks and segments all come from one walk over a page's tokens (``bindery.functions.markup``), in the task that holds the page:
nothing here is shuffled but the texts that meet the translation memory. Comments, scripts and styles are single tokens, an
end tag ends what is open inside its element, and what is never closed ends where HTML ends it or with the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from bindery.functions import markup
from bindery.functions.text import html_body

#: Pages that a task turns into rows at once.
PAGES = 64


def per_page(pages: DataFrame, key: list[str], html: Column, fields: dict[str, object], rows: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(key, fields): what ``rows`` gives for each page, in order, without a shuffle; none for a null page."""
    own = pages.select(*key, html.alias("__html"))
    schema = StructType([*own.schema.fields[:-1], *[StructField(n, t) for n, t in fields.items()]])
    names, kinds = list(fields), to_arrow_schema(StructType([StructField(n, t) for n, t in fields.items()])).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, PAGES):
                batch = whole.slice(s, PAGES)
                made = [(at, row) for at, page in enumerate(batch.column(len(key)).to_pylist()) if page is not None for row in rows(page)]
                at = pa.array([a for a, _ in made], pa.int32())
                values = [pa.array([row[k] for _, row in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(key))], *values], [*key, *names])

    return own.mapInArrow(run, schema)


def of_page(html: Column, kind, value: Callable[[str], object]) -> Column:
    """``value`` of each page as a column; null for a null page."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else value(p) for p in pages.to_pylist()], arrow)

    arrow = to_arrow_schema(StructType([StructField("x", kind)])).types[0]
    return F.arrow_udf(run, kind)(html)


def html_tokens(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, pos, kind, tag, raw, depth): kind is text, open, close, void, raw or comment; depth counts the elements that a token
    stands in."""
    rows = lambda page: ((n, t.kind, t.tag, t.raw, t.depth) for n, t in enumerate(markup.walk(page)))
    return per_page(pages, key, F.col(html), {"pos": IntegerType(), "kind": StringType(), "tag": StringType(), "raw": StringType(), "depth": IntegerType()}, rows)


def visible_texts(html: Column, hides: Callable[[str, str], bool] = markup.never) -> Column:
    """Array of the decoded, trimmed, non-blank texts outside of scripts, styles and the elements that ``hides`` names."""
    return of_page(html, ArrayType(StringType()), lambda page: list(markup.texts(page, hides)))


def bytes_of_text(body: str) -> int:
    return sum(len(t.encode()) for t in markup.texts(body))


def text_len(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, text_len): bytes of trimmed text in the body; scripts and styles don't count, code does. Null without a page."""
    return pages.select(*key, of_page(html_body(F.col(html)), IntegerType(), bytes_of_text).alias("text_len"))


def body_blocks(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, block_no from 1, html, len): direct children of the body in order, loose text counts if not blank."""
    rows = lambda body: ((n, *block) for n, block in enumerate(markup.blocks(body), 1))
    return per_page(pages, key, html_body(F.col(html)), {"block_no": IntegerType(), "html": StringType(), "len": IntegerType()}, rows)


def extract_segments(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, seq from 0, text): decoded, trimmed, non-blank text outside script, style, code and pre, in document order."""
    return per_page(pages, key, F.col(html), {"seq": IntegerType(), "text": StringType()}, lambda page: enumerate(markup.texts(page, markup.code)))


def apply_translations(pages: DataFrame, tm: DataFrame, key: list[str], html: str = "html", encode: Callable[[str], str] | None = None) -> DataFrame:
    """(key, html): each segment's text replaced by ``tm`` (text, translated), white space around it kept.

    Without a translation, or with an empty one, the token stays byte for byte, as all others do. Null pages stay null.
    ``encode`` (default: HTML escaping of & < >) is applied to translations. ``key`` names a page.

    A page's distinct texts meet the memory, one row each, so a text that stands on every page costs keys and not pages; what is
    found comes back as a small map to the page, which is put together in its task.
    """
    encode = encode or (lambda text: escape(text, quote=False))
    known = tm.where("translated is not null and translated <> ''").groupBy("text").agg(F.min("translated").alias("translated"))
    asked = per_page(pages, key, F.col(html), {"text": StringType()}, lambda page: ((t,) for t in dict.fromkeys(markup.texts(page, markup.code))))
    found = asked.join(known, "text").groupBy(*key).agg(F.collect_list(F.struct("text", "translated")).alias("__found"))
    names = [f"__k{n}" for n in range(len(key))]
    found = found.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col("__found.text").alias("__said"), F.col("__found.translated").alias("__now"))
    same = F.lit(True)
    for k, n in zip(key, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))

    def run(page: pa.Array, said: pa.Array, now: pa.Array) -> pa.Array:
        rows = zip(page.to_pylist(), said.to_pylist(), now.to_pylist(), strict=True)
        return pa.array([p if s is None or p is None else markup.replaced(p, dict(zip(s, n, strict=True)), encode) for p, s, n in rows], pa.string())

    both = pages.select(*key, F.col(html).alias("__html")).join(found, same, "left")
    return both.select(*key, F.arrow_udf(run, StringType())("__html", "__said", "__now").alias("html"))
