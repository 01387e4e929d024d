"""Tables that the queries derive from the given ones, and the same definitions as SQL for the comparison."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.ranks import numbered

SP = r"[\s\x0b\x{85}\p{Z}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def norm(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n|[\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> '')"


def para_list(x: str, mode: str = "adaptive") -> str:
    lines = f"list_transform(string_split({norm(x)}, chr(10)), lambda l: {trim('l')})"
    blank = rf"list_transform(regexp_split_to_array(array_to_string({lines}, chr(10)), '\n\n+'), lambda b: replace(regexp_replace(b, '^\n+|\n+$', '', 'g'), chr(10), ' '))"
    return f"list_filter({blank if mode == 'blank' else f'case when contains({norm(x)}, chr(10) || chr(10)) then {blank} else {lines} end'}, lambda p: p <> '')"


def escape(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def source_books(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a book, its documents the chapters."""
    keys = numbered(documents(spark, d).select(F.col("source").alias("book_id"), "doc_id"), ["book_id"], ["doc_id"], number="spine_pos")
    keys = keys.withColumn("spine_pos", F.col("spine_pos").cast("int"))
    return keys.join(documents(spark, d).select("doc_id", "text"), "doc_id").select("book_id", "spine_pos", "doc_id", "text").withColumn("href", F.format_string("page_%03d.html", "spine_pos"))


SOURCE_BOOKS = "sb as (select source as book_id, cast(row_number() over (partition by source order by doc_id) as int) as spine_pos, doc_id, text from documents), source_books as (select *, format('page_{:03d}.html', spine_pos) as href from sb)"


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their host as book_id."""
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("book_id"), "page_id", "url", "html")


def site_books(spark: SparkSession, d: str) -> DataFrame:
    """Each host is a book, its pages the chapters."""
    pages = site_pages(spark, d)
    keys = numbered(pages.select("book_id", "page_id"), ["book_id"], ["page_id"], number="spine_pos")
    return keys.withColumn("spine_pos", F.col("spine_pos").cast("int")).join(pages.drop("book_id"), "page_id").select("book_id", "spine_pos", "page_id", "url", "html")


SITE_BOOKS = "hosts as (select *, regexp_extract(url, '://([^/?#]*)', 1) as book_id from pages), site_books as (select book_id, cast(row_number() over (partition by book_id order by page_id) as int) as spine_pos, page_id, url, html from hosts)"


#: What stands for what in messy pages: no end tags of paragraphs, unquoted values with apostrophes, marks and cells left open.
MESS = [("</p>", " 1 < 2 "), ("<li>", "<li title=it's><b>"), ("</nav>", "<table><tr><td>a<td><i>b</table><pre>x <code>y</nav>"), ('<div class="ad">', "<div class='a>b'><b>m</div><div>"), ("<br>", "<ol><li>n<ul><li>o</ul><li>p</ol>")]


def messy_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with markup as people write it."""
    html = F.col("html")
    for old, new in MESS:
        html = F.replace(html, F.lit(old), F.lit(new))
    return table(spark, d, "pages").select("page_id", html.alias("html"))


def _messy_sql() -> str:
    html = "html"
    for old, new in MESS:
        html = "replace({}, '{}', '{}')".format(html, *(x.replace("'", "''") for x in (old, new)))
    return f"messy as (select page_id, {html} as html from pages)"


MESSY_PAGES = _messy_sql()


def conv_books(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with blank lines between turns."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return turns.select("conv_id", F.array_join("ts.text", "\n\n").alias("text"))


CONV_BOOKS = "conv_books as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn, text) as text from conversations group by conv_id)"

BREAKS = ["\r\n", "\r", "\u0085", "\u2028", "\u2029", "\u000b", "\f"]


def mixed_newlines(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, BREAKS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return documents(spark, d).select("doc_id", F.replace("text", F.lit("\n"), kind).alias("text"))


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))


LINES = "lines_of as (select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as p, unnest(string_split(text, chr(10))) as line from documents)"


def ff_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line break is a form feed."""
    part = lambda x, i: F.concat(F.when(i == 0, "").when(i % 5 == 0, "\f").otherwise("\n"), x)
    return documents(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), part), "").alias("text"))


FF_PAGES = "ff_pages as (select doc_id, string_agg(case when p = 0 then '' when p % 5 = 0 then chr(12) else chr(10) end || line, '' order by p) as text from lines_of group by doc_id)"


def layout_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines with growing indents, a blank line after every third."""
    part = lambda x, i: F.concat(F.when(i == 0, "").when(i % 3 == 0, "\n\n").otherwise("\n"), F.repeat(F.lit(" "), (i % 4 * 4).cast("int")), x)
    return documents(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), part), "").alias("text"))


LAYOUT_TEXT = "layout_text as (select doc_id, string_agg(case when p = 0 then '' when p % 3 = 0 then chr(10) || chr(10) else chr(10) end || repeat(' ', p % 4 * 4) || line, '' order by p) as text from lines_of group by doc_id)"


def layout_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines with heights and left edges."""
    p = F.col("p")
    return lines_of(spark, d).select("doc_id", p.alias("row_no"), F.col("line").alias("text"), (700.0 - 12 * p - 10 * F.floor(p / 4)).cast("double").alias("y"), F.when(p % 5 == 0, 90.0).otherwise(72.0).alias("first_x")).where(F.trim("text") != "")


LAYOUT_ROWS = "layout_rows as (select doc_id, p as row_no, line as text, cast(700 - 12 * p - 10 * (p // 4) as double) as y, cast(case when p % 5 = 0 then 90 else 72 end as double) as first_x from lines_of where trim(line) <> '')"

EXTENSIONS = ["EPUB", "pdf", "mobi", "azw3", "fb2", "RTF", "md", "htm", "html", "txt", "docx", ""]


def file_paths(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 12 + 1).cast("int"))
    name = F.element_at(F.array(F.lit(" Title.. "), F.lit("   ...   "), F.lit("con"), F.lit("Com3"), F.lit("Company"), F.concat(F.lit("Book "), F.floor(F.col("doc_id") / 24).cast("string"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, d).select("doc_id", F.concat(F.lit("/lib/"), "source", F.lit("/"), name, F.lit("."), ext).alias("path"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.substring("text", 1, 20)).alias("title"))


FILE_PATHS = "file_paths as (select doc_id, '/lib/' || source || '/' || ([' Title.. ', '   ...   ', 'con', 'Com3', 'Company', 'Book ' || cast(doc_id // 24 as varchar)])[doc_id % 6 + 1] || '.' || ([" + ", ".join(f"'{x}'" for x in EXTENSIONS) + "])[doc_id % 12 + 1] as path, case when doc_id % 3 = 0 then '  ' else substring(text, 1, 20) end as title from documents)"


def _file(doc_id: int, text: str) -> tuple[str, bytes]:
    """A document as a file, of a kind that its id gives: archive, marked-up book, rich text, text, page, or one that is a reject."""
    from xml.sax.saxutils import escape as xml

    kind, lines = doc_id % 8, text.split("\n")
    if kind == 0:
        out, folders = io.BytesIO(), ("parts", "more")
        at = lambda n: f"{folders[n % 2]}/ch{n}.xhtml"
        items = "".join(f'<item id="c{n}" href="{at(n)}" media-type="application/xhtml+xml"/>' for n in range(1, len(lines) + 1))
        refs = "".join(f'<itemref idref="c{n}"/>' for n in range(len(lines), 0, -1))
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="book/list.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
            z.writestr("book/list.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Archive {doc_id}</dc:title></metadata><manifest><item id="look" href="look.css"/>{items}</manifest><spine><itemref idref="nowhere"/>{refs}</spine></package>')
            for n, line in enumerate(lines, 1):
                back = f'<a href="../{at(n - 1)}#end">back</a>' if n > 1 else ""
                z.writestr(f"book/{at(n)}", f"<html><body><p>{xml(line)}</p>{back}</body></html>")
            z.writestr("../outside.txt", "no")
        return ".epub", out.getvalue()
    if kind == 1:
        return ".fb2", f"<FictionBook><description><title-info><book-title>Tale {doc_id}</book-title></title-info></description><body><section>{''.join(f'<p>{xml(x)}</p>' for x in lines)}</section></body></FictionBook>".encode()
    if kind == 2:
        return ".rtf", b"{\\rtf1\\ansi " + b"\\par ".join(re.sub(r"[^ -\[\]-z|]", "", x).encode() for x in lines) + b"}"
    if kind == 4:
        return ".html", f"<head><title> Page &amp; {doc_id} </title></head><body class='a>b'><p>{xml(text)}</p></body>".encode()
    return (".pdf", b"%PDF") if kind == 5 else (".epub", text.encode()) if kind == 6 else (".txt", b" \n") if kind == 7 else (".txt", text.encode())


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): each document as a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 64).columns)
                made = [_file(i, t) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"/lib/b{i}{e}" for i, (e, _) in zip(ids, made, strict=True)]), pa.array([c for _, c in made], pa.binary())], ["path", "content"])

    return documents(spark, d).select("doc_id", "text").mapInArrow(run, "path string, content binary")


FILES = "files as (select *, doc_id % 8 as kind, '/lib/b' || doc_id || (['.epub', '.fb2', '.rtf', '.txt', '.html', '.pdf', '.epub', '.txt'])[doc_id % 8 + 1] as path from documents)"


def images(spark: SparkSession, d: str) -> DataFrame:
    """An image for every third document of a source, named after the page its paragraphs would be on."""
    return source_books(spark, d).where("spine_pos % 3 = 0").select("book_id", F.concat("book_id", F.lit("_"), F.col("spine_pos").cast("string"), F.lit("_Im0.png")).alias("file_name"))


IMAGES = "images as (select book_id, book_id || '_' || spine_pos || '_Im0.png' as file_name from source_books where spine_pos % 3 = 0)"


def fake_backend(texts: list[str], src: str, dst: str) -> list[str]:
    """Deterministic: echoes, empties and refusals by byte length and content."""
    if any("©" in t for t in texts):
        raise ValueError("refused")
    return [t if len(t.encode()) % 11 == 0 else "" if len(t.encode()) % 13 == 0 else "T:" + t for t in texts]


def prefix_backend(texts: list[str], src: str, dst: str) -> list[str]:
    """Answers everything."""
    return ["T:" + t for t in texts]


def with_sql(*ctes: str, select: str) -> str:
    return "with recursive " + ", ".join(ctes) + " " + select
