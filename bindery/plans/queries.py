"""Registered queries over documents, books and page layouts, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import books, paragraphs, report, site
from bindery.plans import fixtures as X
from bindery.plans.fixtures import escape, para_list, trim, with_sql, word_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


STEM = r"regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '')"
ROUTE = r"lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '\.([^.]*)$', 1))"
CLEAN = f"regexp_replace({trim('s')}, '[. ]+$', '')"
NAMES = f"named as (select *, case when c = '' then 'document' when regexp_full_match(upper(c), 'CON|PRN|AUX|NUL|(COM|LPT)[1-9]') then c || '_' else c end as name from (select *, {CLEAN} as c from (select *, {STEM} as s from file_paths)))"


@query("a1_route_format", with_sql(X.FILE_PATHS, select="select doc_id, case e " + " ".join(f"when '{k}' then '{v}'" for k, v in T.FORMATS.items()) + f" else 'txt' end as fmt from (select doc_id, {ROUTE} as e from file_paths)"))
def a1(s, d):
    return X.file_paths(s, d).select("doc_id", T.route_format(F.col("path")).alias("fmt"))


@query("a3_pending", with_sql(X.SOURCE_BOOKS, select="select distinct book_id from source_books b where not exists (select 1 from source_books c where c.book_id = b.book_id and cast(substring(c.book_id, 4) as int) % 2 = 0)"))
def a3(s, d):
    found = X.source_books(s, d).select("book_id").distinct()
    return books.pending(found, found.where(F.substring("book_id", 4, 9).cast("int") % 2 == 0), ["book_id"])


@query("a3_replace_books", with_sql(X.SOURCE_BOOKS, select="select doc_id as book_id, case when doc_id % 5 = 0 then 'rebuilt' else 'as it was' end as state, strlen(text) as size from documents where doc_id % 5 <> 0 or doc_id % 2 = 0"))
def a3_replace(s, d):
    """A store in which a fifth of the books are rebuilt; every other one of these has no rows any more."""
    from bindery.sources import shelf
    from bindery.sources.staging import scratch

    own = X.documents(s, d).select(F.col("doc_id").alias("book_id"), F.lit("as it was").alias("state"), F.octet_length("text").cast("long").alias("size"))
    again = own.where("book_id % 5 = 0")
    out = scratch(s)
    shelf.store({"sizes": own}, out, 16)
    shelf.replace_books({"sizes": again.where("book_id % 2 = 0").withColumn("state", F.lit("rebuilt"))}, out, again, 16)
    return shelf.load(s, out, ["sizes"])["sizes"]


@query("a6_sanitize_name", with_sql(X.FILE_PATHS, NAMES, select="select doc_id, name from named"))
def a6(s, d):
    return X.file_paths(s, d).select("doc_id", T.sanitize_name(T.stem(F.col("path"))).alias("name"))


@query("a7_name_collisions", with_sql(X.FILE_PATHS, NAMES, select="select name, count(*) as n from named group by name having count(*) > 1"))
def a7(s, d):
    return books.name_collisions(books.with_key(X.file_paths(s, d)))


@query("a8_book_title", with_sql(X.FILE_PATHS, select=f"select doc_id, coalesce(nullif({trim('title')}, ''), {STEM}) as title from file_paths"))
def a8(s, d):
    return X.file_paths(s, d).select("doc_id", T.book_title(F.col("title"), F.col("path")).alias("title"))


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CODE = "try_cast(replace(replace(e[3:-2], 'x', '0x'), 'X', '0x') as bigint)"
CHARACTER = (
    f"case when starts_with(e, '&#') then case when {CODE} = 0 or {CODE} > 1114111 or {CODE} between 55296 and 57343 then chr(65533) when {CODE} between 128 and 159 then {q(T.C1)}[{CODE} - 127] else chr(cast({CODE} as int)) end"
    " else coalesce(map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in T.ENTITIES.items()) + "}[e[2:-2]], e) end"
)


def decode_sql(x: str) -> str:
    return f"(case when contains({x}, '&') then array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {q(T.ENTITY)}), list_transform(regexp_extract_all({x}, {q(T.ENTITY)}), lambda e: {CHARACTER})), lambda z: z[1] || coalesce(z[2], '')), '') else {x} end)"


URL_STEM = STEM.replace("path", "url")
#: Blanks of markup, and what may follow a tag's name, for a matcher without possessive groups.
WS = r"[ \t\n\f\r]"
ATTRIBUTES = rf"""(?:[ \t\n\f\r/]+|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*(?:{WS}*={WS}*(?:"[^"]*"|'[^']*'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*)?)?)*"""
BODY_TAG = rf"<body(?:[ \t\n\f\r/]{ATTRIBUTES})?>"
BODY = f"case when not regexp_matches(html, {q('(?i)' + BODY_TAG)}) then html else regexp_replace(regexp_extract(html, {q('(?is)' + BODY_TAG + '(.*)$')}, 1), '(?is)</body\\s*>.*$', '') end"


PAGE_TITLE = f"coalesce(list_filter(list_transform(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1), lambda t: {trim(decode_sql('t'))}), lambda t: t <> '')[1], {URL_STEM})"


@query("a9_html_title", f"select page_id, {PAGE_TITLE} as title from pages")
def a9(s, d):
    return X.table(s, d, "pages").select("page_id", T.html_title(F.col("html"), F.col("url")).alias("title"))


@query("a10_html_body", f"select page_id, {BODY} as body from pages")
def a10(s, d):
    return X.table(s, d, "pages").select("page_id", T.html_body(F.col("html")).alias("body"))


@query("b1_normalize_lines", "select doc_id, text from documents")
def b1(s, d):
    return X.mixed_newlines(s, d).select("doc_id", T.normalize_lines(F.col("text")).alias("text"))


def unnested(key: str, array: str, source: str) -> str:
    return f"select {key}, cast(generate_subscripts(ps, 1) - 1 as int) as seq, unnest(ps) as text from (select {key}, {array} as ps from {source})"


@query("b2_paragraphs", unnested("doc_id", para_list("text"), "documents"))
def b2(s, d):
    return paragraphs.paragraphs(X.documents(s, d), ["doc_id"])


@query("b2_paragraphs_blank_lines", with_sql(X.CONV_BOOKS, select=unnested("conv_id", para_list("text"), "conv_books")))
def b2_blank(s, d):
    return paragraphs.paragraphs(X.conv_books(s, d), ["conv_id"])


@query("b3_paragraphs_blank_mode", unnested("doc_id", para_list("text", "blank"), "documents"))
def b3(s, d):
    return paragraphs.paragraphs(X.documents(s, d), ["doc_id"], mode="blank")


PARAS = f"paras as ({unnested('doc_id', para_list('text'), 'documents')})"
PAGED = "paged as (select doc_id, seq, text, seq // 30 + 1 as page_no, max(seq // 30 + 1) over (partition by doc_id) as total_pages from paras)"


@query("b4_paginate", with_sql(PARAS, PAGED, select="select doc_id, seq, text, cast(page_no as int) as page_no, cast(total_pages as int) as total_pages, format('page_{:03d}', page_no) as item_id, format('page_{:03d}.html', page_no) as href from paged"))
def b4(s, d):
    return paragraphs.paginate(paragraphs.paragraphs(X.documents(s, d), ["doc_id"], counted=True), ["doc_id"])


@query("b5_html_escape", f"select page_id, {escape('html')} as html from pages")
def b5(s, d):
    return X.table(s, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("html"))


def rendered(title: str, style: str, body: str) -> str:
    """A page as SQL from escaped ``title``, page_no, total_pages and ``body``."""
    look = paragraphs._LOOK + (paragraphs._TEXT | paragraphs._HTML)[style]
    return "||".join([q('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), title, q(f'</title><style>{look}</style></head>\n<body>\n<div class="page-header">'), title, q(" — "), "page_no", q(" / "), "total_pages", q("</div>\n"), body, q("</body></html>\n")])


def text_pages(title: str, style: str, paged: str = "paged", more: str = "") -> str:
    """Rendered pages of paginated paragraphs as SQL."""
    body = f"string_agg('<p>' || {escape('text')} || '</p>' || chr(10), '' order by seq)"
    return f"select doc_id, {more} page_no, total_pages, item_id, href, {rendered('t', style, 'body')} as html from (select doc_id, {more} cast(page_no as int) as page_no, cast(total_pages as int) as total_pages, format('page_{{:03d}}', page_no) as item_id, format('page_{{:03d}}.html', page_no) as href, {title} as t, {body} as body from {paged} group by all)"


DOC_TITLE = escape(q("Doc <") + " || doc_id || " + q(">"))


@query("b6_render_pages", with_sql(PARAS, PAGED, select=text_pages(DOC_TITLE, "txt")))
def b6(s, d):
    return paragraphs.render_texts(X.documents(s, d), ["doc_id"], F.concat(F.lit("Doc <"), F.col("doc_id").cast("string"), F.lit(">")))


SECTIONS = rf"""sections as (select page_id, cast(row_number() over (partition by page_id order by i) as int) as sec_no, html from (select page_id, i, case when headed and i = 1 and not regexp_matches(h, '(?i)^<h[12]') then {trim('h')} else h end as html, headed from
 (select page_id, headed, generate_subscripts(ps, 1) as i, unnest(ps) as h from (select page_id, regexp_matches(html, '(?i)<h[12]') as headed, string_split(regexp_replace(html, '(?i)(<h[12])', chr(1) || '\1', 'g'), chr(1)) as ps from pages))) where html <> '' or not headed)"""


@query("b6_render_sections", with_sql(SECTIONS, select=f"select page_id, page_no, total_pages, {rendered(escape(q('Page ') + ' || page_id'), 'md', 'html || chr(10)')} as html from (select page_id, sec_no as page_no, cast(count(*) over (partition by page_id) as int) as total_pages, html from sections)"))
def b6_sections(s, d):
    """Sections of HTML, one a page, in the style of converted Markdown."""
    from pyspark.sql import Window

    own = paragraphs.split_sections(X.table(s, d, "pages"), ["page_id"])
    own = own.select("page_id", F.col("sec_no").alias("page_no"), F.count("*").over(Window.partitionBy("page_id")).cast("int").alias("total_pages"), F.col("sec_no").alias("seq"), F.col("html").alias("text"))
    item = F.format_string("page_%03d", "page_no")
    paged = own.withColumn("item_id", item).withColumn("href", F.concat(item, F.lit(".html")))
    return paragraphs.render_pages(paged, ["page_id"], F.concat(F.lit("Page "), F.col("page_id").cast("string")), "md").select("page_id", "page_no", "total_pages", "html")


@query("b7_split_sections", with_sql(SECTIONS, select="select * from sections"))
def b7(s, d):
    return paragraphs.split_sections(X.table(s, d, "pages"), ["page_id"])


FF = f"ffp as (select doc_id, cast(generate_subscripts(string_split(text, chr(12)), 1) as int) as src_page, unnest(string_split(text, chr(12))) as text from ff_pages), fft as (select *, max(case when {trim('text')} <> '' then src_page end) over (partition by doc_id) as total from ffp), ff as (select doc_id, src_page, total, cast(row_number() over (partition by doc_id order by src_page) as int) as page_no, text from fft where {trim('text')} <> '')"


@query("b8_split_formfeed", with_sql(X.LINES, X.FF_PAGES, FF, select="select * from ff"))
def b8(s, d):
    return paragraphs.split_formfeed(X.ff_pages(s, d), ["doc_id"])


BLOCKS = rf"""raw as (select doc_id, generate_subscripts(bs, 1) as b, unnest(bs) as raw from (select doc_id, string_split(text, chr(10) || chr(10)) as bs from layout_text)),
 bl as (select doc_id, b, list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(x, '[ \t\r]+$', '')), lambda x: x <> '') as ls from raw),
 blocks as (select doc_id, cast(row_number() over (partition by doc_id order by b) as int) as block_no, array_to_string(list_transform(ls, lambda x: {trim('x')}), ' ') as text, cast(strlen(regexp_extract(ls[1], '^[ \t]*')) as int) as indent from bl where len(ls) > 0)"""


@query("b9_layout_blocks", with_sql(X.LINES, X.LAYOUT_TEXT, BLOCKS, select="select * from blocks"))
def b9(s, d):
    return paragraphs.layout_blocks(X.layout_text(s, d), ["doc_id"])


W = word_list("text")
GARBAGE = f"(len({W}) >= 4 and list_sum(list_transform({W}, lambda w: strlen(w))) / len({W}) < 3.0)"
CLASS = f"case when len({W}) = 0 then 'p' when ((upper(text) = text and regexp_matches(text, '[A-Z]')) or indent > 8) and len({W}) <= 8 then 'h2' when indent > 8 and len({W}) <= 14 then 'h3' else 'p' end"


@query("b10_classify_block", with_sql(X.LINES, X.LAYOUT_TEXT, BLOCKS, select=f"select doc_id, block_no, {CLASS} as tag from blocks"))
def b10(s, d):
    return paragraphs.layout_blocks(X.layout_text(s, d), ["doc_id"]).select("doc_id", "block_no", T.classify_block(F.col("text"), F.col("indent")).alias("tag"))


@query("b11_garbage_lines", with_sql(X.LINES, select=f"select doc_id, p, text from (select doc_id, p, line as text from lines_of) where {GARBAGE}"))
def b11(s, d):
    return X.lines_of(s, d).where(T.is_garbage(F.col("line"))).select("doc_id", "p", F.col("line").alias("text"))


GEOMETRY = """gaps as (select *, abs(y - lag(y) over (partition by doc_id order by row_no)) as gap from layout_rows),
 med as (select doc_id, list_sort(list(gap) filter (gap > 0)) as gs, list_sort(list(first_x)) as xs from gaps group by doc_id),
 cut as (select g.*, coalesce(gs[len(gs) // 2 + 1], 12.0) as median, xs[len(xs) // 4 + 1] as margin from gaps g join med using (doc_id)),
 isl as (select *, sum(case when gap > median * 1.5 or (gap is not null and first_x > margin + 8) then 1 else 0 end) over (partition by doc_id order by row_no) as para_no from cut),
 geo as (select doc_id, cast(para_no as int) as para_no, string_agg(text, ' ' order by row_no) as text from isl group by doc_id, para_no)"""


@query("b12_rows_to_paragraphs", with_sql(X.LINES, X.LAYOUT_ROWS, GEOMETRY, select="select * from geo"))
def b12(s, d):
    return paragraphs.rows_to_paragraphs(X.layout_rows(s, d), ["doc_id"])


@query("b12_spread_layouts", with_sql(X.LINES, X.LAYOUT_ROWS, GEOMETRY, select="select * from geo"))
def b12_spread(s, d):
    """The same with pages of over three rows dealt to many tasks."""
    return paragraphs.rows_to_paragraphs(X.layout_rows(s, d), ["doc_id"], page_rows=3)


@query("b13_words_to_rows", with_sql(X.LINES, X.LAYOUT_ROWS, select="select doc_id, row_no, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: " + trim("w") + "), lambda w: w <> ''), ' ') as text, y, first_x from layout_rows where " + trim("text") + " <> ''"))
def b13(s, d):
    rows = X.layout_rows(s, d)
    ws = rows.select("doc_id", "row_no", "y", "first_x", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    return paragraphs.words_to_rows(ws.withColumn("x", F.col("first_x") + 5 * F.col("word_no")), ["doc_id", ]).select("doc_id", "row_no", "text", "y", "first_x")


@query("b14_cap_page", with_sql(X.LINES, X.LAYOUT_ROWS, GEOMETRY, select="select doc_id, para_no, text from (select *, coalesce(sum(strlen(text) + 1) over (partition by doc_id order by para_no rows between unbounded preceding and 1 preceding), 0) as before from geo) where before <= 1500"))
def b14(s, d):
    return paragraphs.cap_page(paragraphs.rows_to_paragraphs(X.layout_rows(s, d), ["doc_id"]), ["doc_id"], 1500)


PARTS = r"string_split(regexp_replace(file_name, '\.[^.]*$', ''), '_')"
NUM = "case when regexp_full_match(x, '[+-]?[0-9]{1,9}') then cast(x as int) between 1 and 10 else false end"


@query("b15_image_page_no", with_sql(X.SOURCE_BOOKS, X.IMAGES, select=f"select file_name, coalesce(cast(list_filter(list_slice(p, 2, len(p) - 1), lambda x: {NUM})[1] as int), case when len(p) >= 2 then cast(list_filter(list_slice(p, len(p), len(p)), lambda x: {NUM})[1] as int) end, 0) as page_no from (select file_name, {PARTS} as p from images)"))
def b15(s, d):
    return X.images(s, d).select("file_name", T.image_page_no(F.col("file_name"), F.lit(10)).alias("page_no"))


IMG_PAGES = "ip as (select book_id, spine_pos as src_page, cast(count(*) over (partition by book_id) as int) as total, case when spine_pos % 2 = 0 then '' else text end as text from source_books), im as (select book_id, cast(string_split(file_name, '_')[2] as int) as src_page, list_sort(list(file_name)) as images from images group by all), att as (select ip.*, coalesce(images, []) as images from ip left join im using (book_id, src_page))"


def attached(s, d):
    from pyspark.sql import Window

    b = X.source_books(s, d).withColumn("total", F.count("*").over(Window.partitionBy("book_id")).cast("int"))
    pages = b.select("book_id", F.col("spine_pos").alias("src_page"), "total", F.when(F.col("spine_pos") % 2 == 0, "").otherwise(F.col("text")).alias("text"))
    return paragraphs.attach_images(pages, X.images(s, d), ["book_id"])


KEPT = f"len({word_list('text')}) > 0 or len(images) > 0"


@query("b16_attach_images", with_sql(X.SOURCE_BOOKS, X.IMAGES, IMG_PAGES, select=f"select book_id, src_page, total, text, array_to_string(images, ',') as images from att where {KEPT}"))
def b16(s, d):
    return attached(s, d).withColumn("images", F.array_join("images", ","))


def manifest_of(s, d):
    """Every fifth chapter is listed twice, every third is in a folder, some items have other types or XHTML names."""
    b = X.source_books(s, d)
    kind = F.element_at(F.array(*map(F.lit, ["application/xhtml+xml", "text/html", "text/css", ""])), (F.col("spine_pos") % 4 + 1).cast("int"))
    first = b.select("book_id", (F.col("spine_pos") * 2).alias("pos"), F.format_string("ch%d", "spine_pos").alias("item_id"), F.concat(F.when(F.col("spine_pos") % 3 == 0, "text/").otherwise(""), F.when(F.col("spine_pos") % 4 == 0, F.regexp_replace("href", "html$", "XHTML")).when(F.col("spine_pos") == 5, "index.html").otherwise(F.col("href"))).alias("href"), kind.alias("media_type"))
    again = first.where("pos % 10 = 0").select("book_id", (F.col("pos") + 1).alias("pos"), "item_id", F.concat("href", F.lit(".again")).alias("href"), "media_type")
    return first.unionByName(again)


def spine_of(s, d):
    b = X.source_books(s, d)
    return b.select("book_id", "spine_pos", F.when(F.col("spine_pos") % 7 == 0, "missing").otherwise(F.format_string("ch%d", "spine_pos")).alias("idref"))


MANIFEST = """m1 as (select book_id, spine_pos * 2 as pos, 'ch' || spine_pos as item_id, case when spine_pos % 3 = 0 then 'text/' else '' end || case when spine_pos % 4 = 0 then regexp_replace(href, 'html$', 'XHTML') when spine_pos = 5 then 'index.html' else href end as href, (['application/xhtml+xml', 'text/html', 'text/css', ''])[spine_pos % 4 + 1] as media_type from source_books),
 manifest as (select * from m1 union all select book_id, pos + 1, item_id, href || '.again', media_type from m1 where pos % 10 = 0), spine as (select book_id, spine_pos, case when spine_pos % 7 = 0 then 'missing' else 'ch' || spine_pos end as idref from source_books)"""
SPINE_HREFS = "hrefs as (select s.book_id, s.spine_pos, m.href, m.media_type from spine s join (select *, row_number() over (partition by book_id, item_id order by pos desc) as n from manifest) m on m.book_id = s.book_id and m.item_id = s.idref and m.n = 1)"


@query("c1_c2_parse_package", with_sql(X.SOURCE_BOOKS, MANIFEST, select="select book_id, pos // 2 as pos, item_id, href, case when pos % 3 = 0 then '' else media_type end as media_type, 'Title of ' || book_id as title, 'OEBPS' as base_path from manifest where pos % 2 = 0"))
def c1(s, d):
    """A package for each source, with all of its chapters; every third item lacks its media type."""
    first = manifest_of(s, d).where("pos % 2 = 0")
    item = F.concat(F.lit('<item id="'), "item_id", F.lit('" href="'), "href", F.lit('"'), F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit(' media-type="'), "media_type", F.lit('"'))), F.lit("/>"))
    xml = first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))).alias("xs"))
    head = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Title of '), "book_id", F.lit("</dc:title></metadata><manifest>"))
    package = xml.select("book_id", F.concat(head, F.array_join("xs.x", ""), F.lit("</manifest><spine/></package>")).alias("xml"))
    container = xml.select("book_id", F.lit('<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="a.txt" media-type="text/plain"/><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>').alias("xml"))
    found, manifest, _ = books.parse_opf(package.join(books.opf_path(container), "book_id"))
    return manifest.join(found, "book_id").withColumn("pos", F.col("pos") + 1)


@query("c3_spine_hrefs", with_sql(X.SOURCE_BOOKS, MANIFEST, SPINE_HREFS, select="select * from hrefs"))
def c3(s, d):
    return books.spine_hrefs(spine_of(s, d), manifest_of(s, d))


@query("c4_content_files", with_sql(X.SOURCE_BOOKS, MANIFEST, select="select *, false as allow_blank from manifest where media_type in ('application/xhtml+xml', 'text/html') union all select *, true from manifest where media_type in ('application/xhtml+xml', 'text/html', '')"))
def c4(s, d):
    m = manifest_of(s, d)
    return books.content_files(m).withColumn("allow_blank", F.lit(False)).unionByName(books.content_files(m, True).withColumn("allow_blank", F.lit(True)))


ENTRY_NAMES = ["../../../etc/evil.txt", "OEBPS/ch.xhtml", "OEBPS/../ch.xhtml", "OEBPS/../../ch.xhtml", "/abs.txt", "a\\..\\..\\b", "./a/./b"]


@query("c5_safe_entries", "with e as (select doc_id, ([" + ", ".join(f"'{x}'" for x in ENTRY_NAMES) + "])[doc_id % 7 + 1] as entry, text from documents), st as (select *, list_transform(list_filter(string_split(replace(entry, '\\', '/'), '/'), lambda p: p not in ('', '.')), lambda p: case when p = '..' then -1 else 1 end) as steps from e) select doc_id, entry, cast(least(strlen(text), 1000) as int) as size from st where not regexp_matches(entry, '^([/\\\\]|[A-Za-z]:)') and coalesce(list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(list_slice(steps, 1, i)))), 0) >= 0")
def c5(s, d):
    names = F.element_at(F.array(*map(F.lit, ENTRY_NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    e = X.documents(s, d).select("doc_id", names.alias("entry"), F.col("text").cast("binary").alias("content"))
    return books.safe_entries(e, most=1000).select("doc_id", "entry", F.octet_length("content").alias("size"))


def linked_pages(s, d):
    """A page for each chapter, at the chapter's place: it links to the chapters before and after it, as seen from its folder, with
    and without quotes, and to a sheet; it speaks of names that are no links."""
    from pyspark.sql import Window

    first = manifest_of(s, d).where("pos % 2 = 0")
    line = Window.partitionBy("book_id").orderBy("pos")
    near = first.withColumns({"p": F.lag("href").over(line), "n": F.lead("href").over(line), "spine_pos": F.expr("cast(pos div 2 as int)")})
    seen = lambda to: F.concat(F.when(F.col("spine_pos") % 4 == 1, "./").otherwise(""), T.relative_path(T.folder(F.col("href")), F.col(to)))
    back = F.coalesce(F.concat(F.lit('<a title="href=" href="'), seen("p"), F.lit('#top">back</a>')), F.lit(""))
    on = F.coalesce(F.concat(F.lit("<a href="), seen("n"), F.lit("#top class=n>on</a>")), F.lit(""))
    return near.select("book_id", "spine_pos", "href", F.concat(back, F.lit("<link href='a.css'>page_004.XHTML href=\"index.html\""), on).alias("html"))


def links_sql(renamed: str, to: str) -> str:
    """Pages whose two links are replaced where the manifest has a renamed item of that name."""
    seen = lambda x: f"case when starts_with(href, 'text/') then case when starts_with({x}, 'text/') then substring({x}, 6) else '../' || {x} end else {x} end"
    dot = "case when spine_pos % 4 = 1 then './' else '' end"
    new = lambda x, mark: f"case when (book_id, {x}) in (select (book_id, href) from manifest where {renamed}) then '{mark}' || {seen(to.format(x))} || '#top{mark}' else '{mark if mark and x == 'p' else ''}' || {dot} || {seen(x)} || '#top{mark if mark and x == 'p' else ''}' end"
    html = f"""coalesce('<a title="href=" href=' || {new('p', '"')} || '>back</a>', '') || '<link href=''a.css''>page_004.XHTML href="index.html"' || coalesce('<a href=' || {new('n', '"')} || ' class=n>on</a>', '')"""
    return f"select book_id, spine_pos, {html} as html from (select book_id, href, cast(pos // 2 as int) as spine_pos, lag(href) over w as p, lead(href) over w as n from m1 window w as (partition by book_id order by pos))"


XH = "(regexp_matches(href, '(?i)\\.xhtml?$') and media_type in ('application/xhtml+xml', 'text/html'))"


@query("c6_normalize_hrefs", with_sql(X.SOURCE_BOOKS, MANIFEST, select=f"select book_id, pos, item_id, case when {XH} then regexp_replace(href, '(?i)\\.xhtml?$', '.html') else href end as href, case when {XH} then 'text/html' else media_type end as media_type from manifest"))
def c6(s, d):
    return books.normalize_hrefs(manifest_of(s, d), linked_pages(s, d))[0]


@query("c6_rewrite_links", with_sql(X.SOURCE_BOOKS, MANIFEST, select=links_sql(XH, "regexp_replace({}, '(?i)\\.xhtml?$', '.html')")))
def c6_pages(s, d):
    return books.normalize_hrefs(manifest_of(s, d), linked_pages(s, d))[1].select("book_id", "spine_pos", "html")


@query("c7_rename_reserved", with_sql(X.SOURCE_BOOKS, MANIFEST, select=links_sql("href = 'index.html' and media_type in ('application/xhtml+xml', 'text/html', '')", "'_content_' || {}")))
def c7(s, d):
    return books.rename_reserved(manifest_of(s, d).withColumn("base_path", F.lit("")), linked_pages(s, d))[1].select("book_id", "spine_pos", "html")


@query("c8_full_href", with_sql(X.SOURCE_BOOKS, select="select book_id, spine_pos, case when spine_pos % 3 = 0 then 'OEBPS/' || href else href end as href from source_books"))
def c8(s, d):
    base = F.element_at(F.array(F.lit("OEBPS"), F.lit(""), F.lit(".")), (F.col("spine_pos") % 3 + 1).cast("int"))
    return X.source_books(s, d).select("book_id", "spine_pos", T.full_href(base, F.col("href")).alias("href"))


@query("f1_nav", with_sql(X.SOURCE_BOOKS, select="select book_id, spine_pos, 'OEBPS/' || href as href, lag(href) over w as prev_href, lead(href) over w as next_href, '../index.html' as index_href, cast(row_number() over w as int) as current, cast(count(*) over (partition by book_id) as int) as total from source_books window w as (partition by book_id order by spine_pos)"))
def f1(s, d):
    return site.nav(X.source_books(s, d).withColumn("base_path", F.lit("OEBPS")))


FROM = ["OEBPS/text", "OEBPS", "", ".", "a/b/c", "OEBPS/styles"]
REL = "case when f in ('', '.') then t when f = 'OEBPS/text' then h when f = 'OEBPS' then 'text/' || h when f = 'a/b/c' then '../../../OEBPS/text/' || h else '../text/' || h end"


@query("f2_relative_path", with_sql(X.SOURCE_BOOKS, select=f"select book_id, spine_pos, {REL} as link from (select book_id, spine_pos, ([" + ", ".join(f"'{x}'" for x in FROM) + "])[spine_pos % 6 + 1] as f, 'OEBPS/text/' || href as t, href as h from source_books)"))
def f2(s, d):
    start = F.element_at(F.array(*map(F.lit, FROM)), (F.col("spine_pos") % 6 + 1).cast("int"))
    return X.source_books(s, d).select("book_id", "spine_pos", T.relative_path(start, F.concat(F.lit("OEBPS/text/"), "href")).alias("link"))


@query("f5_chapter_label", with_sql(X.SOURCE_BOOKS, select="select book_id, spine_pos, case when spine_pos % 9 = 0 then 'Chapter ' || spine_pos else spine_pos || '. ch ' || spine_pos || ' intro' end as label from source_books"))
def f5(s, d):
    href = F.when(F.col("spine_pos") % 9 == 0, "x/.html").otherwise(F.format_string("x/ch_%d-intro.xhtml", "spine_pos"))
    return X.source_books(s, d).select("book_id", "spine_pos", T.chapter_label(href, F.col("spine_pos")).alias("label"))


@query("e14_is_echo", f"select doc_id, case when {trim('t')} = '' then true when strlen({trim('text')}) < 10 then false else lower({trim('t')}) = lower({trim('text')}) end as echo from (select doc_id, text, case doc_id % 4 when 0 then translate(text, 'abcdefgh', 'ABCDEFGH') || '  ' when 1 then '' when 2 then 'T:' || text else substring(text, 1, 5) end as t from documents)")
def e14(s, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.translate("text", "abcdefgh", "ABCDEFGH"), F.lit("  "))).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("T:"), "text")).otherwise(F.substring("text", 1, 5))
    return X.documents(s, d).select("doc_id", T.is_echo(t, F.col("text")).alias("echo"))


@query("e16_language_name", "select doc_id, case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in T.LANGUAGES.items()) + " else lang end as language from documents")
def e16(s, d):
    return X.documents(s, d).select("doc_id", T.language_name(F.col("lang")).alias("language"))


@query("e19_metrics_format", "select doc_id, format('{:,}', length(text) * 1000) as chars, case when doc_id < 60 then doc_id || 's' else doc_id // 60 || 'm' || doc_id % 60 || 's' end as eta from documents")
def e19(s, d):
    return X.documents(s, d).select("doc_id", T.thousands(F.length("text") * 1000).alias("chars"), T.duration(F.col("doc_id").cast("double")).alias("eta"))


@query("g1_paragraph_report", with_sql(PARAS, PAGED, select="select doc_id, count(*) as paragraphs, cast(max(page_no) as int) as pages from paged group by doc_id"))
def g1(s, d):
    return report.paragraph_report(b4(s, d), ["doc_id"])


@query("g2_page_report", with_sql(X.LINES, X.FF_PAGES, select="select doc_id, count(*) as pages, count(*) filter (trim(t) <> '') as with_text from (select doc_id, unnest(string_split(text, chr(12))) as t from ff_pages) group by doc_id"))
def g2(s, d):
    return report.page_report(X.ff_pages(s, d).select("doc_id", F.explode(F.split("text", "\f")).alias("text")), ["doc_id"])


@query("g3_image_report", with_sql(X.SOURCE_BOOKS, X.IMAGES, IMG_PAGES, select=f"select book_id, cast(sum(len(images)) as bigint) as images, count(*) filter (len(images) > 0) as pages_with_images from att where {KEPT} group by book_id"))
def g3(s, d):
    return report.image_report(attached(s, d), ["book_id"])


@query("g5_chapter_report", with_sql(X.SOURCE_BOOKS, MANIFEST, SPINE_HREFS, select="select book_id, count(*) as chapters from hrefs group by book_id"))
def g5(s, d):
    return report.chapter_report(c3(s, d), ["book_id"])


XML = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LINES_OF = {
    "fb2": f"list_transform(string_split(text, chr(10)), lambda l: {trim(f"regexp_replace(l, '{X.SP}+', ' ', 'g')")})",
    "rtf": f"list_transform(string_split(text, chr(10)), lambda l: {trim(r"regexp_replace(l, '[^ -\[\]-z|]', '', 'g')")})",
    "txt": para_list("text"),
}


def kind_pages(kind: int, fmt: str, title: str) -> str:
    """Pages of one kind of text files as SQL."""
    paras = f"select doc_id, path, cast(generate_subscripts(ps, 1) - 1 as int) as seq, unnest(ps) as text from (select doc_id, path, list_filter({LINES_OF[fmt]}, lambda p: p <> '') as ps from files where kind = {kind})"
    paged = f"(select *, seq // 30 + 1 as page_no, max(seq // 30 + 1) over (partition by doc_id) as total_pages from ({paras}))"
    return f"select path, page_no, item_id, href, html from ({text_pages(title, fmt, paged, 'path, ')})"


FOLDER = lambda n: f"case when {n} % 2 = 0 then 'parts' else 'more' end"
CHAPTERS = f"""select path, len(ls) - n + 2 as page_no, 'c' || n as item_id, {FOLDER('n')} || '/ch' || n || '.html' as href, '<html><body><p>' || {XML('ls[n]')} || '</p>' || case when n > 1 then '<a href="../' || {FOLDER('(n - 1)')} || '/ch' || (n - 1) || '.html#end">back</a>' else '' end || '</body></html>' as html
 from (select path, ls, unnest(range(1, len(ls) + 1)) as n from (select path, string_split(text, chr(10)) as ls from files where kind = 0))"""
FILE_PAGES = " union all ".join(
    [
        kind_pages(3, "txt", "'b' || doc_id"),
        kind_pages(1, "fb2", "'Tale ' || doc_id"),
        kind_pages(2, "rtf", "'b' || doc_id"),
        f"select path, 1, 'page_001', 'page_001.html', {rendered(escape(q('Page & ') + ' || doc_id'), 'html', q('<p>') + ' || ' + XML('text') + ' || ' + q('</p>') + ' || chr(10)')} from (select *, 1 as page_no, 1 as total_pages from files where kind = 4)",
        CHAPTERS,
    ]
)


@query("a2_ingest_pages", with_sql(X.FILES, select=FILE_PAGES))
def a2(s, d):
    """Pages of files of every format that is read."""
    from bindery.sources.ingest import ingest

    tables = ingest(X.files(s, d))
    return tables["pages"].join(tables["books"].select("book_id", "path"), "book_id").select("path", "page_no", "item_id", "href", "html")


@query("a2_ingest_books", with_sql(X.FILES, select="select path, (['epub', 'fb2', 'rtf', 'txt', 'html'])[kind + 1] as fmt, (['Archive ', 'Tale ', 'b', 'b', 'Page & '])[kind + 1] || doc_id as title, case when kind = 0 then 'book' else '' end as base_path, false as truncated from files where kind < 5"))
def a2_books(s, d):
    from bindery.sources.ingest import ingest

    return ingest(X.files(s, d))["books"].drop("book_id")


@query("a2_ingest_rejects", with_sql(X.FILES, select="select path, (['no_decoder', 'BadZipFile', 'empty'])[kind - 4] as reason from files where kind > 4"))
def a2_rejects(s, d):
    """Files of a format without a decoder, broken archives, and files without text."""
    from bindery.sources.ingest import ingest

    return ingest(X.files(s, d))["rejects"].select("path", F.substring_index("reason", ":", 1).alias("reason"))
