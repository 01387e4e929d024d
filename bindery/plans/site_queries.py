"""Registered queries over pages: tokens, splitting, segments, translation, navigation; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators import pack, report, site, tokens, translate
from bindery.plans import fixtures as X
from bindery.plans.fixtures import escape, norm, trim, with_sql
from bindery.functions import markup
from bindery.functions.text import html_title
from bindery.plans.queries import ATTRIBUTES, BODY, BODY_TAG, PAGE_TITLE, PARAS, decode_sql, q, query


RAW = [rf"<{t}(?:[ \t\n\f\r/]{ATTRIBUTES})?(?:\z|>(?:.*?</{t}(?:[ \t\n\f\r/]{ATTRIBUTES})?(?:>|\z)|.*))" for t in ("script", "style")]
#: All of a page as tokens: comments, raw elements, tags, text; and a ``<`` that opens nothing and has no other text around it.
TOKEN = "(?is)" + "|".join([r"<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*(?:>|\z)|</(?:>|[^a-z>][^>]*(?:>|\z))", *RAW, rf"</?[a-z][^ \t\n\f\r/>]*{ATTRIBUTES}(?:>|\z)", r"(?:[^<]+|<+(?:[^a-z/!?<]|\z))+|<"])
KIND = f"case when regexp_matches(raw, '^<[!?]|^</[^A-Za-z]') then 'comment' when tag <> '' and starts_with(raw, '</') then 'close' when tag in ('script', 'style') then 'raw' when tag in {tuple(sorted(markup.VOID))} or (tag <> '' and ends_with(raw, '/>')) then 'void' when tag <> '' then 'open' else 'text' end"


def among(tags) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted(tags)) + ")"


def ended(st: str, wanted, border, stay: int = 0) -> str:
    """The stack ``st`` without its innermost of ``wanted`` and all inside it, unless one of ``border`` is further in."""
    at = lambda tags: f"coalesce(list_max([i for i in range(1, len({st}) + 1) if {st}[i] in {among(tags)}]), 0)" if tags else "0"
    return f"case when {at(wanted)} > 0 and {at(wanted)} >= {at(border)} then {st}[1:{at(wanted)} - {1 - stay}] else {st} end"


def token_rows(name: str, source: str) -> str:
    """Tokens ``name`` (page_id, pos, kind, tag, raw) of the pages of ``source`` (page_id, html)."""
    return f"{name} as materialized (select *, {KIND} as kind from (select *, lower(regexp_extract(raw, '^</?([A-Za-z][^ \\t\\n\\f\\r/>]*)', 1)) as tag from (select page_id, cast(generate_subscripts(rs, 1) - 1 as int) as pos, unnest(rs) as raw from (select page_id, regexp_extract_all(html, {q(TOKEN)}) as rs from {source}))))"


def walked(name: str, source: str) -> str:
    """``name`` (page_id, pos, kind, tag, raw, st): the tokens of ``source`` with the list of elements that each stands in."""
    m = markup
    start = f"""case when tag = 'li' then {ended('st', {'li'}, m.LIST)} when tag in ('dd', 'dt') then {ended('st', {'dd', 'dt'}, m.SCOPE | {'dl'})} when tag in ('option', 'optgroup') then {ended('st', {'option'}, m.SCOPE | {'select'})}
 when tag = 'a' then {ended('st', {'a'}, m.SPECIAL)} when tag in ('td', 'th') then {ended('st', m.ROWS | {'tr', 'table'}, (), 1)} when tag = 'tr' then {ended('st', m.ROWS | {'table'}, (), 1)} when tag in {among(m.ROWS | {'caption', 'colgroup'})} then {ended('st', {'table'}, (), 1)}
 when tag = 'body' then {ended('st', {'html'}, (), 1)} else st end"""
    own = lambda st: f"coalesce(list_max([i for i in range(1, len({st}) + 1) if {st}[i] = tag]), 0)"
    edge = lambda st, tags: f"coalesce(list_max([i for i in range(1, len({st}) + 1) if {st}[i] in {among(tags)}]), 0)"
    upto = lambda tags: f"case when {own('st')} > {edge('st', tags)} then st[1:{own('st')} - 1] else st end"
    mark = f"case when {own('st')} <= {edge('st', m.SCOPE)} then st when {edge('st', m.SPECIAL)} > {own('st')} then list_concat(st[1:{own('st')} - 1], st[{own('st')} + 1:]) else st[1:{own('st')} - 1] end"
    whole = f"case when {own('st')} > 0 then st[1:{own('st')} - 1] else st end"
    end = f"""case when tag in {among(m.MARK)} then {mark} when tag in {among(m.HEADING)} then {ended('st', m.HEADING, m.SCOPE)} when tag = 'li' then {upto(m.LIST)} when tag in ('table', 'body', 'html') then {whole}
 when tag in {among(m.IN_TABLE)} then {upto({'table'})} when tag in {among(m.SPECIAL)} then {upto(m.SCOPE)} else {upto(m.SPECIAL)} end"""
    return f"""{token_rows(name + '_t', source)},
 {name}_r as (select page_id, -1 as pos, '' as kind, '' as tag, '' as raw, cast([] as varchar[]) as st, cast([] as varchar[]) as nxt from (select distinct page_id from {name}_t)
 union all select page_id, pos, kind, tag, raw, st, case kind when 'open' then list_append(st, tag) when 'close' then {end} else st end from (
 select * replace (case when kind in ('open', 'void') and tag in {among(m.HEADING)} and st[-1] in {among(m.HEADING)} then st[1:len(st) - 1] else st end as st) from (
 select * replace (case when kind in ('open', 'void') and tag in {among(m.BLOCK)} then {ended('st', {'p'}, m.SCOPE | {'button'})} else st end as st) from (
 select page_id, pos, kind, tag, raw, case when kind in ('open', 'void') then {start} else st end as st from (select t.*, r.nxt as st from {name}_r r join {name}_t t on t.page_id = r.page_id and t.pos = r.pos + 1))))),
 {name} as materialized (select page_id, pos, kind, tag, raw, st from {name}_r where pos >= 0)"""


def said(x: str) -> str:
    return trim(decode_sql(x))


SEGMENTS = f"{walked('wk', 'pages')},\n segs as materialized (select book_id, page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as seq, text from (select page_id, pos, {said('raw')} as text from wk where kind = 'text' and not list_has_any(st, ['code', 'pre'])) join site_books using (page_id) where text <> '')"
TOKENS = walked("wk", "pages")


def segments(s: SparkSession, d: str) -> DataFrame:
    return tokens.extract_segments(X.site_pages(s, d), ["book_id", "page_id"])


@query("d1_html_tokens", with_sql(TOKENS, select="select page_id, pos, kind, tag, raw, cast(len(st) as int) as depth from wk"))
def d1(s, d):
    return tokens.html_tokens(X.table(s, d, "pages"), ["page_id"])


BODIES = f"bodies as (select page_id, {BODY} as html from pages)"
TEXT_LEN = f"tl as (select page_id, cast(coalesce(n, 0) as int) as text_len from pages left join (select page_id, sum(strlen({said('raw')})) as n from bt where kind = 'text' group by page_id) using (page_id))"


@query("d2_text_len", with_sql(BODIES, token_rows("bt", "bodies"), TEXT_LEN, select="select * from tl"))
def d2(s, d):
    return tokens.text_len(X.table(s, d, "pages"), ["page_id"])


BLOCKS = f"""{BODIES}, {walked('wb', 'bodies')},
 nb as (select page_id, pos, kind, raw, cast(sum(case when len(st) = 0 and (kind in ('open', 'void', 'raw') or (kind = 'text' and {said('raw')} <> '')) then 1 else 0 end) over (partition by page_id order by pos) as int) as block_no from wb),
 bb as (select page_id, block_no, string_agg(raw, '' order by pos) as html, cast(sum(case when kind = 'text' then strlen({said('raw')}) else 0 end) as int) as len from nb where block_no > 0 group by page_id, block_no)"""


@query("d3_body_blocks", with_sql(BLOCKS, select="select * from bb"))
def d3(s, d):
    return tokens.body_blocks(X.table(s, d, "pages"), ["page_id"])


@query("d1_messy_tokens", with_sql(X.MESSY_PAGES, walked("wk", "messy"), select="select page_id, pos, kind, tag, raw, cast(len(st) as int) as depth from wk"))
def d1_messy(s, d):
    """Tokens of pages whose end tags, quotes and cells are left out or in the wrong place."""
    return tokens.html_tokens(X.messy_pages(s, d), ["page_id"])


@query("d3_messy_blocks", with_sql(X.MESSY_PAGES, BLOCKS.replace("from pages)", "from messy)", 1), select="select * from bb"))
def d3_messy(s, d):
    return tokens.body_blocks(X.messy_pages(s, d), ["page_id"])


@query("e1_messy_segments", with_sql(X.MESSY_PAGES, walked("wk", "messy"), select=f"select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as seq, text from (select page_id, pos, {said('raw')} as text from wk where kind = 'text' and not list_has_any(st, ['code', 'pre'])) where text <> ''"))
def e1_messy(s, d):
    return tokens.extract_segments(X.messy_pages(s, d), ["page_id"])


def greedy(rows: str, key: str, limit: int) -> str:
    return f"gr as (select {key}, seq, size, 0 as grp, size as total from {rows} where seq = 0 union all select r.{key}, r.seq, r.size, case when g.total + r.size > {limit} then g.grp + 1 else g.grp end, case when g.total + r.size > {limit} then r.size else g.total + r.size end from gr g join {rows} r on r.{key} = g.{key} and r.seq = g.seq + 1)"


@query("d4_greedy_pack", with_sql(PARAS, "sz as (select doc_id, seq, cast(strlen(text) as int) as size from paras)", greedy("sz", "doc_id", 1000), select="select doc_id, seq, size, cast(grp as int) as group_no from gr"))
def d4(s, d):
    from bindery.operators.paragraphs import paragraphs

    sized = paragraphs(X.documents(s, d), ["doc_id"]).select("doc_id", "seq", F.octet_length("text").alias("size"))
    return pack.greedy_pack(sized, ["doc_id"], "seq", "size", 1000)


@query("d4_pack_long_keys", with_sql(PARAS, "sz as (select k, cast(row_number() over (partition by k order by place) - 1 as int) as seq, place, size from (select doc_id % 11 as k, doc_id * 100000 + seq as place, cast(strlen(text) as int) as size from paras))", greedy("sz", "k", 700), select="select k, place, gr.size, cast(grp as int) as group_no from gr join sz using (k, seq)"))
def d4_long(s, d):
    """Few keys with many items each, which lie in several ranges."""
    from bindery.operators.paragraphs import paragraphs

    sized = paragraphs(X.documents(s, d), ["doc_id"]).select((F.col("doc_id") % 11).alias("k"), (F.col("doc_id") * 100000 + F.col("seq")).alias("place"), F.octet_length("text").alias("size"))
    return pack.greedy_pack(sized, ["k"], "place", "size", 700)


SPLIT = f"""{token_rows('bt', 'bodies')}, {TEXT_LEN}, pl as (select page_id, html, text_len as n from pages join tl using (page_id)),
 sz as (select bb.page_id, cast(row_number() over (partition by bb.page_id order by block_no) - 1 as int) as seq, len as size, bb.html from bb join pl using (page_id) where n > 1500)"""
HEAD = r"regexp_extract(html, '(?is)<head\b[^>]*>.*?</head\s*>')"


@query("d5_split_pages", with_sql(BLOCKS, SPLIT, greedy("sz", "page_id", 1500), select=f"select page_id, cast(1 as int) as chunk, html from pl where n <= 1500 union all select c.page_id, c.chunk, {q('<!DOCTYPE html>' + chr(10) + '<html>' + chr(10))} || h.head || {q(chr(10) + '<body>' + chr(10))} || c.html || {q(chr(10) + '</body>' + chr(10) + '</html>' + chr(10))} from (select page_id, cast(grp + 1 as int) as chunk, string_agg(html, '' order by seq) as html from gr join sz using (page_id, seq) group by page_id, grp) c join (select page_id, {HEAD} as head from pl) h on h.page_id = c.page_id"))
def d5(s, d):
    return pack.split_pages(X.table(s, d, "pages"), ["page_id"], 1500)


def chunked(s, d):
    """Manifest, spine and parts: every chapter in one to three parts, a style sheet outside of the spine."""
    b = X.source_books(s, d)
    items = b.select("book_id", F.col("spine_pos").alias("pos"), F.format_string("ch%d", "spine_pos").alias("item_id"), "href", F.lit("text/html").alias("media_type"))
    css = b.select("book_id").distinct().select("book_id", F.lit(0).alias("pos"), F.lit("css").alias("item_id"), F.lit("a.css").alias("href"), F.lit("text/css").alias("media_type"))
    spine = items.select("book_id", F.col("pos").alias("spine_pos"), F.col("item_id").alias("idref"))
    parts = b.select("book_id", F.format_string("ch%d", "spine_pos").alias("item_id"), F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("chunk"))
    return items.unionByName(css), spine, parts


CHUNKS = "ck as (select book_id, spine_pos, href, unnest(range(1, doc_id % 3 + 2)) as chunk from source_books), pt as (select book_id, spine_pos, chunk, 'ch' || spine_pos || case when chunk > 1 then '_s' || chunk else '' end as item_id, case when chunk > 1 then regexp_replace(href, '\\.[^./]*$', '') || '_s' || chunk || '.html' else href end as href from ck)"


@query("d6_rebuild_manifest", with_sql(X.SOURCE_BOOKS, CHUNKS, select="select book_id, cast(1 + row_number() over (partition by book_id order by spine_pos, chunk) as int) as pos, item_id, href, 'text/html' as media_type from pt union all select distinct book_id, 1, 'css', 'a.css', 'text/css' from source_books"))
def d6(s, d):
    return pack.rebuild_manifest(*chunked(s, d))[0]


@query("d6_rebuild_spine", with_sql(X.SOURCE_BOOKS, CHUNKS, select="select book_id, cast(row_number() over (partition by book_id order by spine_pos, chunk) as int) as spine_pos, item_id as idref from pt"))
def d6_spine(s, d):
    return pack.rebuild_manifest(*chunked(s, d))[1]


@query("g4_split_report", with_sql(X.SOURCE_BOOKS, CHUNKS, select="select book_id, count(*) filter (chunk > 1) as added from pt group by book_id"))
def g4(s, d):
    return report.split_report(chunked(s, d)[2], ["book_id"])


@query("e1_extract_segments", with_sql(X.SITE_BOOKS, SEGMENTS, select="select page_id, seq, text from segs"))
def e1(s, d):
    return segments(s, d).select("page_id", "seq", "text")


@query("e2_identity", "select page_id, html from pages")
def e2(s, d):
    none = s.createDataFrame([], "text string, translated string")
    return tokens.apply_translations(X.table(s, d, "pages"), none, ["page_id"])


@query("e3_decode_entities", f"select page_id, {decode_sql('html')} as html from pages")
def e3(s, d):
    from bindery.functions.text import decode_entities

    return X.table(s, d, "pages").select("page_id", decode_entities(F.col("html")).alias("html"))


ENC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LEAD, TRAIL = (f"regexp_extract({decode_sql('raw')}, '{p}', 1)" for p in (f"^({X.SP}*)", f"({X.SP}*)$"))
TRANSLATED = f"{TOKENS},\n done as (select page_id, string_agg(case when kind = 'text' and not list_has_any(st, ['code', 'pre']) and {said('raw')} <> '' then {LEAD} || {ENC(q('T:') + ' || ' + said('raw'))} || {TRAIL} else raw end, '' order by pos) as html from wk group by page_id)"


@query("e2_apply_translations", with_sql(TRANSLATED, select="select * from done"))
def e2_all(s, d):
    pages = X.table(s, d, "pages")
    tm = tokens.extract_segments(pages, ["page_id"]).select("text").distinct().withColumn("translated", F.concat(F.lit("T:"), "text"))
    return tokens.apply_translations(pages, tm, ["page_id"])


@query("e4_char_count", with_sql(X.SITE_BOOKS, SEGMENTS, select="select book_id, cast(sum(strlen(text)) as bigint) as bytes from segs group by book_id"))
def e4(s, d):
    return translate.char_count(segments(s, d), ["book_id"])


COST = "dt as (select book_id, text, count(*) as n, strlen(text) as b from segs group by book_id, text), cs as (select book_id, cast(sum(n) as bigint) as segments, count(*) as distinct_segments, cast(sum(n * b) as bigint) as bytes, cast(sum(b) as bigint) as distinct_bytes from dt group by book_id)"
COST_SQL = with_sql(X.SITE_BOOKS, SEGMENTS, COST, select="select *, bytes / 1e6 * 20.0 as cost_usd, distinct_bytes / 1e6 * 20.0 as distinct_cost_usd, bytes > 1000 as needs_approval from cs")


@query("e5_g6_site_cost", COST_SQL)
def site_cost(s, d):
    """Per site: segments, bytes and translation cost before and after removal of repeats."""
    return translate.cost_estimate(segments(s, d), ["book_id"])


TM = "tm as (select distinct text from segs where strlen(text) % 3 = 0)"


def memory(s, d):
    """A memory that has every text whose size is a multiple of three."""
    return segments(s, d).where(F.octet_length("text") % 3 == 0).select(F.lit("en").alias("src"), F.lit("de").alias("dst"), "text").distinct().withColumn("translated", F.concat(F.lit("T:"), "text"))


@query("e6_dedup_segments", with_sql(X.SITE_BOOKS, SEGMENTS, TM, select="select distinct 'en' as src, 'de' as dst, text from segs where text not in (select text from tm)"))
def e6(s, d):
    return translate.dedup_segments(segments(s, d), memory(s, d), "en", "de")


@query("e7_tm_stats", with_sql(X.SITE_BOOKS, SEGMENTS, select="select book_id, count(*) as segments, count(distinct text) as distinct_segments, count(*) filter (strlen(text) % 3 = 0) as hits, count(*) filter (strlen(text) % 3 = 0) / count(*) as hit_rate from segs group by book_id"))
def e7(s, d):
    return translate.tm_stats(segments(s, d), memory(s, d), ["book_id"], "en", "de")


@query("e8_batch_by_bytes", with_sql(X.SITE_BOOKS, SEGMENTS, "sz as (select page_id, seq, cast(strlen(text) as int) as size from segs)", greedy("sz", "page_id", 500), select="select page_id, seq, text, cast(grp as int) as batch_no from gr join segs using (page_id, seq)"))
def e8(s, d):
    return pack.batch_by_bytes(segments(s, d).select("page_id", "seq", "text"), ["page_id"], 500)


@query("e9_batch_by_count", with_sql(X.SITE_BOOKS, SEGMENTS, select="select page_id, seq, text, cast(seq // 20 as int) as batch_no, cast(seq % 20 + 1 as int) as item_no from segs"))
def e9(s, d):
    return pack.batch_by_count(segments(s, d).select("page_id", "seq", "text"), ["page_id"])


def batches(s, d):
    return e9(s, d).withColumn("batch_no", F.concat_ws("-", "page_id", "batch_no"))


FAKE = "bt as (select page_id || '-' || seq // 20 as batch_no, page_id, seq, text from segs), fl as (select *, bool_or(contains(text, '©')) over (partition by batch_no) as bad, case when strlen(text) % 11 = 0 then text when strlen(text) % 13 = 0 then '' else 'T:' || text end as t from bt)"


BATCHED = ("sz as (select page_id, seq, cast(strlen(text) as int) as size from segs)", greedy("sz", "page_id", 500), "fl as (select *, case when bad then 'ValueError: refused' end as error from (select page_id, cast(grp as int) as batch_no, seq, text, bool_or(contains(text, '©')) over (partition by page_id, grp) as bad, case when strlen(text) % 11 = 0 then text when strlen(text) % 13 = 0 then '' else 'T:' || text end as t from gr join segs using (page_id, seq)))")


@query("e10_e18_translate", with_sql(X.SITE_BOOKS, SEGMENTS, *BATCHED, select="select page_id, batch_no, seq, text, case when bad then null else t end as translated, error from fl"))
def e10(s, d):
    """Batches by bytes, as they come, to the backend; the order of a batch's texts is the page's."""
    return translate.translate_packed(segments(s, d).select("page_id", "seq", "text"), translate.with_retry(X.fake_backend, wait=0.0), "en", "de", ["page_id"], limit=500)


@query("e12_build_prompts", with_sql(X.SITE_BOOKS, SEGMENTS, FAKE, select=f"select batch_no, cast(count(*) as int) as n, {q('Translate each line from English to German' + translate.PROMPT_RULES)} || string_agg((seq % 20 + 1) || '. ' || text || chr(10), '' order by seq) as prompt from bt group by batch_no"))
def e12(s, d):
    return translate.build_prompts(batches(s, d), ["batch_no"], "en", "de")


REPLY = f"rp as (select batch_no, cast(count(*) as int) as n, string_agg(case when i % 7 = 0 then '' else i || '. ' || t || chr(10) end || case when i % 5 = 0 then i || '. again ' || t || chr(10) else '' end, '' order by i) || '99. out of range' as reply from (select batch_no, seq % 20 + 1 as i, regexp_replace({norm('text')}, '\\s+', ' ', 'g') as t from bt) group by batch_no)"


def replies(s, d):
    t = F.regexp_replace("text", r"\s+", " ")
    i = F.col("item_no")
    line = F.concat(i.cast("string"), F.lit(". "), t, F.lit("\n"))
    twice = F.when(i % 5 == 0, F.concat(i.cast("string"), F.lit(". again "), t, F.lit("\n"))).otherwise("")
    own = batches(s, d).withColumn("line", F.concat(F.when(i % 7 == 0, "").otherwise(line), twice))
    own = own.groupBy("batch_no").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("item_no", "line"))).alias("ls"))
    return own.select("batch_no", "n", F.concat(F.array_join("ls.line", ""), F.lit("99. out of range")).alias("reply"))


@query("e13_parse_reply", with_sql(X.SITE_BOOKS, SEGMENTS, FAKE, REPLY, select=rf"select batch_no, array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(list_last(list_transform(list_filter(list_zip(ks, vs), lambda x: x[1] = cast(i as varchar)), lambda x: {trim('x[2]')})), '')), chr(10)) as texts from (select batch_no, n, regexp_extract_all(reply, '(?m)^\s*(\d+)\.\s*(.+)$', 1) as ks, regexp_extract_all(reply, '(?m)^\s*(\d+)\.\s*(.+)$', 2) as vs from rp)"))
def e13(s, d):
    return replies(s, d).select("batch_no", F.array_join(translate.parse_reply(F.col("reply"), F.col("n")), "\n").alias("texts"))


@query("e15_retry_echoes", with_sql(X.SITE_BOOKS, SEGMENTS, *BATCHED, select="select page_id, batch_no, seq, text, case when bad then null when strlen(text) % 13 = 0 or (strlen(text) % 11 = 0 and strlen(text) >= 10) then 'S:' || text else t end as translated, error, cast(case when not bad and (t = '' or (strlen(text) >= 10 and t = text)) then 1 else 0 end as int) as tries from fl"))
def e15(s, d):
    return translate.retry_echoes(e10(s, d), lambda ts, a, b: ["S:" + t for t in ts], "en", "de")


@query("e6_stream_memory", with_sql(X.SITE_BOOKS, SEGMENTS, select="select distinct 'en' as src, 'de' as dst, text, 'T:' || text as translated, cast(null as varchar) as error from segs"))
def e6_stream(s, d):
    """Segments as a stream of two files: each text is sent once, whatever file it comes in."""
    from bindery.sources.staging import scratch, staged
    from bindery.streaming.translate import memory, stream_translate

    found = staged(segments(s, d).select("text").repartition(2), "stream")
    source = found.inputFiles()[0].rpartition("/")[0]
    stream = s.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source)
    out = scratch(s)
    stream_translate(stream, X.prefix_backend, "en", "de", f"{out}/memory", f"{out}/state").awaitTermination()
    return memory(s, f"{out}/memory")


TITLES = f"tl as (select page_id, {PAGE_TITLE} as title from pages)"


@query("e17_translate_titles", with_sql(TITLES, select="select page_id, title, case when strlen(title) % 2 = 0 and title <> '' then 'T:' || title else title end as title_translated from tl"))
def e17(s, d):
    books = X.table(s, d, "pages").select("page_id", html_title(F.col("html"), F.col("url")).alias("title"))
    tm = books.where(F.octet_length("title") % 2 == 0).where("title <> ''").select(F.col("title").alias("text"), F.concat(F.lit("T:"), "title").alias("translated"))
    return translate.translate_titles(books, tm)


@query("e19_translation_metrics", with_sql(X.SITE_BOOKS, SEGMENTS, *BATCHED, "mt as (select page_id, count(*) as total, count(*) filter (not bad) as done, count(*) filter (bad) as failed, cast(coalesce(sum(strlen(text)) filter (not bad), 0) as bigint) as bytes, cast(coalesce(sum(strlen(text)) filter (bad), 0) as bigint) as open from fl group by page_id), ms as (select *, bytes / 60.0 as rate, cast(floor(open / nullif(bytes / 60.0, 0)) as bigint) as s from mt)", select="select page_id, total, done, failed, bytes, rate, case when bytes = 0 then null when s < 60 then s || 's' else s // 60 || 'm' || s % 60 || 's' end as eta from ms"))
def e19_metrics(s, d):
    """As if every page had taken a minute."""
    return translate.translation_metrics(e10(s, d), ["page_id"], F.lit(60.0))


@query("e18_page_status", with_sql(X.SITE_BOOKS, SEGMENTS, *BATCHED, "ps as (select page_id, count(*) as segments, count(*) filter (bad) as failed from fl group by page_id)", select="select *, case when failed = 0 then 'ok' when failed < segments then 'partial' else 'original' end as status from ps"))
def e18(s, d):
    """Batches of small pages fail with the refused text in them, while the same texts succeed on other pages."""
    return translate.page_status(segments(s, d).select("page_id", "seq"), e10(s, d), ["page_id"])


NAV_LINK = lambda rel, to, text: f"""coalesce(' <a rel="{rel}" href="' || {escape(to)} || '">{text}</a>', '')"""
NAVBAR = "||".join([q('<nav class="pager"><b>'), "c", q("</b> of "), "t", NAV_LINK("prev", "p", "Previous"), NAV_LINK("next", "n", "Next"), q(' <a rel="contents" href="index.html">Contents</a></nav>')])


def site_spine(s, d):
    return X.site_books(s, d).select("book_id", "spine_pos", "page_id", F.format_string("p%d.html", "page_id").alias("href"), F.lit("").alias("base_path"), "html")


@query("f3_inject_nav", with_sql(X.SITE_BOOKS, "nv as (select *, 'p' || lag(page_id) over w || '.html' as p, 'p' || lead(page_id) over w || '.html' as n, row_number() over w as c, count(*) over (partition by book_id) as t from site_books window w as (partition by book_id order by spine_pos))",
    f"hd as (select *, {NAVBAR} as bar, case when regexp_matches(html, '(?i)</head>') then regexp_extract(html, '(?is)^(.*?)</head>', 1) || '<style></style>' || substring(html, length(regexp_extract(html, '(?is)^(.*?)</head>', 1)) + 1) else html end as h from nv)",
    f"bs as (select *, length(regexp_extract(h, {q('(?is)^.*?' + BODY_TAG)})) as e from hd)",
    select="select page_id, case when e > 0 then substring(h, 1, e) || bar || substring(h, e + 1) else h end as html from bs"))
def f3(s, d):
    spine = site_spine(s, d)
    return site.inject_nav(spine, site.nav(spine), ["book_id", "spine_pos"], "<style></style>").select("page_id", "html")


def snips(pages: str) -> str:
    """Snippets of the pages of ``pages`` (book_id, spine_pos, page_id, html) as SQL; no page of the tables has a header of ours."""
    own = f"bodies as (select page_id, {BODY} as html from {pages}), {walked('wb', 'bodies')}"
    listed = f"ls as (select page_id, list(text order by pos) as ts from (select page_id, pos, {said('raw')} as text from wb where kind = 'text' and not list_has_any(st, ['head', 'nav', 'button'])) where text <> '' group by page_id)"
    text = f"sn as (select book_id, spine_pos, page_id, list_reduce(list_prepend('', coalesce(ts, [])), lambda a, t: case when strlen(a) > 300 then a when a = '' then t else a || ' ' || t end) as t from {pages} left join ls using (page_id))"
    return f"{own}, {listed}, {text}, snips as (select book_id, spine_pos, page_id, case when two <> '' then regexp_replace(two, '{X.SP}+$', '') when length(t) > 250 then regexp_replace(substring(t, 1, 250), '{X.SP}+$', '') || '…' else t end as snippet from (select *, regexp_extract(substring(t, 1, 250), '(?s)^((?:[^.!?]*[.!?]){{2}})', 1) as two from sn))"


SNIP = snips("site_books")


@query("f4_snippet", with_sql(X.SITE_BOOKS, SNIP, select="select page_id, snippet from snips"))
def f4(s, d):
    return X.table(s, d, "pages").select("page_id", site.snippet(F.col("html")).alias("snippet"))


N = chr(10)
INDEX = f"""select book_id, cast(1 as int) as part, count(*) as chapters, case when count(*) = 1 then {q('<!doctype html>' + N + '<meta charset="utf-8"><meta http-equiv="refresh" content="0; url=')} || 'p' || min(page_id) || {q('.html">' + N + '<a href="')} || 'p' || min(page_id) || {q('.html">1</a>' + N)}
 else {q('<!doctype html>' + N + '<html><head><meta charset="utf-8"><title>')} || book_id || {q('</title></head>' + N + '<body>' + N + '<main class="contents">' + N + '<h2>')} || book_id || {q('</h2>' + N + '<p>')} || count(*) || {q(' chapters</p>' + N)}
 || string_agg('<p><a href="p' || page_id || '.html">' || case when snippet <> '' then spine_pos || '. ' || {escape('snippet')} else spine_pos || '. p' || page_id end || '</a></p>' || chr(10), '' order by spine_pos) || {q('</main>' + N + '</body></html>' + N)} end as html from snips group by book_id"""


def parted(entries: int) -> str:
    """``INDEX`` in parts of at most ``entries`` chapters, each linked to the one before and after it."""
    sql = INDEX.replace("select book_id, cast(1 as int) as part, count(*) as chapters", "select book_id, part, any_value(total) as chapters").replace("count(*)", "any_value(total)").replace(f"{q('</main>' + N + '</body></html>' + N)}", f"case when part > 1 then {q('<a rel="prev" href="')} || case when part = 2 then 'index.html' else 'index_' || (part - 1) || '.html' end || {q('">prev</a>')} else '' end || case when part * {entries} < any_value(total) then {q('<a rel="next" href="index_')} || (part + 1) || {q('.html">next</a>')} else '' end || {q('</main>' + N + '</body></html>' + N)}")
    return sql.replace("from snips group by book_id", f"from (select *, cast((spine_pos - 1) // {entries} + 1 as int) as part, count(*) over (partition by book_id) as total from snips) group by book_id, part")


@query("f6_f7_build_index", with_sql(X.SITE_BOOKS, SNIP, select=parted(site.PART_ENTRIES)))
def f6(s, d):
    spine = site_spine(s, d).withColumn("snippet", site.snippet(F.col("html")))
    return site.build_index(spine.drop("html"), spine.select("book_id", F.col("book_id").alias("title")).distinct())


@query("f6_contents_in_parts", with_sql(X.SITE_BOOKS, SNIP, select=parted(3)))
def f6_parts(s, d):
    """Contents of three chapters a page, each page linked to the one before and after it."""
    spine = site_spine(s, d).withColumn("snippet", site.snippet(F.col("html")))
    return site.build_index(spine.drop("html"), spine.select("book_id", F.col("book_id").alias("title")).distinct(), entries=3)


@query("f8_index_after_translation", with_sql(X.SITE_BOOKS, TRANSLATED, "translated as (select s.* replace (d.html as html) from site_books s join done d using (page_id))", snips("translated"), select=parted(site.PART_ENTRIES)))
def f8(s, d):
    """Contents pages whose snippets are translated: texts are put back before snippets are taken."""
    pages = X.site_books(s, d)
    tm = tokens.extract_segments(pages, ["page_id"]).select("text").distinct().withColumn("translated", F.concat(F.lit("T:"), "text"))
    done = tokens.apply_translations(pages, tm, ["book_id", "spine_pos", "page_id"])
    spine = done.select("book_id", "spine_pos", F.format_string("p%d.html", "page_id").alias("href"), F.lit("").alias("base_path"), site.snippet(F.col("html")).alias("snippet"))
    return site.build_index(spine, spine.select("book_id", F.col("book_id").alias("title")).distinct())
