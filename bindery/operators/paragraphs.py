"""Texts to paragraphs, paragraphs to pages, extracted layouts to blocks. Every function is DataFrame to DataFrame.

``key`` names the columns of one book or page. Ordered things carry an explicit position. All of it is Spark expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from bindery.functions.text import classify_block, html_escape, image_page_no, is_garbage, normalize_lines, utrim, words
from bindery.operators.pack import starts
from bindery.operators.ranks import numbered
from bindery.sources.staging import staged

PAGE_PARAGRAPHS = 30
PAGE_BYTES = 10 << 20


def paragraph_array(text: Column, mode: str = "adaptive") -> Column:
    """Paragraphs of a text: by blank lines if it has one (or ``mode`` is blank), else one per non-blank line."""
    return _split_paragraphs(normalize_lines(text), mode)


def _split_paragraphs(text: Column, mode: str) -> Column:
    lines = F.transform(F.split(text, "\n"), utrim)
    blank = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda b: F.replace(F.regexp_replace(b, "^\n+|\n+$", ""), F.lit("\n"), F.lit(" ")))
    plain = blank if mode == "blank" else F.when(F.contains(text, F.lit("\n\n")), blank).otherwise(lines)
    return F.filter(plain, lambda p: p != "")


def paragraphs(df: DataFrame, key: list[str], text: str = "text", mode: str = "adaptive", counted: bool = False) -> DataFrame:
    """(key, seq from 0, text) per paragraph; with ``counted`` also n_paragraphs of its text."""
    split = df.select(*key, normalize_lines(F.col(text)).alias("__text")).select(*key, _split_paragraphs(F.col("__text"), mode).alias("__ps"))
    return split.select(*key, *[F.size("__ps").alias("n_paragraphs")] * counted, F.posexplode("__ps").alias("seq", "text"))


def paginate(paras: DataFrame, key: list[str], n: int = PAGE_PARAGRAPHS) -> DataFrame:
    """Adds page_no, total_pages, item_id and href: ``n`` paragraphs a page.

    Counted paragraphs need no shuffle; of others the last one is looked for in a window over the key.
    """
    if "n_paragraphs" in paras.columns:
        count, out = F.col("n_paragraphs"), paras
    else:
        count, out = F.col("__n"), paras.withColumn("__n", F.max("seq").over(Window.partitionBy(*key)) + 1)
    item = F.format_string("page_%03d", "page_no")
    out = out.withColumns({"page_no": (F.floor(F.col("seq") / n) + 1).cast("int"), "total_pages": F.ceil(count / n).cast("int")})
    return out.withColumn("item_id", item).withColumn("href", F.concat(item, F.lit(".html"))).drop("__n", "n_paragraphs")


#: Styles whose paragraphs are text, and what their paragraphs look like; those whose paragraphs are HTML already.
_TEXT = {"txt": "p{text-indent:1.2rem;margin:.6rem 0}", "fb2": "p{text-indent:1.2rem;margin:.3rem 0}", "rtf": "p{margin:.6rem 0}"}
_HTML = {"md": "pre,code{background:#f4f4f4}", "html": "img{max-width:100%}"}
_LOOK = "body{font:1.05rem/1.5 serif;max-width:48rem;margin:1rem auto;padding:0 1rem}.page-header{font-size:.85rem;opacity:.7}"


def page_html(title: Column, page_no: Column, total: Column, paras: Column, style: str = "txt") -> Column:
    """A whole page with ``title — n / total`` above its paragraphs; those of styles ``md`` and ``html`` are markup."""
    name, n = html_escape(title), page_no.cast("string")
    if style in _TEXT:
        body = F.array_join(F.transform(paras, lambda p: F.concat(F.lit("<p>"), html_escape(p), F.lit("</p>\n"))), "")
    else:
        body = F.array_join(F.transform(paras, lambda p: F.concat(p, F.lit("\n"))), "")
    return F.concat(
        F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit(f"</title><style>{_LOOK}{(_TEXT | _HTML)[style]}</style></head>\n<body>\n" + '<div class="page-header">'),
        name, F.lit(" — "), n, F.lit(" / "), total.cast("string"), F.lit("</div>\n"), body, F.lit("</body></html>\n"),
    )


def render_pages(paged: DataFrame, key: list[str], title: Column, style: str = "txt") -> DataFrame:
    """(key, page_no, total_pages, item_id, href, html) from paginated paragraphs, or sections with columns seq and text."""
    own = paged.groupBy(*key, "page_no", "total_pages", "item_id", "href").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("ps"))
    return own.select(*key, "page_no", "total_pages", "item_id", "href", page_html(title, F.col("page_no"), F.col("total_pages"), F.col("ps.text"), style).alias("html"))


def render_texts(df: DataFrame, key: list[str], title: Column, style: str = "txt", text: str = "text", mode: str = "adaptive", n: int = PAGE_PARAGRAPHS) -> DataFrame:
    """``render_pages`` of texts straight from their paragraph arrays, page by page, without a shuffle. ``title`` is of ``key``."""
    split = df.select(*key, normalize_lines(F.col(text)).alias("__text")).select(*key, _split_paragraphs(F.col("__text"), mode).alias("__ps"))
    total = F.ceil(F.size("__ps") / n).cast("int")
    pages = split.where(F.size("__ps") > 0).select(*key, "__ps", total.alias("total_pages"), F.explode(F.sequence(F.lit(1), total)).alias("page_no"))
    item = F.format_string("page_%03d", "page_no")
    own = F.slice("__ps", (F.col("page_no") - 1) * n + 1, F.lit(n))
    return pages.select(*key, "page_no", "total_pages", item.alias("item_id"), F.concat(item, F.lit(".html")).alias("href"), page_html(title, F.col("page_no"), F.col("total_pages"), own, style).alias("html"))


def split_sections(df: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, sec_no from 1, html): cut before every ``<h1`` or ``<h2``; what stands before the first counts if not blank."""
    parts = F.split(F.col(html), "(?i)(?=<h[12])")
    headed = F.regexp_instr(F.col(html), F.lit("(?i)<h[12]")) > 0
    first = F.transform(F.slice(parts, 1, 1), lambda p: F.when(headed & ~p.rlike("(?i)^<h[12]"), utrim(p)).otherwise(p))
    kept = F.filter(F.concat(first, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), lambda p: (p != "") | ~headed)
    return df.select(*key, F.posexplode(kept).alias("sec_no", "html")).withColumn("sec_no", F.col("sec_no") + 1)


def split_formfeed(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, src_page, total, page_no, text): pages between form feeds; blank pages at the end don't count, others are
    skipped but keep their number in ``src_page``, while ``page_no`` has no gaps."""
    pages = df.select(*key, F.posexplode(F.split(text, "\f")).alias("src_page", "text")).withColumn("src_page", F.col("src_page") + 1)
    solid = utrim(F.col("text")) != ""
    book = Window.partitionBy(*key)
    kept = pages.withColumn("total", F.max(F.when(solid, F.col("src_page"))).over(book)).where(solid)
    return kept.withColumn("page_no", F.row_number().over(book.orderBy("src_page"))).select(*key, "src_page", "total", "page_no", "text")


def layout_blocks(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, block_no from 1, text, indent): parts between blank lines, lines joined by blanks; indent in bytes of the first."""
    blocks = pages.select(*key, F.posexplode(F.split(text, "\n\n")).alias("block", "raw"))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.regexp_replace(x, "[ \t\r]+$", "")), lambda x: x != "")
    blocks = blocks.withColumn("lines", lines).where(F.size("lines") > 0)
    out = blocks.select(*key, "block", F.array_join(F.transform("lines", utrim), " ").alias("text"), F.octet_length(F.regexp_extract(F.get("lines", F.lit(0)), "^[ \t]*", 0)).alias("indent"))
    return out.withColumn("block_no", F.row_number().over(Window.partitionBy(*key).orderBy("block"))).select(*key, "block_no", "text", "indent")


def tag_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their tag, garbage rows dropped."""
    return blocks.where(~is_garbage(F.col("text"))).withColumn("tag", classify_block(F.col("text"), F.col("indent")))


def _pieces(names: list[str], values: list[str]):
    """Words that come one after another in a batch and are of one row, as told by ``names``, to a row with lists of their ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cuts = np.flatnonzero(starts(pa.Table.from_batches([batch]), names))
                ends = pa.array([*cuts, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(cuts)) for c in names], *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in values]], [*names, *values])

    return run


def words_to_rows(words_df: DataFrame, key: list[str]) -> DataFrame:
    """(key, row_no, text, y, first_x) from (key, row_no, word_no, word, x, y): words joined, blank rows dropped. Place
    and height are those of the row's first word, blank or not.

    Words that lie together are shuffled together, and of their places only that of the first goes along. They may come in any order.
    """
    names, values = [*key, "row_no"], ["word_no", "word", "x", "y"]
    own = words_df.select(*names, *values)
    schema = StructType([*[own.schema[c] for c in names], *[StructField(c, ArrayType(own.schema[c].dataType)) for c in values]])
    pieces = own.mapInArrow(_pieces(names, values), schema).withColumn("word", F.transform("word", utrim))
    pieces = pieces.select(*names, F.array_min(F.arrays_zip(*values)).alias("first"), F.struct("word_no", "word").alias("said"))
    rows = pieces.groupBy(*names).agg(F.min("first").alias("first"), F.collect_list("said").alias("said"))
    ws = F.array_sort(F.flatten(F.transform("said", lambda p: F.arrays_zip(p["word_no"].alias("word_no"), p["word"].alias("word")))))
    text = F.array_join(F.filter(F.transform(ws, lambda w: w["word"]), lambda w: w != ""), " ")
    return rows.select(*names, text.alias("text"), F.col("first.y").alias("y"), F.col("first.x").alias("first_x")).where("text <> ''")


#: Rows of a page beyond which it is dealt to many tasks.
PAGE_ROWS = 200_000
GAP, INDENT, NO_GAP = 1.5, 8, 12.0


def _breaks() -> Column:
    return F.coalesce((F.col("gap") > F.col("median") * GAP) | (F.col("gap").isNotNull() & (F.col("first_x") > F.col("margin") + INDENT)), F.lit(False)).cast("int")


def _islands(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with para_no, by windows of a page each."""
    page = Window.partitionBy(*key)
    line = page.orderBy("row_no")
    gaps = rows.withColumn("gap", F.abs(F.col("y") - F.lag("y").over(line)))
    # ranks stay within the page's window, so one sort of the page serves both statistics
    ranked = gaps.withColumns({
        "n": F.count("*").over(page),
        "ng": F.count_if(F.col("gap") > 0).over(page),
        "xr": F.row_number().over(page.orderBy("first_x", "row_no")),
        "gr": F.row_number().over(page.orderBy(F.when(F.col("gap") > 0, F.col("gap")).asc_nulls_last(), "row_no")),
    })
    marked = ranked.withColumns({
        "median": F.coalesce(F.max(F.when((F.col("gr") == F.floor(F.col("ng") / 2) + 1) & (F.col("gap") > 0), F.col("gap"))).over(page), F.lit(NO_GAP)),
        "margin": F.max(F.when(F.col("xr") == F.floor(F.col("n") / 4) + 1, F.col("first_x"))).over(page),
    })
    return marked.withColumn("para_no", F.sum(_breaks()).over(line.rowsBetween(Window.unboundedPreceding, 0))).select(*key, "row_no", "text", "para_no")


def _spread_islands(rows: DataFrame, key: list[str]) -> DataFrame:
    """The same for pages of any size: gaps, ranks and numbers of paragraphs are prefix sums over ranges of rows."""
    lined = staged(numbered(rows.select(*key, "row_no", "y", "first_x"), key, ["row_no"], ["y"], number="line").withColumn("gap", F.abs(F.col("y") - F.col("prev_y"))), "gaps")
    margins = numbered(lined.select(*key, "first_x", "row_no"), key, ["first_x", "row_no"], number="xr", total="n").where("xr = floor(n / 4) + 1").select(*key, F.col("first_x").alias("margin"))
    medians = numbered(lined.where("gap > 0").select(*key, "gap", "row_no"), key, ["gap", "row_no"], number="gr", total="ng").where("gr = floor(ng / 2) + 1").select(*key, F.col("gap").alias("median"))
    # one row a page, written, so that its size is known to the join
    of_page = staged(margins.join(medians, key, "left").withColumn("median", F.coalesce("median", F.lit(NO_GAP))), "statistics")
    marked = lined.join(of_page, key).select(*key, "row_no", _breaks().alias("new"))
    islands = numbered(marked, key, ["row_no"], number="line", sums=["new"]).select(*key, "row_no", F.col("sum_new").alias("para_no"))
    return rows.select(*key, "row_no", "text").join(islands, [*key, "row_no"])


def rows_to_paragraphs(rows: DataFrame, key: list[str], page_rows: int = PAGE_ROWS) -> DataFrame:
    """(key, para_no from 0, text): a new paragraph where the gap is over 1.5 times the page's median gap, or the row starts
    more than 8 right of the page's left margin (first quartile). Medians are exact order statistics, not estimates.

    Pages of up to ``page_rows`` rows are worked on in a window each, larger ones in many tasks; both give the same. Keys are not null.
    """
    large = staged(rows.groupBy(*key).count().where(F.col("count") > page_rows).select(*key), "large")
    if large.isEmpty():
        island = _islands(rows, key)
    else:
        island = _islands(rows.join(large, key, "left_anti"), key).unionByName(_spread_islands(rows.join(large, key, "left_semi"), key))
    own = island.groupBy(*key, "para_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("rs"))
    return own.select(*key, F.col("para_no").cast("int").alias("para_no"), F.array_join("rs.text", " ").alias("text"))


def cap_page(paras: DataFrame, key: list[str], most: int = PAGE_BYTES, order: str = "para_no") -> DataFrame:
    """Paragraphs up to the one that takes the page over ``most`` bytes, that one included; a line end counts for each."""
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return paras.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") <= most).drop("__before")


def attach_images(pages: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key, src_page, total, text) with their images (key, file_name) as a sorted array; pages without both go."""
    totals = pages.select(*key, "total").distinct()
    placed = images.join(totals, key).withColumn("src_page", image_page_no(F.col("file_name"), F.col("total"))).where("src_page > 0")
    per_page = placed.groupBy(*key, "src_page").agg(F.sort_array(F.collect_list("file_name")).alias("images"))
    out = pages.join(per_page, [*key, "src_page"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    return out.where((F.size(words(F.col("text"))) > 0) | (F.size("images") > 0))
