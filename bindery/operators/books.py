"""Books as manifest, spine and page tables: catalog, reading order, names and links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bindery.functions.links import relinked, targets
from bindery.functions.text import decode_entities, full_href, route_format, sanitize_name, stem
from bindery.operators.tokens import per_page
from bindery.sources.staging import staged

HTML_TYPES = ("application/xhtml+xml", "text/html")
ENTRY_BYTES = 100 << 20


def pending(candidates: DataFrame, catalog: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Candidates that the catalog doesn't have yet; with ``force`` all of them."""
    return candidates if force else candidates.join(catalog.select(*key).distinct(), key, "left_anti")


def with_key(books: DataFrame, path: str = "path") -> DataFrame:
    """Adds book_id (hash of the path), fmt and name; equal stems no longer collide."""
    return books.withColumns({"book_id": F.xxhash64(path), "fmt": route_format(F.col(path)), "name": sanitize_name(stem(F.col(path)))})


def name_collisions(books: DataFrame, name: str = "name") -> DataFrame:
    """(name, n): output names that several books would share."""
    return books.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def spine_hrefs(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, spine_pos, href, media_type): reading order; references without an item go, the last of equal ids wins."""
    last = F.row_number().over(Window.partitionBy("book_id", "item_id").orderBy(F.desc("pos")))
    items = manifest.withColumn("__n", last).where("__n = 1").select("book_id", F.col("item_id").alias("idref"), "href", "media_type")
    return spine.join(items, ["book_id", "idref"]).select("book_id", "spine_pos", "href", "media_type")


def content_files(manifest: DataFrame, allow_blank: bool = False) -> DataFrame:
    """Items that are HTML; those without a type too if asked."""
    return manifest.where(F.col("media_type").isin(*HTML_TYPES, *([""] if allow_blank else [])))


def is_safe_entry(name: Column) -> Column:
    """The path stays inside its root: not absolute, and never more steps up than down."""
    steps = F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walked = F.aggregate(steps, start, lambda a, p: F.struct((a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), F.least(a["least"], a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return ~name.rlike(r"^([/\\]|[A-Za-z]:)") & (walked["least"] >= 0)


def safe_entries(entries: DataFrame, name: str = "entry", content: str = "content", most: int = ENTRY_BYTES) -> DataFrame:
    """Archive entries inside their root, cut at ``most`` bytes; ``truncated`` says which were."""
    cut = F.octet_length(content) > most
    if "truncated" in entries.columns:
        cut = cut | F.col("truncated")
    return entries.where(is_safe_entry(F.col(name))).withColumn("truncated", cut).withColumn(content, F.substring(content, 1, most))


def entry_path(href: Column) -> Column:
    """A path without ``.`` and empty steps, each ``..`` taking back the step before it."""
    steps = F.filter(F.split(F.translate(href, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    back = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), a), -1), F.lit("..")) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), back), "/")


def html_href(href: Column) -> Column:
    return F.regexp_replace(href, r"(?i)\.xhtml?$", ".html")


def _rewrite(pages: DataFrame, renamed: DataFrame, hint: str, href: str) -> DataFrame:
    """Page html with the links to renamed entries of its book following; queries and fragments stay.

    ``renamed`` has (book_id, old, new), paths from the book's base, as ``href`` is the page's own. Only pages that hold ``hint``,
    a pattern that every link to a renamed entry matches, leave their task. Their links, resolved against the page's folder,
    meet the book's new names in a join by (book_id, entry), so that neither a book's names nor its pages are gathered; each
    page then takes its own few. Pages need no key: equal pages at one place have equal links.
    """
    has = F.coalesce(F.col("html").rlike(hint), F.lit(False))
    own = staged(pages.where(has).withColumn("__mark", F.xxhash64("html", href)), "linking")
    page = F.struct(F.col("html").alias("html"), F.coalesce(F.col(href), F.lit("")).alias("at"))
    links = per_page(own.select("book_id", "__mark", page.alias("__page")), ["book_id", "__mark"], F.col("__page"), {"old": StringType()}, lambda p: ((t,) for t in targets(p["html"], p["at"])))
    found = links.distinct().join(renamed.select("book_id", "old", "new").distinct(), ["book_id", "old"]).groupBy("book_id", "__mark").agg(F.collect_list(F.struct("old", "new")).alias("__names"))

    def run(html: pa.Array, at: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
        rows = zip(html.to_pylist(), at.to_pylist(), old.to_pylist(), new.to_pylist(), strict=True)
        return pa.array([h if o is None else relinked(h, a or "", dict(zip(o, n, strict=True))) for h, a, o, n in rows], pa.string())

    both = own.join(found, ["book_id", "__mark"], "left").withColumn("html", F.arrow_udf(run, StringType())("html", href, "__names.old", "__names.new"))
    return pages.where(~has).unionByName(both.select(*pages.columns))


def normalize_hrefs(manifest: DataFrame, pages: DataFrame, href: str = "href") -> tuple[DataFrame, DataFrame]:
    """XHTML items under ``.html`` names and type, and pages whose links follow. Pages: book_id, html, ``href`` and more, where
    ``href`` is the page's name in the manifest before the renaming, and so it stays."""
    is_x = F.col("href").rlike(r"(?i)\.xhtml?$") & F.col("media_type").isin(*HTML_TYPES)
    renamed = manifest.where(is_x).select("book_id", entry_path(F.col("href")).alias("old"), html_href(entry_path(F.col("href"))).alias("new"))
    items = manifest.withColumn("media_type", F.when(is_x, "text/html").otherwise(F.col("media_type"))).withColumn("href", F.when(is_x, html_href(F.col("href"))).otherwise(F.col("href")))
    return items, _rewrite(pages, renamed, r"(?i)\.xhtml?|%|&#", href)


def rename_reserved(manifest: DataFrame, pages: DataFrame, base_path: str = "base_path", href: str = "href") -> tuple[DataFrame, DataFrame]:
    """An HTML item that would sit at ``index.html`` gets ``_content_`` before its name, and links follow."""
    clash = F.col("media_type").isin(*HTML_TYPES, "") & (entry_path(full_href(F.col(base_path), F.col("href"))) == "index.html")
    new = F.regexp_replace(entry_path(F.col("href")), r"([^/]+)$", "_content_$1")
    renamed = manifest.where(clash).select("book_id", entry_path(F.col("href")).alias("old"), new.alias("new"))
    return manifest.withColumn("href", F.when(clash, new).otherwise(F.col("href"))), _rewrite(pages, renamed, r"index\.html|%|&#", href)


def opf_path(containers: DataFrame, xml: str = "xml") -> DataFrame:
    """(book_id, opf): the first root file of the package type or with the extension."""
    paths = F.xpath(F.col(xml), F.lit('//*[local-name()="rootfile"][@media-type="application/oebps-package+xml" or substring(@full-path, string-length(@full-path) - 3)=".opf"]/@full-path'))
    return containers.select("book_id", F.get(paths, F.lit(0)).alias("opf"))


_QUOTED = r"""(?:[^>"']+|"[^"]*"|'[^']*')*"""


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's decoded value, empty without one."""
    value = F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return decode_entities(F.regexp_replace(value, r"""^["']|["']$""", ""))


def parse_opf(packages: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books (book_id, title, base_path), manifest (book_id, pos, item_id, href, media_type), spine (book_id, spine_pos,
    idref) from (book_id, opf, xml). An item is read as a whole; an attribute that it lacks is empty."""
    doc = F.col(xml)
    title = F.get(F.xpath(doc, F.lit('//*[local-name()="metadata"]/*[local-name()="title"]/text()')), F.lit(0))
    base = F.when(F.instr("opf", "/") > 0, F.regexp_replace("opf", "/[^/]*$", "")).otherwise("")
    books = packages.select("book_id", F.coalesce(title, F.lit("")).alias("title"), base.alias("base_path"))
    listed = F.regexp_extract(F.regexp_replace(doc, "(?s)<!--.*?-->", ""), r"(?s)<(?:[\w.-]+:)?manifest\b[^>]*>(.*?)</(?:[\w.-]+:)?manifest\s*>", 1)
    items = F.regexp_extract_all(listed, F.lit(rf"(?s)<(?:[\w.-]+:)?item\b{_QUOTED}>"), 0)
    manifest = packages.select("book_id", F.posexplode(items).alias("pos", "tag"))
    manifest = manifest.select("book_id", "pos", *[_attribute(F.col("tag"), a).alias(n) for a, n in (("id", "item_id"), ("href", "href"), ("media-type", "media_type"))])
    spine = packages.select("book_id", F.posexplode(F.xpath(doc, F.lit('//*[local-name()="spine"]/*[local-name()="itemref"]/@idref'))).alias("spine_pos", "idref")).withColumn("spine_pos", F.col("spine_pos") + 1)
    return books, manifest, spine
