"""Files of many formats into one schema: books, pages of text, rejects.

Only what Spark has no reader for is done in Python, row by row inside ``mapInArrow``: opening archives and marked-up
containers. Parsing of package files, paragraphs and pages are table operations.
"""

from __future__ import annotations

import io
import re
import time
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.text import book_title, html_body, html_title, utrim
from bindery.operators.books import ENTRY_BYTES, content_files, entry_path, normalize_hrefs, opf_path, parse_opf, rename_reserved, safe_entries, spine_hrefs, with_key
from bindery.operators.paragraphs import page_html, render_texts
from bindery.sources.archives import checked, read_archives
from bindery.sources.staging import staged

Decoder = Callable[[bytes], str]
PAGE_SCHEMA = ["book_id", "page_no", "item_id", "href", "html"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def fb2_paragraphs(raw: bytes) -> tuple[str, list[str]]:
    """Title and paragraphs: body title, then of each section its title, epigraphs, own paragraphs and inner sections.
    Text inside inline marks is kept."""
    root = ET.fromstring(raw)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    said = lambda e: " ".join("".join(e.itertext()).split())
    out: list[str] = []

    def lines(e: ET.Element, *where: str) -> None:
        for tag in where:
            for x in e.findall(tag):
                out.extend(t for p in x.iter("p") if (t := said(p)))

    def section(e: ET.Element) -> None:
        lines(e, "title", "epigraph")
        out.extend(t for p in e.findall("p") if (t := said(p)))
        for inner in e.findall("section"):
            section(inner)

    for body in root.findall("body"):
        lines(body, "title")
        for e in body.findall("section"):
            section(e)
    title = root.find("./description/title-info/book-title")
    return (said(title) if title is not None else ""), out


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?(?:\\'[0-9a-fA-F]{2}|[^\\{}])?|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
#: Groups that hold no text of the document. Fixed values of the format.
_NO_TEXT = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer")


def rtf_text(raw: bytes, codec: str = "cp1251", skip_groups: bool = False) -> str:
    """Text of a rich-text file: breaks and tabs kept, other control words dropped, bytes by code page, code points decoded.

    With ``skip_groups`` the text of font tables and other groups that hold none of the document's is left out.
    """
    out: list[str] = []
    depth, skipped = 0, None
    for byte, point, word, _, sign, brace, text in _RTF.findall(raw.decode("latin-1")):
        if brace:
            depth += 1 if brace == "{" else -1
            if skipped is not None and depth < skipped:
                skipped = None
        elif skip_groups and skipped is None and (word in _NO_TEXT or sign == "*"):
            skipped = depth
        elif skipped is not None:
            continue
        elif byte:
            out.append(bytes.fromhex(byte).decode(codec, "ignore"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word:
            out.append({"par": "\n\n", "line": "\n\n", "tab": "\t"}.get(word, ""))
        elif sign:
            out.append({"\n": "\n\n", "\r": "\n\n", "~": " "}.get(sign, sign if sign in "\\{}" else ""))
        elif text:
            out.append(text.replace("\r", "").replace("\n", "").encode("latin-1").decode(codec, "ignore"))
    return "".join(out)


def _entries(raw: bytes) -> Iterator[tuple[str, bytes, bool]]:
    """Entries, and whether they were cut at ENTRY_BYTES."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if not info.is_dir():
                with z.open(info) as f:
                    data = f.read(ENTRY_BYTES + 1)
                yield info.filename, checked(info.filename, data[:ENTRY_BYTES]), len(data) > ENTRY_BYTES


OPENED = "book_id long, fmt string, path string, entry string, title string, text string, content binary, truncated boolean, error string"
_OPENED = pa.schema([("book_id", pa.int64()), *[(c, pa.string()) for c in ("fmt", "path", "entry", "title", "text")], ("content", pa.binary()), ("truncated", pa.bool_()), ("error", pa.string())])
#: Bytes, and rows, that a task hands over at once.
HAND_BYTES, HAND_ROWS = 4 << 20, 256


def _opened(fmt: str, raw: bytes, decoders: dict[str, Decoder]) -> Iterator[dict]:
    """What comes out of a file: one row for each archive entry of an EPUB, else one; an error may follow entries that were read."""
    try:
        if fmt in decoders:
            out = {"text": decoders[fmt](raw), "fmt": "txt"}
        elif fmt == "epub":
            for name, data, cut in _entries(raw):
                yield {"entry": name, "content": data, "truncated": cut}
            return
        elif fmt == "fb2":
            title, ps = fb2_paragraphs(raw)
            out = {"title": title, "text": "\n".join(ps)}
        elif fmt == "rtf":
            out = {"text": rtf_text(raw)}
        elif fmt in ("txt", "html"):
            out = {"text": raw.decode("utf-8", "ignore")}
        else:
            out = {"error": "no_decoder"}
        yield out if out.get("error") or (out["text"] or "").strip() else {"error": "empty"}
    except Exception as e:  # noqa: BLE001  a broken file is a row of rejects
        yield {"error": f"{type(e).__name__}: {e}"}


def _adapter(decoders: dict[str, Decoder]):
    """(book_id, fmt, path, content) to rows of OPENED, handed over in runs of bounded size, whatever an archive holds.

    A file is taken out of its batch when its turn comes; no second copy of a batch is held.
    """

    def adapt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for book_id, fmt, path, content in zip(*[batch.column(c) for c in range(4)], strict=True):
                base = {"book_id": book_id.as_py(), "fmt": fmt.as_py(), "path": path.as_py(), "entry": None, "title": "", "text": None, "content": None, "truncated": False, "error": None}
                for out in _opened(base["fmt"], content.as_py(), decoders):
                    held.append(base | out)
                    size += len(out.get("content") or out.get("text") or "")
                    if size > HAND_BYTES or len(held) >= HAND_ROWS:
                        yield pa.RecordBatch.from_pylist(held, _OPENED)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _OPENED)

    return adapt


def open_files(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Rows of OPENED from (path, content)."""
    return with_key(files).select("book_id", "fmt", "path", "content").mapInArrow(_adapter(decoders or {}), OPENED)


def open_folder(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Rows of OPENED from all files under ``path``. Archives are read entry by entry and never whole."""
    others = read_files(spark, path)
    own = with_key(read_archives(spark, path, ".epub")).select("book_id", F.lit("epub").alias("fmt"), "path", "entry", F.lit("").alias("title"), F.lit(None).cast("string").alias("text"), "content", "truncated", "error")
    return open_files(others.where(~F.lower("path").endswith(".epub")), decoders).unionByName(own)


def ingest(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> dict[str, DataFrame]:
    """Tables books (book_id, path, fmt, title, base_path, truncated), pages (book_id, page_no, item_id, href, html), manifest,
    spine, rejects (book_id, path, reason) from (path, content), one row a path.

    Files are opened once: what comes out of them is written to the session's shared folder, and all tables derive from that.
    Formats without a decoder and files that cannot be read are rejects; ``decoders`` adds some (bytes to text). Books of
    which an entry was cut at ENTRY_BYTES say so.
    """
    return corpus(open_files(files, decoders))


def ingest_folder(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None) -> dict[str, DataFrame]:
    """The tables of ``ingest`` from all files under ``path``; archives of any size, as none is whole in a row."""
    return corpus(open_folder(spark, path, decoders))


def corpus(opened: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``ingest`` from rows of OPENED. A book of which an entry could not be read is a reject."""
    rows = staged(opened, "opened")
    broken_ids = rows.where("error is not null").select("book_id").distinct()
    entries = safe_entries(rows.where("entry is not null and error is null").join(broken_ids, "book_id", "left_anti").select("book_id", "path", "entry", "content", "truncated"))
    title = book_title(F.col("title"), F.col("path"))

    def plain(fmt: str) -> DataFrame:
        own = rows.where((F.col("fmt") == fmt) & F.col("error").isNull()).select("book_id", title.alias("title"), "text")
        return render_texts(own, ["book_id", "title"], F.col("title"), fmt, mode="blank" if fmt == "rtf" else "adaptive").select(*PAGE_SCHEMA)

    html = rows.where("fmt = 'html' and error is null")
    named = html_title(F.col("text"), F.col("path"))
    page = page_html(named, F.lit(1), F.lit(1), F.array(html_body(F.col("text"))), "html")
    single = html.select("book_id", F.lit(1).alias("page_no"), F.lit("page_001").alias("item_id"), F.lit("page_001.html").alias("href"), page.alias("html"))
    text_of = F.col("content").cast("string")
    # filters may be evaluated in any order: only package files ever reach the XML expressions
    is_container = F.lower("entry") == "meta-inf/container.xml"
    opf = opf_path(entries.where(is_container).select("book_id", F.when(is_container, text_of).alias("xml")))
    packages = entries.withColumnRenamed("entry", "opf").join(opf, ["book_id", "opf"]).select("book_id", "opf", F.when(F.lower("opf").endswith(".opf"), text_of).alias("xml"))
    packages = staged(packages, "opf")  # found once: three tables come from them
    epub, manifest, spine = (staged(t, n) for t, n in zip(parse_opf(packages), ("packages", "manifest", "spine"), strict=True))
    based = manifest.join(epub.select("book_id", "base_path"), "book_id")
    stored = F.when(F.col("base_path") == "", F.col("href")).otherwise(F.concat_ws("/", "base_path", "href"))
    listed = content_files(based).withColumn("entry", entry_path(stored)).select("book_id", "item_id", "href", "entry")
    files_of = staged(listed.join(entries.select("book_id", entry_path(F.col("entry")).alias("entry"), text_of.alias("html")), ["book_id", "entry"]).select("book_id", "item_id", "href", "html"), "chapters")
    manifest, files_of = normalize_hrefs(based, files_of)
    manifest, files_of = rename_reserved(manifest, files_of)
    ordered = spine_hrefs(spine, manifest).join(manifest.select("book_id", "href", "item_id"), ["book_id", "href"])
    chapters = ordered.join(files_of.drop("href"), ["book_id", "item_id"]).select("book_id", F.col("spine_pos").alias("page_no"), "item_id", "href", "html")
    names = rows.where("entry is null and error is null").select("book_id", "path", "fmt", F.when(F.col("fmt") == "html", named).otherwise(title).alias("title"), F.lit("").alias("base_path"), "truncated")
    paths = entries.groupBy("book_id", "path").agg(F.max("truncated").alias("truncated"))
    of_epub = paths.join(epub, "book_id").select("book_id", "path", F.lit("epub").alias("fmt"), book_title(utrim(F.col("title")), F.col("path")).alias("title"), "base_path", "truncated")
    broken = paths.join(epub, "book_id", "left_anti").select("book_id", "path", F.lit("no_package").alias("reason"))
    rejects = rows.where("error is not null").select("book_id", "path", F.col("error").alias("reason")).unionByName(broken)
    pages = reduce(DataFrame.unionByName, [plain("txt"), plain("fb2"), plain("rtf"), single, chapters])
    return {"books": names.unionByName(of_epub), "pages": pages, "manifest": manifest, "spine": spine, "rejects": rejects}


def write_run(tables: dict[str, DataFrame], out: str, batch: int = 0) -> str:
    """All tables as Parquet in a folder of this run, published last by one small file, so that readers see all or nothing.

    A run that fails leaves what was published before; its folder is never read. Of several runs of a batch the last counts.
    Returns the run's folder.
    """
    run = f"{out.rstrip('/')}/runs/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(batch, run, time.time())], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/published")
    return run


PUBLISHED = "batch long, run string, at double"
TABLES = {
    "books": "book_id long, path string, fmt string, title string, base_path string, truncated boolean",
    "pages": "book_id long, page_no int, item_id string, href string, html string",
    "manifest": "book_id long, pos int, item_id string, href string, media_type string, base_path string",
    "spine": "book_id long, spine_pos int, idref string",
    "rejects": "book_id long, path string, reason string",
}


def published(spark: SparkSession, out: str) -> list[tuple[int, str]]:
    """(batch, folder) of the run that counts of each batch; empty before the first."""
    try:
        log = spark.read.schema(PUBLISHED).parquet(f"{out.rstrip('/')}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = log.groupBy("batch").agg(F.max_by("run", F.struct("at", "run")).alias("run"))
    return [(r["batch"], r["run"]) for r in last.orderBy("batch").collect()]


def write_corpus(tables: dict[str, DataFrame], out: str) -> str:
    """One run that stands for the whole corpus; see ``write_run``."""
    return write_run(tables, out)


def read_corpus(spark: SparkSession, out: str, but: int | None = None) -> dict[str, DataFrame]:
    """The tables of all published batches (``but`` one): of each the run that was published last."""
    runs = [run for batch, run in published(spark, out) if batch != but]
    return {name: spark.read.schema(kind).parquet(*[f"{r}/{name}" for r in runs]) if runs else spark.createDataFrame([], kind) for name, kind in TABLES.items()}
