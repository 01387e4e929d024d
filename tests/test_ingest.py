"""Files of every format, rejects, and ingestion as a stream."""

import io
import zipfile

import pytest

from bindery.operators.books import pending
from bindery.sources.ingest import fb2_paragraphs, ingest, read_corpus, read_files, rtf_text, write_corpus
from bindery.streaming.ingest import stream_ingest

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title></metadata>
<manifest><item id="c1" href="ch1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="ch2.xhtml" media-type="application/xhtml+xml"/><item id="s" href="a.css" media-type="text/css"/></manifest>
<spine><itemref idref="c2"/><itemref idref="c1"/><itemref idref="gone"/></spine></package>"""
FB2 = """<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><book-title>F</book-title></title-info></description>
<body><title><p>Top</p></title><section><title><p>S1</p></title><p>one <emphasis>two</emphasis></p><section><p>inner</p></section><p>three</p></section></body></FictionBook>"""
RTF = rb"{\rtf1\ansi Hello\par \'cf\'f0\'e8\'e2\'e5\'f2\tab x\{y\} " + b"\\u1046?z}"


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", OPF)
        z.writestr("OEBPS/ch1.xhtml", '<html><body><a href="ch2.xhtml">next</a></body></html>')
        z.writestr("OEBPS/ch2.xhtml", "<html><body>two</body></html>")
        z.writestr("../../../etc/evil.txt", "no")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    files = {"a.epub": epub(), "b.fb2": FB2.encode(), "c.rtf": RTF, "d.txt": b"one\n\ntwo\nlines\xff", "e.HTM": b"<title> H &amp; h </title><body>x</body>", "f.pdf": b"%PDF", "g.txt": b" \n", "h.epub": b"no archive"}
    for name, raw in files.items():
        (d / name).write_bytes(raw)
    return d


def test_ingest(spark, folder, tmp_path):
    tables = ingest(read_files(spark, str(folder)))
    titles = {r.path.rsplit("/", 1)[1]: (r.fmt, r.title) for r in tables["books"].collect()}
    assert titles == {"a.epub": ("epub", "A Book"), "b.fb2": ("fb2", "F"), "c.rtf": ("rtf", "c"), "d.txt": ("txt", "d"), "e.HTM": ("html", "H & h")}
    reasons = {r.path.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in tables["rejects"].collect()}
    assert reasons == {"f.pdf": "no_decoder", "g.txt": "empty", "h.epub": "BadZipFile"}
    names = {r.book_id: r.path.rsplit("/", 1)[1] for r in tables["books"].collect()}
    pages = [(names[r.book_id], r.page_no, r.href, r.html) for r in tables["pages"].orderBy("page_no").collect()]
    book = [p[1:] for p in pages if p[0] == "a.epub"]
    assert [(n, h) for n, h, _ in book] == [(1, "ch2.html"), (2, "ch1.html")]
    assert 'href="ch2.html"' in book[1][2]
    assert [p for p in pages if p[0] == "d.txt"][0][3].count("<p>") == 2
    write_corpus(tables, str(tmp_path / "out"))
    assert read_corpus(spark, str(tmp_path / "out"))["pages"].count() == len(pages)
    # a run that fails half way is never seen
    with pytest.raises(Exception, match="no_such_column"):
        write_corpus({"books": tables["books"].limit(0), "pages": tables["pages"].selectExpr("no_such_column")}, str(tmp_path / "out"))
    assert read_corpus(spark, str(tmp_path / "out"))["books"].count() == 5
    write_corpus({k: v.limit(1) for k, v in tables.items()}, str(tmp_path / "out"))
    assert read_corpus(spark, str(tmp_path / "out"))["pages"].count() == 1


def test_decoder(spark, folder):
    got = ingest(read_files(spark, str(folder)).where("path like '%pdf'"), {"pdf": lambda raw: "page text"})
    assert got["rejects"].count() == 0
    assert "page text" in got["pages"].first()["html"]


def test_adapters():
    assert fb2_paragraphs(FB2.encode()) == ("F", ["Top", "S1", "one two", "three", "inner"])
    assert rtf_text(RTF) == "Hello\n\nПривет\tx{y} Жz"
    table = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen X;}text}"
    assert rtf_text(table) == "Arial;X;text" and rtf_text(table, skip_groups=True) == "text"


def test_cut_entries_say_so(spark, folder, monkeypatch):
    from bindery.operators import books

    entries = spark.createDataFrame([("a", b"12345"), ("b", b"123")], "entry string, content binary")
    assert sorted((r.entry, bytes(r.content), r.truncated) for r in books.safe_entries(entries, most=4).collect()) == [("a", b"1234", True), ("b", b"123", False)]
    assert {r.truncated for r in ingest(read_files(spark, str(folder)))["books"].collect()} == {False}


def test_package_items_without_attributes(spark):
    from bindery.operators.books import parse_opf

    xml = """<opf:package xmlns:opf="x"><opf:manifest><!-- <opf:item id="no"/> --><opf:item href='a&amp;b.html' id = "1" /><opf:item id="2" media-type="t/x"/><opf:item media-type="t>y" href="c"/></opf:manifest></opf:package>"""
    df = spark.createDataFrame([(1, "a/b.opf", xml)], "book_id long, opf string, xml string")
    assert [tuple(r)[1:] for r in parse_opf(df)[1].orderBy("pos").collect()] == [(0, "1", "a&b.html", ""), (1, "2", "", "t/x"), (2, "", "c", "t>y")]


def test_pending(spark):
    a = spark.createDataFrame([(1,), (2,)], "book_id long")
    b = spark.createDataFrame([(2,)], "book_id long")
    assert [r[0] for r in pending(a, b, ["book_id"]).collect()] == [1]
    assert pending(a, b, ["book_id"], force=True).count() == 2


def test_two_batches_equal_one(spark, folder, tmp_path):
    late = (folder / "b.fb2").rename(tmp_path / "b.fb2")
    for k in range(2):
        stream_ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        if not k:
            late.rename(folder / "b.fb2")
    once = ingest(read_files(spark, str(folder)))
    for name in ("books", "pages", "rejects"):
        df = read_corpus(spark, str(tmp_path / "out"))[name]
        want = sorted(map(str, once[name].collect()))
        got = sorted(map(str, df.select(*once[name].columns).collect()))
        assert [x.replace("file:///", "file:/") for x in got] == [x.replace("file:///", "file:/") for x in want]


def test_files_leave_a_batch_one_by_one():
    """Rows are handed over in runs of bounded size, and no more of a batch is opened than was asked for."""
    import pyarrow as pa

    from bindery.sources import ingest as I

    opened = []
    decode = lambda raw: opened.append(1) or raw.decode() * 100
    raw = [b"word " * 1000] * 200
    batch = pa.RecordBatch.from_pydict({"book_id": pa.array(range(200)), "fmt": ["txt"] * 200, "path": [f"/lib/{n}.txt" for n in range(200)], "content": raw})
    runs = I._adapter({"txt": decode})(iter([batch]))
    first = next(runs)
    assert first.nbytes < I.HAND_BYTES + 2 * 100 * len(raw[0]) and len(opened) == first.num_rows < 200
    assert first.num_rows + sum(r.num_rows for r in runs) == 200
