"""Streams, archives and stores: what is written, seen, replaced and read, and what is not."""

import io
import os
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bindery.sources import archives, ingest, shelf
from bindery.streaming.ingest import stream_ingest
from bindery.streaming.translate import Progress, memory, send_again, stream_translate


def _book(n: int, chapters: int = 3, size: int = 0) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{"ab"[k % 2]}/c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(chapters))
        refs = "".join(f'<itemref idref="i{k}"/>' for k in range(chapters))
        z.writestr("b/p.opf", f"<package><metadata><title>Book {n}</title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>")
        for k in range(chapters):
            z.writestr(f"b/{'ab'[k % 2]}/c{k}.xhtml", f'<body><p>{n}-{k}</p><a href="../{"ab"[(k + 1) % 2]}/c{k + 1}.xhtml?x#y">on</a>{"x" * size}</body>')
    return out.getvalue()


def test_archives_are_read_by_runs_of_entries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"s{n}.epub").write_bytes(_book(n))
    (tmp_path / "in" / "large.epub").write_bytes(_book(9, 60, 2000))
    (tmp_path / "in" / "broken.epub").write_bytes(b"PK no archive" * 900)
    (tmp_path / "in" / "other.txt").write_text("no archive")
    reader = archives.ArchiveReader(str(tmp_path / "in"), (".epub",), 8000)
    runs = reader.partitions()
    assert sum(p.parts[0][2] is not None for p in runs) > 5  # the large one in runs
    rows = archives.read_archives(spark, str(tmp_path / "in"), run_bytes=8000)
    got = rows.groupBy("path").agg(F.count("entry").alias("n"), F.max("error").alias("e")).collect()
    assert {Path(r.path).name: (r.n, r.e and r.e.split(":")[0]) for r in got} == {"s0.epub": (5, None), "s1.epub": (5, None), "s2.epub": (5, None), "large.epub": (62, None), "broken.epub": (0, "BadZipFile")}


def test_a_large_archive_needs_little_memory(tmp_path):
    """An archive of 600 MB in 12 entries, read by one reader: what is held at a time is an entry, not the archive."""
    import resource

    path = tmp_path / "large.epub"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for n in range(12):
            z.writestr(f"e{n}", b"0123456789abcdef" * (50 << 16))
    reader = archives.ArchiveReader(str(tmp_path), (".epub",), 1 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sizes = [batch.column(2).nbytes for run in reader.partitions() for batch in reader.read(run)]
    assert len(sizes) == 12 and sum(sizes) > 600 << 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10  # kilobytes


def test_folder_and_files_give_the_same_tables(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(_book(1))
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.epub").write_bytes(b"none")
    whole = ingest.ingest(ingest.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", "")))
    parts = ingest.ingest_folder(spark, str(tmp_path))
    clean = lambda df: sorted(map(str, df.drop("book_id", "path").collect()))
    for name in ("pages", "manifest", "spine", "rejects"):
        assert clean(whole[name]) == clean(parts[name]), name
    pages = {r.href: r.html for r in parts["pages"].collect() if r.item_id.startswith("i")}
    assert pages["a/c0.html"].count('href="../b/c1.html?x#y"') == 1 and pages["b/c1.html"].count('href="../a/c2.html?x#y"') == 1
    assert pages["a/c2.html"].count('href="../b/c3.xhtml?x#y"') == 1  # no such entry: as it was


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.mkdir(source)
    Path(source, "a.txt").write_text("first")
    stream_ingest(spark, source, out, checkpoint).awaitTermination()
    assert ingest.read_corpus(spark, out)["books"].count() == 1
    Path(source, "b.txt").write_text("second")
    real = ingest.write_run

    def dies(tables, where, batch=0):
        real(dict(list(tables.items())[:2]), f"{where}/lost", batch)
        raise RuntimeError("killed")

    monkeypatch.setattr("bindery.streaming.ingest.write_run", dies)
    with pytest.raises(Exception, match="killed"):
        stream_ingest(spark, source, out, checkpoint).awaitTermination()
    seen = ingest.read_corpus(spark, out)
    assert seen["books"].count() == seen["pages"].count() == 1
    monkeypatch.setattr("bindery.streaming.ingest.write_run", real)
    stream_ingest(spark, source, out, checkpoint).awaitTermination()
    stream_ingest(spark, source, out, checkpoint).awaitTermination()
    seen = ingest.read_corpus(spark, out)
    assert seen["books"].count() == seen["pages"].count() == 2
    ingest.write_run(ingest.ingest(spark.createDataFrame([("/b.txt", b"second")], "path string, content binary")), out, 1)  # a replay
    assert ingest.read_corpus(spark, out)["books"].count() == 2


def test_a_rebuild_replaces_its_buckets_alone(spark, tmp_path):
    out = str(tmp_path / "shelf")
    pages = spark.range(200).select((F.col("id") % 100).alias("book_id"), F.col("id").alias("n"), F.lit("old").alias("html"))
    shelf.store({"pages": pages}, out, 16)
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    assert len(files) == 16
    books = spark.createDataFrame([(3,), (4,), (1000,)], "book_id long")
    buckets = {r[0] for r in books.select(F.pmod(F.xxhash64("book_id"), F.lit(16))).collect()}
    shelf.replace_books({"pages": spark.createDataFrame([(3, 7, "new"), (1000, 8, "new")], "book_id long, n long, html string")}, out, books, 16)
    now = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    assert {p for p, t in files.items() if now.get(p) == t} == {p for p in files if int(p.parent.name.split("=")[1]) not in buckets}
    got = shelf.load(spark, out, ["pages"])["pages"]
    assert got.where("html = 'new'").count() == 2 and got.where("book_id = 4").count() == 0 and got.where("html = 'old'").count() == 196
    bucket = spark.range(100).where(F.pmod(F.xxhash64("id"), F.lit(16)) == 5).select(F.col("id").alias("book_id"))
    shelf.replace_books({"pages": pages.limit(0)}, out, bucket, 16)  # nothing is left of a bucket
    got = shelf.load(spark, out, ["pages"])["pages"]
    assert got.join(bucket, "book_id").count() == 0 and got.count() > 100


def _calls(folder):
    def backend(texts, src, dst):
        for t in texts:
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.write(t + "\n")
        if "bad" in texts and not os.path.exists(os.path.join(folder, "mended")):
            raise ValueError("refused")
        return [t.upper() for t in texts]

    return backend


def test_a_stream_asks_once_for_each_text(spark, tmp_path):
    source, out, checkpoint, calls = (str(tmp_path / x) for x in ("in", "out", "state", "calls"))
    os.mkdir(calls)
    segments = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)
    segments(["one", "two", "one", " ", None])
    stream = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source)
    stream_translate(stream(), _calls(calls), "en", "de", out, checkpoint).awaitTermination()
    segments(["two", "three"])
    segments(["bad", "three", "one"])
    stream_translate(stream(), _calls(calls), "en", "de", out, checkpoint).awaitTermination()  # a restart: the state is in the checkpoint
    asked = sorted(line for p in Path(calls).iterdir() for line in p.read_text().split())
    assert asked == ["bad", "one", "three", "two"]
    got = {r.text: (r.translated, r.error) for r in memory(spark, out).collect()}
    assert got == {"one": ("ONE", None), "two": ("TWO", None), "three": ("THREE", None), "bad": (None, "ValueError: refused")}
    Path(calls, "mended").touch()
    assert {r.text: r.translated for r in send_again(spark, _calls(calls), "en", "de", out).collect()}["bad"] == "BAD"
    assert memory(spark, str(tmp_path / "none")).count() == 0


def test_progress_grows_while_a_stream_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n in range(4):
        spark.createDataFrame([(f"text {n} {k}",) for k in range(5)], "text string").coalesce(1).write.mode("append").parquet(source)

    def slow(texts, src, dst):
        time.sleep(0.3)
        return texts

    watch = Progress(total=4 * 5 * 8)
    spark.streams.addListener(watch)
    try:
        query = stream_translate(spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(source), slow, "en", "de", out, checkpoint)
        early = []
        while query.isActive:
            early.append(watch.now["texts"])
            time.sleep(0.05)
        query.awaitTermination()
        watch.ended.wait(20)
    finally:
        spark.streams.removeListener(watch)
    assert any(0 < n < 20 for n in early)
    assert [s["texts"] for s in watch.seen if s["texts"]][-1] == 20 and watch.now["bytes"] == 160 and watch.now["left"] == 0 and watch.now["rate"] > 0
    lefts = [s["left"] for s in watch.seen if s["left"] is not None]
    assert lefts[0] > lefts[-1]
