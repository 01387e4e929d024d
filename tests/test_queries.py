"""Every registered query beside its SQL on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

import __spark_entry__ as entry

OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    ours, theirs = same_rows(entry.queries()[name](spark, SMALL), duck, entry.oracle_sql()[name])
    assert ours == theirs
    assert ours


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_split_pages_conserves_text(spark):
    from pyspark.sql import functions as F

    from bindery.operators.tokens import text_len

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    parts = entry.queries()["d5_split_pages"](spark, SMALL)
    before = text_len(pages, ["page_id"]).agg(F.sum("text_len")).first()[0]
    assert text_len(parts, ["page_id", "chunk"]).agg(F.sum("text_len")).first()[0] == before
    assert parts.count() > pages.count()


def test_index_after_translation_has_translated_snippets(spark):
    rows = entry.queries()["f8_index_after_translation"](spark, SMALL).where("chapters > 1").collect()
    assert rows and all("T:" in r["html"] for r in rows)


def test_every_file_is_a_book_or_a_reject(spark):
    from bindery.plans.fixtures import files
    from bindery.sources.ingest import ingest

    found = files(spark, SMALL)
    tables = ingest(found)
    paths = [r.path for r in tables["books"].collect()] + [r.path for r in tables["rejects"].select("path").distinct().collect()]
    assert sorted(paths) == sorted(r.path for r in found.select("path").collect())
    assert tables["pages"].select("book_id").distinct().count() == tables["books"].count()


@pytest.mark.parametrize("name", ["f6_f7_build_index", "f8_index_after_translation"])
def test_contents_of_a_book_of_several_parts_equal_sql(spark, tmp_path, name):
    """A site of over PART_ENTRIES pages beside one of a page and one of two."""
    import duckdb

    from bindery.operators.site import PART_ENTRIES

    pages = spark.range(PART_ENTRIES + 4).selectExpr("id as page_id", "'http://' || case id when 3 then 'one' when 5 then 'two' when 6 then 'two' else 'many' end || '.example/' || id as url", "'<html><body><p>Page ' || id || '</p></body></html>' as html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours, theirs = same_rows(entry.queries()[name](spark, str(tmp_path)), c, entry.oracle_sql()[name])
    assert ours == theirs
    assert len(ours) == 4


def test_a_package_holds_all_chapters_of_its_source(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    of_source = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    listed = entry.queries()["c1_c2_parse_package"](spark, SMALL).groupBy("book_id").agg({"pos": "max", "item_id": "count"}).collect()
    assert {r["book_id"]: (r["max(pos)"], r["count(item_id)"]) for r in listed} == {s: (n, n) for s, n in of_source.items()}
