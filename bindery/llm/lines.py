"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth by its number of tokens and its leading tokens to a leaf. Within a leaf lines merge
into templates: tokens with digits are variable fields, and lines of some length also merge if they agree in all but one
third of their remaining positions, which then is a variable field. The path and the leaf's template make a 64-bit key, so
that the whole tree lives in one aggregation by key instead of in any task's memory. Templates that recur across documents
are dropped from every document but the first. Lines that differ in several thirds don't merge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import carrying, lean, stage, text_blocks

#: Leading tokens that every template keeps.
DEPTH = 2
#: Text bytes that a task works on at once; a longer text is worked on alone.
BLOCK_BYTES = 1 << 20
#: Lines of fewer tokens have one template only and must recur in more documents.
SHORT = 8
#: Documents in which a template recurs: of short lines, of others.
SHORT_DOCS, DOCS = 20, 2

_FIELD = re.compile(rb"[0-9]")


def templates(line: bytes, depth: int = DEPTH, short: int = SHORT) -> list[int]:
    """Keys of a line's templates, none for a blank line; as signed 64-bit integers."""
    tokens = [b"<*>" if _FIELD.search(t) else t for t in line.split()]
    n = len(tokens)
    if not n:
        return []
    forms = [b"0 %d " % n + b" ".join(tokens)]
    if n >= short:
        cuts = [depth + (n - depth) * k // 3 for k in range(4)]
        forms += [b"%d %d " % (k + 1, n) + b" ".join(tokens[: cuts[k]] + [b"<*>"] + tokens[cuts[k + 1] :]) for k in range(3)]
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(f)) >> 63 else x for f in forms]


def _occurrences(depth: int, short: int):
    """(id, mark, text) to one row for each line and template; ``once`` at the template's first line in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks((b.select([0, 2, 1]) for b in batches), BLOCK_BYTES):
            keys, lines, rows, once, brief = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                seen: set[int] = set()
                for at, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n") if text else ()):
                    got = templates(line, depth, short)
                    for key in got:
                        keys.append(key)
                        lines.append(at)
                        rows.append(row)
                        once.append(key not in seen)
                        brief.append(len(got) == 1)
                        seen.add(key)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(np.array(lines, np.int32)), pa.array(once, pa.bool_()), pa.array(brief, pa.bool_())],
                ["template", "id", "mark", "line", "once", "brief"],
            )

    return run


def recurring_lines(docs: DataFrame, depth: int = DEPTH, short: int = SHORT, short_docs: int = SHORT_DOCS, many_docs: int = DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, lines array<int>): numbers, from 0, of the lines to drop; only documents that have some.

    A document is an id and the hash of its text (``mark``); rows that repeat both are one document. The first document
    of a template, by id and mark, keeps its lines.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    again = stage(own.groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "repeated")
    if not again.isEmpty():
        same = own["id"].eqNullSafe(again["id"]) & (own["mark"] == again["mark"])
        own = own.join(again, same, "left_anti").unionByName(own.join(again, same, "left_semi").dropDuplicates(["id", "mark"]))
    found = stage(own.mapInArrow(lean(_occurrences(depth, short)), "template long, id long, mark long, line int, once boolean, brief boolean"), "occurrences")
    whose = F.struct("id", "mark")
    known = found.groupBy("template").agg(F.sum(F.col("once").cast("int")).alias("docs"), F.min(whose).alias("first"), F.max(whose).alias("last"), F.first("brief").alias("brief"))
    known = known.where(F.col("docs") >= F.when(F.col("brief"), short_docs).otherwise(many_docs)).where("first is distinct from last")
    known = stage(known.select("template", "first"), "recurring")
    drop = found.select("template", "id", "mark", "line").join(known, "template").where("struct(id, mark) is distinct from first")
    return drop.groupBy("id", "mark").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _mask(lines: Column) -> Column:
    """Sorted line numbers as bytes, 1 at each of them and 0 before: a line is looked up at once, however many there are."""
    gap = lambda k: F.get(lines, k) - F.when(k == 0, 0).otherwise(F.get(lines, k - 1) + 1)
    parts = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.concat(F.repeat(F.lit("0"), gap(k)), F.lit("1")))
    return F.array_join(parts, "").cast("binary")


def drop_recurring(docs: DataFrame, keep_empty: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without recurring lines, all columns kept; documents of which nothing but blanks is left go as a whole.

    With ``keep_empty`` such documents stay, and columns __lines (number of lines, 0 for null) and __dropped (their
    numbers) follow. Null and empty texts stay as they are; blank lines are never dropped by themselves; texts of any
    length are one row; an empty table gives an empty result.
    """
    def work(own: DataFrame) -> DataFrame:
        lines = recurring_lines(own, **options).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("lines").alias("__dropped"), _mask(F.col("lines")).alias("__mask"))
        text = F.col("text").cast("string")
        both = own.join(lines, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
        split = F.split(text, "\n")
        left = F.array_join(F.filter(split, lambda _, i: F.substring(F.col("__mask"), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
        out = both.withColumn("__lines", F.when(text.isNull(), 0).otherwise(F.size(split))).withColumn("text", F.when(F.col("__dropped").isNull(), text).otherwise(left))
        if keep_empty:
            return out.select(*own.columns, "__lines", F.coalesce("__dropped", F.expr("cast(array() as array<int>)")).alias("__dropped"))
        gone = F.col("__dropped").isNotNull() & (F.trim(F.translate(F.col("text"), "\n\r\t", "   ")) == "")
        return out.where(~gone).select(*own.columns)

    return carrying(docs, id_col, text_col, work)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_empty=True)
    return found.select(
        "doc_id",
        F.col("__lines").cast("long").alias("n_lines"),
        F.size("__dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("__dropped").cast("array<string>"), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


OP1_SQL = rf"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
t as (select doc_id, pos, list_transform(list_filter(regexp_split_to_array(line, '[ \t\r\x0b\f]+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as w from l),
c as (select doc_id, pos, w, len(w) as n, {DEPTH} as d from t where len(w) > 0),
k as (select doc_id, pos, n, concat('0 ', n, ' ', array_to_string(w, ' ')) as tpl from c
  union all select doc_id, pos, n, concat(k + 1, ' ', n, ' ', array_to_string(list_concat(list_concat(w[1:d + (n - d) * k // 3], ['<*>']), w[d + (n - d) * (k + 1) // 3 + 1:]), ' ')) from c, (select unnest([0, 1, 2]) as k) where n >= {SHORT}),
r as (select tpl, min(doc_id) as first from k group by tpl having count(distinct doc_id) >= case when any_value(n) >= {SHORT} then {DOCS} else {SHORT_DOCS} end),
x as (select distinct doc_id, pos from k join r using (tpl) where doc_id <> first),
y as (select doc_id, count(*) as n_dropped, string_agg(cast(pos as varchar), ',' order by pos) as dropped from x group by doc_id),
z as (select l.doc_id, string_agg(line, chr(10) order by l.pos) as kept from l left join x on l.doc_id = x.doc_id and l.pos = x.pos where x.pos is null group by l.doc_id)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(n_dropped, 0) as bigint) as n_dropped, coalesce(dropped, '') as dropped, sha256(coalesce(kept, '')) as text_sha256
from documents d left join y using (doc_id) left join z using (doc_id)
"""
