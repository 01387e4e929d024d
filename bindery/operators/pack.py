"""Ordered items into groups of bounded size, oversized pages into parts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from bindery.functions import markup
from bindery.functions.text import html_body
from bindery.operators.ranks import numbered
from bindery.operators.tokens import per_page
from bindery.sources.staging import staged

PAGE_BYTES, BATCH_BYTES, BATCH_ITEMS = 5000, 5000, 20


def greedy_groups(sizes: Iterable[int], limit: int) -> Iterator[int]:
    """Group numbers from 0: a group is closed when it holds an item and the next one would take it over the limit."""
    group, total, held = 0, 0, False
    for size in sizes:
        if held and total + size > limit:
            group, total = group + 1, 0
        yield group
        total, held = total + size, True


def starts(rows: pa.Table, part: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before it, and at the first; null and NaN keys are keys like others."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in part:
        codes = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def packing(part: list[str], size: str, limit: int, name: str = "group_no", carried: tuple[str, str] | None = None):
    """Arrow batches sorted by ``part`` to the same with the group's number in ``name``; no group is held whole.

    ``carried`` names columns with the group that is open where a key starts, and what it holds; null if none is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, total, held = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            new = starts(rows, part)
            new[0] = [repr(rows.column(c)[0].as_py()) for c in part] != last
            out = np.empty(rows.num_rows, np.int32)
            for i, (fresh, s) in enumerate(zip(new.tolist(), rows.column(size).fill_null(0).to_pylist(), strict=True)):
                if fresh:
                    group, total = [rows.column(c)[i].as_py() for c in carried] if carried else (None, 0)
                    held = group is not None
                    group, total = group or 0, total or 0
                if held and total + s > limit:
                    group, total = group + 1, 0
                out[i], total, held = group, total + s, True
            last = [repr(rows.column(c)[-1].as_py()) for c in part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return run


class Piece(NamedTuple):
    """What packing a run of items does to the group that is open before it.

    ``total`` is the run's size. A group that holds ``t`` is closed by the first item with which it is over the limit, the one
    whose prefix sum is the first in ``reach`` over ``limit - t``; from there on it doesn't matter what was before: at the
    run's end the open group holds ``exits`` and ``groups`` more groups have begun. Without an open group, ``alone`` and ``begun``.
    """

    total: int
    reach: np.ndarray
    exits: np.ndarray
    groups: np.ndarray
    alone: int
    begun: int


def summary(sizes: np.ndarray, limit: int) -> Piece:
    """Each item's next group start by binary search in prefix sums, the chains of starts by pointer doubling."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    after = np.maximum(np.searchsorted(sums[1:], sums[:-1] + limit, side="right"), np.arange(1, n + 1))
    # at each start: where the chain stands after 1, 2, 4 ... steps, the end being n; last is the last start before the end
    jump, steps = np.append(after, n), np.append((after < n).astype(np.int64), 0)
    last = np.arange(n + 1)
    while True:
        far = jump < n
        if not far.any():
            break
        last[far] = last[jump[far]]
        steps[far] += steps[jump[far]]
        jump[far] = jump[jump[far]]
    exits, groups = sums[n] - sums[last[:n]], steps[:n]
    own = np.flatnonzero((sums[1:] > sums[:-1]) & (sums[:-1] <= limit))  # an item closes a group only if it has a size; at most limit + 1
    return Piece(int(sums[n]), sums[1:][own], exits[own], groups[own], int(exits[0]) if n else 0, int(groups[0]) if n else 0)


def after(piece: Piece, group: int | None, total: int, limit: int) -> tuple[int, int]:
    """The group that is open behind a run, and what it holds, from those before it (None: none is open)."""
    if group is None:
        return piece.begun, piece.alone
    if total > limit:  # an oversized item stands alone, whatever follows
        return group + 1 + piece.begun, piece.alone
    at = int(np.searchsorted(piece.reach, limit - total, side="right"))
    if at == len(piece.reach):
        return group, total + piece.total
    return group + 1 + int(piece.groups[at]), int(piece.exits[at])


def _summaries(part: list[str], size: str, limit: int):
    """Sorted rows (__range, part, size) to the summaries of the first and the last key of each range: others lie within it."""
    names = ["__range", *part]

    def row(key: pa.Table, sizes: list[np.ndarray]) -> pa.RecordBatch:
        p = summary(np.concatenate(sizes), limit)
        arrays = [pa.array([p.total]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (p.reach, p.exits, p.groups)], pa.array([p.alone]), pa.array([p.begun])]
        return pa.RecordBatch.from_arrays([*[c.chunk(0) for c in key.combine_chunks().columns], *arrays], [*names, *Piece._fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, first, last = None, [], True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            now = [repr(rows.column(c)[0].as_py()) for c in names]
            cuts = np.flatnonzero(starts(rows, names)).tolist()
            cuts = cuts if now != last else cuts[1:]
            whole = rows.column(size).fill_null(0).cast(pa.int64()).to_numpy()
            sizes.append(whole[: cuts[0] if cuts else None])
            # no cut at all: the batch goes on with the key of the one before it
            for s, t in zip(cuts, [*cuts, rows.num_rows][1:], strict=True):
                new = rows.slice(s, 1).select(names)
                if key is not None:
                    over = key.column("__range")[0] != new.column("__range")[0]
                    if first or over:
                        yield row(key, sizes)
                    first = over
                key, sizes = new, [whole[s:t]]
            last = [repr(rows.column(c)[-1].as_py()) for c in names]
        if key is not None:
            yield row(key, sizes)

    return run


def greedy_pack(df: DataFrame, part: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Adds group_no. A group is closed when it holds an item and the next one would take it over the limit.

    Rows are dealt by ranges of (part, order), so that a key of any size is packed in several tasks. What a range does to the
    group that is open before it is a short table; these tables are applied one after another for keys that lie in several ranges,
    and each range is then packed from what it starts with. Null and NaN keys are keys like others; a null size counts as
    nothing, negative sizes are not allowed.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["__range", *part]
    ranged = staged(df.repartitionByRange(n, *part, order).withColumn("__range", F.spark_partition_id()), "ranged")
    keys = [ranged.schema[c] for c in names]
    longs = ArrayType(LongType())
    kinds = [LongType(), longs, longs, longs, LongType(), LongType()]
    sorted_ = ranged.select(*names, order, size).repartition(n, "__range").sortWithinPartitions(*names, order)
    pieces = sorted_.mapInArrow(_summaries(part, size, limit), StructType([*keys, *[StructField(f, k) for f, k in zip(Piece._fields, kinds, strict=True)]]))

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__range")
        group, total, out = None, 0, []
        for p in rows.select(list(Piece._fields)).to_pylist():
            out.append((group, total))
            group, total = after(Piece(*[np.array(v) if isinstance(v, list) else v for v in p.values()]), group, total, limit)
        carried = [pa.array([o[k] for o in out], t) for k, t in ((0, pa.int32()), (1, pa.int64()))]
        return pa.Table.from_arrays([*[rows.column(c) for c in names], *carried], [*names, "__group", "__held"])

    carry = pieces.groupBy(*part).applyInArrow(fold, StructType([*keys, StructField("__group", IntegerType()), StructField("__held", LongType())])).where("__group is not null")
    # one row a range at most: those of a key's later pieces
    carry = staged(carry.select(*[F.col(c).alias(f"__c{k}") for k, c in enumerate(names)], "__group", "__held"), "carry")
    same = F.col("__range") == F.col("__c0")
    for k, c in enumerate(part, 1):
        same = same & F.col(c).eqNullSafe(F.col(f"__c{k}"))
    both = ranged.join(F.broadcast(carry), same, "left").select(*df.columns, "__range", "__group", "__held")
    schema = StructType([*both.schema.fields, StructField("group_no", IntegerType())])
    done = both.repartition(n, "__range").sortWithinPartitions(*names, order).mapInArrow(packing(names, size, limit, carried=("__group", "__held")), schema)
    return done.select(*df.columns, "group_no")


def batch_by_bytes(segments: DataFrame, part: list[str], limit: int = BATCH_BYTES, order: str = "seq") -> DataFrame:
    """Segments with batch_no, batches of at most ``limit`` bytes unless one segment alone is larger."""
    sized = segments.withColumn("__size", F.octet_length("text"))
    return greedy_pack(sized, part, order, "__size", limit).drop("__size").withColumnRenamed("group_no", "batch_no")


def batch_corpus(segments: DataFrame, buckets: int, limit: int = BATCH_BYTES) -> DataFrame:
    """Distinct texts with (bucket, batch_no): batches across pages, dealt by a hash so that no window spans the corpus."""
    texts = segments.select("text").distinct().withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int"))
    return batch_by_bytes(texts, ["bucket"], limit, "text")


def batch_by_count(segments: DataFrame, part: list[str], n: int = BATCH_ITEMS, order: str = "seq") -> DataFrame:
    """Segments with batch_no (from 0) and item_no (from 1): ``n`` in a batch."""
    row = F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1
    return segments.withColumn("__row", row).withColumn("batch_no", F.floor(F.col("__row") / n).cast("int")).withColumn("item_no", (F.col("__row") % n + 1).cast("int")).drop("__row")


_HEAD = re.compile(r"(?is)<head(?=[ \t\n\f\r/>])[^>]*+>.*?</head\s*+>")


def split_pages(pages: DataFrame, key: list[str], limit: int = PAGE_BYTES, html: str = "html") -> DataFrame:
    """(key, chunk from 1, html): pages over ``limit`` bytes of text in parts, each with the head; others as they are.

    A page is cut in the task that holds it, so none is shuffled. A page whose body has no block stays whole; null pages have no
    row.
    """
    both = pages.select(*key, F.struct(F.col(html).alias("page"), html_body(F.col(html)).alias("body")).alias("__both"))

    def parts(page: str, body: str) -> Iterator[tuple[int, str]]:
        found = list(markup.blocks(body))  # all of a body's text is in its blocks
        if sum(size for _, size in found) <= limit:
            yield 1, page
            return
        head = m.group() if (m := _HEAD.search(page)) else ""
        groups = greedy_groups((size for _, size in found), limit)
        for group, own in groupby(zip(groups, found, strict=True), key=lambda x: x[0]):
            yield group + 1, f"<!DOCTYPE html>\n<html>\n{head}\n<body>\n{''.join(part for _, (part, _) in own)}\n</body>\n</html>\n"

    return per_page(both, key, F.col("__both"), {"chunk": IntegerType(), "html": StringType()}, lambda b: parts(b["page"], b["body"]) if b["page"] is not None else ())


def rebuild_manifest(manifest: DataFrame, spine: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, spine and (book_id, added) after splitting; ``chunks`` has (book_id, item_id, chunk).

    Items outside the spine come first; part 1 keeps id and name, part i gets ``_s{i}``.
    """
    inside = spine.select("book_id", F.col("idref").alias("item_id"), "spine_pos")
    parts = manifest.join(inside, ["book_id", "item_id"]).join(chunks, ["book_id", "item_id"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(1)))
    suffix = F.when(F.col("chunk") > 1, F.concat(F.lit("_s"), F.col("chunk").cast("string"))).otherwise("")
    href = F.when(F.col("chunk") > 1, F.concat(F.regexp_replace("href", r"\.[^./]*$", ""), suffix, F.lit(".html"))).otherwise(F.col("href"))
    parts = parts.select("book_id", "spine_pos", "chunk", F.concat("item_id", suffix).alias("item_id"), href.alias("href"), F.when(F.col("chunk") > 1, "text/html").otherwise(F.col("media_type")).alias("media_type"))
    new_spine = numbered(parts.select("book_id", "spine_pos", "chunk", "item_id"), ["book_id"], ["spine_pos", "chunk"], number="pos").select("book_id", F.col("pos").cast("int").alias("spine_pos"), F.col("item_id").alias("idref"))
    rest = manifest.join(inside, ["book_id", "item_id"], "left_anti").select("book_id", F.lit(0).alias("k"), F.col("pos").alias("a"), F.lit(0).alias("chunk"), "item_id", "href", "media_type")
    both = rest.unionByName(parts.select("book_id", F.lit(1).alias("k"), F.col("spine_pos").alias("a"), "chunk", "item_id", "href", "media_type"))
    new_manifest = numbered(both, ["book_id"], ["k", "a", "chunk"], number="pos").select("book_id", F.col("pos").cast("int").alias("pos"), "item_id", "href", "media_type")
    return new_manifest, new_spine, parts.groupBy("book_id").agg(F.count_if(F.col("chunk") > 1).alias("added"))
