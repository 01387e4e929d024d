"""Exact dedup through a cuckoo-filter index of the digests of live texts.

Digests are dealt to shards by a hash. A shard is a cuckoo filter, each of whose cells points to a stored key: the digest, the
length, how many live documents have the text and which of them stays. A digest whose fingerprint is in neither of its two
buckets is new; a hit is checked against the keys that its cells point to, since different digests may share a
fingerprint. Insertion moves fingerprints between their two buckets; if that doesn't end, the shard takes twice the buckets
and is filled again from its stored keys. A digest that no document has any more is deleted from its shard.

An index is four tables, written and read by shard, so that later documents are looked up, inserted and deleted without
reading old texts: a lookup reads filters, and stored keys for hits alone. Shards are as many as keep each small. Equal digests of a batch of rows are one
row before they are shuffled, so a text that fills a third of the table arrives at its shard as few rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import stage

#: Documents for which there is a shard.
SHARD_DOCS = 1 << 16
SLOTS, FIRST_BUCKETS, KICKS = 4, 64, 256
#: Digests with more documents than this, and than one in HOT_SHARE of all, go to every task in the last join: under HOT_SHARE rows.
HOT_DOCS, HOT_SHARE = 100_000, 10_000
#: What an event of a shard is, in the order in which a shard takes them.
STORED, DELETED, INSERTED = 0, 1, 2
KEY = "digest binary, size long, n long, id long, row long"


def places(digest: bytes, buckets: int) -> tuple[int, int, int]:
    """Fingerprint (never 0) and the two buckets of a digest; each bucket follows from the other and the fingerprint."""
    mark = int.from_bytes(digest[8:10], "little") or 1
    first = int.from_bytes(digest[:8], "little") & (buckets - 1)
    return mark, first, first ^ (mark * 0x9E3779B1 >> 7 & (buckets - 1))


class Shard:
    """A cuckoo filter whose cells point to stored keys."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.keys: list[list | None] = []
        self.live = self.resized = self.refuted = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.at = [0] * (SLOTS * buckets)

    def find(self, digest: bytes, size: int) -> int:
        """The cell of a live digest, -1 without one; hits are checked against the keys that the cells point to."""
        mark, one, two = places(digest, self.buckets)
        for bucket in (one, two) if one != two else (one,):
            for cell in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.marks[cell] == mark:
                    key = self.keys[self.at[cell]]
                    if key[0] == digest and key[1] == size:
                        return cell
                    self.refuted += 1
        return -1

    def _place(self, at: int) -> bool:
        mark, one, two = places(self.keys[at][0], self.buckets)
        for bucket in (one, two):
            for cell in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.marks[cell]:
                    self.marks[cell], self.at[cell] = mark, at
                    return True
        bucket = one
        for kick in range(KICKS):
            cell = SLOTS * bucket + kick % SLOTS
            mark, self.marks[cell] = self.marks[cell], mark
            at, self.at[cell] = self.at[cell], at
            bucket ^= mark * 0x9E3779B1 >> 7 & (self.buckets - 1)
            for cell in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.marks[cell]:
                    self.marks[cell], self.at[cell] = mark, at
                    return True
        return False

    def insert(self, digest: bytes, size: int, n: int, best: tuple) -> None:
        """``n`` more documents of a text; ``best`` is the (id, row) of theirs that would stay."""
        cell = self.find(digest, size)
        if cell >= 0:
            key = self.keys[self.at[cell]]
            key[2] += n
            key[3] = max(key[3], best, key=_rank)
            return
        self.keys.append([digest, size, n, best])
        self.live += 1
        placed = self._place(len(self.keys) - 1)
        while not placed:
            self.resized += 1
            self._clear(2 * self.buckets)
            placed = all(self._place(at) for at, key in enumerate(self.keys) if key)

    def delete(self, digest: bytes, size: int) -> bool:
        """Takes a live digest out; False if there is none."""
        cell = self.find(digest, size)
        if cell < 0:
            return False
        self.keys[self.at[cell]] = None
        self.marks[cell] = 0
        self.live -= 1
        return True


def _rank(best: tuple) -> tuple:
    """Largest id last, null before all, then the later row."""
    return best[0] is not None, best[0] or 0, best[1]


@dataclass(frozen=True)
class Index:
    """``documents`` (row, id, digest, size) that are live; ``keys`` (shard, digest, size, n, id, row) of their distinct texts with the
    document that stays; ``filters`` (shard, marks binary, live, resized); the number of shards, and of documents."""

    documents: DataFrame
    keys: DataFrame
    filters: DataFrame
    shards: int
    count: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, size), written: a number of its own for each row, SHA-256 and bytes of its text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return stage(own.select(F.monotonically_increasing_id().alias("row"), "id", "digest", "size"), "digests")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a batch as one row: how many, and the largest id with its last row."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by("row")
        order = pa.compute.sort_indices(rows, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start")
        got = rows.take(order).group_by(["digest", "size"], use_threads=False).aggregate([("row", "count"), ("id", "last"), ("row", "last")])
        got = got.select(["digest", "size", "row_count", "id_last", "row_last"]).rename_columns(["digest", "size", "n", "id", "row"])
        yield from got.combine_chunks().to_batches()


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(29)), F.lit(shards)).cast("int")


def _events(keys: DataFrame, kind: int, shards: int) -> DataFrame:
    return keys.select(_shard(shards).alias("shard"), F.lit(kind).alias("kind"), "digest", "size", "n", "id", "row")


def _inserted(rows: DataFrame, shards: int) -> DataFrame:
    return _events(rows.select("row", "id", "digest", "size").mapInArrow(_merged, KEY), INSERTED, shards)


EVENT = f"shard int, kind int, {KEY}"


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by shard and kind to each shard's keys, then one row (kind -1) with its filter: the marks as ``digest``, live
    keys as ``size``, resizes as ``n``."""
    now, number = None, None

    def done() -> Iterator[pa.RecordBatch]:
        keys = [k for k in now.keys if k]
        rows = [(number, STORED, k[0], k[1], k[2], *k[3]) for k in keys] + [(number, -1, now.marks.tobytes(), now.live, now.resized, None, None)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "kind", "digest", "size", "n", "id", "row"])

    for batch in batches:
        for shard, kind, digest, size, n, ident, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != number:
                if now:
                    yield from done()
                now, number = Shard(), shard
            if kind == DELETED:
                now.delete(digest, size)
            else:
                now.insert(digest, size, n, (ident, row))
    if now:
        yield from done()


def _maintained(events: DataFrame, documents: DataFrame, shards: int, count: int) -> Index:
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = stage(events.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_filled, EVENT), "index")
    filters = done.where("kind = -1").select("shard", F.col("digest").alias("marks"), F.col("size").alias("live"), F.col("n").alias("resized"))
    return Index(documents, done.where(f"kind = {STORED}").drop("kind"), filters, shards, count)


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, **columns) -> Index:
    """The index of all rows of ``docs``; ``columns`` are id_col and text_col."""
    rows = digests(docs, **columns)
    count = rows.count()
    shards = max(1, -(-count // shard_docs))
    return _maintained(_inserted(rows, shards), rows, shards, count)


def insert(index: Index, docs: DataFrame, **columns) -> Index:
    """``index`` with the rows of ``docs`` too, which count as later than those that it has."""
    new = digests(docs, **columns)
    last = index.documents.agg(F.max("row")).first()[0]
    new = new.withColumn("row", F.col("row") + F.lit(0 if last is None else last + 1))
    events = _events(index.keys, STORED, index.shards).unionByName(_inserted(new, index.shards))
    return _maintained(events, stage(index.documents.unionByName(new), "documents"), index.shards, index.count + new.count())


def delete(index: Index, ids: DataFrame, id_col: str = "doc_id") -> Index:
    """``index`` without the documents whose id is in ``ids``: their digests are deleted, and inserted again for what is left."""
    gone = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
    left = stage(index.documents.join(gone, "id", "left_anti").select("row", "id", "digest", "size"), "documents")
    hit = stage(index.documents.join(gone, "id", "left_semi").select("digest", "size").distinct(), "deleted")
    none = [F.lit(None).cast("long").alias(c) for c in ("n", "id", "row")]
    deleted = _events(hit.select("digest", "size", *none), DELETED, index.shards)
    again = _inserted(left.join(hit, ["digest", "size"], "left_semi"), index.shards)
    return _maintained(_events(index.keys, STORED, index.shards).unionByName(deleted).unionByName(again), left, index.shards, left.count())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its filter (kind -1) first, to those whose fingerprint the filter has."""
    marks, number = array("H"), None
    for batch in batches:
        keep = []
        for at, (shard, kind, digest) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if kind == -1:
                marks, number = array("H"), shard
                marks.frombytes(digest)
            elif shard == number:
                mark, one, two = places(digest, len(marks) // SLOTS)
                if mark in marks[SLOTS * one : SLOTS * one + SLOTS] or mark in marks[SLOTS * two : SLOTS * two + SLOTS]:
                    keep.append(at)
        yield batch.take(pa.array(keep, pa.int64()))


def lookup(index: Index, docs: DataFrame, **columns) -> DataFrame:
    """(id, digest, keep_id, found): whether the index has a text, and which of its documents stays; one row each of ``docs``.

    Filters answer for new texts; stored keys are read for hits alone.
    """
    rows = digests(docs, **columns)
    asked = _inserted(rows, index.shards).withColumn("kind", F.lit(INSERTED))
    own = index.filters.select("shard", F.lit(-1).alias("kind"), F.col("marks").alias("digest"), *[F.lit(None).cast("long").alias(c) for c in ("size", "n", "id", "row")])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = own.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe, EVENT)
    true = hits.select("shard", "digest", "size").distinct().join(index.keys.select("shard", "digest", "size", F.col("id").alias("keep_id")), ["shard", "digest", "size"]).drop("shard")
    return rows.join(stage(true.withColumn("found", F.lit(True)), "hits"), ["digest", "size"], "left").select("id", "digest", "keep_id", F.coalesce("found", F.lit(False)).alias("found"))


def decisions(index: Index) -> DataFrame:
    """(row, id, digest, size, keep_id, group_size, kept) of every live document; exactly one of a group of equal texts is kept.

    Documents meet their text's key in a join. Keys with very many documents, fewer than HOT_SHARE of them, go to every task.
    """
    keys = index.keys.select("digest", "size", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    limit = max(HOT_DOCS, index.count // HOT_SHARE)
    hot = stage(keys.where(F.col("group_size") > limit), "hot")
    on = ["digest", "size"]
    if hot.isEmpty():
        both = index.documents.join(keys, on)
    else:
        cold = index.documents.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col("group_size") <= limit), on)
        both = index.documents.join(F.broadcast(hot), on).unionByName(cold)
    return both.select("row", "id", "digest", "size", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def dedup(docs: DataFrame, **columns) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): every row of ``docs``, dropped ones too.

    Texts are equal if their bytes are; a null text is an empty one, texts of any length are read whole. Of equal texts the row
    with the largest id stays, null ids last, and of rows that repeat that id one stays. An empty table gives an empty one;
    other columns are ignored.
    """
    return decisions(build(docs, **columns)).select("id", "keep_id", "group_size", "kept", "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are, whatever their names.

    Of rows that repeat id and text, one stays, whichever.
    """
    kept = decisions(build(docs, id_col=id_col, text_col=text_col)).where("kept").select("id", "digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    packed = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("r"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = packed.join(kept.withColumnsRenamed({"id": "i", "digest": "d"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    return own.dropDuplicates(["digest"]).select("r.*")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
 doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256 from d
"""
