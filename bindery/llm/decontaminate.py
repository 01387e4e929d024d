"""Benchmark decontamination by a prefix-filtered join of word windows.

The words of the benchmark are ranked by how rare they are in the documents. Of each item window only its rarest word is
needed as a prefix, since a contained window shares all its words. A document window goes on if it lies in a run of
benchmark words at least as long as the window (length bound) and its own rarest word is a prefix at the same offset
(positional bound); what is left is verified word by word. The index goes to every task in parts of checked size; each
part is one more pass over the documents, of which only keys and spans of hit texts are written, so it can grow without
limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from bindery.llm.common import carrying, lean, stage, text_blocks

WINDOW = 13
#: Benchmark words that one pass indexes, in bytes; as windows they take about ten times that in every task.
MOST_INDEX_BYTES = 8 << 20

#: Bytes of words: 0-9, a-z (A-Z lowered) and all of code points from 128 on; other bytes are blanks.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """The lowered words of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _counter(words: frozenset[bytes]):
    """Texts to (word, times) of those words, once for each task."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(words)}
        times = np.zeros(len(words) + 1, np.int64)
        for batch in text_blocks(batches):
            for text in batch.column(1).to_pylist():
                got = split_words(text)
                times += np.bincount(np.fromiter(map(number.get, got, repeat(len(words))), np.int64, len(got)), minlength=len(times))
        at = np.flatnonzero(times[:-1])
        own = list(number)
        yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in at], pa.binary()), pa.array(times[at])], ["word", "times"])

    return count_words


class Windows:
    """The item windows of one part of the benchmark, under their rarest words: sorted rows of ranks, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], times: dict[bytes, int], size: int):
        words = sorted({w for _, ws in items for w in ws}, key=lambda w: (times.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        lengths: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, ws in items:
            ids = np.array([self.rank[w] for w in ws], np.int32)
            n = min(size, len(ids))
            lengths.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[item]))
        # by length: distinct windows, where the items of each begin, the items, and the prefixes
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in lengths.items():
            rows = np.concatenate([w for w, _ in own])
            flat = self._flat(rows + 1)
            pairs = np.unique(np.rec.fromarrays([flat, np.repeat([k for _, k in own], [len(w) for w, _ in own]).astype(np.int32)], names="w,i"))
            known, first = np.unique(pairs["w"], return_index=True)
            keys = np.unique(rows.min(1).astype(np.int64) * 64 + rows.argmin(1))
            self.of[n] = known, np.append(first, len(pairs)), pairs["i"].copy(), keys

    @staticmethod
    def _flat(rows: np.ndarray) -> np.ndarray:
        """Each row as one value of bytes, which sort and compare as a whole."""
        return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * rows.shape[1]}").ravel() if rows.size else np.zeros(0, f"S{4 * rows.shape[1]}")

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence in a sequence of ranks, -1 where a word is in no window."""
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, (windows, first, items, prefixes) in self.of.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] == known[:-n])
            if not len(starts):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)[starts]
            keys = rows.min(1).astype(np.int64) * 64 + rows.argmin(1)
            fits = prefixes[np.minimum(np.searchsorted(prefixes, keys), len(prefixes) - 1)] == keys
            asked = self._flat(rows[fits] + 1)
            at = np.minimum(np.searchsorted(windows, asked), len(windows) - 1)
            same = windows[at] == asked
            for start, k in zip(starts[fits][same].tolist(), at[same].tolist(), strict=True):
                yield start, start + n, [self.names[i] for i in items[first[k] : first[k + 1]]]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _finder(windows: Windows, all_rows: bool):
    """(id, text, more columns) to (id, more columns, n_words, spans, items); without ``all_rows`` only of texts that are hit."""

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            ranks, sizes = [], []
            for text in batch.column(1).to_pylist():
                got = split_words(text)
                sizes.append(len(got))
                ranks.append(np.fromiter(map(windows.rank.get, got, repeat(-1)), np.int32, len(got)))
                ranks.append(np.array([-1], np.int32))  # no window reaches into the next text
            ends = np.cumsum(np.array(sizes, np.int64) + 1)
            spans, items = [[] for _ in sizes], [[] for _ in sizes]
            for start, end, got in windows.find(np.concatenate(ranks)):
                row = int(np.searchsorted(ends, start, side="right"))
                base = int(ends[row]) - sizes[row] - 1
                own = spans[row]
                if own and start - base <= own[-1]["end"] and start - base >= own[-1]["start"]:
                    own[-1]["end"] = max(own[-1]["end"], end - base)
                else:
                    own.append({"start": start - base, "end": end - base})
                items[row] += got
            spans, items = [_merged(x) for x in spans], [sorted(set(x)) for x in items]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                ["id", *batch.schema.names[2:], "n_words", "spans", "items"],
            )
            yield out if all_rows else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return find_windows


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _pieces(window: int, most: int):
    """(item, text) to (item, words) in pieces of about ``most`` bytes that share all but one word of a window, so that every
    window of an item stands whole in one of them."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                step = max(1, most // (1 + max(map(len, words), default=1)))
                for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    items.append(item)
                    pieces.append(b" ".join(words[at : at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], ["item", "words"])

    return cut_items


def _parts(docs: DataFrame, benchmark: DataFrame, window: int, most: int, text_col: str, item_col: str) -> Iterator[Windows]:
    """The index of each part of the benchmark; a part's words take ``most`` bytes at most, about."""
    known = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    pieces = stage(known.mapInArrow(_pieces(window, max(64, most // 64)), "item string, words binary").distinct(), "pieces")
    size = pieces.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16)).first()[0] or 0
    parts = max(1, -(-size // most))
    texts = docs.select(F.lit(0), F.col(text_col).cast("string").alias("text"))
    for part in range(parts):
        rows = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()
        items = [(r["item"], bytes(r["words"]).split()) for r in rows]
        words = frozenset(w for _, ws in items for w in ws)
        times = texts.mapInArrow(lean(_counter(words)), "word binary, times long").groupBy("word").agg(F.sum("times").alias("times")).collect() if words else []
        yield Windows(items, {bytes(r["word"]): r["times"] for r in times}, window)


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _union(spans: pa.Array) -> pa.Array:
    return pa.array([_merged(x) if x is not None else None for x in spans.to_pylist()], _SPANS)


def _more(docs: DataFrame, parts: Iterator[Windows], text_col: str, key: dict[str, Column]) -> DataFrame | None:
    """(key, spans, items) of texts that later parts hit: their hits are written and united; texts themselves never are."""
    own = docs.select(F.lit(0).alias("zero"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in key.items()])
    kinds = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in key)
    hits = [stage(own.mapInArrow(_finder(w, False), f"id int, {kinds}, {_FOUND}").drop("id", "n_words").distinct(), "hits") for w in parts]
    if not hits:
        return None
    both = reduce(DataFrame.unionByName, hits).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"))
    return stage(both, "united")


def _scanned(docs: DataFrame, benchmark: DataFrame, carried: Column, window: int, most: int, text_col: str, item_col: str) -> DataFrame:
    """(id, __text, n_words, spans, items) per row, ``carried`` as id.

    The first part's pass goes over the rows themselves. Of further parts only keys and spans of hit texts are kept, and
    joined to the rows by the hash of the text.
    """
    parts = _parts(docs, benchmark, window, most, text_col, item_col)
    text = F.col(text_col).cast("string")
    own = docs.select(carried.alias("id"), text.alias("text"), text.alias("__text"), F.xxhash64(text).alias("mark"))
    out = own.mapInArrow(lean(_finder(next(parts), True)), StructType([own.schema["id"], *StructType.fromDDL(f"__text string, mark long, {_FOUND}")]))
    more = _more(docs, parts, text_col, {"mark": F.xxhash64(text), "size": F.octet_length(text)})
    if more is None:
        return out
    out = out.withColumn("size", F.octet_length("__text")).join(more, ["mark", "size"], "left")
    none = "cast(array() as array<string>)"
    return out.select("id", "__text", "n_words", _union(F.concat("spans", F.coalesce("more_spans", F.slice("spans", 1, 0)))).alias("spans"), F.array_sort(F.array_union("items", F.coalesce("more_items", F.expr(none)))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_index_bytes: int = MOST_INDEX_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, spans (merged word spans inside item windows), items (sorted ids as text).

    Null and empty texts have no words, spans or items. Items with a null id or without words are left out; equal item
    ids count once. An empty benchmark hits nothing; an empty table gives an empty result. Ids of documents may be null
    or repeated; other columns are ignored. Documents are never shuffled.
    """
    out = _scanned(docs, benchmark, F.col(id_col).cast("long"), window, most_index_bytes, text_col, item_col)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_index_bytes: int = MOST_INDEX_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with all columns, without the rows of which a twentieth of the words or more lies in item windows.

    Null and empty texts stay, as do null and repeated ids and repeated rows: each row is judged by its own text. Texts of any
    length are read whole; an empty benchmark drops nothing; an empty table gives an empty result.
    """
    def work(own: DataFrame) -> DataFrame:
        out = _scanned(own, benchmark, F.struct("rest"), window, most_index_bytes, "text", item_col).where(~contaminated())
        return out.select(F.lit(None).alias("doc_id"), F.col("__text").alias("text"), F.col("id.rest").alias("rest"))

    # rows are judged by their texts alone, so every other column is carried
    return carrying(docs, None, text_col, work)


def n_hit() -> Column:
    """Number of words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.end - s.start))


def contaminated() -> Column:
    """A twentieth of the words or more is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP5_SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
i as (select item_id, w, least(len(w), 13) as n from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as t from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from i)),
occurs as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from i) where len(w) >= n)),
hit as (select doc_id, item_id, p, occurs.n from occurs join win using (n, t)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p, p + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""
