"""Byte-level BPE encoding and decoding through one global table of distinct words.

Texts are cut into pre-tokens; each block of texts keeps its pre-tokens' positions as indexes into the block's own list
of distinct words. The words of all blocks meet by hash in one shuffle, where each distinct word is encoded once; the ids
are joined back to the blocks, and every block's texts are put together by position. Positions never travel with the
words, so a frequent word costs one entry per block and no key is hot. Words and positions are shuffled as packed binary
columns, one row for each block and word bucket.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import give_back, lean, stage, text_blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Text bytes of a block: its word list is held by one task.
BLOCK_BYTES = 8 << 20
#: A vocabulary file over this is refused, as it goes to every task.
MOST_RANK_BYTES = 64 << 20

_ROWS = "block long, bucket int, head binary, body binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        raw = f.read(MOST_RANK_BYTES + 1)
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as compressed byte planes."""
    v = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<Q", len(values)) + v.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(raw, np.uint8, offset=8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "bucket", "head", "body"])


def _by_times(times: np.ndarray) -> np.ndarray:
    """Word numbers from the most frequent on. Positions hold ranks in this order: small numbers, which pack well, and the
    order follows from the counts, so it need not travel."""
    return np.argsort(-times.astype(np.int64), kind="stable")


def _cutter(buckets: int):
    """(id, text) rows to a block's rows: for each word bucket how often its words occur, and the words; in bucket -1, by
    parts of the block, the ids of the texts with their numbers of words, and the words' ranks by position."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(public_tokenizers.PATTERN).findall
        words: dict[str, int] = defaultdict(count().__next__)
        parts: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().int >> 65
            raw = [w.encode() for w in words]
            to = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in raw], np.int64)
            by = np.argsort(to, kind="stable")  # words are numbered by bucket; how often each occurs goes with them
            times = sum((np.bincount(seq, minlength=len(words)) for _, _, seq in parts), np.zeros(len(words), np.int64))
            rank = np.empty(len(words), np.uint32)
            rank[by[_by_times(times[by])]] = np.arange(len(words))
            for ids, n, seq in parts:
                yield _batch([(block, -1, _heads(ids, n), _pack(rank[seq]))])
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            z = zstandard.ZstdCompressor(level=1)
            for b in range(buckets):
                if (at := by[ends[b] : ends[b + 1]]).size:
                    own = [raw[i] for i in at]
                    head = _pack(np.concatenate([times[at].astype(np.uint32), np.array([len(w) for w in own], np.uint32)]))
                    yield _batch([(block, b, head, z.compress(b"".join(own)))])
            words.clear()
            words.default_factory = count().__next__
            parts.clear()

        for batch in text_blocks(batches, 1 << 20):
            texts = batch.column(1).to_pylist()
            seqs = []
            for text in texts:
                got = cut(text) if text else ()
                seqs.append(np.fromiter(map(words.__getitem__, got), np.uint32, len(got)))
            size += batch.column(1).nbytes
            parts.append((batch.column(0), [len(s) for s in seqs], np.concatenate(seqs)))
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
        if parts:
            yield from flush()

    return cut_texts


def _heads(ids: pa.Array, n: list[int]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.record_batch([ids.cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n"])
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _coder(ranks: dict[bytes, int]):
    """A bucket's rows, words replaced by the ids: the head keeps the words' counts and gets their numbers of ids."""

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[1] != bucket:
                    known, bucket = {}, row[1]
                head = _unpack(row[2]).reshape(2, -1)
                body = zstandard.ZstdDecompressor().decompress(row[3])
                ends = np.cumsum(head[1], dtype=np.int64).tolist()
                ids, n, a = [], [], 0
                for b in ends:
                    word = body[a:b]
                    if (got := known.get(word)) is None:
                        got = known[word] = one(word.decode())
                    ids += got
                    n.append(len(got))
                    a = b
                yield _batch([(row[0], row[1], _pack(np.concatenate([head[0], np.array(n, np.uint32)])), _pack(np.array(ids, np.uint32)))])

    return encode_words


def _assembler(table: dict[int, bytes] | None):
    """A block's word rows with ids and its text rows to (id, token_ids) of each text; with a token-byte table, the bytes
    of each word's ids are joined from it and the texts' bytes follow as ``decoded``."""

    def put_together(coded: pa.Table, cut: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint32)
        rows = sorted(zip(*(coded.column(c).to_pylist() for c in ("bucket", "head", "body")), strict=True))
        heads = [_unpack(h).reshape(2, -1) for _, h, _ in rows]
        order = _by_times(np.concatenate([none, *(h[0] for h in heads)]))
        n = np.concatenate([none, *(h[1] for h in heads)]).astype(np.int64)
        flat = np.concatenate([none, *(_unpack(b) for _, _, b in rows)]).astype(np.int32)
        starts, lens = (np.cumsum(n) - n)[order], n[order]
        del rows, heads
        words: list[bytes] = []
        if table is not None:
            pieces = [table[i] for i in flat.tolist()]
            words = [b"".join(pieces[a : a + k]) for a, k in zip(starts.tolist(), lens.tolist(), strict=True)]
            del pieces
        out = []
        for head, body in zip(cut.column("head").to_pylist(), cut.column("body").to_pylist(), strict=True):
            texts = pa.ipc.open_stream(head).read_all()
            seq, to = _unpack(body), 0
            for row in range(0, texts.num_rows, 256):
                own = texts.slice(row, 256)
                sizes = np.cumsum(own.column(1).to_numpy())
                part = seq[to : to + sizes[-1]]
                to += len(part)
                k = lens[part]
                ends = np.cumsum(k)
                ids = flat[np.repeat(starts[part] - ends + k, k) + np.arange(ends[-1] if len(ends) else 0)]
                cuts = np.concatenate([[0], ends])[np.concatenate([[0], sizes])]
                columns = [own.column(0).combine_chunks(), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))]
                if table is not None:
                    said = part.tolist()
                    bounds = [0, *sizes.tolist()]
                    columns.append(pa.array([b"".join(map(words.__getitem__, said[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()))
                out.append(pa.RecordBatch.from_arrays(columns, names))
        del words, order, flat, starts, lens
        give_back()
        return pa.Table.from_batches(out, pa.schema([("id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())][: len(names)]))

    names = ["id", "token_ids"] + ["decoded"] * (table is not None)
    return put_together


def _run(docs: DataFrame, ranks_path: str | None, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    ranks = read_ranks(ranks_path or public_tokenizers.path(RANKS))
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.rdd.getNumPartitions()))
    cut = stage(own.mapInArrow(lean(_cutter(2 * n)), _ROWS), "pretokens", bucket=("block", n))
    words = cut.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_coder(ranks)), _ROWS)
    # the table is bucketed by block: positions stay where they are, only the words' ids come to them
    put = _assembler({i: b for b, i in ranks.items()} if decoded else None)
    done = words.groupBy("block").cogroup(cut.where("bucket < 0").groupBy("block")).applyInArrow(put, "id long, token_ids array<int>" + ", decoded binary" * decoded)
    return done.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` (long, null allowed) and ``token_ids`` array<int>.

    Each match of the public pattern is encoded alone by the ranks, without special tokens. Null and empty texts have no
    ids; repeated rows and ids stay as they are; other columns are ignored; an empty table gives an empty result. A text
    of any length is one row; its word list is part of its block.
    """
    return _run(docs, ranks_path, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``decoded`` (binary): the ids' bytes, joined from the token-byte table once for each word of a block."""
    return _run(docs, ranks_path, id_col, text_col, True)


def decode(encoded: DataFrame, ranks_path: str | None = None, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col`` (binary): the bytes of its ids, joined from the token-byte table.

    The table has one row per token of a vocabulary file of checked size and goes to every task. Null ids give null, no
    ids no bytes; an id outside the table stops the job.
    """
    table = {i: b for b, i in read_ranks(ranks_path or public_tokenizers.path(RANKS)).items()}

    @F.arrow_udf("binary")
    def to_bytes(ids: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(ids), 64):
            some = ids.slice(at, 64)
            flat = some.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum(some.fill_null([]).value_lengths().to_numpy()).tolist()
            out += [b"".join(map(table.__getitem__, flat[a:b])) if ok else None for a, b, ok in zip([0, *ends], ends, some.is_valid().to_pylist(), strict=False)]
        return pa.array(out, pa.binary())

    return encoded.withColumn(out_col, to_bytes(F.col(ids_col)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
