"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of any m segments, so they share a bucket
of one of the tables keyed by m - radius segments; nothing is missed. Within a bucket the bit planes stand vertically, a
word holding one bit of 64 fingerprints: distances of many fingerprints are counted at once by carry-save adders, and
queries whose lanes all exceed the radius are abandoned. Buckets over a chunk are compared by pairs of chunks in separate
tasks. Links become local spanning forests before they leave a task, and components follow from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import carrying, components, forest, lean, stage, text_blocks

WORDS, RADIUS = 4, 4
#: Fingerprints of a bucket that one comparison holds at most, twice.
CHUNK = 2048
#: Tables get more segments while the mean bucket is over this.
MEAN_BUCKET = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints_of(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """A 64-bit fingerprint for each text: bits set in over half of its shingles' hashes."""
    hashed, sizes = [], []
    digest = xxhash.xxh64_digest
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not own:
            sizes.append(0)
            continue
        line = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = (ends - np.fromiter(map(len, own), np.int64, len(own)) - 1).tolist()
        k = min(words, len(own)) - 1
        ends = (ends - 1)[k:].tolist()
        hashed += [digest(line[a:b], 42) for a, b in zip(starts, ends, strict=False)]
        sizes.append(len(ends))
    out = np.zeros((len(texts), 8), np.uint8)
    at = 0
    flat = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8)
    for row, n in enumerate(sizes):
        if n:
            set_in = np.zeros(64, np.int64)
            for a in range(at, at + n, 1 << 16):
                set_in += np.unpackbits(flat[a : min(at + n, a + (1 << 16))], axis=1).sum(0, dtype=np.int64)
            out[row] = np.packbits(2 * set_in > n)
            at += n
    return out.view(">u8").astype(np.uint64).ravel()


def _fingerprint(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1 << 20):
            fp = fingerprints_of(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    return run


def fingerprint(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """(id, fp long) per row. Null, empty and blank texts have fingerprint zero; fewer words than ``words`` are one shingle.

    With ``mark`` the hash of the text follows.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.xxhash64(text).alias("mark")] * mark)
    return own.mapInArrow(lean(_fingerprint(words)), "id long, fp long" + ", mark long" * mark)


def tables(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one per table, for ``n`` fingerprints: any two within the radius agree under one mask at least."""
    m = radius + 1
    while m < 2 * radius and n / 2 ** (64 * (m - radius) / m) > MEAN_BUCKET and comb(m + 1, radius) <= 80:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    segments = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(segments[i] for i in keep) for keep in combinations(range(m), m - radius)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """(groups, lanes) fingerprints, lanes a multiple of 64, to bit planes (64, groups, lanes / 64)."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(*fps.shape, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64)


def near(queries: np.ndarray, group: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) pairs of each query and its group's valid lanes within the radius."""
    levels = max(1, int(radius).bit_length())
    rows = np.arange(len(queries))
    count = [np.zeros((len(rows), planes.shape[2]), np.uint64) for _ in range(levels)]
    over = ~valid[group]
    for bit in range(64):
        flip = np.where((queries[rows] >> np.uint64(bit)) & np.uint64(1), _ALL, np.uint64(0))[:, None]
        carry = planes[bit][group[rows]] ^ flip
        for c in count:  # carry-save: each level takes the carry of the one below
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if bit % 8 == 7:
            dead = over | _exceeds(count, radius)
            alive = (dead != _ALL).any(1)
            if not alive.all():
                rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
            if not len(rows):
                break
    hit = ~(over | _exceeds(count, radius))
    q, word = np.nonzero(hit)
    lanes = np.unpackbits(np.ascontiguousarray(hit[q, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(lanes)
    return rows[q[i]], word[i] * 64 + lane


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _ALL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _links(fps: np.ndarray, ids: np.ndarray, side: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids within the radius, for consecutive groups of rows; sides 0 and 1 are compared with each other, 2 with itself."""
    sizes = np.diff(bounds)
    width = -(-sizes // 64)
    for w in np.unique(width):
        of = np.flatnonzero((width == w) & (sizes > 1))
        step = max(1, 8192 // int(w * 64))
        for at in range(0, len(of), step):
            own = of[at : at + step]
            n = sizes[own]
            where = np.repeat(bounds[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            group = np.repeat(np.arange(len(own)), n)
            lane = where - bounds[own][group]
            padded = np.zeros((len(own), w * 64), np.uint64)
            padded[group, lane] = fps[where]
            ok = np.zeros((len(own), w * 64), np.uint8)
            ok[group, lane] = side[where] != 0
            valid = np.packbits(ok, axis=1, bitorder="little").view(np.uint64)
            planes = _planes(padded)
            asks = np.flatnonzero(side[where] != 1)
            for a in range(0, len(asks), max(64, (1 << 18) // int(w))):
                some = asks[a : a + max(64, (1 << 18) // int(w))]
                q, to = near(fps[where[some]], group[some], planes, valid, radius)
                x, y = ids[where[some[q]]], ids[bounds[own][group[some[q]]] + to]
                keep = x != y
                if keep.any():
                    yield x[keep], y[keep]


def _compare(radius: int):
    """Rows (unit, side, fp, id) sorted by unit: edges (a, b) of the units' forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            unit, side, fp, ids = parts
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
            pairs = list(_links(fp.view(np.uint64), ids, side, bounds, radius))
            if pairs:
                a, b = forest(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                yield from edges([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield from edges(rest)

    return run


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all ``nodes`` (fp long, distinct; id long) as the pairs within ``radius`` bits do."""
    spark = nodes.sparkSession
    masks = tables(nodes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", "id", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    large = stage(keyed.groupBy("t", "key").count().where(F.col("count") > chunk).select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "large")
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("byte")
    # rows of two buckets under one 64-bit unit are compared too, which adds no false link
    units = dealt.select(F.xxhash64("t", "key", low, high).alias("unit"), side.alias("side"), "fp", "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(lean(_compare(radius)), "a long, b long")


def _leaders(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, leader): the least leader over all ``nodes`` (fp long, distinct; leader, may be null) that links reach.

    Links join fingerprints, not ids: an id that stands for two texts links neither.
    """
    found = components(links(nodes.select("fp", F.col("fp").alias("id")), radius))
    rooted = stage(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "leader", "root"), "rooted")
    least = stage(rooted.where("root is not null").groupBy("root").agg(F.min("leader").alias("leader")), "leaders")
    linked = rooted.where("root is not null").select("fp", "root").join(least, "root").select("fp", "leader")
    return stage(linked.unionByName(rooted.where("root is null").select("fp", "leader")), "led")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, fp (long) and component_id, the smallest id reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits, exactly. Equal texts share a fingerprint and are one node, so
    copies are never paired. Rows with a null id are never the smallest; a component of none but those has a null
    component_id. Ids may repeat; other columns are ignored; an empty table gives an empty result.
    """
    own = stage(fingerprint(docs, words, id_col, text_col), "fingerprints")
    led = _leaders(stage(own.groupBy("fp").agg(F.min("id").alias("leader")), "nodes"), radius)
    return own.join(led, "fp").select(F.col("id").alias(id_col), "fp", F.col("leader").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", keep_null_ids: bool = True) -> DataFrame:
    """``docs`` with all columns, one row of each component: the one with the smallest id, then the smallest text hash.

    A document is an id and its text, so an id that repeats with another text stands for two. Rows with a null id all
    stay, unless ``keep_null_ids`` is false: then they are documents like others, after those with an id.
    """
    def work(rows: DataFrame) -> DataFrame:
        own = stage(fingerprint(rows, words, mark=True), "fingerprints")
        counted = F.lit(not keep_null_ids) | F.col("id").isNotNull()
        first = F.min(F.when(counted, F.struct(F.col("id").isNull().alias("none"), "id", "mark")))
        led = _leaders(stage(own.groupBy("fp").agg(first.alias("leader")), "nodes"), radius)
        stays = F.col("id").eqNullSafe(F.col("leader.id")) & (F.col("mark") == F.col("leader.mark"))
        goes = stage(own.where(counted).join(led, "fp").where(~stays).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "removed")
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mark"))
        left = rows.join(goes, same, "left_anti")
        again = stage(own.where(counted).groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).count().where("count > 1").drop("count"), "repeated")
        if again.isEmpty():
            return left
        once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        return left.join(again, same, "left_anti").unionByName(once)

    return carrying(docs, id_col, text_col, work)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
