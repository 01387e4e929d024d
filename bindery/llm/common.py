"""Shared helpers: scratch tables, text blocks, label samples, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at once.
BLOCK_BYTES = 4 << 20
#: Characters of a text that a model learns from at most.
SAMPLE_CHARS = 1 << 17
#: Values that a label column may have. More stop the job, as their counts go to the driver: no value is left out silently.
MOST_VALUES = 2000


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (tests) gets one made on this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or _local_scratch()
    return f"{base.rstrip('/')}/bindery-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stage(df: DataFrame, name: str, bucket: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    With ``bucket`` (column, number) later joins on that column need no shuffle of the table.
    """
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/{name}"
    out = df.write.format("parquet").option("compression", "zstd")
    if bucket is None:
        out.save(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"bindery_{uuid.uuid4().hex}"
    out.option("path", path).bucketBy(bucket[1], bucket[0]).saveAsTable(table)
    back = spark.table(table)
    back.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return back


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids (crc32 of the decimal text, modulo 5) that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def excerpt(text: Column, most: int, parts: int = 64) -> Column:
    """``text``, or of one over ``most`` characters that many, in ``parts`` parts spread evenly over its whole length.

    For samples that models learn from, so that their bytes are bounded as their rows are. Null stays null.
    """
    size = most // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, (F.floor(i.cast("double") * (F.length(text) - size) / (parts - 1)) + 1).cast("int"), F.lit(size)))
    return F.when(text.isNull() | (F.length(text) <= most), text).otherwise(F.array_join(cut, ""))


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose second column holds at most ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.maximum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False), 1), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Freed memory back to the system. Python workers live on and serve other stages, whose needs would add to what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a task's work on batches, with what it has freed given back at its end."""

    def work(*batches):
        yield from run(*batches)
        give_back()

    return work


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array (null: empty) and the offsets between texts."""
    raw = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def key_counts(rows: DataFrame, label: str, key: str) -> dict:
    """Distinct keys of each value of ``label``, nearly. More than MOST_VALUES values stop the job."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.approx_count_distinct(key, 0.02)).limit(MOST_VALUES + 1).collect()}
    if len(counts) > MOST_VALUES:
        raise ValueError(f"{label} has over {MOST_VALUES} values")
    return counts


def _shares(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``label``, by a hash of ``key``, each key once; counts are those of distinct keys."""
    counts = key_counts(rows, label, key)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / max(n, 1)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) / 1e6 < share).dropDuplicates([label, key])


def labelled_sample(docs: DataFrame, label: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """About ``most`` labelled rows of each label value, outside the held-out fifth, chosen by a hash of id and text.

    The share kept of each value follows from counts of distinct rows, so the sample stays as large however many rows there
    are, and however often an id or a row repeats. Written. Columns: id, text, label. Rows with a null id, text or label are left out; of texts over
    SAMPLE_CHARS there are parts spread over the whole length. A column of over MOST_VALUES values stops the job.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), excerpt(text, SAMPLE_CHARS).alias("text"), F.col(label).alias("label"), F.xxhash64(F.col(id_col), text).alias("mark"))
    return stage(_shares(rows, "label", "mark", most).select("id", "text", "label"), "sample")


def sampled_labels(labels: DataFrame, label: str, most: int, id_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of about ``most`` ids of each value 0 and 1 outside the held-out fifth, and the counts of all such ids.

    An id with several labels has its smallest. The rows are bounded by ``most``, so they may be broadcast.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    rows = rows.groupBy("id").agg(F.min("label").alias("label")).where(~held_out("id"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1e6 < share), counts


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of the sampled ``ids``, one row each: of an id with several texts that with the smallest hash, so that
    there are as many rows as ids however often one repeats. Of texts over SAMPLE_CHARS there are parts, as in ``labelled_sample``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), excerpt(text, SAMPLE_CHARS).alias("text"), F.xxhash64(text).alias("mark")).where("text is not null").join(F.broadcast(ids), "id")
    return rows.groupBy("id").agg(F.min_by(F.struct("text", "label"), "mark").alias("r")).select("id", "r.text", "r.label")


def column(name: str) -> Column:
    """A column by its whole name, whatever is in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def carrying(docs: DataFrame, id_col: str | None, text_col: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of a table (doc_id, text, rest), as a table with the columns of ``docs`` in their order.

    All other columns travel as fields of ``rest`` under numbers, so that no name that a caller's table has can clash with one that
    an operator makes. Without ``id_col`` the id is one of them. ``work`` returns the three columns and perhaps more, which follow.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.lit(0).alias("c"), *[column(c).alias(f"c{n}") for n, c in enumerate(others)])
    out = work(docs.select((column(id_col) if id_col else F.lit(None)).alias("doc_id"), column(text_col).alias("text"), rest.alias("rest")))
    of = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"rest.c{n}") for n, c in enumerate(others)}
    more = [c for c in out.columns if c not in ("doc_id", "text", "rest")]
    return out.select(*[of[c].alias(c) for c in docs.columns], *more)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, root), root the smallest node reached.

    Alternating large-star and small-star steps on (high, low) edges. Minima combine before their shuffle and are written,
    so that a join meets a hub's many edges with its one row straight from two exchanges, which AQE can split.
    Nodes without edges have no row. Loops and repeated edges are ignored.
    """
    def sides(df: DataFrame, u: str, v: str) -> DataFrame:
        return df.select(F.col(u).alias("u"), F.col(v).alias("v"))

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = stage(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = sides(now, "high", "low").unionByName(sides(now, "low", "high"))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        large = stage(large, "large")
        low = stage(large.groupBy("high").agg(F.min("low").alias("m")), "low")
        small = large.join(low, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = stage(small.unionByName(low.select("high", F.col("m").alias("low"))).distinct(), "small")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of ids, pairs (id, smallest id of its local component): as connected as the input, one per id at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
