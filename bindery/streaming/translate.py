"""Translation of segments that arrive over time, with a memory that is asked once for each text, and live progress."""

from __future__ import annotations

import threading
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from bindery.functions.text import SPACES
from bindery.operators.translate import Backend, translate_packed

MEMORY = "src string, dst string, text string, translated string, error string"
#: Name of the counts that a translating stream reports.
COUNTS = "translation"


def misses(segments: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, text, key) of a stream: each text when it comes first, never again.

    The state is a hash by language pair and text, kept in the stream's checkpoint and dealt by that hash; a text that is on every page
    is one entry. Blank and null texts are never sent.
    """
    named = segments.where(F.btrim("text", F.lit(SPACES)) != "").select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), "text")
    return named.withColumn("key", F.sha2(F.to_json(F.struct("src", "dst", "text")), 256)).dropDuplicates(["key"])


def stream_translate(segments: DataFrame, backend: Backend, src: str, dst: str, out: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Sends what ``segments`` (a stream with text) has that was never sent before, and adds it to the memory under ``out``.

    A micro-batch is written under its number and replaced if it is run again. Texts whose batch failed are in the memory with
    an error; ``send_again`` takes those. Counts of texts and bytes are reported as COUNTS while the stream runs.
    """

    def each(batch: DataFrame, number: int) -> None:
        dealt = batch.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        done = translate_packed(dealt, backend, src, dst, ["bucket"], "key")
        done.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), "text", "translated", "error").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    new = misses(segments, src, dst).observe(COUNTS, F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    return new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory(spark: SparkSession, out: str) -> DataFrame:
    """What the streams under ``out`` have of each text: a translation if any batch gave one, else its error."""
    try:
        rows = spark.read.schema(f"{MEMORY}, batch long").parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MEMORY)
    best = F.max_by(F.struct("translated", "error"), F.struct(F.col("error").isNull(), "batch"))
    return rows.groupBy("src", "dst", "text").agg(best.alias("b")).select("src", "dst", "text", "b.translated", "b.error")


def send_again(spark: SparkSession, backend: Backend, src: str, dst: str, out: str, buckets: int = 16) -> DataFrame:
    """Sends what failed once more, adds it to the memory, and returns the memory as it is then."""
    open_ = memory(spark, out).where((F.col("src") == src) & (F.col("dst") == dst) & F.col("error").isNotNull()).select("text")
    dealt = open_.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets)))
    done = translate_packed(dealt, backend, src, dst, ["bucket"], "text")
    last = spark.read.schema(f"{MEMORY}, batch long").parquet(out).agg(F.max("batch")).first()[0] or 0
    # behind all numbers that a stream gives, which start at 0 and rise by 1
    done.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), "text", "translated", "error").write.parquet(f"{out.rstrip('/')}/batch={max(last, 1 << 40) + 1}")
    return memory(spark, out)


class Progress(StreamingQueryListener):
    """Counts of a running stream as rate and time left, for ``spark.streams.addListener``.

    ``total`` is the number of bytes that there are to do, if known. ``now`` may be read at any time: texts, bytes, bytes a second, seconds
    left (None if unknown), and whether the stream has ended; ``seen`` has all reports so far.
    """

    def __init__(self, total: int | None = None, counts: str = COUNTS):
        self.total, self.counts, self.began = total, counts, time.time()
        self.seen: list[dict] = []
        self.ended = threading.Event()

    @property
    def now(self) -> dict:
        return self.seen[-1] if self.seen else {"texts": 0, "bytes": 0, "rate": 0.0, "left": None}

    def onQueryStarted(self, event) -> None:
        self.began = time.time()

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.counts)
        if row is not None:
            texts, size = self.now["texts"] + row["texts"], self.now["bytes"] + row["bytes"]
            rate = size / max(time.time() - self.began, 1e-9)
            self.seen.append({"texts": texts, "bytes": size, "rate": rate, "left": max(self.total - size, 0) / rate if self.total is not None and rate else None})

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
