"""Translation of segments: memory, batches for a backend, prompts, retries and quality checks.

A backend is any ``Callable[[list[str], str, str], list[str]]`` (texts, source code, target code), plain text in and out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from bindery.functions.text import duration, echoes, is_echo, language_name, utrim
from bindery.operators.pack import BATCH_BYTES, packing, starts
from bindery.sources.staging import staged

Backend = Callable[[list[str], str, str], list[str]]
USD_PER_MILLION, ASK_BYTES, ECHO_PASSES = 20.0, 1000, 2
RETRIES, FIRST_WAIT = 3, 1.0
#: Pieces that batches are dealt to where calls are bounded.
PIECES = 32


class BackendError(Exception):
    """A refusal with a status code; 429, 500 and above are tried again, as is anything that carries no code."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retry(backend: Backend, n: int = RETRIES, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Backend:
    """``backend`` with up to ``n`` more tries after 1, 2, 4 ... times ``wait`` seconds."""

    def run(texts: list[str], src: str, dst: str) -> list[str]:
        for again in range(n + 1):
            try:
                return backend(texts, src, dst)
            except Exception as e:
                status = getattr(e, "status", None)
                if again == n or (status is not None and status != 429 and status < 500):
                    raise
                sleep(wait * 2**again)
        raise AssertionError

    return run


def char_count(segments: DataFrame, book: list[str]) -> DataFrame:
    """(book, bytes) of translatable text."""
    return segments.groupBy(*book).agg(F.sum(F.octet_length("text")).alias("bytes"))


def cost_estimate(segments: DataFrame, book: list[str], usd_per_m: float = USD_PER_MILLION, ask_bytes: int = ASK_BYTES) -> DataFrame:
    """(book, segments, distinct_segments, bytes, distinct_bytes, cost_usd, distinct_cost_usd, needs_approval).

    Repeats are counted per text first, so a text that fills a book costs one row in the second shuffle.
    """
    texts = segments.groupBy(*book, "text").agg(F.count("*").alias("n")).withColumn("b", F.octet_length("text").cast("long"))
    sums = texts.groupBy(*book).agg(F.sum("n").alias("segments"), F.count("*").alias("distinct_segments"), F.sum(F.col("n") * F.col("b")).alias("bytes"), F.sum("b").alias("distinct_bytes"))
    usd = lambda c: F.col(c) / 1e6 * usd_per_m
    return sums.withColumns({"cost_usd": usd("bytes"), "distinct_cost_usd": usd("distinct_bytes"), "needs_approval": F.col("bytes") > ask_bytes})


def dedup_segments(segments: DataFrame, tm: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, text): each text once, without those that the memory (src, dst, text, translated) has."""
    own = segments.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), "text").distinct()
    return own.join(tm.select("src", "dst", "text"), ["src", "dst", "text"], "left_anti")


def tm_stats(segments: DataFrame, tm: DataFrame, book: list[str], src: str, dst: str) -> DataFrame:
    """(book, segments, distinct_segments, hits, hit_rate): how much the memory already has."""
    known = tm.where((F.col("src") == src) & (F.col("dst") == dst)).select("text").distinct().withColumn("hit", F.lit(1))
    texts = segments.groupBy(*book, "text").agg(F.count("*").alias("n")).join(known, "text", "left")
    sums = texts.groupBy(*book).agg(F.sum("n").alias("segments"), F.count("*").alias("distinct_segments"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits"))
    return sums.withColumn("hit_rate", F.col("hits") / F.col("segments"))


def prompt_of(texts: Column, src: Column, dst: Column) -> Column:
    """One numbered prompt for an array of texts."""
    head = F.concat(F.lit("Translate each line from "), language_name(src), F.lit(" to "), language_name(dst), F.lit(PROMPT_RULES))
    return F.concat(head, F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t, F.lit("\n"))), ""))


#: What a model is told besides the languages.
PROMPT_RULES = """. Answer with one numbered line for every line below, under the same number, and with nothing else.
Translate all of a line, quotations included.

"""


def build_prompts(batches: DataFrame, batch: list[str], src: str, dst: str) -> DataFrame:
    """(batch, n, prompt) from (batch, item_no, text)."""
    own = batches.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("item_no", "text"))).alias("ts"))
    return own.select(*batch, F.size("ts").alias("n"), prompt_of(F.col("ts.text"), F.lit(src), F.lit(dst)).alias("prompt"))


def parse_reply(reply: Column, n: Column) -> Column:
    """Array of ``n`` texts from ``N. text`` lines: numbers out of range are dropped, the last of equal ones wins, missing
    ones are empty."""
    pattern = r"(?md)^\s*(\d+)\.\s*(.+)$"
    lines = F.arrays_zip(F.regexp_extract_all(reply, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(reply, F.lit(pattern), 2).alias("v"))
    of = lambda i: F.filter(lines, lambda x: x["k"].try_cast("int") == i)
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(utrim(F.try_element_at(of(i), F.lit(-1))["v"]), F.lit(""))))


def _calls(backend: Backend, src: str, dst: str, batch: list[str]):
    """Arrow batches sorted by ``batch`` to the same with translated and error; one call a batch, over the borders of what Spark
    hands over at once."""

    def call(rows: pa.Table) -> pa.Table:
        try:
            got, error = backend(rows.column("text").to_pylist(), src, dst), None
            if len(got) != rows.num_rows:
                raise BackendError(f"{len(got)} texts for {rows.num_rows}")
        except Exception as e:  # noqa: BLE001  a backend's failure is data here
            got, error = [None] * rows.num_rows, f"{type(e).__name__}: {e}"
        return rows.append_column("translated", pa.array(got, pa.string())).append_column("error", pa.array([error] * rows.num_rows, pa.string()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in parts:
            rows = pa.Table.from_batches([part])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            at = np.flatnonzero(starts(rows, batch)).tolist()
            done = [call(rows.slice(s, t - s)) for s, t in zip(at, at[1:], strict=False)]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
            rest = rows.slice(at[-1])
        if rest is not None:
            yield from call(rest).combine_chunks().to_batches()

    return run


_ANSWER = [StructField("translated", StringType()), StructField("error", StringType())]


def translate(batches: DataFrame, backend: Backend, src: str, dst: str, batch: list[str], order: str, parallel: int | None = None, pieces: int = PIECES) -> DataFrame:
    """(batch, order, text, translated, error) from (batch, order, text): one call per batch, its texts in order.

    ``batch`` names all columns that make a batch, such as a page and its batch_no. A failing batch has an error and no
    translations, others go on. Write the result before it is used twice.

    ``parallel`` bounds the calls at a time: batches are dealt to ``pieces``, and these are sent in rounds of so many tasks, each round written
    before the next, at once and not when the result is asked for. So a backend that takes one call at a time still gets
    many small tasks, and a lost one repeats a piece.
    """
    names = list(dict.fromkeys([*batch, order, "text"]))
    dealt = batches.select(*names)
    schema = StructType([*dealt.schema.fields, *_ANSWER])
    send = _calls(backend, src, dst, batch)
    if not parallel:
        return dealt.repartition(*batch).sortWithinPartitions(*batch, order).mapInArrow(send, schema)
    held = staged(dealt.withColumn("__piece", F.pmod(F.xxhash64(*batch), F.lit(max(pieces, parallel))).cast("int")), "pieces")
    done = []
    for first in range(0, max(pieces, parallel), parallel):
        own = held.where(F.col("__piece").between(first, first + parallel - 1)).repartition(parallel, "__piece").sortWithinPartitions(*batch, order).select(*names)
        done.append(staged(own.mapInArrow(send, schema), f"round-{first}"))
    return reduce(DataFrame.unionByName, done)


def translate_packed(segments: DataFrame, backend: Backend, src: str, dst: str, part: list[str], order: str = "seq", limit: int = BATCH_BYTES) -> DataFrame:
    """(part, order, text, batch_no, translated, error): segments packed into batches of at most ``limit`` bytes within ``part`` and sent
    on as they are packed, in one pass after one shuffle."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = segments.select(*dict.fromkeys([*part, order, "text"]), F.octet_length("text").alias("__size")).repartition(n, *part).sortWithinPartitions(*part, order)
    schema = StructType([*sized.schema.fields, StructField("batch_no", IntegerType()), *_ANSWER])
    pack, send = packing(part, "__size", limit, "batch_no"), _calls(backend, src, dst, [*part, "batch_no"])
    return sized.mapInArrow(lambda rows: send(pack(rows)), schema).drop("__size")


def retry_echoes(done: DataFrame, backend: Backend, src: str, dst: str, passes: int = ECHO_PASSES) -> DataFrame:
    """``done`` (text, translated, error and more) with tries: texts that came back unchanged or empty are asked for again one
    by one, at most ``passes`` times, in the task that holds them; the last answer that isn't an echo stays."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            texts, got, errors = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("text", "translated", "error"))
            tries = [0] * len(texts)
            open_ = [i for i, (t, o, e) in enumerate(zip(got, texts, errors, strict=True)) if e is None and echoes(t, o)]
            for _ in range(passes):
                before = len(open_)
                for i in open_:
                    tries[i] += 1
                    try:
                        answer = backend([texts[i]], src, dst)[0]
                    except Exception:  # noqa: BLE001  the first answer stays
                        continue
                    if not echoes(answer, texts[i]):
                        got[i] = answer
                open_ = [i for i in open_ if echoes(got[i], texts[i])]
                if len(open_) == before or not open_:
                    break
            columns = dict(zip(rows.schema.names, rows.columns, strict=True)) | {"translated": pa.array(got, pa.string()), "tries": pa.array(tries, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return done.mapInArrow(run, StructType([*done.schema.fields, StructField("tries", IntegerType())]))


def translation_metrics(done: DataFrame, key: list[str], seconds: Column) -> DataFrame:
    """(key, total, done, failed, bytes, rate, eta) of translated texts: ``rate`` in bytes a second, ``eta`` what the texts
    that failed would take at that rate. ``seconds`` is how long the work took, a column of ``key``."""
    size = F.octet_length("text").cast("long")
    ok = F.col("error").isNull()
    sums = done.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~ok, size)), F.lit(0)).alias("open"))
    rate = F.col("bytes") / seconds
    return sums.select(*key, "total", "done", "failed", "bytes", rate.alias("rate"), F.when(F.col("bytes") > 0, duration(F.floor(F.col("open") / rate).cast("double"))).alias("eta"))


def observed(done: DataFrame, watch: Observation) -> DataFrame:
    """``done`` unchanged; once it has been written, ``watch`` holds texts, failed and bytes, counted on the way."""
    return done.observe(watch, F.count(F.lit(1)).alias("texts"), F.count("error").alias("failed"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def with_titles(segments: DataFrame, books: DataFrame) -> DataFrame:
    """(kind, text): segments and book titles for one memory."""
    return segments.select(F.lit("segment").alias("kind"), "text").unionByName(books.where(utrim(F.col("title")) != "").select(F.lit("title").alias("kind"), F.col("title").alias("text")))


def translate_titles(books: DataFrame, tm: DataFrame) -> DataFrame:
    """Books with title_translated: the memory's, else the title."""
    known = tm.where("translated is not null and translated <> ''").groupBy("text").agg(F.min("translated").alias("__t"))
    return books.join(known, books["title"] == known["text"], "left").withColumn("title_translated", F.coalesce("__t", "title")).drop("__t", "text")


def page_status(segments: DataFrame, done: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """(key, segments, failed, status): ``ok`` if all of a page's segments came back, ``original`` if none did, else ``partial``.

    ``done`` has (key, seq, error), one row for each segment that was sent; those that never were have failed. Each segment is
    judged by what became of itself, whatever became of the same text elsewhere.
    """
    names = [*key, seq]
    sent = done.select(*names, F.col("error").isNull().cast("int").alias("__ok")).groupBy(*names).agg(F.max("__ok").alias("__ok"))
    own = segments.select(*names).join(sent, names, "left").groupBy(*key).agg(F.count("*").alias("segments"), F.count_if(F.coalesce("__ok", F.lit(0)) == 0).alias("failed"))
    return own.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("failed") < F.col("segments"), "partial").otherwise("original"))


def echo_report(done: DataFrame) -> DataFrame:
    """(texts, echoes, errors) in one row."""
    return done.agg(F.count("*").alias("texts"), F.count_if(is_echo(F.coalesce("translated", F.lit("")), F.col("text"))).alias("echoes"), F.count("error").alias("errors"))
