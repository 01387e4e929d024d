"""Files that arrive over time, ingested once each by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bindery.operators.books import pending, with_key
from bindery.sources.ingest import ingest, read_corpus, write_run

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """All files under ``path`` that ``out`` doesn't have yet, then stops (trigger availableNow). ``read_corpus`` reads ``out``.

    A micro-batch is one run: its tables become visible together, by one entry of the log under its number. One that fails
    between two tables is never seen; one that is run again takes the place of its first run; files whose key another batch
    has are left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        files = with_key(batch.select("path", "content"))
        seen = read_corpus(spark, out, but=number)
        for name in ("books", "rejects"):
            files = pending(files, seen[name], ["book_id"])
        write_run(ingest(files.select("path", "content")), out, number)

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    stream = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).load(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
