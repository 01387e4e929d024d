"""Archives as a Spark data source: rows of entries, read by runs of entries, so that no archive is whole anywhere."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bindery.operators.books import ENTRY_BYTES

SCHEMA = "path string, entry string, content binary, truncated boolean, error string"
#: Unpacked bytes that make a run of entries, and packed bytes of small archives that go together.
RUN_BYTES = 128 << 20


class Run(InputPartition):
    """Archives with the entries to read of each: from one number up to another, or all (None)."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        self.parts = parts


def checked(name: str, data: bytes) -> bytes:
    """Entries that a package is read from must be well-formed, so that no later query meets broken XML."""
    if name.lower().endswith((".opf", "container.xml")):
        ET.fromstring(data)
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...], run_bytes: int):
        self.path, self.suffixes, self.run_bytes = path, suffixes, run_bytes

    def _listed(self) -> list[tuple[str, int]]:
        fs, path = FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (FileSystem.from_uri("file:///")[0], self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(path, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.path.lower().endswith(self.suffixes))

    def _open(self, path: str):
        fs = FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else FileSystem.from_uri("file:///")[0]
        return fs.open_input_file(path)

    def partitions(self) -> list[Run]:
        """Small archives go together and are opened by the task that reads them; of a large one the directory at its end is read
        here, and its entries are cut into runs."""
        runs: list[Run] = []
        small: list[tuple[str, int, int | None]] = []
        held = 0
        for path, size in self._listed():
            if size <= self.run_bytes:
                if small and held + size > self.run_bytes:
                    runs.append(Run(small))
                    small, held = [], 0
                small.append((path, 0, None))
                held += size
                continue
            try:
                with self._open(path) as raw, zipfile.ZipFile(raw) as z:
                    sizes = [i.file_size for i in z.infolist()]
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                runs.append(Run([(path, 0, None)]))  # the task reports it
                continue
            first, total = 0, 0
            for n, s in enumerate(sizes):
                if n > first and total + s > self.run_bytes:
                    runs.append(Run([(path, first, n)]))
                    first, total = n, 0
                total += min(s, ENTRY_BYTES)
            runs.append(Run([(path, first, len(sizes))]))
        if small:
            runs.append(Run(small))
        return runs

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string())
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["path", "entry", "content", "truncated", "error"])
        for path, first, end in run.parts:
            try:
                with self._open(path) as raw, zipfile.ZipFile(raw) as z:
                    for info in z.infolist()[first:end]:
                        if not info.is_dir():
                            with z.open(info) as f:
                                data = f.read(ENTRY_BYTES + 1)
                            yield one(path, info.filename, checked(info.filename, data[:ENTRY_BYTES]), len(data) > ENTRY_BYTES, None)
            except pa.ArrowInvalid:  # too short to have a directory
                yield one(path, None, None, False, "BadZipFile: File is not a zip file")
            except Exception as e:  # noqa: BLE001  a broken archive is a row of rejects
                yield one(path, None, None, False, f"{type(e).__name__}: {e}")


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: (path, entry, content, truncated, error), one row an entry, in any order.

    Options: ``suffixes`` (default ``.epub,.zip``) and ``runBytes``. An archive or entry that cannot be read is a row with an error, besides
    the entries that could.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], tuple(self.options.get("suffixes", ".epub,.zip").lower().split(",")), int(self.options.get("runbytes", self.options.get("runBytes", RUN_BYTES))))


def read_archives(spark: SparkSession, path: str, suffixes: str = ".epub,.zip", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Entries of all archives under ``path``, which is local or of a kind that pyarrow's file systems open (``s3://``, ``gs://``,
    ``hdfs://``). Where only Spark's readers reach, ``ingest`` of ``read_files`` opens archives from their rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("suffixes", suffixes).option("runBytes", str(run_bytes)).load(path)
