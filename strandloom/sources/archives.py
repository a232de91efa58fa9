"""Text corpora in zip archives, read by a Python data source: a partition is a run of members of an archive, and their lines are streamed.

The driver reads the archives' directories only. A member is decompressed as it is read, so neither archive nor member needs to fit in memory. Files are opened
through pyarrow's file systems, so paths may be local or URIs of a store that these know.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that are one partition, as archives often hold very many small ones, and of a member that is a partition of its own.
PARTITION_BYTES, LARGE_BYTES = 16 << 20, 1 << 20
#: Lines of an Arrow batch, and their bytes at most (or one longer line).
BATCH_LINES, BATCH_BYTES = 10_000, 4 << 20


def _opened(path: str):
    files, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return files, at


def archives_under(path: str) -> list[str]:
    """The archive itself, or all archives below a folder, by suffix and in order of name."""
    files, at = _opened(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(head + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".zip"))


@dataclass
class Members(InputPartition):
    """Those from start to before stop of an archive's members with the suffix."""

    archive: str
    start: int
    stop: int


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def _listed(self, z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [i for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)]

    def partitions(self) -> list[Members]:
        out = []
        for archive in archives_under(self.path):
            files, at = _opened(archive)
            with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                start, size, large = 0, 0, False
                for k, info in enumerate(listed := self._listed(z)):
                    if k > start and (large or info.file_size >= LARGE_BYTES or size + info.file_size > PARTITION_BYTES):
                        out.append(Members(archive, start, k))
                        start, size = k, 0
                    size, large = size + info.file_size, info.file_size >= LARGE_BYTES
                if listed:
                    out.append(Members(archive, start, len(listed)))
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Members):
            return  # an empty corpus has one empty partition
        files, at = _opened(partition.archive)
        with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
            rows, size = [], 0
            for info in self._listed(z)[partition.start : partition.stop]:
                with z.open(info) as member:
                    for number, line in enumerate(io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="\n")):
                        rows.append((info.filename, number, line.removesuffix("\n").removesuffix("\r")))
                        size += len(line)
                        if len(rows) >= BATCH_LINES or size >= BATCH_BYTES:
                            yield self._batch(partition.archive, rows)
                            rows, size = [], 0
            if rows:
                yield self._batch(partition.archive, rows)

    @staticmethod
    def _batch(archive: str, rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        members, numbers, lines = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array(members, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "line_no", "value"])


class ZipCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_corpus"

    def schema(self) -> str:
        return "archive string, member string, line_no long, value string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_zip(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, line_no, value) of the members with the suffix."""
    spark.dataSource.register(ZipCorpus)
    return spark.read.format("zip_corpus").option("suffix", suffix).load(path)


def write_zip(lines: DataFrame, path: str, member: str = "member", value: str = "value", archives: int = 8) -> int:
    """Writes the lines as members of at most so many archives under path, a member whole in one, in any order of its lines; gives the number of archives.

    An archive gets its name when it is complete, so a task that is tried again leaves one.
    """
    files, at = _opened(path)
    files.create_dir(at, recursive=True)

    def run(batches):
        task, open_, entry, last = TaskContext.get(), None, None, None
        beside = f"{at}/.{task.partitionId()}-{task.taskAttemptId()}.part"
        for got in batches:
            for name, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if open_ is None:
                    raw = files.open_output_stream(beside)
                    open_ = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                if name != last:
                    if entry:
                        entry.close()
                    entry, last = open_.open(name, "w", force_zip64=True), name
                entry.write((text or "").encode() + b"\n")
        if open_ is not None:
            entry.close()
            open_.close()
            raw.close()
            done = f"{at}/part-{task.partitionId():05d}.zip"
            files.move(beside, done)
            yield pa.RecordBatch.from_arrays([pa.array([done])], names=["archive"])

    rows = lines.select(F.col(member).cast("string").alias("member"), F.col(value).alias("value")).repartition(archives, "member").sortWithinPartitions("member")
    return rows.mapInArrow(run, "archive string").count()
