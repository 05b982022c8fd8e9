"""Landed payload files as a Spark data source: ``spark.read.format("feed")`` and ``spark.readStream.format("feed")``.

A row for each file: source (the option of that name), payload, query_rank, request_pos, label, file and landed_at. The
folder columns are those of ``feeds.read_landing``, so ``normalize.payload_leads`` takes the rows of any registered
source, in batch and per micro-batch. Files are listed and read through pyarrow's file systems (local paths and URIs);
for other stores there is ``feeds.read_landing``.

Files are dealt out in input partitions of at most ``partitionBytes`` bytes (at least one file each). The stream's offset
is (modification time, path): a batch holds the files after the last offset, so a restarted query goes on where it
stopped. A file must not appear with a time before that of files already read; ``settleSeconds`` holds back files
younger than that where writers need longer.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source string, payload string, query_rank int, request_pos int, label string, file string, landed_at timestamp"
_ARROW = pa.schema(
    [
        ("source", pa.string()), ("payload", pa.string()), ("query_rank", pa.int32()), ("request_pos", pa.int32()),
        ("label", pa.string()), ("file", pa.string()), ("landed_at", pa.timestamp("us", "UTC")),
    ]
)
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class LandedFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files  # path, modification time in ns


def _hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def folder_values(path: str) -> dict[str, str | None]:
    """``name=value`` folders of a path, decoded."""
    parts = (p.split("=", 1) for p in path.split("/")[:-1] if "=" in p)
    return {k: None if v == NO_VALUE else unquote(v) for k, v in parts}


class _Landing:
    """What batch and stream share: the listing, the partitions, the rows."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("load(path): the landing folder is missing")
        self.path, self.source = options["path"], options.get("source")
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.settle = float(options.get("settleSeconds", 0))

    def _system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1))
        return fs.LocalFileSystem(), self.path

    def listed(self) -> list[tuple[int, str, int]]:
        """(modification time, path, bytes) of all files, in that order."""
        system, root = self._system()
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        before = time.time_ns() - int(self.settle * 1e9)
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos if i.is_file and not _hidden(i.path) and (i.mtime_ns or 0) <= before)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[LandedFiles]:
        out, held = [], 0
        for when, path, size in files:
            if not out or held + size > self.partition_bytes:
                out.append(LandedFiles([]))
                held = 0
            out[-1].files.append((path, when))
            held += size
        return out

    def rows(self, partition: LandedFiles | None) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        for path, when in partition.files if partition else ():  # Spark asks once where nothing is listed
            with system.open_input_stream(path) as f:
                payload = f.read().decode("utf-8", "replace")
            named = folder_values(path)
            number = lambda k: int(named.get(k) or 0)
            row = {
                "source": self.source, "payload": payload, "query_rank": number("query_rank"), "request_pos": number("request_pos"),
                "label": named.get("label", ""), "file": path, "landed_at": when // 1000,
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.landing.dealt(self.landing.listed())

    def read(self, partition: LandedFiles) -> Iterator[pa.RecordBatch]:
        return self.landing.rows(partition)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def initialOffset(self) -> dict:
        return {"mtime": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.landing.listed()
        return {"mtime": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((o["mtime"], o["path"]) for o in (start, end))
        return self.landing.dealt([f for f in self.landing.listed() if low < f[:2] <= high])

    def read(self, partition: LandedFiles) -> Iterator[pa.RecordBatch]:
        return self.landing.rows(partition)


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)
