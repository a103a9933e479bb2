"""JSON-lines data sources for ``spark.read.format`` and ``readStream``.

``star_reviews`` reads review files (text, stars), ``feedback_log`` the feedback
log. Every line gives a row: its fields, ``broken`` (no JSON object, or a field
of another kind), and its identity, the ``file`` and the byte ``position`` where
the line begins, which tells equal lines apart. Blank lines give no row; fields that a line lacks are null.

A batch read cuts files into splits of ``splitBytes``, wherever the lines end: a
split owns the lines that begin in it. Splits are read by the tasks, block by
block, and handed over as Arrow batches. A stream reads whole files: an offset
is the set of files seen, each once, so files must appear complete (as Spark's
own writers make them) and stay; a batch takes all that are new.

Options: ``path`` (a file or folder; any URL that pyarrow knows), ``splitBytes``
(64 MB), ``suffix`` (only files so named; else all but hidden ones). A missing
path has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, InputPartition)
from pyspark.sql.types import StructType

BLOCK = 1 << 20  # bytes read together
ROWS = 10_000  # of an Arrow batch
KINDS = {"string": str, "double": (int, float), "bigint": int, "boolean": bool}
ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
IDENTITY = "broken boolean, file string, position bigint"


@dataclass
class Split(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        super().__init__(None)
        self.file, self.start, self.end = file, start, end


def _opened(path: str):
    """(file system, path on it) of a URL or a plain local path."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str = "") -> dict[str, int]:
    """The files below a path and their sizes, hidden ones left out."""
    from pyarrow import fs
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    below = lambda p: p[len(root):].split("/")
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)
            and not any(part.startswith(("_", ".")) for part in below(f.path))}


def splits(files: dict[str, int], size: int) -> list[Split]:
    return [Split(f, a, min(a + size, n)) for f, n in sorted(files.items()) for a in range(0, n, size)]


def lines(stream, split: Split) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in the split; ``stream`` is a
    seekable file. A line may end beyond the split."""
    at = split.start
    if at:
        stream.seek(at - 1)  # a line begins at ``start`` if a line end lies before it
    rest, own, begun = b"", max(at - 1, 0), not at
    while True:
        block = stream.read(BLOCK)
        if not block:
            break
        if not begun:
            cut = block.find(b"\n")
            if cut < 0:
                own += len(block)
                continue
            own += cut + 1
            block, begun = block[cut + 1:], True
            if own >= split.end:
                return
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if own >= split.end:
                return
            yield own, line
            own += len(line) + 1
        if own >= split.end:
            return
    if rest and begun and own < split.end:
        yield own, rest


class _Rows:
    """Lines to Arrow batches of the fields and the identity."""

    def __init__(self, schema: StructType, path: str):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields[:-3]]
        self.names, self.path = schema.names, path
        self.types = [ARROW[k] for _, k in self.fields] + [pa.bool_(), pa.string(), pa.int64()]

    def parsed(self, line: bytes) -> tuple[list, bool]:
        try:
            record = json.loads(line)
        except ValueError:
            return [None] * len(self.fields), True
        if not isinstance(record, dict):
            return [None] * len(self.fields), True
        values, broken = [], False
        for name, kind in self.fields:
            value = record.get(name)
            if value is not None and (not isinstance(value, KINDS[kind]) or kind != "boolean" and isinstance(value, bool)):
                value, broken = None, True
            values.append(float(value) if kind == "double" and value is not None else value)
        return values, broken

    def batches(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        held: list[tuple] = []
        with system.open_input_file(split.file) as stream:
            for position, line in lines(stream, split):
                if line.strip():
                    values, broken = self.parsed(line)
                    held.append((*values, broken, split.file, position))
                if len(held) >= ROWS:
                    yield self.batch(held)
                    held = []
        if held:
            yield self.batch(held)

    def batch(self, held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), self.types)], names=self.names)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.options = options["path"], options
        self.rows = _Rows(schema, self.path)

    def partitions(self) -> list[Split]:
        files = listed(self.path, self.options.get("suffix", ""))
        return splits(files, int(self.options.get("splitbytes", 1 << 26))) or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from self.rows.batches(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.options = options["path"], options
        self.rows = _Rows(schema, self.path)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": listed(self.path, self.options.get("suffix", ""))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = {f: n for f, n in end["files"].items() if f not in start["files"]}
        return splits(new, int(self.options.get("splitbytes", 1 << 26))) or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from self.rows.batches(partition)


class JsonLines(DataSource):
    """Base of the sources: ``columns`` in DDL, then the identity."""

    columns = ""

    def schema(self) -> str:
        return f"{self.columns}, {IDENTITY}"

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError(f"{self.name()} needs a path")
        return options

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self._options())


class StarReviews(JsonLines):
    columns = "text string, stars double"

    @classmethod
    def name(cls) -> str:
        return "star_reviews"


class FeedbackLog(JsonLines):
    columns = "timestamp string, text string, prediction string, true_label string, confidence double"

    @classmethod
    def name(cls) -> str:
        return "feedback_log"


def register(spark: SparkSession) -> None:
    """Make ``star_reviews`` and ``feedback_log`` known to a session."""
    for source in (StarReviews, FeedbackLog):
        spark.dataSource.register(source)
