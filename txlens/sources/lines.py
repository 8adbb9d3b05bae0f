"""Journals as lines with their place, read whole or followed while they grow.

A data source of its own because two things are needed that the text reader lacks: the byte at which a line starts, which says
which of two rows is later, and files that grow while they are read. Files are cut into byte ranges at line ends, a range is a
task. As a stream, the offset is the number of bytes read of every file, up to the last line end: a line that is still being
written waits for the next batch, and a new file of the folder joins with its first batch. Paths are opened by Arrow, so a URI
of any file system Arrow knows will do.

Rows are (file, start, value). Bytes that are not UTF-8 are replaced. An empty folder has no rows, a path that does not exist is
an error. A file that became shorter is an error in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "journal_lines"
SCHEMA = "file string, start bigint, value string"
#: Bytes of a range, and of a read.
RANGE, READ = 32 << 20, 1 << 20


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> dict[str, int]:
    """Size of every file under a path; names that start with a dot or an underscore are not data."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def _ranges(path: str, spans: dict[str, tuple[int, int]], size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end)) for file, (start, end) in sorted(spans.items()) for a in range(start, end, size)]


def _lines(path: str, part: Range, whole: int) -> Iterator[pa.RecordBatch]:
    """Lines that start in the range; the last one may go on beyond it, up to `whole`."""
    system, _ = _open(path)
    with system.open_input_file(part.file) as f:
        at = part.start
        if at > 0:
            # a line that starts before the range belongs to the range before
            f.seek(at - 1)
            head = f.read(READ)
            while b"\n" not in head:
                more = f.read(READ)
                if not more:
                    return
                head += more
            at = at - 1 + head.index(b"\n") + 1
        rest, start = b"", at
        f.seek(at)
        while start < part.end:
            data = f.read(min(READ, whole - (start + len(rest))))
            if not data:
                break
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            starts, kept = [], []
            for line in lines:
                if start >= part.end:
                    break
                starts.append(start)
                kept.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                start += len(line) + 1
            yield _batch(part.file, starts, kept)
        if rest and start < part.end and start + len(rest) >= whole:
            yield _batch(part.file, [start], [rest.removesuffix(b"\r").decode("utf-8", "replace")])


def _batch(file: str, starts: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], ["file", "start", "value"])


class _Whole(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.sizes = _files(path)

    def partitions(self) -> list[Range]:
        return _ranges(self.path, {f: (0, n) for f, n in self.sizes.items()}, self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _lines(self.path, partition, self.sizes[partition.file])


class _Followed(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _ended(self, file: str, size: int) -> int:
        """Bytes up to the last line end."""
        system, _ = _open(self.path)
        done = self.known.get(file, 0)
        with system.open_input_file(file) as f:
            at = size
            while at > done:
                start = max(done, at - READ)
                f.seek(start)
                cut = f.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
        return done

    def latestOffset(self) -> dict:
        for file, size in _files(self.path).items():
            if size > self.known.get(file, 0):
                self.known[file] = self._ended(file, size)
        return {f: n for f, n in sorted(self.known.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if any(end.get(f, 0) < n for f, n in start.items()):
            raise ValueError("a file of the journal became shorter")
        self.known = {**end, **{f: max(n, end.get(f, 0)) for f, n in self.known.items()}}
        spans = {f: (start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)}
        return [_Part(p, end[p.file]) for p in _ranges(self.path, spans, self.size)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _lines(self.path, partition, partition.whole)

    def commit(self, end: dict) -> None:
        pass


class _Part(Range):
    """A range of a batch, and how far the batch goes in its file."""

    def __init__(self, part: Range, whole: int) -> None:
        super().__init__(part.file, part.start, part.end)
        self.whole = whole


class JournalLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("range", RANGE))

    def reader(self, schema: object) -> DataSourceReader:
        return _Whole(*self._given())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Followed(*self._given())


def read_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    spark.dataSource.register(JournalLines)
    return spark.read.format(NAME).option("range", size).load(path)


def follow_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The lines as a stream, those to come included."""
    spark.dataSource.register(JournalLines)
    return spark.readStream.format(NAME).option("range", size).load(path)
