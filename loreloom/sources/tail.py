"""Following growing text files as a stream: ``spark.readStream.format("log_tail")``.

The position in a file is (identity, byte after the last line read), so a file that grows is read on, up to its last complete
line; a file that shrank, or whose place another file took, is read from its start. The identity is the file's number where the
file system has one, and a hash of the file's first bytes, so a file that was cut and has grown past the old position is
noticed, too. New files in a folder are read from their start. Positions are kept in the query's checkpoint.

A batch is a byte range per file; ranges are cut into pieces of ``splitBytes``, and a piece yields the lines that begin in it.

Options: ``path`` (a file, or a folder with ``pattern``, default ``*``), ``startingPosition`` (``earliest``, or ``latest`` to skip what
the files hold when the query first starts), ``maxBytesPerTrigger`` (per file; the first batch
after a restart takes all there is), ``splitBytes``, and ``failOnDataLoss`` (a planned
range is gone because its file was replaced before it was read: true fails, false skips it).

Rows: path, position (of the line's first byte), value (without the line end; bytes that are no UTF-8 become U+FFFD). Paths may be
any that ``pyarrow.fs`` opens; on a cluster they must be in storage which driver and executors share.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position bigint, value string"
#: First bytes of a file that its identity covers.
HEAD = 256
BLOCK = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _number(system: pafs.FileSystem, path: str) -> str:
    if not isinstance(system, pafs.LocalFileSystem):
        return ""
    stat = os.stat(path)
    return f"{stat.st_dev}:{stat.st_ino}"


def _head(stream, size: int) -> str:
    stream.seek(0)
    return hashlib.sha256(stream.read(size)).hexdigest()


def complete_end(stream, start: int, end: int) -> int:
    """The byte after the last line end in ``start`` to ``end``; ``start`` if there is none."""
    while end > start:
        low = max(start, end - BLOCK)
        stream.seek(low)
        at = stream.read(end - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        end = low
    return start


@dataclass
class Piece(InputPartition):
    """Lines that begin in ``start`` to ``end`` of a file; the file's range ends at ``stop``."""

    path: str
    number: str
    head_size: int
    head: str
    low: int
    start: int
    end: int
    stop: int


class TailReader(DataSourceStreamReader):
    """Offsets: {"files": {path: [number, head size, head hash, position]}}."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.latest = options.get("startingposition", options.get("startingPosition", "earliest")) == "latest"
        self.most = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 0)))
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.strict = str(options.get("failondataloss", options.get("failOnDataLoss", "true"))).lower() == "true"
        self.known: dict[str, list] = {}
        #: Whether ``known`` says where the last batch ended; after a restart only the checkpoint does, until the first batch is planned.
        self.sure = False

    def _files(self) -> list[tuple[str, int]]:
        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [(info.path, info.size)]
        if info.type == pafs.FileType.NotFound:
            return []
        found = system.get_file_info(pafs.FileSelector(root, recursive=False))
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))

    def _follow(self, path: str, size: int, before: list | None, limit: int) -> list | None:
        """The file's next position, from its position ``before``."""
        system, _ = _open(self.path)
        try:
            with system.open_input_file(path) as stream:
                number = _number(system, path)
                start = 0
                if before and before[0] == number and before[3] <= size and _head(stream, before[1]) == before[2]:
                    start = before[3]
                    if before[1] == HEAD:
                        head = before[1:3]
                    else:
                        head = [min(HEAD, size), _head(stream, min(HEAD, size))]
                else:
                    head = [min(HEAD, size), _head(stream, min(HEAD, size))]
                end = min(size, start + limit) if limit else size
                stop = complete_end(stream, start, end)
                if stop == start and end < size:  # a line longer than the limit is read whole
                    stop = self._line_end(stream, end, size, start)
                return [number, *head, stop]
        except FileNotFoundError:
            return None

    @staticmethod
    def _line_end(stream, low: int, size: int, start: int) -> int:
        while low < size:
            stream.seek(low)
            data = stream.read(min(BLOCK, size - low))
            at = data.find(b"\n")
            if at >= 0:
                return low + at + 1
            low += len(data)
        return start

    def initialOffset(self) -> dict:
        self.sure = True
        if not self.latest:
            return {"files": {}}
        found = {path: self._follow(path, size, None, 0) for path, size in self._files()}
        self.known = {path: at for path, at in found.items() if at}
        return {"files": self.known}

    def latestOffset(self) -> dict:
        files = {}
        for path, size in self._files():
            at = self._follow(path, size, self.known.get(path), self.most if self.sure else 0)
            if at:
                files[path] = at
        self.known = files
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (number, head_size, head, stop) in sorted(end["files"].items()):
            before = start["files"].get(path)
            low = self._resumed(before, number, stop, path)
            for a in range(low, stop, self.split):
                out.append(Piece(path, number, head_size, head, low, a, min(a + self.split, stop), stop))
        self.known, self.sure = dict(end["files"]), True
        return out

    def _resumed(self, before: list | None, number: str, stop: int, path: str) -> int:
        """Where the range to ``stop`` begins: the position before, if it is the same file that went on."""
        if not before or before[0] != number or before[3] > stop:
            return 0
        system, _ = _open(self.path)
        try:
            with system.open_input_file(path) as stream:
                return before[3] if _head(stream, before[1]) == before[2] else 0
        except FileNotFoundError:
            return before[3]

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, _ = _open(self.path)
        try:
            stream = system.open_input_file(piece.path)
        except FileNotFoundError:
            return self._lost(piece)
        with stream:
            same = _number(system, piece.path) == piece.number and stream.size() >= piece.stop
            if not same or _head(stream, piece.head_size) != piece.head:
                return self._lost(piece)
        return self._lines(piece)

    def _lost(self, piece: Piece) -> Iterator[tuple]:
        if self.strict:
            raise RuntimeError(f"{piece.path} was replaced before bytes {piece.start} to {piece.end} were read")
        return iter(())

    def _lines(self, piece: Piece) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(piece.path) as stream:
            # a line that began before this piece belongs to the piece before: find the first line end from one byte earlier
            at = piece.start if piece.start == piece.low else self._line_end(stream, piece.start - 1, piece.stop, piece.stop)
            stream.seek(at)
            place, parts = at, []
            while at < piece.end and (data := stream.read(min(BLOCK, piece.stop - place))):
                place += len(data)
                *lines, rest = data.split(b"\n")
                for line in lines:
                    if at >= piece.end:
                        return
                    line = b"".join([*parts, line])
                    parts = []
                    yield piece.path, at, line.decode("utf-8", "replace").removesuffix("\r")
                    at += len(line) + 1
                parts.append(rest)


class LogTail(DataSource):
    """The source behind the format ``log_tail``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, position, value): the complete lines of a growing file, or of the files of a folder, as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, **options).load()
