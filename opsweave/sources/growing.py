"""Log files that grow: a data source of text blocks, read as a table or as a stream.

``spark.read.format("blocklog")`` and ``spark.readStream.format("blocklog")`` once ``blocks`` has run, with the
options ``path`` (a file or a folder, or the URL of one), ``start`` (the line that begins a block; without it
every line is a block) and ``split_bytes``. Rows ``(file, offset, value)``: the place of the block in its file in
bytes, and its text without the start line and the line end at its end.

Files are cut into byte ranges that separate tasks read; a block belongs to the range it begins in. A stream keeps
one offset per file, at the end of its last whole block: a line without its line end, or the last started block
of a file, waits until more is written, so rows of a stream never change. A table takes what there is, with the
last block. A file that got shorter is read anew from its beginning. Text before the first start line, empty
lines and empty blocks are left out. The driver holds one number per file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20


class Range(InputPartition):
    """Blocks of ``file`` that begin in [lo, hi); nothing at or after ``end`` is read."""

    def __init__(self, file: str, lo: int, hi: int, end: int):
        super().__init__((file, lo, hi, end))
        self.file, self.lo, self.hi, self.end = file, lo, hi, end


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Files:
    """What the table and the stream share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.mark = options.get("start", "").encode()
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def sizes(self) -> dict[str, int]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            return {}
        if info.type == fs.FileType.File:
            return {path: info.size}
        inside = system.get_file_info(fs.FileSelector(path, recursive=True))
        shown = [f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return {f.path: f.size for f in shown}

    def ranges(self, file: str, lo: int, end: int) -> list[Range]:
        return [Range(file, at, min(at + self.split, end), end) for at in range(lo, end, self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        with _open(self.path)[0].open_input_file(part.file) as f:
            block, begun = [], -1
            for at, line in self._lines(f, part):
                if not self.mark:
                    if line.strip():
                        yield part.file, at, _text(line)
                elif line.rstrip(b"\r\n") == self.mark:
                    if begun >= 0 and block:
                        yield part.file, begun, _text(b"".join(block))
                    block, begun = [], at if at < part.hi else -1
                    if begun < 0:
                        return
                elif begun >= 0:
                    block.append(line)
            if begun >= 0 and block:
                yield part.file, begun, _text(b"".join(block))

    def _lines(self, f, part: Range) -> Iterator[tuple[int, bytes]]:
        """Lines from the first that begins in the range; without marks, to the last that does."""
        at = max(0, part.lo - 1)  # a line begins at lo if the byte before ends one
        rest, skip = b"", part.lo > 0
        begin = at
        while True:
            if not self.mark and not skip and begin >= part.hi:
                return
            chunk = f.read_at(min(_CHUNK, part.end - at), at) if at < part.end else b""
            at += len(chunk)
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if not skip:
                    if not self.mark and begin >= part.hi:
                        return
                    yield begin, line + b"\n"
                skip, begin = False, begin + len(line) + 1
            if not chunk:
                if rest and not skip and (self.mark or begin < part.hi):
                    yield begin, rest
                return

    def whole_until(self, file: str, size: int) -> int:
        """The end of the last whole block, found from the end of the file backwards."""
        with _open(self.path)[0].open_input_file(file) as f:
            tail, at = b"", size
            while at > 0:
                step = min(_CHUNK, at)
                at -= step
                tail = f.read_at(step, at) + tail[: 2 * len(self.mark) + 4]
                if not self.mark:
                    cut = tail.rfind(b"\n", 0, step)
                    if cut >= 0:
                        return at + cut + 1
                    continue
                cut = len(tail)
                while (cut := tail.rfind(b"\n" + self.mark, 0, cut)) >= 0:
                    if tail[cut + 1 + len(self.mark) :].lstrip(b"\r")[:1] == b"\n":
                        return at + cut + 1
            return 0


def _text(block: bytes) -> str:
    return block.rstrip(b"\r\n").decode("utf-8", "replace")


class _Table(_Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(self.sizes().items()) for r in self.ranges(file, 0, size)]


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        ends = {file: self.whole_until(file, size) for file, size in sorted(self.sizes().items())}
        return {"files": json.dumps({f: e for f, e in ends.items() if e})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, out = json.loads(start["files"]), []
        for file, until in json.loads(end["files"]).items():
            lo = before.get(file, 0)
            out += self.ranges(file, lo if lo <= until else 0, until)
        return out


class BlockLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def blocks(spark: SparkSession, path: str, start: str = "", stream: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, offset, value)`` of the blocks under ``path``."""
    spark.dataSource.register(BlockLog)
    source = (spark.readStream if stream else spark.read).format("blocklog")
    return source.options(path=path, start=start, split_bytes=str(split_bytes)).load()
