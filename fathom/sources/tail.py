"""Growing transcripts as a streaming source: whole lines from a byte place in each file on.

    spark.dataSource.register(TranscriptTail)
    spark.readStream.format("transcript_tail").option("path", folder).load()

An offset is a JSON object of file to byte: up to where its lines have been given. Only bytes up to a file's last line end belong to a batch, so half a line waits for its rest;
the checkpoint keeps offsets, so a restart gives every line once. A batch's bytes are cut into splits of split_bytes, read by different tasks: a line belongs to the split it
begins in. `tail_bytes` starts a file that is new at the start of the stream near its end, at the first whole line within so many last bytes. Files are found below `path` by
the ending `suffix`, through any file system that Arrow knows; files that shrink are read again from their beginning, as they are other files then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 16


class Split(InputPartition):
    def __init__(self, name: str, low: int, high: int, begins: bool):
        self.name, self.low, self.high, self.begins = name, low, high, begins


def line_end(file, size: int, low: int) -> int:
    """The place behind the last line end between low and size; low if there is none."""
    high = size
    while high > low:
        start = max(low, high - _BLOCK)
        file.seek(start)
        at = file.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.split_bytes = int(options.get("split_bytes", 8 << 20))
        self.tail_bytes = int(options.get("tail_bytes", 0))

    def system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def files(self) -> dict[str, int]:
        system, root = self.system()
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and f.base_name.endswith(self.suffix) and not f.base_name.startswith(("_", "."))}

    def initialOffset(self) -> dict:  # noqa: N802
        if not self.tail_bytes:
            return {"files": "{}"}
        system, _ = self.system()
        places = {}
        for name, size in self.files().items():
            with system.open_input_file(name) as file:
                places[name] = line_end(file, max(0, size - self.tail_bytes), 0)
        return {"files": json.dumps(places, sort_keys=True)}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = self.system()
        ends = {}
        for name, size in self.files().items():
            with system.open_input_file(name) as file:
                ends[name] = line_end(file, size, 0)
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        before, out = json.loads(start["files"]), []
        for name, high in json.loads(end["files"]).items():
            low = before.get(name, 0)
            low = 0 if low > high else low
            for a in range(low, high, self.split_bytes):
                out.append(Split(name, a, min(a + self.split_bytes, high), a == low))
        return out

    def read(self, partition: Split) -> Iterator[tuple]:
        system, _ = self.system()
        with system.open_input_file(partition.name) as file:
            at = partition.low
            if not partition.begins:  # the line that reaches into this split is its beginning's
                file.seek(at - 1)
                at = at - 1 + len(_line(file))
            else:
                file.seek(at)
            while at < partition.high:
                line = _line(file)
                if not line:
                    break
                yield partition.name, at, line.rstrip(b"\n").rstrip(b"\r").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _line(file) -> bytes:
    """From here to the next line end."""
    parts = []
    while block := file.read(_BLOCK):
        at = block.find(b"\n")
        if at >= 0:
            file.seek(file.tell() - len(block) + at + 1)
            return b"".join([*parts, block[: at + 1]])
        parts.append(block)
    return b"".join(parts)


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)
