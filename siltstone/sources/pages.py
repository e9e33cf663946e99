"""Spark data sources for what a crawl has saved and what a server sends: pages by host, and streams of event frames in files.

Both read from any file system that Arrow knows, by partitions; nothing goes through the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Bytes of pages that a partition has, at least, before the next one begins.
PARTITION_BYTES = 32 << 20
#: Bytes that are read at once on the way back to where a frame begins.
BACK = 1 << 16


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def page_path(url: str) -> str:
    """Where a page is saved below its folder: host=<host>/<rest of the address>.html."""
    scheme, _, rest = url.partition("://")
    host, _, path = rest.partition("/")
    return f"host={host}/{quote(f'{scheme}/{path}', safe='')}.html"


def page_url(path: str) -> str:
    host, name = path.rsplit("/", 2)[-2:]
    scheme, _, rest = unquote(name.removesuffix(".html")).partition("/")
    return f"{scheme}://{host.removeprefix('host=')}/{rest}"


class Pages(InputPartition):
    def __init__(self, host: str, files: list[str]):
        self.host, self.files = host, files


class SavedPages(DataSource):
    """Rows (host, url, html) of pages saved under ``path`` by ``page_path``; filters on the host are answered by its folders."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "host string, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.hosts = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("host",):
                yield f
            else:
                self.hosts = wanted if self.hosts is None else self.hosts & wanted

    def partitions(self) -> list[Pages]:
        fs, root = opened(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        hosts = sorted(f.base_name.removeprefix("host=") for f in found if f.type == arrow_fs.FileType.Directory and f.base_name.startswith("host="))
        out = []
        for host in hosts:
            if self.hosts is not None and host not in self.hosts:
                continue
            held, size = [], 0
            for f in sorted(fs.get_file_info(arrow_fs.FileSelector(f"{root}/host={host}")), key=lambda f: f.path):
                if f.type == arrow_fs.FileType.File and f.base_name.endswith(".html"):
                    held.append(f.path)
                    size += f.size
                    if size >= PARTITION_BYTES:
                        out.append(Pages(host, held))
                        held, size = [], 0
            if held:
                out.append(Pages(host, held))
        return out or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path in partition.files:
            with fs.open_input_stream(path) as f:
                yield partition.host, page_url(path), f.read().decode("utf-8", "replace")


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Frames(DataSource):
    """A stream of frames (path, at, event, data) in the growing files of a folder: lines up to an empty one, of which those of ``data:`` are joined.

    A frame comes out with the batch in which its empty line was there; what of it came before is read again then. ``at`` is where it ends.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, at long, event string, data string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameReader(self.options["path"])


class FrameReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        fs, root = opened(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        return {"files": {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))}}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(p, start["files"].get(p, 0), n) for p, n in end["files"].items() if n > start["files"].get(p, 0)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_file(piece.path) as f:
            at, found = piece.start, -1
            while at > 0 and found < 0:  # back to the last empty line before
                low = max(0, at - BACK)
                found = f.read_at(min(piece.start, at + 1) - low, low).rfind(b"\n\n")
                at = low + found + 2 if found >= 0 else low
            raw = f.read_at(piece.end - at, at)
        rows, begin = [], 0
        while (stop := raw.find(b"\n\n", begin)) >= 0:
            if at + stop + 2 > piece.start and (frame := frame_of(raw[begin:stop])):
                rows.append((piece.path, at + stop + 2, *frame))
            begin = stop + 2
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "at", "event", "data"])


def frame_of(raw: bytes) -> tuple[str | None, str] | None:
    """(event, data) of a frame's lines; null for one without data."""
    event, data = None, []
    for line in raw.decode("utf-8", "replace").replace("\r", "").split("\n"):
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "event":
            event = value
    return (event, "\n".join(data)) if data else None
