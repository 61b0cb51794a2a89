"""Page primitives as a data source of Spark (S2), and the correction log as a stream with offsets.

    register(spark)
    spark.read.format("page_primitives").option("path", folder).option("reader", "jsonl").load().filter("page = 3")

A partition is a run of pages of one file, so a long set of sheets is read by several tasks. Filters on `page` and `path` are taken by
the reader: pages that they rule out are not decoded, and files that they rule out are not opened. A decoder is a plain object with
pages(data) -> how many pages, and page(data, number) -> rows (kind, x0, y0, x1, y1, text), so this module needs no PDF library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGES = "path string, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, text string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder, by name; hidden ones apart."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def _bytes(path: str, start: int = 0, end: int | None = None) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        size = f.size()
        return f.read_at((size if end is None else min(end, size)) - start, start)


class JsonPages:
    """Pages as lines, each a JSON list of [kind, x0, y0, x1, y1, text]."""

    @staticmethod
    def pages(data: bytes) -> int:
        return data.count(b"\n") + (len(data) > 0 and not data.endswith(b"\n"))

    @staticmethod
    def page(data: bytes, number: int) -> Iterator[tuple]:
        line = data.split(b"\n", number)[number - 1]
        for item in json.loads(line) if line.strip() else ():
            yield tuple(item)


#: Named decoders; a module adds its own where executors import it too.
DECODERS: dict[str, object] = {"jsonl": JsonPages}


class _Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class PageSource(DataSource):
    """Options: path (file or folder), reader (a name of DECODERS), pages (pages a partition, 16)."""

    @classmethod
    def name(cls) -> str:
        return "page_primitives"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.decoder, self.run = options["path"], options.get("reader", "jsonl"), int(options.get("pages", "16"))
        self.low, self.high, self.only, self.paths = 1, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can hold to exactly; the rest goes back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("page",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            elif column == ("page",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == ("page",) and isinstance(f, LessThan | LessThanOrEqual):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
            elif column == ("path",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            else:
                yield f

    def _wanted(self, page: int) -> bool:
        return page >= self.low and (self.high is None or page <= self.high) and (self.only is None or page in self.only)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, _ in _files(self.path):
            if self.paths is None or path in self.paths:
                n = DECODERS[self.decoder].pages(_bytes(path))
                runs = [(a, min(a + self.run - 1, n)) for a in range(1, n + 1, self.run)]
                out += [_Pages(path, a, b) for a, b in runs if any(map(self._wanted, range(a, b + 1)))]
        return out or [_Pages("", 1, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        if not partition.path:
            return
        data, decoder = _bytes(partition.path), DECODERS[self.decoder]
        for page in filter(self._wanted, range(partition.first, partition.last + 1)):
            for seq, row in enumerate(decoder.page(data, page)):
                yield (partition.path, page, seq, *row)


LOG = "file string, at bigint, line string"


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LogSource(DataSource):
    """An append-only log of lines (a file or a folder of files) as a stream: (file, at, line), where `at` is the line's place in bytes. The
    offset is the end of the last whole line of each file, so an export since an offset reads what was appended alone."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return WholeLog(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options["path"])


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = {}
        for path, size in _files(self.path):
            # the last line may still be being written: go back to the end of a whole one
            end, step = size, 1 << 16
            while end:
                tail = _bytes(path, max(0, end - step), end)
                if b"\n" in tail:
                    end = max(0, end - step) + tail.rindex(b"\n") + 1
                    break
                end = max(0, end - step)
            if end:
                ends[path] = end
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Span(path, start.get(path, 0), at) for path, at in sorted(end.items()) if at > start.get(path, 0)] or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        at = partition.start
        for line in _bytes(partition.path, partition.start, partition.end).split(b"\n")[:-1] if partition.path else ():
            yield (partition.path, at, line.decode())
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        return


class WholeLog(DataSourceReader):
    """All whole lines, a task a file."""

    def __init__(self, path: str):
        self.log = LogReader(path)

    def partitions(self) -> Sequence[InputPartition]:
        return self.log.partitions({}, self.log.latestOffset())

    def read(self, partition: _Span) -> Iterator[tuple]:
        return self.log.read(partition)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets Spark hand filters to readers written in Python, which it does not by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    spark.dataSource.register(LogSource)
