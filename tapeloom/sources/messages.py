"""A feed's messages as a data source of batches and streams: text segments, read by position."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "segment string, at long, raw string"
#: Bytes of a segment that a task reads, and lines of a batch it hands over.
RANGE, LINES = 64 << 20, 8192


@dataclass
class Part(InputPartition):
    """The lines of a segment that begin at start or later and before end."""

    segment: str
    start: int
    end: int


def _system(path: str) -> tuple[pf.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (pf.LocalFileSystem(), path) if path.startswith("/") else pf.FileSystem.from_uri(path)


class _Segments:
    """What both readers share: listing, cutting into ranges, reading lines."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.range = int(options.get("rangeBytes", RANGE))

    def listed(self) -> list[tuple[str, int]]:
        """Names below the path and sizes, in order of names; hidden files are none."""
        system, root = _system(self.path)
        root = root.rstrip("/") + "/"
        found = [(i.path[len(root) :], i.size) for i in system.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == pf.FileType.File]
        return sorted((n, s) for n, s in found if not any(p[0] in "._" for p in n.split("/")))

    def cut(self, segments: list[tuple[str, int]]) -> list[Part]:
        return [Part(name, start, min(size, start + self.range)) for name, size in segments for start in range(0, size, self.range)]

    def lines(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, root = _system(self.path)
        schema = pa.schema([("segment", pa.string()), ("at", pa.int64()), ("raw", pa.string())])
        with io.BufferedReader(system.open_input_file(f"{root}/{part.segment}"), 1 << 20) as source:
            at = part.start
            if at:  # a line belongs to the range that its first byte lies in
                source.seek(at - 1)
                at += len(source.readline()) - 1
            else:
                source.seek(0)
            places, texts = [], []
            while at < part.end:
                line = source.readline()
                if not line:
                    break
                if line.strip():
                    places.append(at)
                    texts.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                if len(texts) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([part.segment] * len(texts)), pa.array(places, pa.int64()), pa.array(texts)], schema=schema)
                    places, texts = [], []
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([part.segment] * len(texts)), pa.array(places, pa.int64()), pa.array(texts)], schema=schema)


class BatchReader(_Segments, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.cut(self.listed()) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.lines(partition) if partition.segment else iter(())


class FilteredReader(BatchReader):
    """Bounds of the segment's name choose the files that are opened; all else is left to Spark."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.bounds: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("segment",):
                self.bounds.append(f)
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        holds = {
            EqualTo: lambda n, v: n == v, GreaterThan: lambda n, v: n > v, GreaterThanOrEqual: lambda n, v: n >= v,
            LessThan: lambda n, v: n < v, LessThanOrEqual: lambda n, v: n <= v,
        }
        return [s for s in super().listed() if all(holds[type(f)](s[0], f.value) for f in self.bounds)]


class StreamReader(_Segments, DataSourceStreamReader):
    """The offset is the name of the last segment taken."""

    def __init__(self, options: dict) -> None:
        _Segments.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"segment": ""}

    def latestOffset(self) -> dict:
        names = self.listed()
        return {"segment": names[-1][0] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.cut([s for s in self.listed() if start["segment"] < s[0] <= end["segment"]])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.lines(partition)


class Messages(DataSource):
    """Lines of text segments below option path: segment, at (the line's first byte), raw.

    Segments are those of a log: each is whole when it appears, none changes, and names ascend. A
    stream's offset is the last name, so a query that starts again from its checkpoint reads each
    line once. Blank lines are left out, bytes that are no UTF-8 become U+FFFD. Long segments are
    read in ranges of rangeBytes, one a task. The path is one that all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else BatchReader)(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def messages(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Messages below path, as a table or a stream. A table's filters on segment choose the files if
    spark.sql.python.filterPushdown.enabled is set (Spark refuses a source that takes filters if not)."""
    spark.dataSource.register(Messages)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.readStream if stream else spark.read
    return read.format("feed_messages").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def without_errors(found: DataFrame) -> DataFrame:
    """found, or a failed query if a message is an object with a field error: the server refused the
    subscription, so whatever follows is not the feed."""
    error = F.get_json_object("raw", "$.error")
    return found.where(F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("the feed reports: "), error)).isNotNull()).otherwise(True))
