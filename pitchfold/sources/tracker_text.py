"""A data source for trackers' text files: a file a match, a line a box.

The layout is that of the public multi-object tracking benchmarks, without a
header: frame, id, left, top, width, height, confidence, class and whatever
follows. A file is named after its match, such as ``match-12.txt``. Each file is
a partition, read in blocks. Filters on the match leave files out, a filter on
the frame leaves lines out where they are read. As a stream, files are taken in
order of their time and name; a file is whole when it appears.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

NAME = "tracker_text"
SCHEMA = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
_COLUMNS = ("frame", "tid", "left", "top", "width", "height", "conf", "cls")
_KINDS = {"frame": pa.int64(), "tid": pa.int64(), "left": pa.float64(), "top": pa.float64(), "width": pa.float64(), "height": pa.float64(), "conf": pa.float64(), "cls": pa.int32()}
_MATCH = re.compile(r"(\d+)\.[A-Za-z]+$")
_ARROW = pa.schema([("match_id", pa.int64()), ("frame", pa.int64()), ("ord", pa.int64()), ("tid", pa.int64()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2", "conf")], ("cls", pa.int32())])


@dataclass
class MatchFile(InputPartition):
    path: str
    match_id: int
    first_frame: int | None = None


def _files(folder: str) -> list[tuple[int, str, int]]:
    """(time, path, match) of a folder's files whose names end with a match's number, in order of time and name."""
    where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = [f for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((f.mtime_ns, f.path, int(m[1])) for f in found if (m := _MATCH.search(f.base_name)))


def _rows(folder: str, part: MatchFile | None) -> Iterator[pa.RecordBatch]:
    if part is None:
        return  # no file is left
    where = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    with where.open_input_stream(part.path) as raw:
        if not (begin := raw.read(1)):
            return  # an empty file is a match without boxes
        raw = pa.PythonFile(_Joined(begin, raw), mode="r")
        wide = 0
        lines = csv.open_csv(raw, csv.ReadOptions(column_names=None, autogenerate_column_names=True), csv.ParseOptions(), csv.ConvertOptions(column_types={f"f{k}": _KINDS[c] for k, c in enumerate(_COLUMNS)}, strings_can_be_null=True))
        for batch in lines:
            n = batch.num_rows
            c = dict(zip(_COLUMNS, batch.columns))
            order = pa.array(range(wide, wide + n), pa.int64())
            wide += n
            out = pa.RecordBatch.from_arrays([pa.array([part.match_id] * n, pa.int64()), c["frame"], order, c["tid"], c["left"], c["top"], pc.add(c["left"], c["width"]), pc.add(c["top"], c["height"]), c["conf"], c["cls"]], schema=_ARROW)
            yield out if part.first_frame is None else out.filter(pc.greater_equal(out.column("frame"), part.first_frame))


class _Joined:
    """A stream whose first byte was read already."""

    closed = False

    def __init__(self, begin: bytes, rest):
        self.begin, self.rest = begin, rest

    def read(self, n: int = -1) -> bytes:
        got, self.begin = self.begin, b""
        return got + self.rest.read(None if n is None or n < 0 else max(n - len(got), 0))

    def close(self) -> None:
        self.closed = True


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.matches, self.first = folder, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("match_id",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.matches = wanted if self.matches is None else self.matches & wanted
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("frame",):
                least = f.value + isinstance(f, GreaterThan)
                self.first = least if self.first is None else max(self.first, least)
            else:
                yield f

    def partitions(self) -> list[MatchFile]:
        return [MatchFile(path, match, self.first) for _, path, match in _files(self.folder) if self.matches is None or match in self.matches]

    def read(self, partition: MatchFile) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and the path of the last file taken."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"last": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"last": json.dumps(list(files[-1][:2]))} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[MatchFile]:
        a, b = (tuple(json.loads(o["last"])) for o in (start, end))
        return [MatchFile(path, match) for at, path, match in _files(self.folder) if a < (at, path) <= b]

    def read(self, partition: MatchFile) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition)


class TrackerText(DataSource):
    """``spark.read.format("tracker_text").load(folder)``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackerText)
