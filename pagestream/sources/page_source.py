"""Page files as a Spark data source, for batches and streams: ``spark.read.format("page_files")``.

A page file is JSONL, a line a page: index, width, height, rotation, text, lines
(and what else there is).  A bundle is a file; its id is the file's whole path
below the folder that is read, without the last extension, so that files of one
name in two folders stay apart.

* A partition is a range of a file's bytes, cut at line ends; large files are
  read by many tasks.
* ``columns`` (comma-separated) names the fields to read; others aren't parsed.
* Filters on ``bundle_id`` (equal, in, starts with) drop whole files before any
  task starts; filters on ``page_index`` are applied to the batches.  Spark
  hands filters on if ``spark.sql.python.filterPushdown.enabled`` is set, which
  ``register`` does.
* As a stream, new files are read in the order of their times; files may not
  change once they are seen (write elsewhere, then rename).  An offset is the
  time and path of the last file, so that it doesn't grow with the folder.
  ``files_per_batch`` bounds a batch.

Folders are opened by ``pyarrow.fs``, which all nodes have to be able to.  A line
that is no page fails the read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from pagestream.shipping import ship

LINE = "struct<text:string,x0:double,top:double,x1:double,bottom:double,size:double,bold:boolean>"
_LINE = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "top", "x1", "bottom", "size")), ("bold", pa.bool_())])
#: Column: (field of the file, Spark type, Arrow type).
FIELDS = {
    "page_index": ("index", "int", pa.int32()), "width": ("width", "double", pa.float64()), "height": ("height", "double", pa.float64()),
    "rotation": ("rotation", "int", pa.int32()), "text": ("text", "string", pa.string()), "lines": ("lines", f"array<{LINE}>", pa.list_(_LINE)),
}
SPLIT_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class PageRange(InputPartition):
    """The pages whose lines begin in [start, stop) of a file."""

    path: str
    bundle: str
    start: int
    stop: int


@dataclass(frozen=True)
class Found:
    path: str
    bundle: str
    size: int
    time: int


class _Files:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        if not self.root:
            raise ValueError("page_files needs a path")
        self.columns = [c.strip() for c in options.get("columns", ",".join(FIELDS)).split(",") if c.strip()]
        if unknown := set(self.columns) - set(FIELDS) - {"bundle_id"}:
            raise ValueError(f"page files have no column {sorted(unknown)[0]}")
        self.suffixes = tuple(options.get("suffixes", ".jsonl,.json").split(","))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.checks: list[tuple[type, int]] = []

    @staticmethod
    def _open(path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path if "://" in path else f"/{path.removeprefix('file:').lstrip('/')}")

    def files(self) -> list[Found]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._open(self.root)
        info = fs.get_file_info(root)
        infos = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=False))
        out = []
        for f in infos:
            below = posixpath.basename(f.path) if f.path == root else posixpath.relpath(f.path, root)
            hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
            if f.type == FileType.File and f.path.endswith(self.suffixes) and not hidden:
                out.append(Found(f.path, posixpath.splitext(below)[0], f.size, f.mtime_ns or 0))
        return sorted(out, key=lambda f: (f.time, f.path))

    def ranges(self, files: Iterable[Found]) -> list[PageRange]:
        return [PageRange(f.path, f.bundle, at, min(at + self.split_bytes, f.size)) for f in files for at in range(0, f.size, self.split_bytes)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open(self.root)
        wanted = [c for c in self.columns if c != "bundle_id"]
        needed = list(dict.fromkeys(wanted + (["page_index"] if self.checks or not wanted else [])))
        schema = pa.schema([(FIELDS[c][0], FIELDS[c][2]) for c in needed])
        with fs.open_input_file(partition.path) as source:
            at = partition.start
            left = b""
            if at:  # the line that reaches into the range belongs to the one before
                source.seek(at - 1)
                at -= 1
                while b"\n" not in left:
                    got = source.read(BLOCK_BYTES)
                    if not got:
                        return
                    left = got if not left else left + got
                skip = left.index(b"\n") + 1
                at, left = at + skip, left[skip:]
            while at < partition.stop:
                # left: bytes from ``at`` on; whole lines that begin before ``stop``
                room = partition.stop - at
                end = left.find(b"\n", room - 1) + 1 if len(left) >= room else left.rfind(b"\n") + 1
                if not end:
                    got = source.read(BLOCK_BYTES)
                    if got:
                        left += got
                        continue
                    end = len(left)  # the last line has no end
                    if not end:
                        return
                chunk, left, at = left[:end], left[end:], at + end
                if chunk.strip():
                    yield from self._pages(chunk, schema, wanted, partition)

    def _pages(self, chunk: bytes, schema: pa.Schema, wanted: list[str], partition: PageRange) -> Iterator[pa.RecordBatch]:
        options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        try:
            table = pj.read_json(pa.BufferReader(chunk), pj.ReadOptions(use_threads=False, block_size=max(len(chunk), 1 << 10) + 1), options)
        except pa.ArrowInvalid as e:
            raise ValueError(f"{partition.path}: a line is no page: {e}") from e
        for kind, value in self.checks:
            table = table.filter(pc.fill_null(_COMPARE[kind](table.column("index"), value), False))
        n = table.num_rows
        bundle = pa.array([partition.bundle], pa.string()).take(pa.array([0] * n, pa.int32()))
        columns = [bundle if c == "bundle_id" else table.column(FIELDS[c][0]) for c in self.output()]
        yield from pa.table(dict(zip(self.output(), columns, strict=True))).to_batches()

    def output(self) -> list[str]:
        return ["bundle_id", *(c for c in self.columns if c != "bundle_id")]


class PageReader(_Files, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.keep: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name == "bundle_id" and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.keep.append(f)
            elif name == "page_index" and type(f) in _COMPARE and isinstance(f.value, int):
                self.checks.append((type(f), f.value))
            else:
                yield f

    def _kept(self, bundle: str) -> bool:
        for f in self.keep:
            if isinstance(f, StringStartsWith):
                if not bundle.startswith(f.value):
                    return False
            elif bundle not in (f.value if isinstance(f, In) else [f.value]):
                return False
        return True

    def partitions(self) -> list[PageRange]:
        return self.ranges(f for f in self.files() if self._kept(f.bundle)) or [PageRange("", "", 0, 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class PageStream(_Files, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("files_per_batch", 1 << 30))
        self.last = (-1, "")

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        new = [f for f in self.files() if (f.time, f.path) > self.last][: self.most]
        if new:
            self.last = new[-1].time, new[-1].path
        return {"time": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        self.last = max(self.last, high)
        return self.ranges(f for f in self.files() if low < (f.time, f.path) <= high)

    def commit(self, end: dict) -> None:
        """Files are remembered by the offset alone."""


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        columns = _Files(self.options).output()
        return ", ".join(f"{c} {'string' if c == 'bundle_id' else FIELDS[c][1]}" for c in columns)

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("page_files").options(**options).load(path)


def stream_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("page_files").options(**options).load(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """pages(bundle_id, page_index, ...) to page files, one folder and file a bundle: its id is read back as ``bundle=<id>/...``."""
    rows = pages.withColumnsRenamed({"bundle_id": "bundle", "page_index": "index"})
    rows.repartition("bundle").sortWithinPartitions("bundle", "index").write.partitionBy("bundle").json(path)
