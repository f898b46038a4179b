"""A data source of raw grey frames: files of bytes, read by offset with a stride, and written in parallel.

A folder holds files named ``<series>-<first frame>.raw``, each of consecutive frames of ``width`` * ``height`` bytes and nothing
else, so any run of frames is a range of bytes.

* Reading: a file is cut into partitions of ``frames_per_partition`` frames. A partition seeks to every ``stride``-th frame (counted over
  the series, not the file) and reads only those bytes, one frame at a time. Columns: g, i, v (binary), at (the offset in its file).
* Writing rows (g, i, v): every task writes the frames it gets, a file for each run of consecutive ones, under a draft name;
  files have their final names only once all tasks are done, and a task that is lost leaves only drafts.

Paths are any that Arrow's file systems open.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "g string, i long, v binary, at long"
FRAMES_PER_PARTITION = 10_000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Run(InputPartition):
    """Frames ``first`` to ``last`` of a series, at ``base`` on of a file."""

    path: str
    g: str
    first: int
    last: int
    base: int


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options["width"]) * int(options["height"])
        self.stride, self.per = max(1, int(options.get("stride", 1))), int(options.get("frames_per_partition", FRAMES_PER_PARTITION))

    def partitions(self) -> list[Run]:
        fs, root = _opened(self.path)
        runs = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
            name = posixpath.basename(info.path)
            if not name.endswith(".raw") or name.startswith(("_", ".")):
                continue
            g, _, first = name[:-4].rpartition("-")
            n, first = info.size // self.size, int(first)
            for lo in range(0, n, self.per):
                runs.append(Run(info.path, g, first + lo, first + min(n, lo + self.per) - 1, lo * self.size))
        return runs

    def read(self, run: Run | None) -> Iterator[tuple]:
        if run is None:  # a folder without frames
            return
        fs, _ = _opened(self.path)
        start = -(-run.first // self.stride) * self.stride
        if start > run.last:
            return
        with fs.open_input_file(run.path) as f:
            for i in range(start, run.last + 1, self.stride):
                at = run.base + (i - run.first) * self.size
                yield run.g, i, self.frame(f, at), at

    def frame(self, f, at: int) -> bytes:
        f.seek(at)
        return f.read(self.size)


@dataclass
class Drafts(WriterCommitMessage):
    files: list[tuple[str, str]]


class RawFramesWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options["width"]) * int(options["height"])

    def write(self, rows: Iterator) -> Drafts:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        files, out, last = [], None, None
        try:
            for r in rows:
                g, i, v = r["g"], r["i"], bytes(r["v"])
                if len(v) != self.size:
                    raise ValueError(f"frame {i} of {g} has {len(v)} bytes instead of {self.size}")
                if last != (g, i - 1):
                    if out is not None:
                        out.close()
                    draft = f"{root}/_draft-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft)
                    files.append((draft, f"{root}/{g}-{i}.raw"))
                out.write(v)
                last = (g, i)
        finally:
            if out is not None:
                out.close()
        return Drafts(files)

    def commit(self, messages: list[Drafts | None]) -> None:
        fs, _ = _opened(self.path)
        for m in messages:
            for draft, final in m.files if m else []:
                fs.move(draft, final)

    def abort(self, messages: list[Drafts | None]) -> None:
        fs, _ = _opened(self.path)
        for m in messages:
            for draft, _ in m.files if m else []:
                fs.delete_file(draft)


class RawFrames(DataSource):
    """``spark.read.format("raw_frames")`` with the options path, width, height, stride and frames_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawFramesReader:
        return RawFramesReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawFramesWriter:
        return RawFramesWriter(self.options)


def to_bytes(v: Column) -> Column:
    """A picture's numbers as bytes, rounded and held within 0 and 255."""
    byte = lambda x: F.lpad(F.hex(F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("long")), 2, "0")
    return F.unhex(F.array_join(F.transform(v, byte), ""))


def write_frames(frames: DataFrame, path: str, width: int, height: int) -> None:
    """Write frames (g, i, v binary), each series in order; see ``RawFrames``. The folder is new; null frames are an error."""
    spark = frames.sparkSession
    spark.dataSource.register(RawFrames)
    ordered = frames.select(F.col("g").cast("string").alias("g"), F.col("i").cast("long").alias("i"), "v", F.lit(0).cast("long").alias("at")).repartitionByRange("g", "i").sortWithinPartitions("g", "i")
    ordered.write.format("raw_frames").mode("append").option("path", path).option("width", width).option("height", height).save()


def read_frames(spark, path: str, width: int, height: int, stride: int = 1, frames_per_partition: int = FRAMES_PER_PARTITION) -> DataFrame:
    """(g, i, v, at): every ``stride``-th frame of each series."""
    spark.dataSource.register(RawFrames)
    options = {"path": path, "width": width, "height": height, "stride": stride, "frames_per_partition": frames_per_partition}
    return spark.read.format("raw_frames").options(**options).load()
