"""Zip archives and PDF books of many pages, one file for each group, put together in parallel.

Every byte of such a file has a place that follows from the sizes of what comes before it: the pages, then a directory with
a line for each of them, then an end of fixed form. So sizes are summed first (in each range of rows, then over ranges), and all
pages, directory lines and ends are then written at their places by whichever task has them.

The folder is on a file system that all executors have mounted, since pieces are written into the middle of files. All files are
written in a draft folder that gets its name in one step when every task is done; a task that runs twice writes the same
bytes at the same places.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framelake.operators.catalog import safe_filename
from framelake.tables import materialise

#: Members that a task reads.
MEMBERS_PER_TASK = 10_000
#: Adjacent pieces are written together up to so many bytes.
RUN_BYTES = 1 << 20
#: Pages under one node of a book's page tree.
NODE_PAGES = 256
#: Fixed values of the zip format: signatures, the largest numbers of its short fields, and 1980-01-01 as a date.
MEMBER, ENTRY, END, END64, LOCATOR64 = "504B0304", "504B0102", "504B0506", "504B0606", "504B0607"
SHORT_MAX, LONG_MAX, DAY = 0xFFFF, 0xFFFFFFFF, "00002100"


def _le(c: Column, n: int) -> Column:
    """A number as ``n`` bytes in hex, the lowest first."""
    digits = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])


def _least(c: Column, most: int) -> Column:
    return F.least(c.cast("long"), F.lit(most).cast("long"))


class Zip:
    """A stored archive; files of 4 GB and 65,535 members or more have the 64-bit records."""

    suffix, start = ".zip", ""

    def __init__(self, extension: str) -> None:
        self.extension = extension

    def name(self, k: Column) -> Column:
        # lpad would cut longer numbers
        number = (k + 1).cast("string")
        return F.concat(F.lit("page_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")), F.lit("." + self.extension)).cast("binary")

    def head(self, p) -> Column:
        name = self.name(p.k)
        fields = [F.lit(MEMBER + "14000000" + "0000" + DAY), _le(p.crc, 4), _le(p.size, 4), _le(p.size, 4), _le(F.octet_length(name), 2), F.lit("0000")]
        return F.concat(F.unhex(F.concat(*fields)), name)

    def head_size(self, p) -> Column:
        return F.octet_length(self.name(p.k)) + 30

    def entry_size(self, p) -> Column:
        return F.octet_length(self.name(p.k)) + F.when(p.at >= LONG_MAX, 58).otherwise(46)

    tail = b""

    def middle(self, n: Column, records_end: Column) -> Column:
        return F.lit(b"")

    def entry(self, p) -> Column:
        name, far = self.name(p.k), p.at >= LONG_MAX
        extra = F.when(far, F.concat(F.lit("01000800"), _le(p.at, 8))).otherwise(F.lit(""))
        fields = [F.lit(ENTRY + "2D002D000000" + "0000" + DAY), _le(p.crc, 4), _le(p.size, 4), _le(p.size, 4), _le(F.octet_length(name), 2), F.when(far, "0C00").otherwise("0000"), F.lit("0000000000000000" + "0000"), _le(_least(p.at, LONG_MAX), 4)]
        return F.concat(F.unhex(F.concat(*fields)), name, F.unhex(extra))

    def end(self, n: Column, records_end: Column, directory_at: Column, directory_size: Column) -> Column:
        large = (n >= SHORT_MAX) | (directory_at >= LONG_MAX) | (directory_size >= LONG_MAX)
        long = F.concat(F.lit(END64), _le(F.lit(44), 8), F.lit("2D002D000000000000000000"), _le(n, 8), _le(n, 8), _le(directory_size, 8), _le(directory_at, 8), F.lit(LOCATOR64 + "00000000"), _le(directory_at + directory_size, 8), F.lit("01000000"))
        count = _le(_least(n, SHORT_MAX), 2)
        short = F.concat(F.lit(END + "00000000"), count, count, _le(_least(directory_size, LONG_MAX), 4), _le(_least(directory_at, LONG_MAX), 4), F.lit("0000"))
        return F.unhex(F.concat(F.when(large, long).otherwise(F.lit("")), short))


class Book:
    """A PDF of grey pictures, each on a page of its size at ``dpi``, or as large as fits in the middle of a ``page`` (w, h) in points.

    Page k has the objects 4k + 3 (page), 4k + 4 (content), 4k + 5 (picture) and, if it is the first of a node, 4k + 6 (that node).
    """

    suffix, start = ".pdf", "%PDF-1.4\n"
    tail = b"\nendstream\nendobj\n"

    def __init__(self, width: int, height: int, dpi: float = 200.0, page: tuple[float, float] | None = None) -> None:
        self.width, self.height = width, height
        across, down = page or (width * 72 / dpi, height * 72 / dpi)
        scale = min(across / width, down / height)
        w, h = width * scale, height * scale
        self.box = f"{across:.3f} {down:.3f}"
        self.content = f"q {w:.3f} 0 0 {h:.3f} {(across - w) / 2:.3f} {(down - h) / 2:.3f} cm /P Do Q"

    def _objects(self, p) -> list[Column]:
        """Node (or nothing), page, content, and the picture up to its bytes."""
        number = lambda k, o: (k * 4 + o).cast("string")
        first = p.k % NODE_PAGES == 0
        node = p.k - p.k % NODE_PAGES
        below = F.least(F.lit(NODE_PAGES).cast("long"), p.n - p.k)
        kids = F.array_join(F.transform(F.sequence(p.k, p.k + below - 1), lambda k: F.concat(number(k, 3), F.lit(" 0 R"))), " ")
        tree = F.when(first, F.concat(number(p.k, 6), F.lit(" 0 obj\n<</Type/Pages/Parent 2 0 R/Count "), below.cast("string"), F.lit("/Kids["), kids, F.lit("]>>\nendobj\n"))).otherwise(F.lit(""))
        page = F.concat(number(p.k, 3), F.lit(" 0 obj\n<</Type/Page/Parent "), number(node, 6), F.lit(f" 0 R/MediaBox[0 0 {self.box}]/Contents "), number(p.k, 4), F.lit(" 0 R/Resources<</XObject<</P "), number(p.k, 5), F.lit(" 0 R>>>>>>\nendobj\n"))
        content = F.concat(number(p.k, 4), F.lit(f" 0 obj\n<</Length {len(self.content)}>>\nstream\n{self.content}\nendstream\nendobj\n"))
        picture = F.concat(number(p.k, 5), F.lit(f" 0 obj\n<</Type/XObject/Subtype/Image/Width {self.width}/Height {self.height}/ColorSpace/DeviceGray/BitsPerComponent 8/Length "), p.size.cast("string"), F.lit(">>\nstream\n"))
        return [tree, page, content, picture]

    def head(self, p) -> Column:
        return F.concat(*self._objects(p)).cast("binary")

    def head_size(self, p) -> Column:
        return F.length(F.concat(*self._objects(p)))

    def entry_size(self, p) -> Column:
        return F.lit(80)

    def _tree(self, n: Column) -> tuple[Column, Column]:
        nodes = F.transform(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(NODE_PAGES).cast("long")), lambda k: F.concat((k * 4 + 6).cast("string"), F.lit(" 0 R")))
        root = F.concat(F.lit("2 0 obj\n<</Type/Pages/Count "), n.cast("string"), F.lit("/Kids["), F.array_join(nodes, " "), F.lit("]>>\nendobj\n"))
        return F.lit("1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n"), root

    def _line(self, at: Column) -> Column:
        return F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))

    def middle(self, n: Column, records_end: Column) -> Column:
        catalog, root = self._tree(n)
        lines = F.concat(F.lit("xref\n0 "), (n * 4 + 3).cast("string"), F.lit("\n0000000000 65535 f \n"), self._line(records_end), self._line(records_end + F.length(catalog)))
        return F.concat(catalog, root, lines).cast("binary")

    def entry(self, p) -> Column:
        tree, page, content, _ = self._objects(p)
        a = p.at + F.length(tree)
        b = a + F.length(page)
        node = F.when(F.length(tree) > 0, self._line(p.at)).otherwise(F.lit("0000000000 00000 f \n"))
        # the format has ten digits for a place
        wide = F.raise_error(F.lit("a book holds at most 10 GB")).cast("string")
        return F.when(b < 9_999_000_000, F.concat(self._line(a), self._line(b), self._line(b + F.length(content)), node)).otherwise(wide).cast("binary")

    def end(self, n: Column, records_end: Column, directory_at: Column, directory_size: Column) -> Column:
        catalog, root = self._tree(n)
        xref = records_end + F.length(catalog) + F.length(root)
        return F.concat(F.lit("trailer\n<</Root 1 0 R/Size "), (n * 4 + 3).cast("string"), F.lit(">>\nstartxref\n"), xref.cast("string"), F.lit("\n%%EOF\n")).cast("binary")


@dataclass(frozen=True)
class _Page:
    """What is known of a page before its bytes are read."""

    k: Column
    n: Column
    size: Column
    crc: Column
    at: Column


def _page() -> _Page:
    return _Page(*(F.col(c) for c in ("k", "n", "size", "crc", "at")))


def _before(rows: DataFrame, size: Column, out: str) -> DataFrame:
    """``rows`` (g, _p, _r and others) with ``out``: the sum of ``size`` over earlier rows of the group; ranges first, then rows of a range."""
    earlier = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_size", size.cast("long"))
    ranges = rows.groupBy("g", "_p").agg(F.sum("_size").alias("_sum"))
    ranges = ranges.select("g", "_p", F.coalesce(F.sum("_sum").over(Window.partitionBy("g").orderBy("_p").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("g", "_p").orderBy("_r").rowsBetween(*earlier)), F.lit(0))
    return rows.withColumn("_inside", inside).join(ranges, ["g", "_p"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_size", "_inside", "_base")


def pieces(pages: DataFrame, form: Zip | Book) -> DataFrame:
    """(file, at, bytes): every piece of the files of ``pages`` (g, i, v), each group's pages in order of ``i``, at its place.

    Groups are named by their file names: unsafe characters are blanks, null and empty names "untitled"; groups of one name share
    a file. Null bytes are an empty page; pages of one ``i`` go by a hash of their bytes, null ``i`` first; repeated rows are pages each; other
    columns are ignored; an empty table has no files.
    """
    p = pages.select(F.coalesce(safe_filename(F.col("g").cast("string")), F.lit("untitled")).alias("g"), "i", F.coalesce(F.col("v").cast("binary"), F.lit(b"")).alias("v"))
    p = p.withColumn("_tie", F.xxhash64("v")).repartitionByRange("g", "i", "_tie").sortWithinPartitions("g", "i", "_tie")
    p = p.withColumn("_r", F.monotonically_increasing_id()).select("g", "v", "_r", F.octet_length("v").cast("long").alias("size"), F.crc32("v").alias("crc"))
    p = materialise(p.withColumn("_p", F.shiftright("_r", 33)), "archive-pages")
    rows = _before(p.drop("v"), F.lit(1), "k")
    rows = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    page = _page()
    record = form.head_size(page) + page.size + len(form.tail)
    rows = materialise(_before(rows, record, "at").withColumn("at", F.col("at") + len(form.start)), "archive-places")
    rows = materialise(_before(rows, form.entry_size(page), "entry_at"), "archive-entries")
    sums = rows.groupBy("g").agg(F.first("n").alias("n"), F.max(F.col("at") + record).alias("_records"), F.max(F.col("entry_at") + form.entry_size(page)).alias("_directory"))
    n, records = F.col("n"), F.col("_records")
    sums = sums.withColumn("_middle", form.middle(n, records)).withColumn("_from", records + F.octet_length("_middle"))
    file = F.concat("g", F.lit(form.suffix)).alias("file")
    entries = rows.join(sums.select("g", "_from"), "g").select(file, (F.col("_from") + F.col("entry_at")).alias("at"), form.entry(page).alias("bytes"))
    members = p.select("_r", "v").join(rows, "_r").select(file, "at", F.concat(form.head(page), F.col("v"), F.lit(form.tail)).alias("bytes"))
    rest = F.array(
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(form.start.encode()).alias("bytes")), F.struct(records.alias("at"), F.col("_middle").alias("bytes")),
        F.struct((F.col("_from") + F.col("_directory")).alias("at"), form.end(n, records, F.col("_from"), F.col("_directory")).alias("bytes")),
    )
    ends = sums.select(file, F.inline(rest)).where(F.octet_length("bytes") > 0)
    return members.unionByName(entries).unionByName(ends)


class PlacedWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.draft = options["path"], options["draft"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.draft, exist_ok=True)
        name, out, run, at = None, None, bytearray(), 0
        try:
            for r in rows:
                # pieces that follow each other, as lines of directories do, are one write
                if r["file"] != name or r["at"] != at + len(run) or len(run) >= RUN_BYTES:
                    self.place(out, run, at)
                    run, at = bytearray(), r["at"]
                if r["file"] != name:
                    if out is not None:
                        os.close(out)
                    name, out = r["file"], os.open(f"{self.draft}/{r['file']}", os.O_WRONLY | os.O_CREAT, 0o644)
                run += r["bytes"]
            self.place(out, run, at)
        finally:
            if out is not None:
                os.close(out)
        return WriterCommitMessage()

    @staticmethod
    def place(out: int | None, run: bytearray, at: int) -> None:
        view = memoryview(run)
        while view:
            done = os.pwrite(out, view, at)
            view, at = view[done:], at + done

    def commit(self, messages: list) -> None:
        os.makedirs(self.draft, exist_ok=True)
        os.rename(self.draft, self.path)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.draft, ignore_errors=True)


class PlacedBytes(DataSource):
    """A sink of rows (file, at, bytes) for files of the new folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "file string, at long, bytes binary"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options)


def write_files(pages: DataFrame, path: str, form: Zip | Book) -> None:
    """Write the files of ``pages`` (g, i, v), see ``pieces``, to the folder ``path``, which must not exist."""
    spark = pages.sparkSession
    path = re.sub("^file:/+", "/", path).rstrip("/")
    if not path.startswith("/"):
        raise ValueError(f"{path}: files are put together in a folder that all executors have mounted")
    if os.path.exists(path):
        raise FileExistsError(path)
    spark.dataSource.register(PlacedBytes)
    # any task can write any piece, so none is moved for it
    placed = pieces(pages, form).sortWithinPartitions("file", "at")
    placed.write.format("placed_bytes").mode("append").option("path", path).option("draft", f"{path}._draft-{uuid.uuid4().hex}").save()


def _end_of(f, size: int) -> tuple[int, int]:
    """(place of the directory, number of members) by the end of an archive, with a comment or without."""
    f.seek(max(0, size - SHORT_MAX - 22))
    last = f.read()
    at = last.rfind(bytes.fromhex(END))
    if at < 0:
        raise ValueError("no end of a directory: not a whole archive")
    n, place = int.from_bytes(last[at + 10 : at + 12], "little"), int.from_bytes(last[at + 16 : at + 20], "little")
    if last[max(0, at - 20) : at].startswith(bytes.fromhex(LOCATOR64)):
        f.seek(int.from_bytes(last[at - 12 : at - 4], "little"))
        long = f.read(56)
        n, place = int.from_bytes(long[32:40], "little"), int.from_bytes(long[48:56], "little")
    return place, n


def _table_of(f, size: int) -> tuple[int, int]:
    """(place of the first line of the table of objects, number of pages) of a book."""
    f.seek(max(0, size - 64))
    table = int(re.search(rb"startxref\s+(\d+)\s", f.read())[1])
    f.seek(table)
    head = re.match(rb"xref\s+0 (\d+)\s", f.read(64))
    return table + head.end(), (int(head[1]) - 3) // 4


def _ranges(per_task: int, directory):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                with open(path, "rb") as f:
                    place, n = directory(f, size)
                for lo in range(0, n, per_task):
                    yield pa.RecordBatch.from_pylist([{"path": path, "place": place, "lo": lo, "hi": min(n, lo + per_task)}])

    return run


MEMBERS = "archive string, k long, name string, at long, v binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            with open(r["path"], "rb") as directory, open(r["path"], "rb") as f:
                directory.seek(r["place"])
                for k in range(r["hi"]):
                    entry = directory.read(46)
                    name_size, extra_size, comment = (int.from_bytes(entry[x : x + 2], "little") for x in (28, 30, 32))
                    name, extra = directory.read(name_size), directory.read(extra_size + comment)[:extra_size]
                    if k < r["lo"]:
                        continue
                    size, at = int.from_bytes(entry[20:24], "little"), int.from_bytes(entry[42:46], "little")
                    if LONG_MAX in (size, int.from_bytes(entry[24:28], "little")):
                        raise ValueError(f"{r['path']}: member {name!r} is larger than 4 GB")
                    if at == LONG_MAX:
                        while extra[:2] != b"\x01\x00":
                            extra = extra[4 + int.from_bytes(extra[2:4], "little") :]
                        at = int.from_bytes(extra[4:12], "little")
                    f.seek(at)
                    head = f.read(30)
                    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                    data = f.read(size)
                    data = zlib.decompress(data, -15) if entry[10:12] == b"\x08\x00" else data
                    if zlib.crc32(data) != int.from_bytes(entry[16:20], "little"):
                        raise ValueError(f"{r['path']}: member {name!r} is damaged")
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(r["path"])]), pa.array([k], pa.int64()), pa.array([name.decode()]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["archive", "k", "name", "at", "v"])


def read_zips(spark: SparkSession, path: str, members_per_task: int = MEMBERS_PER_TASK) -> DataFrame:
    """(archive, k, name, at, v): members of all archives of a folder, number ``k`` of the directory and at ``at`` of the file.

    Directories are cut into ranges of ``members_per_task``, which tasks read by themselves, a member at a time. A damaged member is an error.
    """
    return _in_ranges(spark, path, "*.zip", _end_of, members_per_task).mapInArrow(_members, MEMBERS)


def _in_ranges(spark: SparkSession, path: str, names: str, directory, per_task: int) -> DataFrame:
    """(path, place, lo, hi): files of a folder, the places of their directories, and ranges of members, dealt evenly."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    ranges = listed.mapInArrow(_ranges(per_task, directory), "path string, place long, lo long, hi long")
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "lo")


PICTURES = "book string, k long, at long, v binary"


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            with open(r["path"], "rb") as f:
                for k in range(r["lo"], r["hi"]):
                    # lines of the table have one length
                    f.seek(r["place"] + 20 * (4 * k + 5))
                    at = int(f.read(10))
                    f.seek(at)
                    head = re.match(rb"%d 0 obj\n<<[^>]*/Length (\d+)>>\nstream\n" % (4 * k + 5), f.read(512))
                    if head is None:
                        raise ValueError(f"{r['path']}: page {k} is not where the table has it")
                    f.seek(at + head.end())
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(r["path"])]), pa.array([k], pa.int64()), pa.array([at], pa.int64()), pa.array([f.read(int(head[1]))], pa.binary())], names=["book", "k", "at", "v"])


def read_books(spark: SparkSession, path: str, pages_per_task: int = MEMBERS_PER_TASK) -> DataFrame:
    """(book, k, at, v): the pictures of the pages of all books that ``write_files`` put into a folder, found through their tables of objects."""
    return _in_ranges(spark, path, "*.pdf", _table_of, pages_per_task).mapInArrow(_pictures, PICTURES)
