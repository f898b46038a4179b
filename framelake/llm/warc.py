"""WARC archives: write pages as records with revisits, read archives back and salvage damaged ones."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, shared_path
from .urls import possible

MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: An empty gzip member. It follows each record, and its last byte is the separator of Spark's text writer.
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
#: Archives are closed at about this many bytes of payload; a reader holds one archive.
ARCHIVE_BYTES = 24 << 20
STEP = 16 << 10
MIN_REVISIT_BYTES = 100
RECORDS = "archive string, record_offset long, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_bytes long, problem string"


def _urn(page_id: int | None, digest: str) -> str:
    number = int(digest[:32], 16) | 1 << 127 if page_id is None else page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def _page_id(urn: str | None) -> int | None:
    """The number that ``_urn`` put into a record id; null for ids of other writers."""
    try:
        number = uuid.UUID(urn.strip("<>")[9:]).int if urn else 1 << 64
    except ValueError:
        return None
    return None if number >> 64 else number - (1 << 64 if number >> 63 else 0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP head, which states the length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}"]
    if page_id is None:
        head.append("WARC-Page-Unknown: true")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True)
        # the writer puts the separator, the empty member's last byte, after each value
        out = [record(i.as_py(), u.as_py(), p.as_py(), d.as_py(), r.as_py()) + _EMPTY[:-1] for i, u, p, d, r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["bytes"])


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): equal payloads refer to that of the smallest id.

    The smallest ids come from partial sums by digest, not from windows, so a payload
    that a third of the pages share is never in one task. Only rows that a Bloom filter of
    repeated digests lets through are shuffled for the join that gives them these ids; a page whose
    payload is its own stays where it was read.

    Null html is an empty payload; a row with a null id refers to nothing and is not
    referred to; of rows repeated under the smallest id each is a response; an empty
    table gives an empty result. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT_BYTES
    first = pages.select("page_id", payload.alias("payload")).where(large).groupBy(F.sha2("payload", 256).alias("_key")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    first = materialise(first, "warc-repeated")
    asked = possible(p, first.select(F.col("_key").alias("url")), "digest")
    ask = F.col("possible") & large & F.col("page_id").isNotNull()
    out = ["page_id", "url", "payload", "digest"]
    joined = asked.where(ask).join(first, F.col("digest") == F.col("_key"), "left")
    alone = asked.where(~ask).select(*out, F.lit(None).cast(first.schema["_first"].dataType).alias("refers_to"))
    return alone.unionByName(joined.select(*out, F.when(F.col("page_id") > F.col("_first"), F.col("_first")).alias("refers_to")))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to gzip archives under ``path``.

    Spark's text writer puts the bytes down as they are and its commit protocol keeps
    one copy of each archive when a task runs twice. Null html is an empty payload; a
    null url has no target line; rows with null ids are responses; repeated rows are
    records each; an empty table leaves a folder without records. An archive is closed at the mean
    number of records that make ``archive_bytes``, so that of pages longer than others is larger.
    """
    n, total = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    per_file = max(1, archive_bytes * n // max(1, total))
    records = deduplicated(pages).mapInArrow(_records, "bytes binary").select(F.col("bytes").cast("string"))
    records.write.option("lineSep", _EMPTY[-1:].decode()).option("maxRecordsPerFile", per_file).text(path)


def _members(data: bytes) -> Iterator[tuple[int, int, bytes | None, str, bool]]:
    """(offset, end, content, problem, plain) of gzip members and of plain stretches between them.

    A stretch without a member goes on to the next member that decodes at all; from its
    first version line on it is plain, before that a gap. Of a member that is cut off or
    damaged inside, what did decode is content with a problem and ends where decoding
    stopped, give or take ``STEP``; the search goes on inside it for what follows.
    """
    view, at, gap = memoryview(data), 0, None

    def between(start: int, end: int) -> Iterator[tuple[int, int, bytes | None, str, bool]]:
        line = VERSION.search(data, start, end) if end > start else None
        stop = line.start() if line else end
        if stop > start:
            yield start, stop, None, "bytes between members do not decode", False
        if line:
            yield stop, end, data[stop:end], "", True

    while at < len(data):
        content, end, whole = b"", at, False
        if data.startswith(MEMBER, at):
            z = zlib.decompressobj(31)
            # in steps, so that what follows the member is not copied for each one
            parts, size = [], STEP
            while not z.eof and end < len(data):
                before, step = z.copy(), view[end : end + size]
                try:
                    parts.append(z.decompress(step))
                except zlib.error:
                    if size == 1:
                        break
                    # again in bytes, to keep what decodes before the damage
                    z, size = before, 1
                    continue
                end += len(step)
            content, whole = b"".join(parts), z.eof
            end -= len(z.unused_data)
        if not whole and not VERSION.search(content):
            gap = at if gap is None else gap
            at = data.find(MEMBER, at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield from between(gap, at)
            gap = None
        yield at, end, content, "" if whole else "the member is cut off or damaged", False
        if not whole:
            # damage may have led the decoder on into the members after it
            gap = end
            at = data.find(MEMBER, at + 1)
            at = len(data) if at < 0 else at
            continue
        at = end
    if gap is not None:
        yield from between(gap, len(data))


def parse(content: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, end, record, problem) of the records in uncompressed WARC bytes.

    A record whose head, length, block digest or payload digest fails is given up;
    the search goes on at the next version line after it and the bytes between are
    a gap. A digest is checked by the algorithm it names, in hex, base32 or base64; one
    that is absent or of an unknown algorithm is not checked, nor is that of a payload
    whose transfer encoding its writer may have taken off.
    """
    at, gap, problem = 0, None, ""
    while at < len(content):
        found, why = _one(content, at)
        if found is None:
            if gap is None:
                gap, problem = at, why
            nxt = VERSION.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        if gap is not None:
            yield gap, at, None, problem
            gap = None
        end = found.pop("end")
        yield at, end, found, ""
        at = end
    if gap is not None:
        yield gap, len(content), None, problem


def _one(content: bytes, at: int) -> tuple[dict | None, str]:
    start = VERSION.match(content, at)
    stop = content.find(b"\r\n\r\n", at)
    if not start or stop < 0:
        return None, "no version line or head"
    head = {}
    for line in content[start.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        return None, "no length"
    begin = stop + 4
    end = begin + int(head["content-length"])
    block = content[begin:end]
    if content[end : end + 4] != b"\r\n\r\n":
        return None, "length does not lead to the end of a record"
    if differs(head.get("warc-block-digest", ""), block):
        return None, "block digest differs"
    kind = head.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    if kind == "response" and not re.search(rb"(?i)\r\ntransfer-encoding:", http) and differs(head.get("warc-payload-digest", ""), payload):
        return None, "payload digest differs"
    ids = [None if "warc-page-unknown" in head else _page_id(head.get("warc-record-id")), _page_id(head.get("warc-refers-to"))]
    found = {"end": end + 4, "page_id": ids[0], "uri": head.get("warc-target-uri"), "record_type": kind, "refers_to": ids[1], "payload": None, "payload_bytes": None}
    found["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in ("response", "resource", "conversion"):
        found |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    elif length := re.search(rb"(?i)\r\ncontent-length: *(\d+)", http):
        found["payload_bytes"] = int(length[1])
    return found, ""


def differs(stated: str, data: bytes) -> bool:
    """Whether a labelled digest names a known algorithm and is not that of the bytes."""
    name, _, text = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if not text or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return False
    digest = hashlib.new(name, data).digest()
    text = text.strip()
    same = text.lower() == digest.hex() or text.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")
    return not same and text.rstrip("=") != base64.b64encode(digest).decode().rstrip("=")


def salvage(path: str, data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, compressed member by member, plain, or both in turn.

    An archive with a version line and no member before it is plain to its end. Offsets
    and sizes of gaps inside a member are those of its uncompressed bytes; the rest of a
    member that does not decode is a gap from where decoding stopped.
    """
    blank = dict.fromkeys(("page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "gap_bytes", "problem"))
    first = VERSION.search(data)
    members = [(0, len(data), data, "", True)] if first and MEMBER not in data[: first.start()] else _members(data)
    for at, end, content, problem, plain in members:
        if content is None:
            yield blank | {"archive": path, "record_offset": at, "record_type": "gap", "gap_bytes": end - at, "problem": problem}
            continue
        for start, stop, found, why in parse(content):
            offset = at + start if plain else at
            if found is None:
                yield blank | {"archive": path, "record_offset": offset, "record_type": "gap", "gap_bytes": stop - start, "problem": problem or why}
            else:
                yield blank | found | {"archive": path, "record_offset": offset}


def _salvage_batches(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, types[t]) for n, t in (x.strip().split() for x in RECORDS.split(","))])
        for b in batches:
            for p, c in zip(b.column("path"), b.column("content"), strict=True):
                rows, held = [], 0
                for r in salvage(p.as_py(), c.as_py()):
                    if not with_payload:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under ``path`` and, as rows of type ``gap``, the quarantined byte ranges.

    Each archive is one row of the file source, which takes up to 2 GB; archives of that
    size need executors that hold one and its largest member. Digests of payloads are
    SHA-256 in hex whatever the archive states; of revisits they are as stated. Ids are
    null in archives of other writers. A folder without records gives an empty result.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvage_batches(with_payload), RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; a gap in an archive just written is an error."""
    path = shared_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path, with_payload=False)
    lost = F.concat(F.lit("archive "), "archive", F.lit(" has a gap: "), F.coalesce("problem", F.lit("")))
    back = back.where(F.when(F.col("record_type") == "gap", F.raise_error(lost).cast("boolean")).otherwise(True))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint b, sha256(coalesce(html, '')) d from pages),
f as (select *, case when b >= 100 then min(page_id) over (partition by d) end m from p)
select page_id, b payload_bytes, d payload_digest, case when page_id > m then 'revisit' else 'response' end record_type,
       case when page_id > m then m end refers_to from f""",
}
