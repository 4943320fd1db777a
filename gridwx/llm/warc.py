"""WARC archives: a writer of response and revisit records, and a salvage reader.

An archive is a sequence of gzip members, one per record, or of plain records. The reader checks each record (member
checksum, version line, length, end mark, block digest). After a failed check it searches for the next place where a valid
member or version line begins, goes on from there, and logs the bytes between as a quarantined gap. The content of a member
is searched in the same way, of a damaged one as far as it unpacks; there only records with a block digest that fits count.
Each search goes on where the one before ended, so the time is in proportion to the bytes whatever they hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Copies of the list of repeated payloads that the join is dealt over, so that a frequent payload does not meet in one task.
SALTS = 16
#: Bytes that the reader unpacks from one member: more than a value of Spark can hold, so such a record has no row.
LARGEST = (1 << 31) + (1 << 20)

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_END = b"\r\n\r\n"
#: Fields that a record has once; a header in which one returns is two headers run together.
_SINGLE = (b"content-length", b"warc-type", b"warc-record-id")
_DIGESTS = ("sha1", "sha256", "sha512", "md5")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(column)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to to pages.

    Of records with equal payloads of `least` bytes or more, those with the largest page_id are responses and the others
    revisit it; shorter payloads, and records whose page_id is null, are responses. A null html is an empty payload. Payloads
    are equal by SHA-256, as SHA-1 can be made to agree. Columns of pages with the added names are replaced.
    """
    added = ("payload_digest", "record_type", "refers_to")
    kept = [c for c in pages.columns if c not in added]
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.struct(*[payload.alias(c) if c == "html" else F.col(c) for c in kept]).alias("page"),
        F.sha2(payload, 256).alias("key"),
        F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"),
        (F.octet_length(payload) >= least).alias("long"),
    )
    repeated = (
        rows.where("long")
        .groupBy("key")
        .agg(F.max("page.page_id").alias("last"), F.min("page.page_id").alias("first"))
        .where("first < last")
        .select("key", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    again = F.col("long") & (F.col("page.page_id") < F.col("last"))
    return rows.join(repeated, ["key", "salt"], "left").select(
        "page.*",
        base32_sha1(F.col("page.html").cast("binary")).alias("payload_digest"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
    )


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the response's headers, its payload's length among them, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines += [f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Page-ID: {page_id}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages that mark_revisits has marked: archive string, content binary."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, members, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(6)]):
                page_id, url, html, digest, kind, refers_to = [x.as_py() for x in row]
                members.append(gzip_member(record(page_id, url, html.encode(), digest, kind, refers_to)))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield close()
                    n, members, size = n + 1, [], 0
        if members:
            yield close()

    columns = pages.selectExpr("CAST(page_id AS LONG) page_id", "url", "html", "payload_digest", "record_type", "CAST(refers_to AS LONG) refers_to")
    return columns.mapInArrow(write, "archive string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive (column content, whole gzip members) as a file of its own in a new folder, and return the files
    (path, content). The names are Spark's.

    A member without content ends each file, as the text writer puts a mark after every row: `gzip -t` finds no fault.
    """
    spark = archives.sparkSession
    writer = archives.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", gzip_member(b"").decode("latin-1")).text(folder)
    return spark.read.format("binaryFile").load(folder).select("path", "content")


class Places:
    """The next place of a pattern at or after a position. Positions only grow, so all searches pass the data once."""

    def __init__(self, search: Callable[[int], int]) -> None:
        self.search, self.place = search, -1

    def next(self, at: int) -> int:
        if self.place < at:
            self.place = self.search(at)
        return self.place


def _fits(said: bytes, block: memoryview, known: dict[str, tuple[bytes, bytes]]) -> bool | None:
    """Whether the block has the digest said, in base 32 or 16; None for an algorithm that is not known."""
    name, _, value = said.partition(b":")
    name = name.decode("latin-1").strip().lower()
    if name not in _DIGESTS:
        return None
    if name not in known:
        digest = hashlib.new(name, block).digest()
        known[name] = base64.b32encode(digest).rstrip(b"="), digest.hex().upper().encode()
    return value.strip().rstrip(b"=").upper() in known[name]


def _plain_record(data: bytes, at: int, head: int, digest_needed: bool) -> tuple[int, int, dict[str, str], bytes] | None:
    """Start, end, headers and block of the first valid record whose version line stands from `at` on and before `head`,
    where the header lines end. The lines are gone through once, from the last, for all of these version lines."""
    fields: dict[bytes, bytes] = {}
    digests: dict[int, dict] = {}
    lines = data[at:head].split(b"\r\n")
    begin, best = head + 2, None

    def valid() -> int | None:
        length = fields.get(b"content-length", b"")
        if not length.isdigit() or len(length) > 18:
            return None
        end = head + 4 + int(length)
        if data[end : end + 4] != _END:
            return None
        said = fields.get(b"warc-block-digest")
        good = _fits(said, memoryview(data)[head + 4 : end], digests.setdefault(end, {})) if said else None
        return end if good or (good is None and not digest_needed) else None

    for i in range(len(lines) - 1, -1, -1):
        line = lines[i]
        begin -= len(line) + 2
        if line.endswith(_VERSIONS) and (end := valid()) is not None:
            best = begin + len(line) - 8, i, end
        if line[:1] in (b" ", b"\t"):  # goes on with the line before
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon or (name in fields and name in _SINGLE):
            break
        fields.setdefault(name, value.strip())
    if best is None:
        return None
    start, i, end = best
    headers = {}
    for line in lines[i + 1 :]:
        if line[:1] not in (b" ", b"\t"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
    return start, end + 4, headers, data[head + 4 : end]


def _member(data: bytes, at: int, largest: int) -> tuple[bytes, int, bool]:
    """Content and end of the gzip member at `at`, as far as it unpacks, and whether it is sound. Fed in steps, so what
    follows is not copied."""
    unpacker, content, size, step = zlib.decompressobj(31), [], 0, 1 << 16
    while not unpacker.eof:
        piece = data[at : at + step]
        try:
            content.append(unpacker.decompress(piece))
        except zlib.error:
            return b"".join(content), at, False
        at += len(piece)
        size += len(content[-1])
        if not piece or size > largest:
            return b"".join(content), at, False
    return b"".join(content), at - len(unpacker.unused_data), True


def salvage(data: bytes, largest: int = LARGEST) -> Iterator[tuple[str, int, int, tuple[int, int] | None, dict[str, str], bytes]]:
    """("record" or "gap", start, end, inner, headers, block) in the order of the archive; gaps have no headers and no block.

    Start and end are places in the archive, inner places in the member's content, where there is a member. What is
    recovered from a damaged member lies within its gap.
    """
    return _search(data, True, False, largest)


def _search(data: bytes, members: bool, digest_needed: bool, largest: int) -> Iterator[tuple[str, int, int, tuple[int, int] | None, dict[str, str], bytes]]:
    n = len(data)

    def found_at(pattern: bytes) -> Places:
        return Places(lambda at: n if (place := data.find(pattern, at)) < 0 else place)

    versions = Places(lambda at: m.start() if (m := _VERSION.search(data, at)) else n)
    heads, magics = found_at(_END), found_at(_MAGIC)
    at, bad = 0, -1
    while at < n:
        after, one, items, end = at + 1, None, None, at
        if members and data.startswith(_MAGIC, at):
            content, end, sound = _member(data, at, largest)
            items = [("gap" if i == "gap" else "record", at, end, (s, e), h, b) for i, s, e, _, h, b in _search(content, False, not sound, largest)]
            if not sound:
                yield from (x for x in items if x[0] == "record")
                items = None
        elif versions.next(at) == at:
            after = head = heads.next(at)
            one = _plain_record(data, at, head, digest_needed) if head < n else None
            if one:
                start, end, headers, block = one
                items = [("record", start, end, None, headers, block)]
                if bad < 0 and start > at:
                    bad = at
        if items is not None:
            if bad >= 0:
                yield "gap", bad, one[0] if one else at, None, {}, b""
                bad = -1
            yield from items
            at = end
            continue
        if bad < 0:
            bad = at
        at = min(versions.next(after), magics.next(at + 1) if members else n)
    if bad >= 0:
        yield "gap", bad, n, None, {}, b""


RECORDS = (
    "archive string, item string, start long, end long, inner_start long, inner_end long, record_id string, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, payload binary, refers_to long"
)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps (item) of archives: archive string or, for files, path, and content binary.

    start and end are places in the archive, inner_start and inner_end places in the content of the gzip member there.
    payload is null for revisits, whose payload_bytes and payload_digest are those of the full payload. A payload that
    does not fit its digest makes the record a gap. A page id or length that is no 64-bit number is null. Null contents
    and empty archives give no rows.
    """

    def number(text: str | None) -> int | None:
        found = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
        return found if found is not None and -(1 << 63) <= found < 1 << 63 else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("archive", pa.string()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64())]
            + [("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())]
        )
        rows, size = [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                name, data = archive.as_py(), content.as_py()
                for item, start, end, inner, headers, block in salvage(data or b""):
                    place = (start, end, *(inner or (None, None)))
                    row = (name, item, *place) + (None,) * 8
                    if item == "record":
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = headers.get("warc-type")
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
                        if kind == "response":
                            said, digest = digest, base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if said and said != digest:
                                rows.append((name, "gap", *place) + (None,) * 8)
                                continue
                        bytes_ = len(payload) if kind == "response" else number(length[1].decode()) if length else None
                        row = (name, item, *place, headers.get("warc-record-id"), number(headers.get("warc-page-id")), headers.get("warc-target-uri"), kind)
                        row += (digest, bytes_, payload if kind == "response" else None, number(headers.get("warc-refers-to-page-id")))
                    rows.append(row)
                    size += len(block)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    name = "archive" if "archive" in archives.columns else "path"
    return archives.select(name, "content").mapInArrow(read, RECORDS)
