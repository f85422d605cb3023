"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages damaged files.

Each record is a gzip member of its own. Archives are written by Spark's text sink, whose commit protocol
makes the files whole when executors are lost: the last byte of a member is the top byte of its length,
zero for records below 16 MiB, and that zero is what the sink writes as its line end. A longer record
keeps its last byte, and the zero after it is padding between members.

The reader checks every member (its CRC, the records' framing, their digests). After a failed check it looks for the
next gzip member or ``WARC/1.`` version line that passes, goes on from there, and reports the bytes between
as a quarantined gap. Plain and compressed records may alternate in a file, and a member may hold several records, among which the
search goes on in the same way. The search reads a file once: the ends of heads are looked up in order, a head is read up to its first
line that is none, and what failed checks may inflate and digest is bounded by a multiple of the file's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import shared_folder, ship_package, small_side, stored

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[0-9]+\r\n")
END = b"\r\n\r\n"
#: Compressed bytes given to zlib at a time.
STEP = 4096
#: Bytes of a record's head at most.
HEAD = 1 << 16
#: Bytes that failed checks may inflate and digest: so many times the file's, and some more. Beyond it, a candidate that asks for more is passed over.
WASTE, WASTE_MORE = 16, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where a search for the next record may go on: a gzip member or a version line, which then must pass all checks.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_PADDING = re.compile(rb"\0+")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
READ_SCHEMA = (
    "archive string, start long, end long, gap string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary"
)


# ---------------------------------------------------------------- records


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is that of the payload left out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else page_urn(page_id)[1:-1]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", page_urn(refers_to))] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + END


def member(record: bytes) -> bytes:
    """``record`` as a gzip member without its last byte where that is zero (the sink writes it)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    return data[:-1] if data[-1] == 0 else data


@dataclass
class Found:
    """A record, or a gap if ``gap`` says why its bytes were passed over."""

    start: int
    end: int
    gap: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Damaged(ValueError):
    pass


class Reader:
    """The records of one archive, or of one inflated member."""

    def __init__(self, data: bytes, waste: list[int] | None = None):
        self.data, self.head_end, self.inside = data, -1, waste is not None
        self.waste = waste or [WASTE * len(data) + WASTE_MORE]

    def spend(self, size: int) -> None:
        """Before a check that reads ``size`` bytes; what passes is given back."""
        if size > self.waste[0]:
            raise Damaged("failed checks have read too much to check this one")
        self.waste[0] -= size

    def plain(self, start: int) -> Found:
        """The uncompressed record that begins at ``start``; Damaged if any check fails."""
        data = self.data
        version = VERSION.match(data, start)
        if not version:
            raise Damaged("no record head")
        if self.head_end < start:  # asked for in order, so all searches together read the data once
            found = data.find(END, start)
            self.head_end = found if found >= 0 else len(data)
        if self.head_end == len(data) or self.head_end - start > HEAD:
            raise Damaged("no record head")
        fields, at = {}, version.end()
        while at < self.head_end:
            stop = data.find(b"\r\n", at, self.head_end)
            line = data[at : stop if stop >= 0 else self.head_end]
            key, colon, value = line.partition(b":")
            if not colon:
                raise Damaged("head line without a colon")
            fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
            at += len(line) + 2
        length = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            raise Damaged("no content length")
        begin = self.head_end + len(END)
        end = begin + int(length)
        if data[end : end + len(END)] != END:
            raise Damaged("record does not end where its length says")
        self.spend(end - begin)
        block = data[begin:end]
        digest = fields.get("warc-block-digest", "").removeprefix("sha1:")
        if digest and digest != sha1_base32(block):
            raise Damaged("block digest differs")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if digest and fields.get("warc-type") == "response" and digest != sha1_base32(payload_of(block)):
            raise Damaged("payload digest differs")
        self.waste[0] += end - begin
        return Found(start, end + len(END), None, fields, block)

    def member(self, start: int) -> list[Found]:
        """The records, and gaps between them, of the gzip member that begins at ``start``. Damaged if it is not whole or has no record."""
        data, opener, at, parts, size = memoryview(self.data), zlib.decompressobj(31), start, [], 0
        try:
            while not opener.eof:  # in steps, as what follows the member is copied by zlib
                if at >= len(data):
                    raise Damaged("gzip member is cut off")
                parts.append(opener.decompress(data[at : at + STEP]))
                self.spend(STEP + len(parts[-1]))
                size += STEP + len(parts[-1])
                at += STEP
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        end = min(at, len(data)) - len(opener.unused_data)
        inside = list(Reader(b"".join(parts), self.waste).records())
        if all(found.gap is not None for found in inside):
            raise Damaged(inside[0].gap if inside else "gzip member is empty")
        self.waste[0] += size
        return [Found(start, end, found.gap and f"in a member: {found.gap}", found.fields, found.block) for found in inside]

    def records(self) -> Iterator[Found]:
        """All records, and a gap for each run of bytes that belongs to none."""
        data, at, size = self.data, 0, len(self.data)
        why, lost = "", None
        while at < size:
            if lost is None and data[at] == 0:  # padding between members
                at = _PADDING.match(data, at).end()
                continue
            try:
                found = self.member(at) if data.startswith(GZIP, at) and not self.inside else [self.plain(at)]
            except Damaged as e:
                if lost is None:
                    lost, why = at, str(e)
                following = _START.search(data, at + 1)
                at = following.start() if following else size
                continue
            if lost is not None:
                yield Found(lost, at, why)
                lost = None
            yield from found
            at = found[-1].end
        if lost is not None:
            yield Found(lost, size, why)


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, and a gap for each run of bytes that belongs to none. Records of one gzip member have the member's place."""
    return Reader(data).records()


def payload_of(block: bytes) -> bytes:
    return block.partition(END)[2]


# ---------------------------------------------------------------- Spark jobs


def write_archives(
    spark: SparkSession, pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z"
) -> None:
    """Write ``pages`` (page_id, url, payload binary) as gzip WARC archives below ``path``.

    Of pages with equal payloads of at least ``least_bytes`` the one with the largest page_id becomes the
    response and the others revisits of it; smaller payloads are all responses. A null payload is empty, a
    null page_id comes after all others; rows that share the largest page_id and the payload are all
    responses. Payloads are equal if their SHA-256 and length are. A payload that a third of all pages share costs the grouping one row a task;
    the payloads that repeat are a table, broadcast if it is small, and else the join that tells pages their response is one that
    Spark's skew handling can split. Archives are written where that join leaves the pages; an archive holds the pages of about
    ``archive_bytes`` of payload at most.
    """
    ship_package(spark)
    folder = shared_folder(spark)
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("size"))
    groups = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("pages"))
    groups = stored(groups, f"{folder}/payloads")
    size = groups.agg(F.sum(F.col("size") * F.col("pages")).alias("bytes"), F.sum("pages").alias("pages")).first()
    each = max(1, archive_bytes * (size["pages"] or 1) // max(1, size["bytes"] or 1))
    repeated = stored(groups.where("pages > 1").select("digest", "size", "response_id", F.lit(True).alias("repeated")), f"{folder}/repeated")
    is_revisit: Column = F.col("repeated").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    records = keyed.join(small_side(repeated), ["digest", "size"], "left").select("page_id", "url", "payload", "response_id", is_revisit.alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "response_id", "revisit")), strict=True)
            yield pa.RecordBatch.from_pydict({"member": pa.array((member(record_bytes(*row, date)) for row in rows), pa.binary())})

    members = records.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value"))
    written(members, each, path)


def written(members: DataFrame, each: int, path: str) -> None:
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", each).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``, one row each (``gap`` is null for records).

    ``payloads=False`` leaves the payload column null. For a revisit, payload_bytes and payload_digest are
    those of the payload it refers to. An empty archive has no rows.
    """
    ship_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[dict] = []
                for found in salvage(content.as_py()):
                    rows.append(described(found, payloads) | {"archive": archive.as_py()})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, READ_SCHEMA)


def described(found: Found, payloads: bool) -> dict:
    get = found.fields.get
    row = {"start": found.start, "end": found.end, "gap": found.gap}
    if found.gap is not None:
        return row
    head, _, payload = found.block.partition(END)
    length = len(payload)
    if get("warc-type") == "revisit":
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        length = int(told[1]) if told else None
    return row | {
        "record_type": get("warc-type"),
        "record_id": get("warc-record-id"),
        "refers_to": get("warc-refers-to"),
        "target_uri": get("warc-target-uri"),
        "payload_digest": get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": length,
        "payload": payload if payloads else None,
    }


def page_of(urn: Column) -> Column:
    """The page_id in a record's name; null for the page without one."""
    return F.regexp_extract(urn, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")
