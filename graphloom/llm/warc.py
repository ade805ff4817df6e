"""WARC archives: written as gzip members by Spark's writer, read by a splittable scanner."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byteranges import opened, ranges

MAGIC = b"\x1f\x8b\x08"
LEAST_DEDUPLICATED = 1000
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
CHUNK_BYTES = 16 << 10  # of what is read ahead, so that a member's end is overshot by little
LEVEL = 6
CHAIN = 4
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RESPONSE_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    head = RESPONSE_HEAD.format(len(payload)).encode()
    body = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte: an empty member follows where the length's last byte isn't zero."""
    found = gzip.compress(record, LEVEL, mtime=0)
    return found if found.endswith(b"\0") else found + EMPTY_MEMBER


def with_references(pages: DataFrame, least: int = LEAST_DEDUPLICATED, key: str = "page_id") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each page's record needs.

    Pages with equal payloads of at least ``least`` bytes refer to the largest
    id among them; that page, and smaller ones, refer to none.  The largest id
    of each payload is aggregated before the shuffle.  Rows that repeat the
    largest id are all responses; a null id refers to the largest if there is
    one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select(F.col(key).alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = F.octet_length("payload") >= least
    copies = full.where(long).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "refers_to")
    joined = full.join(copies, (F.col("digest") == F.col("_digest")) & long, "left").drop("_digest")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write a record for every page to archives under ``path``.

    Spark's text writer writes the members' bytes and, as its line end, the
    zero byte that each ends in, so archives are plain concatenated members,
    on any file system, and only finished tasks' files are kept.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                made = [member(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers_to"] is not None))[:-1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    members = with_references(pages, **options).mapInArrow(pack, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class ReadAhead:
    """A file read in large pieces one after the other; what a small step back needs is still held."""

    def __init__(self, file) -> None:
        self.file, self.at, self.start, self.held = file, 0, 0, b""

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        if not self.start <= self.at <= self.start + len(self.held):
            self.file.seek(self.at)
            self.start, self.held = self.at, b""
        lack = self.at + size - self.start - len(self.held)
        if lack > 0:
            self.held = self.held[self.at - self.start :] + self.file.read(max(lack, READ_BYTES))
            self.start = self.at
        found = self.held[self.at - self.start : self.at - self.start + size]
        self.at += len(found)
        return found


def members_in(uri: str, start: int, stop: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Offsets and contents of the WARC members of a file that start in ``[start, stop)``.

    Candidates are the gzip magic numbers in the range.  A candidate counts
    when its first bytes inflate to a WARC version line, and it and the
    ``CHAIN`` - 1 members after it (fewer at the end of the file) inflate to
    their ends with the right checksums; compressed bytes that look like magic
    fail that, and so do up to that many records stored openly in a payload.
    Members that follow a valid one are read on from its end, not searched for.
    The file is read ahead in large pieces, each about once.
    """
    with opened(uri) as raw:
        file, at, trusted = ReadAhead(raw), start, start == 0
        while at < stop:
            if not trusted:
                at = _find_magic(file, at, stop, length)
                if at < 0:
                    return
                if not _chained(file, at, length):
                    at += 1
                    continue
            found = _inflate(file, at, length)
            if found is None:
                at, trusted = at + 1, False
                continue
            data, end = found
            if data:
                yield at, data
            at, trusted = end, True


def _chained(file, at: int, length: int) -> bool:
    for _ in range(CHAIN):
        if at == length:
            return True
        found = _inflate(file, at, length) if _head_is_warc(file, at, length) else None
        if found is None:
            return False
        at = found[1]
    return True


def _find_magic(file, at: int, stop: int, length: int) -> int:
    while at < stop:
        file.seek(at)
        chunk = file.read(min(READ_BYTES, length - at))
        hit = chunk.find(MAGIC)
        if hit >= 0 and at + hit < stop:
            if _head_is_warc(file, at + hit, length):
                return at + hit
            at += hit + 1
        elif hit >= 0 or at + len(chunk) >= length:
            return -1
        else:
            at += max(1, len(chunk) - len(MAGIC) + 1)
    return -1


def _head_is_warc(file, at: int, length: int) -> bool:
    """Whether a member whose first bytes are a WARC version line, or an empty one, starts here."""
    file.seek(at)
    chunk = file.read(min(CHUNK_BYTES, length - at))
    if chunk.startswith(EMPTY_MEMBER):
        return True
    if not chunk.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(chunk, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(file, at: int, length: int) -> tuple[bytes, int] | None:
    file.seek(at)
    inflater, parts, read = zlib.decompressobj(31), [], 0
    try:
        while not inflater.eof:
            chunk = file.read(min(CHUNK_BYTES, length - at - read))
            if not chunk:
                return None
            read += len(chunk)
            parts.append(inflater.decompress(chunk))
    except zlib.error:
        return None
    return b"".join(parts), at + read - len(inflater.unused_data)


def parse_record(data: bytes) -> dict:
    """Headers and content of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return {"type": fields.get("warc-type"), "fields": fields, "payload": payload, "http_length": int(sizes[0]) if sizes else len(payload)}


def read_archives(spark, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to`` of every record under ``path``.

    A task reads ranges of ``split`` bytes and owns the records that start in
    them; one record at a time is held.  Length and digest of a response are
    taken from its payload; a revisit's from its headers, its payload is null.
    """
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for _, data in members_in(r["path"], r["start"], r["stop"], r["length"]):
                    rows.append(_row(parse_record(data)))
                    held += len(data)
                    if held > READ_BYTES:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return ranges(spark, path, split, "part-*").mapInArrow(scan, schema)


def _row(record: dict) -> tuple:
    fields = record["fields"]
    own = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    if record["type"] == "revisit":
        payload, size, digest = None, record["http_length"], fields["warc-payload-digest"].removeprefix("sha1:")
    else:
        payload, size, digest = record["payload"], len(record["payload"]), hashlib.sha1(record["payload"]).hexdigest()
    return int(own) if own else None, fields.get("warc-target-uri"), record["type"], payload, size, digest, int(refers) if refers else None
