"""WARC archives: monolithic gzip files and their normalisation.

``write_archives`` packs pages into WARC files that are one gzip stream each,
as some crawlers leave them. ``normalise`` inflates such a file once, as a
stream, rewrites every record as a gzip member of its own, and writes a sidecar
with the offset of every member, so that single records can be read again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import AtomicFile, bytes_of, new_folder, open_shared, partitions, released, small_batches, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    value = identifier.removeprefix("<urn:page:").removesuffix(">") if identifier else "null"
    return None if value == "null" else int(value)


def clean_uri(url: str | None) -> str:
    """Header values are one line: controls and spaces are percent-encoded; null gives urn:none."""
    if not url:
        return "urn:none"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP headers and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean_uri(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Contents of a gzip file of one or more members, in pieces of at most ``chunk`` bytes."""
    d, data = zlib.decompressobj(31), b""
    while True:
        if not data and not (data := stream.read(chunk)):
            break
        out = d.decompress(data, chunk)
        if out:
            yield out
        data = d.unconsumed_tail
        if d.eof:
            data = d.unused_data
            d = zlib.decompressobj(31)
        elif not data:
            continue
    if rest := d.flush():
        yield rest


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header bytes, pieces of the block and its end) of every record of a stream.

    A record's pieces must be used up before the next record is asked for. The
    buffer holds one header and one piece, however long a record is.
    """
    buf = bytearray()

    def fill() -> bool:
        piece = next(parts, None)
        if piece is None:
            return False
        buf.extend(piece)
        return True

    def body(left: int) -> Iterator[bytes]:
        while left:
            if not buf and not fill():
                raise ValueError("a record ends early")
            out = bytes(buf[:left])
            del buf[:left]
            left -= len(out)
            yield out

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill():
                if buf.strip():
                    raise ValueError("trailing bytes after the last record")
                return
        head = bytes(buf[:end])
        del buf[:end + 4]
        yield head, body(int(parse_headers(head)["content-length"]) + 4)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archives: int | None = None,
                   min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write pages as monolithic ``.warc.gz`` files; returns the written manifest (archive, n_records).

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the smallest page_id is a response and the others are revisits of it.
    Null html is an empty payload; a null url is ``urn:none``. Among rows equal
    in page_id and payload the first written is the response. Null page_ids
    come after all others when the response is chosen. Other columns are
    ignored. An empty table makes no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("sha", F.sha1("payload")).withColumn("key", F.concat_ws("#", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("sha")))
    # Narrow rows only: which digests repeat, and which pages are not the first of theirs.
    narrow = src.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "sha", "key")
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    revisits = narrow.join(firsts, "sha").filter(F.col("page_id").isNull() | (F.col("page_id") >= F.col("first"))).groupBy("key").agg(F.min("first").alias("first")).withColumn("repeats", F.lit(True))
    dealt = src.repartition(archives or partitions(spark), "key").join(revisits, "key", "left").sortWithinPartitions("page_id", "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, gz, n, last = TaskContext.get().partitionId(), None, None, 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "first", "repeats", "sha")]
            for page, link, first, repeats, sha, payload in zip(*cols, bytes_of(batch.column("payload")), strict=True):
                if out is None:
                    out, gz = AtomicFile(archive_uri(folder, number)), zlib.compressobj(level, zlib.DEFLATED, 31)
                    info = b"software: pandekt\r\nformat: WARC File Format 1.1\r\n"
                    out.write(gz.compress(VERSION + f"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{number}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                again = bool(repeats) and (page != first or (page, sha) == last)
                last = (page, sha)
                out.write(gz.compress(record_bytes(page, link, payload, first, again, date)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.publish()
            yield pa.RecordBatch.from_pydict({"archive": pa.array([number], pa.int64()), "n_records": pa.array([n], pa.int64())})

    return written(dealt.mapInArrow(released(run), "archive long, n_records long"), f"{folder}/manifest")


def archive_uri(folder: str, number: int) -> str:
    return f"{folder}/monolithic/pages-{number:06d}.warc.gz"


def member_uri(folder: str, number: int) -> str:
    return f"{folder}/records/pages-{number:06d}.warc.gz"


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite every record as its own gzip member; returns the written index.

    Index rows: archive, offset, length (compressed bytes), record_type,
    record_id, uri. The same rows lie beside each archive as JSON lines
    (``.cdxj``). An archive is one task; memory holds one piece of a record.
    """
    spark = manifest.sparkSession
    dealt = manifest.select("archive").repartition(partitions(spark), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("archive").to_pylist():
                out, side = AtomicFile(member_uri(folder, number)), AtomicFile(member_uri(folder, number) + ".cdxj")
                at, rows = 0, []
                with open_shared(archive_uri(folder, number)) as stream:
                    for head, body in split_records(inflate(stream)):
                        gz, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        pieces = [gz.compress(head + b"\r\n\r\n")]
                        for piece in body:
                            pieces.append(gz.compress(piece))
                            for x in pieces:
                                out.write(x)
                                size += len(x)
                            pieces = []
                        tail = b"".join([*pieces, gz.flush()])
                        out.write(tail)
                        size += len(tail)
                        h = parse_headers(head)
                        row = {"archive": number, "offset": at, "length": size, "record_type": h["warc-type"], "record_id": h["warc-record-id"], "uri": h.get("warc-target-uri", "")}
                        side.write(f"{row['uri'] or row['record_id']} {h['warc-date']} {json.dumps(row)}\n".encode())
                        at += size
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
                            rows = []
                out.publish()
                side.publish()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=INDEX)

    return written(dealt.mapInArrow(released(run), "archive long, offset long, length long, record_type string, record_id string, uri string"), f"{folder}/index")


INDEX = pa.schema([("archive", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string())])
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_member(raw: bytes) -> dict:
    """A page record from the bytes of its gzip member; the digest of a response is checked."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    h = parse_headers(head)
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
    if not revisit and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its headers")
    return {"page_id": page_of(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to")) if revisit else None,
            "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Page records at the given index rows, each read by one seek."""
    spark = index.sparkSession
    wanted = index.filter(F.col("record_type").isin("response", "revisit")).select("archive", "offset", "length")
    dealt = wanted.repartition(partitions(spark), "archive").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, current = None, None
        for batch in batches:
            rows, held = [], 0
            for number, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if number != current:
                    if stream is not None:
                        stream.close()
                    stream, current = open_shared(member_uri(folder, number)), number
                stream.seek(offset)
                row = read_member(stream.read(length))
                if not with_payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
        if stream is not None:
            stream.close()

    return dealt.mapInArrow(released(run), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = True, **columns) -> DataFrame:
    """Write, normalise and read back all pages."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(pages, folder, **columns), folder), folder, with_payload)
