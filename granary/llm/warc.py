"""WARC archives: writing with segmented records, reading with reassembly.

Every page gives one record, `response` or `revisit`, whose block is an HTTP response; payloads above `chunk_from` bytes
are framed as chunked transfers. A block above `segment` bytes is cut into the record itself (segment 1) and
`continuation` records that name its identifier, their number and, in the last, the total length. Reading groups
continuations by that identifier, orders them by number, checks the total length, undoes the transfer framing and checks
the payload's digest. Archives are gzip files in the shared folder, each of about `archive` bytes of records (one page
more at most), written by Spark's committed writer, so that a lost executor leaves no partial file behind.

Of pages with equal payloads of at least `least` bytes the one with the largest key is the response (rows tied on it
all are), the others revisit it; smaller payloads are all responses. Null payloads count as empty; null keys come back
null and are not referred to unless all keys of the payload are null; long payloads are taken whole, in segments;
repeated rows give repeated rows; an empty table gives an empty one; columns besides key, address and payload are not
read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut, new_path, session_of, small_batches

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The content of a chunked transfer; extensions and trailers are skipped, damage raises ValueError."""
    out, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + CRLF + CRLF


def records(data: bytes):
    """Headers and block of each record; damage raises ValueError."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != CRLF + CRLF:
            raise ValueError(f"truncated record at byte {at}")
        yield headers, block
        at = end + 8 + size


def written(key, url: str | None, payload: bytes, digest: str, refers, revisit: bool, segment: int, chunk_from: int, chunk: int) -> bytes:
    """The record or records of one page."""
    address = re.sub(r"[\x00-\x20]", "%20", url or "urn:none")
    name = f"<urn:uuid:{uuid.uuid4()}>"
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": address, "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": key}
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "Refers-To-Page-ID": refers}
    headers["Content-Type"] = "application/http; msgtype=response"
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        return record(headers, start + b"Content-Length: %d\r\n\r\n" % len(payload))
    if len(payload) > chunk_from:
        block = start + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    else:
        block = start + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    if len(block) <= segment:
        return record(headers, block)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(headers | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Target-URI": address, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}
        out.append(record(own, part))
    return b"".join(out)


def read_block(block: bytes) -> tuple[bytes | None, int]:
    """Payload (none where only its length is told) and its length."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = dict(line.lower().split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:])
    if fields.get("transfer-encoding") == "chunked":
        body = unchunked(body)
        return body, len(body)
    size = int(fields["content-length"])
    if body and len(body) != size:
        raise ValueError("payload of another length")
    return (None if size and not body else body), size


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, segment: int = 16_384, chunk_from: int = 2_048, chunk: int = 4_096, archive: int = 16 << 20) -> None:
    """Writes one record (and its continuations) for each row into gzip files under path."""
    small_batches(session_of(pages))
    own = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).cast("string").alias("u"), F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("p"))
    own = own.withColumn("d", F.unhex(F.sha1("p"))).withColumn("size", F.octet_length("p"))
    groups = own.where(F.col("size") >= least).groupBy("d", "size").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").select(F.col("d").alias("gd"), F.col("size").alias("gs"), "top")  # the rest needs no reference
    groups = cut(groups, "repeated")  # digests and keys alone; where they are few, no payload is dealt
    dealt = own.join(checked(groups, groups.count()), (F.col("d") == F.col("gd")) & (F.col("size") == F.col("gs")), "left")
    dealt = dealt.select("k", "u", "p", F.lower(F.hex("d")).alias("d"), "top", (F.col("gd").isNotNull() & ~F.col("k").eqNullSafe(F.col("top"))).alias("again"))

    def run(batches):
        held: list[bytes] = []  # records of one archive, each without its end
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([(CRLF + CRLF).join(held)], pa.binary())], ["value"])

        for batch in batches:
            for k, u, p, d, top, again in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(written(k, u, p, d, top, again, segment, chunk_from, chunk)[:-4])
                size += len(held[-1])
                if size >= archive:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    # The text writer puts bytes as they are; its line end is the end of a record, so run() leaves the last one off.
    lines = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of each record, continuations joined to theirs."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    whole = pa.schema([(key, pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda text: None if text in (None, "None") else int(text)

    def result(headers, block):
        body, size = read_block(block)
        told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if body is not None and hashlib.sha1(body).hexdigest() != told:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        return number(headers.get("Page-ID")), size, told, headers["WARC-Type"], number(headers.get("Refers-To-Page-ID"))

    def parse(batches):
        """Whole records as results; segments with their origin, number and total length."""
        for batch in batches:
            for data in batch.column(0):
                out = []
                for headers, block in records(gzip.decompress(data.as_py())):
                    n = headers.get("WARC-Segment-Number")
                    if n is None:
                        out.append((*result(headers, block), None, None, None, None, None))
                    else:
                        head = "\r\n".join(f"{k}: {v}" for k, v in headers.items()) if n == "1" else None
                        out.append((None, None, None, None, None, headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), int(n), number(headers.get("WARC-Segment-Total-Length")), head, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(every), every)], every.names)

    every = pa.schema([*whole, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])
    kinds = f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    parsed = files.mapInArrow(parse, kinds + ", origin string, number int, total bigint, head string, block binary")
    # Segments of a record come together by its identifier, in order; whole records pass by with keys of their own.
    dealt = parsed.repartition(F.coalesce("origin", F.xxhash64("payload_digest", f"`{key}`").cast("string"))).sortWithinPartitions("origin", "number")

    def join(batches):
        held: list = []  # the segments of one record

        def joined():
            numbers = [n for n, _, _, _ in held]
            block = b"".join(b for _, _, _, b in held)
            if numbers != list(range(1, len(held) + 1)) or held[-1][1] != len(block):
                raise ValueError("segments missing")
            return result(dict(line.split(": ", 1) for line in held[0][2].split("\r\n")), block)

        origin = None
        for batch in batches:
            out = []
            for *done, name, n, total, head, block in zip(*(c.to_pylist() for c in batch.columns)):
                if held and name != origin:
                    out.append(joined())
                    held.clear()
                if name is None:
                    out.append(tuple(done))
                else:
                    origin = name
                    held.append((n, total, head, block))
            yield pa.RecordBatch.from_pydict({f.name: [row[i] for row in out] for i, f in enumerate(whole)}, whole)
        if held:
            yield pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(whole, joined())}, whole)

    return dealt.mapInArrow(join, kinds)


def round_trip(pages: DataFrame, path: str | None = None, key: str = "page_id", **options) -> DataFrame:
    """Writes the archives of all pages and returns what reading them gives."""
    spark = session_of(pages)
    path = path or new_path(spark, "warc")
    write_archives(pages, path, key, **options)
    return read_archives(spark, path, key)
