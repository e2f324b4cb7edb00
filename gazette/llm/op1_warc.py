"""WARC archives: writing with deduplication and segmentation, and reading back with segment reassembly.

Writing: one record for each page, gzip members in archives of bounded size. Of pages with equal payloads the one with the least id is
a ``response``; the others are ``revisit`` records that name it and carry no payload. A response's HTTP body is chunked; blocks above
``segment`` bytes are cut into a first record and ``continuation`` records. Archives are named after the partition that wrote them and
moved into place when complete, so a task that runs again replaces its own files.

Reading: archives are parsed in tasks; whole records are decoded at once, segments are grouped by their origin identifier, put in order
of segment number, checked against the total length, and only then is the chunked framing decoded.

Cases: a null payload counts as empty, and empty payloads are equal to each other; pages equal in id and payload are all responses
under record ids of their own, and a revisit names none of several by record id, only the page;
a null id is written without an id and comes back null, as a response unless a page with an id has the same payload; line ends in URLs
are percent-encoded; a record with a missing segment, a wrong total length or broken framing comes back with ``complete`` false and null
payload; columns other than id, URL and payload are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import scratch, stored, table

SEGMENT = 32 << 10
CHUNK = 8 << 10
ARCHIVE = 8 << 20
_END = b"\r\n"
_RECORD = "record string, page_id long, url string, kind string, refers_to long, digest string, length long, origin string, number int, total long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, part: int = 1, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{part}{copy}')}>"


def framed(payload: bytes, chunk: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), chunk):
        part = payload[at : at + chunk]
        out += [b"%x" % len(part), _END, part, _END]
    return b"".join([*out, b"0", _END, _END])


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(_END, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != _END:
            raise ValueError("broken chunk")
        out.append(part)
        at += size + 2


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + _END + block + _END + _END) + packer.flush()


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int, chunk: int, copy: str = "", named: bool = True) -> Iterator[bytes]:
    """``copy`` tells rows equal in id and payload apart; a revisit names its response only where that is one record (``named``)."""
    digest = digest_of(payload)
    own = record_id(page_id, digest, copy=copy)
    date = ("WARC-Date", "1970-01-01T00:00:00Z")
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    shared = [("WARC-Target-URI", target), date, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest) if named else None), ("X-Refers-To-Page-Id", refers_to)]
        yield member(head + shared, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload, chunk)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("Content-Type", "application/http; msgtype=response")]
    yield member(head + shared + ([("WARC-Segment-Number", 1)] if len(pieces) > 1 else []), pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
        yield member([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, n, copy)), date, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), *last], piece)


class Archives:
    """Writes members into archives of about ``most`` bytes; an archive appears under its name only when complete."""

    def __init__(self, folder: str, stem: str, most: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.stem, self.most, self.number, self.sink = stem, most, 0, None

    def add(self, data: bytes) -> tuple[str, int] | None:
        if self.sink is None:
            self.path = f"{self.root}/{self.stem}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.root}/_{uuid.uuid4().hex}"
            self.sink, self.size = self.files.open_output_stream(self.temporary, compression=None), 0
        self.sink.write(data)
        self.size += len(data)
        return self.close() if self.size >= self.most else None

    def close(self) -> tuple[str, int] | None:
        if self.sink is None:
            return None
        self.sink.close()
        self.sink = None
        self.number += 1
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.temporary, self.path)
        return self.path, self.size


def _write(folder: str, segment: int, chunk: int, archive: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(folder, f"part-{TaskContext.get().partitionId():06d}", archive)
        copies: dict[tuple[int | None, bytes], int] = {}
        row = lambda done: pa.RecordBatch.from_pydict({"path": [done[0]], "bytes": pa.array([done[1]], pa.int64())})
        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "payload", "refers_to", "several", "named")]
            for i in range(len(batch)):
                page, url, payload, refers, several, named = (c[i].as_py() for c in columns)
                copy = ""
                if several:
                    # Equal rows are numbered in their partition: the numbers don't depend on the order of rows when a task runs again.
                    key = (page, hashlib.sha1(payload or b"").digest())
                    copies[key] = copies.get(key, 0) + 1
                    copy = f":{TaskContext.get().partitionId()}:{copies[key]}"
                for data in records(page, url, payload or b"", refers, segment, chunk, copy, named is not False):
                    if done := out.add(data):
                        yield row(done)
        if done := out.close():
            yield row(done)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Writes all pages below ``folder`` (a URI that driver and executors share) and returns path and bytes of each archive."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    ids = rows.select("page_id", F.sha1("payload").alias("sha"))
    counted = ids.groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first")
    firsts = counted.groupBy("sha").agg(first, F.sum("n").alias("total")).filter("total > 1").drop("total")
    later = F.coalesce(F.col("page_id") != F.col("first.page_id"), F.col("first.page_id").isNotNull())
    # Written first: a join with an aggregate can't split a payload that many pages have, a join with a table can.
    later = counted.join(stored(firsts, "firsts"), "sha").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.when(later, F.col("first.page_id")).alias("refers_to"), (F.col("n") > 1).alias("several"), (F.col("first.n") == 1).alias("named"))
    later = later.filter("refers_to is not null or several")
    marked = rows.join(later, rows["page_id"].eqNullSafe(later["p"]) & (F.sha1(rows["payload"]) == later["s"]), "left").drop("p", "s")
    return stored(marked.mapInArrow(_write(folder, segment, chunk, archive), "path string, bytes long"), "manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        yield headers | {"block": stream.read(int(headers["content-length"]))}


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    for batch in batches:
        for i in range(len(batch)):
            rows: list[dict] = []
            size = 0
            with gzip.GzipFile(fileobj=io.BytesIO(batch.column("content")[i].as_py())) as stream:
                for r in parse(io.BufferedReader(stream, 1 << 20)):
                    number = _number(r.get("warc-segment-number"))
                    own = r["warc-record-id"]
                    rows.append({"record": own, "page_id": _number(r.get("x-page-id")), "url": r.get("warc-target-uri"), "kind": r["warc-type"], "refers_to": _number(r.get("x-refers-to-page-id")), "digest": (r.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "length": _number(r.get("x-payload-length"))}
                                | {"origin": r.get("warc-segment-origin-id") or (own if number else None), "number": number, "total": _number(r.get("warc-segment-total-length")), "block": r["block"]})
                    size += len(r["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response, or None if its framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    try:
        return unframed(body)
    except ValueError:
        return None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, declared, length = batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), batch.column("length").to_pylist()
        whole, payloads = batch.column("whole").to_pylist(), []
        for i, pieces in enumerate(batch.column("pieces")):
            payloads.append(payload_of(b"".join(pieces.as_py())) if kind[i] == "response" and whole[i] else None)
        good = [k == "revisit" or p is not None for k, p in zip(kind, payloads)]
        columns = {k: batch.column(k) for k in ("page_id", "url", "kind", "refers_to")}
        columns |= {"payload": pa.array(payloads, pa.binary()), "bytes": pa.array([len(p) if p is not None else n if k == "revisit" else None for p, n, k in zip(payloads, length, kind)], pa.int64())}
        columns |= {"digest": pa.array([digest_of(p) if p is not None else d if k == "revisit" else None for p, d, k in zip(payloads, declared, kind)], pa.string()), "complete": pa.array(good)}
        yield pa.RecordBatch.from_pydict(columns)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each response or revisit below ``folder``: page_id, url, kind, refers_to, payload, bytes, digest, complete.

    ``payload`` is null for revisits, whose digest and length come from their headers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    parsed = stored(files.mapInArrow(_read, _RECORD), "records")
    names = ["page_id", "url", "kind", "refers_to", "digest", "length", "pieces", "whole"]
    single = parsed.filter("origin is null").withColumn("whole", F.lit(True)).withColumn("pieces", F.array("block")).select(names)
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    grouped = parsed.filter("origin is not null").groupBy("origin").agg(*(first(c) for c in names[:6]), F.max("total").alias("total"), parts.alias("parts"))
    # The segments are joined once, in the task that decodes them.
    joined = grouped.withColumn("pieces", F.expr("transform(parts, x -> x.block)")).withColumn("size", F.expr("aggregate(parts, 0L, (a, x) -> a + octet_length(x.block))"))
    ordered = F.expr("transform(parts, x -> x.number) = sequence(1, size(parts))")
    reassembled = joined.withColumn("whole", F.coalesce(ordered & (F.col("size") == F.col("total")), F.lit(False))).withColumn("kind", F.coalesce("kind", F.lit("response")))
    schema = "page_id long, url string, kind string, refers_to long, payload binary, bytes long, digest string, complete boolean"
    return single.unionByName(reassembled.select(names)).mapInArrow(_decode, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    out = read_archives(spark, folder)
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "complete")
