"""WARC archives: written in segments with chunked transfer framing, read back by reassembling the segments."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import path_exists
from .common import Workspace, partitions, small_batches
from .files import reader, writer

#: Bytes of a record's block above which it is cut into segments; of one chunk of a body; of content after which a new file begins.
SEGMENT, CHUNK, FILE = 32 << 10, 8 << 10, 16 << 20
#: Payloads below this size are never written as revisits.
LEAST = 100
#: Archives carry a fixed date, so that writing again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
_LINE, _WINDOW = b"\r\n", 64 << 10


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(body[k : k + size]), body[k : k + size]) for k in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked transfer framing. Chunk extensions and trailers are skipped; framing that is cut short is an error."""
    out, at = [], 0
    while True:
        end = data.index(_LINE, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != _LINE:
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, headers: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **headers, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + _LINE + block + b"\r\n\r\n"


def _header_text(value: str | None) -> str:
    """A header's value has no line breaks."""
    return " ".join((value or "").split())


def page_records(record_id: str, page_id: int | None, url: str | None, body: bytes, digest: str, original: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a response in one or several segments, or a revisit of the page `original`."""
    headers: dict[str, object] = {"WARC-Target-URI": _header_text(url), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Bytes": len(body), "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        headers["X-Page-ID"] = page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if original is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{page_urn(original, digest)}>", "X-Refers-To-Page": original}
        return [_record("revisit", record_id, http, headers | more)]
    block = http + chunked(body)
    if len(block) <= segment:
        return [_record("response", record_id, block, headers)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record("response", record_id, parts[0], headers | {"WARC-Segment-Number": 1})]
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        out.append(_record("continuation", f"{record_id}:{n}", part, {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": n, **last}))
    return out


def page_urn(page: int | None, digest: str) -> str:
    """The identifier of a page's record, if there is one row of that id and payload; more of them add their place to it."""
    return f"urn:page:{'none' if page is None else page}:{digest[:16]}"


class _Stream:
    """Bytes of a file, compressed record by record or as a whole or not at all, as they are needed."""

    def __init__(self, source: Any) -> None:
        self.source, self.data, self.at = source, b"", 0
        self.raw = source.read(_WINDOW)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Add some bytes; false at the end of the file."""
        got = b""
        while not got:
            if not self.raw:
                self.raw = self.source.read(_WINDOW)
            if not self.raw:
                if self.member is not None and not self.member.eof and self.started:
                    raise ValueError("a compressed record is cut short")
                return False
            if self.member is None:
                got, self.raw = self.raw, b""
            else:
                if self.member.eof:
                    self.member = zlib.decompressobj(31)
                got = self.member.decompress(self.raw)
                self.raw = self.member.unused_data
                self.started = not self.member.eof
        self.data, self.at = self.data[self.at :] + got, 0
        return True

    started = False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before a mark, which is skipped; None at the end of the file."""
        look = self.at
        while (end := self.data.find(mark, look)) < 0:
            rest = len(self.data) - self.at
            if not self.more():
                if self.data[self.at :].strip():
                    raise ValueError("a record is cut short")
                return None
            look = max(0, rest - len(mark))
        out = self.data[self.at : end]
        self.at = end + len(mark)
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self.more():
                raise ValueError("a record is cut short")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def parse_records(source: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of all records of a file (a stream or bytes). One record is held at a time."""
    stream = _Stream(io.BytesIO(source) if isinstance(source, bytes) else source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        yield headers, stream.exactly(int(headers["content-length"]))
        stream.until(b"\r\n\r\n")


def revisit_targets(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(page, digest, bytes, copies, original): for each distinct id and payload how many rows have both, and the page that they revisit, else null.

    Only digests are shuffled. Pages of one payload are a hot key at worst in a join that the adaptive skew join splits; their minimum is combined before the shuffle.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    each = pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    light = each.groupBy("page", "digest", "bytes").agg(F.count("*").alias("copies"))
    first = light.where((F.col("bytes") >= LEAST) & F.col("page").isNotNull()).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = light.join(first, "digest", "left")
    return joined.select("page", "digest", "bytes", "copies", F.when(F.col("page") > F.col("first"), F.col("first")).alias("original"))


def write_archives(pages: DataFrame, ws: Workspace, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> str:
    """Write one record for each row of pages into compressed archives in the shared folder; returns the folder's address.

    A null html is an empty payload; a null or repeated page id is written like any other, as is a null url; every record has an identifier of its own. Nothing else of
    pages is read. A manifest beside the folder names the archives of the tasks that ended; what tasks left that didn't is not in it. No pages give no archives.
    """
    spark = pages.sparkSession
    name = f"{ws.path}/warc"
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(F.encode(body, "UTF-8"), 256).alias("sha"))
    targets = revisit_targets(pages, id_col, body_col)
    rows = rows.join(targets, rows.id.eqNullSafe(targets.page) & (rows.sha == targets.digest)).select("id", "url", "body", "digest", "copies", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt, k, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, 0
        out, path, size = None, "", 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "bytes"])
        for batch in batches:
            for page, url, text, digest, copies, original in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body", "digest", "copies", "original")), strict=True):
                n += 1
                record_id = page_urn(page, digest) + (f":{task}.{n}" if copies > 1 else "")
                if out is None:
                    path, size = f"{name}/part-{task:06d}-{attempt}-{k:04d}.warc.gz", 0
                    out = writer(path)
                for record in page_records(record_id, page, url, text.encode("utf-8", "surrogatepass"), digest, original):
                    c = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = c.compress(record) + c.flush()
                    out.write(data)
                    size += len(data)
                if size >= FILE:
                    out.close()
                    yield done()
                    out, k = None, k + 1
        if out is not None:
            out.close()
            yield done()

    with small_batches(spark):
        rows.mapInArrow(run, "path string, bytes long").write.parquet(f"{name}-manifest")
    return name


def archives(spark: SparkSession, address: str) -> DataFrame:
    """(path): the archives of a folder, those of its manifest if it has one; their contents are not read."""
    if path_exists(spark, f"{address}-manifest"):
        return spark.read.schema("path string, bytes long").parquet(f"{address}-manifest").select("path")
    if not path_exists(spark, address):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(address).select("path")


_SCHEMA = "origin string, segment int, total long, kind string, page_id long, refers_to long, uri string, digest string, bytes long, block binary"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.strip().split()[0] for x in _SCHEMA.split(",")]


def _payload(origin: str, digest: str | None, block: bytes) -> bytes:
    """The body of a response's block, its framing decoded and its digest verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"{origin}: the payload doesn't have the stated digest")
    return body


def read_archives(spark: SparkSession, address: str, payload: bool = True) -> DataFrame:
    """(record_id, page_id, record_type, refers_to, target_uri, digest, payload_bytes, payload binary) of the responses and revisits of all archives in a folder.

    Segments are grouped by the identifier of their origin, ordered by number, and must be without gaps and of the stated total length; chunked framing
    is decoded and the payload's digest verified; whatever doesn't hold is an error. A group is one record, so its size is bounded by that record.
    A revisit's payload is null; its digest and size are those of the full payload. payload=False verifies alike but leaves payloads out. A folder without archives gives no rows.
    Archives are read record by record and only once: whole records are finished where they are read, and segments alone go on.
    """
    ws = Workspace(spark, "warc-read")
    bare = lambda x: x.strip("<>")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with reader(path) as source:
                    for h, block in parse_records(source):
                        kind, page = h["warc-type"], h.get("x-page-id")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        origin, segment = bare(h.get("warc-segment-origin-id", h["warc-record-id"])), int(h.get("warc-segment-number", 0))
                        refers = h.get("x-refers-to-page")
                        digest, total = h.get("warc-payload-digest", "").rpartition(":")[2] or None, h.get("warc-segment-total-length")
                        full = int(h["x-payload-bytes"]) if "x-payload-bytes" in h else None
                        if not segment:
                            block = _payload(origin, digest, block) if kind == "response" else None
                            full = full if block is None else len(block)
                            block = block if payload else None
                        rows.append((origin, segment, int(total) if total else None, kind, int(page) if page else None, int(refers) if refers else None, h.get("warc-target-uri"), digest, full, block))
                        size += len(block or b"") + 256
                        if size > FILE // 4:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block = b"".join(p["block"] for p in r["parts"])
                if not r["ordered"] or r["total"] != len(block):
                    raise ValueError(f"{r['origin']}: segments are missing or don't have the stated length")
                body = _payload(r["origin"], r["digest"], block) if r["kind"] == "response" else None
                rows.append((r["origin"], r["page_id"], r["kind"], r["refers_to"], r["uri"], r["digest"], r["bytes"] if body is None else len(body), body if payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types, strict=True)], out_names)

    out_types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    out_names = ["record_id", "page_id", "record_type", "refers_to", "target_uri", "digest", "payload_bytes", "payload"]
    schema = "record_id string, page_id long, record_type string, refers_to long, target_uri string, digest string, payload_bytes long, payload binary"
    with small_batches(spark):
        records = ws.save(archives(spark, address).repartition(partitions(spark), "path").mapInArrow(parse, _SCHEMA), "records")
        whole = records.where("segment = 0").select("origin", "page_id", "kind", "refers_to", "uri", "digest", "bytes", "block").toDF(*out_names)
        parts = records.where("segment > 0").groupBy("origin").agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
            *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "refers_to", "uri", "digest", "bytes")),
        )
        ordered = (F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))) & F.col("total").isNotNull() & F.col("kind").isNotNull()
        long = ws.save(parts.withColumn("ordered", ordered).mapInArrow(joined, schema), "joined")
    return (whole if payload else whole.withColumn("payload", F.lit(None).cast("binary"))).unionByName(long)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: digests and kinds of records."""
    ws = Workspace(spark, "warc")
    back = read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), ws), payload=False)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
