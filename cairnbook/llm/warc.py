"""WARC archives: writing with segmented records and chunked transfer framing, and reading them back whole.

A payload is sent as an HTTP response with chunked framing. A block longer than the segment size becomes a first
segment and continuation records, which name their origin, their number and, in the last, the total length. Reading
groups continuations by origin identifier, orders them by segment number, verifies the total length and takes the
chunks apart. Of equal payloads, one record is the response and the others revisit it.

Scale: equal payloads meet as counts per digest (partially aggregated), and the winners join back salted, so that a
third of all pages may be one payload. Only segmented records are shuffled when reading, one record a group.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.files import new_file, reading, writing
from cairnbook.llm.shared import bounded, fresh_path, materialise, salted_left_join

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HTTP_ALONE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[k:k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are skipped, a broken frame raises."""
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        n = int(framed[at:eol].split(b";", 1)[0], 16)
        at = eol + 2
        if not n:
            return b"".join(out)
        if framed[at + n:at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(framed[at:at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + _END) + squeeze.flush()


def _urn(page: int | None, row: int, segment: int = 1) -> str:
    """A record's identifier; rows that share a page id differ by their place."""
    return f"<urn:page:{'' if page is None else page}:{row}:{segment}>"


def records(page: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of one page, each a gzip member."""
    common = [("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), *([("WARC-Target-URI", url.replace("\r", "").replace("\n", ""))] if url else [])]
    named = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), *([("X-Page-Id", str(page))] if page is not None else [])]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page, row)), *common, *named, profile, ("X-Refers-To-Page", str(refers_to))], _HTTP_ALONE)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", _urn(page, row)), *common, *named], block)
        return
    parts = [block[k:k + segment] for k in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", _urn(page, row)), *common, *named, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(page, row, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", _urn(page, row)), ("WARC-Segment-Number", str(k)), *total], part)


def read_records(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of a .warc.gz stream."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is shorter than its length says")
        yield fields, block


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to: of equal payloads of least_bytes or more, the row
    with the largest page_id is the response (null refers_to) and the others refer to it. Rows that share that largest
    page_id are all responses. Null html: empty. Payloads seen only with null page_ids: all responses."""
    raw = F.coalesce(F.col("html"), F.lit(""))
    rows = bounded(pages).select("page_id", "url", raw.alias("html"), F.sha1(raw.cast("binary")).alias("payload_digest"), F.octet_length(raw).alias("_bytes"))
    winners = rows.filter(F.col("_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.max("page_id").alias("winner")).filter("_n > 1 and winner is not null").select("payload_digest", "winner")
    joined = salted_left_join(rows, winners, ["payload_digest"])
    refers_to = F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner"))
    return joined.select("page_id", "url", "html", "payload_digest", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes one .warc.gz per task into the shared folder; returns the manifest (path, n_records) of the tasks that
    succeeded. pages: page_id, url, html; repeated rows get a record each; an empty table writes no record."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        path = new_file(folder, part, ".warc.gz")
        with writing(path) as out:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
                for page, url, html, digest, refers_to in zip(*columns, strict=True):
                    for one in records(page, part << 40 | row, url, html.encode(), digest, refers_to, segment):
                        out.write(one)
                    row += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([row], pa.int64())], names=["path", "n_records"])

    return materialise(with_revisits(pages).mapInArrow(run, "path string, n_records long"), "warc-manifest")


_READ = "record string, page_id long, record_type string, declared_digest string, declared_bytes long, refers_to long, segment int, total long, block binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload (binary; null for a revisit), payload_bytes, payload_digest of every
    response and revisit in the manifest's archives, with segments put together. A revisit's figures are those that its
    record declares. A missing segment, a wrong total or a digest that isn't the payload's raises."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _READ.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with reading(path) as source:
                    for f, block in read_records(source):
                        whole = lambda k, f=f: int(f[k]) if k in f else None
                        rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), whole("x-page-id"), f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:"), whole("x-payload-length"), whole("x-refers-to-page"), whole("warc-segment-number"), whole("warc-segment-total-length"), block))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes, digests = [], [], []
            for kind, blocks, total, digest, n in zip(*(batch.column(c).to_pylist() for c in ("record_type", "blocks", "total", "declared_digest", "declared_bytes")), strict=True):
                if kind == "revisit":
                    payloads.append(None)
                    sizes.append(n)
                    digests.append(digest)
                    continue
                block = b"".join(blocks)
                if total is not None and len(block) != total:
                    raise ValueError("segments of a record don't have the length that its last one states")
                head, _, body = block.partition(_END)
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                found = hashlib.sha1(payload).hexdigest()
                if digest and found != digest:
                    raise ValueError("a payload isn't what its digest says")
                payloads.append(payload)
                sizes.append(len(payload))
                digests.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_type"), batch.column("refers_to"), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])

    files = max(1, manifest.count())
    spark = manifest.sparkSession
    found = materialise(manifest.select("path").repartition(min(files, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(scan, _READ), "warc-records", "zstd")
    keep = ["page_id", "record_type", "refers_to", "declared_digest", "declared_bytes"]
    single = found.filter("segment is null").select(*keep, F.lit(None).cast("long").alias("total"), F.array("block").alias("blocks"))
    parts = found.filter("segment is not null").groupBy("record").agg(
        F.max("page_id").alias("page_id"), F.max("declared_digest").alias("declared_digest"), F.max("declared_bytes").alias("declared_bytes"),
        F.max("total").alias("total"), F.count("*").alias("n"), F.max("segment").alias("last"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    good = (F.col("n") == F.col("last")) & F.col("total").isNotNull()
    checked = F.when(good, F.col("parts.block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("record"))))
    whole = parts.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "declared_digest", "declared_bytes", "total", checked.alias("blocks"))
    return single.unionByName(whole).mapInArrow(open_up, "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def op9_warc_segments(spark, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), w AS (
  SELECT html, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.html = w.html AND p.payload_bytes >= 1000
"""
