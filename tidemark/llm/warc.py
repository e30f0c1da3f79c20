"""WARC archives with an index (operator 1).

Writing: each task writes gzip members, one a record, to archives of its own in the shared folder and gives an index row for
each record (path, offset, length, url, digest). Only the index that a finished job has stored counts, so archives of lost or
repeated attempts are never read. Reading: the selected index rows are dealt by archive and stretch of it, sorted by offset, and
neighbouring byte ranges are fetched in one read.

Payload digests are counted before writing: of equal payloads the smallest page_id becomes the response, the others revisit it. A
revisit has the response's HTTP head, with the full payload's length, and no payload.

Defined results
  html null or empty        an empty payload (0 bytes); equal to every other empty payload
  url null                  a record without a target; characters that a URI may not hold are percent-encoded
  page_id null              never the smallest; where a payload has only such rows, all are responses
  repeated page_id          every row with the payload's smallest page_id is a response
  very long html            one record, in memory as a whole
  empty table               no archives, no rows
  more columns              ignored
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: An archive is closed when it has reached so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Archives are dealt in stretches; a task reads about TASK_BYTES of records, or less where cores would be idle, but not under LEAST_BYTES;
#: ranges less than GAP apart are read at once, up to READ_BYTES.
STRETCH = 4 << 20
TASK_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
GAP = 64 << 10
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of one payload are dealt over so many join keys.
SALTS = 16

_INDEX = "page_id long, url string, digest string, record_type string, refers_to long, path string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool) -> bytes:
    """One record, uncompressed."""
    name = lambda p, kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{p} {digest} {kind}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {name(page_id, 'response' if is_response else 'revisit')}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not is_response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to, 'response')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _payload(html: str | Column) -> Column:
    return F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))


def decide(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload("html").alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "_sha")
    copies = C.materialize(large.groupBy("_sha").agg(F.min("page_id").alias("_low"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _low is not null").drop("_n"), "warc-copies")
    if copies.count() <= C.BROADCAST_ROWS:
        joined = rows.join(F.broadcast(copies), "_sha", "left")
    else:
        salted = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_sha", "_salt"], "left")
    revisit = F.col("_low").isNotNull() & ~F.col("_low").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("_low")).alias("refers_to"))


def write(pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; gives their index, stored in the shared folder."""
    spark = pages.sparkSession
    folder = folder or C.new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        for b in batches:
            index = []
            for page_id, url, payload, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
                    at = out.write(_gz(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                data = payload.encode()
                digest = digest_of(data)
                member = _gz(record(page_id, url, data, digest, refers_to, refers_to is None))
                out.write(member)
                index.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, path, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if index:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*index, strict=True), kinds, strict=True)], ["page_id", "url", "digest", "record_type", "refers_to", "path", "offset", "length"])
        if out is not None:
            out.close()

    return C.materialize(decide(pages, min_bytes=min_bytes).mapInArrow(run, _INDEX), "warc-index")


def ranges(offset: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Runs [i, j) of sorted byte ranges that are read at once."""
    out, i = [], 0
    for j in range(1, len(offset) + 1):
        if j == len(offset) or offset[j] - (offset[j - 1] + length[j - 1]) > GAP or offset[j] + length[j] - offset[i] > READ_BYTES:
            out.append((i, j))
            i = j
    return out


def read(index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Read the records of `index` (any selection of its rows) back: page_id, url, payload_bytes and payload_digest of the full payload,
    record_type, refers_to, and the payload that the record itself holds. A payload that doesn't fit its digest raises."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload string" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            offset, length = (b.column(i).to_numpy() for i in (1, 2))
            cut = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            rows = []
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                fs, p = pafs.FileSystem.from_uri(paths[lo])
                with fs.open_input_file(p) as f:
                    for i, j in ranges(offset[lo:hi], length[lo:hi]):
                        first = int(offset[lo + i])
                        data = f.read_at(int(offset[lo + j - 1] + length[lo + j - 1]) - first, first)
                        for k in range(lo + i, lo + j):
                            a = int(offset[k]) - first
                            fields, http, payload = parse(zlib.decompress(data[a : a + int(length[k])], 31))
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            full = int(http.rpartition(b"Content-Length: ")[2])
                            if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != full):
                                raise ValueError(f"{paths[k]} at {offset[k]}: the payload doesn't fit its digest")
                            page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                            row = (page and int(page), fields.get("WARC-Target-URI"), full, digest, fields["WARC-Type"], refers and int(refers))
                            rows.append((*row, payload.decode()) if with_payload else row)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: len(rows[0])]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(rows[0])]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # the index is small beside what it points at: tasks are counted by the archives' bytes, not by the index's
    slim = index.select("path", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("_stretch"))
    size = slim.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), 1)
    dealt = slim.repartition(tasks, "path", "_stretch").sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "length").mapInArrow(run, schema)


# ---------------------------------------------------------------- query


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    return read(write(C.table(spark, sf_dir, "pages")), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_A32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, list_transform(range(8), lambda i: CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)) AS five, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(five, lambda x: substr('{_A32}', ((x >> 15) & 31) + 1, 1) || substr('{_A32}', ((x >> 10) & 31) + 1, 1) || substr('{_A32}', ((x >> 5) & 31) + 1, 1) || substr('{_A32}', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM d
"""
