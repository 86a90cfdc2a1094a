"""WARC archives: an index first, then coalesced range reads.

Writing: each task writes one archive after the other (a gzip member for each record) straight into the shared folder and returns
an index row a record: file, offset, length, url, digest. The index is written as Parquet; a task that runs twice leaves files that no index row
names. Reading: the selected index rows are dealt and sorted by file and offset, neighbouring ranges become one read (gaps up to GAP bytes, at most SPAN bytes
a read), and each record is cut out, unpacked and checked against its digest.

A null payload counts as empty. Of equal payloads of at least min_revisit bytes the record with the largest page_id is the response and the others are
revisits of it; repeated rows with that page_id are all responses. A null page_id sorts first; a null url gives no target header. Empty tables give an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path

ROLL = 256 << 20
GAP = 64 << 10
SPAN = 8 << 20
#: Bytes of archives that a task reads.
SHARE = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC record; a revisit has the headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (None for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_ID)) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload_digest": digest, "payload_bytes": length, "payload": None if revisit else payload}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def decided(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html, sha, refers_to, revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    # payloads that occur once need no partner; written, so that a payload of any number of pages is split in the join
    repeated = own.groupBy("sha", "n").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    newest = materialise(repeated.select("sha", "n", "newest", F.lit(True).alias("again")), "warc-newest")
    both = own.join(newest, ["sha", "n"], "left")
    revisit = F.coalesce("again", F.lit(False)) & (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return both.select("page_id", "url", "html", "sha", F.when(revisit, F.col("newest")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, min_revisit: int = 0, roll: int = ROLL) -> DataFrame:
    """Write archives and index below folder; the index: file, offset, length, url, digest, page_id, record_type."""
    spark = pages.sparkSession
    names = ["file", "offset", "length", "url", "digest", "page_id", "record_type"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(f"{root}/archives", recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, sha, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                    digest = b32(sha)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, html.encode(), digest, refers_to, revisit)) + packer.flush()
                    if out is None or at + len(raw) > roll:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/archives/{name}", compression=None)
                    out.write(raw)
                    rows.append((name, at, len(raw), url, digest, page_id, "revisit" if revisit else "response"))
                    at += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    schema = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
    decided(pages, min_revisit).mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, offset long, length long, url string, digest string, page_id long, record_type string").parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[int]]]:
    """Of sorted (file, offset, length): file, start, length, and the places of the rows that each read covers."""
    held: list[int] = []
    start = end = 0
    for k, (file, offset, length) in enumerate(rows):
        if held and (file != rows[held[0]][0] or offset > end + gap or max(end, offset + length) - start > span):
            yield rows[held[0]][0], start, end - start, held
            held = []
        if not held:
            start = end = offset
        end = max(end, offset + length)
        held.append(k)
    if held:
        yield rows[held[0]][0], start, end - start, held


def read_warc(selected: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, span: int = SPAN, share: int = SHARE) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes(, payload) of the records that the index rows select."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"][: 7 if payloads else 6]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        source, name = None, None
        try:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                for file, start, length, places in ranges(rows, gap, span):
                    if file != name:
                        if source is not None:
                            source.close()
                        source, name = system.open_input_file(f"{root}/archives/{file}"), file
                    block = source.read_at(length, start)
                    found = [parse(zlib.decompress(block[rows[k][1] - start : rows[k][1] - start + rows[k][2]], 31)) for k in places]
                    yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names=names)
        finally:
            if source is not None:
                source.close()

    chosen = selected.select("file", "offset", "length")
    tasks = max(1, -(-(chosen.agg(F.sum("length")).first()[0] or 0) // share))
    dealt = chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    return dealt.mapInArrow(read, schema)


def roundtrip(pages: DataFrame, folder: str | None = None, min_revisit: int = 0) -> DataFrame:
    folder = folder or shared_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, min_revisit), folder, payloads=False)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERY = lambda spark, sf_dir: digest(roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet")))

#: Base32 takes the 160 bits of the digest five at a time: four symbols of each five hexadecimal digits.
SQL = """
WITH own AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
newest AS (SELECT h, max(page_id) AS newest FROM own GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM own JOIN newest USING (h)
"""
