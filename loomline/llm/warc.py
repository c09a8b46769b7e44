"""WARC archives with revisit resolution.

Pages are written as archives of response records, one file per task. Their headers alone, with each
record's file and place, are then shuffled by payload digest: of equal payloads that are long enough
one record is the original, and the others become revisits that refer to it. Each archive is written
again in that light, with fresh headers and without the repeated payloads, which are never shuffled.
Records are gzip members of their own, so a reader gets any of them by its offset.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .batches import by_bytes, values

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADER = "page_id long, url string, path string, at long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def record_id(run: str, page_id: int | None, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{page_id}/{n}')}>"


def clean(value: str | None) -> str:
    """A header's value: one line."""
    return " ".join((value or "").split())


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def members(source, size: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream."""
    rest, at = b"", 0
    while True:
        data = rest or source.read(size)
        if not data:
            return
        d, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while True:
            out.write(d.decompress(data))
            used += len(data) - len(d.unused_data)
            if d.eof:
                rest = d.unused_data
                break
            data = source.read(size)
            if not data:
                raise EOFError("an archive ends inside a record")
        yield at, used, out.getvalue()
        at += used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class Archive:
    """An archive being written."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.warc.gz"
        fs, path = scratch.open_fs(self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink, self.at, self.n = fs.open_output_stream(path, compression=None), 0, 0

    def put(self, headers: dict[str, object], block: bytes) -> tuple[int, int]:
        data = member(record(headers, block))
        self.sink.write(data)
        self.at, self.n = self.at + len(data), self.n + 1
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.sink.close()


def write_responses(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a response record per row, payload its HTML in UTF-8 (null: empty). Returns (path, records)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = None
        for batch in by_bytes(batches, "html"):
            archive = archive or Archive(folder, f"raw-{TaskContext.get().partitionId():06d}")
            for page, url, html in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), values(batch.column("html")), strict=True):
                archive.put({
                    "WARC-Type": "response", "WARC-Record-ID": record_id(archive.path, page, archive.n), "WARC-Date": DATE, "WARC-Target-URI": clean(url),
                    "WARC-Payload-Digest": f"sha1:{hashlib.sha1(html).hexdigest()}", "X-Page-ID": page, "X-Payload-Length": len(html), "Content-Type": "application/http; msgtype=response",
                }, HTTP + html)
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [archive.path], "records": [archive.n]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return scratch.write_table(rows.mapInArrow(run, "path string, records long"), "warc-raw")


def read_headers(archives: DataFrame, check: bool = True) -> DataFrame:
    """A row of HEADER per record of the archives of ``path``; digests of responses are checked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = scratch.open_fs(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as source:
                    for at, length, data in members(source):
                        h, block = parse(data)
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and check and hashlib.sha1(payload(block)).hexdigest() != digest:
                            raise ValueError(f"the record at {at} of {path} doesn't have its digest")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), h.get("warc-target-uri"), path, at, length, number("x-payload-length"), digest, kind, number("x-refers-to-page"), h["warc-record-id"]))
                        if len(rows) == 5000:
                            yield _headers(rows)
                            rows = []
                if rows:
                    yield _headers(rows)

    # a given number of tasks, as the paths' few bytes say nothing of the archives' size
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInArrow(run, HEADER)


def _headers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in HEADER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def resolve(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Headers with the original's place in each: + is_original, o_page, o_url, o_record.

    Of records whose payloads are equal and have ``least_bytes`` or more the one of the largest page id is
    the original (null ids least; then by file and place). Shorter ones are all originals.
    """
    long = headers.where(F.col("payload_bytes") >= least_bytes)
    original = long.groupBy("payload_digest").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "path", "at", "url", "record_id")).alias("o")).where("copies > 1")
    # digests with more than one record in a thousand are few, so they go to every task; the others' groups are small
    n = headers.count()
    hot = F.col("copies") * 1000 > n
    often, seldom = F.broadcast(original.where(hot)), original.where(~hot)
    digests = often.select(F.col("payload_digest").alias("d"), F.lit(True).alias("often"))
    marked = headers.join(F.broadcast(digests), F.col("payload_digest") == F.col("d"), "left").drop("d")
    a = marked.where("often").drop("often").join(often, "payload_digest")
    b = marked.where("often is null").drop("often").join(seldom, "payload_digest", "left")
    both = a.unionByName(b)
    own = F.col("o").isNull() | (F.col("payload_bytes") < least_bytes) | ((F.col("o.path") == F.col("path")) & (F.col("o.at") == F.col("at")))
    return both.select(*headers.columns, own.alias("is_original"), F.col("o.page_id").alias("o_page"), F.col("o.url").alias("o_url"), F.col("o.record_id").alias("o_record"))


def deduplicate(headers: DataFrame, folder: str, least_bytes: int = 1000, piece: int = 32 << 20) -> DataFrame:
    """Write the archives of ``headers`` again with repeated payloads as revisits. Returns (path, records).

    A task writes a range of records, about ``piece`` bytes, whatever archives they come from.
    """
    decided = resolve(headers, least_bytes).select("path", "at", "length", "is_original", "o_page", "o_url", "o_record")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = archive = None
        for batch in batches:
            for new, at, length, is_original, o_page, o_url, o_record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    archive = Archive(folder, "dedup")
                if new != path:
                    if source:
                        source.close()
                    fs, name = scratch.open_fs(new)
                    path, source = new, fs.open_input_file(name)
                source.seek(at)
                h, block = parse(gzip.decompress(source.read(length)))
                fresh = {
                    "WARC-Type": "response" if is_original else "revisit", "WARC-Record-ID": h["warc-record-id"], "WARC-Date": h["warc-date"], "WARC-Target-URI": h["warc-target-uri"],
                    "WARC-Payload-Digest": h["warc-payload-digest"], "X-Page-ID": h.get("x-page-id"), "X-Payload-Length": h.get("x-payload-length"), "Content-Type": h["content-type"],
                }
                if not is_original:
                    fresh |= {"WARC-Profile": PROFILE, "WARC-Refers-To": o_record, "WARC-Refers-To-Target-URI": o_url, "WARC-Refers-To-Date": h["warc-date"], "X-Refers-To-Page": o_page}
                    block = block[: len(block) - len(payload(block))]
                archive.put(fresh, block)
        if source:
            source.close()
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [archive.path], "records": [archive.n]})

    total, files = headers.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("path")).first()
    return scratch.write_table(decided.repartitionByRange(max(1, files, -(-total // piece)), "path", "at").sortWithinPartitions("path", "at").mapInArrow(run, "path string, records long"), "warc-dedup")


def archive(pages: DataFrame, folder: str, least_bytes: int = 1000, **columns) -> DataFrame:
    """Write pages as deduplicated archives under ``folder`` and return the headers read back from them.

    Null HTML is an empty payload, a null URL an empty one. Rows that repeat an id are records of their
    own. Other columns aren't written. An empty table writes nothing and gives an empty result.
    """
    raw = write_responses(pages, f"{folder}/raw", **columns)
    headers = scratch.write_table(read_headers(raw), "warc-headers")
    return read_headers(deduplicate(headers, f"{folder}/dedup", least_bytes))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.new_path(spark, "warc"))
    return headers.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM q
"""

QUERIES = {"op8_warc": op8_warc}
ORACLE = {"op8_warc": SQL}
