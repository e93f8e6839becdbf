"""WARC archives: records written with an index, then read back through it by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import Scratch, shuffle_partitions

INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM_BYTES = 100
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20


def _line(value) -> str:
    """A header's value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value or ""))


def _record(page_id, url, payload: bytes, digest: str, refers_to, target: str | None) -> bytes:
    """One gzip member with one record. A revisit has the HTTP headers only, as its payload is that of another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if target is not None else http + payload
    kind = "response" if target is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if target is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{target}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its header")
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds `digest` (SHA-256 of the payload) and `refers_to`: null for a response, else the page that it repeats.

    Among rows with equal payloads of REVISIT_FROM_BYTES or more, those with the smallest page_id are responses. Null
    html is an empty payload; rows with null page_id are always responses. The large column is dealt by page_id, so a
    payload that a third of the rows share does not meet in one task; the digests are summed before they are dealt.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    long_ones = keyed.where((F.octet_length("html") >= REVISIT_FROM_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = long_ones.join(firsts, "digest").where("page_id > first").select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), F.col("first").alias("refers_to")).distinct()
    return keyed.join(again, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("again_digest")), "left").drop("again", "again_digest")


def write_warc(pages: DataFrame, root: str) -> DataFrame:
    """Writes one .warc.gz file a task under `root` and gives the index of all records (lazily; store it once).

    `pages`: page_id, url, html, digest, refers_to. A task that is run again writes a new file, and the index only
    names files of tasks that ended.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for r in batch.to_pylist():
                revisit = r["refers_to"] is not None
                data = _record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], str(r["refers_to"]) if revisit else None)
                out.write(data)
                rows.append((r["page_id"], r["url"], "revisit" if revisit else "response", r["digest"], name, at, len(data)))
                at += len(data)
            if rows and at >= READ_BYTES * 128:
                out.close()
                name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=INDEX.replace(",", "").split()[::2])
        if out is not None:
            out.close()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, INDEX)


def read_warc(selected: DataFrame, root: str) -> DataFrame:
    """The selected index rows' records, read in place order with neighbouring ranges joined into one read.

    Ranges at most GAP_BYTES apart are read together, up to READ_BYTES at once; tasks get stretches of a file. Gives
    page_id, payload_bytes, payload_digest (computed anew for responses, as stored for revisits), record_type,
    refers_to and payload (null for revisits). A digest that differs from the header's raises an error.
    """
    spark = selected.sparkSession
    n = shuffle_partitions(spark)
    dealt = selected.select("file", F.floor(F.col("offset") / READ_BYTES).alias("stretch"), "offset", "length").repartition(n, "file", "stretch").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def number(urn: str):
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def emit(fs, path: str, run: list) -> Iterator[pa.RecordBatch]:
        rows = []
        with fs.open_input_file(f"{path}/{run[0][0]}") as f:
            data = memoryview(f.read_at(run[-1][1] + run[-1][2] - run[0][1], run[0][1]))
        for _, offset, length in run:
            fields, http, payload = parse_record(bytes(data[offset - run[0][1] :][:length]))
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is not that of its digest")
            rows.append((number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=schema.replace(",", "").split()[::2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        run: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if run and (row[0] != run[0][0] or row[1] - run[-1][1] - run[-1][2] > GAP_BYTES or row[1] + row[2] - run[0][1] > READ_BYTES):
                    yield from emit(fs, path, run)
                    run = []
                run.append(row)
        if run:
            yield from emit(fs, path, run)

    return dealt.mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, then reads every record back through the index."""
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = scratch.table(write_warc(with_revisits(pages), f"{scratch.root}/archives"), "index")
    return read_warc(index, f"{scratch.root}/archives").drop("payload")


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 AND page_id IS NOT NULL
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head < page_id THEN head END AS refers_to
FROM f
"""
