"""WARC archives with a Zstandard dictionary, written and read back.

Each task writes archives of at most ARCHIVE_BYTES of payload into the shared folder. An archive starts with a skippable frame (magic
0x184D2A5D) that holds a dictionary trained on records of that archive; every record is a frame of its own, compressed with it, so that
any record can be read on its own. An archive is written under a temporary name and renamed; which archives count is known from the rows
that the writing tasks return, so what a lost or repeated task left behind is never read."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .shared import scratch, stored

LEAST = 1000  # bytes of payload from which equal payloads are stored once
MAGIC = 0x184D2A5D
SAMPLE_RECORDS = 400  # records an archive's dictionary is trained on, at most
SAMPLE_BYTES = 1 << 21
DICT_BYTES = 1 << 15
ARCHIVE_BYTES = 1 << 26
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def record(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record; a revisit has no block and names the record it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    return fields, rest[:n]


def pack(records: list[bytes]) -> Iterator[bytes]:
    """The frames of an archive: first the dictionary's, then one a record."""
    import zstandard as zstd

    step = max(1, len(records) // SAMPLE_RECORDS)
    sample, total = [], 0
    for r in records[::step]:
        if total > SAMPLE_BYTES:
            break
        sample.append(r[:65536])
        total += len(sample[-1])
    try:
        trained = zstd.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), sample, k=200, d=8).as_bytes()
    except zstd.ZstdError:  # too few or too uniform records: the sample itself is a raw dictionary
        trained = b"".join(sample)[:DICT_BYTES] or b"WARC/1.1\r\n"
    yield struct.pack("<II", MAGIC, len(trained)) + trained
    kind = zstd.ZstdCompressionDict(trained)
    c = zstd.ZstdCompressor(level=3, dict_data=kind, write_checksum=True, write_content_size=True)
    for r in records:
        yield c.compress(r)


def unpack(raw: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard as zstd

    magic, n = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw[8 : 8 + n]))
    at = 8 + n
    view = memoryview(raw)
    while at < len(raw):
        one = d.decompressobj()
        out = one.decompress(view[at:])
        rest = len(one.unused_data)
        if not one.eof:
            raise ValueError("a frame is cut short")
        at = len(raw) - rest
        yield out


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)

        def close(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with where.open_output_stream(f"{root}/{name}.tmp") as out:
                size = sum(out.write(x) for x in pack(records))
            where.move(f"{root}/{name}.tmp", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([size])], names=["archive", "records", "bytes"])

        records, total = [], 0
        for b in batches:
            for page_id, url, html, sha1, refers_to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                payload = (html or "").encode()
                records.append(record(page_id, url, payload, sha1, refers_to))
                total += len(payload) + 500
                if total >= ARCHIVE_BYTES:
                    yield close(records)
                    records, total = [], 0
        if records:
            yield close(records)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x == "<urn:page:null>" else int(x[10:-1])
    for b in batches:
        for raw in b.column(0):
            rows = []
            for one in unpack(raw.as_buffer().to_pybytes()):
                f, block = parse(one)
                kind, sha1, size = f["WARC-Type"], f["WARC-Payload-Digest"][5:], int(f["X-Payload-Length"])
                if kind == "response" and (digest(block) != sha1 or len(block) != size):
                    raise ValueError("a payload differs from its digest")
                rows.append((number(f["WARC-Record-ID"]), size, sha1, kind, number(f["WARC-Refers-To"]) if kind == "revisit" else None, f["WARC-Target-URI"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages to archives in folder; returns one row an archive: archive, records, bytes.

    Of records with equal payloads of at least LEAST bytes, the one with the largest page_id is the response and the others refer to it; a
    row without page_id is written as a response always. Null html is an empty payload, null url an empty URI. Rows that repeat a page_id:
    with equal payload, each is a response if that id is the group's largest. Other columns are not read."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"))
    big = p.where(f"octet_length(html) >= {LEAST} and page_id is not null").select("page_id", "sha1", F.sha2("html", 256).alias("key"))
    groups = big.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "refers_to")
    groups, _ = stored(groups, "warc-groups")
    again = big.join(groups, "key").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()
    again, _ = stored(again, "warc-again")
    right = again.select(F.col("page_id").alias("k"), F.col("sha1").alias("s"), "refers_to")
    right = F.broadcast(right) if again.count() <= 200_000 else right
    rows = p.join(right, F.expr("page_id = k and sha1 = s"), "left").select("page_id", "url", "html", "sha1", "refers_to")
    made, _ = stored(rows.mapInArrow(_write(folder), "archive string, records long, bytes long"), "warc-archives")
    return made


def read_warc(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of the archives that count."""
    files = spark.read.format("binaryFile").load(folder).select("content", F.element_at(F.split("path", "/"), -1).alias("archive"))
    few = F.broadcast(archives.select("archive")) if archives.count() <= 100_000 else archives.select("archive")
    found = files.join(few, "archive", "left_semi").select("content")
    return found.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    archives = write_warc(pages, folder)
    if archives.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return read_warc(spark, folder, archives)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.top IS NULL OR g.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g USING (html)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")
