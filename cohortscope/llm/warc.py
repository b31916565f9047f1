"""WARC archives: written as files by Spark, read back sequentially.

Every record is a gzip member of its own.  Spark's text writer writes the files, so that
task retries and lost executors are its commit protocol's business and any file system it
knows will do; what it puts between rows is an empty gzip member, which readers of
concatenated members pass over (its files end in ``.txt``; their content is ``.warc.gz``).
Files end after ``FILE_BYTES``, so that each can be read as one value, however large pages
are.  The reader decompresses a member piece by piece, cuts the record at its content length,
verifies both digests and passes records on in batches of bounded bytes.

Defined cases: NULL html is an empty payload, a NULL url leaves the target out; a row whose
page_id equals the smallest of its payload, or is NULL, is a response, so repeated rows with
that id are responses all; an empty table gives an empty result; very long payloads pass
whole; other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import table
from cohortscope.session import staging_root

MIN_BYTES = 0               # payloads from this size on can be revisits
RECORDS_PER_FILE = 20_000
FILE_BYTES = 1 << 26        # compressed; a file ends with the record that reaches it
BATCH_BYTES = 1 << 24       # payloads that the reader passes on at once
PIECE = 1 << 16             # bytes handed to the decompressor at a time
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BETWEEN = gzip.compress(b"", mtime=0)
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r$")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes,
                 refers_to: int | None = None) -> bytes:
    """One compressed record: a response, or a revisit of the page ``refers_to``."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(
            r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
               ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def members(data: bytes | memoryview) -> Iterator[Iterable[bytes]]:
    """Gzip members of an archive, each as pieces of decompressed bytes."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, pieces = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("archive ends within a member")
            piece = view[at:at + PIECE]
            out = unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)
            if out:
                pieces.append(out)
        yield pieces


def parse_record(pieces: Iterable[bytes]) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of one record; None for an empty member."""
    data = b"".join(pieces)
    if not data:
        return None
    head, found, _ = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = len(head) + 4
    stop = start + int(fields["content-length"])
    if data[stop:] != b"\r\n\r\n":
        raise ValueError("record does not end at its content length")
    return fields, data[start:stop]


def read_archive(data: bytes) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, payload length, digest, payload) of every record.

    A digest that does not fit raises an error.  A revisit carries no payload; its HTTP
    header has the length of the one it refers to.
    """
    def page(value):
        number = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    for pieces in members(data):
        record = parse_record(pieces)
        if record is None:
            continue
        fields, block = record
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {fields['warc-record-id']} differs")
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(_LENGTH.search(head + b"\r").group(1))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response":
            if digest != base32_sha1(payload) or length != len(payload):
                raise ValueError(f"payload of {fields['warc-record-id']} differs")
        yield (page(fields["warc-record-id"]), fields.get("warc-target-uri"),
               fields["warc-type"], page(fields.get("warc-refers-to")), length, digest,
               payload if fields["warc-type"] == "response" else None)


def with_references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Payload, and for repeated payloads the smallest page that has it.

    The smallest page per digest is an aggregate that shrinks before its exchange, kept for
    repeated payloads only; the join back is one that Spark splits where a digest is common.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = (rows.filter(F.length("payload") >= min_bytes).groupBy("sha1")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    return rows.join(first, "sha1", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def _records(file_bytes: int):
    """Records, and the number of the file within the task that each goes to."""
    def run(batches):
        number, size = 0, 0
        for batch in batches:
            out, numbers = [], []
            for i, u, p, r in zip(*batch.columns):
                out.append(build_record(i.as_py(), u.as_py(), p.as_py(), r.as_py()))
                numbers.append(number)
                size += len(out[-1])
                if size >= file_bytes:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.binary()), pa.array(numbers, pa.int32())], ["record", "file"])
    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES,
                   per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write archive files of the pages (``page_id``, ``url``, ``html``) to ``folder``."""
    records = with_references(pages, min_bytes).mapInArrow(
        _records(file_bytes), "record binary, file int")
    (records.select(F.col("record").cast("string").alias("record"), "file")
     .write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1"))
     .option("maxRecordsPerFile", per_file).partitionBy("file").text(folder))


def _read(batches):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
             "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.binary()]

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for record in read_archive(content.as_buffer()):
                held.append(record)
                size += 200 + len(record[-1] or b"")
                if size >= BATCH_BYTES:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archive files in ``folder``; a file is one task's input at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        folder).select("content")
    return files.mapInArrow(_read, "page_id bigint, url string, record_type string, "
                                   "refers_to bigint, payload_bytes bigint, "
                                   "payload_digest string, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUPS = range(8)          # of five hexadecimal digits, that is four base32 digits
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_DIGITS}', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31), 1)"
    for g in _GROUPS for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}
