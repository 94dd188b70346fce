"""WARC archives with a Zstandard dictionary: written by Spark's own file writer, read back from its files.

An archive starts with a skippable frame that holds the dictionary; every record is a frame of its own, so one
record can be read without the others. Spark's text writer puts the frames into files and commits them, so any
file system will do and lost tasks are redone; its line separator is an empty skippable frame, which readers of
the format pass over. The dictionary is trained on at most ``SAMPLES`` records of at most ``SAMPLE_BYTES`` bytes,
those with the smallest digests (documented bound); with too few of them there is none.

Defined cases: a null payload is empty; equal payloads of at least ``revisit_from`` bytes are stored once, by the
row with the smallest id, rows that share that id all being responses (as are all rows with a null id where no row
has one); a null URL gives a record without a target; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import shared_dir

SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 400, 32_768, 65_536, 3

# Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def digests(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Rows with their payload, its length and SHA-1."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def plan_records(rows: DataFrame, revisit_from: int) -> DataFrame:
    """Adds ``first``: the smallest id with this payload, where several rows have it.

    Only ids and digests are grouped, and partial minima come first, so a digest with a third of all rows is no
    hot group; in the join back such a digest meets one row and the large side can be split.
    """
    firsts = rows.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.filter((F.col("copies") > 1) & (F.col("payload_bytes") >= revisit_from)).drop("copies")
    return rows.join(firsts, ["sha1", "payload_bytes"], "left")


def dictionary_of(rows: DataFrame) -> bytes:
    import zstandard

    small = rows.filter(F.col("payload_bytes").between(64, SAMPLE_BYTES)).select("sha1", "payload")
    # every task sends its share of the sample, not a sample of its own
    share = min(1.0, 2 * SAMPLES / max(1, small.count()))
    small = small.filter(F.conv(F.substring("sha1", 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    samples = [bytes(r.payload) for r in small.orderBy("sha1").limit(SAMPLES).collect()]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10 + 1024), samples).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform data for a dictionary
        return b""


def record_id(kind: str, page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which tells the length of the payload it stands for."""
    revisit = first is not None and page != first
    block = HTTP_OK.format(len(payload)).encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id("page", page, digest)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Refers-To", record_id("page", first, digest)), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(first))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP header and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


def write_archives(rows: DataFrame, path: str, dictionary: bytes, level: int = LEVEL) -> None:
    """Archives of the planned rows in ``path``, one for each partition."""

    def frames(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        lead = [DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary] if dictionary else []
        for batch in batches:
            out = lead
            for page, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out.append(pack.compress(record_bytes(page, url, payload, digest, first)))
            if len(out) > len(lead) or batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                lead = []

    packed = rows.select("page_id", "url", "payload", "sha1", "first").mapInArrow(frames, "frame binary")
    packed.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def frames_of(data: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive, one at a time."""
    import zstandard

    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and 0x50 <= magic[0] <= 0x5F:
            (size,) = struct.unpack("<I", view[at + 4 : at + 8])
            if magic == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            piece = view[at : at + 65_536]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``; a revisit has no payload of its own."""

    def records(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for record in frames_of(archive.as_py()):
                    fields, http, body = parse_record(record)
                    page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], digest, length, first and int(first), body))
                    held += len(body)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(records, RECORD)


def archive(
    pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0,
) -> DataFrame:
    """Write ``pages`` to archives in ``path`` (default: a new folder in the shared one) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = digests(pages, page_id, url, html)
    write_archives(plan_records(rows, revisit_from), path, dictionary_of(rows))
    return read_archives(spark, path)
