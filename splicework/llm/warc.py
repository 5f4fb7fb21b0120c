"""WARC archives compressed record by record with a Zstandard dictionary that each file carries."""

from __future__ import annotations

import base64
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
import uuid
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lookup, scratch, table
from .registry import corpus_query

# Fixed values of the formats: the skippable frame that holds a dictionary, a frame's first bytes,
# the profile of a revisit.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that one archive holds before the next begins; a task holds one archive's records
#: to build the dictionary from them. A longer payload has an archive of its own.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Fewest records to build a dictionary from; archives of fewer carry none.
DICTIONARY_RECORDS = 16


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> adds payload (UTF-8, null: empty), payload_bytes and sha1 (hex)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.withColumn("payload", payload).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of the records of at least ``least`` bytes that share a payload,
    the one of the largest page_id is the response and the others revisit it.

    Rows that repeat the largest page_id are responses too, as is every row of a payload without
    any page_id. The text is not shuffled for it: each (payload, page) pair is counted from the
    scan, and pages look up their payload's largest page dealt over pieces.
    """
    keyed = digests(pages)
    keys = keyed.select("page_id", "payload_bytes", "sha1")
    largest = keys.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    revisits = (
        lookup(keys.distinct(), largest, ["sha1", "payload_bytes"], ["page_id"])
        .where((F.col("payload_bytes") >= least) & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "sha1", "refers_to")
    )
    found = revisits.select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), "refers_to")
    joined = keyed.join(found, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha1") == F.col("__sha1")), "left").drop("__page", "__sha1")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def page_urn(page_id: int | None) -> str | None:
    return None if page_id is None else f"<urn:page:{page_id}>"


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else row["payload"]
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {page_urn(row['page_id']) or f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {row['payload_bytes']}", f"WARC-Target-URI: {one_line(row['url'])}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {page_urn(row['refers_to'])}", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def one_line(url: str | None) -> str:
    """A header value: blanks at line ends and breaks would end the header."""
    return " ".join((url or "").split())


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then each record as a frame of its own."""
    out, dictionary = io.BytesIO(), None
    if len(records) >= DICTIONARY_RECORDS:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
        except zstandard.ZstdError:  # too little text to build one from
            dictionary = None
    if dictionary:
        raw = dictionary.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    for record in records:
        out.write(compressor.compress(record))
    return out.getvalue()


def unpack(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a seekable stream of its bytes."""
    dictionary, head = None, stream.read(8)
    if len(head) == 8 and head[:4] == struct.pack("<I", SKIPPABLE):
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    data = head
    while True:
        data = data or stream.read(1 << 16)
        if not data:
            return
        unpacker, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not unpacker.eof:
            if not data and not (data := stream.read(1 << 16)):
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")), "payload": rest[: int(fields["Content-Length"])],
    }


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes what ``with_revisits`` returns (with url) as archives below ``folder`` and returns their
    paths, one per row, with the number of records in each.

    ``folder`` is any place that all executors reach. Each attempt of a task writes files under
    names of its own and only those of the attempt that succeeded are listed, so a lost executor
    costs nothing but unlisted files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            store, at = fs.FileSystem.from_uri(folder)
            store.create_dir(at, recursive=True)
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(pack(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if held and size + row["payload_bytes"] > ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append(record_bytes(row))
                size += len(held[-1])
        if held:
            yield flush()

    asked = records.select("page_id", "url", "payload", "payload_bytes", "sha1", "record_type", "refers_to")
    return checkpoint(asked.mapInArrow(work, "path string, records long"))


def read_archives(paths: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Reads archives listed as (path) back: one row per record, streamed record by record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as stream:
                    held, size = [], 0
                    for record in unpack(stream):
                        held.append(parse_record(record))
                        size += len(record)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, RECORD)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, RECORD)

    return paths.select("path").mapInArrow(work, RECORD_SQL)


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Pages (page_id, url, html) -> the paths of their archives.

    A null html is an empty payload, a null url an empty address; rows without page_id get a
    random record id and come back without one. Repeated rows are a record each. Other columns
    are not archived. An empty table makes no archive.
    """
    return write_archives(with_revisits(pages.select("page_id", "url", "html"), least).drop("html"), folder)


def _base32(sha1: str) -> str:
    """SQL for 40 hex digits as 32 base-32 digits: each five digits are four."""
    value = "CAST('0x' || substr({0}, {1}, 5) AS INTEGER)"
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({0} >> {1}) & 31) + 1, 1)"
    return " || ".join(digit.format(value.format(sha1, 1 + 5 * i), shift) for i in range(8) for shift in (15, 10, 5, 0))


WARC_SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM hashed)
SELECT page_id, payload_bytes, {_base32('h')} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to FROM firsts
"""


@corpus_query("op6_warc", sql=WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = archive(table(spark, sf_dir, "pages"), scratch(spark, "archives"))
    return read_archives(paths).drop("url", "payload")
