"""WARC archives of pages, compressed with a Zstandard dictionary of their own.

An archive is one file: a skippable frame (magic number 0x184D2A5D) with the dictionary, then one Zstandard frame per
record, so that any record can be read alone. The dictionary is built from records spread over that archive.

Executors have no other way to the shared store than Spark's writers. An archive is one row of bytes, written by the text
source with one row per file; what that source writes behind each row is chosen to be an empty skippable frame, which
every Zstandard reader passes over. So archives are committed like any table and survive lost executors. Spark names the
files part-….txt.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm.common import freed_shuffles, ship, stored
from tidyledger.sources.scratch import new_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20  # of records before compression; a longer record is an archive of its own
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  # of records that a dictionary is built from
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
COPIES = 1000  # revisits of a repeated row that one generated row stands for

RECORDS = ("archive string, record_type string, record_id string, page_id long, url string, payload_bytes long, "
           "payload_digest string, refers_to_record string, refers_to long, payload binary")


# --- which pages are written whole ---------------------------------------------


def with_digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))


def _decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, sha1, n, first_id, first_url, is_first): rows of payloads that occur more than once, n equal rows each.

    Of equal payloads the row with the largest page_id comes first (then the largest url; null is smaller than anything).
    """
    rows = with_digests(pages).filter(F.col("payload_bytes") >= min_bytes)
    copies = stored(rows.groupBy("sha1", "page_id", "url").agg(F.count("*").alias("n")), "payload-copies")
    best = copies.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("best"), F.sum("n").alias("all")).filter("all > 1")
    return copies.join(best, "sha1").select(
        "page_id", "url", "sha1", "n", F.col("best.page_id").alias("first_id"), F.col("best.url").alias("first_url"),
        (F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))).alias("is_first"))


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One row per record: page_id, url, html (null for revisits), sha1, payload_bytes, first_id, first_url, is_response, copy.

    The html is shuffled once, by page and payload, so a payload with a third of all pages is spread evenly.
    """
    decided = stored(_decided(pages, min_bytes), "payload-decisions")
    d = decided.select(*(F.col(c).alias(f"d_{c}") for c in decided.columns))
    p = with_digests(pages)
    joined = p.join(d, (p.sha1 == d.d_sha1) & p.page_id.eqNullSafe(d.d_page_id) & p.url.eqNullSafe(d.d_url), "left")
    is_response = F.coalesce("d_is_first", F.lit(True))
    shape = ["page_id", "url", F.when(is_response, F.col("html")).alias("html"), "sha1", "payload_bytes",
             F.col("d_first_id").alias("first_id"), F.col("d_first_url").alias("first_url"), is_response.alias("is_response"),
             F.lit(0).cast("long").alias("copy")]
    tied = decided.filter("is_first and n > 1")
    if tied.isEmpty():
        return joined.select(*shape)
    # Equal rows that come first in their group cannot be told apart: one is written whole, the others are its revisits.
    again = F.coalesce(F.col("d_is_first") & (F.col("d_n") > 1), F.lit(False))
    whole = joined.filter(again).dropDuplicates(["sha1"]).select(*shape)
    blocks = tied.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 2) div {COPIES}"))))
    first = F.col("part") * COPIES + 1
    rest = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES - 1, F.col("n") - 1))))
    lengths = whole.select(F.col("sha1").alias("w_sha1"), "payload_bytes")
    rest = rest.join(lengths, F.col("sha1") == F.col("w_sha1")).select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "payload_bytes", "first_id", "first_url",
        F.lit(False).alias("is_response"), F.col("copy").cast("long"))
    return joined.filter(~again).select(*shape).unionByName(whole).unionByName(rest)


# --- records as bytes -------------------------------------------------------------


def _uri(url: str | None, page_id: int | None) -> str:
    """The url with blanks and control characters percent-encoded; a page without one is named by its id."""
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub("[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url)


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {copy} {url}')}>"


def record(page_id, url, html, digest, payload_bytes, first_id, first_url, is_response, copy, date: str = DATE) -> bytes:
    """One WARC/1.1 record. Ids and the length of a revisited payload are extension fields."""
    fields = [("WARC-Type", "response" if is_response else "revisit"), ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("X-Payload-Length", payload_bytes)]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    if is_response:
        block += html.encode("utf-8", "surrogatepass")
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, first_url, digest, 0)),
                   ("WARC-Refers-To-Target-URI", _uri(first_url, first_id)), ("WARC-Refers-To-Date", date)]
        if first_id is not None:
            fields.append(("X-Refers-To-Page-Id", first_id))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields)
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload (what follows the HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"No WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("A record does not end where its length says")
    return fields, block.partition(b"\r\n\r\n")[2]


# --- archives as bytes --------------------------------------------------------------


def built_dictionary(parts: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """Dictionary from records spread evenly over the archive, ``sample`` bytes of them; None where there is too little to learn."""
    step = max(1, -(-sum(map(len, parts)) // sample))
    chosen = parts[::step]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, chosen)) // 8), chosen)
    except zstandard.ZstdError:
        return None


def archive(parts: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """Records to one archive."""
    learned = built_dictionary(parts, dictionary_bytes)
    out = []
    if learned is not None:
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(learned)) + learned.as_bytes())
        learned.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True).compress
    return b"".join(out + [compress(part) for part in parts])


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic number, frame) of a file; the content of skippable frames, other frames as they are."""
    at = 0
    while at < len(data):
        magic, = struct.unpack_from("<I", data, at)
        start = at
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            start, end = at + 8, at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            end = at + zstandard.frame_header_size(data[at:at + 18])
            last = False
            while not last:
                block = int.from_bytes(data[end:end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 if data[at + 4] & 4 else 0  # checksum
        if end > len(data):
            raise ValueError("An archive ends inside a frame")
        yield magic, data[start:end]
        at = end


def unpacked(data: bytes) -> Iterator[bytes]:
    """Records of an archive."""
    open_frame = zstandard.ZstdDecompressor()
    for magic, frame in frames(memoryview(data)):
        if magic == DICTIONARY_FRAME:
            open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
        elif magic & SKIPPABLE_MASK != SKIPPABLE:
            yield open_frame.decompress(frame)


# --- on Spark ------------------------------------------------------------------------


def _archives(archive_bytes: int, dictionary_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed():
            return pa.RecordBatch.from_pydict({"file": pa.array([archive(held, dictionary_bytes)], pa.binary())})

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                part = record(*row)
                if held and size + len(part) > archive_bytes:
                    yield packed()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield packed()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   dictionary_bytes: int = DICTIONARY_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in the new folder ``path``.

    Null html is the empty payload; a null url is named urn:page:<id>; blanks and control characters of a url are
    percent-encoded. Payloads of ``min_bytes`` and more are written once, with the largest page_id (null is smallest); other
    rows with that payload are revisits, also when they repeat the row itself. Equal small rows are records with one record id.
    An empty table gives no records. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    files = records(pages, min_bytes).mapInArrow(_archives(archive_bytes, dictionary_bytes), "file binary")
    with freed_shuffles(spark):
        (files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
         .option("lineSep", EMPTY_FRAME).text(path))


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
                        ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, size = [], 0
            for data in unpacked(content.as_buffer()):
                fields, payload = parsed(data)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = fields["WARC-Type"] == "response"
                if response and (len(payload) != int(fields["X-Payload-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: {fields['WARC-Record-ID']} does not hold the payload of its digest")
                page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                rows.append((path.as_py(), fields["WARC-Type"], fields["WARC-Record-ID"], page and int(page), fields["WARC-Target-URI"],
                             int(fields["X-Payload-Length"]), digest, fields.get("WARC-Refers-To"), first and int(first),
                             payload if payloads and response else None))
                size += len(payload) if payloads else 500
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives in a folder, every payload checked against its digest: see RECORDS for the columns.

    With ``payloads`` responses carry theirs, else the column is null and payloads stay in the tasks.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to; see :func:`write_archives` for odd rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM d
"""
