"""WARC archives compressed with Zstandard and a dictionary.

A file starts with a skippable frame that holds the dictionary (itself compressed); each
record is one frame after it. Files are written by Spark's own text writer, whose record
separator is an empty skippable frame, so that commits, retries and any Hadoop file
system work as for other tables. The reader loads the dictionary from the leading frame,
finds each frame's end from its block headers, decodes one frame per record and checks
version, mandatory headers, lengths and digests.

Of records with equal payloads of at least `MIN_REVISIT` bytes, the one with the smallest
page id is a response and the others are revisits of it; smaller payloads are always
responses. Of equal ids with equal payloads none is told apart. Defined cases: a null payload is empty; a null id sorts after all others and is
read back as null; a null url has no target header; rows that repeat an id and its payload
are records of the same kind; an empty table makes archives without records. What does not
validate is returned with `error` set and no payload, and reading goes on behind it where
the frame's end is known. Other columns of the pages, whatever their names, are not written. A
page of any length is written whole and held whole by a task, and so is an archive, which
aims at FILE_BYTES of payload and exceeds it by a page at most.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import chunks, map_batches, read, shared_path

MIN_REVISIT = 100
#: Raw payload bytes that a file aims at, and the bounds of what the dictionary is trained on.
FILE_BYTES, DICT_BYTES, DICT_SAMPLES, SAMPLE_CHARS = 32 << 20, 16 << 10, 200, 2_000
LEVEL = 3
#: Fixed values of the formats: the dictionary's and another skippable frame's magic number, the frame magic, the revisit profile.
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary, error string"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where there are too few to train on, their text itself; empty without any."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES] if sum(map(len, samples)) >= 8 else b""


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


def loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record: the headers, and an HTTP response whose body a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame at `at` ends, from its header and block headers (RFC 8878)."""
    flags = buf[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size = flags >> 6
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single if size == 0 else (0, 2, 4, 8)[size])
    while True:
        if pos + 3 > len(buf):
            raise ValueError("truncated frame")
        head = buf[pos] | buf[pos + 1] << 8 | buf[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    if (pos := pos + 4 * checksum) > len(buf):
        raise ValueError("truncated frame")
    return pos


def frames(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(decoded record, error) for each frame of an archive."""
    buf, at, decoder, leading = memoryview(content), 0, zstandard.ZstdDecompressor(), True
    while at < len(buf):
        if at + 8 > len(buf):
            yield None, "truncated frame"
            return
        magic, size = struct.unpack_from("<II", buf, at)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if at + 8 + size > len(buf):
                yield None, "truncated skippable frame"
                return
            if leading and magic == DICT_MAGIC:
                body = bytes(buf[at + 8 : at + 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=loaded(body))
            at, leading = at + 8 + size, False
            continue
        leading = False
        if magic != FRAME_MAGIC:
            yield None, "bad frame magic"
            return
        try:
            end = frame_end(buf, at)
        except (ValueError, IndexError):
            yield None, "truncated frame"
            return
        try:
            yield decoder.decompress(buf[at:end]), None
        except zstandard.ZstdError as e:
            yield None, f"frame: {e}"
        at = end


def parsed(raw: bytes) -> dict:
    """The fields of a record; ValueError where it is not valid."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no version line")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header")
        headers[key.strip().lower()] = value.strip()
    if missing := [k for k in MANDATORY if k not in headers]:
        raise ValueError(f"no {missing[0]}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("bad length")
    http, mark, body = rest[:-4].partition(b"\r\n\r\n")
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or not told or not told[0].isdigit():
        raise ValueError("bad block")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = headers["warc-type"]
    number = lambda k: None if (x := headers[k].removeprefix("<urn:page:").removesuffix(">")) == "none" else int(x)
    out = {"page_id": number("warc-record-id"), "payload_bytes": int(told[0]), "payload_digest": digest, "record_type": kind, "refers_to": None, "url": headers.get("warc-target-uri"), "payload": None, "error": None}
    if kind == "revisit":
        if headers.get("warc-profile") != PROFILE or "warc-refers-to" not in headers or body:
            raise ValueError("bad revisit")
        return out | {"refers_to": number("warc-refers-to")}
    if kind != "response":
        raise ValueError("bad type")
    if len(body) != int(told[0]) or hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("bad payload")
    return out | {"payload": body}


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of pages (page_id, url, html) to archives below path."""
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("n_bytes", F.length("payload").cast("long"))
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63))))
    light = rows.select("page_id", "key", "digest", "n_bytes")
    firsts = light.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    kinds = light.select("page_id", "key", "digest").distinct().join(firsts, "digest", "left")
    kinds = kinds.select("key", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    order = F.xxhash64("page_id")
    last = [r[0] for r in rows.select(order.alias("h")).orderBy("h").limit(DICT_SAMPLES).collect()][-1:]
    samples = rows.where(order <= F.lit(last[0])).select(F.substring("payload", 1, SAMPLE_CHARS)).limit(DICT_SAMPLES).collect() if last else []
    dictionary = trained_dictionary(sorted(bytes(r[0]) for r in samples))
    # one shuffle of payloads, by a key that no group of copies shares; the join keeps to it
    dealt = rows.repartition(files, "key", "digest").join(kinds, ["key", "digest"])
    records = dealt.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.lower(F.hex("digest")).alias("digest"), "n_bytes", "refers_to")

    def encode(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded(dictionary), write_checksum=True, write_content_size=True)
        if dictionary:
            yield pa.RecordBatch.from_arrays([pa.array([leading_frame(dictionary)], pa.binary())], names=["value"])
        for batch in chunks(batches, "payload"):
            rows = [packer.compress(record(*(r[k] for k in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to")), r["refers_to"] is not None)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    map_batches(records, encode, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below path; `error` tells what does not validate."""

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for raw, error in frames(content.as_py()):
                    try:
                        if error:
                            raise ValueError(error)
                        row = parsed(raw)
                    except ValueError as e:
                        row = dict.fromkeys(x.split()[0] for x in RECORD_SCHEMA.split(", ")) | {"error": str(e)}
                    held += len(row["payload"] or b"")
                    rows.append(row if payloads else row | {"payload": None})
                    if held > FILE_BYTES // 8 or len(rows) >= 2_000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), decode, RECORD_SCHEMA)


ARROW_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f ON p.h = f.h
"""
