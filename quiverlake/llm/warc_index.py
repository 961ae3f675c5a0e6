"""WARC archives with their index first.

Writing: each task writes one archive of records, each record a gzip member of its own,
under a fresh name in a folder that the cluster shares, and yields an index row for each
record: file, offset, length, URL, digest. Spark commits the index as Parquet. The index
is what counts: a file of a failed or repeated attempt is in no index row.

Reading: records are chosen from the index. Their byte ranges are sorted by file and
offset and coalesced where gaps are small, up to a bounded size, and each coalesced range
is fetched by one read. Ranges, not files, are dealt to tasks.

Equal payloads of at least `least` bytes are stored once: the row with the largest page
id is a response, the others are revisits that refer to it and keep the original's HTTP
header, whose Content-Length is the payload's size.

Defined results: a null payload is empty; a null URL is left out of the record, and line
breaks in one are escaped; of rows that share payload and id each is a record of the same
kind; a null id counts as smaller than any other; empty tables give no records; other
columns are ignored. A record is held whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, materialise, run_folder

INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, record_type string, refers_to bigint"
INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
MOST_GAP, MOST_RANGE = 64 << 10, 8 << 20
BROADCAST_HOLDERS = 300_000  # of about 60 bytes; beyond, payloads are joined by digest
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of the HTTP message in it, and the payload."""
    fields = lambda block: {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(pages: DataFrame, path: str, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 6) -> DataFrame:
    """Write a record for each row of pages below path and return the index, read from path/index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # Only digests that occur twice need a lookup. Ids and digests meet by digest; copies are counted within each task first.
    first = rows.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    kept = materialise(first, run_folder(spark, "warc_holders"))
    kept = F.broadcast(kept) if kept.limit(BROADCAST_HOLDERS + 1).count() <= BROADCAST_HOLDERS else kept
    holder = F.when(F.col("_held"), F.col("holder")).otherwise(F.col("page_id")).alias("holder")
    joined = rows.join(kept.withColumn("_held", F.lit(True)), "digest", "left").select("page_id", "url", "payload", "digest", holder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        files.create_dir(f"{folder}/archives", recursive=True)
        name, out, offset = f"archives/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            found = []
            for page_id, url, data, hexed, holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                digest, revisit = base32(hexed), len(data) >= least and page_id != holder
                codec = zlib.compressobj(level, wbits=31)
                packed = codec.compress(record(page_id, url, data, digest, holder, revisit)) + codec.flush()
                out.write(packed)
                found.append((name, offset, len(packed), page_id, url, digest, "revisit" if revisit else "response", holder if revisit else None))
                offset += len(packed)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), INDEX_ARROW, strict=True)], schema=INDEX_ARROW)
        if out is not None:
            out.close()

    joined.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def coalesced(offsets: np.ndarray, lengths: np.ndarray, most_gap: int = MOST_GAP, most_range: int = MOST_RANGE) -> list[tuple[int, int]]:
    """First and last-plus-one place of each run of sorted ranges to be fetched at once."""
    out, first = [], 0
    for i in range(1, len(offsets) + 1):
        end = int(offsets[i - 1] + lengths[i - 1])
        if i == len(offsets) or offsets[i] - end > most_gap or offsets[i] + lengths[i] - offsets[first] > most_range:
            out.append((first, i))
            first = i
    return out


def read_records(chosen: DataFrame, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for a revisit) of index rows, from the archives."""
    spark = chosen.sparkSession
    kind = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    number = lambda name: None if name == record_name(None) else int(name[len("<urn:page:") : -1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            offsets, lengths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                with files.open_input_file(f"{folder}/{names[a]}") as source:
                    for lo, hi in coalesced(offsets[a:b], lengths[a:b]):
                        begin = int(offsets[a + lo])
                        raw, found = source.read_at(int(offsets[a + hi - 1] + lengths[a + hi - 1]) - begin, begin), []
                        for o, n in zip((offsets[a + lo : a + hi] - begin).tolist(), lengths[a + lo : a + hi].tolist(), strict=True):
                            warc, http, payload = parse(zlib.decompress(raw[o : o + n], wbits=31))
                            revisit = warc["warc-type"] == "revisit"
                            digest = warc["warc-payload-digest"].removeprefix("sha1:")
                            if not revisit and base32(hashlib.sha1(payload).hexdigest()) != digest:
                                raise ValueError(f"{names[a]} at {o + begin}: the payload does not match its digest")
                            found.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], number(warc["warc-refers-to"]) if revisit else None, digest, int(http["content-length"]), None if revisit else payload))
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stretches of MOST_RANGE bytes of a file go together; which task gets them is left to the hash.
    dealt = chosen.select("file", "offset", "length").repartition(partitions, "file", F.expr(f"offset div {MOST_RANGE}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, kind)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read all records back."""
    path = run_folder(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 of the 40 hex digits of SHA-1: every 5 digits are 4 characters.
OP7_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest
  FROM hashed
), held AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM held
"""
