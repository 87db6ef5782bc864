"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are gzip files with a member for each record, so they can be read from
the middle: a task scans its byte range for gzip magic, checks each candidate by
decoding its header, and owns the records that start inside its range.

The writer hands finished members to Spark's text writer, which stores bytes
unchanged and brings its commit protocol and any file system that Spark knows;
the "line separator" is an empty gzip member, which decoders skip.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_bytes

#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 100
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
#: Fixed value: a gzip member that decodes to nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; refers_to is null for responses.

    Digests with more than one page are few beside the pages; they are written
    out, so that the join back has plain shuffles on both sides, which Spark
    splits where one digest holds many pages.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = materialize(same.where("n > 1 and first_id is not null").select("digest", "first_id"), "digests")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record as one gzip member.  The HTTP header of a revisit still tells the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@F.pandas_udf(T.BinaryType())
def _members(page_id: pd.Series, url: pd.Series, payload: pd.Series, digest: pd.Series, refers_to: pd.Series) -> pd.Series:
    number = lambda x: None if pd.isna(x) else int(x)
    return pd.Series([record(number(p), u, bytes(b), d, number(r)) for p, u, b, d, r in zip(page_id, url, payload, digest, refers_to, strict=True)])


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a record per page.  Null html: an empty payload.  Rows that share the smallest page_id of a payload are all responses."""
    # ids travel as text: a nullable long would become a float in pandas
    rows = plan_records(pages, min_bytes).select(
        _members(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string")).alias("member")
    )
    rows.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def _decode(f, at: int, chunk: int = 1 << 16):
    """(bytes, end) of the gzip member at ``at``, or None if there is none that starts like a WARC record."""
    unpack, out, f_at = zlib.decompressobj(31), [], at
    checked = False
    while not unpack.eof:
        f.seek(f_at)
        data = f.read(chunk)
        if not data:
            return None
        f_at += len(data)
        try:
            out.append(unpack.decompress(data))
        except zlib.error:
            return None
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
        chunk = min(chunk * 2, 1 << 20)
    return (b"".join(out), f_at - len(unpack.unused_data)) if checked else None


def records_in(f, size: int, start: int, end: int):
    """Records whose gzip member starts in [start, end), in order; a record may reach beyond ``end``."""
    at = start
    step = 1 << 20
    while at < end:
        f.seek(at)
        data = f.read(min(step, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        got = _decode(f, at + found)
        if got is None:
            at += found + 1
        else:
            yield at + found, got[0]
            at = got[1]


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
    kind = fields["WARC-Type"]
    number = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?[0-9]+)", fields.get(k, ""))) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


OUTPUT = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, record_offset long"


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records under ``path``, read by byte ranges of ``range_bytes``; revisits have no payload.

    An empty folder gives no rows.  A candidate that does not decode to a WARC
    header is passed over; a response whose payload does not match its digest
    fails the task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start")
    ranges = files.select("path", "length", starts).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    fields = [x.split() for x in OUTPUT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])

        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with _open(file) as f:
                    for at, data in records_in(f, size, start, min(size, start + range_bytes)):
                        rows.append(parse(data) | {"file": file, "record_offset": at})
                        held += len(data)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    return ranges.mapInArrow(run, OUTPUT)
