"""WARC archives: index first, then coalesced byte-range reads.

``write_archives`` writes one gzip member per record to archives in the shared folder and
returns the index, a row per record with archive, offset, length, URL and digest.  Of rows
of one payload the one with the smallest page_id becomes a response record and the others
revisit records that refer to it.  Every writing task names its archives anew, and only
those that the committed index names count, so a task that is run twice leaves no trace.

``read_records`` takes any selection of index rows, sorts it by archive and offset, joins
neighbours (gaps of up to ``GAP`` bytes, up to ``RANGE`` bytes at once) to ranges, reads
each range with one request and takes the records apart.

Defined cases: null html is an empty payload, null url is left out of the record; a null
page_id is always a response; rows that tie for the smallest page_id are all responses; an
empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import materialise, open_store, shared_path

ARCHIVE = 256 << 20  # bytes after which a task begins another archive
RANGE = 8 << 20
GAP = 64 << 10
DATE = "2026-01-01T00:00:00Z"
MIN_REVISIT = 0  # payloads below this many bytes are all responses
_NAMES = uuid.UUID("6f4d1c52-0f0e-5a53-9b39-0a4c6d8f7e21")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, url string, digest string"


def _record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, 'null' if page is None else 'page ' + page)}>"


def _coded(page: str | None) -> str | None:
    """An id as a header value: percent-encoded, so that no id ends its line."""
    return None if page is None else quote(page, safe="")


def _decoded(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": url and quote(url, safe="%/:?#[]@!$&'()*+,;=~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to),
        "WARC-Profile": None if refers_to is None else _REVISIT,
        "Page-Id": _coded(page),
        "Refers-To-Page-Id": _coded(refers_to),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, http, payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload = (r["html"] or "").encode()
                    digest = sha1_base32(payload)
                    member = _gzip(record(r["page"], r["url"], payload, digest, r["refers_to"]))
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append({"archive": f"{folder}/{name}", "offset": at, "length": len(member), "url": r["url"], "digest": digest})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())]))
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the index, itself written."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    digest = F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("_sha")
    narrow = materialise(
        pages.select("page_id", digest, F.octet_length(F.coalesce("html", F.lit(""))).alias("_n")).filter(F.col("_n") >= min_revisit),
        "warc-digests")
    first = materialise(
        narrow.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).filter("_last > _first"),
        "warc-first").select("_sha", "_first")
    # narrow rows only; those of a hot payload are split by adaptive execution
    revisits = narrow.join(first, "_sha").filter("page_id > _first").select("page_id", "_sha", "_first").distinct()
    rows = (
        pages.select("page_id", "url", "html", digest).join(revisits, ["page_id", "_sha"], "left")
        .select(F.col("page_id").cast("string").alias("page"), "url", "html", F.col("_first").cast("string").alias("refers_to"))
    )
    return materialise(rows.mapInArrow(_write(folder), INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """Coalesced reads: archive, start, stop, records (offset, length)."""
    per = "PARTITION BY archive ORDER BY offset"
    gap = F.expr(f"offset - lag(offset + length) OVER ({per})")
    part = F.floor(F.col("offset") / RANGE)
    cut = (F.coalesce(gap, F.lit(GAP + 1)) > GAP) | (part != F.expr(f"lag(floor(offset / {RANGE})) OVER ({per})"))
    numbered = index.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn(
        "_range", F.expr(f"sum(_cut) OVER ({per} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return numbered.groupBy("archive", "_range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.collect_list(F.struct("offset", "length")).alias("records"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            store, path = open_store(r["archive"])
            with store.open_input_file(path) as f:
                data = f.read_at(r["stop"] - r["start"], r["start"])
            out = []
            for x in r["records"]:
                a = x["offset"] - r["start"]
                fields, http, payload = parse(zlib.decompress(data[a:a + x["length"]], 31))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and sha1_base32(payload) != digest:
                    raise ValueError(f"digest of {fields['WARC-Record-ID']} does not hold")
                size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.startswith(b"Content-Length:"))
                out.append({"page": _decoded(fields.get("Page-Id")), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
                            "record_type": fields["WARC-Type"], "refers": _decoded(fields.get("Refers-To-Page-Id")), "payload": None if revisit else payload})
            yield pa.RecordBatch.from_pylist(out, schema)


def read_records(index: DataFrame) -> DataFrame:
    """Records of the index rows: page, url, payload_bytes, payload_digest, record_type, refers, payload (null: revisit)."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges(index).repartition(n, "archive", "start").mapInArrow(
        _read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives."""
    kind = pages.schema["page_id"].dataType
    back = read_records(write_archives(pages))
    return back.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers").cast(kind).alias("refers_to"))
