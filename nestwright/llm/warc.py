"""WARC archives: writing captures with payload revisits, reading records back, assembling transactions.

A capture is written as three WARC/1.1 records: a ``response`` (or a ``revisit`` of an earlier equal payload), its
``request`` and a ``metadata`` record; the latter two name the first in WARC-Concurrent-To. Files are gzip-compressed
and hold a bounded number of captures and, on average, of bytes. They are unpacked piece by piece and cut by
Content-Length, so payloads may hold anything. *Assembly* joins records through their concurrent-to identifiers, in either direction and over a record in
between, and emits one nested row per capture.

Null payloads count as empty, null urls are written without a target. Repeated rows become captures of their own; rows
of one id and equal payloads are responses alike. A payload may have up to 2 GB, as a row of Spark may. Other columns
are not looked at, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.llm.work import Workspace

#: Captures that a file holds at most, and bytes that it has on average at most.
PER_FILE, FILE_BYTES = 500, 64 << 20
_RECORD = "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to string, payload_digest string, payload_bytes long, capture_key string, payload binary"


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, work: Workspace, least: int = 100) -> DataFrame:
    """``pages`` with ``_digest``, ``_bytes`` and ``_original``: the smallest id of those with an equal payload of ``least`` bytes or more.

    Digests that occur once are not joined to anything; the rows of a very common payload meet one row that was
    aggregated before, in a join that Spark can split.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumns({"_digest": F.sha2(payload, 256), "_bytes": F.octet_length(payload).cast("long")})
    firsts = rows.where(f"_bytes >= {least}").groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_digest").alias("_same"), "_first")
    firsts = work.table(firsts, "originals")
    joined = rows.join(firsts, rows._digest == firsts._same, "left").drop("_same")
    return joined.withColumn("_original", F.when(F.col(f"`{id_col}`") != F.col("_first"), F.col("_first"))).drop("_first")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, record_id: Column, date: str, headers: list[tuple[str, Column]], body: Column) -> Column:
    """The record's text but for its closing blank lines. Null headers are left out."""
    end = F.lit("\r\n")
    lines = [F.concat(F.lit(f"{name}: "), value, end) for name, value in headers]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, end, F.lit("WARC-Record-ID: "), record_id, end, F.lit(f"WARC-Date: {date}\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", work: Workspace | None = None) -> None:
    """Write each row as a response or revisit, a request and a metadata record below ``path``."""
    pages = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").alias("payload"))
    rows = mark_revisits(pages, "id", "payload", work or Workspace(pages.sparkSession, "warc"))
    size = rows.agg(F.avg("_bytes")).head()[0] or 0.0
    ident = F.col("id").cast("string")
    own = [F.coalesce(ident, F.lit("null")), F.monotonically_increasing_id().cast("string")]  # one task writes all of a row's records
    rows = rows.withColumns({"_rid": _urn(F.lit("response"), *own), "_qid": _urn(F.lit("request"), *own), "_mid": _urn(F.lit("metadata"), *own)})
    one_line = F.translate(F.col("url").cast("string"), "\r\n", "  ")
    target = ("WARC-Target-URI", one_line)
    again = F.col("_original").isNotNull()
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.when(again, status).otherwise(F.concat(status, F.coalesce(F.col("payload").cast("string"), F.lit(""))))
    main = _record(F.when(again, "revisit").otherwise("response"), F.col("_rid"), date, [target, ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))), ("X-Payload-Length", F.col("_bytes").cast("string")), ("X-Capture-Key", ident), ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("X-Refers-To-Key", F.col("_original").cast("string"))], body)
    request = _record("request", F.col("_qid"), date, [target, ("Content-Type", F.lit("application/http;msgtype=request")), ("WARC-Concurrent-To", F.col("_rid"))], F.concat(F.lit("GET "), F.coalesce(one_line, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", F.col("_mid"), date, [target, ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", F.col("_qid"))], F.concat(F.lit("payload-length: "), F.col("_bytes").cast("string"), F.lit("\r\n")))
    end = "\r\n\r\n"
    out = rows.select(F.concat_ws(end, main, request, metadata).alias("value"))
    out.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", max(1, min(PER_FILE, int(FILE_BYTES / (size + 1000))))).text(path)


def unpacked(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes piece by piece, out of any number of gzip members or as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    inflate, at = zlib.decompressobj(31), 0
    while at < len(content):
        piece = content[at : at + size]
        yield inflate.decompress(piece)
        at += len(piece) - len(inflate.unused_data)
        if inflate.eof:
            inflate = zlib.decompressobj(31)


def cut_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, body) of each record of an archive; a header's values in order, names lower-cased. One record is held."""
    held, pieces = bytearray(), iter(pieces)
    while True:
        while (start := held.find(b"WARC/")) < 0 or (stop := held.find(b"\r\n\r\n", start)) < 0:
            if (piece := next(pieces, None)) is None:
                return
            held += piece
        headers: dict[str, list[str]] = {}
        for line in bytes(held[start:stop]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode(), []).append(value.strip().decode("utf-8", "replace"))
        end = stop + 4 + int(headers["content-length"][0])
        while len(held) < end:
            if (piece := next(pieces, None)) is None:
                raise ValueError("an archive ends inside a record")
            held += piece
        yield headers, bytes(held[stop + 4 : end])
        del held[:end]


def _read(with_payload: bool):
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for headers, body in cut_records(unpacked(content.as_py())):
                    get = lambda name, h=headers: h.get(name, [None])[0]
                    kind, payload = get("warc-type"), body
                    if "http" in (get("content-type") or ""):
                        payload = body.partition(b"\r\n\r\n")[2]
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    if kind == "revisit":  # the payload stands elsewhere; its digest and size are in the headers
                        digest, size = (get("warc-payload-digest") or "").removeprefix("sha256:"), int(get("x-payload-length") or 0)
                    out.append((get("warc-record-id"), kind, headers.get("warc-concurrent-to", []), get("warc-target-uri"), get("x-refers-to-key"), digest, size, get("x-capture-key"), payload if with_payload else None))
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (a response or revisit), ``requests`` and ``metadata``.

    Records point at others of their transaction by ``concurrent_to``. A pointer at a response names the capture; one
    at a request or metadata record is followed once more. Where only the response points, the records it names belong
    to it. Records that reach no response are captures of their own with a null response.
    """
    fields = [c for c in records.columns if c != "concurrent_to"]
    is_main = F.col("record_type").isin("response", "revisit")
    links = records.select("record_id", F.explode("concurrent_to").alias("to"), is_main.alias("main"))
    # capture of each side record, by its own pointer or by the response's
    side = links.where("not main").select(F.col("record_id").alias("child"), F.col("to").alias("parent"))
    named = links.where("main").select(F.col("to").alias("child"), F.col("record_id").alias("parent"))
    up = side.unionByName(named).groupBy("child").agg(F.min("parent").alias("parent"))
    twice = up.alias("a").join(up.alias("b"), F.col("a.parent") == F.col("b.child"), "left")
    capture = twice.select(F.col("a.child").alias("_child"), F.coalesce("b.parent", "a.parent").alias("_capture"))
    rows = records.join(capture, ~is_main & (records.record_id == F.col("_child")), "left")
    row = F.struct(*fields)
    return rows.groupBy(F.when(is_main, F.col("record_id")).otherwise(F.coalesce("_capture", "record_id")).alias("capture_id")).agg(
        F.first(F.when(is_main, row), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("record_type") == "request", row)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", row)).alias("metadata"),
    )


def capture_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Round trip: write the captures, read them back, assemble, and report each page's payload."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    write_captures(pages, f"{work.path}/archive", id_col, url_col, payload_col, work=work)
    work.release()
    captures = assemble(read_records(spark, f"{work.path}/archive", with_payload=False).drop("payload"))
    kind = pages.schema[id_col].dataType
    r = F.col("response")
    return captures.select(r.capture_key.cast(kind).alias(id_col), r.payload_bytes.alias("payload_bytes"), r.payload_digest.alias("payload_digest"), r.record_type.alias("record_type"), r.refers_to.cast(kind).alias("refers_to"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))
