"""WARC archives: writing with revisit records, reading, and assembly of transactions.

Every capture is three records: the request, the response (or a revisit, if an equal payload is stored
already) and a metadata record; request and metadata name the capture in ``WARC-Concurrent-To``. Reading
walks the records by their content length, and assembly joins the three through the concurrent-to
identifier into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, work_dir

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Captures in one archive file at most.
CAPTURES_PER_FILE = 2000
RECORD_SCHEMA = "record_id string, concurrent_to string, kind string, uri string, page_id string, payload_bytes long, payload_digest string, stored_digest string"


def _lines(*parts: Column | str | None) -> Column:
    """Concatenate; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record(kind: Column | str, record_id: Column, uri: Column, date: str, extra: Column, content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    target = F.when(uri.isNotNull(), _lines("WARC-Target-URI: ", uri, CRLF)).otherwise(F.lit(""))
    return _lines("WARC/1.1", CRLF, "WARC-Type: ", kind, CRLF, "WARC-Record-ID: ", record_id, CRLF, f"WARC-Date: {date}", CRLF, target, extra, f"Content-Type: {content_type}", CRLF, "Content-Length: ", F.octet_length(block).cast("string"), CRLF, CRLF, block, CRLF, CRLF)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``pages`` as gzip WARC files under ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` the smallest id is stored as a response (so are
    repeated rows of that id), the others revisit it; shorter ones are all stored. Null html is an empty
    payload; a null id is never the smallest; line breaks in a URL are dropped.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    p = pages.select(pages[id_col].alias("id"), F.regexp_replace(pages[url_col], "[\r\n]", "").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    slim = p.where(F.col("n") >= min_revisit_bytes).select("id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    again = slim.join(firsts, "digest").where("id is null or id > first").select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest")).distinct()
    p = p.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    revisit = F.col("again_digest").isNotNull()
    urn = lambda kind: _lines("<urn:uuid:", F.regexp_replace(F.md5(_lines(f"{kind} ", F.coalesce(F.col("id").cast("string"), F.lit("")), " ", F.col("row").cast("string"))), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), ">")
    p = p.withColumn("row", F.monotonically_increasing_id()).withColumn("capture", urn("capture"))
    concurrent = _lines("WARC-Concurrent-To: ", F.col("capture"), CRLF)
    uri = F.col("url")
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit(""))
    request = _record("request", urn("request"), uri, date, concurrent, "application/http;msgtype=request", _lines("GET ", F.coalesce(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^#]*)", 1), F.lit("/")), " HTTP/1.1", CRLF, "Host: ", host, CRLF, CRLF))
    head = _lines("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", F.col("n").cast("string"), CRLF, CRLF)
    digest = _lines("WARC-Payload-Digest: sha256:", F.col("digest"), CRLF)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("capture"), uri, date,
        F.concat(digest, F.when(revisit, f"WARC-Profile: {REVISIT_PROFILE}{CRLF}").otherwise("")),
        "application/http;msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    metadata = _record("metadata", urn("metadata"), uri, date, concurrent, "application/warc-fields", F.when(F.col("id").isNull(), "").otherwise(_lines("page-id: ", F.col("id").cast("string"), CRLF)))
    # the writer ends each value with the line separator, the last two bytes of the last record
    value = p.select(F.concat(request, response, F.regexp_replace(metadata, r"\r\n\z", "")).alias("value"))
    value.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Records of one archive from its decompressed bytes, piece by piece."""
    buffer = bytearray()
    more = True

    def fill(n: int) -> None:
        nonlocal more
        while more and len(buffer) < n:
            chunk = next(chunks, None)
            if chunk is None:
                more = False
            else:
                buffer.extend(chunk)

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more:
            fill(len(buffer) + 1)
        if end < 0:
            if buffer.strip():
                raise ValueError("an archive ends inside a record's header")
            return
        if not buffer.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {bytes(buffer[:40])!r}")
        fields = {k.strip().lower(): v for k, v in _FIELD.findall(bytes(buffer[: end + 2]))}
        size = int(fields[b"content-length"])
        fill(end + 4 + size + 4)
        block = bytes(buffer[end + 4 : end + 4 + size])
        if len(block) < size:
            raise ValueError("an archive ends inside a record")
        del buffer[: end + 4 + size + 4]
        yield _facts(fields, block)


def _facts(fields: dict[bytes, bytes], block: bytes) -> dict:
    said = lambda name: fields[name].decode() if name in fields else None
    kind = said(b"warc-type")
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest"))
    out |= {"record_id": said(b"warc-record-id"), "concurrent_to": said(b"warc-concurrent-to"), "kind": kind, "uri": said(b"warc-target-uri"), "stored_digest": (said(b"warc-payload-digest") or "").removeprefix("sha256:") or None}
    if kind == "metadata":
        found = dict(_FIELD.findall(block)).get(b"page-id")
        out["page_id"] = found.decode() if found is not None else None
    elif kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        else:  # the payload itself is with the response that it revisits
            http = {k.lower(): v for k, v in _FIELD.findall(head + b"\r\n")}
            out |= {"payload_bytes": int(http[b"content-length"]), "payload_digest": out["stored_digest"]}
    return out


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members."""
    while data:
        member = zlib.decompressobj(31)
        at = 0
        while not member.eof and at < len(data):
            yield member.decompress(data[at : at + step])
            at += step
        data = member.unused_data + data[at:]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip WARC files under ``path``."""
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"payload_bytes": pa.int64()}
        for batch in batches:
            for data in batch.column(0):
                rows = list(parse_records(_inflated(data.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit) and metadata.

    A capture's records meet through the concurrent-to identifier; a missing one is null.
    """
    key = F.coalesce("concurrent_to", "record_id")
    one = lambda kinds, *fields: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*fields)))
    return records.groupBy(key.alias("capture_id")).agg(
        one(("request",), "record_id", "uri").alias("request"),
        one(("response", "revisit"), "kind", "uri", "payload_bytes", "payload_digest", "stored_digest").alias("response"),
        one(("metadata",), "record_id", "page_id").alias("metadata"),
    )


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back, and give one row per capture.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, capture_id. A revisit refers
    to the smallest id among the responses of its digest. Repeated rows give a capture each; a capture
    whose request, payload or metadata is missing or whose digest differs from its header raises.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    captures = assemble(read_records(spark, path))
    broken = F.col("request").isNull() | F.col("metadata").isNull() | ~F.col("response.payload_digest").eqNullSafe(F.col("response.stored_digest"))
    rows = captures.select(
        F.when(broken, F.raise_error(F.concat(F.lit("broken capture "), "capture_id")).cast(kind)).otherwise(F.col("metadata.page_id").cast(kind)).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "capture_id",
    )
    rows = stored(rows, "captures")
    firsts = rows.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("refers"))
    revisits = rows.where("record_type = 'revisit'").join(firsts, F.col("payload_digest") == F.col("d"), "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return rows.where("record_type <> 'revisit'").select(*out, F.lit(None).cast(kind).alias("refers_to"), "capture_id").unionByName(revisits.select(*out, F.col("refers").alias("refers_to"), "capture_id"))
