"""WARC archives of web pages: written and read as text records, put together per capture.

Every page becomes a request, a response (or a revisit of an equal payload) and a metadata
record. Request and metadata name the response in ``WARC-Concurrent-To``; reading joins the
three on it into one nested row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record ends with two empty lines; a header ends with one.
END = "\r\n\r\n"
RECORDS_PER_FILE = 30_000
#: Payloads of fewer bytes are always stored.
LEAST = 1000

RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target string, "
    "content_type string, payload_bytes long, payload_digest string, fields map<string,string>, payload string"
)


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, content_type: str, block: Column, **headers: Column) -> Column:
    """Text of a record without its end. Headers that are null are left out."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        *[F.concat(F.lit(f"{n.replace('_', '-')}: "), c) for n, c in headers.items()],
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes`` and ``response_id, response_url`` for revisits.

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest id is the
    response. Rows equal in id and payload are all responses. A null id is the smallest.
    The join reads each page once; a payload that a third of all pages share is split by AQE.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumn("payload_digest", F.sha1(F.col("html").cast("binary"))).withColumn(
        "payload_bytes", F.octet_length("html").cast("long")
    )
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    shared = large.agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(shared.select("payload_digest", "kept"), "payload_digest", "left")
    later = F.col("kept.page_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept.page_id")))
    return joined.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(later, F.col("kept.page_id")).alias("response_id"),
        F.when(later, F.col("kept.url")).alias("response_url"),
    )


def records(pages: DataFrame, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``value``: the text of three records per page. A null payload is empty, a null url has no header."""
    rows = roles(pages, least)
    own = _id(F.lit("response"), F.col("page_id"), F.col("payload_digest"), F.col("url"))
    first = _id(F.lit("response"), F.col("response_id"), F.col("payload_digest"), F.col("response_url"))
    again = F.col("response_id").isNotNull()
    common = {"WARC_Target_URI": F.col("url"), "WARC_Date": F.lit(date)}
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(" HTTP/1.1" + END))
    noted = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nrevisit-of: "), F.coalesce(F.col("response_id").cast("string"), F.lit("")), F.lit("\r\n"),
    )
    response = _record(
        F.when(again, "revisit").otherwise("response"), "application/http;msgtype=response",
        F.concat(http, F.when(again, "").otherwise(F.col("html"))), WARC_Record_ID=own, **common,
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), "payload_digest"), WARC_Refers_To=F.when(again, first),
    )
    parts = [
        _record("request", "application/http;msgtype=request", asked, WARC_Concurrent_To=own, **common,
                WARC_Record_ID=_id(F.lit("request"), F.col("page_id"), F.col("payload_digest"), F.col("url"))),
        response,
        _record("metadata", "application/warc-fields", noted, WARC_Concurrent_To=own, **common,
                WARC_Record_ID=_id(F.lit("metadata"), F.col("page_id"), F.col("payload_digest"), F.col("url"))),
    ]
    return rows.select(F.explode(F.array(*parts)).alias("value"))


def write(records: DataFrame, folder: str) -> None:
    """WARC/1.1 files, each one gzip stream and therefore read by one task from its start."""
    records.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(folder)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record. Digest and size are of the payload as stored, for a revisit as noted.

    Files are streamed: no more than a record and a batch is held. A payload may hold anything,
    record ends included, because records are told apart by ``Content-Length``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *[(n, pa.string()) for n in ("type", "record_id", "concurrent_to", "refers_to", "target", "content_type")],
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.string()),
        ])
        stream, need, rows, weight = bytearray(), 0, [], 0
        for batch in batches:
            for piece in batch.column(0).cast(pa.binary()).to_pylist():
                stream += piece + _END
                while len(stream) >= need:
                    record, used, need = _next(stream)
                    if record is None:
                        break
                    del stream[:used]
                    rows.append(_row(*record, payloads))
                    weight += used
                if len(rows) >= 10_000 or weight > 1 << 24:
                    yield _batch(rows, schema)
                    rows, weight = [], 0
        if rows:
            yield _batch(rows, schema)

    return spark.read.option("lineSep", END).text(folder).mapInArrow(run, RECORD)


_END = END.encode()


def _next(stream: bytearray) -> tuple[tuple[dict[str, str], bytes] | None, int, int]:
    """The record at the start of ``stream`` and its length; or how long the stream must be for it."""
    start = 0
    while stream[start : start + 2] == b"\r\n":  # ends of the record before, and of a file
        start += 2
    head = stream.find(_END, start)
    if head < 0:
        return None, 0, len(stream) + 1
    lines = stream[start:head].decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = head + len(END) + int(headers["Content-Length"])
    if len(stream) < end:
        return None, 0, end
    return (headers, bytes(stream[head + len(END) : end])), end, 0


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = headers["WARC-Type"]
    size = digest = fields = payload = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(_END)
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if kind == "revisit":
            size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        elif payloads:
            payload = body.decode()
    elif kind == "metadata":
        fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
    names = ("WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "Content-Type")
    return kind, *[headers.get(n) for n in names], size, digest, fields, payload


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, page_id, url, request, response, metadata``.

    Records meet by ``WARC-Concurrent-To``. A capture without a response or revisit is left out;
    one without request or metadata has null there. Captures that were archived more than once
    with equal page and payload come out as often as they were.
    """
    key = F.coalesce("concurrent_to", "record_id")
    is_response = F.col("type").isin("response", "revisit")
    of = lambda kind, *names: F.first(F.when(F.col("type") == kind, F.struct(*names)), ignorenulls=True)
    stored = ("type", "record_id", "refers_to", "payload_bytes", "payload_digest", "payload")
    grouped = records.groupBy(key.alias("capture_id")).agg(
        of("request", "record_id", "target").alias("request"),
        F.first(F.when(is_response, F.struct(*stored)), ignorenulls=True).alias("response"),
        of("metadata", "record_id", "fields").alias("metadata"),
        F.count(F.when(is_response, 1)).alias("n"),
    )
    field = lambda name: F.nullif(F.col("metadata.fields")[name], F.lit("")).cast("long")
    return grouped.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select(
        "capture_id", field("page-id").alias("page_id"), F.col("request.target").alias("url"),
        field("revisit-of").alias("revisit_of"), "request", "response", "metadata",
    )
