"""WARC archives written and read as tables of record chunks.

A payload becomes rows (record id, chunk number, data) of at most ``CHUNK``
characters.  A payload of one chunk is one WARC record; a longer one is a
``response`` record with segment number 1 and ``continuation`` records, the
format's own segments.  Every record is one row of Spark's text writer, whose
line separator ends it, so no task holds more than a chunk besides its input
row, and archives land on any file system Spark writes to.

Archives are read back with the start of a record as line separator.  Segment
cuts fall inside every ``WARC/1.1`` a payload holds, so a payload cannot look
like a record's start.  Records of one segment are digested where they are
read; only segments are shuffled, sorted by (record, number) and fed one
after another to an incremental SHA-256.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest page id is a ``response``, the others are ``revisit`` records
without the payload.

Defined results: null or empty html: an empty payload; a null page id
precedes nothing (it never is the smallest unless all are null); rows that
repeat the smallest id are all responses; every row has its record; a null url has no
target URI, and control characters in one are percent-encoded; other columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, scratch

CHUNK = 1 << 20
MIN_REVISIT = 100
BATCH_CHARS = 1 << 23  # of records handed back at once
VERSION = "WARC/1.1"
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CUT = re.compile(r"(?<=WARC)(?=/1\.1)")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def describe(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``pages`` (a stored table with page_id, url, html) with row number,
    payload size and digest, record type and the page it revisits."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.monotonically_increasing_id().alias("row"),
                        F.octet_length(html).cast("long").alias("payload_bytes"),
                        F.sha2(html, 256).alias("payload_digest"))
    # Only groups of copies; a group reaches its row as one partial per task.
    firsts = (rows.filter(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 AND first IS NOT NULL").select("payload_digest", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (rows.join(firsts, "payload_digest", "left")
            .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first"))).drop("first"))


def segments(payload: str, chunk: int = CHUNK) -> Iterator[str]:
    """The payload in parts of at most ``chunk`` characters, none holding a record's start."""
    for part in _CUT.split(payload) if VERSION in payload else (payload,):
        for at in range(0, len(part), chunk) if part else (0,):
            yield part[at:at + chunk]


def _header(fields: list[tuple[str, object]]) -> str:
    return END.join([VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""])


def records_of(row: dict, chunk: int = CHUNK) -> Iterator[str]:
    """The WARC records of a described page."""
    own = f"<urn:page:{row['row']}>"
    url = row["url"]
    common = [("WARC-Date", DATE),
              ("WARC-Target-URI", url and _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
              ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
              ("X-Page-Id", row["page_id"])]
    http = HTTP % row["payload_bytes"]
    if row["record_type"] == "revisit":
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                       ("WARC-Profile", PROFILE), ("X-Refers-To-Page", row["refers_to"]),
                       ("Content-Type", "application/http;msgtype=response"),
                       ("Content-Length", len(http))]) + http + END
        return
    parts = list(segments(row["html"], chunk))
    for k, data in enumerate(parts):
        size = len(data) if data.isascii() else len(data.encode())
        if k == 0:
            yield _header([("WARC-Type", "response"), ("WARC-Record-ID", own), *common,
                           ("WARC-Segment-Number", 1 if len(parts) > 1 else None),
                           ("Content-Type", "application/http;msgtype=response"),
                           ("Content-Length", len(http) + size)]) + http + data + END
        else:
            total = len(http) + row["payload_bytes"] if k == len(parts) - 1 else None
            yield _header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{row['row']}:{k}>"),
                           ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1),
                           ("WARC-Date", DATE), ("WARC-Segment-Total-Length", total),
                           ("Content-Length", size)]) + data + END


def write_archives(described: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """One record a row, gzip files."""
    cols = ["row", "page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in range(b.num_columns))):
                for text in records_of(dict(zip(cols, (x.as_py() for x in row))), chunk):
                    out.append(text)
                    held += len(text)
                    if held >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    (map_arrow(described.select(*cols), run, "value string")
     .write.option("lineSep", END).option("compression", "gzip").text(path))


CHUNKS = ("record string, number int, record_type string, page_id long, refers_to long, "
          "stated_bytes long, stated_digest string, data binary, data_bytes long, data_digest string")


def read_chunks(spark: SparkSession, path: str, keep_data: bool = False) -> DataFrame:
    """The archives as chunk rows.  A record of one segment comes with its
    digest, and with its data only if asked for."""
    rows = spark.read.option("lineSep", f"{END}{END}{VERSION}{END}").text(path)
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.binary(), pa.int64(), pa.string())

    def parse(value: str) -> tuple:
        head, _, block = value.partition(END + END)
        fields = dict(line.split(": ", 1) for line in head.split(END) if ": " in line)
        data = block.encode()[:int(fields["Content-Length"])]
        kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 0))
        record = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        number_of = lambda k: int(fields[k]) if k in fields else None
        stated = None
        if kind != "continuation":
            http, _, data = data.partition(b"\r\n\r\n")
            stated = int(http.rsplit(b": ", 1)[1])
        whole = number == 0 and kind == "response"
        return (record, number, kind, number_of("X-Page-Id"), number_of("X-Refers-To-Page"), stated,
                fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                data if keep_data or number else None, len(data),
                hashlib.sha256(data).hexdigest() if whole else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [parse(v.as_py()) for v in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return map_arrow(rows, run, CHUNKS)


def assemble(chunks: DataFrame) -> DataFrame:
    """One row per record: page, size and digest of the payload as read back
    (of a revisit: as stated), type and the page it refers to."""
    whole = chunks.filter("number = 0")
    parts = (chunks.filter("number > 0").repartition("record")
             .sortWithinPartitions("record", "number"))
    out = ["record", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, sha = None, 0, None

        def done() -> pa.RecordBatch:
            row = (first["record"], "response", first["page_id"], None, size, sha.hexdigest())
            if size != first["stated_bytes"] or row[5] != first["stated_digest"]:
                raise ValueError(f"{first['record']}: the segments do not give the stated payload")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=out)

        for b in batches:
            for r in range(b.num_rows):
                chunk = {n: b.column(n)[r].as_py() for n in b.schema.names}
                if first is None or chunk["record"] != first["record"]:
                    if first is not None:
                        yield done()
                    first, size, sha = chunk, 0, hashlib.sha256()
                size += len(chunk["data"])
                sha.update(chunk["data"])
        if first is not None:
            yield done()

    kinds = "record string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"
    again = F.col("record_type") == "revisit"
    return (whole.select("record", "record_type", "page_id", "refers_to",
                         F.when(again, F.col("stated_bytes")).otherwise(F.col("data_bytes")).alias("payload_bytes"),
                         F.when(again, F.col("stated_digest")).otherwise(F.col("data_digest")).alias("payload_digest"))
            .unionByName(map_arrow(parts, run, kinds)))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(describe(read(spark, sf_dir, "pages")), path)
    return (assemble(read_chunks(spark, path))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100
                 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100)
                 ELSE page_id END AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
