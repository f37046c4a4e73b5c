import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import warc

from .helpers import stored

ROWS = [(1, "u", "x" * 250), (2, None, "y" * 99), (12, "u", "y" * 99),
        (3, "a b\n", "WARC/1.1\r\nfoo\r\n\r\nWARC/1.1\r\n" * 20), (4, "u", None), (5, "u", ""),
        (6, "u", "é日𝒳" * 300 + "\r\n"), (7, "u", "x" * 250), (None, "u", "x" * 250),
        (8, "u", "z\r\n\r\nWARC" * 30 + "\r\n\r\n"), (9, "u", "\r\n\r\n" * 50), (1, "u", "x" * 250),
        (10, "u", "é" * 50), (11, "u", "é" * 50), (None, None, "only null ids" * 20)]


@pytest.mark.parametrize("chunk", [warc.CHUNK, 100, 7])
def test_round_trip(spark, tmp_path, chunk):
    df = stored(spark.createDataFrame(ROWS, "page_id long, url string, html string")
                .withColumns({"row": F.lit("x"), "first": F.lit(1)}), tmp_path)
    path = str(tmp_path / "archives")
    warc.write_archives(warc.describe(df), path, chunk=chunk)
    chunks = warc.read_chunks(spark, path, keep_data=True)
    assert chunks.where(F.length(F.decode("data", "UTF-8")) > chunk).count() == 0
    got = sorted((tuple(r) for r in warc.assemble(chunks).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        ids = [j for j, _, h in ROWS if h == html and len(raw) >= 100 and j is not None]
        again = bool(ids) and i != min(ids)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                     min(ids) if again else None))
    assert got == sorted(want, key=str)


def test_files_are_warc(spark, tmp_path):
    import gzip
    df = stored(spark.createDataFrame(ROWS, "page_id long, url string, html string"), tmp_path)
    path = tmp_path / "archives"
    warc.write_archives(warc.describe(df), str(path))
    seen = 0
    for f in path.glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        while raw:  # record after record, by the stated lengths
            head, _, rest = raw.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert rest[n:n + 4] == b"\r\n\r\n"
            raw, seen = rest[n + 4:], seen + (b"WARC-Type: continuation" not in head)
    assert seen == len(ROWS)


def test_empty_table(spark, tmp_path):
    df = stored(spark.createDataFrame(ROWS, "page_id long, url string, html string").limit(0), tmp_path)
    path = str(tmp_path / "archives")
    warc.write_archives(warc.describe(df), path)
    assert warc.assemble(warc.read_chunks(spark, path)).count() == 0
