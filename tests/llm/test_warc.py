import pytest

from tessera.llm import warc
from tessera.llm.common import scratch_path


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw) if page is not None and first.get(raw) != page else None
        out.append((page, len(raw), warc.digest(raw), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


FAKE = warc.record(999, "http://fake/", b"inside", None).decode() + "\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/ c\r\n", "<p>one</p>"), (3, None, None), (4, "http://d/", ""),
    (5, "http://e/", "WARC/1.1\r\n"), (6, "http://f/", "x" + FAKE + "y"), (7, "http://g/", FAKE * 3), (8, "", FAKE),
    (9, "http://h/", "WARC/1.1\r\nContent-Length: 5\r\nWARC-Type: x\r\n\r\nabc"), (None, "http://i/", "<p>one</p>"),
    (0, "http://j/", "\r\n\r\n"), (10, "http://k/", "\r\n\r\n"), (10, "http://k/", "\r\n\r\n"), (11, "http://l/", "ü" * 50000),
    (12, "http://m/", "WARC/1.1\r\n" * 50), (-5, "http://n/", "tail WARC/1.1\r\n"),
]


@pytest.mark.parametrize("files", [1, 4])
@pytest.mark.parametrize("block", [None, "700b", "50kb"])
def test_round_trip_with_magic_in_payloads(spark, files, block):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, refers_to string").coalesce(files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        path = scratch_path(spark, "warc-test")
        warc.write_archives(pages, path)
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == brute(ROWS)


def test_least_size_and_empty_table(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(pages, min_revisit_bytes=5).collect()), key=str)
    assert got == brute(ROWS, 5)
    assert warc.round_trip(pages.limit(0)).count() == 0
