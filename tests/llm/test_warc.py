import base64
import glob
import hashlib

import pytest

from palimpsest.llm import queries, warc


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and first.get(h or "", i) != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def evil(i):
    """Payloads that hold the magic, whole records and lying lengths."""
    inner = warc.record(900 + i, "u", b"x" * i, None).decode() + "\r\n"
    return [
        (i, "http://a/", "<p>" + inner * 3 + "</p>"), (i + 1, "a\r\nb%", inner), (i + 2, None, "WARC/1.0\r\n"), (i + 3, "WARC/1.0\r\n", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n" * 4),
        (i + 4, "x", "WWARC/1.0\r\nWARC/1.0\r" + "y" * i), (i + 5, "x", "WARC/1.0\r\nContent-Length: 4\r\n\r\nabcd"), (i + 6, "x", inner + "z" * 3000),
    ]


@pytest.fixture
def odd(spark):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, "v", "same"), (2, "v", "same"), (None, "n", "same"), (None, None, None), (4, None, ""), (5, "", None), (6, "é", "ü\n" * 50_000), (7, "u", "\r\n\r\n"), (-8, "m", "minus")]
    for i in range(20, 300, 7):
        rows += evil(i)
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("split", ["128m", "3000", "700"])
def test_round_trip_over_splits(spark, odd, split):
    rows, df = odd
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.round_trip(df.coalesce(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_small_payloads_are_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(df, least=3).collect())) == brute(rows, 3)


def test_files_are_plain_archives(spark, odd, tmp_path):
    rows, df = odd
    warc.write(df.coalesce(1), f"{tmp_path}/w")
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/w/part-*")))
    n = 0
    while data:
        assert data.startswith(warc.MAGIC)
        head, fields = warc._parse(data[warc.M :])
        end = warc.M + head + int(fields["content-length"])
        assert data[end : end + 4] == b"\r\n\r\n"
        data, n = data[end + 4 :], n + 1
    assert n == len(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op2_warc_round_trip(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_chain_of_jumps(spark):
    jumps = spark.createDataFrame([("f", i, i + 1) for i in range(100)] + [("f", 200, 201), ("g", 0, 5)], "file string, at long, to long")
    start = spark.createDataFrame([("f", 0), ("g", 0)], "file string, at long")
    assert {tuple(r) for r in warc.reached(start, jumps, 100).collect()} == {("f", i) for i in range(101)} | {("g", 0), ("g", 5)}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
