import base64
import hashlib
import struct

import zstandard

from voxelith.llm import warc

ODD = [
    (1, "http://a/1", "<p>x</p>"),
    (2, None, "<p>x</p>"),
    (2, None, "<p>x</p>"),
    (3, "http://a/3\n", None),
    (4, "http://a/4", ""),
    (5, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 3),
    (6, "http://é/😀", "é😀" * 100000),
    (None, "http://a/n", "<p>x</p>"),
    (None, "http://a/n", "<p>none</p>"),
    (-7, "http://a/m", "<p>x</p>"),
]


def brute(rows, least=0):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, d in data:
        if p is not None:
            first[d] = min(first.get(d, p), p)
    out = []
    for p, d in data:
        f = first.get(d)
        ref = None if f is None or f == p or len(d) < least else f
        out.append((p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert result(warc.archive_round_trip(pages)) == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    assert result(warc.archive_round_trip(df)) == brute(ODD)
    assert result(warc.archive_round_trip(df, min_bytes=10)) == brute(ODD, 10)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_long_pages_clashing_columns_and_hot_payloads(spark):
    rows = [(1, "http://a/1", "x" * 5_000_000), (2, "http://a/2", "x" * 5_000_000)] + [(10 + i, f"http://a/{i}", "the same page") for i in range(500)] + [(600 + i, None, f"own {i}") for i in range(50)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, payload string, sha int").repartition(5)
    out = warc.archive_round_trip(df)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert result(out) == brute(rows)


def test_stores_by_their_hadoop_names(monkeypatch, tmp_path):
    seen = []

    class Store:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return object(), uri.split("://")[1]

    monkeypatch.setattr(warc.fs, "FileSystem", Store)
    monkeypatch.setattr(warc, "_stores", {})
    one, path = warc._open("s3a://bucket/a/b")
    two, other = warc._open("s3://bucket/c")
    assert one is two and path == "bucket/a/b" and other == "bucket/c" and seen == ["s3://bucket/a/b"]
    assert warc._open("dbfs:/a/b")[1] == "/dbfs/a/b" and warc._open("file:/x/y")[1] == "/x/y" and warc._open("/x/z")[1] == "/x/z"


def test_seeking_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(df, f"file://{tmp_path}/w", frame_bytes=4096).collect()
    assert len({r["frame"] for r in index}) > 10
    reader = warc.BundleReader(index[0]["bundle"])
    for r in index[::17]:
        head, _, payload, _ = reader.record(r["frame"], r["offset"])
        assert head["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and payload.decode() == f"page {r['page_id']} " * 50
    data = open(index[0]["bundle"].removeprefix("file://"), "rb").read()
    assert struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE_MAGIC
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response") == 200
    got = warc.read_archives(spark, spark.createDataFrame(index), payloads=True).collect()
    assert {r["page_id"]: r["payload"].decode() for r in got} == {i: f"page {i} " * 50 for i in range(200)}
