import base64
import hashlib
import io
import zlib

import pytest

from tessera.llm import warc as W


def digest(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_round_trip_with_copies_and_odd_rows(spark):
    big = "é" * 700_000
    rows = [(i, f"https://x/{i} y\r\n", ["same", f"own {i}", None][i % 3]) for i in range(60)]
    rows += [(100, None, big), (101, "u", big), (None, "u", "same"), (7, "u", "own 7"), (102, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_archives(W.archive(df)).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    responses = {}
    for r in got:
        if r.record_type == "response":
            assert r.refers_to is None
            responses[r.payload_digest] = responses.get(r.payload_digest, 0) + 1
    want = {digest(h): (len(h.encode()), i) for h, i in top.items()}
    assert responses == dict.fromkeys(want, 1)
    for r in got:
        size, best = want[r.payload_digest]
        assert r.payload_bytes == size
        assert r.record_type == ("response" if r.refers_to is None else "revisit") and r.refers_to in (None, best)
        if r.record_type == "response":
            assert r.page_id == best


def test_chunks_carry_incremental_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij"), (2, "u", None)], "page_id long, url string, html string")
    rows = W.chunk_table(df, chunk_bytes=4).orderBy("page_id", "chunk_no").collect()
    assert [bytes(r.chunk) for r in rows] == [b"abcd", b"efgh", b"ij", b""]
    assert [r.digest for r in rows] == [digest("abcd"), digest("abcdefgh"), digest("abcdefghij"), digest("")]
    assert [r.is_last for r in rows] == [False, False, True, True]


def test_min_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in W.read_archives(W.archive(df, min_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert W.read_archives(W.archive(df.limit(0))).count() == 0


def test_parser_reads_members_in_small_blocks():
    body = b"x" * 5000 + b"\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    got = [(h["WARC-Type"], b"".join(p)) for h, p in W.parse_archive(io.BytesIO(pack(record) * 3))]
    assert got == [("response", body)] * 3


def test_addresses_as_spark_names_them(tmp_path):
    pytest.importorskip("pyarrow.fs")
    from pyarrow import fs

    assert W.store_of(f"file://{tmp_path}")[1] == str(tmp_path)
    if hasattr(fs, "S3FileSystem"):
        assert [W.store_of(f"{x}://bucket/a/b?region=us-east-1")[1] for x in ("s3", "s3a", "s3n")] == ["bucket/a/b"] * 3
