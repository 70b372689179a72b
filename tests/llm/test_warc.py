import base64
import gzip
import hashlib
import zlib

import pytest

from urlweave.llm import warc as W

SF = "/root/testdata/sf0.001"


def brute(pages):
    """page_id -> (bytes, digest, type, refers_to)."""
    first = {}
    for i, html in pages:
        first[html or ""] = min(i, first.get(html or "", i))
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, h in pages}


def test_round_trip_of_the_pages(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r["page_id"]: tuple(r)[1:] for r in W.op5_warc(spark, SF).collect()}
    assert got == brute(pages)


@pytest.mark.parametrize("size", [1, 97, 1000, 1 << 20])
def test_ranges_of_any_size_read_every_record_once(spark, tmp_path, size):
    rows = [(i, f"http://a/{i}", ["x" * i, None, "", "same", "é" * 50][i % 5]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    manifest = W.write_archives(pages, f"file://{tmp_path}/a")
    got = W.read_archives(manifest, f"file://{tmp_path}/a", max(size, 50)).collect()
    want = brute([(i, h) for i, _, h in rows])
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted((k, *v) for k, v in want.items())
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in rows}


def test_a_record_inside_a_payload_is_not_a_record(tmp_path):
    """A stored (uncompressed) member that holds a whole record: only the outer one counts, from any range."""
    inner = W.record(7, "http://in/", b"inner", W.base32_sha1(b"inner"), None, False)
    outer_payload = b"<html>" + inner + b"</html>"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: " + str(len(outer_payload) + 4).encode() + b"\r\n\r\n\r\n\r\n" + outer_payload + b"\r\n\r\n"
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = stored.compress(head) + stored.flush() + W.record(2, "http://b/", b"next", W.base32_sha1(b"next"), None, False)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    files, path = W.filesystem(f"file://{tmp_path}/a.warc.gz")
    archive = W.Archive(files, path, len(raw))
    found = [W.parse(r)["page_id"] for k in range(0, len(raw), 64) for _, r in archive.records(k, min(k + 64, len(raw)))]
    assert found == [1, 2]
    assert gzip.decompress(raw)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None), (3, "http://a/\r\nX: y", "p"), (3, "http://a", "p"), (5, "", "p"), (None, "u", "p"), (9, "v", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/b"
    got = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in W.read_archives(W.write_archives(pages, folder), folder).collect())
    assert got == [(-1, "response", 0, 0), (-1, "revisit", 3, 1), (3, "response", 0, 1), (3, "response", 0, 1), (5, "revisit", 3, 1), (9, "response", 0, 300_000)]
    empty = W.write_archives(pages.limit(0), f"file://{tmp_path}/c")
    assert W.read_archives(empty, f"file://{tmp_path}/c").collect() == []
