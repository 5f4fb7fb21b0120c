"""Archives come back as they were written."""

import base64
import hashlib
import io

import pytest

from splicework.llm import warc


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    pages = [(1, "http://a/1", "same text é"), (5, "http://a/5", "same text é"), (3, None, "same text é"), (2, "http://b\r\nX: y", None), (4, "u", ""), (6, "u", "abc"), (7, "u", "abc"), (8, "u", "x\r\n\r\ny" * 200000)]
    pages += [(100 + i, f"http://c/{i}", f"<html>page {i} with some shared text</html>") for i in range(60)] + [(None, "n", "no id"), (7, "u", "abc")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    paths = warc.archive(df, f"file://{tmp_path}/warc", least)
    back = warc.read_archives(paths).collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(p[0]) for p in pages)
    by_id = {p[0]: (p[2] or "").encode() for p in pages}
    largest = {}
    for i, body in by_id.items():
        if i is not None and len(body) >= least:
            largest[body] = max(largest.get(body, i), i)
    for r in back:
        body = by_id[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = largest.get(body, r.page_id)
        if r.page_id is None or r.page_id == first:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", first, b"")


def test_container():
    records = [f"record {i} ".encode() * 50 for i in range(40)] + [b"", bytes(range(256)) * 1000]
    data = warc.pack(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.unpack(io.BytesIO(data))) == records
    assert list(warc.unpack(io.BytesIO(warc.pack(records[:2])))) == records[:2] and list(warc.unpack(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.unpack(io.BytesIO(data[:-3])))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archive(df, f"file://{tmp_path}/none")).count() == 0
