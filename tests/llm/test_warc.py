import base64
import gzip
import hashlib
import io
import uuid

import pytest

from cairn.llm import queries, shared, warc

SF = "/root/testdata/sf0.01"


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= least and f is not None and f != i
        out.append((i, len(b), b32(b), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_query_like_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op6_warc(spark, SF).collect()), key=str) == brute(rows)


def test_cases(spark):
    rows = [(3, "u", "same"), (1, "v", "same"), (2, None, "same"), (1, "v", "same"), (4, "a\r\nb c", None), (5, "é", ""), (None, "n", "same"), (None, "m", "alone"), (None, "m", "alone"), (6, "x", "\r\n\r\nWARC/1.1\r\n" * 50_000), (7, "y", "ü")]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, payload string, first int")
    for least, size in ((0, warc.ARCHIVE_BYTES), (0, 10), (5, 1000)):
        folder = f"{shared.folder(spark)}/warc-test-{uuid.uuid4().hex}"
        manifest = warc.archive(pages, folder, least, size)
        got = warc.read_back(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least)
        assert sum(r["n_records"] for r in manifest.collect()) == len(rows)
    assert warc.archive(pages.limit(0), folder).count() == 0


def test_normalise_any_shape():
    parts = [warc.record(k, f"u{k}", b"x" * (k * 1000)) for k in range(200)]
    shapes = [b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts[:90])) + gzip.compress(b"".join(parts[90:])) + b"\0" * 99]
    for whole in shapes:
        target, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(whole), target, index) == 200
        assert gzip.decompress(target.getvalue()) == b"".join(parts)
        import json

        places = [json.loads(x) for x in index.getvalue().splitlines()]
        for k in (0, 57, 199):
            head, block = warc.member(target, places[k]["offset"], places[k]["length"])
            assert head["warc-record-id"] == f"<urn:page:{k}>" and block.endswith(b"x" * (k * 1000))
    for broken, what in ((shapes[1][:-20000], "truncated"), (shapes[0][:-3], "truncated"), (shapes[0][100:], "WARC version"), (b"WARC/1.1\r\nA: b\r\n\r\n", "Content-Length")):
        with pytest.raises(ValueError, match=what):
            warc.normalise(io.BytesIO(broken), io.BytesIO(), io.BytesIO())
