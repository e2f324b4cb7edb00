import base64
import gzip
import hashlib
import random
import tempfile

import pytest

from gazette.llm.op1_warc import framed, member, read_archives, unframed, write_archives


def brute(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if page is not None:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, url, html in rows:
        b = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        kind = "response" if first.get(b) == page else "revisit"
        out.append((page, url, kind, first[b] if kind == "revisit" else None, len(b), sha, b if kind == "response" else None))
    return sorted(map(repr, out))


def corpus():
    rng = random.Random(1)
    html = [None, "", "x", "é" * 70_000, "0\r\n\r\nWARC/1.1\r\n" * 9000] + ["".join(rng.choice("ab<>é\n") for _ in range(rng.choice([10, 900, 40_000]))) for _ in range(30)]
    rows = [(i * 7 % 101, f"http://h{i}/é", rng.choice(html)) for i in range(100)]
    return rows + [(500, None, "x"), (501, "http://a\r\nX: 1", ""), rows[3], rows[3]]


@pytest.mark.parametrize("segment", [1000, 32 << 10])
def test_round_trip(spark, segment):
    rows = corpus()
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, kind string, digest string").repartition(3)
    manifest = write_archives(pages, folder, segment=segment, chunk=500, archive=20_000).collect()
    assert len(manifest) > 3 and all(r.bytes > 0 for r in manifest)
    out = read_archives(spark, folder).collect()
    want = [(p, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, h) for p, u, h in rows]
    assert sorted(repr((r.page_id, r.url, r.kind, r.refers_to, r.bytes, r.digest, None if r.payload is None else bytes(r.payload))) for r in out) == brute(want)
    assert all(r.complete for r in out)


def test_null_id_and_empty(spark):
    schema = "page_id long, url string, html string"
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    write_archives(spark.createDataFrame([(None, "u", "same"), (4, "u", "same"), (None, "u", "alone")], schema), folder)
    out = sorted((repr(r.page_id), r.kind, repr(r.refers_to)) for r in read_archives(spark, folder).collect())
    assert out == [("4", "response", "None"), ("None", "response", "None"), ("None", "revisit", "4")]
    empty = "file://" + tempfile.mkdtemp(prefix="spark-")
    assert write_archives(spark.createDataFrame([], schema), empty).count() == 0
    assert read_archives(spark, empty).count() == 0


def test_damaged_segments(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(b"hello world", 4)
    base = lambda i: [("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("X-Page-Id", i), ("WARC-Segment-Number", 1)]
    more = lambda i, n, total=None: [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{i}-{n}>"), ("WARC-Segment-Origin-ID", f"<{i}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
    good = [member(more(1, 3, len(block)), block[60:]), member(base(1), block[:50]), member(more(1, 2), block[50:60])]  # out of order
    gap = [member(base(2), block[:50]), member(more(2, 3, len(block)), block[60:])]
    wrong = [member(base(3), block[:50]), member(more(3, 2, 7), block[50:])]
    cut = [member([("WARC-Type", "response"), ("WARC-Record-ID", "<4>"), ("X-Page-Id", 4)], block[:-9])]
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(b"".join(good + gap))
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(b"".join(wrong + cut))
    assert gzip.open(f"{folder}/a.warc.gz").read(8) == b"WARC/1.1"
    out = {r.page_id: (r.complete, r.payload and bytes(r.payload)) for r in read_archives(spark, folder).collect()}
    assert out == {1: (True, b"hello world"), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_framing():
    for payload in (b"", b"a", b"abc" * 1000, b"\r\n0\r\n\r\n"):
        assert unframed(framed(payload, 7)) == payload
