"""Round trip of pages through archives and chunks."""

import hashlib
import io

import pytest
from pulsepanel.llm import warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, digest_so_far string, archive int"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = hashlib.sha1(body).hexdigest()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        top = max(same, default=None)
        again = len(body) >= 1000 and top is not None and i != top
        out.append((i, len(body), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 20_000
    rows = [(1, "http://a/ b?é", long), (2, None, long), (3, "u\r\nX: y", "short"), (4, "v", "short"),
            (5, "v", None), (6, "v", ""), (7, "v", "x" * 999), (8, "v", "x" * 999), (9, "v", "y" * 1000),
            (10, "v", "y" * 1000), (10, "v", "y" * 1000), (None, "v", "y" * 1000), (None, "v", "\r\n"),
            (-5, "v", long)]
    got = warc.page_records(pages(spark, *rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_chunks_carry_running_digests(spark, tmp_path):
    body = "".join(chr(97 + i % 26) for i in range(10_000))
    manifest = warc.write_warc(pages(spark, (1, "u", body), (2, "u", "")), str(tmp_path))
    rows = sorted(warc.read_chunks(manifest, 1024).collect(), key=lambda r: (r.page_key, r.chunk_no))
    first = [r for r in rows if r.page_key == "1"]
    assert [len(r.chunk) for r in first] == [1024] * 9 + [10_000 - 9 * 1024]
    for n, r in enumerate(first):
        assert r.digest_so_far == hashlib.sha1(body[:1024 * (n + 1)].encode()).hexdigest()
        assert r.last == (n == 9)
    assert [(r.chunk, r.last) for r in rows if r.page_key == "2"] == [(b"", True)]


def test_archives_roll_over(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 600) for i in range(20)]
    manifest = warc.write_warc(pages(spark, *rows).coalesce(1), str(tmp_path), archive_bytes=4000)
    assert manifest.count() > 5
    assert manifest.agg(F.sum("records")).first()[0] == 20
    assert warc.read_chunks(manifest).where("last").count() == 20


def test_broken_record_is_an_error():
    head = warc.record_head("response", "r", "u", "d", 50, "1", None)
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(head + b"short")))


def test_empty(spark):
    assert warc.page_records(pages(spark).limit(0)).count() == 0
