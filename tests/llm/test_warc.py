import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from skein.llm.warc import assemble, pages_through_warc, parse_records, read_records, write_warc

ROWS = [(1, "http://a.example/x?q=1#f", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://b.example", "same"), (3, "u\r\nEvil: 1", "same"), (4, None, None), (5, "http://c", ""), (6, "http://d", "x" * 200_000), (9, "http://r", "twice"), (9, "http://r", "twice"), (None, "http://n", "none"), (7, "http://e", "same"), (8, "http://f", "none")]
ROWS += [(100 + i, f"http://h/{i}", "hot page") for i in range(300)]


def brute(rows):
    out, leads = [], {}
    for i, _, h in rows:
        p = h or ""
        leads[p] = min(leads.get(p, (True, 0)), (i is None, i or 0))
    done = set()
    for i, _, h in rows:
        p = h or ""
        lead = leads[p] == (i is None, i or 0) and p not in done
        if lead:
            done.add(p)
        b = p.encode()
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if lead else "revisit", None if lead else leads[p][1]))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    assert sorted(map(tuple, pages_through_warc(df).collect()), key=str) == brute(ROWS)
    assert pages_through_warc(df.limit(0)).collect() == []


def test_archives_are_valid_and_captures_nest(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:7], "page_id long, url string, html string").coalesce(1)
    write_warc(df, f"file://{tmp_path}/w", captures_per_file=2)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 4
    kinds = [f["warc-type"] for p in files for f, _ in parse_records(gzip.decompress(p.read_bytes()))]
    assert kinds.count("request") == kinds.count("metadata") == 7 and kinds.count("response") == 5
    rows = assemble(read_records(spark, f"file://{tmp_path}/w")).collect()
    got = {r.metadata.page_id: r for r in rows}
    assert got[1].response.payload == ROWS[0][2].encode() and got[1].request.target_uri == ROWS[0][1]
    assert got[3].response.record_type == "revisit" and got[3].response.refers_to == got[2].capture_id
    assert "Evil" not in [k for p in files for f, _ in parse_records(gzip.decompress(p.read_bytes())) for k in f]


def test_foreign_archives(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\n\r\nhi"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:0>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(head + block + b"\r\n\r\n"))
    (tmp_path / "b.warc").write_bytes(head.replace(b"x:1", b"x:2") + block + b"\r\n\r\n")
    [a, b] = sorted(assemble(read_records(spark, f"file://{tmp_path}")).collect())
    assert a.response.payload == b.response.payload == b"hi" and a.request is None and a.metadata is None
    with pytest.raises(ValueError):
        list(parse_records(head + b"HT"))
