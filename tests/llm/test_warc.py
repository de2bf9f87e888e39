from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter

from edge_data import rows_of
from tidemark.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    first = {}
    for key, html in rows:
        p = (html or "").encode()
        first[p] = max(first.get(p, -1), -1 if key is None else key)
    out, used = [], set()
    for key, html in rows:
        p = (html or "").encode()
        top = None if first[p] == -1 else first[p]
        response = len(p) < least or (key == top and p not in used)
        if len(p) >= least and response:
            used.add(p)
        out.append((key, len(p), digest(p), "response" if response else "revisit", None if response else top))
    return Counter(out)


ROWS = [(1, "same"), (2, "same"), (3, "same"), (4, ""), (5, None), (6, "été\r\n\r\nWARC/1.1\r\n"), (7, "x" * 200_000),
        (8, "only"), (3, "same"), (None, "same"), (None, "alone"), (None, "alone"), (9, "only")]


def pages(spark, rows):
    return spark.createDataFrame(
        [(k, None if i % 4 == 0 else f"http://a/{i}\n", h, "r", 1) for i, (k, h) in enumerate(rows)],
        "page_id long, url string, html string, header string, rid int")


def test_equals_brute_force(spark):
    for least in (0, 5):
        assert Counter(rows_of(warc.archive_pages(pages(spark, ROWS), least))) == plain(ROWS, least)


def test_whole_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = plain([(r.page_id, r.html) for r in given.collect()])
    assert Counter(rows_of(warc.archive_pages(given))) == expected


def test_payloads_once_and_records_whole(spark, tmp_path):
    warc.write_pages(pages(spark, ROWS), str(tmp_path))
    stored = rows_of(spark.read.parquet(f"{tmp_path}/payloads").select("address", "payload"))
    assert Counter(bytes(p) for _, p in stored) == Counter({(h or "").encode() for _, h in ROWS})
    assert all(hashlib.sha256(p).hexdigest() == a for a, p in stored)
    whole = rows_of(warc.bodies(spark, str(tmp_path)))
    assert len(whole) == len(ROWS) and all(v for _, v in whole)
    for record, _ in whole:
        ((header, block),) = warc.split_records(bytes(record))
        assert header + block + b"\r\n\r\n" == bytes(record)


def test_files_round_trip(spark, tmp_path):
    made = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello",
        b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 25\r\n\r\n"
        b"HTTP/1.1 200 OK\r\n\r\n\x00\xff\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello",
        b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n",
    ]
    made = [m + b"\r\n\r\n" for m in made]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "in/b.warc").write_bytes(made[1])
    warc.store(warc.records_of(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    back = Counter(bytes(r) for r, v in rows_of(warc.bodies(spark, str(tmp_path / "out"))) if v)
    assert back == Counter(made + [made[1]])


def test_a_changed_payload_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    warc.write_pages(pages(spark, ROWS), str(tmp_path))
    changed = spark.read.parquet(f"{tmp_path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).collect()
    spark.createDataFrame(changed, "address string, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/payloads")
    try:
        warc.read_pages(spark, str(tmp_path)).collect()
    except Exception as error:
        assert "does not have its digest" in str(error)
    else:
        raise AssertionError


def test_empty(spark):
    assert rows_of(warc.archive_pages(pages(spark, []))) == []
