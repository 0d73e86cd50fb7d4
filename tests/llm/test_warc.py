import base64
import hashlib

import numpy as np
import pytest

from stratalake.llm import warc
from stratalake.llm.common import scratch

MAGIC = "WARC/1.1\r\n"


def rows():
    nasty = [(0, ""), (1, "a"), (2, "a"), (3, MAGIC + "Content-Length: 5\r\n\r\nhello\r\n\r\n" + MAGIC), (4, "x" * 5000 + MAGIC + "WARC-Type: response\r\nContent-Length: 100\r\n\r\n" + "y" * 3000 + MAGIC * 800), (5, None), (6, "é\r\n\r\n"), (7, "WARC/1.1"), (8, "\r\n"), (9, "\r\n" + MAGIC)]
    return nasty + [(100 + i, "q%d" % (i % 150) * (i % 97) + (MAGIC + "Content-Length: %d\r\n\r\n" % i) * (i % 5)) for i in range(300)] + [(100, "")]


def expected(given):
    by = {}
    for i, h in given:
        by.setdefault((h or "").encode(), []).append(i)
    out = []
    for payload, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max(ids)
        for k, i in enumerate(sorted(ids, reverse=True)):
            out.append((i, len(payload), digest, "revisit" if k else "response", first if k else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_over_many_splits(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "BLOCK", 1 << 12)
    src = f"file://{tmp_path}/pages"
    spark.createDataFrame([(i, "u\r\nx", h, "e") for i, h in rows()], "page_id long, url string, html string, uid string").repartition(4).write.parquet(src)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"file://{tmp_path}/warc"
        warc.write_archives(spark.read.parquet(src), path, compression)
        got = warc.read_archives(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows())
    assert all(r.sound for r in got)


def test_query_and_empty(spark, folder):
    given = [(1, "x"), (2, "x"), (3, None), (3, None), (4, "é" * 100_000)]
    df = spark.createDataFrame([(i, None, h) for i, h in given], "page_id long, url string, html string")
    got = warc.query(spark, folder(pages=df)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(given)
    assert warc.query(spark, folder(pages=df.limit(0))).count() == 0


def test_pointer_jumping():
    offs = np.array([0, 5, 10, 14, 20, 31, 40], np.int64)
    succs = np.array([10, 14, 20, 20, 40, 33, 55], np.int64)
    assert warc.follow(offs, succs, 0) == [0, 2, 4, 6]
    assert warc.exits(offs, succs, 30).tolist()[:5] == [40, 40, 40, 40, 40]
    assert warc.follow(offs, succs, 3) == []
    assert warc.parse_head(b"A: b\r\nContent-Length: 3\r\n\r\nabc") == (27, {b"a": b"b", b"content-length": b"3"})
    assert warc.parse_head(b"no header") is None and warc.parse_head(b"Content-Length: x\r\n\r\n") is None
    assert scratch is not None
