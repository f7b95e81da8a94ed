import base64
import gzip
import hashlib
import os
import uuid

from pyspark.sql import functions as F

from vintara.llm.warc import archived_pages, read_warc, write_pages

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        revisit = p != first.get(h or "")
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first.get(h or "") if revisit else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a/é", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (9, None, None), (7, "u", ""), (7, "u", ""), (1, "v", "ünï\r\n\r\nWARC/1.1\r\n" * 3), (None, "w", "alone"),
        (None, "w", "<p>x</p>"), (11, "z", "long " * 500_000)]


def test_round_trip(spark):
    got = archived_pages(spark.createDataFrame(ROWS, PAGES).withColumn("record_id", F.lit("clash")))
    rows = got.select("page_id", "payload_length", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(ROWS)
    texts = {(p, (h or "").encode()) for p, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in texts if r.record_type == "response" else not r.payload for r in rows)
    assert archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_pushdown_and_files(spark, tmp_path):
    path = f"file:///tmp/warc-{uuid.uuid4().hex}"
    write_pages(spark.createDataFrame(ROWS, PAGES).repartition(3), path)
    files = [f for f in os.listdir(path[7:]) if f.endswith(".gz")]
    assert sum(gzip.open(f"{path[7:]}/{f}").read().startswith(b"WARC/1.1\r\n") for f in files) == len(files) >= 1
    only = read_warc(spark, path, payload="false", partition_bytes="1").where("record_type = 'revisit' AND target_uri IN ('u', 'z', 'w')")
    assert sorted((r.record_id, r.payload or None) for r in only.collect()) == [("<urn:page:>", None)]
    assert read_warc(spark, path).where("record_type = 'response'").count() == sum(r[3] == "response" for r in brute(ROWS))
    assert read_warc(spark, path, partition_bytes="1").rdd.getNumPartitions() == len(files)
