"""Seekable bundles and records: round trips, single frames, revisits, odd rows."""

import hashlib
import os

import pytest
import zstandard
from pyspark.sql import types as T

from evigraph.llm import warc
from evigraph.llm.common import put_file, workdir

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_bundle_round_trip(tmp_path):
    records = [os.urandom(k * 7 % 900) for k in range(300)]
    w = warc.BundleWriter(frame_bytes=4096)
    places = [w.add(r) for r in records]
    uri = f"{tmp_path}/a.warc.zst"
    put_file(uri, w.finished())
    r = warc.BundleReader(uri)
    assert len(r.table) > 20
    assert [r.record(*p) for p in reversed(places)] == records[::-1]
    raw = open(uri, "rb").read()
    at, packed, unpacked = r.table[5]
    assert len(zstandard.ZstdDecompressor().decompress(raw[at : at + packed])) == unpacked  # a frame stands alone
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as s:
        assert s.read() == b"".join(records)
    with pytest.raises(ValueError, match="seek"):
        put_file(f"{tmp_path}/b", [b"x" * 50])
        warc.BundleReader(f"{tmp_path}/b")


def test_record():
    raw = warc.record("urn:x:5", "http://é/ x\r\nEvil: 1", b"pay\r\n\r\nload", "d", None)
    head, http, payload = warc.parsed(raw)
    assert payload == b"pay\r\n\r\nload" and head["WARC-Type"] == "response" and "Evil" not in head and http["Content-Length"] == "11"
    head, http, payload = warc.parsed(warc.record("urn:x:6", None, b"pay", "d", 5))
    assert payload == b"" and head["WARC-Refers-To"].endswith(":5>") and http["Content-Length"] == "3"
    with pytest.raises(ValueError):
        warc.parsed(raw + b"x")


def test_rows(spark):
    big, small = "x" * 100, "y" * 99
    rows = [(5, "u", big), (3, "u", big), (9, None, big), (3, "u", big), (None, "u", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (7, "é", "é" * 50), (8, "é", "é" * 50), (10, "u", "z" * 3_000_000)]
    got = warc.archive_and_read(spark.createDataFrame(rows, PAGES).selectExpr("*", "html as payload", "url as digest", "page_id as first")).collect()
    first = {big: 3, "é" * 50: 7}
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        refers = first[h] if h in first and p is not None and p > first[h] else None
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_small_bundles(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 50)) for k in range(500)]
    where = workdir(spark, "warc-test")
    index = warc.write_bundles(warc.marked(spark.createDataFrame(rows, PAGES)), where, frame_bytes=2000, bundle_bytes=1500)
    assert index.select("bundle").distinct().count() > 4
    assert warc.read_records(index).where("record_type = 'response'").count() + warc.read_records(index).where("record_type = 'revisit'").count() == 500


def test_identifiers_are_a_map(spark):
    rows = [(3, "u", "x" * 200), (3, "v", "x" * 200), (3, "w", "other"), (None, "n", "a"), (None, "n", "a"), (4, "r", "x" * 200), (5, "s", "alone")]
    index = warc.write_bundles(warc.marked(spark.createDataFrame(rows, PAGES)), workdir(spark, "warc-ids"))
    ids = [r["record_id"] for r in index.collect()]
    assert len(set(ids)) == len(rows) and {"urn:evigraph:page:3", "urn:evigraph:page:4", "urn:evigraph:page:5"} <= set(ids)
    for r in warc.find_records(index, ids).collect():
        assert warc.parsed(bytes(r["raw"]))[0]["WARC-Record-ID"] == f"<{r['record_id']}>"
    revisit = warc.parsed(bytes(warc.find_records(index, ["urn:evigraph:page:4"]).first()["raw"]))[0]
    assert revisit["WARC-Type"] == "revisit" and revisit["WARC-Refers-To"] == "<urn:evigraph:page:3>"
    assert warc.find_records(index, ["urn:evigraph:page:99"]).count() == 0
