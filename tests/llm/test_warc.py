import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from readsieve.llm import warc
from readsieve.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, k string, d string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d") for r in rows], SCHEMA)


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(body) >= 1000 and i is not None and i != max(same)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, "x" * 999), (4, "http://d/", "x" * 999), (5, "u", None), (6, "u", ""), (7, "http://é/", "é" * 500 + "\r\n\r\nWARC/1.1\r\n"), (8, "u", "é" * 500 + "\r\n\r\nWARC/1.1\r\n"), (None, "n", "y"), (9, "u", "z" * 200_000), (-3, "u", "z" * 200_000), (9, "u", "z" * 200_000)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    warc.register(spark)
    scratch = Scratch(spark, "test")
    warc.page_records(pages(spark, ROWS).repartition(3), scratch).write.format("warc").option("compression", compression).option("filebytes", "5000").mode("append").save(scratch.path("x"))
    assert sorted((tuple(r) for r in warc.read_pages(spark, scratch.path("x")).collect()), key=str) == expected(ROWS)


def test_empty(spark):
    warc.register(spark)
    scratch = Scratch(spark, "test")
    warc.page_records(pages(spark, []), scratch).write.format("warc").mode("append").save(scratch.path("x"))
    assert warc.read_pages(spark, scratch.path("x")).count() == 0


def foreign(compress):
    """An archive of another writer: no skip lengths, folded headers, base 32 digests, other types."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    made = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    return b"".join(map(gzip.compress, made)) if compress else b"".join(made)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("payload", [True, False])
def test_other_writers(compress, payload):
    rows = list(warc.records(io.BytesIO(foreign(compress)), payload=payload))
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response", "metadata"]
    assert rows[1]["target_uri"] == "http://a/ b" and rows[1]["payload"] == (b"HTTP/1.1 200 OK\r\n\r\nhello" if payload else None)
    assert warc.hex_digest(rows[1]["payload_digest"]) == hashlib.sha1(b"HTTP/1.1 200 OK\r\n\r\nhello").hexdigest()
    only = list(warc.records(io.BytesIO(foreign(compress)), wanted=lambda r: r["warc_type"] == "metadata"))
    assert [r["payload"] for r in only] == [b""]


def test_several_records_in_one_member():
    plain = foreign(False) + warc.member([("WARC-Type", "resource")], b"z" * 3_000_000, False) + foreign(False)
    for blob in (gzip.compress(plain), gzip.compress(plain) + foreign(True) + b"", gzip.compress(foreign(False)) * 2):
        rows = list(warc.records(io.BytesIO(blob)))
        want = list(warc.records(io.BytesIO(gzip.decompress(blob))))
        assert len(rows) >= 6 and rows == want
        assert [r["warc_type"] for r in warc.records(io.BytesIO(blob), wanted=lambda r: r["warc_type"] != "resource", payload=False)] == [r["warc_type"] for r in want if r["warc_type"] != "resource"]


def test_truncation_and_garbage_are_errors():
    blob = gzip.compress(foreign(False))
    for bad in (blob[:-12], blob + b"garbage behind the last member", gzip.compress(foreign(False)[:-20]), gzip.compress(foreign(False)[:150]), foreign(False)[:-70]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))


def test_members_are_gzip_and_can_be_skipped():
    blob = b"".join(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{i}>")], bytes([65 + i]) * (3_000_000 if i == 1 else 10), True) for i in range(4))
    assert gzip.decompress(blob).count(b"WARC/1.1") == 4

    class Counting(io.BytesIO):
        seeks = 0

        def seek(self, *a):
            Counting.seeks += 1
            return super().seek(*a)

    rows = list(warc.records(Counting(blob), wanted=lambda r: r["record_id"] != "<urn:x:1>"))
    assert [r["payload"][:1] for r in rows] == [b"A", b"C", b"D"]
    plain = b"".join(warc.member([("WARC-Type", "resource")], b"p" * n, False) for n in (5, 3_000_000, 7))
    kept = list(warc.records(Counting(plain), wanted=lambda r: r["content_length"] < 10))
    assert [len(r["payload"]) for r in kept] == [5, 7] and Counting.seeks > 0


def test_predicates_are_pushed(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc").write_bytes(foreign(False))
    (tmp_path / "b.warc.gz").write_bytes(foreign(True))
    (tmp_path / "notes.txt").write_text("no archive")
    df = spark.read.format("warc").load(str(tmp_path))
    assert df.count() == 6 and df.where("target_uri is null").count() == 4
    for condition, n in (("warc_type = 'response'", 2), ("warc_type in ('response', 'metadata')", 4), ("content_length > 2", 4), ("target_uri like 'http://a%'", 2), ("not warc_type = 'response'", 4), ("target_uri is not null and warc_type = 'warcinfo'", 0), ("record_id <=> null", 2)):
        assert df.where(condition).count() == n, condition
    assert df.where("warc_type = 'response'").select(F.octet_length("payload").alias("n")).first().n == 24
    plan = lambda c: df.where(c)._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan("warc_type = 'response'") and " Filter " in plan("length(warc_type) = 8")
