"""SAM and BAM: coercions, order, round trips."""

import gzip
import os

import pytest

from readsieve.plans.marking import mark_duplicates
from readsieve.sources import bam, read_alignments, sam, write_alignments
from readsieve.sources.header import Header

HEADER = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c1\tLN:1000", "@SQ\tSN:c2\tLN:500", "@RG\tID:lane1\tLB:lib", "@CO\tsays @SQ in a comment"]
BODY = [
    "r1\t99\tc1\t5\t40\t2S4M\t=\t33\t10\tACTGAC\t()()!!\tNM:i:1\tRG:Z:lane1\tXA:A:q\tXB:B:s,1,-2\tXF:f:1.5",
    "r1\t147\tc1\t33\t37\t4M1D2M\t=\t5\t-10\tACTGAC\t*",
    "r2\t73\tc2\t21\t40\t3M\t*\t0\t5\tGGG\t&&1",
    "r3\t0\tc1\t0\t40\t3M\t*\t0\t5\tGGG\t&&1",
    "r4\t0\tnowhere\t7\t40\t3M\tc2\t0\t5\tGGG\t&&1",
    "r5\t0\tc1\t9\t40\t*\t*\t0\t5\t*\t*",
    "r6\t4\t*\t0\t0\t*\t*\t0\t0\tNAC\tIII",
]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in.sam").write_text("".join(f"{x}\n" for x in HEADER + BODY))
    return str(tmp_path / "in.sam")


def rows(df):
    return [r.asDict() for r in df.orderBy("idx").collect()]


def test_coercions(spark, path):
    df, header = read_alignments(spark, path)
    got = rows(df)
    assert header.references == [("c1", 1000), ("c2", 500)] and header.library == "lane1" and header.lines == HEADER
    assert [r["idx"] for r in got] == list(range(7))
    assert [(r["flag"], r["tid"], r["pos"], r["mtid"], r["mpos"]) for r in got] == [(99, 0, 4, 0, 32), (147, 0, 32, 0, 4), (73, 1, 20, -1, -1), (4, -1, -1, -1, -1), (4, -1, 6, -1, -1), (4, 0, 8, -1, -1), (4, -1, -1, -1, -1)]
    assert got[0]["rg"] == "lane1" and got[0]["tags"][0] == "NM:i:1" and got[1]["rg"] is None and got[1]["tags"] == []


def test_many_splits_keep_file_order(spark, tmp_path):
    path = tmp_path / "big.sam"
    path.write_text("".join(f"{x}\n" for x in HEADER) + "".join(f"q{i}\t0\tc1\t{i + 1}\t9\t3M\t*\t0\t0\tGGG\tIII\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df, _ = read_alignments(spark, str(path))
        assert df.select("idx", "qname").rdd.getNumPartitions() > 3
        assert [(r.idx, r.qname) for r in df.orderBy("idx").collect()] == [(i, f"q{i}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sam_round_trip_is_textual(spark, path, tmp_path):
    df, header = read_alignments(spark, path)
    write_alignments(df.repartition(3), header, str(tmp_path / "out.sam"))
    parts = sorted(p for p in os.listdir(tmp_path / "out.sam") if p.startswith("part-"))
    text = "".join((tmp_path / "out.sam" / p).read_text() for p in parts).splitlines()
    want = [x.split("\t") for x in BODY]
    want[3][1:3], want[4][1:3], want[5][1] = ["4", "*"], ["4", "*"], "4"
    want[4][6] = "*"
    assert text[:5] == HEADER and [x.split("\t") for x in text[5:]] == want


def test_gzip_is_told_by_its_bytes(spark, path, tmp_path):
    packed = tmp_path / "x.sam.gz"
    packed.write_bytes(gzip.compress(open(path, "rb").read()))
    assert rows(read_alignments(spark, str(packed))[0]) == rows(read_alignments(spark, path)[0])


def test_bam_round_trip(spark, path, tmp_path):
    df, header = read_alignments(spark, path)
    names = bam.write_bam(df.repartition(3), header, str(tmp_path / "parts"))
    whole = tmp_path / "named.anything"
    whole.write_bytes(b"".join((tmp_path / "parts" / n).read_bytes() for n in names))
    assert gzip.decompress(whole.read_bytes())[:4] == b"BAM\1"
    again, other = read_alignments(spark, str(whole))
    assert rows(again) == rows(df) and other.lines == header.lines
    assert {r.tid: (r.mapped, r.unmapped) for r in bam.count_placed(again).collect()} == {0: (2, 1), 1: (1, 0), -1: (0, 3)}


def test_large_records_cross_blocks(spark, tmp_path):
    rows_ = [(i, "n", 0, 0, i, 9, "70000M", -1, -1, 0, "ACGT" * 17_500, "I" * 70_000, ["XZ:Z:" + "z" * 999], None) for i in range(3)]
    df = spark.createDataFrame(rows_, bam.SCHEMA)
    header = Header(HEADER)
    names = bam.write_bam(df, header, str(tmp_path / "p"))
    (tmp_path / "w.bam").write_bytes(b"".join((tmp_path / "p" / n).read_bytes() for n in names))
    assert rows(read_alignments(spark, str(tmp_path / "w.bam"))[0]) == rows(df)


def test_marks_a_file(spark, path):
    df, header = sam.read_sam(spark, path)
    marked = mark_duplicates(df)
    assert marked.reads.count() == 7 and marked.metrics().first().read_pairs_examined == 1


def test_program_lines_get_free_names():
    h = Header(HEADER).with_program("p", "1", "a\tb").with_program("p", "1", "c")
    assert h.lines[-2:] == ["@PG\tID:p\tVN:1\tCL:a b", "@PG\tID:p.1\tVN:1\tCL:c"]


def test_no_library_is_an_empty_string():
    assert Header(["@HD\tVN:1.6"]).library == ""
