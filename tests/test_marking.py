"""Marking against a sequential model on random ends, and hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from readsieve.operators import annotate as A
from readsieve.operators import duplicates as D
from readsieve.operators import metrics as M
from readsieve.operators import optical as O
from readsieve.operators.ends import derive_ends
from readsieve.operators.pairs import build_pairs
from readsieve.plans.marking import Options, mark_duplicates
from tests.model import mark

ENDS = "idx long, qname string, first_of_pair boolean, tid int, coord int, rev boolean, score int, mate_tid int, has_mate boolean, tile int, x int, y int"
READS = "idx long, qname string, flag int, tid int, pos int, mapq int, cigar string, mtid int, mpos int, tlen int, seq string, qual string, tags array<string>, rg string"


def run(spark, ends, distance=100):
    df = spark.createDataFrame(ends, ENDS)
    members = D.pair_members(build_pairs(df))
    found = A.verdicts(D.pair_duplicates(members), D.frag_duplicates(df), O.optical_duplicates(members, distance)).collect()
    assert len({r.idx for r in found}) == len(found)
    return {r.idx: (r.set_rep, r.set_size) for r in found}, {r.idx for r in found if r.is_optical}


def end(idx, name, coord, rev=False, score=100, mate=0, first=None, tid=0, at=(1, 0, 0)):
    return (idx, name, idx % 2 == 0 if first is None else first, tid, coord, rev, score, mate, mate != -1, *at)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_ends_match_the_model(spark, seed):
    rng = random.Random(seed)
    rows, idx = [], 0
    for k in range(900):
        tile, x, y = rng.choice([-1, 1, 1, 2]), rng.randrange(0, 500, 20), rng.randrange(0, 300, 20)
        kind, coord = rng.random(), rng.randrange(12)
        copies = 1 if kind < 0.2 else 3 if kind > 0.97 else 2
        for c in range(copies):
            rows.append([idx, f"q{k}", rng.random() < 0.5, rng.randrange(2), coord + c * rng.randrange(2), rng.random() < 0.4, rng.randrange(4), -1 if copies == 1 and rng.random() < 0.7 else 0, True, tile, x, y])
            rows[-1][8] = rows[-1][7] != -1
            idx += 1
    names = [f.split()[0] for f in ENDS.split(", ")]
    want = mark([dict(zip(names, r, strict=True)) for r in rows])
    rng.shuffle(rows)
    got = run(spark, [tuple(r) for r in rows])
    assert got == want
    assert want[1] and len(want[0]) > 100


def test_orientation_of_ends_at_one_place(spark):
    rows = [end(0, "a", 10, True), end(1, "a", 10, False), end(2, "b", 10, False), end(3, "b", 10, True)]
    assert run(spark, rows)[0] == {2: (0, 2), 3: (0, 2)}


def test_swapped_ends_group_with_ordered_ones(spark):
    rows = [end(0, "a", 50, True, 90), end(1, "a", 10), end(2, "b", 10), end(3, "b", 50, True)]
    assert run(spark, rows)[0] == {1: (2, 2), 0: (2, 2)}


def test_ties_keep_the_earlier_pair_and_negative_scores_work(spark):
    rows = [end(0, "a", 1, score=-9), end(1, "a", 5, score=-9), end(2, "b", 1, score=-9), end(3, "b", 5, score=-9)]
    assert run(spark, rows)[0] == {2: (0, 2), 3: (0, 2)}


def test_missing_mate_counts_as_paired_and_is_never_marked(spark):
    rows = [end(0, "a", 7), end(2, "b", 7, mate=-1)]
    assert run(spark, rows)[0] == {2: (None, None)}


def test_third_occurrence_of_a_name_waits_for_a_fourth(spark):
    df = spark.createDataFrame([end(i, "a", i) for i in (3, 1, 2)], ENDS)
    assert [(r.idx1, r.idx2, r.slot) for r in build_pairs(df).collect()] == [(1, 2, 0)]


def test_keeper_in_the_other_list_still_flags_pairs_near_it(spark):
    # three pairs of one group; the best is READ1-reversed, the two others are near it but not near each other
    rows = []
    for k, (x, score, first) in enumerate([(100, 200, False), (20, 100, True), (180, 100, True)]):
        rows += [end(2 * k, f"q{k}", 1, score=score, first=first, at=(1, x, 0)), end(2 * k + 1, f"q{k}", 9, True, score, first=not first, at=(1, x, 0))]
    assert run(spark, rows)[1] == {2, 3, 4, 5}


def test_chains_of_four_are_one_component(spark):
    rows = [e for k in range(5) for e in (end(2 * k, f"q{k}", 1, at=(1, 90 * k, 0), score=50 + (k == 4)), end(2 * k + 1, f"q{k}", 9, True, at=(1, 90 * k, 0)))]
    assert run(spark, rows)[1] == {0, 1, 2, 3, 4, 5, 6, 7}


def test_tile_minus_one_is_never_optical(spark):
    rows = [e for k in range(4) for e in (end(2 * k, f"q{k}", 1, at=(-1, 0, 0)), end(2 * k + 1, f"q{k}", 9, True, at=(-1, 0, 0)))]
    assert run(spark, rows)[1] == set()


def read(idx, name, flag, pos, cigar="4M", qual="IIII", tags=(), mtid=0):
    return (idx, name, flag, 0, pos, 60, cigar, mtid, 0, 0, "ACGT", qual, list(tags), None)


def job(spark, rows, **options):
    return mark_duplicates(spark.createDataFrame(rows, READS), Options(**options))


FRAGS = [read(0, "I:1:F:1:1:5:5", 0, 10, tags=["DT:Z:SQ", "XX:i:1", "DI:i:9"]), read(1, "I:2:F:1:1:5:5", 0, 12, "2S2M", "!!!!", ["PG:Z:old"]), read(2, "I:2:F:1:1:5:5", 256, 10), read(3, "I:3:F:1:1:5:5", 4 + 1024, -1, "*")]


def test_reads_with_one_five_prime_end_and_their_tags(spark):
    marked = job(spark, FRAGS)
    got = {r.idx: (r.flag, r.tags) for r in marked.reads.collect()}
    assert got == {0: (0, ["XX:i:1", "DI:i:9", "PG:Z:readsieve"]), 1: (1024, ["DT:Z:LB", "PG:Z:readsieve"]), 2: (256, ["PG:Z:readsieve"]), 3: (4, ["PG:Z:readsieve"])}
    row = marked.metrics().first().asDict()
    assert (row["unpaired_reads_examined"], row["unpaired_read_duplicates"], row["secondary_or_supplementary_rds"], row["unmapped_reads"], row["estimated_library_size"]) == (2, 1, 1, 1, 0)
    assert row["percent_duplication"] == 0.5


def test_removal_keeps_metrics(spark):
    marked = job(spark, FRAGS, remove_duplicates=True, tagging_policy="DontTag", program=None)
    assert sorted(r.idx for r in marked.reads.collect()) == [0, 2, 3]
    assert marked.metrics().first().unpaired_read_duplicates == 1


def pairs(names, **more):
    rows = []
    for k, name in enumerate(names):
        rows += [read(2 * k, name, 99, 10, qual="I" * 4 if k == 0 else "5555"), read(2 * k + 1, name, 147, 40)]
    return rows


def test_set_tags_and_optical(spark):
    rows = pairs(["I:1:F:1:1:100:100", "I:1:F:1:1:150:150", "I:1:F:1:1:900:100"])
    got = {r.idx: r.tags for r in job(spark, rows, tag_set_members=True, program=None).reads.collect()}
    assert got[0] == ["DI:i:0", "DS:i:3"] and got[2] == ["DT:Z:SQ", "DI:i:0", "DS:i:3"] and got[5] == ["DT:Z:LB", "DI:i:0", "DS:i:3"]


@pytest.mark.parametrize(("names", "options", "optical"), [(["a:1:100:100", "a:1:100:101"], {}, 0), (["I:1:F:1:1:5:5", "I:1:F:1:1:6:6"], {"name_pattern": "null"}, 0), (["I:1:F:1:1:5:5", "I:1:F:1:1:6:6"], {}, 2), (["x_1_5_5", "x_1_6_6"], {"name_pattern": r"x_(\d+)_(\d+)_(\d+)"}, 2), (["a:1:1:1:5:5", "a:1:1:1:5:6"], {}, 0), (["I:1:F:1:1:5:5", "I:1:F:1:1:65541:5"], {}, 2), (["I:1:F:1:1:5:5", "I:1:F:1:1:65541:5"], {"wrap_int16": False}, 0)])
def test_names_decide_on_optical(spark, names, options, optical):
    assert job(spark, pairs(names), **options).reads.where("is_optical").count() == optical


def test_strategies_and_the_discount(spark):
    rows = [read(0, "I:1:F:1:1:5:5", 512, 10), read(1, "I:2:F:1:1:5:5", 0, 10, qual="####")]
    assert [r.idx for r in job(spark, rows).reads.where("is_dup").collect()] == [0]
    for strategy in ("TOTAL_MAPPED_REFERENCE_LENGTH", "RANDOM"):
        assert job(spark, rows, strategy=strategy).reads.where("is_dup").count() == 1
    with pytest.raises(ValueError):
        job(spark, rows, strategy="BEST")


def test_libraries_can_be_kept_apart(spark):
    rows = [(*read(i, f"I:{i}:F:1:1:5:5", 0, 10)[:-1], lib) for i, lib in enumerate(["a", "a", "b"])]
    assert job(spark, rows).reads.where("is_dup").count() == 2
    assert job(spark, rows, library_column="rg").reads.where("is_dup").count() == 1


def test_reads_without_a_group_are_a_library(spark):
    """Equal reads, some with a group and some without: each lot keeps one, single ends and pairs alike."""
    rows = [(*read(i, f"I:{i}:F:1:1:5:5", 0, 10)[:-1], lib) for i, lib in enumerate([None, None, None, "a", "a"])]
    assert job(spark, rows, library_column="rg").reads.where("is_dup").count() == 3
    both = [(*r[:-1], None) for r in pairs([f"I:1:F:1:1:{50 * k}:100" for k in range(5)])]
    alone, kept = (job(spark, both, **options).reads.where("is_dup").count() for options in ({}, {"library_column": "rg"}))
    assert alone == kept == 8


def test_missing_qualities_count_as_255(spark):
    df = spark.createDataFrame([read(0, "a", 0, 1, qual="*"), read(1, "b", 0, 1, qual="!I0/")], READS)
    assert [r.score for r in derive_ends(df).orderBy("idx").collect()] == [1020, 40 + 15]


def test_empty_input(spark):
    marked = job(spark, [])
    assert marked.reads.count() == 0
    row = marked.metrics().first()
    assert row.read_pairs_examined == 0 and row.percent_duplication == 0 and row.estimated_library_size == 0
    assert {r.coverage_mult for r in marked.roi().collect()} == {None}
    assert "BIN CoverageMult" in M.report(marked.metrics(), marked.roi(), ["x"])


def test_library_size():
    assert M.library_size(10_000, 8_000) == 21_541
    for unique in (10, 500, 9_990, 9_999):  # the equation holds at the result
        size = M.library_size(10_000, unique)
        assert abs(size * -math.expm1(-10_000 / size) - unique) < 1
    assert M.library_size(0, 0) == M.library_size(5, 5) == M.library_size(5, 0) == 0


def test_result_does_not_depend_on_partitions(spark):
    rows = pairs([f"I:1:F:1:1:{50 * (k % 7)}:100" for k in range(20)])
    one, many = spark.createDataFrame(rows, READS).coalesce(1), spark.createDataFrame(rows, READS).repartition(7, F.rand(3))
    a, b = ({(r.idx, r.is_optical) for r in mark_duplicates(x).verdicts.collect()} for x in (one, many))
    assert a == b and len(a) == 38
