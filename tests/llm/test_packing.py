import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from readsieve.llm import packing as pk
from tests.llm.edge import TEXTS, documents, plain


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 8)))
        counts, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 5)
        chosen = pk.plan(lengths, counts, k)
        pad = lambda edges: sum((min(e for e in edges if e >= n) - n) * c for n, c in zip(lengths, counts, strict=True))
        best = min(pad((*cut, lengths[-1])) for r in range(min(k, len(lengths))) for cut in itertools.combinations(lengths[:-1], r))
        assert chosen.padding == best == pad(chosen.boundaries) and sum(chosen.documents) == sum(counts) and len(chosen.boundaries) <= k
    assert pk.plan([], []).boundaries == []


def quadratic(lengths, counts, buckets):
    """Least padding, by trying every cut before every length."""
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[i] + sum((lengths[j] - n) * c for n, c in zip(lengths[i : j + 1], counts[i : j + 1])) for i in range(j + 1)) for j in range(len(lengths))]
    return best[-1]


def test_boundaries_are_optimal_for_long_documents():
    rng = random.Random(3)
    for _ in range(6):
        lengths = sorted(rng.sample(range(20_000), 60))
        counts, k = [rng.randint(1, 1000) for _ in lengths], rng.randint(1, 9)
        assert pk.plan(lengths, counts, k).padding == quadratic(lengths, counts, k)


def test_many_lengths_take_no_square_of_steps():
    rng = random.Random(4)
    lengths = sorted(rng.sample(range(10_000_000), 100_000))
    chosen = pk.plan(lengths, [rng.randint(1, 50) for _ in lengths], 16)
    assert len(chosen.boundaries) == 16 and chosen.boundaries[-1] == lengths[-1]


def verify(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch_id].append(r)
    assert sorted(batches) == list(range(len(batches)))
    partial = defaultdict(int)
    for found in batches.values():
        (size,) = {r.bucket_tokens for r in found}
        (bucket,) = {r.bucket for r in found}
        full = max(1, budget // max(1, size))
        assert sorted(r.slot for r in found) == list(range(len(found))) and len(found) <= full and max(r.n_tokens for r in found) <= size
        partial[bucket] += len(found) < full
    assert all(n <= 1 for n in partial.values())


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([3, 3, 3, 3, 7, 50, 400, 5000]), None) for i in range(700)] + [(5, "again", None)] * 30
    got = pk.pack(plain(spark, rows).repartition(5), budget=1000, buckets=4, slice_rows=40).collect()
    assert len(got) == 730 and {r.doc_id: r.n_tokens for r in got if r.doc_id != 5} == {i: len(t.split()) for i, t, _ in rows if i != 5}
    verify(got, 1000)
    again = pk.pack(plain(spark, rows).repartition(2), budget=1000, buckets=4, slice_rows=40).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_one_bucket_with_most_rows_is_spread(spark):
    got = pk.pack(plain(spark, [(i, "a b", None) for i in range(1000)]), budget=64, slice_rows=100).collect()
    assert len({r.batch_id for r in got}) == 32
    verify(got, 64)


def test_equal_rows_are_spread(spark):
    """A key, or none, that most rows have."""
    rows = [(None, "a b c", None)] * 700 + [(1, "a b c", None)] * 500 + [(i, "a b", None) for i in range(2, 100)]
    got = pk.pack(plain(spark, rows).repartition(3), budget=60, slice_rows=30).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 700 and sum(r.doc_id == 1 for r in got) == 500
    verify(got, 60)


def test_word_count(spark):
    texts = ["", None, " a\tb\n", "\x0b\x0cx", "a b c", "one"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(pk.word_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\t-\r ]+", t or "")) for t in texts]


def test_edges(spark):
    got = pk.pack(documents(spark)).collect()
    assert len(got) == len(TEXTS) and next(r for r in got if r.doc_id == 2).n_tokens == 0
    verify(got, pk.BUDGET)
    assert pk.pack(plain(spark, [])).count() == 0
    given = pk.pack(plain(spark), n_tokens=F.col("n_chars"))
    assert given.agg(F.max("n_tokens")).first()[0] == max(len(t or "") for _, t, _ in TEXTS)
