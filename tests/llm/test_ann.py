import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsieve.llm import ann

DATA = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", k int, e string").select("*") if rows and len(rows[0]) > 2 else spark.createDataFrame(rows, SCHEMA)


def brute(rows, queries, nearest=10):
    out = []
    for q, v in queries:
        found = sorted({(float(np.sqrt(((np.array(w, np.float32).astype(float) - np.array(v, np.float32).astype(float)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v)})
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(found[:nearest])]
    return sorted(out)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]
    rows = [r for r in rows if any(r[1])] + [(200 + i, [1.0, 1.0, 1.0]) for i in range(30)] + [(300, [1.0, 2.0]), (301, [2.0, 2.0])]
    queries = rows[::7] + [(300, [1.0, 2.0])]
    got = ann.nearest_neighbours(table(spark, rows), table(spark, queries))
    rounded = lambda found: sorted((q, k, i, round(s, 9)) for q, k, i, s in found)
    assert rounded(tuple(r) for r in got.collect()) == rounded(brute(rows, queries))


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    got = ann.nearest_neighbours(table(spark, rows), table(spark, rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 7), (7, 1, 0)]
    assert ann.nearest_neighbours(table(spark, []), table(spark, rows)).count() == 0
    assert ann.nearest_neighbours(table(spark, rows), table(spark, [])).count() == 0


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    queries = rows[::50]
    got = {}
    for r in ann.nearest_neighbours(table(spark, rows), table(spark, queries), shard_rows=800).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {}
    for q, _, i, _ in brute(rows, queries):
        want.setdefault(q, set()).add(i)
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.95


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [5, 5]], np.float32)
    graph = ann.Graph(x, degree=3)
    kept = graph._prune(np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]], np.int32))
    assert kept[0].tolist()[:2] == [1, 3] and 2 not in kept[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark):
    got = ann.op4_ann(spark, DATA)
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    assert got.count() == 200


def test_repeated_rows_and_clashing_columns(spark):
    """A row that most of the table repeats is one candidate; columns with the operator's own names play no part."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(40)]
    many = rows + [rows[3]] * 3000 + [(50 + i, rows[3][1]) for i in range(40)]
    df = table(spark, [(i, v, -1, "x") for i, v in many])
    for name in ("h", "ks", "r", "shard", "asks", "rank", "score", "query_id"):
        df = df.withColumn(name, F.lit("clash"))
    got = ann.nearest_neighbours(df.repartition(6), df.where("vec_id in (3, 7, 60)").drop("rank"))
    wanted = [(i, v) for i, v in rows + [(50 + i, rows[3][1]) for i in range(40)]]
    rounded = lambda found: sorted((q, k, i, round(s, 9)) for q, k, i, s in found)
    assert rounded(tuple(r) for r in got.collect()) == rounded(brute(wanted, [r for r in wanted if r[0] in (3, 7, 60)]))


def test_shards_stay_few(spark, monkeypatch):
    """Beyond SHARDS shards they grow instead of their number, and the answers stay."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(300)]
    monkeypatch.setattr(ann, "SHARDS", 2)
    got = ann.nearest_neighbours(table(spark, rows), table(spark, rows[::50]), shard_rows=10)
    rounded = lambda found: sorted((q, k, i, round(s, 9)) for q, k, i, s in found)
    have, want = rounded(tuple(r) for r in got.collect()), rounded(brute(rows, rows[::50]))
    assert len(have) == len(want) and len(set(have) & set(want)) >= 0.95 * len(want)
