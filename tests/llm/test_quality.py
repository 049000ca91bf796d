import os

import numpy as np
import pytest

from readsieve.llm import quality as q
from tests.llm.edge import documents, plain

DATA = "/root/testdata/sf0.1"


def test_features_do_not_depend_on_blocks(monkeypatch):
    texts = ["Some text, with Words!! and 123.", None, "", "é" * 50 + "###", "a", "x y " * 100]
    whole = q.features(texts, 64)
    assert whole[1].sum() == whole[2].sum() == 0 and whole[0, :64].sum() == len(texts[0]) - 2
    alone = np.concatenate([q.features([t], 64) for t in texts])
    assert np.array_equal(whole, alone)
    monkeypatch.setattr(q, "BLOCK_CHARS", 60)
    assert np.array_equal(q.features(texts, 64)[:, :64], whole[:, :64])  # byte trigrams across the cuts count once


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (40, 32)).astype(np.float32)
    labels = rng.integers(0, 2, 40)
    model = q.fit_rows(counts, labels, np.full(40, 1 / 40), latent=8)
    got = model.score(counts[:5], neighbours=7)
    vectors = model.latent(counts[:5])
    for v, s in zip(vectors, got, strict=True):
        cos = np.array([float(v @ w) for w in model.vectors])
        near = np.argsort(-cos)[:7]
        votes = np.exp((cos[near] - 1) / q.TEMPERATURE) * (cos[near] > 0) / 40
        assert abs(votes @ labels[near] / votes.sum() - s) < 1e-4


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int")


def test_edges(spark):
    model = q.train(plain(spark), labels(spark, [(1, 1), (8, 1), (10, 0), (5, 0), (2, 1), (99, 1), (7, None), (None, 1), (6, 3)]), buckets=64)
    got = q.predict(documents(spark), model)
    rows = got.collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= q.THRESHOLD) for r in rows)
    assert q.predict(plain(spark, []), model).count() == 0


def test_no_labels(spark):
    model = q.train(plain(spark), labels(spark, []), buckets=64)
    assert {r.score for r in q.predict(plain(spark), model).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_labels(spark):
    got = q.op3_quality(spark, DATA)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    r = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    order = r.score.rank().to_numpy()
    y = r.quality.to_numpy()
    n = y.sum()
    assert (order[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n) > 0.98
    assert (r.predicted == r.quality).mean() > 0.97


def test_repeated_ids_count_once(spark, monkeypatch):
    """However often a labelled id occurs in documents, the driver gets a row for each sampled label."""
    docs = plain(spark, [(1, f"text number {i % 7}", None) for i in range(300)] + [(i, f"other text {i}", None) for i in range(2, 9)]).repartition(5)
    seen = []
    monkeypatch.setattr(q, "fit_rows", lambda counts, labels, weights, **_: seen.append((len(counts), labels.tolist())))
    q.train(docs, labels(spark, [(i, i % 2) for i in range(1, 9)]))
    assert [(n, sorted(y)) for n, y in seen] == [(8, [0] * 4 + [1] * 4)]
