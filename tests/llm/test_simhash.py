import random
import re

import numpy as np
import xxhash

from readsieve.llm import components as cc
from readsieve.llm import simhash as sh
from readsieve.llm.common import Scratch
from tests.llm.edge import documents, plain


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints():
    for text in ["", None, "a", "a b", "A b C", "one two three four " * 30, "é x y\x0bz w", " lead  trail "]:
        assert sh.fingerprint(text) == fingerprint(text)


def test_thresholds_by_dynamic_programming():
    rng = random.Random(1)
    for _ in range(100):
        costs = [[0, *sorted(rng.randrange(100) for _ in range(3))] for _ in range(rng.randint(2, 4))]
        best, chosen = sh.allocate(costs, 3)
        every = [()]
        for c in costs:
            every = [(*x, k) for x in every for k in range(len(c))]
        assert best == min(sum(c[k] for c, k in zip(costs, x, strict=True)) for x in every if sum(x) == 3)
        assert sum(t + 1 for t in chosen) == 3 and best == sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))


def test_bits_are_dealt_once():
    both = np.random.default_rng(0).integers(0, 50, (64, 64))
    both = both + both.T + np.diag(np.full(64, 100))
    for m in (2, 3, 4):
        groups = sh.group_bits(both, 400, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1


def linked(spark, values, monkeypatch, paired):
    monkeypatch.setattr(sh, "PAIRED", paired)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "fp long, first long")
    scratch = Scratch(spark, "test")
    nodes = scratch.table(nodes, "nodes")
    got = sh.near_links(nodes, scratch).collect()
    index = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    return [(index[r.u], index[r.v]) for r in got]


def test_links_lose_nothing(spark, monkeypatch):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9])):
            centre ^= 1 << rng.randrange(64) if rng.random() < 0.5 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(centre)
    values = sorted(values)
    far = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2}
    chosen = sh.plan
    forced = [(list(range(20)), 1), (list(range(20, 64)), 0)]
    for paired, plan in ((1_000, chosen), (1, chosen), (1_000, lambda *a: forced), (1, lambda *a: forced)):  # by pairs; by one-bit neighbours
        monkeypatch.setattr(sh, "plan", plan)
        links = linked(spark, values, monkeypatch, paired)
        assert all((values[i] ^ values[j]).bit_count() <= 2 for i, j in links)
        assert classes(range(len(values)), links) == classes(range(len(values)), far)


def test_components_of_random_graphs(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)]
    df = spark.createDataFrame([*links, (None, 4), (7, 7)], "u long, v long").repartition(6)
    want = classes({x for e in links for x in e if e[0] != e[1]}, links)
    for most in (1_000_000, 30):
        monkeypatch.setattr(cc, "LOCAL_LINKS", most)
        got = cc.connected_components(df, Scratch(spark, "test")).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert cc.connected_components(df.where("u < -1"), Scratch(spark, "test")).count() == 0


def test_edges(spark):
    df = documents(spark)
    got = {}
    for r in sh.components(df).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint_bits, r.component_id))
    assert got[2] == got[3] == got[4] == {(0, 2)}
    assert {c for _, c in got[8]} == {1} and len(got) == 12
    kept = [r.doc_id for r in sh.deduplicate(df).collect()]
    assert sorted(kept, key=lambda i: (i is not None, i or 0)) == [None, -5, 1, 2, 5, 6, 7, 9, 10]
    assert sh.components(plain(spark, [])).count() == 0 and sh.deduplicate(plain(spark, [])).count() == 0
