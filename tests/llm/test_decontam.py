import hashlib
import random
import re

import pytest

from readsieve.llm import decontam as dc
from tests.llm.edge import documents, plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    """Hit words and items, window by window."""
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(doc), sorted(hit), sorted(found)


def spread(spans):
    return [i for a, b in spans for i in range(a, b)]


@pytest.mark.parametrize("seed", range(4))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = "abc"[: rng.randint(1, 3)]
        items = [(k, " ".join(rng.choices(letters, k=rng.randint(0, 9)))) for k in range(rng.randint(0, 6))]
        automaton = dc.Automaton([(k, dc.words(t)) for k, t in items], window=4)
        for _ in range(6):
            text = " ".join(rng.choices(letters + "z", k=rng.randint(0, 25)))
            spans, found = automaton.search(dc.words(text))
            n, hit, named = brute(text, items, 4)
            assert (spread(spans), sorted(found)) == (hit, named), (items, text)
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_words():
    text = "Ab-c1 \x00ÀÉ_x y É9\x7fz😀q İ"
    assert [w.decode() for w in dc.words(text)] == words(text)
    assert dc.words(None) == dc.words("") == []


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, ""), (4, None), (10, "Short ITEM"), (5, "... !!")]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard", [dc.SHARD_BYTES, 40])
def test_digest(spark, shard):
    rows = [(1, "x " + ITEMS[0][1] + " y short item", None), (2, "short items", None), (3, "a SHORT-item " + "w " * 37, None), (4, "b short item " + "w " * 38, None), (5, None, None), (6, "", None)]
    df = dc.digest(dc.search(plain(spark, rows), benchmark(spark), shard_bytes=shard))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}
    sha = lambda *ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert got == {1: (18, 16, 3, sha(1, 2, 10), True), 2: (2, 0, 0, sha(), False), 3: (40, 2, 2, sha(2, 10), True), 4: (41, 2, 2, sha(2, 10), False), 5: (0, 0, 0, sha(), False), 6: (0, 0, 0, sha(), False)}


@pytest.mark.parametrize("held", [0, dc.HELD_BYTES])
def test_several_shards_with_null_repeated_and_clashing_keys(spark, monkeypatch, held):
    monkeypatch.setattr(dc, "HELD_BYTES", held)
    items = [(1, "red green blue"), (2, "one two"), (3, "green blue black"), (3, "two three"), (None, "never asked for")]
    rows = [(7, "a red green blue black z", None), (7, "one two three", None), (None, "red green blue one two three", None), (7, "one two three", None), (8, "never asked for", None)]
    df = dc.search(plain(spark, rows).repartition(1), benchmark(spark, items), shard_bytes=5)
    assert len(list(dc.shards(benchmark(spark, items), "item_id", "text", 5))) > 1
    got = sorted((r.text, spread([(s.first, s.end) for s in r.hits]), r["items"], r.n_words) for r in df.collect())
    want = sorted((t, hit, found, n) for t in (t for _, t, _ in rows) for n, hit, found in [brute(t, items[:-1])])
    assert got == want


def test_removal(spark):
    rows = [(1, "Keep this. Short, item! and " + "more " * 60, None), (2, "short item here", None), (3, None, None), (4, "clean", None)]
    got = {r.doc_id: r.text for r in dc.remove_spans(plain(spark, rows), benchmark(spark)).collect()}
    assert got == {1: "Keep this. ! and " + "more " * 60, 3: None, 4: "clean"}


def test_edges(spark):
    df = dc.digest(dc.search(documents(spark), benchmark(spark)))
    assert df.count() == 13 and df.where("contaminated").count() == 0
    assert dc.search(plain(spark, []), benchmark(spark)).count() == 0
    none = dc.digest(dc.search(plain(spark), benchmark(spark, [])))
    assert none.where("n_hit > 0").count() == 0 and none.where("doc_id = 7").first().n_words == 60_003
    assert dc.remove_spans(documents(spark), benchmark(spark)).count() == 13
