import random
import time

import numpy as np
import pyarrow as pa

from readsieve.llm import substring as ss
from tests.llm.edge import CLASHES, documents, plain


def pieces(text):
    """Words of each sentence or piece, by the rule itself."""
    known = ss._Known()
    sentences, now = [], []
    for line in text.lower().split("\n"):
        for word in line.split():
            now.append(word)
            if word.endswith(ss.MARKS):
                sentences, now = [*sentences, now], []
        sentences, now = [*sentences, now], []
    out = []
    for words in filter(None, sentences):
        order = [known[w] * int(ss.BASES[0]) % 2**64 for w in words]
        ends = {min(range(i, i + ss.PIECE), key=order.__getitem__) for i in range(len(words) - ss.PIECE + 1)} | {len(words) - 1}
        at = 0
        for e in sorted(ends):
            out.append(words[at : e + 1])
            at = e + 1
    return out


def corpus(seed, docs=120):
    """Passages of many lengths, cut from anywhere in running text and put anywhere into others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7)))
    prose = lambda n: [word() + rng.choice(["", "", "", "", "", ",", ".", ".\n", "!"]) for _ in range(n)]
    shared = [prose(rng.choice([20, 35, 51, 52, 60, 90, 200])) for _ in range(25)]
    rows = []
    for i in range(docs):
        words = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            words += rng.choice(shared) + prose(rng.randint(1, 40))
        rows.append((i, " ".join(words)))
    return rows


def windows(rows, n=ss.PASSAGE):
    """By document the places of words in some run of n words that stood before."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        words, hit = text.lower().split(), set()
        for k in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[k : k + n]), (i, k)) != (i, k):
                hit |= set(range(k, k + n))
        out[i] = hit
    return out


def test_pieces_and_runs_by_the_rule():
    for _, text in [*corpus(1, 40), (0, "no end " * 100), (0, "3.14 is. a.b.c\n\n漢字。 次")]:
        want = pieces(text)
        hashes, bounds = ss.cuts(text, ss._Known())
        assert [len(p) for p in want] == np.diff(bounds).tolist() and max(map(len, want), default=0) <= ss.PIECE
        starts, stops, halves = ss.runs(hashes, bounds)
        fits = lambda a, b: b - a >= ss.SENTENCES and sum(map(len, want[a:b])) >= ss.WORDS  # noqa: E731, B023
        brute = [(int(bounds[a]), int(bounds[next(b for b in range(a, len(want) + 1) if fits(a, b))])) for a in range(len(want)) if fits(a, len(want))]
        assert list(zip(starts.tolist(), stops.tolist())) == brute
        words = text.lower().split()
        by_hash = {}
        for a, b, h in zip(starts, stops, halves.T.tolist()):
            assert by_hash.setdefault(tuple(words[a:b]), tuple(h)) == tuple(h)
        assert len(set(by_hash.values())) == len(by_hash)


def spans(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["key", "whole", "text"])
    return pa.Table.from_batches(ss._spans(iter([batch]))).to_pylist()


def test_many_texts_at_once_as_each_alone(monkeypatch):
    texts = [None, "", " \n", *(t for _, t in corpus(2, 60)), "one", None, *(t for _, t in corpus(3, 20))]
    texts += [" ".join(texts[5:9]).swapcase(), "\u3000"]
    alone = [x | {"key": i, "whole": i} for i, t in enumerate(texts) for x in spans([t])]
    for most in (1, 700, 10**6):
        monkeypatch.setattr(ss, "AT_ONCE", most)
        assert spans(texts) == alone
    code = lambda w: (ss._Known()[w] >> 13) % 8
    for x in alone:
        words = texts[x["key"]].lower().split()
        behind, before = words[x["at"] + x["n"] :][: ss.AROUND], words[: x["at"]][::-1][: ss.AROUND]
        assert (x["before"], x["behind"]) == tuple(sum(code(w) << 3 * k for k, w in enumerate(ws)) for ws in (before, behind))


def test_short_texts_cost_little_more_than_as_many_words_in_one():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60_000)]

    def seconds(texts):
        took = []
        for _ in range(3):
            began = time.process_time()
            spans(texts)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds([" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]) < 4 * seconds([" ".join(words)])


def test_every_passage_over_fifty_words_goes_and_little_else(spark):
    rows = corpus(4)
    got = {r.doc_id: r for r in ss.remove_repeats(plain(spark, [(i, t, None) for i, t in rows]).repartition(5)).collect()}
    hits, loose, lost = windows(rows), windows(rows, 45), 0
    for i, text in rows:
        words = text.split()
        left = got[i].text.split()
        must_stay = [w for k, w in enumerate(words) if k not in hits[i]]
        assert len(left) <= len(must_stay)  # all of every passage went
        assert (got[i].n_removed > 0) == (len(left) < len(words))
        if not loose[i]:
            assert left == words and got[i].text == text
        lost += len(must_stay) - len(left)
    removed = sum(map(len, hits.values()))
    assert removed > 3000 and lost < removed / 50


def test_a_passage_is_cut_from_all_but_the_first(spark):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = ". ".join(make(n) for n in (12, 9, 15, 11, 8)) + "."
    rows = [(i, f"{make(7)}. {make(5)} {passage} {make(9)}. {make(4)}.", None) for i in (3, 1, 2)]
    got = {r.doc_id: r.text for r in ss.remove_repeats(plain(spark, rows)).collect()}
    assert got[1] == rows[1][1] and not any(s in got[i] for i in (2, 3) for s in passage.split(". "))
    assert all(rows[k][1].split(". ")[0] in got[i] for k, i in ((0, 3), (2, 2)))


def test_one_id_with_several_texts(spark):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    one, other = make(80), make(80)
    rows = [(1, one, None), (2, f"{make(3)} {one}", None), (2, other, None), (2, other, None)]
    got = sorted((r.doc_id, r.text) for r in ss.remove_repeats(plain(spark, rows)).collect())
    assert got == sorted([(1, one), (2, rows[1][1].rsplit(" ", 80)[0]), (2, other), (2, other)])


def test_a_repeat_within_a_text(spark):
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    p, q = make(70), make(20)
    (row,) = ss.remove_repeats(plain(spark, [(1, f"{p} {q} {p} {p}", None)])).collect()
    assert row.text == f"{p} {q}"


def test_edges(spark):
    got = ss.remove_repeats(documents(spark))
    assert got.count() == 13 and set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "n_removed", *CLASHES}
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[10].n_removed == 0 and rows[None].n_removed == 0
    assert 0 < len(rows[7].text) < 300_200 and rows[7].n_removed > 1000
    assert ss.remove_repeats(plain(spark, [])).count() == 0
