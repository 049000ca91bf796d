import random

import pytest
from pyspark.sql import functions as F

from readsieve.llm import linededup as ld
from tests.llm.edge import CLASHES, documents, plain


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, edits):
    """Texts after dropping each line with an earlier one within the edits."""
    lines = [(i, n, raw.strip(ld.SPACE)) for i, t in sorted(rows) for n, raw in enumerate(t.split("\n"))]
    gone, seen = set(), []
    for i, n, line in lines:
        if not line:
            continue
        if any(line == s or (edits and within_one(line, s)) for s in seen):
            gone.add((i, n))
        seen.append(line)
    return {i: ("\n".join(raw for n, raw in enumerate(t.split("\n")) if (i, n) not in gone), sum(x == i for x, _ in gone)) for i, t in rows}


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab é", k=rng.choice([1, 2, 3, 5, 8, 14, 15, 16, 17, 23, 24, 25, 31, 32, 33, 80]))) for _ in range(40)]

    def changed(line):
        i = rng.randrange(len(line) + 1)
        return rng.choice([line, line[:i] + rng.choice("abcé") + line[i:], line[:i] + line[i + 1 :], line[:i] + "z" + line[i + 1 :], "  " + line + "\t"])

    return [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(70)]


def long_lines(seed):
    """Some of thousands of characters, with edits at every place and runs of one character."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab", k=k)) for k in (700, 2047, 2048, 2049, 2303, 5000)] + ["a" * 900, "a" * 901, "ab" * 1000]
    rows = []
    for i in range(60):
        line = rng.choice(base)
        at = rng.choice([0, len(line), rng.randrange(len(line))])
        rows.append((i, rng.choice([line, line[:at] + "c" + line[at:], line[:at] + line[at + 1 :], line[:at] + "c" + line[at + 1 :], line[:at] + "cc" + line[at:]])))
    return rows


@pytest.mark.parametrize(("seed", "edits"), [(1, 1), (2, 1), (3, 0)])
def test_against_brute_force(spark, seed, edits):
    rows = corpus(seed)
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.remove_lines(plain(spark, [(i, t, None) for i, t in rows]).repartition(4), edits=edits).collect()}
    assert got == brute(rows, edits)
    assert sum(n for _, n in got.values()) > 20


def test_long_lines_against_brute_force(spark, monkeypatch):
    rows = long_lines(4)
    monkeypatch.setattr(ld, "NARROW", 24)
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.remove_lines(plain(spark, [(i, t, None) for i, t in rows]).repartition(4)).collect()}
    assert got == brute(rows, 1)
    assert 10 < sum(n for _, n in got.values()) < 55


def test_work_grows_with_the_length_of_a_line(spark):
    """Variants are of regions of bounded length: of two lines of 120,000 characters that differ in one some hundreds, not 30,000."""
    a = "".join(random.Random(5).choices("abcdefgh ", k=120_000))
    docs = plain(spark, [(1, a, None), (2, a[:70_000] + "Z" + a[70_001:], None), (3, a[::-1], None)])
    lines = ld._lines(ld._rows(docs, "doc_id", "text"))
    rows = lines.select(F.col("key").alias("id"), F.lit(0).cast("long").alias("k"), F.col("line").alias("region"))
    for _ in range(3):
        rows = ld._cut(rows)
    assert 2 <= ld._variants(rows).count() <= 16 * (ld.NARROW + ld.BAND)
    assert {r.doc_id: r.n_removed for r in ld.remove_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_many_lines_around_one(spark):
    rows = [(i, f"This is page number {i % 10} of the very same report") for i in range(200)]
    got = {r.doc_id: r.n_removed for r in ld.remove_lines(plain(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == {i: int(i > 0) for i in range(200)}


def test_other_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        ld.remove_lines(plain(spark), edits=2)


def test_edges(spark):
    got = ld.remove_lines(documents(spark))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", *CLASHES}
    assert rows[2][0].text is None and rows[2][0].n_lines == 0 and rows[3][0].text == "" and rows[4][0].text == " \n\t \n"
    assert [r.text for r in rows[8]] == ["", ""] and rows[8][0].n_removed == 2 and rows[1][0].n_removed == 0
    assert (rows[10][0].text, rows[10][0].n_removed) == ("The same long line again and again.", 4)
    assert sum(map(len, rows.values())) == 13 and ld.remove_lines(plain(spark, [])).count() == 0
