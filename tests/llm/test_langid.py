import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsieve.llm import langid
from readsieve.llm.common import held_out
from tests.llm.edge import CLASHES, documents, plain

DATA = "/root/testdata/sf0.01"


def vector(code, d):
    return np.random.default_rng([langid.SEED, code]).integers(0, 2, d, np.int8).astype(int) * 2 - 1


def brute(text, d):
    """A bundle, gram by gram."""
    out = np.zeros(d)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = [0, *map(ord, word), 0]
        for x, y, z in zip(marked, marked[1:], marked[2:]):
            out += np.roll(vector(x, d), 2) * np.roll(vector(y, d), 1) * vector(z, d)
    return out


def test_bundles_are_those_of_the_definition():
    texts = ["Hello, wörld!", None, "", "a", "1 2 3", "Straße 漢字 x2y"]
    got = langid.Profiler(64).bundle(texts)
    assert np.array_equal(got, [brute(t or "", 64) for t in texts])


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "some words, and more " * 50
    whole = langid.Profiler(64).bundle([text, "b c"])
    monkeypatch.setattr(langid, "BLOCK_CHARS", 100)
    assert np.array_equal(langid.Profiler(64).bundle([text, "b c"]), whole)


def test_held_out_is_crc32(spark):
    ids = list(range(-3, 60))
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_edges(spark):
    got = langid.identify(documents(spark))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(CLASHES) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 13
    for i in (2, 3, 4, 5):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "xx", "de") and 0 <= r.score <= 1 for i, r in rows.items() if i not in (2, 3, 4, 5))
    assert rows[1].lang_pred == "en" and rows[1].held_out == (zlib.crc32(b"1") % 4 == 2)


def test_nothing_to_learn_from(spark):
    rows = langid.identify(plain(spark, [(1, "text", None), (2, "more", None)])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert langid.identify(plain(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    got = langid.op1_language_id(spark, DATA)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"]
    both = got.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    share = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98 and got.count() == 1000
