import numpy as np

from readsieve.llm import tokencount as tc
from readsieve.llm.common import Scratch
from tests.llm.edge import documents, plain


def brute(name, ids, end):
    out, first = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((name, len(out), first, i - first, True))
            first = i + 1
    return [*out, (name, len(out), first, len(ids) - first, False)] if first < len(ids) else out


def test_scan_and_stitch(spark, tmp_path, monkeypatch):
    rng, want = np.random.default_rng(1), []
    monkeypatch.setattr(tc, "GROUP_BLOCKS", 3)
    for k, n in enumerate([0, 1, 6, 7, 8, 100, 300]):
        ids = rng.integers(0, 9 if k < 6 else 60, n).astype("<u2")
        if k == 3:
            ids[:] = 5
        (tmp_path / f"f{k}").write_bytes(ids.tobytes() + b"\x01" * (k == 4))
        want += brute(f"f{k}", ids.tolist(), 5)
    for block in (1, 7, 1000):
        got = [tuple(r) for r in tc.count_tokens(spark, str(tmp_path), end=5, block_tokens=block).collect()]
        assert sorted(got) == sorted(want)
    named = spark.createDataFrame([("f5",), ("f5",)], "file string")
    assert {r.file for r in tc.count_tokens(spark, str(tmp_path), 5, 7, named).collect()} == {"f5"}


def test_wide_ids(spark, tmp_path):
    np.array([70_000, 1, 100_000, 100_000], "<u4").tofile(tmp_path / "f")
    assert [tuple(r)[1:] for r in tc.count_tokens(spark, str(tmp_path), end=100_000).orderBy("ordinal").collect()] == [(0, 0, 2, True), (1, 3, 0, True)]


def test_edges(spark):
    scratch = Scratch(spark, "test")
    folder = scratch.path("files")
    system, root = tc._fs(folder)
    system.create_dir(root, recursive=True)
    written = scratch.table(tc.write_tokens(documents(spark).repartition(3), folder, file_tokens=1000), "written")
    assert written.count() == 13 and "text" not in written.columns
    got = tc.count_tokens(spark, folder, names=written, block_tokens=1 << 14).withColumnsRenamed({"file": "f", "ordinal": "o"})
    counts = {r.doc_id: r.n_tokens for r in written.join(got, (written.file == got.f) & (written.ordinal == got.o)).collect()}
    encode = tc._encoder(tc.tokenizer_path()).encode_ordinary
    assert counts == {r.doc_id: len(encode(r.text or "")) for r in plain(spark).collect()}
    assert tc.count_tokens(spark, scratch.path("none")).count() == 0
