"""The stream gives the batch job's pairs and, for closed groups, its duplicates."""

from readsieve.operators import duplicates as D
from readsieve.operators.ends import derive_ends
from readsieve.operators.pairs import build_pairs
from readsieve.streaming.incremental import PAIR, stream_pair_duplicates, stream_pairs
from tests.test_marking import READS

NAMES = [f.split()[0] for f in PAIR.split(", ")]


def reads(n):
    rows = []
    for k in range(n):
        pos = 10 * (k // 3)
        name = f"I:{k}:F:1:1:{k}:5"
        rows += [(2 * k, name, 99, 0, pos, 60, "4M", 0, pos + 30, 0, "ACGT", "IIII" if k % 3 else "5555", [], None), (2 * k + 1, name, 147, 0, pos + 30, 60, "4M", 0, pos, 0, "ACGT", "IIII", [], None)]
    return sorted(rows, key=lambda r: (r[4], r[0]))


def drained(df, name, spark):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_pairs_across_batches(spark, tmp_path):
    rows = reads(40)
    for k in range(4):  # mates fall into different files, hence batches
        spark.createDataFrame(rows[20 * k : 20 * k + 20], READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], READS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(stream_pairs(stream), "pairs", spark)
    batch = build_pairs(derive_ends(spark.createDataFrame(rows, READS)))
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == sorted(tuple(r) for r in batch.select(*NAMES).collect())


def test_groups_close_behind_the_watermark(spark, tmp_path):
    pairs = build_pairs(derive_ends(spark.createDataFrame(reads(30), READS))).select(*NAMES)
    rows = sorted(pairs.collect(), key=lambda r: r.coord1)
    end = [("z", 0, 100_000 + k, 10_000 + 2 * k, 0, 100_000 + k, 10_001 + 2 * k, 3, 3, 1, -1, 0, 0) for k in range(3)]
    for part in (rows[:17], rows[17:], end[:1], end[1:2], end[2:]):
        spark.createDataFrame([tuple(r) for r in part], PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(stream_pair_duplicates(stream, slack=100), "dups", spark)
    want = D.pair_duplicates(D.pair_members(pairs))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert want.count() == 40


def test_ends_on_two_references_do_not_move_the_watermark_too_far(spark, tmp_path):
    far = ("a", 0, 200_000_000, 0, 5, 1_000, 1, 3, 3, 1, -1, 0, 0)
    later = [("b", 5, 2_000, 2, 5, 2_300, 3, 3, 3, 9, -1, 0, 0), ("c", 5, 2_000, 4, 5, 2_300, 5, 3, 3, 1, -1, 0, 0)]
    end = [("z", 5, 300_000_000 + k, 10_000 + 2 * k, 5, 300_000_000 + k, 10_001 + 2 * k, 3, 3, 1, -1, 0, 0) for k in range(3)]
    schema = spark.createDataFrame([], PAIR).schema
    for part in ([far], later[:1], later[1:], end[:1], end[1:2], end[2:]):
        spark.createDataFrame(part, PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(stream_pair_duplicates(stream, slack=100), "two_references", spark)
    assert sorted(tuple(r) for r in got.collect()) == [(4, 2, 2), (5, 2, 2)]
