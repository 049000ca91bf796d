"""What a stage's queries ask of the driver at once."""

import pytest

from readsieve import scratch as sc
from readsieve.llm import linededup as ld
from readsieve.llm import nearcopies as nc
from tests.llm.edge import plain


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def exchanges(monkeypatch):
    """Shuffles that the plan of each written table begins with, by name."""
    found, table = {}, sc.Scratch.table

    def counted(self, df, name):
        found[name] = shuffles(df)
        return table(self, df, name)

    monkeypatch.setattr(sc.Scratch, "table", counted)
    return found


def texts(spark):
    words = " ".join(f"w{i}" for i in range(200))
    return plain(spark, [(i, f"{words} {i}\n{words} x{i // 2}\nline {i % 5}", None) for i in range(90)])


def test_lines_in_small_queries(spark, exchanges):
    cut = ld.remove_lines(texts(spark))
    assert {"met", "gone"} <= set(exchanges)
    assert shuffles(cut) <= 2
    assert cut.where("n_removed > 0").count() > 80


def test_near_copies_in_small_queries(spark, exchanges):
    kept = nc.deduplicate(texts(spark))
    assert {"paired", "linked", "paired-anew", "found-0"} <= set(exchanges)
    assert exchanges["pairs"] <= 8
    assert kept.count() == 1


def test_key_of_a_region_stands_once(spark):
    rows = spark.createDataFrame([(0, 0, "x" * 40)], "id long, k long, region string")
    assert ld._cut(rows)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") <= 2  # either side of the join


def test_tables_collect_the_drivers_garbage(spark, monkeypatch):
    beans = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    scratch, before = sc.Scratch(spark, "test"), full()
    monkeypatch.setattr(sc, "HEAP", 0.0)
    assert sorted(r.id for r in scratch.table(spark.range(50).repartition(7), "kept").collect()) == list(range(50))
    assert full() > before
