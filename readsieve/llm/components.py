"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round points nodes at smaller neighbours with grouped minima and joins, and before it every task contracts its own links, a
bounded number, to stars; nothing is collected. Rounds grow with the square of the logarithm of the nodes. Each round's links
are a written table, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve.llm.common import Scratch


#: Links that one task contracts at most, about, as they are dealt out evenly: some 200 MB of memory. Its result, if no other task has links, is final.
LOCAL_LINKS = 1_000_000


def _same(column: Column) -> Column:
    """The value, hidden from the planner: the join on it shuffles both sides, so that AQE can split a hot key."""
    return F.bitwise_not(F.bitwise_not(column))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as stars around the smallest node of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([root(x) for x in part], pa.int64())})


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(_same(F.col("u")).alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    other = least.select(_same(F.col("u")).alias("w"), "m")
    moved = links.join(other, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) for every node of links (u long, v long), component being the smallest node reachable.

    Direction, repeats and self-links don't matter; links with a null end are none. No links give no rows."""
    start = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    now, k = scratch.table(start, f"{name}-0"), 0
    size, before = now.count(), None
    while True:
        tasks = max(1, -(-size // LOCAL_LINKS))
        now, k = scratch.table(now.repartition(tasks).mapInArrow(_contract, "u long, v long"), f"{name}-{k + 1}"), k + 1
        scratch.drop(f"{name}-{k - 1}")
        if tasks == 1:  # one task has seen all links
            break
        shrunk, size = size, now.count()
        if size * 2 < shrunk:
            continue
        now, k = scratch.table(_small_star(_large_star(now)), f"{name}-{k + 1}"), k + 1
        scratch.drop(f"{name}-{k - 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, size = mark, mark[0]
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
