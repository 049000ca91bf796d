"""Packing into length buckets of least padding.

The histogram of all lengths goes to the driver: its distinct lengths, which number no more than the square root of twice all tokens.
Dynamic programming over it picks the bucket boundaries for which padding every document to its bucket's longest costs fewest
tokens; best cuts move with the end of the bucket, so each row of it takes n log n steps. Inside a bucket a batch takes as many
documents as the token budget allows at that length. Documents are numbered within a bucket by a
two-level count, of slices and within slices, so a bucket that holds most documents is still many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readsieve.llm.common import Scratch

BUCKETS, BUDGET = 16, 32_768
SLICE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and empty texts have none."""
    trimmed = F.regexp_replace(text, r"^[\t-\r ]+|[\t-\r ]+$", "")
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, r"[\t-\r ]+"))).cast("long")


@dataclass
class Plan:
    """Upper boundaries, ascending, and documents of each bucket."""

    boundaries: list[int]
    documents: list[int]
    padding: int


def _row(before: np.ndarray, edge: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j, the least before[i] + edge[j - 1] * (ahead[j] - ahead[i]) over i < j, and its first i.

    That i never falls as j grows. So the middle j of a range tells the ranges of i for both halves; all ranges of a depth are done at once."""
    n = len(edge)
    least, first = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    low, high, bottom, top = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(low):
        mid = (low + high) // 2
        sizes = np.minimum(top, mid - 1) - bottom + 1
        offsets = np.cumsum(sizes) - sizes
        i = np.arange(int(sizes.sum())) + np.repeat(bottom - offsets, sizes)
        options = before[i] + np.repeat(edge[mid - 1], sizes) * (np.repeat(ahead[mid], sizes) - ahead[i])
        least[mid] = np.minimum.reduceat(options, offsets)
        best = np.flatnonzero(options == np.repeat(least[mid], sizes))
        first[mid] = i[best[np.searchsorted(best, offsets)]]
        low, high, bottom, top = np.concatenate([low, mid + 1]), np.concatenate([mid - 1, high]), np.concatenate([bottom, first[mid]]), np.concatenate([first[mid], top])
        some = low <= high
        low, high, bottom, top = low[some], high[some], bottom[some], top[some]
    return least, first


def plan(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> Plan:
    """Of ascending distinct lengths and their documents, the consecutive groups of least padding. Ties go to the earlier cut. Fewer
    lengths than buckets give a bucket each."""
    n = len(lengths)
    if not n:
        return Plan([], [], 0)
    edge, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
    ahead = np.concatenate([[0], np.cumsum(counts)])
    cost = np.concatenate([[0], edge * ahead[1:]])  # of the first j lengths in one bucket
    cuts = []
    for _ in range(1, min(buckets, n)):
        cost, cut = _row(cost, edge, ahead)
        cuts.append(cut.astype(np.int32))
    boundaries, documents, j = [], [], n
    while j:
        i = int(cuts.pop()[j]) if cuts else 0
        boundaries.append(int(edge[j - 1]))
        documents.append(int(ahead[j] - ahead[i]))
        j = i
    return Plan(boundaries[::-1], documents[::-1], int(cost[n] - (edge * counts).sum()))


def pack(docs: DataFrame, n_tokens: Column | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row a document: its key, ``n_tokens``, ``bucket`` from 0, ``bucket_tokens``, the length it is padded to, ``batch_id``, from 0
    and running through the buckets, and ``slot``, its place in the batch.

    A batch of a bucket holds max(1, budget // bucket_tokens) documents (bucket_tokens 0 counts as 1); only a bucket's last batch may
    hold fewer. Lengths are words unless ``n_tokens`` gives another; null lengths are 0. Null keys and repeated rows are
    documents like others; which of equal (key, length) rows comes first makes no difference. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "packing")
    length = word_count(F.col(text)) if n_tokens is None else n_tokens.cast("long")
    # equal rows are one with a count, dealt out in chunks: so neither they nor a bucket that holds most rows meet in one task
    rows = docs.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).alias("n_tokens")).groupBy("key", "n_tokens").agg(F.count("*").alias("rows"))
    rows = scratch.table(rows, "lengths")
    found = rows.groupBy("n_tokens").agg(F.sum("rows").alias("n")).orderBy("n_tokens").toArrow()
    chosen = plan(found.column(0).to_numpy(), found.column(1).to_numpy(), buckets)
    each = [max(1, budget // max(1, b)) for b in chosen.boundaries]
    batches = [-(-n // e) for n, e in zip(chosen.documents, each, strict=True)]
    ahead = np.concatenate([[0], np.cumsum(batches)]).astype(int).tolist()
    slices = max(1, -(-sum(chosen.documents) // slice_rows))

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [0]]), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in chosen.boundaries[:-1]]).cast("array<bigint>"), lambda b: b < F.col("n_tokens")))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / slice_rows)))).withColumn("n", F.least(F.col("rows") - F.col("chunk") * slice_rows, F.lit(slice_rows)))
    chunks = chunks.withColumn("bucket", bucket).withColumn("mixed", F.xxhash64("key", "n_tokens", "chunk")).withColumn("slice", F.pmod("mixed", F.lit(slices)))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("bucket", "slice").agg(F.sum("n").alias("n"))
    starts = scratch.table(sizes.select(F.col("bucket").alias("b"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("bucket", "slice").orderBy("mixed", "key", "n_tokens", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    numbered = chunks.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, (F.col("bucket") == F.col("b")) & (F.col("slice") == F.col("s")))
    numbered = numbered.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1)))
    place = F.col("start") + F.col("rank")
    per = of(each)
    return numbered.select(F.col("key").alias(key), "n_tokens", F.col("bucket").cast("int").alias("bucket"), of(chosen.boundaries).alias("bucket_tokens"), (of(ahead[:-1] or [0]) + F.floor(place / per)).cast("long").alias("batch_id"), (place % per).cast("int").alias("slot"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
