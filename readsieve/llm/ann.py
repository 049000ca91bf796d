"""Approximate nearest neighbours with robust-pruned directed graphs, one a shard (after Subramanya et al., 2019).

Equal vectors are one node. Nodes are dealt to shards of bounded size by hash, few enough that sending every query to every shard costs less than
the vectors themselves until shards are as large as memory allows; each shard starts from random edges and inserts its
nodes in batches: a greedy beam search from the shard's centre proposes neighbours, and pruning keeps a candidate unless a kept one is
closer to it by a factor than the node is; edges also run back. Queries stream through every shard by beam search, and the
best of all shards are merged. Vectors are searched in single precision; distances returned are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readsieve.llm.common import Scratch

#: Nodes of a shard; where that would make more shards than SHARDS, as many more as fit into SHARD_BYTES of vectors and edges.
SHARD_ROWS, SHARDS, SHARD_BYTES = 8_192, 64, 256 << 20
DEGREE, ALPHA = 28, 1.2
BUILD_BEAM, QUERY_BEAM = 48, 96
BATCH, STEP, NEAREST = 256, 4, 10
SEED = 11


class Graph:
    """A directed graph over the rows of a float32 matrix; edges[i] holds neighbours of i, then -1."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = SEED):
        self.x, self.alpha, self.degree = np.ascontiguousarray(vectors, np.float32), alpha, degree
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree + degree // 2), -1, np.int32)  # some room before a node is pruned again
        centre = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))) if n else 0
        self.entries = np.unique(np.append(rng.permutation(n)[:8], centre))[:n] if n else np.zeros(0, np.int64)
        if n <= beam:
            self.entries = np.arange(n)
            return
        for k in range(min(degree // 2, n - 1)):
            self.edges[:, k] = (np.arange(n) + 1 + (np.arange(n) * 7919 + k * 104_729 + rng.integers(n)) % (n - 1)) % n
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            self._insert(order[at : at + BATCH], beam)

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        _, _, met = self.search(self.x[nodes], beam, path=True)
        proposed = np.concatenate([met, self.edges[nodes]], axis=1)
        kept = self._prune(nodes, proposed)
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = kept
        source, target = np.repeat(nodes, self.degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, starts, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(starts, counts)
        back = np.full((len(ends), counts.max(initial=0)), -1, np.int32)
        back[np.repeat(np.arange(len(ends)), counts), rank] = source
        back[(back[:, :, None] == self.edges[ends][:, None, :]).any(2)] = -1
        have, new = (self.edges[ends] >= 0).sum(1), (back >= 0).sum(1)
        room = have + new <= self.edges.shape[1]
        row, col = np.nonzero((back >= 0) & room[:, None])
        place = have[row] + np.cumsum(back >= 0, axis=1)[row, col] - 1
        self.edges[ends[row], place] = back[row, col]
        full = np.flatnonzero(~room)
        for at in range(0, len(full), BATCH):
            part = full[at : at + BATCH]
            again = self._prune(ends[part], np.concatenate([self.edges[ends[part]], back[part]], axis=1))
            self.edges[ends[part]] = -1
            self.edges[ends[part], : self.degree] = again

    def _prune(self, nodes: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Nearest candidate first; it stays, and those it is closer to, by the factor alpha, than the node go."""
        proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), axis=1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        there = proposed >= 0
        width = max(int(there.sum(1).max(initial=0)), 1)
        proposed = np.take_along_axis(proposed, np.argsort(~there, axis=1, kind="stable")[:, :width], 1)
        there = proposed >= 0
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for at in range(0, len(nodes), 64):
            ids, rows = proposed[at : at + 64], nodes[at : at + 64]
            points = self.x[ids]
            norms = (points**2).sum(2)
            own = ((points - self.x[rows][:, None, :]) ** 2).sum(2)
            own[~there[at : at + 64]] = np.inf
            apart = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
            left, lane = own.copy(), np.arange(len(rows))
            for k in range(self.degree):
                pick = left.argmin(1)
                good = np.isfinite(left[lane, pick])
                if not good.any():
                    break
                out[at : at + 64, k] = np.where(good, ids[lane, pick], -1)
                left[lane, pick] = np.inf
                left[(self.alpha**2 * apart[lane, pick] <= own) & good[:, None]] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int, path: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids, squared distances) of the beam's nodes of each query, -1 and inf where there are fewer; with path also the nodes
        expanded. Each step expands the STEP nearest nodes of every beam."""
        q, n = np.ascontiguousarray(queries, np.float32), len(self.x)
        m, rows = len(q), np.arange(len(queries))
        beam = max(beam, len(self.entries))
        ids = np.full((m, beam), -1, np.int32)
        far = np.full((m, beam), np.inf, np.float32)
        todo = np.zeros((m, beam), bool)
        seen = np.zeros((m, n + 1), bool)  # the last column stands for -1
        seen[:, n] = True
        k = len(self.entries)
        ids[:, :k], todo[:, :k] = self.entries, True
        seen[:, self.entries] = True
        far[:, :k] = ((self.x[self.entries][None] - q[:, None]) ** 2).sum(2)
        walked = []
        step = min(STEP, beam)
        while k < n and todo.any():
            rank = np.where(todo, far, np.inf)
            pick = np.argpartition(rank, step - 1, axis=1)[:, :step]
            wanted = np.isfinite(np.take_along_axis(rank, pick, 1))
            chosen = np.where(wanted, np.take_along_axis(ids, pick, 1), -1)
            np.put_along_axis(todo, pick, False, 1)
            if path:
                walked.append(chosen)
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1)
            fresh = np.zeros(near.shape, bool)
            for w in range(step):
                fresh[:, w] = ~seen[rows[:, None], near[:, w]]
                seen[rows[:, None], near[:, w]] = True
            seen[:, n] = True
            lane, _, _ = at = np.nonzero(fresh)
            found = near[at]
            gap = self.x[found] - q[lane]
            distance = np.full(near.shape, np.inf, np.float32)
            distance[at] = np.einsum("nd,nd->n", gap, gap)
            all_far = np.concatenate([far, distance.reshape(m, -1)], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far = np.take_along_axis(all_far, best, 1)
            ids = np.take_along_axis(np.concatenate([ids, np.where(fresh, near, -1).reshape(m, -1)], axis=1), best, 1)
            todo = np.take_along_axis(np.concatenate([todo, fresh.reshape(m, -1)], axis=1), best, 1)
        met = np.concatenate(walked, axis=1) if walked else ids if path else None
        return ids, far, met


def _answer(graph: Graph, members: list[list[int]], exact: np.ndarray, asked: list[int], vectors: np.ndarray, nearest: int, beam: int) -> Iterator[tuple[int, int, float]]:
    for at in range(0, len(asked), BATCH):
        part = vectors[at : at + BATCH]
        ids, _, _ = graph.search(part.astype(np.float32), beam)
        for query, vector, row in zip(asked[at : at + BATCH], part, ids, strict=True):
            nodes = row[row >= 0]
            distance = np.sqrt(((exact[nodes] - vector) ** 2).sum(1))
            found = sorted((float(d), i) for d, node in zip(distance, nodes.tolist(), strict=True) for i in members[node] if i != query)
            yield from ((query, i, d) for d, i in found[:nearest])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries, its nearest rows of vectors but those of its own key.

    Smallest Euclidean distance first, ties to the smaller key. Null keys and vectors that are null, empty, all zero or hold a null
    or non-finite component take no part on either side. Vectors are compared with those of their own length only. Rows may repeat:
    equal (key, vector) rows count once. Fewer candidates give fewer rows; empty tables give none. Other columns play no part."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    usable = "k is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    shape = lambda df: df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("e")).where(usable)
    equal = Window.partitionBy("h", "e")
    rows = shape(vectors).withColumn("h", F.xxhash64("e"))
    # at most nearest + 1 ids of equal vectors can be answers; the limit is pushed below the shuffle, and repeated rows don't pass it
    classes = rows.distinct().withColumn("r", F.row_number().over(equal.orderBy("k"))).where(F.col("r") <= nearest + 1).groupBy("h", "e").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    nodes = scratch.table(classes, "nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("e"))).first()
    most = SHARD_BYTES // (12 * (width or 0) + 8 * DEGREE)
    shards = max(1, -(-n // max(shard_rows, min(most, -(-n // SHARDS)))))
    dealt = nodes.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "ks", "e")
    asked = shape(queries).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.array("k").alias("ks"), "e")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, a shard's nodes before its queries."""
        shard, waiting, graphs = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if numbers[a] != shard:
                    shard, waiting, graphs = numbers[a], [], None
                part = batch.slice(a, b - a)
                asks = part.column(1).to_numpy(zero_copy_only=False)
                split = int(np.argmax(asks)) if asks.any() else len(asks)
                if split:
                    waiting.append(part.slice(0, split))
                if split < len(asks):
                    if graphs is None:
                        graphs, waiting = _graphs(waiting), []
                    yield _answers(graphs, part.slice(split), nearest, beam)

    schema = "query_id long, vec_id long, score double"
    found = dealt.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks").mapInArrow(work, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    del spark
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, np.float64)


def _graphs(parts: list[pa.RecordBatch]) -> dict[int, tuple[Graph, list[list[int]], np.ndarray]]:
    """A graph for each length of vectors."""
    grouped: dict[int, tuple[list, list]] = {}
    for part in parts:
        for members, row in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            ids, rows = grouped.setdefault(len(row), ([], []))
            ids.append(members)
            rows.append(np.array(row))
    out = {}
    for size, (ids, rows) in grouped.items():
        order = sorted(range(len(ids)), key=ids.__getitem__)  # whatever order rows came in
        exact = np.array([rows[i] for i in order])
        out[size] = Graph(exact.astype(np.float32)), [ids[i] for i in order], exact
    return out


def _answers(graphs: dict, part: pa.RecordBatch, nearest: int, beam: int) -> pa.RecordBatch:
    asked: dict[int, tuple[list, list]] = {}
    for members, row in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
        ids, rows = asked.setdefault(len(row), ([], []))
        ids.append(members[0])
        rows.append(row)
    got = [x for size, (ids, rows) in asked.items() if size in graphs for x in _answer(*graphs[size], ids, _matrix(rows), nearest, beam)]
    columns = list(zip(*got, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
