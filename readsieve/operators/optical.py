"""Optical duplicates: members of a pair group that were seen next to each other on the flow cell.

Lists of two or three members are a closed form in column expressions. Longer ones are a graph, in Arrow batches: union-find over
a grid of cells as wide as the distance. A list has LIST_CAP members at most, longer ones having no optical duplicates by
definition, so a group handed to Python is bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve.operators.duplicates import PAIR_KEY, attach

# Fixed values that results depend on: distance, longest list, longest list of the closed form.
PIXEL_DISTANCE = 100
LIST_CAP = 300_000
FAST = 3


def close(a: Column, b: Column, distance: int = PIXEL_DISTANCE) -> Column:
    """Both located, on one tile, and within the distance along either axis."""
    return (a["tile"] != -1) & (b["tile"] != -1) & (a["tile"] == b["tile"]) & (F.abs(a["x"] - b["x"]) <= distance) & (F.abs(a["y"] - b["y"]) <= distance)


def lists(members: DataFrame) -> tuple[DataFrame, list[str]]:
    """Members with ``n_list``, the size of their list (a group's pairs of one sequencing orientation), and the list's key."""
    keys = [*PAIR_KEY, "opt_orient", *(["library"] if "library" in members.columns else [])]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n_list")).where(f"n_list between 2 and {LIST_CAP}")
    return attach(members, sizes, keys), keys


def _few(members: DataFrame, keys: list[str], distance: int) -> DataFrame:
    member = F.struct("idx1", "idx2", "tile", "x", "y")
    found = members.groupBy(*keys, "set_rep", "best_tile", "best_x", "best_y").agg(F.array_sort(F.collect_list(member)).alias("m"))
    found = found.select("m", "set_rep", F.struct(F.col("best_tile").alias("tile"), F.col("best_x").alias("x"), F.col("best_y").alias("y")).alias("k"))
    m = [F.get("m", F.lit(i)) for i in range(FAST)]
    other = [m[i]["idx1"] != F.col("set_rep") for i in range(FAST)]
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = found.select("m", "set_rep", *[yes(other[i] & close(F.col("k"), m[i], distance)).alias(f"f{i}") for i in range(FAST)], *[yes(other[i] & other[j] & close(m[i], m[j], distance)).alias(f"p{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))])
    for i, j in ((0, 1), (0, 2), (1, 2)):  # in this order, each step on the flags of the last
        p, a, b = F.col(f"p{i}{j}"), F.col(f"f{i}"), F.col(f"f{j}")
        found = found.withColumns({f"f{i}": a | (p & b), f"f{j}": b | p})
    flagged = F.explode(F.filter(F.array(*[F.when(F.col(f"f{i}") & yes(other[i]), m[i]) for i in range(FAST)]), lambda x: x.isNotNull()))
    return found.select(flagged.alias("m")).select("m.idx1", "m.idx2")


def components(tiles: list[int], xs: list[int], ys: list[int], distance: int) -> list[int]:
    """Component number of each node; nodes of tile -1 are alone."""
    parent = list(range(len(tiles)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    cells: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    width = distance + 1
    for i, (t, x, y) in enumerate(zip(tiles, xs, ys, strict=True)):
        if t == -1:
            continue
        cx, cy = x // width, y // width
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for j in cells.get((t, cx + dx, cy + dy), ()):
                    if abs(xs[j] - x) <= distance and abs(ys[j] - y) <= distance:
                        a, b = root(i), root(j)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
        cells[t, cx, cy].append(i)
    return [root(i) for i in range(len(tiles))]


def _flagged(rows: np.ndarray, distance: int) -> np.ndarray:
    """Rows (idx1, idx2, tile, x, y, set_rep) of one list, in order of idx1: which are optical. Of a component the group's best stays,
    else the member first by x, y and row."""
    part = np.array(components(rows[:, 2].tolist(), rows[:, 3].tolist(), rows[:, 4].tolist(), distance))
    order = np.lexsort((rows[:, 0], rows[:, 4], rows[:, 3], rows[:, 0] != rows[:, 5], part))
    out = np.zeros(len(rows), bool)
    out[order[1:]] = part[order[1:]] == part[order[:-1]]
    return out


def _many(members: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Lists come one after the other in sorted partitions; a batch's last is carried to the next batch."""
    columns = ["idx1", "idx2", "tile", "x", "y", "set_rep"]
    sortable = [F.xxhash64("library").alias("library") if k == "library" else F.col(k).cast("long").alias(k) for k in keys]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(keys) + len(columns)), np.int64)
        n = len(keys)

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = [0, *(np.flatnonzero((rows[1:, :n] != rows[:-1, :n]).any(1)) + 1).tolist(), len(rows)]
            marks = np.concatenate([_flagged(rows[i:j, n:], distance) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(rows[marks, n]), pa.array(rows[marks, n + 1])], names=["idx1", "idx2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
            last = np.flatnonzero((held[:, :n] != held[-1, :n]).any(1))
            if len(last):
                done, held = held[: last[-1] + 1], held[last[-1] + 1 :]
                yield from found(done)
        if len(held):
            yield from found(held)

    rows = members.select(*sortable, *[F.col(c).cast("long").alias(c) for c in columns])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "idx1").mapInArrow(flag, "idx1 long, idx2 long")


def optical_pairs(members: DataFrame, distance: int = PIXEL_DISTANCE) -> DataFrame:
    """(idx1, idx2) of pairs flagged as optical; members are those of pair_members()."""
    listed, keys = lists(members)
    return _few(listed.where(f"n_list <= {FAST}"), keys, distance).union(_many(listed.where(f"n_list > {FAST}"), keys, distance))


def optical_duplicates(members: DataFrame, distance: int = PIXEL_DISTANCE) -> DataFrame:
    """idx of both ends of optical pairs."""
    return optical_pairs(members, distance).select(F.explode(F.array("idx1", "idx2")).alias("idx"))


def optical_edges(members: DataFrame, distance: int = PIXEL_DISTANCE) -> DataFrame:
    """(idx1, other) of pairs of one list that are close, each edge once. Cells as wide as the distance make it an equi-join: a pair
    meets only those of its own and the neighbouring cells."""
    width = distance + 1
    listed, keys = lists(members)
    cells = listed.where("tile <> -1").select(*keys, "tile", "idx1", "x", "y", F.floor(F.col("x") / width).cast("int").alias("cx"), F.floor(F.col("y") / width).cast("int").alias("cy"))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = cells.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")
    right = cells.select(*keys, "tile", "cx", "cy", F.col("idx1").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = left.join(right, [*keys, "tile", "cx", "cy"])
    return met.where((F.col("idx1") < F.col("other")) & (F.abs(F.col("x") - F.col("ox")) <= distance) & (F.abs(F.col("y") - F.col("oy")) <= distance)).select("idx1", "other")
