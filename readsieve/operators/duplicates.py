"""Duplicates among pairs and among single ends.

Groups are summed by hash aggregates with map-side combination, on numbers alone; a best member is the least packed (score, idx).
The sums are joined back on keys hidden from the planner, so both sides are shuffled for the join and AQE can split a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR_KEY = ["tid1", "coord1", "orient", "tid2", "coord2"]
END_KEY = ["tid", "coord", "rev"]
#: Bits of a packed rank that hold the row number.
IDX_BITS = 46


def rank(score: Column, idx: Column) -> Column:
    """Smaller is better: the higher score, then the earlier row."""
    return F.shiftleft((F.lit(65_535) - score).cast("long"), IDX_BITS).bitwiseOR(idx)


def row_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << IDX_BITS) - 1))


def _hidden(column: str, kind: str) -> Column:
    if kind == "boolean":
        return F.when(F.col(column), True).otherwise(False)
    if kind == "string":
        return F.reverse(F.reverse(column))
    return F.bitwise_not(F.bitwise_not(column))


def attach(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with one row of sums a key; null keys, such as the library of reads without a group, meet each other."""
    kinds = dict(sums.dtypes)
    other = sums.select(*[_hidden(k, kinds[k]).alias(f"_{k}") for k in keys], *[c for c in sums.columns if c not in keys])
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "library" else F.col(k) == F.col(f"_{k}"))
    return rows.join(other, met).drop(*[f"_{k}" for k in keys])


def _keys(rows: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, "library"] if "library" in rows.columns else keys


def pair_groups(pairs: DataFrame) -> DataFrame:
    """One row a group of two pairs or more at the same places: its key, size, and the rank and location of its best pair."""
    packed = rank(F.col("score"), F.col("idx1"))
    best = [F.min_by(c, packed).alias(f"best_{c}") for c in ("tile", "x", "y")]
    return pairs.groupBy(*_keys(pairs, PAIR_KEY)).agg(F.count("*").alias("set_size"), F.min(packed).alias("best"), *best).where("set_size > 1").withColumn("set_rep", row_of(F.col("best"))).drop("best")


def pair_members(pairs: DataFrame) -> DataFrame:
    """Every pair of a group, with the group's size and representative and whether it is that."""
    return attach(pairs, pair_groups(pairs), _keys(pairs, PAIR_KEY)).withColumn("is_best", F.col("idx1") == F.col("set_rep"))


def pair_duplicates(members: DataFrame) -> DataFrame:
    """(idx, set_rep, set_size) of both ends of every pair but a group's best."""
    return members.where("not is_best").select(F.explode(F.array("idx1", "idx2")).alias("idx"), "set_rep", "set_size")


def set_members(members: DataFrame) -> DataFrame:
    """(idx, set_rep, set_size) of both ends of every pair of a group."""
    return members.select(F.explode(F.array("idx1", "idx2")).alias("idx"), "set_rep", "set_size")


def frag_groups(ends: DataFrame) -> DataFrame:
    """Groups of two ends or more at one place, an unpaired one among them: size, whether one is paired, the best end."""
    unpaired = F.col("mate_tid") == -1
    sums = ends.groupBy(*_keys(ends, END_KEY)).agg(F.count("*").alias("n"), F.max((~unpaired).cast("int")).alias("paired"), F.max(unpaired.cast("int")).alias("single"), F.min(rank(F.col("score"), F.col("idx"))).alias("best"))
    return sums.where("n > 1 and single = 1").withColumn("best", row_of(F.col("best"))).drop("single")


def frag_duplicates(ends: DataFrame) -> DataFrame:
    """(idx, mixed): unpaired ends where a paired one stands, and elsewhere all unpaired ends but the best."""
    singles = ends.where("mate_tid = -1").select("idx", *_keys(ends, END_KEY))
    met = attach(singles, frag_groups(ends), _keys(ends, END_KEY))
    return met.where("paired = 1 or idx <> best").select("idx", (F.col("paired") == 1).alias("mixed"))
