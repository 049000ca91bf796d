"""Read ends: where each candidate read's template begins, how good it is, and where on the flow cell it was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsieve import functions as R

SUM_OF_BASE_QUALITIES, TOTAL_MAPPED_REFERENCE_LENGTH, RANDOM = "SUM_OF_BASE_QUALITIES", "TOTAL_MAPPED_REFERENCE_LENGTH", "RANDOM"


def candidates(reads: DataFrame) -> DataFrame:
    """Mapped primary alignments."""
    return reads.where(R.is_candidate(F.col("flag")))


def score(strategy: str = SUM_OF_BASE_QUALITIES, seed: int = 0):
    flag = F.col("flag")
    raw = {SUM_OF_BASE_QUALITIES: lambda: R.sum_of_base_qualities(F.col("qual"), F.col("seq")), TOTAL_MAPPED_REFERENCE_LENGTH: lambda: R.mapped_reference_length(flag, F.col("cigar")), RANDOM: lambda: R.random_score(F.col("qname"), seed)}
    if strategy not in raw:
        raise ValueError(f"unknown scoring strategy {strategy!r}")
    return R.discounted(raw[strategy](), flag)


def derive_ends(reads: DataFrame, strategy: str = SUM_OF_BASE_QUALITIES, seed: int = 0, name_pattern: str | None = None, wrap: bool = True, library: str | None = None) -> DataFrame:
    """One row a candidate read, without its sequence, qualities and tags, so that these never reach a shuffle.

    mate_tid is -1 for reads that count as unpaired; tile is -1 where the name has no location. ``library`` names a column that keeps
    reads of different libraries apart."""
    flag = F.col("flag")
    extra = [F.col(library).alias("library")] if library else []
    rows = candidates(reads).select(
        "idx", "qname", *extra,
        R.is_first_of_pair(flag).alias("first_of_pair"), "tid", R.five_prime(flag, F.col("pos"), F.col("cigar")).cast("int").alias("coord"), R.is_reverse(flag).alias("rev"),
        score(strategy, seed).cast("int").alias("score"),
        F.when(R.has_mapped_mate(flag), F.col("mtid")).otherwise(-1).alias("mate_tid"), R.has_mapped_mate(flag).alias("has_mate"), R.name_numbers(F.col("qname"), name_pattern).alias("numbers"),
    )
    known = rows.withColumn("located", R.located(F.col("numbers")))  # each step reads the last one's columns, so names are parsed once
    fit = R.wrap16 if wrap else lambda v: v
    at = [F.when(F.col("located"), fit(F.get("numbers", F.lit(i)))).otherwise(-1).alias(k) for i, k in enumerate(("tile", "x", "y"))]
    return known.select(*[c for c in rows.columns if c != "numbers"], *at, "located")
