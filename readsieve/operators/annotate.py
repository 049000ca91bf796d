"""Verdicts written back to the alignments: flags and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsieve import functions as R

LIBRARY, SEQUENCING = "LB", "SQ"
ALL, OPTICAL_ONLY, DONT_TAG = "All", "OpticalOnly", "DontTag"
PROGRAM_ID = "readsieve"


def verdicts(pair_dups: DataFrame, frag_dups: DataFrame, optical: DataFrame | None = None) -> DataFrame:
    """idx, is_optical, dup_type, set_rep and set_size of every duplicate. The two kinds of duplicates share no row."""
    both = pair_dups.select("idx", "set_rep", "set_size").union(frag_dups.select("idx", F.lit(None).cast("long"), F.lit(None).cast("long")))
    if optical is None:
        both = both.withColumn("is_optical", F.lit(False))
    else:
        marks = optical.select(F.col("idx").alias("_optical"))
        both = both.join(marks, F.col("idx") == F.col("_optical"), "left").withColumn("is_optical", F.col("_optical").isNotNull()).drop("_optical")
    return both.select("idx", "is_optical", F.when(F.col("is_optical"), SEQUENCING).otherwise(LIBRARY).alias("dup_type"), "set_rep", "set_size")


def _without(tags: Column, *names: str) -> Column:
    return F.filter(tags, lambda t: ~F.substring(t, 1, 3).isin(*[f"{n}:" for n in names]))


def _tag(on: Column, *values: Column) -> Column:
    return F.when(on, F.array(*values)).otherwise(F.expr("cast(array() as array<string>)"))


def annotate(reads: DataFrame, verdict: DataFrame, sets: DataFrame | None = None, policy: str = ALL, program: str | None = PROGRAM_ID) -> DataFrame:
    """All reads, their duplicate flag set or cleared, and their tags: DT replaced, then DI and DS of members of a set (with ``sets``),
    then PG. Adds is_dup and is_optical. Stale DI and DS of other reads stay."""
    if policy not in (ALL, OPTICAL_ONLY, DONT_TAG):
        raise ValueError(f"unknown tagging policy {policy!r}")
    marks = verdict.select(F.col("idx").alias("_idx"), "is_optical", "dup_type")
    out = reads.join(marks, F.col("idx") == F.col("_idx"), "left").withColumn("is_dup", F.col("_idx").isNotNull()).withColumn("is_optical", F.coalesce("is_optical", F.lit(False))).drop("_idx")
    shown = {ALL: F.col("is_dup"), OPTICAL_ONLY: F.col("is_optical"), DONT_TAG: F.lit(False)}[policy]
    tags = F.concat(_without(F.col("tags"), "DT"), _tag(shown, F.concat(F.lit("DT:Z:"), F.col("dup_type"))))
    if sets is not None:
        own = sets.select(F.col("idx").alias("_idx"), F.col("set_rep").alias("_rep"), F.col("set_size").alias("_size"))
        out = out.join(own, F.col("idx") == F.col("_idx"), "left").drop("_idx")
        tagged = F.col("_rep").isNotNull() & R.is_candidate(F.col("flag"))
        tags = F.when(tagged, F.concat(_without(tags, "DI", "DS"), F.array(F.concat(F.lit("DI:i:"), F.col("_rep")), F.concat(F.lit("DS:i:"), F.col("_size"))))).otherwise(tags)
    if program:
        tags = F.concat(_without(tags, "PG"), F.array(F.lit(f"PG:Z:{program}")))
    out = out.withColumn("tags", tags).withColumn("flag", R.set_duplicate(F.col("flag"), F.col("is_dup")))
    return out.drop("dup_type", "_rep", "_size")


def remove_duplicates(annotated: DataFrame) -> DataFrame:
    return annotated.where("not is_dup")


def remove_sequencing_duplicates(annotated: DataFrame) -> DataFrame:
    return annotated.where("not is_optical")
