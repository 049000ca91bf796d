"""One query an operator, over alignments derived from the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve import functions as R
from readsieve.operators import annotate as A
from readsieve.operators import duplicates as D
from readsieve.operators import ends as E
from readsieve.operators import metrics as M
from readsieve.operators import optical as O
from readsieve.operators.pairs import build_pairs
from readsieve.plans.marking import Options, mark_duplicates
from readsieve.sources.derived import reads

class _Columns:
    """c.name is F.col("name")."""

    def __getattr__(self, name: str):
        return F.col(name)


c = _Columns()


def candidate_reads(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", "flag", "tid")


def flag_breakdown(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(R.is_unmapped(c.flag), "unmapped").when(R.is_secondary_or_supplementary(c.flag), "secondary_or_supplementary").when(~R.is_paired(c.flag) | R.is_mate_unmapped(c.flag), "unpaired").otherwise("paired")
    return reads(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *[F.count_if(f(c.flag)).alias(k) for k, f in (("reverse", R.is_reverse), ("qc_fail", R.is_qc_fail), ("first", R.is_first_of_pair), ("mate_reverse", R.is_mate_reverse))])


def unclipped_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = E.candidates(reads(spark, d))
    return rows.select("idx", R.reference_length(c.cigar).alias("reference_length"), R.alignment_end(c.flag, c.pos, c.cigar).alias("end"), R.unclipped_start(c.pos, c.cigar).alias("unclipped_start"), R.unclipped_end(c.flag, c.pos, c.cigar).alias("unclipped_end"), R.five_prime(c.flag, c.pos, c.cigar).alias("five_prime"), R.strand_code(c.flag).alias("strand"))


def score_sum_quality(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", E.score(E.SUM_OF_BASE_QUALITIES).cast("int").alias("score"))


def score_ref_length(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", E.score(E.TOTAL_MAPPED_REFERENCE_LENGTH).cast("int").alias("score"))


def score_random(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", E.score(E.RANDOM, 1).cast("int").alias("score"))


def read_name_location(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", R.location(c.qname, wrap=False).alias("at")).select("idx", "at.*")


def read_name_location_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", R.location(c.qname).alias("at")).select("idx", "at.*")


def read_name_location_pattern(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(reads(spark, d)).select("idx", R.location(c.qname, r".*:(\d+):(\d+):(\d+)").alias("at")).select("idx", "at.*")


def global_position(spark: SparkSession, d: str) -> DataFrame:
    packed = E.candidates(reads(spark, d)).select("idx", R.pack_position(F.col("tid"), c.pos).alias("packed"))
    return packed.select("idx", "packed", R.unpack_position(F.col("packed")).alias("at")).select("idx", "packed", "at.*")


def read_ends(spark: SparkSession, d: str) -> DataFrame:
    return E.derive_ends(reads(spark, d)).drop("qname")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return build_pairs(E.derive_ends(reads(spark, d)))


def mate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def pair_orientation(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("orient", "opt_orient").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def pair_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_groups(_pairs(spark, d)).select(*D.PAIR_KEY, "set_size")


def pair_representatives(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_groups(_pairs(spark, d)).select(*D.PAIR_KEY, "set_rep", "best_tile", "best_x", "best_y")


def pair_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_duplicates(D.pair_members(_pairs(spark, d)))


def _frags(spark: SparkSession, d: str, mixed: bool) -> DataFrame:
    return D.frag_duplicates(E.derive_ends(reads(spark, d))).where(F.col("mixed") == mixed).select("idx")


def frag_duplicates_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _frags(spark, d, True)


def frag_duplicates_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return _frags(spark, d, False)


def all_duplicates(spark: SparkSession, d: str) -> DataFrame:
    ends = E.derive_ends(reads(spark, d))
    members = D.pair_members(build_pairs(ends))
    return A.verdicts(D.pair_duplicates(members), D.frag_duplicates(ends)).select("idx", F.lit(True).alias("is_dup"), "set_rep", "set_size")


def duplicate_set_tags(spark: SparkSession, d: str) -> DataFrame:
    return D.set_members(D.pair_members(_pairs(spark, d)))


def optical_edges(spark: SparkSession, d: str) -> DataFrame:
    return O.optical_edges(D.pair_members(_pairs(spark, d)))


def optical_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return O.optical_duplicates(D.pair_members(_pairs(spark, d)))


def duplicate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(reads(spark, d)).verdicts


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("idx", "flag", F.array_join("tags", " ").alias("tags"))


def annotated_reads(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mark_duplicates(reads(spark, d)).reads)


def annotated_set_members(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mark_duplicates(reads(spark, d), Options(tag_set_members=True)).reads)


def annotated_no_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mark_duplicates(reads(spark, d), Options(remove_duplicates=True)).reads)


def annotated_no_sequencing_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mark_duplicates(reads(spark, d), Options(remove_sequencing_duplicates=True, tagging_policy=A.OPTICAL_ONLY)).reads)


def duplication_metrics(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(reads(spark, d), Options(library="rg1")).metrics()


def set_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(reads(spark, d)).set_sizes()


def estimated_library_size(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(reads(spark, d)).metrics().select("estimated_library_size")


def roi_histogram(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(reads(spark, d)).roi().select("bin", F.round("coverage_mult", 6).alias("coverage_mult"))


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    candidate_reads, flag_breakdown, unclipped_ends, score_sum_quality, score_ref_length, score_random, read_name_location, read_name_location_wrapped, read_name_location_pattern, global_position, read_ends,
    mate_pairs, pair_orientation, pair_groups, pair_representatives, pair_duplicates, frag_duplicates_mixed, frag_duplicates_unpaired, all_duplicates, duplicate_set_tags, optical_edges, optical_duplicates,
    duplicate_verdicts, annotated_reads, annotated_set_members, annotated_no_duplicates, annotated_no_sequencing_duplicates, duplication_metrics, set_size_histogram, estimated_library_size, roi_histogram,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
