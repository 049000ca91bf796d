"""Duplication metrics, the estimated library size and the return on sequencing more."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsieve import functions as R

# Fixed values that results depend on: bins of the histogram; library sizes are given in 2^40 steps from one time to 100, 1,000, ... times
# the unique pairs, whichever comes first.
BINS = 100
STEPS, LEAST_SPAN, SPAN_GROWTH = 2**40, 100.0, 10.0


def counts(annotated: DataFrame) -> DataFrame:
    """One row of counters over all reads; each read counts once, as the first that fits of unmapped, secondary or supplementary,
    unpaired, paired. One partial aggregate and one small exchange."""
    flag = F.col("flag")
    kind = F.when(R.is_unmapped(flag), 0).when(R.is_secondary_or_supplementary(flag), 1).when(~R.is_paired(flag) | R.is_mate_unmapped(flag), 2).otherwise(3)
    rows = annotated.select(kind.alias("kind"), "is_dup", "is_optical")
    n = lambda condition: F.count_if(F.expr(condition))
    return rows.agg(
        n("kind = 2").alias("unpaired_reads_examined"), F.expr("count_if(kind = 3) div 2").alias("read_pairs_examined"), n("kind = 1").alias("secondary_or_supplementary_rds"), n("kind = 0").alias("unmapped_reads"),
        n("is_dup and kind = 2").alias("unpaired_read_duplicates"), F.expr("count_if(is_dup and kind = 3) div 2").alias("read_pair_duplicates"), F.expr("count_if(is_optical) div 2").alias("read_pair_optical_duplicates"),
    )


def library_size(pairs: int, unique: int) -> int:
    """Molecules x in a library of which ``pairs`` draws gave ``unique`` different ones: unique/x = 1 - exp(-pairs/x). 0 where there is
    nothing to estimate from.

    In r = pairs/x that is r * share + exp(-r) - 1 = 0, a convex function that is positive at 1/share, to the right of its root: Newton's
    steps from there go down to the root and never pass it. The result is the middle of the step that holds it."""
    if not 0 < unique < pairs:
        return 0
    share = unique / pairs
    r, last = 1 / share, math.inf
    while r < last:
        r, last = r - (r * share + math.expm1(-r)) / (share - math.exp(-r)), r
    times = pairs / last / unique
    span = LEAST_SPAN
    while span < times:
        span *= SPAN_GROWTH
    step = (span - 1) / STEPS
    return int(unique * (1 + (math.floor((times - 1) / step) + 0.5) * step))


def metrics(counted: DataFrame, library: str = "") -> DataFrame:
    """The metrics row; ``counted`` is of counts(). Only that one row comes to the driver, for the library size."""
    row = counted.first()
    pairs, dups, optical = row.read_pairs_examined, row.read_pair_duplicates, row.read_pair_optical_duplicates
    total = row.unpaired_reads_examined + 2 * pairs
    share = (row.unpaired_read_duplicates + 2 * dups) / total if total else 0.0
    spark = counted.sparkSession
    names = ", ".join(f"{c} long" for c in counted.columns)
    return spark.createDataFrame([(library, *row, share, library_size(pairs - optical, pairs - dups))], f"library string, {names}, percent_duplication double, estimated_library_size long")


def roi_histogram(row: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, coverage_mult): how many times the unique pairs a library gives at 1 to 100 times the sequencing; null if its size is 0."""
    size, pairs = F.col("estimated_library_size"), F.col("read_pairs_examined")
    unique = pairs - F.col("read_pair_duplicates")
    found = row.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), size.alias("l"), pairs.alias("p"), unique.alias("u"))
    value = F.expr("l * (1 - exp(-(bin * p) / l)) / u")
    return found.select("bin", F.when((F.col("l") > 0) & (F.col("u") > 0), value).alias("coverage_mult"))


def set_size_histogram(members: DataFrame, optical: DataFrame | None = None) -> DataFrame:
    """(set_size, all_sets, optical_sets, non_optical_sets): pair groups by their size, by one more than their optical pairs, and by their
    size without these. ``optical`` is of optical_pairs()."""
    keys = ["set_rep"]
    if optical is None:
        marked = members.withColumn("o", F.lit(0))
    else:
        marks = optical.select(F.col("idx1").alias("_o"))
        marked = members.join(marks, F.col("idx1") == F.col("_o"), "left").withColumn("o", (F.col("_o").isNotNull() & ~F.col("is_best")).cast("int"))
    sets = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("o").alias("o"))
    parts = F.array(F.struct(F.col("n").alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")), F.struct((F.col("o") + 1).alias("s"), F.lit(0).alias("a"), (F.col("o") > 0).cast("int").alias("b"), F.lit(0).alias("c")), F.struct((F.col("n") - F.col("o")).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    found = sets.select(F.explode(parts).alias("x")).groupBy(F.col("x.s").alias("set_size")).agg(F.sum("x.a").alias("all_sets"), F.sum("x.b").alias("optical_sets"), F.sum("x.c").alias("non_optical_sets"))
    return found.where("all_sets + optical_sets + non_optical_sets > 0")


def report(row: DataFrame, histogram: DataFrame, header: list[str] = ()) -> str:
    """Metrics and histogram as a text file's content."""
    values = row.first()
    columns = [c.upper() for c in row.columns]
    lines = [x for h in header for x in ("## StringHeader", f"# {h}")]
    lines += ["", "## METRICS", "\t".join(columns), "\t".join("" if v is None else str(v) for v in values), "", "## HISTOGRAM\tDouble", "BIN CoverageMult"]
    lines += [f"{r.bin}\t{r.coverage_mult:.6f}" if r.coverage_mult is not None else f"{r.bin}\tnan" for r in histogram.orderBy("bin").collect()]
    return "\n".join(lines) + "\n"
