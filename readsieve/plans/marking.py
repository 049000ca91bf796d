"""The whole job: ends, pairs, duplicates, optical duplicates, annotated reads and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsieve.operators import annotate as A
from readsieve.operators import duplicates as D
from readsieve.operators import ends as E
from readsieve.operators import metrics as M
from readsieve.operators import optical as O
from readsieve.operators.pairs import build_pairs
from readsieve.scratch import Scratch


@dataclass
class Options:
    """``name_pattern`` "null" turns optical duplicates off; ``materialize`` writes ends and group members, which are narrow, to
    the shared folder, so that the input is decoded once for them and once for the result, and lost executors cost no more than their tasks."""

    strategy: str = E.SUM_OF_BASE_QUALITIES
    seed: int = 0
    pixel_distance: int = O.PIXEL_DISTANCE
    name_pattern: str | None = None
    wrap_int16: bool = True
    tag_set_members: bool = False
    tagging_policy: str = A.ALL
    remove_duplicates: bool = False
    remove_sequencing_duplicates: bool = False
    library_column: str | None = None
    library: str = ""
    materialize: bool = True
    program: str | None = A.PROGRAM_ID


@dataclass
class Marked:
    """Lazy results of one job."""

    ends: DataFrame
    pairs: DataFrame
    members: DataFrame
    verdicts: DataFrame
    annotated: DataFrame
    reads: DataFrame
    options: Options = field(default_factory=Options)
    optical: DataFrame | None = None

    def metrics(self) -> DataFrame:
        """Counted over all reads, before any is removed."""
        return M.metrics(M.counts(self.annotated), self.options.library)

    def roi(self) -> DataFrame:
        return M.roi_histogram(self.metrics())

    def set_sizes(self) -> DataFrame:
        return M.set_size_histogram(self.members, self.optical)


def mark_duplicates(reads: DataFrame, options: Options | None = None) -> Marked:
    """Marks duplicates among reads (columns of the reads table). If any candidate's name has no location, optical duplicates are off,
    which a look at one such row decides."""
    o = options or Options()
    off = o.name_pattern in ("null", "Null", "NULL", "")
    scratch = Scratch(reads.sparkSession, "marking") if o.materialize else None
    kept_as = scratch.table if scratch else lambda df, name: df
    ends = kept_as(E.derive_ends(reads, o.strategy, o.seed, None if off else o.name_pattern, o.wrap_int16, o.library_column), "ends")
    pairs = build_pairs(ends)
    members = kept_as(D.pair_members(pairs), "members")
    optical = None if off or ends.where("not located").limit(1).count() else O.optical_pairs(members, o.pixel_distance)
    marks = None if optical is None else optical.select(F.explode(F.array("idx1", "idx2")).alias("idx"))
    verdicts = A.verdicts(D.pair_duplicates(members), D.frag_duplicates(ends), marks)
    annotated = A.annotate(reads, verdicts, D.set_members(members) if o.tag_set_members else None, o.tagging_policy, o.program)
    kept = annotated
    if o.remove_duplicates:
        kept = A.remove_duplicates(kept)
    if o.remove_sequencing_duplicates:
        kept = A.remove_sequencing_duplicates(kept)
    return Marked(ends, pairs, members, verdicts, annotated, kept, o, optical)
