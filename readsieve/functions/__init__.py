"""Column functions on the fields of alignments: flags, CIGAR, qualities and read names. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048

# Fixed values that results depend on.
#: Highest score of one read; the sum of two fits 16 bits.
SCORE_CAP = 16_383
#: Qualities below don't count.
LEAST_QUALITY = 15
#: Quality of a base for which none is given.
MISSING_QUALITY = 255
#: Orientations: F and R of single reads, then of pairs in order of their ends.
FORWARD, REVERSED, FF, FR, RR, RF = range(6)


def has(flag: Column, bits: int) -> Column:
    """Any of the bits is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def is_unmapped(flag: Column) -> Column:
    return has(flag, UNMAPPED)


def is_paired(flag: Column) -> Column:
    return has(flag, PAIRED)


def is_qc_fail(flag: Column) -> Column:
    return has(flag, QC_FAIL)


def is_mate_unmapped(flag: Column) -> Column:
    return has(flag, MATE_UNMAPPED)


def is_secondary(flag: Column) -> Column:
    return has(flag, SECONDARY)


def is_supplementary(flag: Column) -> Column:
    return has(flag, SUPPLEMENTARY)


def is_secondary_or_supplementary(flag: Column) -> Column:
    return has(flag, SECONDARY | SUPPLEMENTARY)


def is_first_of_pair(flag: Column) -> Column:
    return has(flag, FIRST)


def is_reverse(flag: Column) -> Column:
    return has(flag, REVERSE)


def is_mate_reverse(flag: Column) -> Column:
    return has(flag, MATE_REVERSE)


def is_duplicate(flag: Column) -> Column:
    return has(flag, DUPLICATE)


def set_duplicate(flag: Column, on: Column) -> Column:
    return F.when(on, flag.bitwiseOR(F.lit(DUPLICATE))).otherwise(flag.bitwiseAND(F.lit(~DUPLICATE)))


def is_candidate(flag: Column) -> Column:
    """Mapped primary alignments take part in duplicate marking."""
    return ~has(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY)


def has_mapped_mate(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(PAIRED | MATE_UNMAPPED)) == PAIRED


def _sum_of(cigar: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1)), F.lit(0), lambda total, n: total + n.cast("int"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len:int,op:string>>; empty for ``*``."""
    lengths, ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(2))
    return F.zip_with(lengths, ops, lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def reference_length(cigar: Column) -> Column:
    """Reference bases that the alignment spans: its M, D, N, = and X."""
    whole = F.when(cigar.endswith("M"), F.substring(cigar, F.lit(1), F.length(cigar) - 1).try_cast("int"))  # one operation, as most have
    return F.coalesce(whole, _sum_of(cigar, r"(\d+)[MDN=X]"))


def query_length(cigar: Column) -> Column:
    """Read bases in the record: M, I, S, = and X."""
    return _sum_of(cigar, r"(\d+)[MIS=X]")


def _clipped(cigar: Column) -> Column:
    return cigar.contains("S") | cigar.contains("H")


def leading_clip(cigar: Column, ops: str = "SH") -> Column:
    return F.when(~_clipped(cigar), 0).otherwise(_sum_of(F.regexp_extract(cigar, rf"^((?:\d+[{ops}])*)", 1), r"(\d+)[SH]"))


def trailing_clip(cigar: Column, ops: str = "SH") -> Column:
    return F.when(~_clipped(cigar), 0).otherwise(_sum_of(F.regexp_extract(cigar, rf"((?:\d+[{ops}])*)$", 1), r"(\d+)[SH]"))


def inserted_length(cigar: Column) -> Column:
    return _sum_of(cigar, r"(\d+)I")


def deleted_length(cigar: Column) -> Column:
    return _sum_of(cigar, r"(\d+)D")


def alignment_end(flag: Column, pos: Column, cigar: Column) -> Column:
    """First position behind the alignment; one base long where it spans none, and pos + 1 for unmapped reads."""
    return pos + F.when(is_unmapped(flag), 1).otherwise(F.greatest(reference_length(cigar), F.lit(1)))


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - leading_clip(cigar)


def unclipped_end(flag: Column, pos: Column, cigar: Column) -> Column:
    """Last position, clipped bases included."""
    return alignment_end(flag, pos, cigar) + trailing_clip(cigar) - 1


def five_prime(flag: Column, pos: Column, cigar: Column) -> Column:
    return F.when(is_reverse(flag), unclipped_end(flag, pos, cigar)).otherwise(unclipped_start(pos, cigar))


def strand_code(flag: Column) -> Column:
    return F.when(is_reverse(flag), REVERSED).otherwise(FORWARD)


def orientation(first_reverse: Column, second_reverse: Column) -> Column:
    return F.when(first_reverse & second_reverse, RR).when(first_reverse, RF).when(second_reverse, FR).otherwise(FF)


def sum_of_base_qualities(qual: Column, seq: Column) -> Column:
    """Qualities of 15 or more, summed and capped. Without qualities every base counts as 255."""
    base = lambda total, code: total + F.when(code >= LEAST_QUALITY + 33, code - 33).otherwise(0)
    bases = F.when((seq == "*") | seq.isNull(), 0).otherwise(F.length(seq))
    summed = F.when((qual == "*") | qual.isNull(), bases * MISSING_QUALITY).otherwise(F.aggregate(F.transform(F.split(qual, ""), F.ascii), F.lit(0), base))
    return F.least(summed, F.lit(SCORE_CAP))


def mapped_reference_length(flag: Column, cigar: Column) -> Column:
    return F.when(is_unmapped(flag), 0).otherwise(F.least(reference_length(cigar), F.lit(SCORE_CAP)))


def random_score(qname: Column, seed: int = 0) -> Column:
    """The same for a name and seed on every run, from 8192 to 24575."""
    return (F.xxhash64(qname, F.lit(seed)).bitwiseAND(F.lit(SCORE_CAP)) + 8192).cast("int")


def discounted(score: Column, flag: Column) -> Column:
    """Reads that failed quality checks lose to all others."""
    return F.when(is_qc_fail(flag), score - (SCORE_CAP + 1)).otherwise(score)


def wrap16(value: Column) -> Column:
    """A whole number as a signed 16-bit one, overflow wrapping."""
    return (value + 32_768).bitwiseAND(F.lit(65_535)) - 32_768


def name_numbers(qname: Column, pattern: str | None = None) -> Column:
    """array<int> of the tile, x and y in a read name, null where it has none.

    Without a pattern: the leading integers of the last three of 5 or 7 fields between colons. A pattern must match the whole name;
    its first three groups are the numbers."""
    if pattern is not None:
        return F.array(*[F.regexp_extract(qname, f"^(?:{pattern})$", k).try_cast("int") for k in (1, 2, 3)])
    fields = F.split(qname, ":", -1)
    number = lambda f: F.coalesce(f.try_cast("int"), F.regexp_extract(f, r"^\s*([+-]?\d+)", 1).try_cast("int"))
    return F.when(F.size(fields).isin(5, 7), F.transform(F.slice(fields, -3, 3), number))


def located(numbers: Column) -> Column:
    """Whether all three numbers are there."""
    return F.coalesce(F.forall(numbers, lambda n: n.isNotNull()), F.lit(False))


def location(qname: Column, pattern: str | None = None, wrap: bool = True) -> Column:
    """struct<tile,x,y> of a read name, null where it has none; see name_numbers()."""
    numbers = name_numbers(qname, pattern)
    fit = wrap16 if wrap else lambda v: v
    return F.when(located(numbers), F.struct(*[fit(F.get(numbers, F.lit(i))).alias(k) for i, k in enumerate(("tile", "x", "y"))]))


def pack_position(tid: Column, pos: Column) -> Column:
    """One number that sorts like (tid, pos); both must be 0 or more."""
    return F.shiftleft(tid.cast("long"), 40).bitwiseOR(pos.cast("long"))


def unpack_position(packed: Column) -> Column:
    return F.struct(F.shiftright(packed, 40).cast("int").alias("tid"), packed.bitwiseAND(F.lit((1 << 40) - 1)).cast("int").alias("pos"))
