"""Alignments in and out: SAM and BAM files, and tables derived from a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readsieve.sources import bam, sam
from readsieve.sources.files import opened, sniff
from readsieve.sources.header import Header


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Reads and header of a file, whose format its first bytes tell."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        kind = sniff(file.read(1 << 16))
    if kind == "cram":
        raise NotImplementedError("CRAM")
    return bam.read_bam(spark, path) if kind == "bam" else sam.read_sam(spark, path)


def write_alignments(reads: DataFrame, header: Header, path: str) -> None:
    """In the format of the path's ending: .sam, .sam.gz, and BAM for any other."""
    if path.endswith((".sam", ".sam.gz")):
        sam.write_sam(reads, header, path, compression="gzip" if path.endswith(".gz") else None)
    else:
        bam.write_bam(reads, header, path)
