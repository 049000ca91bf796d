"""Command line: marks the duplicates of one file. ``python -m readsieve --input in.bam --output out.sam --metrics out.txt``"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from readsieve import __version__
from readsieve.operators import annotate as A
from readsieve.operators import ends as E
from readsieve.operators import metrics as M
from readsieve.operators import optical as O
from readsieve.plans.marking import Options, mark_duplicates
from readsieve.sources import read_alignments, write_alignments
from readsieve.sources.files import opened


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readsieve", description="Mark duplicate alignments with Spark.")
    p.add_argument("--input", required=True, help="SAM, SAM.gz or BAM file")
    p.add_argument("--output", required=True, help="folder of parts that make up one file; its ending tells the format, BAM by default")
    p.add_argument("--metrics", required=True, help="text file of metrics")
    p.add_argument("--num-threads", type=int, default=1, help="threads of a local run; on a cluster Spark's settings count")
    p.add_argument("--none-duplex-io", action="store_true", help="accepted; Spark overlaps reading and writing by itself")
    p.add_argument("--create-index", action="store_true", help="not supported")
    p.add_argument("--index-format", choices=("BAI", "CSI"), default="BAI", help="not supported")
    p.add_argument("--remove-duplicates", action="store_true")
    p.add_argument("--remove-sequencing-duplicates", action="store_true")
    p.add_argument("--duplicate-scoring-strategy", choices=(E.SUM_OF_BASE_QUALITIES, E.TOTAL_MAPPED_REFERENCE_LENGTH, E.RANDOM), default=E.SUM_OF_BASE_QUALITIES)
    p.add_argument("--optical-duplicate-pixel-distance", type=int, default=O.PIXEL_DISTANCE)
    p.add_argument("--read-name-regex", help="three groups give tile, x and y; null turns optical duplicates off")
    p.add_argument("--tag-duplicate-set-members", action="store_true")
    p.add_argument("--tagging-policy", choices=(A.DONT_TAG, A.OPTICAL_ONLY, A.ALL), default=A.ALL)
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(arguments: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(arguments)
    if a.create_index:
        p.error("indexes aren't written")
    started = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    command = " ".join(["readsieve", *(sys.argv[1:] if arguments is None else arguments)])
    builder = SparkSession.builder.appName("readsieve")
    spark = (builder if SparkSession.getActiveSession() else builder.config("spark.master", f"local[{a.num_threads}]")).getOrCreate()
    reads, header = read_alignments(spark, a.input)
    options = Options(strategy=a.duplicate_scoring_strategy, pixel_distance=a.optical_duplicate_pixel_distance, name_pattern=a.read_name_regex, tag_set_members=a.tag_duplicate_set_members, tagging_policy=a.tagging_policy, remove_duplicates=a.remove_duplicates, remove_sequencing_duplicates=a.remove_sequencing_duplicates, library=header.library)
    job = mark_duplicates(reads, options)
    write_alignments(job.reads, header.with_program(A.PROGRAM_ID, __version__, command), a.output)
    row = job.metrics()
    system, path = opened(a.metrics)
    with system.open_output_stream(path) as out:
        out.write(M.report(row, M.roi_histogram(row), [command, f"Started on: {started}"]).encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
