"""SAM text as a source and a sink, in DataFrame expressions; plain files split like any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve import functions as R
from readsieve.sources.files import inflated, opened
from readsieve.sources.header import Header

COLUMNS = ["idx", "qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "tags", "rg"]
HEADER_CHUNK = 1 << 16


def read_header(path: str) -> Header:
    """The leading @ lines of a plain or compressed SAM file."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        packed = file.read(2) == b"\x1f\x8b"
        file.seek(0)
        pieces = inflated(file, HEADER_CHUNK) if packed else iter(lambda: file.read(HEADER_CHUNK), b"")
        text = b""
        for piece in pieces:
            text += piece
            lines = text.split(b"\n")
            if any(x[:1] != b"@" for x in lines[:-1]) or (lines[-1][:1] not in (b"@", b"")):
                break
    found = []
    for x in text.decode().split("\n"):
        if x[:1] != "@":
            break
        found.append(x.rstrip("\r"))
    return Header(found)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with idx, their place in file order from 0. Splits are counted first; their sizes are a row a split."""
    rows = lines.select("value", F.col("path"), F.col("start"), F.monotonically_increasing_id().alias("m"))
    splits = rows.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("m").alias("low")).collect()
    ahead, table = 0, []
    for s in sorted(splits, key=lambda s: (s.path, s.start)):
        table.append((s.path, s.start, ahead - s.low))
        ahead += s.n
    shifts = lines.sparkSession.createDataFrame(table, "path string, start long, shift long")
    return rows.join(shifts, ["path", "start"]).select((F.col("m") + F.col("shift")).alias("idx"), "value")


def parse(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Columns of the reads table from (idx, value). A read without a known reference or position is unmapped, as is one without a
    CIGAR; a mate without a position has no reference."""
    f = F.split("value", "\t", 12)
    at = lambda i, kind="string": f[i].cast(kind)
    rows = lines.select("idx", at(0).alias("qname"), at(1, "int").alias("flag"), at(2).alias("rname"), (at(3, "int") - 1).alias("pos"), at(4, "int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"), (at(7, "int") - 1).alias("mpos"), at(8, "int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), F.split(F.coalesce(F.get(f, F.lit(11)), F.lit("")), "\t").alias("tags"))
    here, there = references.select(F.col("name").alias("rname"), F.col("tid").alias("t1")), references.select(F.col("name").alias("rnext"), F.col("tid").alias("t2"))
    rows = rows.join(here, "rname", "left").join(there, "rnext", "left")
    tid = F.when(F.col("pos") >= 0, F.coalesce("t1", F.lit(-1))).otherwise(-1)
    mate = F.when(F.col("rnext") == "=", tid).otherwise(F.coalesce("t2", F.lit(-1)))
    off = (tid < 0) | (F.col("cigar") == "*")
    tags = F.filter("tags", lambda t: t != "")
    group = F.get(F.filter(tags, lambda t: t.startswith("RG:Z:")), F.lit(0))
    return rows.select("idx", "qname", F.when(off, F.col("flag").bitwiseOR(F.lit(R.UNMAPPED))).otherwise(F.col("flag")).alias("flag"), tid.alias("tid"), "pos", "mapq", "cigar", F.when(F.col("mpos") < 0, -1).otherwise(mate).alias("mtid"), "mpos", "tlen", "seq", "qual", tags.alias("tags"), F.substring(group, F.lit(6), F.length(group)).alias("rg"))


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Reads and header of a SAM file, plain or gzip-compressed (then one task reads it)."""
    header = read_header(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))
    return parse(numbered(lines), header.table(spark)), header


def lines(reads: DataFrame, header: Header) -> DataFrame:
    """(idx, value): header lines with negative idx, then the alignments as text."""
    spark = reads.sparkSession
    names = header.table(spark)
    rows = reads.join(names.select(F.col("tid").alias("_t"), F.col("name").alias("rname")), F.col("tid") == F.col("_t"), "left").drop("_t")
    rows = rows.join(names.select(F.col("tid").alias("_t"), F.col("name").alias("rnext")), F.col("mtid") == F.col("_t"), "left").drop("_t")
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    mate: Column = F.when((F.col("mtid") >= 0) & (F.col("mtid") == F.col("tid")), "=").otherwise(star("rnext"))
    fields = [F.col("qname"), F.col("flag"), star("rname"), F.col("pos") + 1, F.col("mapq"), star("cigar"), mate, F.col("mpos") + 1, F.col("tlen"), star("seq"), star("qual")]
    body = rows.select("idx", F.concat_ws("\t", *[x.cast("string") for x in fields], F.col("tags")).alias("value"))
    n = len(header.lines)
    head = spark.createDataFrame([(i - n, x) for i, x in enumerate(header.lines)], "idx long, value string")
    return head.union(body)


def write_sam(reads: DataFrame, header: Header, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """A folder of text parts that, one after the other, are one SAM file in file order."""
    text = lines(reads, header)
    spread = text.repartitionByRange("idx").sortWithinPartitions("idx").select("value")
    spread.write.mode(mode).option("compression", compression or "none").text(path)


