"""Line dedup within one edit, by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are distinct by two 64-bit hashes. Two lines are within one insertion, deletion or substitution only if some deletion variants of them are
equal; emitting every variant of every line would square the text, so exact filters come first. A line of about 8L characters has 8
regions; leaving region s out, what stands before it (from the start) and behind it (from the end) must be equal in both lines for the s in
which the edit is. Keys of halves, over all lines, and of eighths, over the lines those leave, pick the (line, region) that
share a key with another line. Long regions are cut into eighths again, so work grows with a line's length and not its square; lines under
LEAST characters are one region. The regions' variants are then emitted as hashed keys and joined:
equal variants with the character deleted at the same place differ by a substitution, and a variant equal to a whole region by an
insertion. So each group of equal keys needs its earliest line only, never its pairs. The edit distance to it is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm.common import Scratch, fresh

#: Characters below which a line is one region; a multiple of BAND.
LEAST = 16
#: Regions of more characters are cut again.
NARROW = 256
SPACE = " \t\r\x0b\x0c"
BAND = 8


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash of the whole text, and text, of the documents that count."""
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("whole"), F.col(text).alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """key, whole, pos and line, trimmed, of the lines that aren't blank."""
    rows = rows.select("key", "whole", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(SPACE))).withColumn("n", F.length("line")).where("n > 0")


def _hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _around(k: Column, line: Column, n: Column, size: Column, region: Column, regions: int) -> Column:
    """Hash of k and what stands before and behind a region of a line that belongs to the band of ``size`` characters."""
    part = (size / regions).cast("int")
    behind = part * (regions - 1 - region)
    return F.xxhash64(k, size, region, F.substring(line, F.lit(1), part * region), F.substring(line, n - behind + 1, behind))


def _bands(build, n: Column) -> Column:
    """Arrays that ``build`` gives for the band of a line of n characters, and for the band below where n is that band's next length."""
    size = n - n % BAND
    return F.when((n % BAND == 0) & (n > LEAST), F.concat(build(size), build(size - BAND))).otherwise(build(size))


def _halves() -> Column:
    """Keys of a line's halves; none of a short line."""
    keys = _bands(lambda size: F.array(*[_around(F.lit(0), F.col("line"), F.col("n"), size, F.lit(s), 2) for s in range(2)]), F.col("n"))
    return F.when(F.col("n") < LEAST, F.expr("cast(array() as array<bigint>)")).otherwise(keys)


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed whose key k another row has; no line has a key twice."""
    twice = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(F.bitwise_not(F.bitwise_not("k")).alias("kk"))
    return keyed.join(twice, F.col("k") == F.col("kk")).drop("kk")


def _cut(rows: DataFrame) -> DataFrame:
    """(id, k, region) of the eighths of the regions in rows, with new keys; those that no other line shares go."""
    held = rows.withColumn("n", F.length("region")).withColumn("size", F.explode(_bands(F.array, F.col("n"))))
    # a row each, so that the expressions of a key stand in the plan once and not for every eighth of either band
    held = held.withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(8)])))
    region, n, size, s = (F.col(c) for c in ("region", "n", "size", "s"))
    part = (size / 8).cast("int")
    return _shared(held.select("id", _around(F.col("k"), region, n, size, s, 8).alias("k"), F.substring(region, part * s + 1, n - part * 7).alias("region")))


def _variants(regions: DataFrame) -> DataFrame:
    """(id, kind, v): kind 0 is a place deleted, with the place; 1 a place deleted, of equal neighbours the first; 2 nothing deleted. So no row comes twice."""
    region = F.col("region")
    without = lambda i: F.concat(F.substring(region, F.lit(1), i - 1), F.substring(region, i + 1, F.length(region)))
    places = F.when(F.length(region) > 0, F.sequence(F.lit(1), F.length(region))).otherwise(F.expr("cast(array() as array<int>)"))
    new = F.filter(places, lambda i: (i == 1) | (F.substring(region, i, F.lit(1)) != F.substring(region, i - 1, F.lit(1))))
    variant = lambda kind, place, text: F.struct(F.lit(kind).alias("kind"), F.xxhash64("k", place, text).alias("v"))
    found = F.concat(F.transform(places, lambda i: variant(0, i, without(i))), F.transform(new, lambda i: variant(1, F.lit(0), without(i))), F.array(variant(2, F.lit(0), region)))
    return regions.select("id", F.explode(found).alias("x")).select("id", "x.kind", "x.v")


def _near(rows: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """(nh, ng) of the distinct lines that have an earlier line within one edit. rows: as _rows; firsts: first, halves and short of each distinct line."""
    place = [F.col(f"first.{c}").alias(f"w{c}") for c in ("key", "pos", "whole")]
    long = _shared(firsts.where(F.size("halves") > 0).select(*place, F.explode("halves").alias("k"))).select("wkey", "wpos", "wwhole")
    wanted = long.union(firsts.where("short").select(*place)).distinct()
    # numbered in the order of first occurrences
    wanted = wanted.repartitionByRange("wkey", "wpos", "wwhole").sortWithinPartitions("wkey", "wpos", "wwhole").withColumn("id", F.monotonically_increasing_id())
    wanted = scratch.table(wanted, "wanted")
    places = wanted.groupBy("wkey", "wwhole").agg(F.collect_list(F.struct("wpos", "id")).alias("places"))
    # always a shuffle of the texts, however few lines are wanted: a broadcast of those would end at some size
    held = rows.join(places.hint("merge"), (F.col("key") == F.col("wkey")) & (F.col("whole") == F.col("wwhole"))).withColumn("lines", F.split("text", "\n", -1))
    there = F.filter("places", lambda p: p["wpos"] < F.size("lines"))  # lines is named twice, so that it is split once and not for each place
    line = F.explode(F.transform(there, lambda p: F.struct(p["id"].alias("id"), F.btrim(F.get("lines", p["wpos"]), F.lit(SPACE)).alias("line"))))
    texts = scratch.table(held.select(line.alias("x")).select("x.id", "x.line").dropDuplicates(["id"]).withColumn("n", F.length("line")), "texts")
    longest = texts.agg(F.max("n")).first()[0] or 0
    level, k = _cut(texts.where(F.col("n") >= LEAST).select("id", F.lit(0).cast("long").alias("k"), F.col("line").alias("region"))), 0
    regions = texts.where(F.col("n") <= LEAST).select("id", F.lit(-1).cast("long").alias("k"), F.col("line").alias("region"))
    while (longest := longest // 8 + BAND) > NARROW + 1:
        level, k = scratch.table(level, f"level-{k}"), k + 1
        regions = regions.union(level.where(F.length("region") <= NARROW + 1))  # the next length goes both ways, to meet either neighbour
        level = _cut(level.where(F.length("region") > NARROW))
    variants = scratch.table(_variants(regions.union(level)), "variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("id")))
    groups = variants.groupBy("v").agg(least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2"), F.count("*").alias("c")).where("c > 1")
    groups = groups.select(F.bitwise_not(F.bitwise_not("v")).alias("vv"), "m0", "m1", "m2")
    other = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    met = variants.join(groups, F.col("v") == F.col("vv")).withColumn("other", other).where("other < id").groupBy("id").agg(F.min("other").alias("other"))
    met = scratch.table(met, "met")
    left = texts.select(F.col("id").alias("lid"), F.col("line").alias("l"))
    right = texts.select(F.col("id").alias("rid"), F.col("line").alias("r"))
    seen = met.join(left, F.col("id") == F.col("lid")).join(right, F.col("other") == F.col("rid")).where(F.levenshtein("l", "r", 1) >= 0)
    near = scratch.table(seen.select(*[c.alias(f"n{x}") for c, x in zip(_hashes("l"), "hg", strict=True)]), "near")
    for name in ("wanted", "texts", "variants", "met", *[f"level-{i}" for i in range(k)]):
        scratch.drop(name)
    return near


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """(key, whole, gone): of each document with any, the numbers of its lines that go; whole is xxhash64 of its text.

    A line goes if an earlier one, by key and then line number, equals it or (edits 1) is within one edit of it, whether that one
    stays or not. Lines are compared without the white space around them; blank ones stay."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    rows = _rows(docs, key, text)
    lines = _lines(rows)
    more = [_halves().alias("halves"), (F.col("n") <= LEAST).alias("short")] if edits else []
    marked = lines.select("key", "whole", "pos", *_hashes(), *more)
    if edits:
        marked = scratch.table(marked, "marked")
    firsts = marked.groupBy("h", "g").agg(F.min(F.struct("key", "pos", "whole")).alias("first"), F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("halves", "short") if edits])
    again = firsts.where("c > 1").select("h", "g", *[F.col(f"first.{c}").alias(f"f{c}") for c in ("key", "pos", "whole")])
    if edits:
        firsts = scratch.table(firsts, "firsts")
        near = _near(rows, firsts, scratch)
        found = firsts.join(near, (F.col("h") == F.col("nh")) & (F.col("g") == F.col("ng")), "left").where("c > 1 or nh is not null")
        # of lines near an earlier one not even the first stays
        again = found.select("h", "g", *[F.when(F.col("nh").isNull(), F.col(f"first.{c}")).alias(f"f{c}") for c in ("key", "pos", "whole")])
    again = again.withColumnsRenamed({"h": "ah", "g": "ag"})
    first = (F.col("key") == F.col("fkey")) & (F.col("pos") == F.col("fpos")) & (F.col("whole") == F.col("fwhole"))
    gone = marked.select("key", "whole", "pos", "h", "g").join(again, (F.col("h") == F.col("ah")) & (F.col("g") == F.col("ag"))).where(~F.coalesce(first, F.lit(False)))
    gone = gone.groupBy("key", "whole").agg(F.collect_set("pos").alias("gone"))
    if edits:  # a query of its own: one with all joins of this module keeps the driver's memory busy with their stages at once
        gone = scratch.table(gone, "gone")
        for name in ("marked", "firsts", "near"):
            scratch.drop(name)
    return gone


def remove_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = 1) -> DataFrame:
    """All columns of docs, the text without its repeated lines, and ``n_lines`` and ``n_removed``.

    Null texts stay null, with 0 lines; rows with a null key are never cut and cut nobody; equal rows of one key count as one document;
    columns of docs with the added names are replaced. Lines keep their order and the white space around them."""
    docs = docs.drop("n_lines", "n_removed")
    other, whole, marks, own = fresh(docs, "_key", "_whole", "_gone", "_text")
    gone = repeated_lines(docs, text, key, edits).select(F.col("key").alias(other), F.col("whole").alias(whole), F.col("gone").alias(marks))
    names = docs.columns
    joined = docs.withColumn(own, F.xxhash64(text)).join(gone, (F.col(key) == F.col(other)) & (F.col(own) == F.col(whole)), "left")
    (split,) = fresh(joined, "_lines")  # a column of its own, so that it is split once and only where lines go
    joined = joined.withColumn(split, F.when(F.col(marks).isNotNull(), F.split(F.col(text), "\n", -1)))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(marks)), lambda i: F.get(F.col(split), i)), "\n")
    new = F.when(F.col(marks).isNull(), F.col(text)).otherwise(kept)
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    counted = F.when(F.col(text).isNull(), 0).otherwise(breaks + 1)
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in names], counted.alias("n_lines"), F.coalesce(F.size(marks), F.lit(0)).alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Deletion variants of whole lines, joined on their hashes: one character deleted at the same place of both lines, or of one line only. DuckDB's
#: levenshtein counts bytes, which would take one edited letter beyond ASCII for several edits.
OP8_SQL = r"""
with lines as (
  select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as raw from documents where text is not null
), counting as (
  select doc_id, pos, trim(raw, concat(' ', chr(9), chr(13), chr(11), chr(12))) as line from lines where length(trim(raw, concat(' ', chr(9), chr(13), chr(11), chr(12)))) > 0
), firsts as (
  select line, min(struct_pack(d := doc_id, p := pos)) as f, row_number() over () as id from counting group by line
), variants as (
  select id, i as place, hash(substr(line, 1, i - 1) || substr(line, i + 1)) as v from (select id, line, unnest(range(1, length(line) + 1)) as i from firsts)
  union all select id, 0, hash(line) from firsts
), met as (
  select distinct a.id as x, b.id as y from variants a join variants b on a.v = b.v and a.id <> b.id and (a.place = b.place or a.place = 0 or b.place = 0)
), near as (
  select distinct x.line from met join firsts x on x.id = met.x join firsts y on y.id = met.y where y.f < x.f
), gone as (
  select distinct c.doc_id, c.pos from counting c join firsts f on c.line = f.line left join near n on c.line = n.line
  where n.line is not null or struct_pack(d := c.doc_id, p := c.pos) <> f.f
), kept as (
  select l.doc_id, string_agg(l.raw, chr(10) order by l.pos) filter (where g.pos is null) as text, count(*) as n_lines, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, cast(coalesce(n_lines, 0) as integer) as n_lines, cast(coalesce(n_removed, 0) as integer) as n_removed
from documents d left join kept k using (doc_id)
"""
