"""Alignments derived from the star schema: one order is one template. They exercise every operator without sequencing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
select o_orderkey as k, cast(o_custkey as bigint) as c, o_orderkey % 20 as m, o_custkey % 3 as tid,
  1000 + o_custkey * 101 + if(o_orderkey % 20 = 10, 50, 0) as coord1,
  1000 + o_custkey * 101 + if(o_custkey % 17 = 0, 0, 200 + 50 * (o_orderkey % 3)) as coord2,
  o_custkey % 7 = 0 as rev1, o_custkey % 11 <> 0 as rev2,
  concat_ws(':', 'I', o_orderkey, 'F', 1, 1101 + o_orderkey % 2, (o_custkey * 331) % 40000 + (o_orderkey % 5) * 60, (o_custkey * 353) % 40000 + (o_orderkey % 7) * 40) as qname,
  o_orderkey % 4 as clip, if(o_orderkey % 5 = 0, 2, 0) as gap, o_orderkey % 50 = 49 as bad
from orders
"""

# role: 1 and 2 the ends, 3 a secondary or supplementary alignment of end 1
_READS = """
select *, role = 1 and m not in (0, 10) and k % 4 <> 3 or role = 1 and m in (1, 11) or role = 2 and m not in (1, 11) and k % 4 = 3 as first,
  if(role = 2, rev2, rev1) as rev, if(role = 2, coord2, coord1) as coord, if(role = 2, 37, 31) as qa, if(role = 2, 11, 7) as qb
from (select *, explode(array(1, 2, 3)) as role from base)
where role = 1 or role = 2 and m not in (0, 10) or role = 3 and m <> 2 and k % 9 in (4, 5)
"""

_FIELDS = """
select
  4 * k + case when role = 3 then 2 when m not in (0, 1, 2, 10, 11) and k % 13 = 0 then 2 - role else role - 1 end as idx,
  qname,
  cast(if(bad, 512, 0) + case
    when m in (0, 10) then if(rev, 16, 0)
    when m in (1, 11) then if(role = 2, 1 + 4 + 128, 1 + 8 + 64 + if(rev, 16, 0))
    when m = 2 then 1 + 4 + 8 + if(role = 1, 64, 128)
    else 1 + if(rev, 16, 0) + if(if(role = 2, rev1, rev2), 32, 0) + if(first, 64, 128) end
    + if(role = 3, if(k % 9 = 4, 256, 2048), 0) as int) as flag,
  cast(if(m = 2, -1, tid) as int) as tid,
  cast(case when m = 2 then -1 when m in (1, 11) and role = 2 then coord1 when rev then coord - 9 - gap else coord + clip end as int) as pos,
  60 as mapq,
  case when m = 2 or m in (1, 11) and role = 2 then '*'
    when rev then concat(if(gap > 0, concat('4M', gap, 'D', 6 - clip, 'M'), concat(10 - clip, 'M')), if(clip > 0, concat(clip, 'S'), ''))
    else concat(if(clip > 0, concat(clip, 'S'), ''), if(gap > 0, concat('4M', gap, 'D', 6 - clip, 'M'), concat(10 - clip, 'M'))) end as cigar,
  cast(if(m in (0, 10, 2), -1, tid) as int) as mtid, cast(if(m in (0, 10, 2), -1, if(role = 2, coord1, coord2)) as int) as mpos, 0 as tlen,
  'ACGTACGTAC' as seq,
  array_join(transform(sequence(0, 9), i -> chr(33 + (k * qa + i * qb) % 41)), '') as qual,
  if(k % 23 = 0, array('NM:i:0', 'DT:Z:LB', 'RG:Z:rg1'), array('NM:i:0', 'RG:Z:rg1')) as tags, 'rg1' as rg
from reads
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads table of ``orders``: unpaired, half-mapped, unmapped and paired templates, with clips, gaps and extra alignments."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cores = spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:  # a small file is one split, yet several cores' work
        orders = orders.repartition(cores, "o_orderkey")
    base = spark.sql(_BASE.replace("from orders", "from {orders}"), orders=orders)
    ends = spark.sql(_READS.replace("from base", "from {base}"), base=base)
    return spark.sql(_FIELDS.replace("from reads", "from {reads}"), reads=ends)
