"""DuckDB SQL for the queries. Fields come from the generating formulas, not from parsing CIGAR, qualities or names."""

from __future__ import annotations

_ENDS = """
with recursive base as (
  select o_orderkey as k, o_custkey as c, o_orderkey % 20 as m, o_custkey % 3 as tid, 1000 + o_custkey * 101 + case when o_orderkey % 20 = 10 then 50 else 0 end as coord1,
    1000 + o_custkey * 101 + case when o_custkey % 17 = 0 then 0 else 200 + 50 * (o_orderkey % 3) end as coord2, o_custkey % 7 = 0 as rev1, o_custkey % 11 <> 0 as rev2,
    1101 + o_orderkey % 2 as tile, (o_custkey * 331) % 40000 + (o_orderkey % 5) * 60 as x, (o_custkey * 353) % 40000 + (o_orderkey % 7) * 40 as y,
    o_orderkey % 4 as clip, case when o_orderkey % 5 = 0 then 2 else 0 end as gap, o_orderkey % 50 = 49 as bad
  from orders
), roles as (
  select *, case when m in (0, 10) then 'single' when m in (1, 11) then 'half' when m = 2 then 'none' else 'pair' end as kind from base, (values (1), (2), (3)) as t(role)
  where role = 1 or (role = 2 and m not in (0, 10)) or (role = 3 and m <> 2 and k % 9 in (4, 5))
), reads as (
  select *, 4 * k + case when role = 3 then 2 when kind = 'pair' and k % 13 = 0 then 2 - role else role - 1 end as idx,
    case when role = 2 then rev2 else rev1 end as rev, case when role = 2 then coord2 else coord1 end as coord,
    kind = 'none' or (kind = 'half' and role = 2) as unmapped,
    case when kind = 'single' then false when kind in ('half', 'none') then role <> 2 else (role <> 2) <> (k % 4 = 3) end as seen_first,
    list_sum(list_filter(list_transform(range(0, 10), lambda i: (k * case when role = 2 then 37 else 31 end + i * case when role = 2 then 11 else 7 end) % 41), lambda q: q >= 15)) as quality
  from roles
), flagged as (
  select *, case when kind = 'single' then false when role = 3 and kind = 'pair' then false else seen_first end as first,
    cast(case when bad then 512 else 0 end + case kind
      when 'single' then case when rev then 16 else 0 end
      when 'half' then case when role = 2 then 133 else 73 + case when rev then 16 else 0 end end
      when 'none' then 13 + case when role = 1 then 64 else 128 end
      else 1 + case when rev then 16 else 0 end + case when case when role = 2 then rev1 else rev2 end then 32 else 0 end + case when role <> 3 and seen_first then 64 else 128 end end
    + case when role <> 3 then 0 when k % 9 = 4 then 256 else 2048 end as integer) as flag,
    10 - clip + gap as span
  from reads
), ends as (
  select k, idx, first as first_of_pair, cast(tid as integer) as tid, cast(coord as integer) as coord, rev, cast(quality - case when bad then 16384 else 0 end as integer) as score, span, clip,
    case when kind = 'pair' then cast(tid as integer) else -1 end as mate_tid, kind = 'pair' as has_mate, cast(tile as integer) as tile, cast(((x + 32768) & 65535) - 32768 as integer) as x, cast(((y + 32768) & 65535) - 32768 as integer) as y, x as rawx, y as rawy, bad
  from flagged where not unmapped and role <> 3
)"""

_PAIRS = """, met as (
  select a.k, a.idx as ai, b.idx as bi, a.tid as ta, b.tid as tb, a.coord as ac, b.coord as bc, a.rev as ar, b.rev as br, a.score + b.score as score, a.tile, a.x, a.y, b.first_of_pair as bf
  from ends a join ends b on a.k = b.k and a.has_mate and b.has_mate and a.idx < b.idx
), turned as (
  select *, tb > ta or (tb = ta and bc >= ac) as kept, case when ar and br then 4 when ar then 5 when br then 3 else 2 end as fwd, case when ar and br then 4 when br then 5 when ar then 3 else 2 end as bwd from met
), pairs as (
  select k, case when kept then ta else tb end as tid1, case when kept then ac else bc end as coord1, case when kept then ai else bi end as idx1, case when kept then tb else ta end as tid2, case when kept then bc else ac end as coord2,
    case when kept then bi else ai end as idx2, cast(case when not kept then bwd when ta = tb and ac = bc and fwd = 5 then 3 else fwd end as integer) as orient, cast(case when bf then bwd else fwd end as integer) as opt_orient, score, tile, x, y
  from turned
), members as (
  select *, row_number() over w = 1 as is_best, count(*) over g as set_size, first_value(idx1) over w as set_rep, first_value(tile) over w as kt, first_value(x) over w as kx, first_value(y) over w as ky
  from pairs window g as (partition by tid1, coord1, orient, tid2, coord2), w as (partition by tid1, coord1, orient, tid2, coord2 order by score desc, idx1, idx2)
), groups as (
  select * from members where set_size > 1
), pdup as (
  select unnest([idx1, idx2]) as idx, set_rep, set_size from groups where not is_best
)"""

_FRAGS = """, places as (
  select *, count(*) over g as n, bool_or(mate_tid <> -1) over g as paired, bool_or(mate_tid = -1) over g as single, row_number() over (partition by tid, coord, rev order by score desc, idx) as r
  from ends window g as (partition by tid, coord, rev)
), fdup as (
  select idx, paired as mixed from places where n > 1 and single and mate_tid = -1 and (paired or r > 1)
)"""

_OPTICAL = """, listed as (
  select *, count(*) over l as n_list, row_number() over (partition by tid1, coord1, orient, tid2, coord2, opt_orient order by idx1, idx2) as i, dense_rank() over (order by tid1, coord1, orient, tid2, coord2, opt_orient) as l
  from groups window l as (partition by tid1, coord1, orient, tid2, coord2, opt_orient)
), edges as (
  select a.l, a.idx1 as a, b.idx1 as b, a.n_list from listed a join listed b on a.l = b.l and a.idx1 <> b.idx1 and a.tile = b.tile and a.tile <> -1 and abs(a.x - b.x) <= 100 and abs(a.y - b.y) <= 100
  where a.n_list between 2 and 300000
), reach as (
  select idx1 as a, idx1 as b, l from listed where n_list > 3
  union select r.a, e.b, r.l from reach r join edges e on r.b = e.a and r.l = e.l
), comps as (
  select b as idx1, min(a) as comp from reach group by b
), ranked as (
  select g.*, row_number() over (partition by c.comp order by is_best desc, x, y, g.idx1) as r from listed g join comps c using (idx1)
), few as (
  select l, set_rep, n_list, kt, kx, ky, list({'idx1': idx1, 'idx2': idx2, 't': tile, 'x': x, 'y': y} order by i) as v from listed where n_list in (2, 3) group by all
), few0 as (
  select v, [list_extract(v, j).idx1 <> set_rep and list_extract(v, j).t = kt and kt <> -1 and abs(list_extract(v, j).x - kx) <= 100 and abs(list_extract(v, j).y - ky) <= 100 for j in [1, 2, 3]] as f,
    [coalesce(list_extract(v, p[1]).idx1 <> set_rep and list_extract(v, p[2]).idx1 <> set_rep and list_extract(v, p[1]).t = list_extract(v, p[2]).t and list_extract(v, p[1]).t <> -1 and abs(list_extract(v, p[1]).x - list_extract(v, p[2]).x) <= 100 and abs(list_extract(v, p[1]).y - list_extract(v, p[2]).y) <= 100, false) for p in [[1, 2], [1, 3], [2, 3]]] as p
  from few
), few1 as (
  select v, p, f[1] or (p[1] and f[2]) as a, f[2] or p[1] as b, coalesce(f[3], false) as c from few0
), few2 as (
  select v, p, a or (p[2] and c) as a, b, c or p[2] as c from few1
), few3 as (
  select v, a, b or (p[3] and c) as b, c or p[3] as c from few2
), opairs as (
  select idx1, idx2 from ranked where r > 1
  union all select v[1].idx1, v[1].idx2 from few3 where a union all select v[2].idx1, v[2].idx2 from few3 where b union all select v[3].idx1, v[3].idx2 from few3 where c
), odup as (
  select unnest([idx1, idx2]) as idx from opairs
), verdict as (
  select idx, set_rep, set_size from pdup union all select idx, null, null from fdup
), judged as (
  select v.*, o.idx is not null as is_optical from verdict v left join odup o on v.idx = o.idx
), marked as (
  select f.*, j.idx is not null as is_dup, coalesce(j.is_optical, false) as is_optical from flagged f left join judged j on f.idx = j.idx
)"""

_TAGS = "concat('NM:i:0 RG:Z:rg1', case when is_dup then case when is_optical then ' DT:Z:SQ' else ' DT:Z:LB' end else '' end{sets}, ' PG:Z:readsieve')"
_FLAG = "cast(flag + case when is_dup then 1024 else 0 end as integer) as flag"

_METRICS = """, counted as (
  select cast(count(*) filter (where not unmapped and role <> 3 and kind <> 'pair') as bigint) as unpaired_reads_examined, cast(count(*) filter (where not unmapped and role <> 3 and kind = 'pair') // 2 as bigint) as read_pairs_examined,
    cast(count(*) filter (where not unmapped and role = 3) as bigint) as secondary_or_supplementary_rds, cast(count(*) filter (where unmapped) as bigint) as unmapped_reads,
    cast(count(*) filter (where is_dup and kind <> 'pair') as bigint) as unpaired_read_duplicates, cast(count(*) filter (where is_dup and kind = 'pair') // 2 as bigint) as read_pair_duplicates, cast(count(*) filter (where is_optical) // 2 as bigint) as read_pair_optical_duplicates
  from marked
), input as (
  select cast(read_pairs_examined - read_pair_optical_duplicates as double) as n, cast(read_pairs_examined - read_pair_duplicates as double) as u from counted
), wide as (
  select 100.0::double as hi, n, u from input
  union all select hi * 10, n, u from wide where u / (hi * u) - 1 + exp(-n / (hi * u)) > 0
), halves as (
  select 0 as i, 1.0::double as lo, (select max(hi) from wide) as hi, n, u from input where n > u
  union all select i + 1, case when u / (((lo + hi) / 2) * u) - 1 + exp(-n / (((lo + hi) / 2) * u)) >= 0 then (lo + hi) / 2 else lo end, case when u / (((lo + hi) / 2) * u) - 1 + exp(-n / (((lo + hi) / 2) * u)) <= 0 then (lo + hi) / 2 else hi end, n, u from halves where i < 40
), sized as (
  select coalesce((select cast(trunc(u * (lo + hi) / 2) as bigint) from halves order by i desc limit 1), 0) as estimated_library_size
)"""

_CAND = "not unmapped and role <> 3"
_AT = "cast(coord - case when rev then 9 + gap else -clip end as integer)"


def oracle_sql() -> dict[str, str]:
    e, p, f = _ENDS, _ENDS + _PAIRS, _ENDS + _PAIRS + _FRAGS
    o = f + _OPTICAL
    m = o + _METRICS
    where = "select idx, cast(tile as integer) as tile, cast(rawx as integer) as x, cast(rawy as integer) as y from ends"
    sets = ", case when g.set_rep is null then '' else concat(' DI:i:', g.set_rep, ' DS:i:', g.set_size) end"
    return {
        "candidate_reads": f"{e} select idx, flag, cast(tid as integer) as tid from flagged where {_CAND}",
        "flag_breakdown": f"{e} select case when unmapped then 'unmapped' when role = 3 then 'secondary_or_supplementary' when kind <> 'pair' then 'unpaired' else 'paired' end as kind, count(*) as n, count(*) filter (where flag & 16 > 0) as reverse, count(*) filter (where bad) as qc_fail, count(*) filter (where flag & 64 > 0) as first, count(*) filter (where flag & 32 > 0) as mate_reverse from flagged group by 1",
        "unclipped_ends": f"{e} select idx, cast(span as integer) as reference_length, {_AT} + cast(span as integer) as \"end\", cast({_AT} - case when rev then 0 else clip end as integer) as unclipped_start, cast({_AT} + span - 1 + case when rev then clip else 0 end as integer) as unclipped_end, cast(coord as integer) as five_prime, cast(rev as integer) as strand from flagged where {_CAND}",
        "score_sum_quality": f"{e} select idx, score from ends",
        "score_ref_length": f"{e} select idx, cast(span - case when bad then 16384 else 0 end as integer) as score from ends",
        "read_name_location": f"{e} {where}",
        "read_name_location_wrapped": f"{e} select idx, tile, x, y from ends",
        "read_name_location_pattern": f"{e} select idx, tile, x, y from ends",
        "global_position": f"{e} select idx, (cast(tid as bigint) << 40) | {_AT} as packed, cast(tid as integer) as tid, {_AT} as pos from flagged where {_CAND}",
        "read_ends": f"{e} select idx, first_of_pair, tid, coord, rev, score, mate_tid, has_mate, tile, x, y, true as located from ends",
        "mate_pairs": f"{p} select concat_ws(':', 'I', k, 'F', 1, 1101 + k % 2, (o_custkey * 331) % 40000 + (k % 5) * 60, (o_custkey * 353) % 40000 + (k % 7) * 40) as qname, cast(0 as bigint) as slot, tid1, coord1, idx1, tid2, coord2, idx2, orient, opt_orient, score, tile, x, y from pairs join orders on o_orderkey = k",
        "pair_orientation": f"{p} select orient, opt_orient, count(*) as n, cast(sum(score) as bigint) as score from pairs group by all",
        "pair_groups": f"{p} select distinct tid1, coord1, orient, tid2, coord2, set_size from groups",
        "pair_representatives": f"{p} select tid1, coord1, orient, tid2, coord2, idx1 as set_rep, tile as best_tile, x as best_x, y as best_y from groups where is_best",
        "pair_duplicates": f"{p} select * from pdup",
        "frag_duplicates_mixed": f"{f} select idx from fdup where mixed",
        "frag_duplicates_unpaired": f"{f} select idx from fdup where not mixed",
        "all_duplicates": f"{f} select idx, true as is_dup, set_rep, set_size from pdup union all select idx, true, null, null from fdup",
        "duplicate_set_tags": f"{p} select unnest([idx1, idx2]) as idx, set_rep, set_size from groups",
        "optical_edges": f"{o} select a as idx1, b as other from edges where a < b",
        "optical_duplicates": f"{o} select idx from odup",
        "duplicate_verdicts": f"{o} select idx, is_optical, case when is_optical then 'SQ' else 'LB' end as dup_type, set_rep, set_size from judged",
        "annotated_reads": f"{o} select idx, {_FLAG}, {_TAGS.format(sets='')} as tags from marked",
        "annotated_set_members": f"{o}, sets as (select unnest([idx1, idx2]) as idx, set_rep, set_size from groups) select m.idx, {_FLAG}, {_TAGS.format(sets=sets)} as tags from marked m left join sets g on m.idx = g.idx",
        "annotated_no_duplicates": f"{o} select idx, {_FLAG}, {_TAGS.format(sets='')} as tags from marked where not is_dup",
        "annotated_no_sequencing_duplicates": f"{o} select idx, {_FLAG}, 'NM:i:0 RG:Z:rg1 PG:Z:readsieve' as tags from marked where not is_optical",
        "duplication_metrics": f"{m} select 'rg1' as library, counted.*, case when unpaired_reads_examined + 2 * read_pairs_examined = 0 then 0 else (unpaired_read_duplicates + 2 * read_pair_duplicates) / (unpaired_reads_examined + 2 * read_pairs_examined) end as percent_duplication, estimated_library_size from counted, sized",
        "set_size_histogram": f"{o}, s as (select set_rep, count(*) as n, count(q.idx1) as q from groups g left join opairs q on g.idx1 = q.idx1 group by set_rep), parts as (select n as set_size, 1 as a, 0 as b, 0 as c from s union all select q + 1, 0, 1, 0 from s where q > 0 union all select n - q, 0, 0, 1 from s) select set_size, cast(sum(a) as bigint) as all_sets, cast(sum(b) as bigint) as optical_sets, cast(sum(c) as bigint) as non_optical_sets from parts group by set_size",
        "estimated_library_size": f"{m} select estimated_library_size from sized",
        "roi_histogram": f"{m} select cast(bin as integer) as bin, round(estimated_library_size * (1 - exp(-(bin * read_pairs_examined) / estimated_library_size)) / (read_pairs_examined - read_pair_duplicates), 6) as coverage_mult from counted, sized, range(1, 101) as t(bin)",
    }
