"""SimHash near-duplicates, linked by the general pigeonhole principle.

Fingerprints are 64 bits. Bits that go together are grouped into parts; part i gets a threshold t_i >= -1 with sum(t_i + 1) =
bound + 1, so two fingerprints within the bound agree up to t_i bits in some part (a part of threshold -1 isn't probed). The parts'
number and the thresholds are those of the smallest estimated number of candidates, found by dynamic programming over counts
of all fingerprints. Part values within their threshold are probed by an equi-join, and candidates are verified on all bits.

A part value that many fingerprints share is not paired within itself: there each fingerprint emits itself and its 64
one-bit neighbours, and those that meet at a neighbour, at most 65, are within 2 bits of each other. That is exact for bounds of 2.
Equal fingerprints are one node, so thousands of copies cost one.

components() links fingerprints; deduplicate() takes a similarity instead, of which such links are only the first candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from readsieve.llm.common import Scratch, extended, fresh, texts_in_arrow
from readsieve.llm.components import connected_components

BITS, SHINGLE, SEED, BOUND = 64, 3, 42, 2
#: Fingerprints of one part value that are paired directly; those of more go by one-bit neighbours.
PAIRED = 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at once.
BLOCK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned. Words are split at ASCII white space after lower-casing A-Z; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - k].tolist()]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        counts += _set_bits(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], "<u8"))
    return _majority(counts, len(starts))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes; none give 0."""
    counts = sum((_set_bits(hashes[at : at + BLOCK].astype("<u8")) for at in range(0, len(hashes), BLOCK)), np.zeros(BITS, np.int64))
    return _majority(counts, len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint_bits") -> DataFrame:
    """All columns of docs but the text, and the fingerprint as a signed long. A column of docs so named is replaced."""
    docs = docs.drop(name)
    place = docs.columns.index(text)
    kept = [c for c in docs.columns if c != text]
    schema = extended(docs.select(*kept), f"{name} long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(place)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(found)], names=schema.names)

    return texts_in_arrow(docs, scan, schema)


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are both set, of one partition."""
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.indices(both.shape)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "n": pa.array(both.ravel())})


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in groups of almost equal size: each starts with the free pair that correlates most, and takes the free bit that
    correlates most with it until full."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, -1)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        part = correlation[np.ix_(left, left)]
        first, second = divmod(int(part.argmax()), len(left))
        group = [left[first], left[second]]
        free -= set(group)
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: correlation[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group[:size]))
    return groups


def _probes(width: int, threshold: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(threshold + 1))


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more, one a part, whose sum(t + 1) is units and whose cost, costs[part][t + 1], is least."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
    for cost in costs:
        best = [min(((best[u - k][0] + cost[k], [*best[u - k][1], k - 1]) for k in range(min(u, len(cost) - 1) + 1)), key=lambda x: x[0]) for u in range(units + 1)]
    return best[units]


def _value(bits: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)))


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def plan(nodes: DataFrame, bound: int = BOUND, choices: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe. nodes has distinct fingerprints in column fp."""
    both = np.zeros((BITS, BITS), np.int64)
    for r in nodes.select("fp").mapInArrow(_bit_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    n = nodes.count()
    groups = {m: group_bits(both, n, m) for m in choices}
    flat = [(m, k, bits) for m, parts in groups.items() for k, bits in enumerate(parts)]
    keyed = nodes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), _value(bits).alias("v")) for i, (_, _, bits) in enumerate(flat)])).alias("x")).select("x.*")
    pairs = {r.p: float(r.c) for r in keyed.groupBy("p", "v").agg(F.count("*").alias("c")).groupBy("p").agg(F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("c")).collect()}
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    best = None
    for m in choices:
        costs = []
        for i, (_, _, bits) in ((i, x) for i, x in enumerate(flat) if x[0] == m):
            apart = np.zeros(bound + 2)  # chances that k bits of the part differ
            apart[0] = 1
            for b in bits:
                apart = np.convolve(apart, [1 - differ[b], differ[b]])[: bound + 2]
            cost = [0.0]
            for t in range(bound + 1):
                met = max(pairs.get(i, 0.0), n * n / 2 * apart[0]) * apart[: t + 1].sum() / max(apart[0], 1e-300)
                cost.append(met + 4.0 * n * _probes(len(bits), t))
            costs.append(cost)
        total, thresholds = allocate(costs, bound + 1)
        if best is None or total < best[0]:
            best = total, [(bits, t) for bits, t in zip(groups[m], thresholds, strict=True) if t >= 0]
    return best[1]


def near_links(nodes: DataFrame, scratch: Scratch, bound: int = BOUND) -> DataFrame:
    """Links (u, v) between fingerprints within the bound, enough to connect all that are; nodes has distinct ones in column fp."""
    if not 0 <= bound <= 2:
        raise ValueError("one-bit neighbours meet within 2 bits; deduplicate() finds what is farther apart")
    rows = []
    for k, (bits, threshold) in enumerate(plan(nodes, bound)):
        rows.append(nodes.select(F.lit(k).alias("part"), _value(bits).alias("key"), "fp", F.lit(False).alias("probe")))
        flips = [_mask(c) for t in range(1, threshold + 1) for c in combinations(bits, t)]
        if flips:
            own = _value(bits)
            near = F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda x: x.bitwiseXOR(own))  # noqa: B023
            rows.append(nodes.select(F.lit(k).alias("part"), F.explode(near).alias("key"), "fp", F.lit(True).alias("probe")))
    keyed = rows[0]
    for more in rows[1:]:
        keyed = keyed.union(more)
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.count(F.expr("nullif(probe, true)")).alias("own")).where("n > 1 and own > 0")
    sizes = sizes.select(F.col("part").alias("p"), F.bitwise_not(F.bitwise_not("key")).alias("k"), "n")
    met = scratch.table(keyed.join(sizes, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k"))).select("part", "key", "fp", "probe", "n"), "met")
    few = met.where(f"n <= {PAIRED}")
    other = few.select(F.col("part").alias("p"), F.col("key").alias("k"), F.col("fp").alias("g"), F.col("probe").alias("asks"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("g"))) <= bound
    paired = few.where("not probe").join(other, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")) & (F.col("asks") & (F.col("fp") != F.col("g")) | (F.col("fp") < F.col("g"))) & close).select(F.col("fp").alias("u"), F.col("g").alias("v"))
    return paired.union(_by_neighbours(met.where(f"n > {PAIRED}"), bound))


def _by_neighbours(many: DataFrame, bound: int) -> DataFrame:
    """Links of fingerprints that share a part value with many. Those meeting at a bit string, at most 65, are linked to the smallest;
    for a bound under 2 they are verified against each."""
    around = F.array(F.lit(0), *[F.lit(_mask([b])) for b in range(BITS)]) if bound else F.array(F.lit(0))
    spread = many.select("part", "key", "fp", F.explode(F.transform(around.cast("array<bigint>"), lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))
    groups = spread.groupBy("part", "key", "at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if bound == 1:  # within 1 bit: one end is the place itself
        return groups.where(F.array_contains("fps", F.col("at"))).select(F.col("at").alias("u"), F.explode("fps").alias("v")).where("u <> v").distinct()
    return groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v").distinct()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """One row a document: its key, ``fingerprint_bits`` and ``component_id``, the smallest key reachable over links.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Rows with a null key belong to their component but
    never name it. Repeated rows stay repeated. Other columns play no part."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", "fp"), "marked")
    nodes = scratch.table(marked.groupBy("fp").agg(F.min("_key").alias("first")), "nodes")
    parts = connected_components(near_links(nodes, scratch, bound), scratch)
    member = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id")).select(F.bitwise_not(F.bitwise_not("component")).alias("c"), "component_id")
    named = member.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id")
    return marked.join(named, F.col("fp") == F.col("f")).select(F.col("_key").alias(key), F.col("fp").alias("fingerprint_bits"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents without near copies, which have a Jaccard similarity of 0.8 or more on five-word shingles: of those linked by near pairs, also
    over others, the one of the smallest key stays. Links of fingerprints propose pairs and an exact join finds those that they
    can't; every pair is verified on the whole sets of shingles.

    Texts without words are copies of each other. Rows with a null key stay and play no part. Repeated rows stay repeated; rows
    that share a key and have other texts are documents of their own, of which none makes another a copy."""
    from readsieve.llm import nearcopies  # which takes fingerprints from here

    return nearcopies.deduplicate(docs, text, key)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")
