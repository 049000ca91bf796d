"""Duplicate marking over a stream of coordinate-sorted alignments.

Ends wait for their mate in state keyed by read name; complete pairs wait in state keyed by their group until the stream's position
has passed every place where another member could still begin. Position within a reference serves as event time: it is mapped to a
timestamp, so the engine's watermark closes groups and drops state, and a slack in bases allows for what clipping shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readsieve import functions as R
from readsieve.operators.ends import derive_ends
from readsieve.operators.pairs import CARRIED

PAIR = "qname string, tid1 int, coord1 int, idx1 long, tid2 int, coord2 int, idx2 long, orient int, opt_orient int, score int, tile int, x int, y int"
#: Bases by which an end's unclipped place may lie behind the stream's position.
SLACK = 10_000
#: Bases that one reference may span in the mapped time, in seconds.
SPAN = 1 << 30


def position_time(tid, pos):
    """Timestamp of a position: a second a base, references one after the other."""
    return F.timestamp_seconds(tid.cast("long") * SPAN + pos)


def stream_pairs(reads: DataFrame, **options) -> DataFrame:
    """Pairs of a streaming reads table, each given out when its second end arrives. An end without a mate stays in state."""
    ends = derive_ends(reads, **options).where("has_mate").select("qname", *CARRIED)

    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(state.get)] if state.exists else []
        rows = []
        for batch in batches:
            rows += [tuple(r) for r in batch[CARRIED].itertuples(index=False)]
        waiting += sorted(rows)
        out = [_pair(key[0], waiting[i], waiting[i + 1]) for i in range(0, len(waiting) - 1, 2)]
        if len(waiting) % 2:
            state.update(tuple(v.item() if hasattr(v, "item") else v for v in waiting[-1]))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PAIR.split(", ")])

    held = "idx long, first_of_pair boolean, tid int, coord int, rev boolean, score int, tile int, x int, y int"
    return ends.groupBy("qname").applyInPandasWithState(match, PAIR, held, "append", GroupStateTimeout.NoTimeout)


def _pair(name: str, a: tuple, b: tuple) -> tuple:
    """The pair of ends a, earlier in the file, and b, given as CARRIED."""
    a, b = dict(zip(CARRIED, a, strict=True)), dict(zip(CARRIED, b, strict=True))
    code = {(False, False): R.FF, (False, True): R.FR, (True, True): R.RR, (True, False): R.RF}
    forward, swapped = code[bool(a["rev"]), bool(b["rev"])], code[bool(b["rev"]), bool(a["rev"])]
    seen = swapped if b["first_of_pair"] else forward
    ordered = (b["tid"], b["coord"]) >= (a["tid"], a["coord"])
    one, two = (a, b) if ordered else (b, a)
    orient = forward if ordered else swapped
    if ordered and (a["tid"], a["coord"]) == (b["tid"], b["coord"]) and orient == R.RF:
        orient = R.FR
    return name, one["tid"], one["coord"], one["idx"], two["tid"], two["coord"], two["idx"], orient, seen, a["score"] + b["score"], a["tile"], a["x"], a["y"]


def stream_pair_duplicates(pairs: DataFrame, slack: int = SLACK) -> DataFrame:
    """(idx, set_rep, set_size) of both ends of every pair but a group's best, given out when the watermark passes the group's last end.

    A pair's time is the place of its later end, by reference and then coordinate. One that comes later than the watermark is dropped, as
    the engine does with late rows; groups that the watermark hasn't passed when the stream ends aren't given out. State is a score and two row
    numbers for each pair of the open groups."""
    keyed = pairs.withColumn("at", position_time(F.col("tid2"), F.col("coord2"))).withWatermark("at", f"{slack} seconds")
    held = "ranks array<long>, firsts array<long>, seconds array<long>"

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ranks, firsts, seconds = (list(v) for v in state.get) if state.exists else ([], [], [])
        if state.hasTimedOut:
            state.remove()
            order = sorted(zip(ranks, firsts, seconds, strict=True))
            rows = [(i, order[0][1], len(order)) for r in order[1:] for i in r[1:]]
            yield pd.DataFrame(rows, columns=["idx", "set_rep", "set_size"])
            return
        for batch in batches:
            ranks += (-batch["score"]).tolist()
            firsts += batch["idx1"].tolist()
            seconds += batch["idx2"].tolist()
        state.update((ranks, firsts, seconds))
        closes = (int(key[3]) * SPAN + int(key[4]) + 1) * 1000
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))

    key = ["tid1", "coord1", "orient", "tid2", "coord2"]
    return keyed.groupBy(*key).applyInPandasWithState(close, "idx long, set_rep long, set_size long", held, "append", GroupStateTimeout.EventTimeTimeout)
