"""Substring dedup by sliding sentence spans.

A text is cut into sentences. One of more than PIECE words is cut further: of every PIECE consecutive words of a sentence the one of the
least hash ends a piece. So no piece is longer, and the cuts inside a passage don't depend on what stands around it. From each
sentence on, the shortest run of several consecutive ones that has enough words is hashed, by differences of running sums. Every passage of
51 words holds such a run, wherever it begins and ends: PIECE words at either end may be cut otherwise, and as many more may pass before the next cut.

Equal hashes are found by a grouped minimum over all documents, which also tells the first occurrence (smallest key, then place), and a
join gives every other occurrence back to its document. Runs carry codes of the words around them, so that the join also tells how far
the words go on agreeing with the first occurrence; what so repeats, if it is long enough, goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from readsieve.llm.common import Scratch, extended, fresh, text_slices, texts_in_arrow

#: Words of a sentence or piece at most; sentences and words of a run at least.
PIECE, SENTENCES, WORDS = 8, 2, 14
#: Words of a repeated passage that goes, at least.
PASSAGE = 51
#: Words before and behind a run that are coded, and bits of each: a word beyond a passage agrees with a chance of 1 in 8.
AROUND, CODE_BITS = 21, 3
#: Words at once where memory follows it; powers that are kept; bytes of texts that are cut at once, one text at least.
BLOCK, POWERS, AT_ONCE = 100_000, 250_000, 1_000_000

MARKS = tuple(".!?…。！？")
MARK_BYTES = tuple(mark.encode() for mark in MARKS)
#: Which characters are white space; those from the last one on aren't.
SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)


class _Known:
    """Hashes of words; the last bit tells whether the word ends a sentence."""

    def __getitem__(self, word: str) -> int:
        return int(self.of([word])[0])

    def of(self, words: list[str]) -> np.ndarray:
        """Of many words; Arrow finds the different ones and each of them is hashed once. A dict of all words so far misses the processor's caches."""
        if not words:
            return np.zeros(0, U)
        data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
        inside = data != ord(" ")
        ends = np.concatenate([[0], np.flatnonzero(~inside) - np.arange(len(words))])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(xxh3_64_intdigest, different), U, len(different))
        last = np.fromiter((word.endswith(MARK_BYTES) for word in different), bool, len(different))
        return (hashes & ~U(1) | last)[found.indices.to_numpy()]


def cuts(text: str | None, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, split at white space and in lower case; the first word of each sentence or piece, then the number of words.

    Sentences end after a word that ends with a mark, and at line breaks."""
    return _cuts([text], known)[:2]


def _cuts(texts: list[str | None], known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``cuts`` gives, of texts one behind the other, so that NumPy is called for all of them at once; and the first word of each text, then
    the number of words. No piece reaches into another text, as the end of a text ends a sentence."""
    words: list[str] = []
    breaks, firsts = [], [0]
    for text in texts:
        for line in text.lower().split("\n") if text else ():
            words += line.split()
            breaks.append(len(words))
        firsts.append(len(words))
    n = len(words)
    hashes = known.of(words)
    if not n:
        return hashes, np.zeros(1, np.int64), np.array(firsts, np.int64)
    last = (hashes & U(1)).astype(bool)
    behind = np.array(breaks, np.int64)
    last[behind[behind > 0] - 1] = True
    ends = np.concatenate([[0], np.cumsum(last)])
    order = hashes * BASES[0]
    for at in range(0, n - PIECE + 1, BLOCK):
        top = min(at + BLOCK, n - PIECE + 1)
        picked = _least(order[at : top + PIECE - 1]) + at
        inside = ends[at + PIECE - 1 : top + PIECE - 1] == ends[at:top]
        last[picked[inside]] = True
    return hashes, np.concatenate([[0], np.flatnonzero(last) + 1]), np.array(firsts, np.int64)


def _least(order: np.ndarray) -> np.ndarray:
    """The place of the least, the first of equal ones, of every PIECE consecutive values: from two shorter windows each, as argmin is slow on so few."""
    least, place, width = order, np.arange(len(order)), 1
    while width < PIECE:
        step = min(width, PIECE - width)
        first = least[:-step] <= least[step:]
        least, place = np.where(first, least[:-step], least[step:]), np.where(first, place[:-step], place[step:])
        width += step
    return place


def runs(hashes: np.ndarray, bounds: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word behind the last, and two 64-bit hashes of the shortest run of SENTENCES and WORDS or more from each sentence.

    firsts: as ``_cuts`` gives it for several texts; no run reaches into another text. Hashes don't depend on where a run begins."""
    if len(bounds) <= SENTENCES:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), U)
    starts = bounds[:-1]
    stop = np.maximum(np.searchsorted(bounds, starts + WORDS), np.arange(len(starts)) + SENTENCES)
    whole = stop < len(bounds)
    starts, stops = starts[whole], bounds[stop[whole]]
    if firsts is not None:
        whole = stops <= firsts[np.searchsorted(firsts, starts, "right")]
        starts, stops = starts[whole], stops[whole]
    found = []
    for base, inverse in zip(BASES, INVERSES, strict=True):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * _powers(base, len(hashes)), dtype=U)])
        mixed = (sums[stops] - sums[starts]) * _powers(inverse, len(hashes))[starts]
        found.append((mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9))
    return starts, stops, np.stack(found)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; POWERS are kept."""
    kept = _POWERS.get(int(base))
    if kept is None or n > len(kept):
        kept = np.full(max(n, POWERS), base, U)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if len(kept) == POWERS:
            _POWERS[int(base)] = kept
    return kept[:n]


def _around(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the AROUND words before and behind each run in its text, which is row, the nearest in the lowest bits; 0 for words that aren't there."""
    apart = AROUND * np.arange(1, len(firsts))  # each text stands between AROUND codes of 0
    codes = np.zeros(len(hashes) + AROUND * len(firsts), U)
    codes[np.arange(len(hashes)) + np.repeat(apart, np.diff(firsts))] = (hashes >> U(13)) & U((1 << CODE_BITS) - 1)
    before = _packed(codes[::-1])[len(codes) - apart[row] - starts]
    return before.view(np.int64), _packed(codes)[stops + apart[row]].view(np.int64)


def _packed(codes: np.ndarray) -> np.ndarray:
    """AROUND consecutive codes in one number, from every place on, the first in the lowest bits."""
    width = 1
    while width < AROUND:
        step = min(width, AROUND - width)
        codes = codes[:-step] | codes[step:] << U(CODE_BITS * step)
        width += step
    return codes


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        for _, _, texts in text_slices(batch.column(0), AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(runs(*_cuts(texts, known))[2][0].view(np.int64))], names=["h"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        for first, _, texts in text_slices(batch.column(2), AT_ONCE):
            hashes, bounds, firsts = _cuts(texts, known)
            starts, stops, halves = runs(hashes, bounds, firsts)
            row = np.searchsorted(firsts, starts, "right") - 1
            numbers = ((starts - firsts[row]).astype(np.int32), (stops - starts).astype(np.int32), *halves.view(np.int64), *_around(hashes, starts, stops, row, firsts))
            at = pa.array(row + first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, numbers)], names=["key", "whole", "at", "n", "h", "g", "before", "behind"])


def _agreeing(one: str, other: str):
    """How many words agree, of the codes in two columns."""
    x = F.col(one).bitwiseXOR(F.col(other))
    zeros = F.bit_count(x.bitwiseAND(-x) - 1)
    return F.when(x == 0, AROUND).otherwise((zeros / CODE_BITS).cast("int"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, whole, spans): of each document with any, [first, end) of words that occurred before, in a document of smaller key or
    earlier in its own; whole is xxhash64 of its text. Documents of one key are told apart by that; those without a key are never cut and cut nobody.

    One pass counts the runs' first hashes; a second brings the runs whose hash occurs twice, with all 128 bits and their places."""
    scratch = Scratch(docs.sparkSession, "substring")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("whole"), F.col(text).alias("text")).where("key is not null")
    twice = texts_in_arrow(rows.select("text"), _marks, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    twice = scratch.table(twice.select(F.col("h").alias("t")), "twice")
    spans = texts_in_arrow(rows, _spans, f"key {kind}, whole long, at int, n int, h long, g long, before long, behind long")
    met = scratch.table(spans.join(twice, F.col("h") == F.col("t")).drop("t"), "met")
    scratch.drop("twice")
    first = met.groupBy("h", "g").agg(F.min(F.struct("key", "whole", "at", "before", "behind")).alias("first"), F.count("*").alias("c")).where("c > 1")
    names = ("key", "whole", "at", "before", "behind")
    first = first.select(F.bitwise_not(F.bitwise_not("h")).alias("fh"), F.col("g").alias("fg"), *[F.col(f"first.{c}").alias(f"f{c}") for c in names])
    same = (F.col("key") == F.col("fkey")) & (F.col("whole") == F.col("fwhole"))
    again = met.join(first, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg"))).where(~(same & (F.col("at") == F.col("fat"))))
    start, end = F.col("at") - F.least(_agreeing("before", "fbefore"), "fat"), F.col("at") + F.col("n") + _agreeing("behind", "fbehind")
    start = F.when(same, F.greatest(start, F.least(F.col("at"), F.col("fat") + F.col("n")))).otherwise(start)  # not into the first one
    found = again.select("key", "whole", F.struct(F.greatest(start, F.lit(0)).alias("a"), end.alias("b")).alias("span"))
    return found.groupBy("key", "whole").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """All columns of docs, the text without repeated passages of ``passage`` words or more, and ``n_removed``, the sentences (or pieces of them) that
    lost words. A passage is what adjoining and overlapping repeated spans cover.

    The first occurrence, by key and place, stays. A column of docs so named is replaced. Null texts stay null and have no sentences; null
    keys are never cut and cut nobody; rows that share a key are documents of their own if their texts differ, and one if not."""
    docs = docs.drop("n_removed")
    other, whole, spans_of, own = fresh(docs, "_key", "_whole", "_spans", "_own")
    found = repeats(docs, text, key).select(F.col("key").alias(other), F.col("whole").alias(whole), F.col("spans").alias(spans_of))
    joined = docs.withColumn(own, F.xxhash64(text)).join(found, (F.col(key) == F.col(other)) & (F.col(own) == F.col(whole)), "left")
    place, names = docs.columns.index(text), docs.columns
    schema = extended(docs, "n_removed int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            column, gone = batch.column(place), np.zeros(batch.num_rows, np.int32)
            rows, starts, stops = passages(batch.column(len(names)), passage)
            if len(rows):
                new, hit = [], np.unique(rows)
                for first, end, texts in text_slices(column.take(pa.array(hit)), AT_ONCE):
                    here = slice(*np.searchsorted(rows, [hit[first], hit[end - 1] + 1]))
                    of = np.searchsorted(hit, rows[here]) - first
                    gone[hit[first:end]] = _touched(texts, known, of, starts[here], stops[here])
                    for i, text in enumerate(texts):
                        own = slice(*(np.searchsorted(of, [i, i + 1]) + here.start))
                        new.append(without(text, list(zip(starts[own].tolist(), stops[own].tolist(), strict=True))))
                mask = np.zeros(batch.num_rows, bool)
                mask[hit] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
            columns = [column if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone)], names=schema.names)

    return texts_in_arrow(joined.select(*names, spans_of), cut, schema)


def passages(spans: pa.ListArray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and word behind the last of each passage: adjoining and overlapping spans of a row as one, of ``least`` words or more; in order."""
    rows = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, rows, rows
    pairs = spans.flatten()
    a, b = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    apart = int(b.max()) + 2  # no span meets one of another row
    order = np.argsort(a := a + rows * apart, kind="stable")
    a, b = a[order], np.maximum.accumulate((b + rows * apart)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    a, b = a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]
    a, b = a[b - a >= least], b[b - a >= least]
    return a // apart, a % apart, b - a // apart * apart


def _touched(texts: list[str], known: _Known, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many sentences or pieces of each text lose words with passages; these are in order."""
    _, bounds, firsts = _cuts(texts, known)
    first = np.searchsorted(bounds, firsts[rows] + starts, "right")
    end = np.searchsorted(bounds, np.minimum(firsts[rows] + stops, firsts[rows + 1])) + 1
    end[:-1] -= first[1:] < end[:-1]  # one that two passages touch counts once
    return np.bincount(rows, end - first, len(texts)).astype(np.int32)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without words [first, end) of each span; ends may lie behind the last word."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.concatenate([[True], SPACE[np.minimum(codes, len(SPACE) - 1)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1]).reshape(-1, 2)  # of each word
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : edges[a, 0]])
        at = edges[min(b, len(edges)) - 1, 1]
    return "".join([*out, text[at:]]).strip()


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
