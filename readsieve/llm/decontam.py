"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every run of words of every benchmark item. Walking a document's words through it gives, at each word, the
length of the longest run ending there that some item holds. Where that length reaches the window (13 words, or all words of a
shorter item), the window's words are hit; suffix links lead to the items that hold it.

Test items are cut into shards of bounded size, each broadcast on its own. Every task walks its documents, some at a time, through one shard's
automaton after the other and merges the hits. So no broadcast grows with the benchmark, documents are read once however many
shards there are, and nothing is shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm.common import extended, texts_in_arrow

WINDOW = 13
#: UTF-8 bytes of test items that one automaton is built of, and so the size of a broadcast.
SHARD_BYTES = 2_000_000
#: Bytes of documents that go through one shard's automaton before the next one's is built, where there are several.
HELD_BYTES = 32_000_000
#: A document is contaminated if hits are one word in so many at least.
COVERAGE = 20

#: Lower-cases A-Z and puts a space for every ASCII byte that isn't a letter or digit; other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, of items given as (id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        paths = []
        for _, tokens in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
            last = 0
            for c in numbers:
                last = self._extend(last, c)
            paths.append(numbers)
        self._mark([i for i, _ in items], paths)

    def _extend(self, last: int, c: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        if (q := nxt[last].get(c)) is not None:  # the run exists already, from another item
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, ids: list[int], paths: list[list[int]]) -> None:
        """Gives each state the windows that its longest run ends with: their items, and the length of the longest."""
        full: dict[int, set[int]] = {}  # by the state of a 13-word window
        short: dict[int, set[int]] = {}  # by the state of an item of fewer words
        self.shortest = self.window
        for item, numbers in zip(ids, paths, strict=True):
            state, matched = 0, 0
            for c in numbers:
                state, matched = self.next[state][c], matched + 1
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= self.window:
                    full.setdefault(state, set()).add(item)
            if 0 < len(numbers) < self.window:
                short.setdefault(self._exact(numbers), set()).add(item)
                self.shortest = min(self.shortest, len(numbers))
        # states in order of length: a link is always shorter, so its marks are complete
        self.spans: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.spans[self.link[state]]
            if state in full and self.length[self.link[state]] < self.window:
                above = (*above, (self.window, frozenset(full[state])))
            elif state in short:
                above = (*above, (self.length[state], frozenset(short[state])))
            self.spans[state] = above

    def _exact(self, numbers: list[int]) -> int:
        state = 0
        for c in numbers:
            state = self.next[state][c]
        return state

    def walk(self, numbers: list[int]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(last word, words, items) of each window that ends in numbers."""
        nxt, link, length, spans = self.next, self.link, self.length, self.spans
        state = matched = 0
        for i, c in enumerate(numbers):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            for n, items in spans[state]:
                if n <= matched:
                    yield i, n, items

    def search(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint hit spans [first, end) of words, in order, and the items with an occurring window.

        Words that no item holds break every run, so only the runs between them that can hold a window are walked."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        breaks = np.concatenate([[-1], np.flatnonzero(numbers < 0), [len(tokens)]])
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for k in np.flatnonzero(np.diff(breaks) - 1 >= self.shortest):
            start = int(breaks[k]) + 1
            for i, n, items in self.walk(numbers[start : int(breaks[k + 1])].tolist()):
                found |= items
                first, end = start + i + 1 - n, start + i + 1
                while hits and first <= hits[-1][1]:
                    first = min(first, hits.pop()[0])
                hits.append((first, end))
        return hits, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def shards(items: DataFrame, item_id: str, text: str, most: int = SHARD_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Test items in lists of about ``most`` bytes, fetched one list at a time. Null and word-less items have no window."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs, and ``n_words`` long, ``hits`` array of (first, end) word spans, disjoint and in order, and ``items``,
    the sorted ids of the items with an occurring window. Columns of docs so named are replaced.

    Null and empty texts have no words and no hits; rows may repeat and keys play no part; an empty benchmark gives no hits."""
    docs = docs.drop("n_words", "hits", "items")
    schema = extended(docs, "n_words long, hits array<struct<first:int,end:int>>, items array<long>")
    spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    walk = _walker(docs, items, text, item_id, item_text, window, shard_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, hits, found in walk(batches):
            of = pa.array([[{"first": a, "end": b} for a, b in h] for h in hits], spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), of, pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], names=schema.names)

    return texts_in_arrow(docs, scan, schema)


def _walker(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, shard_bytes: int):
    """A function for tasks: of batches of docs it gives each one with the rows' numbers of words, hit spans and items found."""
    place = docs.columns.index(text)
    sent = [docs.sparkSession.sparkContext.broadcast({"items": shard}) for shard in shards(items, item_id, item_text, shard_bytes)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[tuple[int, int]]], list[set[int]]]]:
        for held in _bundles(batches, HELD_BYTES if len(sent) > 1 else 0):
            counts = [[0] * b.num_rows for b in held]
            hits: list[list[list[tuple[int, int]]]] = [[[] for _ in c] for c in counts]
            found: list[list[set[int]]] = [[set() for _ in c] for c in counts]
            for shard in sent:
                automaton = _automaton(shard.value, window, keep=len(sent) == 1)
                for k, batch in enumerate(held):
                    for row, t in enumerate(batch.column(place)):
                        tokens = words(t.as_py())
                        more, ids = automaton.search(tokens)
                        counts[k][row] = len(tokens)
                        if more:
                            hits[k][row] = merged(hits[k][row] + more)
                            found[k][row] |= ids
            yield from zip(held, counts, hits, found, strict=True)

    return walk


def _bundles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most`` bytes, one at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield held
            held = []
    if held:
        yield held


def _automaton(shard: dict, window: int, keep: bool) -> Automaton:
    """Of the items in a broadcast; kept with them, for the worker's next tasks, if wanted."""
    found = shard.get(window) or Automaton([(i, words(t)) for i, t in shard["items"]], window)
    if keep:
        shard[window] = found
    return found


def digest(found: DataFrame) -> DataFrame:
    """The columns n_hit, n_items, items_sha256 and contaminated, of those that search() adds."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(named, 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words")))


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", coverage: int = COVERAGE, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents without benchmark passages: those of which one word in ``coverage`` or more is hit go; from the others the hit
    words go, with what stands between them. Columns stay as they are. Null and clean texts stay untouched."""
    names, place = docs.columns, docs.columns.index(text)
    walk = _walker(docs, items, text, item_id, item_text, window, shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, hits, _ in walk(batches):
            n_hit = [sum(b - a for a, b in h) for h in hits]
            stay = [not n or n * coverage < of for n, of in zip(n_hit, counts, strict=True)]
            column = batch.column(place)
            if any(n and s for n, s in zip(n_hit, stay, strict=True)):
                column = pa.array([without(t.as_py(), h) if h and s else t.as_py() for t, h, s in zip(column, hits, stay, strict=True)], pa.string())
            columns = [column if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay))

    return texts_in_arrow(docs, cut, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without words [first, end) of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edges = np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : starts[first]])
        at = ends[end - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(search(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Windows of benchmark words, joined with those of documents of the same length.
OP2_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), item_windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from item_words where len(w) > 0)
), doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), sizes as (select distinct n from item_windows
), doc_windows as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words cross join sizes where len(w) >= n)
), found as (
  select d.doc_id, d.i, d.n, m.item_id from doc_windows d join item_windows m on d.n = m.n and d.g = m.g
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words d left join hit using (doc_id) left join named using (doc_id)
"""
