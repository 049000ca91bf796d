"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. The n-gram ``abc`` is the product of the vectors of its letters, that of each
letter permuted (shifted cyclically) by its place; a text is the bundle (sum) of its n-grams, counted as often as they occur; a
language is the bundle of the unit vectors of its learning texts. A text takes the language of the prototype with the largest cosine.

N-grams are those of words with a mark at either end, so a text may be cut at any non-letter and its parts summed: long texts need
bounded memory. All counts and bundles are linear, hence one pass, no shuffle of texts, and any executor's work can be redone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm.common import extended, held_out, text_blocks, text_slices, texts_in_arrow

DIMENSIONS = 512
SEED = 20_251
#: Learning texts a language at most (about: rows are taken by the hash of their id).
TRAIN_PER_LANGUAGE = 2_000
#: Characters worked on at once.
BLOCK_CHARS = 500_000
#: N-grams whose counts, a column each and a row a text, and code book are held at once.
PART = 8_192
#: Languages at most; a column with more isn't one of languages.
LANGUAGES = 10_000
#: Sums of unit vectors are exchanged as integers of this step, so that results don't depend on the order of additions.
STEP = 2.0**30
UNDETERMINED = "und"


class Profiler:
    """Turns texts into bundles. Letters get their vectors when they first occur; a vector depends on the letter alone."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.lut = np.full(0x110000, -1, np.int32)  # code point -> letter number, 0: no letter, -1: not met yet
        self.letters = np.zeros((256, dimensions), np.int8)
        self.letters[0] = self._vector(0)
        self.n = 1

    def _vector(self, code: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, code]).integers(0, 2, self.d, np.int8) * 2 - 1).astype(np.int8)

    def _learn(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            if not chr(code).isalpha():
                self.lut[code] = 0
                continue
            if self.n == len(self.letters):
                self.letters = np.vstack([self.letters, np.zeros_like(self.letters)])
            self.letters[self.n] = self._vector(code)
            self.lut[code] = self.n
            self.n += 1

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[int, str]]:
        """Texts in parts of BLOCK_CHARS at most, cut after a non-letter where there is one."""
        for row, text in enumerate(texts):
            text = text.lower() if text else ""
            while len(text) > BLOCK_CHARS:
                cut = next((i + 1 for i in range(BLOCK_CHARS - 1, BLOCK_CHARS // 2, -1) if not text[i].isalpha()), BLOCK_CHARS)
                yield row, text[:cut]
                text = text[cut:]
            if text:
                yield row, text

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row of float64 for each text; zero if it has no letter."""
        out = np.zeros((len(texts), self.d))
        pieces = list(self._pieces(texts))
        for a, b in text_blocks([p for _, p in pieces], BLOCK_CHARS):
            rows = np.array([r for r, _ in pieces[a:b]])
            np.add.at(out, rows, self._block([p for _, p in pieces[a:b]]))
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        joined = " " + " ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.lut[codes]
        if (ids < 0).any():
            self._learn(np.unique(codes[ids < 0]))
            ids = self.lut[codes]
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=-1))[: len(ids)]
        keep = ids > 0
        keep[1:] |= ids[:-1] > 0
        keep[:-1] |= ids[1:] > 0
        ids, doc = ids[keep].astype(np.int64), doc[keep]
        if len(ids) < 3:
            return np.zeros((len(texts), self.d))
        mid = ids[1:-1] > 0
        base = self.n
        grams = ((ids[:-2] * base + ids[1:-1]) * base + ids[2:])[mid]
        doc = doc[1:-1][mid]
        if base**3 <= 1 << 22:
            seen = np.zeros(base**3, np.int64)
            seen[grams] = 1
            unique = np.flatnonzero(seen)
            seen[unique] = np.arange(len(unique))
            place = seen[grams]
        else:
            unique, place = np.unique(grams, return_inverse=True)
        first, rest = np.divmod(unique, base * base)
        second, third = np.divmod(rest, base)
        out = np.zeros((len(texts), self.d))
        order = np.argsort(place, kind="stable") if len(unique) > PART else slice(None)
        place, doc = place[order], doc[order]
        for at in range(0, len(unique), PART):  # counts and the code book in parts of bounded size
            part = slice(at, at + PART)
            book = np.roll(self.letters, 2, 1)[first[part]] * np.roll(self.letters, 1, 1)[second[part]] * self.letters[third[part]]
            held = slice(*np.searchsorted(place, (at, at + PART))) if len(unique) > PART else slice(None)
            counts = np.bincount(doc[held] * len(book) + place[held] - at, minlength=len(texts) * len(book))
            out += counts.reshape(len(texts), -1).astype(np.float32) @ book.astype(np.float32)
        return out


def _units(bundles: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(bundles, axis=1, keepdims=True)
    return np.divide(bundles, norms, out=np.zeros_like(bundles), where=norms > 0)


def train(learning: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes. About ``per_language`` rows of each language are read, taken by the hash of
    their key. Rows without text or language don't count. The result has one row a language; more than LANGUAGES are refused."""
    rows = learning.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_l")).where(F.col("_l").isNotNull() & F.col("_t").isNotNull())
    sizes = rows.groupBy("_l").agg(F.count("*").alias("_n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values")
    if not sizes:
        return [], np.zeros((0, dimensions))
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r._l, r._n)])[F.col("_l")]
    share = F.pmod(F.xxhash64(F.col("_k"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(share * size < per_language).select("_l", "_t")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions, seed), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), BLOCK_CHARS):
                units = np.rint(_units(profiler.bundle(texts)) * STEP).astype(np.int64)
                for name, row in zip(langs[a:b], units, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            yield pa.RecordBatch.from_pydict({"l": pa.array([name] * dimensions), "i": pa.array(range(dimensions), pa.int32()), "v": pa.array(row)})

    total = texts_in_arrow(sample, bundles, "l string, i int, v long").groupBy("l", "i").agg(F.sum("v").alias("v"))
    got = total.collect()  # languages x dimensions
    names = sorted({r.l for r in got})
    prototypes = np.zeros((len(names), dimensions))
    where = {name: k for k, name in enumerate(names)}
    for r in got:
        prototypes[where[r.l], r.i] = r.v
    return names, _units(prototypes)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", seed: int = SEED) -> DataFrame:
    """All columns of docs, and ``lang_pred`` and ``score``, the cosine with that language's prototype cut at 0.

    Null texts and texts without letters get ``und`` and 0, as does everything if nothing was learned. Ties go to the name that
    sorts first. Columns of docs with those two names are replaced."""
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text)
    schema = extended(docs, "lang_pred string, score double")
    models = docs.sparkSession.sparkContext.broadcast(prototypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, known = Profiler(prototypes_d, seed), models.value
        for batch in batches:
            labels, scores = [], []
            for a, b, texts in text_slices(batch.column(place), BLOCK_CHARS):
                bundles = profiler.bundle(texts)
                if not names:
                    labels += [UNDETERMINED] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                cosines = _units(bundles) @ known.T
                best = np.argmax(np.round(cosines, 12), axis=1)
                none = ~bundles.any(axis=1)
                if none.any():  # a bundle can vanish by chance
                    none &= [not any(map(str.isalpha, t or "")) for t in texts]
                labels += [UNDETERMINED if z else names[k] for z, k in zip(none, best, strict=True)]
                scores += [0.0 if z else min(1.0, max(0.0, float(row[k]))) for z, k, row in zip(none, best, cosines, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    prototypes_d = prototypes.shape[1] if prototypes.ndim == 2 and len(prototypes) else DIMENSIONS
    return texts_in_arrow(docs, score, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learns from rows of docs that aren't held out and predicts for all; adds ``held_out``, ``lang_pred`` and ``score``."""
    names, prototypes = train(docs.where(~held_out(F.col(key))), text, lang, key)
    return predict(docs.withColumn("held_out", F.coalesce(held_out(F.col(key)), F.lit(False))), names, prototypes, text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    names, prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    asked = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict(asked, names, prototypes).drop("text")
