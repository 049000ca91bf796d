"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of hashed trigrams of its shape (runs of lower case, upper case, digits, spaces
and each punctuation mark, with their lengths in steps), damped, weighted by rarity and projected on the leading singular vectors
of the labelled sample. Each document's vector meets every labelled vector in a blocked matrix product; the nearest vote with a
weight that grows with their cosine. The labelled sample is bounded (``PER_CLASS`` rows a class), hence so is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.llm.common import extended, held_out, text_blocks, text_slices, texts_in_arrow

#: Labelled rows a class at most (about: rows are taken by the hash of their id). Their weights restore the classes' shares.
PER_CLASS = 2_000
#: Buckets of byte trigrams and as many of shape trigrams; a power of 2.
BUCKETS = 2_048
LATENT = 64
NEIGHBOURS = 60
TEMPERATURE = 0.05
THRESHOLD = 0.7
BLOCK_CHARS = 500_000
SEED = 7

#: Classes of bytes: 1 lower case (and all beyond ASCII), 2 upper case, 3 digit; others stand for themselves.
SHAPES = np.array([2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint32)


def _hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray, buckets: int) -> np.ndarray:
    mixed = a.astype(np.uint32) * np.uint32(2654435761) ^ b.astype(np.uint32) * np.uint32(2246822519) ^ c.astype(np.uint32) * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    return (mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def features(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """Counts, float32, one row a text. Texts of any length are counted in parts of about BLOCK_CHARS bytes."""
    out = np.zeros((len(texts), 2 * buckets), np.float32)
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    pieces = [(i, raw[max(0, at - 2) : at + BLOCK_CHARS]) for i, raw in enumerate(raws) for at in range(0, len(raw), BLOCK_CHARS)]
    for a, b in text_blocks([p for _, p in pieces], BLOCK_CHARS):
        rows = np.array([i for i, _ in pieces[a:b]])
        lengths = np.array([len(p) for _, p in pieces[a:b]])
        data = np.frombuffer(b"".join(p for _, p in pieces[a:b]), np.uint8)
        doc = np.repeat(rows, lengths)
        if len(data) >= 3:
            same = doc[:-2] == doc[2:]
            at = _hashed(data[:-2], data[1:-1], data[2:], buckets)[same] + doc[:-2][same] * 2 * buckets
            low, high = int(rows[0]), int(rows[-1]) + 1
            out[low:high] += np.bincount(at - low * 2 * buckets, minlength=(high - low) * 2 * buckets).reshape(high - low, -1)
        shape = SHAPES[data]
        starts = np.flatnonzero(np.concatenate([[True], (shape[1:] != shape[:-1]) | (doc[1:] != doc[:-1])]))
        runs = np.diff(np.append(starts, len(data)))
        symbol = shape[starts] * np.uint32(8) + np.minimum(7, np.log2(runs).astype(np.uint32) + 1).astype(np.uint32)
        doc = doc[starts]
        if len(symbol) >= 3:
            same = doc[:-2] == doc[2:]
            at = _hashed(symbol[:-2], symbol[1:-1], symbol[2:], buckets)[same] + buckets + doc[:-2][same] * 2 * buckets
            low, high = int(rows[0]), int(rows[-1]) + 1
            out[low:high] += np.bincount(at - low * 2 * buckets, minlength=(high - low) * 2 * buckets).reshape(high - low, -1)
    return out


@dataclass
class Model:
    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _units(_units(_damped(counts) * self.rarity) @ self.projection)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its cosine; the share of all where no cosine counts."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = float(self.weights @ self.labels / self.weights.sum())
        cosines = self.latent(counts) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < cosines.shape[1] else np.broadcast_to(np.arange(k), cosines.shape)
        got = np.take_along_axis(cosines, near, 1).astype(np.float64)
        votes = np.exp((got - 1) / TEMPERATURE) * self.weights[near] * (got > 0)
        for_one = (votes * self.labels[near]).sum(1)
        return np.clip((for_one + 1e-9 * prior) / (votes.sum(1) + 1e-9), 0, 1)


def _damped(counts: np.ndarray) -> np.ndarray:
    half = counts.shape[1] // 2
    shares = np.concatenate([part / np.maximum(part.sum(1, keepdims=True), 1) for part in (counts[:, :half], counts[:, half:])], axis=1)
    return np.sqrt(shares, out=shares)


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit_rows(counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, latent: int = LATENT, seed: int = SEED) -> Model:
    """Randomised truncated SVD of the weighted sample."""
    n = len(labels)
    rarity = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    rows = _units(_damped(counts) * rarity)
    width = min(latent + 16, *rows.shape) if n else 0
    start = rows.T @ (rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], width), np.float32)) if n else np.zeros((rows.shape[1], 0), np.float32)
    for _ in range(3):
        start = rows.T @ (rows @ np.linalg.qr(start)[0])
    basis = np.linalg.qr(start)[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False) if n else (None, None, np.zeros((0, 0), np.float32))
    projection = (basis @ turn.T)[:, :latent].astype(np.float32)
    return Model(rarity, projection, _units(rows @ projection), labels.astype(np.float64), weights.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", per_class: int = PER_CLASS, buckets: int = BUCKETS, seed: int = SEED) -> Model:
    """Fits on about ``per_class`` rows of each class (0 and 1) of labels, taken by the hash of their key, and the texts of docs with
    these keys; of several rows with a key one counts. Rows with another or no label don't count; null texts count as empty. The sample of labels, bounded by that
    parameter, is broadcast to the texts."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")
    sizes = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.col("_k"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.when(F.col("_y") == 1, F.lit(per_class / max(sizes.get(1, 0), 1))).otherwise(F.lit(per_class / max(sizes.get(0, 0), 1)))
    sample = known.where(share < wanted).limit(4 * per_class)
    rows = docs.select(F.col(key).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(sample), F.col("_d") == F.col("_k")).select("_k", "_t", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), BLOCK_CHARS):
                found = features(texts, buckets)
                yield pa.RecordBatch.from_pydict({"k": batch.column(0)[a:b].cast(pa.string()), "y": batch.column(2)[a:b], "x": pa.array([row.astype("<f4").tobytes() for row in found], pa.binary())})

    # ids may repeat in docs: one row for each label, so that no more come here than labels were sampled
    got = texts_in_arrow(rows, count, "k string, y int, x binary").groupBy("k", "y").agg(F.min("x").alias("x")).toArrow().to_pydict()
    order = sorted(range(len(got["k"])), key=lambda i: (got["k"][i] or "", got["y"][i]))
    labels = np.array([got["y"][i] for i in order], np.int64)
    counts = np.frombuffer(b"".join(got["x"][i] for i in order), "<f4").reshape(len(order), 2 * buckets) if order else np.zeros((0, 2 * buckets), np.float32)
    weights = np.array([sizes[y] / max(1, int((labels == y).sum())) for y in labels], np.float64)
    return fit_rows(counts, labels, weights / max(weights.sum(), 1), seed=seed)


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and ``score`` from 0 to 1 and ``predicted``, 1 where the score reaches the threshold. Columns so named are
    replaced. Null and empty texts get the share of label 1 among all; if nothing was learned, every score is 0.5."""
    docs = docs.drop("score", "predicted")
    place, schema, buckets = docs.columns.index(text), extended(docs, "score double, predicted int"), len(model.rarity) // 2
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known.score(features(texts[i : i + 256], buckets)) for _, _, texts in text_slices(batch.column(place), BLOCK_CHARS) for i in range(0, len(texts), 256)]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return texts_in_arrow(docs, score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    model = train(docs, labels, label="quality")
    asked = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return predict(asked, model).drop("text")
