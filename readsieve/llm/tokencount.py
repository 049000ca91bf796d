"""Token counts of flat, unindexed token files, by a scan for the end-of-document identifier.

A token file is nothing but little-endian unsigned 16- or 32-bit token ids; an end-of-document id follows each document. Files are
cut into blocks of fixed size. One vectorised comparison finds the separators of a block; each separator but a block's first has
its document's start in the same block. Across blocks, counts and last separators are combined by a prefix scan in two levels (blocks of a
group, groups of a file), so neither a huge file nor a document longer than many blocks lands in one task.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readsieve.llm.common import Scratch, extended, text_slices, texts_in_arrow

BLOCK_TOKENS = 4 << 20
#: Blocks of a file that are scanned together before groups are.
GROUP_BLOCKS = 256
TOKENIZER = "byte_bpe_50k.tiktoken"
END = 50_256
FILE_TOKENS = 64 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the named vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, folder: str, text: str = "text", vocabulary: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Tokenises docs into flat files of ``folder``, a task writing files of its own, and gives where each document went: the other
    columns of docs, ``file`` and ``ordinal``, its place among the file's documents. Null and empty texts are documents of no token.
    The files of a task that ran twice stay, but only those named in the result count."""
    docs = docs.drop("file", "ordinal")
    place, kept = docs.columns.index(text), [c for c in docs.columns if c != text]
    schema = extended(docs.select(*kept), "file string, ordinal long")
    path = vocabulary or tokenizer_path()
    width = "<u2" if end < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (system, root) = _encoder(path).encode_ordinary_batch, _fs(folder)
        out, name, size, count = None, "", 0, 0
        try:
            for batch in batches:
                files, ordinals = [], []
                for a, b, texts in text_slices(batch.column(place), 1 << 20):
                    if out is None or size >= file_tokens:
                        if out:
                            out.close()
                        name, size, count = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = system.open_output_stream(f"{root}/{name}")
                    flat = np.concatenate([np.append(np.array(ids, width), np.array(end, width)) for ids in encode([t or "" for t in texts], num_threads=1)])
                    out.write(flat.tobytes())
                    size += len(flat)
                    files += [name] * (b - a)
                    ordinals += range(count, count + b - a)
                    count += b - a
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())], names=schema.names)
        finally:
            if out:
                out.close()

    return texts_in_arrow(docs, write, schema)


def _scan(ids: np.ndarray, end: int) -> np.ndarray:
    """Places of the separators."""
    return np.flatnonzero(ids == end)


def count_tokens(spark: SparkSession, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS, names: DataFrame | None = None) -> DataFrame:
    """file, ordinal, first (place of its first token), n_tokens and ended, of each document of the token files in ``folder``.

    Two separators in a row hold a document without tokens; tokens after the last separator are a document that hasn't ``ended``; an
    empty file has none. Bytes beyond the last whole id are no token. ``names`` (file string) restricts the files, repeats counting once."""
    from pyarrow import fs

    width = 2 if end < 1 << 16 else 4
    scratch = Scratch(spark, "tokencount")
    system, root = _fs(folder)
    listed = [(x.base_name, x.size // width) for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File and x.size >= width]
    files = spark.createDataFrame(listed, "file string, tokens long")
    if names is not None:
        files = files.join(names.select(F.col("file").alias("named")).distinct(), F.col("file") == F.col("named"), "left_semi")
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block_tokens}"))).alias("block"), "tokens")
    tasks = max(spark.sparkContext.defaultParallelism * 2, -(-sum(n for _, n in listed) // (block_tokens * 4)))
    blocks = blocks.repartition(tasks, "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _fs(folder)
        for batch in batches:
            for file, block, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = block * block_tokens
                with source.open_input_file(f"{base}/{file}") as data:
                    ids = np.frombuffer(data.read_at(min(block_tokens, tokens - at) * width, at * width), f"<u{width}")
                ends = _scan(ids, end).astype(np.int64) + at
                last = len(ends) and at + len(ids) == tokens and int(ends[-1]) == tokens - 1
                whole = at + len(ids) < tokens or last  # no tail that lacks its separator
                stops = ends if whole else np.append(ends, tokens)
                before = np.concatenate([[-1], ends])[: len(stops)]
                n = len(stops)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.string()), "block": pa.array(np.full(n, block)), "k": pa.array(np.arange(n)), "stop": pa.array(stops), "before": pa.array(before), "ended": pa.array(stops < tokens)})
                if not n:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), "block": pa.array([block], pa.int64()), "k": pa.array([-1], pa.int64()), "stop": pa.array([-1], pa.int64()), "before": pa.array([-1], pa.int64()), "ended": pa.array([False])})

    found = scratch.table(blocks.mapInArrow(scan, "file string, block long, k long, stop long, before long, ended boolean"), "found")
    return _stitch(found, scratch)


def _stitch(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Gives each block the separators and the last separator before it."""
    sums = found.groupBy("file", "block").agg(F.sum(F.expr("cast(k >= 0 and ended as long)")).alias("n"), F.max(F.expr("if(k >= 0 and ended, stop, -1)")).alias("last"))
    sums = sums.withColumn("part", F.expr(f"block div {GROUP_BLOCKS}"))
    groups = sums.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    outer = groups.select(F.col("file").alias("f"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead("file", "part")), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(ahead("file", "part")), F.lit(-1)).alias("last0"))
    inner = sums.select("file", "part", "block", F.coalesce(F.sum("n").over(ahead("file", "part", "block")), F.lit(0)).alias("n1"), F.coalesce(F.max("last").over(ahead("file", "part", "block")), F.lit(-1)).alias("last1"))
    carried = inner.join(outer, (F.col("file") == F.col("f")) & (F.col("part") == F.col("p"))).select("f", F.col("block").alias("b"), (F.col("n0") + F.col("n1")).alias("skip"), F.greatest("last0", "last1").alias("carry"))
    carried = scratch.table(carried, "carried")
    rows = found.where("k >= 0").join(carried, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    before = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.col("before"))
    rows = rows.select("file", (F.col("skip") + F.col("k")).alias("ordinal"), (before + 1).alias("first"), (F.col("stop") - before - 1).alias("n_tokens"), "ended")
    return rows


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, and their tokens counted from these: doc_id, n_tokens."""
    scratch = Scratch(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch.path("files")
    system, root = _fs(folder)
    system.create_dir(root, recursive=True)
    written = scratch.table(write_tokens(docs, folder), "written")
    counted = count_tokens(spark, folder, names=written).select(F.col("file").alias("f"), F.col("ordinal").alias("o"), "n_tokens")
    return written.join(counted, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select("doc_id", "n_tokens")
