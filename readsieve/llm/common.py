"""Helpers that several training-data operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readsieve.scratch import Scratch, shared_dir

__all__ = ["Scratch", "extended", "fresh", "held_out", "shared_dir", "text_blocks", "text_slices", "texts_in_arrow"]

#: Learning rows are those whose crc32 of the id, as text, is not 2 modulo 4; the others are held out.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS) == HELD_OUT_REMAINDER


#: Rows that go to a Python worker at once where rows hold whole texts; memory on both sides follows it.
TEXT_ROWS = 500


def texts_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow for rows with whole texts: lowers the session's Arrow batch size to TEXT_ROWS first, where it is larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting, "10000")) <= TEXT_ROWS:
        df.sparkSession.conf.set(setting, str(TEXT_ROWS))
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores as make it none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with more columns."""
    return StructType([*df.schema, *StructType.fromDDL(ddl)])


def text_slices(column: pa.Array, most: int):
    """(first row, end row, texts) of ranges of about ``most`` bytes, one row at least; only one range's texts are Python objects."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, n in enumerate([*sizes, most + 1]):
        if i == len(sizes) or (i > start and held + n > most):
            if i > start:
                yield start, i, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n


def text_blocks(texts: list[str | None], most: int):
    """Ranges of rows holding about ``most`` characters, one row at least."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and chars + n > most:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)
