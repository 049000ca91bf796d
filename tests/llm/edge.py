"""Awkward documents that every operator on texts must take."""

from pyspark.sql import functions as F

LONG = "word " * 60_000 + "the end. " + "x" * 300_000
TEXTS = [
    (1, "The first document has a line.\nIt has another line of text here.", "en"), (2, None, "en"), (3, "", "en"), (4, " \n\t \n", None), (5, "12345 !!! ???", "en"),
    (6, "ünïcödé 漢字かな交じり文 😀 é İstanbul", "xx"), (7, LONG, "en"), (8, "The first document has a line.\nIt has another line of text here.", "en"), (8, "The first document has a line.\nIt has another line of text here.", "en"),
    (None, "A document without an id, yet with words in it.", "en"), (9, "a", None), (10, "\n".join(["The same long line again and again."] * 5), "en"), (-5, "negative ids are ids\x00with a zero byte", "de"),
]
#: Names that operators use inside.
CLASHES = ["_key", "_spans", "key", "h", "g", "k", "n", "v", "fp", "first", "component", "hits", "items", "n_words", "score", "lang_pred", "predicted", "held_out", "n_removed", "n_lines", "_gone", "_text", "_whole", "_copy", "bucket", "slot", "batch_id", "file", "ordinal", "fingerprint_bits", "component_id", "whole", "pos", "line", "a", "b", "value"]


def documents(spark, rows=TEXTS):
    """doc_id, text, lang, and columns with clashing names."""
    df = spark.createDataFrame([(i, t, g, "src", len(t) if t else 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def plain(spark, rows=TEXTS):
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
