"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readsieve.llm import ann, decontam, langid, linededup, packing, quality, simhash, substring, tokencount, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_quality": quality.op3_quality,
        "op4_ann": ann.op4_ann,
        "op5_simhash": simhash.op5_simhash,
        "op6_substring": substring.op6_substring,
        "op7_packing": packing.op7_packing,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_warc": warc.op9_warc,
        "op10_token_counts": tokencount.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.OP2_SQL, "op8_line_dedup": linededup.OP8_SQL, "op9_warc": warc.OP9_SQL}
