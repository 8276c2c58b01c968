"""Reads as a stream: an extension, since no operator needs one. Preparation keeps no state and every count can be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cut_at_run, run_length_at


def prepared(reads: DataFrame, seq: str = "seq", code_length: int = 7) -> DataFrame:
    """Code, run of G behind it, and insert without its tail, row by row."""
    code = F.substring(seq, 1, code_length)
    return reads.withColumn("code", code).withColumn("g_run", run_length_at(F.col(seq), code_length)).withColumn("insert", cut_at_run(F.substring(F.col(seq), F.lit(code_length + 1), F.length(seq))))


def code_counts(reads: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Reads of each code in each window; a window is given out when it can't change any more."""
    return reads.withWatermark(time, late).groupBy(F.window(time, every), "code").agg(F.count("*").alias("reads"))


def first_molecules(reads: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first read of each molecule; keys are forgotten when they are `late`."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
