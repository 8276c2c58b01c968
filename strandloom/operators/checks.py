"""Checks of results: each gives rows (check, passed, detail) and never raises by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(frame: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One check as aggregates of a frame."""
    return frame.agg(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def conserved(frame: DataFrame, name: str, whole: str, parts: list[str]) -> DataFrame:
    """Parts add up to the whole in every row."""
    off = F.sum(F.abs(F.col(whole) - sum((F.col(p) for p in parts), F.lit(0))))
    return check(frame, name, off == 0, off)


def hundred_percent(frame: DataFrame, name: str, by: list[str], share: str, tolerance: float = 0.05) -> DataFrame:
    """Shares of each group add up to 100."""
    sums = frame.groupBy(*by).agg(F.abs(100 - F.sum(share)).alias("_off"))
    return check(sums, name, F.max("_off") <= tolerance, F.round(F.max("_off"), 6))


def same_keys(declared: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """Found keys are the declared ones, once each."""
    counts = found.groupBy(key).agg(F.count("*").alias("_n"))
    both = declared.select(key, F.lit(True).alias("_d")).join(counts, key, "full")
    wrong = F.count_if(F.col("_d").isNull() | F.col("_n").isNull() | (F.col("_n") > 1))
    return check(both, name, wrong == 0, wrong)


def reconciled(each: DataFrame, pooled: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Sums over units are the pooled values."""
    sums = each.groupBy(*key).agg(F.sum(value).alias("_sum"))
    both = sums.join(pooled.select(*key, F.col(value).alias("_pool")), key, "full")
    wrong = F.count_if(~F.col("_sum").eqNullSafe(F.col("_pool")))
    return check(both, name, wrong == 0, wrong)


def nested(frame: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Each column is at most the one before it."""
    wrong = F.count_if(reduce(lambda a, b: a | b, (F.col(y) > F.col(x) for x, y in zip(columns, columns[1:]))))
    return check(frame, name, wrong == 0, wrong)


def declared_codes(counts: DataFrame, code: str, reads: str, declared: str, least_share: float = 0.001, most_other: float = 0.005) -> DataFrame:
    """Each declared code has max(1, a share) of the reads, and the others together not more than theirs."""
    everything = counts.agg(F.sum(reads).alias("_all"))
    rows = counts.crossJoin(F.broadcast(everything))
    few = F.count_if(F.col(declared) & (F.col(reads) < F.greatest(F.lit(1.0), least_share * F.col("_all"))))
    other = F.sum(F.when(~F.col(declared), F.col(reads)).otherwise(0)) / F.max("_all")
    return check(rows, "declared codes", (few == 0) & (other <= most_other), F.concat_ws(" ", few.cast("string"), F.round(other, 6).cast("string")))


def offset_probe(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, reach: int = 1) -> DataFrame:
    """Rows of `left` found in `right` for each shift of start and end: only (0, 0) should match well.

    The shifts are few and known, so each row asks once for each; the join is on all keys.
    """
    shifts = F.array(*(F.struct(F.lit(a).alias("ds"), F.lit(b).alias("de")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))
    asked = left.select(*keys, start, end).distinct().withColumn("_s", F.explode(shifts)).select(*keys, (F.col(start) + F.col("_s.ds")).alias(start), (F.col(end) + F.col("_s.de")).alias(end), "_s.ds", "_s.de")
    known = right.select(*keys, start, end).distinct().withColumn("_hit", F.lit(1))
    return asked.join(known, [*keys, start, end], "left").groupBy("ds", "de").agg(F.count("*").alias("asked"), F.count("_hit").alias("matched"))


def some_denominator(frame: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """No row in which all parts of a denominator are 0."""
    nothing = reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit(0)) == 0 for c in columns))
    return check(frame, name, F.count_if(nothing) == 0, F.count_if(nothing))


def not_all_zero(frame: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Each column has a value above 0 somewhere."""
    empty = sum((F.when(F.coalesce(F.max(c), F.lit(0)) <= 0, 1).otherwise(0) for c in columns), F.lit(0))
    return check(frame, name, empty == 0, empty)


def kept_within(frame: DataFrame, name: str, kept: str, whole: str, tolerance: float = 0.02) -> DataFrame:
    """No row keeps more than it had, and the sums agree within the tolerance."""
    more = F.count_if(F.col(kept) > F.col(whole))
    off = F.abs(F.sum(kept) - F.sum(whole)) / F.sum(whole)
    return check(frame, name, (more == 0) & (off <= tolerance), F.concat_ws(" ", more.cast("string"), F.round(off, 6).cast("string")))


def right_direction(codes: DataFrame, name: str, share: str, reads: str, least: int = 50, fail: float = 0.5, note: float = 0.7) -> DataFrame:
    """No code with enough reads has less than `fail` of its declared species; those below `note` are told."""
    enough = F.col(reads) >= least
    low, doubtful = F.count_if(enough & (F.col(share) < fail)), F.count_if(enough & (F.col(share) >= fail) & (F.col(share) < note))
    return check(codes, name, low == 0, F.concat_ws(" ", low.cast("string"), doubtful.cast("string")))


def proportional(frame: DataFrame, name: str, by: list[str], a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    """a and b have the same shares of their sums in each group."""
    sums = frame.groupBy(*by).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"))
    off = F.max(F.abs(F.col(a) / F.col("_a") - F.col(b) / F.col("_b")))
    return check(frame.join(sums, by), name, off <= tolerance, F.round(off, 9))
