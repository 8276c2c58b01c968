"""Samples without random streams: order by a hash of a row's key, so results don't depend on partitions or runs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*keys: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def first_by_order(rows: DataFrame, by: list[str], order: list[str | Column], n: int, into: str = "rank") -> DataFrame:
    """The first n rows of each group in an order. Up to spark.sql.optimizer.windowGroupLimitThreshold of them, each task drops the others of its
    own rows before the shuffle."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(into) <= n)


#: Bits of a hash that name its stretch in hashed_rank().
STRETCH_BITS = 10


def hashed_rank(rows: DataFrame, by: list[str], keys: list[str], seed: int = 0, into: str = "_rank") -> DataFrame:
    """Rows with their number in their group in the order of hash_order(keys), then the keys; nulls in `by` are a group like others.

    The hashes are cut into stretches. Rows are numbered in theirs, and go on from the rows of the stretches before: a group of any size is the work
    of many tasks, and one window sees only a group's counts.
    """
    cut = rows.withColumn("_group", F.struct(*by)).withColumn("_hash", hash_order(*keys, seed=seed)).withColumn("_stretch", F.shiftright("_hash", 64 - STRETCH_BITS))
    counts = cut.groupBy("_group", "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_group", "_stretch", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_group", "_stretch").orderBy("_hash", *keys)))
    return inside.join(starts, ["_group", "_stretch"]).select(*rows.columns, (F.col("_start") + F.col("_in")).alias(into))


def exact_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of least hash, from the whole table."""
    return rows.orderBy(hash_order(*keys, seed=seed), *keys).limit(n)


def rarefy(rows: DataFrame, by: list[str], order: list[str | Column], depths: list[int], measures: dict[str, Column]) -> DataFrame:
    """Measures of nested prefixes of each group in an order; depths above a group's rows are left out.

    Only rows up to the largest depth are ranked and kept (first_by_order), and sent to the depths they belong to, which are few.
    """
    totals = rows.groupBy(*by).agg(F.count("*").alias("_all")).select(F.struct(*by).alias("_group"), "_all")
    ranked = first_by_order(rows, by, order, max(depths), "_rank").withColumn("_group", F.struct(*by)).join(totals, "_group")
    fits = F.filter(F.array(*(F.lit(d).cast("long") for d in depths)), lambda d: (d >= F.col("_rank")) & (d <= F.col("_all")))
    return ranked.withColumn("depth", F.explode(fits)).groupBy(*by, "depth").agg(*(c.alias(k) for k, c in measures.items()))


def at_least_in_binomial(n: Column, p: Column, k: int) -> Column:
    """P(Binomial(n, p) >= k) for a small k, in closed form."""
    terms = [F.lit(1.0) * comb_of(n, i) * F.pow(p, F.lit(i)) * F.pow(1 - p, n - i) for i in range(k)]
    return F.when(n >= k, F.greatest(F.lit(0.0), 1 - reduce(lambda a, b: a + b, terms))).otherwise(F.lit(0.0))


def comb_of(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def expected_features(counts: DataFrame, by: list[str], count: str, depths: list[int], least: int) -> DataFrame:
    """Expected features with `least` molecules or more when each molecule is kept with chance depth / all; null above all."""
    total = counts.groupBy(*by).agg(F.sum(count).alias("_all"))
    wide = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))
    rows = wide.withColumn("depth", F.explode(F.array(*(F.lit(d).cast("long") for d in depths))))
    chance = at_least_in_binomial(F.col(count), F.col("depth") / F.col("_all"), least)
    expected = F.sum(F.when(F.col("depth") <= F.col("_all"), F.when(F.col("depth") == F.col("_all"), (F.col(count) >= least).cast("double")).otherwise(chance)))
    return rows.groupBy(*by, "depth").agg(expected.alias("expected"))


#: Branches of a group's tree of features, and how far from the mode, in standard deviations and in counts, a draw is sought.
BRANCHES = 1024
REACH, MORE_REACH = 12, 60


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The number of good ones among `draws` without replacement, by inversion at u from [0, 1): exact weights around the mode, each from its neighbour."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    every = good + bad
    mode = min(max((draws + 1) * (good + 1) // (every + 2), low), high)
    share = good / every
    width = int(REACH * math.sqrt(draws * share * (1 - share) * (every - draws) / max(every - 1, 1))) + MORE_REACH
    x = np.arange(max(low, mode - width), min(high, mode + width) + 1, dtype=float)
    rise = (good - x[:-1]) * (draws - x[:-1]) / ((x[1:]) * (bad - draws + x[1:]))
    at = mode - int(x[0])
    weight = np.ones(len(x))
    weight[at + 1 :] = np.cumprod(rise[at:])
    weight[:at] = np.cumprod(1 / rise[:at][::-1])[::-1]
    total = np.cumsum(weight)
    return int(x[min(int(np.searchsorted(total, u * total[-1], side="right")), len(x) - 1)])


def _dealt_draws(draws: int, counts: list[int], chances: list[float]) -> list[int]:
    """`draws` without replacement from all counts, one count after another: each takes its part of what is left."""
    left, out = sum(counts), []
    for n, u in zip(counts, chances):
        out.append(hypergeometric(u, n, left - n, draws))
        left, draws = left - n, draws - out[-1]
    return out


def thin_counts(counts: DataFrame, by: list[str], feature: str, count: str, depth: int, seed: int = 0) -> DataFrame:
    """Counts of a sample of `depth` molecules without replacement; groups with fewer are left out. Features without any are, too.

    No molecule is listed: features are dealt to branches by hash, a group's draws are split over the totals of its branches, and each branch's over its features,
    by hypergeometric draws whose chances are hashes. So rows are as many as features, whatever their counts, and the sample is the same on every run. A null
    feature is one like others; features' rows are summed first.
    """
    chance = lambda *keys: F.shiftrightunsigned(hash_order(*keys, seed=seed), 11).cast("double") / float(1 << 53)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    some = counts.where(F.col(count) > 0).groupBy(*by, feature).agg(F.sum(F.col(count).cast("long")).alias("_n"))
    some = some.withColumn("_group", group).withColumn("_branch", F.pmod(hash_order(feature, seed=seed + 1), F.lit(BRANCHES)).cast("int"))
    some = some.withColumn("_u", chance("_group", feature)).withColumn("_id", F.to_json("_group")).withColumn("_order", hash_order(feature, seed=seed + 2))
    branches = some.groupBy("_id", "_branch").agg(F.sum("_n").alias("_n")).withColumn("_u", chance("_id", "_branch"))

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_branch")
        n = pdf["_n"].tolist()
        drawn = _dealt_draws(depth, n, pdf["_u"].tolist()) if sum(n) >= depth else [0] * len(n)
        return pd.DataFrame({"_id": pdf["_id"], "_branch": pdf["_branch"], "_drawn": drawn})

    taken = branches.groupBy("_id").applyInPandas(split, "_id string, _branch int, _drawn long").where("_drawn > 0")

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")  # not by the chances: what comes first would have the small ones
        return pdf.assign(_taken=_dealt_draws(int(pdf["_drawn"].iloc[0]), pdf["_n"].tolist(), pdf["_u"].tolist()))[[*by, feature, "_taken"]]

    schema = ", ".join(f"`{c}` {some.schema[c].dataType.simpleString()}" for c in [*by, feature]) + ", _taken long"
    rows = some.join(taken, ["_id", "_branch"]).groupBy("_id", "_branch").applyInPandas(inside, schema)
    return rows.where("_taken > 0").withColumnRenamed("_taken", count)


def to_smallest(rows: DataFrame, by: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """As many rows of each group as the smallest group has."""
    least = rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return hashed_rank(rows, by, keys, seed).crossJoin(F.broadcast(least)).where("_rank <= _least").drop("_rank", "_least")


def common_features(rows: DataFrame, method: str, feature: str, depth: int, methods: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly `depth` rows of each (method, feature), for features that all methods have that many of. Tasks keep only their first rows before the shuffle (first_by_order)."""
    enough = rows.groupBy(method, feature).agg(F.count("*").alias("_n")).where(F.col("_n") >= depth).groupBy(feature).agg(F.count("*").alias("_m")).where(F.col("_m") == methods)
    first = first_by_order(rows, [method, feature], [hash_order(*keys, seed=seed), *keys], depth, "_rank").drop("_rank")
    return first.join(enough.select(feature), feature, "left_semi")


def strided(rows: DataFrame, by: list[str], order: list[str], step: int, at_most: int | None = None) -> DataFrame:
    """Every step-th row of each group in an order, the first included."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("_rank") % step == 0)
    return (ranked.where(F.col("_rank") < step * at_most) if at_most else ranked).drop("_rank")
