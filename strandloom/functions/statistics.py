"""Statistics as column expressions where SQL can express them, and as vectorised functions where it can't."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributions

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.96


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b; null, or `otherwise`, where b is 0."""
    out = F.when(b != 0, a / b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def wilson(k: Column, n: Column, z: float = Z95, clamp: bool = False) -> tuple[Column, Column]:
    """Bounds of Wilson's interval of k of n in percent; null where n is 0."""
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = 100 * (mid - half), 100 * (mid + half)
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(100.0))
    return F.when(n > 0, low), F.when(n > 0, high)


def katz(a: Column, b: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """a / b and its interval on the log scale for two Poisson counts; null where one is 0."""
    fine, r = (a > 0) & (b > 0), a / b
    se = F.sqrt(1.0 / a + 1.0 / b)
    return F.when(fine, r), F.when(fine, r * F.exp(-z * se)), F.when(fine, r * F.exp(z * se))


def specificity(ah: Column, am: Column, th: Column, tm: Column) -> Column:
    """Chance-corrected share of correct calls, from -1 to 1, of two codes on two species."""
    n = ah + am + th + tm
    base = (ah + th) / n
    expected = F.when((ah + am > 0) & (th + tm > 0), (ah + am) / n * base + (th + tm) / n * (1 - base)).when(ah + am > 0, base).otherwise(1 - base)
    seen = (ah + tm) / n
    up = F.when(expected < 1, (seen - expected) / (1 - expected)).otherwise(0.0)
    down = F.when(expected > 0, (seen - expected) / expected).otherwise(0.0)
    return F.when(n > 0, F.when(seen >= expected, up).otherwise(down))


def effective_numbers(counts: DataFrame, by: list[str], count: str) -> DataFrame:
    """Simpson's and Shannon's effective numbers and the Gini-Simpson index of the counts of each group."""
    total = F.sum(count).over(Window.partitionBy(*by))
    p = counts.where(F.col(count) > 0).withColumn("_p", F.col(count) / total)
    squares = F.sum(F.col("_p") * F.col("_p"))
    return p.groupBy(*by).agg((1 / squares).alias("simpson"), F.exp(-F.sum(F.col("_p") * F.log("_p"))).alias("shannon"), (1 - squares).alias("gini_simpson"))


def gini(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of the values of each group; 0 where they sum to 0."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    n, s = F.count("*"), F.sum(value)
    return rows.withColumn("_rank", rank).groupBy(*by).agg(F.when(s != 0, 2 * F.sum(F.col("_rank") * F.col(value)) / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))


# Tests ------------------------------------------------------------------------------------------------------


def p_of_t(t: Column, df: Column) -> Column:
    """Two-sided p of t; 1 where either isn't a number (nothing varies, so there's no evidence)."""
    return F.coalesce(distributions.t_two_sided(t, df), F.lit(1.0))


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct<low, high> of the exact interval of k of n; nulls where n is 0."""
    low = F.when(k > 0, distributions.beta_quantile(alpha / 2, k, n - k + 1)).otherwise(0.0)
    high = F.when(k < n, distributions.beta_quantile(1 - alpha / 2, k + 1, n - k)).otherwise(1.0)
    return F.struct(F.when(n > 0, low).alias("low"), F.when(n > 0, high).alias("high"))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: tables no likelier than the one seen."""
    return distributions.hypergeometric_two_sided(a, b, c, d)


def mann_whitney(rows: DataFrame, by: list[str], value: str, group: str, first: str) -> DataFrame:
    """U of group `first` against the rest and its two-sided p: exact up to 20 values without ties, else the normal limit with ties.

    Each group of `by` is one task's rows; it's meant for samples, not for reads.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", u double, p double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.loc[pdf[group] == first, value].to_numpy(float)
        y = pdf.loc[pdf[group] != first, value].to_numpy(float)
        n, m = len(x), len(y)
        if not n or not m:
            return pd.DataFrame([[*key, float("nan"), 1.0]], columns=[*by, "u", "p"])
        every = np.concatenate([x, y])
        ranks = pd.Series(every).rank().to_numpy()
        u = ranks[:n].sum() - n * (n + 1) / 2
        ties = np.unique(every, return_counts=True)[1]
        if n + m <= 20 and ties.max() == 1:
            ways = np.zeros((n + 1, n * m + 1))
            ways[0, 0] = 1
            for j in range(1, n + m + 1):
                for i in range(min(n, j), 0, -1):
                    shift = j - i
                    if shift <= n * m:
                        ways[i, shift:] += ways[i - 1, : n * m + 1 - shift]
            share = ways[n] / ways[n].sum()
            p = min(1.0, 2 * min(share[: int(u) + 1].sum(), share[int(u) :].sum()))
        else:
            size = n + m
            spread = n * m / 12 * (size + 1 - ((ties**3 - ties).sum() / (size * (size - 1))))
            z = max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(spread) if spread else 0.0
            p = math.erfc(z / math.sqrt(2))
        return pd.DataFrame([[*key, u, p]], columns=[*by, "u", "p"])

    return rows.groupBy(*by).applyInPandas(run, schema)


def poisson_bootstrap(rows: DataFrame, key: str, counts: tuple[str, str, str, str], draws: int = 4000, seed: int = 1) -> DataFrame:
    """key, index, low and high: (a / b) / (c / d) and its 95 % interval over Poisson draws; null where a count of a denominator is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                values = np.array(row[1:], float)
                generator = np.random.default_rng([seed, *values.astype(int)])
                drawn = generator.poisson(values, size=(draws, 4))
                with np.errstate(divide="ignore", invalid="ignore"):
                    index = values[0] / values[1] / (values[2] / values[3])
                    made = drawn[:, 0] / drawn[:, 1] / (drawn[:, 2] / drawn[:, 3])
                made = made[np.isfinite(made)]
                fine = np.isfinite(index) and len(made)
                out.append([row[0], index if fine else None, np.quantile(made, 0.025) if fine else None, np.quantile(made, 0.975) if fine else None])
            yield pd.DataFrame(out, columns=[key, "index", "low", "high"])

    return rows.select(key, *counts).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, index double, low double, high double")
