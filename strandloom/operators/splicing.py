"""Junction counts, inclusion shares and differential tests over wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import p_of_t
from ..sources.work import written
from . import scans
from .sampling import first_by_order
from .tables import all_of


def junction_support(reads: DataFrame, junction: list[str], read: str, left: str, right: str, anchor: int = 4, each_read: bool = False) -> DataFrame:
    """Distinct reads over each junction. Anchors of `anchor` are asked of the best read on either side or, with `each_read`, of every read."""
    if each_read:
        reads = reads.where((F.col(left) >= anchor) & (F.col(right) >= anchor))
    out = reads.groupBy(*junction).agg(F.count_distinct(read).alias("support"), F.max(left).alias("_l"), F.max(right).alias("_r"))
    return out.where((F.col("_l") >= anchor) & (F.col("_r") >= anchor)).drop("_l", "_r")


def inclusion(counts: DataFrame, event: str, junction: str, sample: str, count: str) -> DataFrame:
    """Counts with the event's total in the sample and the share of it; null where the total is 0."""
    total = F.sum(count).over(Window.partitionBy(event, sample))
    return counts.withColumn("total", total).withColumn("psi", F.when(total > 0, F.col(count) / total))


def testable(psi: DataFrame, row: list[str], least_mean: float = 100, least_var: float = 0.005) -> DataFrame:
    """Rows with a mean total of `least_mean`, no empty sample, and a population variance of psi of `least_var`."""
    stats = psi.groupBy(*row).agg(F.avg("total").alias("_mean"), F.min("total").alias("_min"), F.var_pop("psi").alias("_var"))
    return psi.join(stats.where((F.col("_mean") >= least_mean) & (F.col("_min") > 0) & (F.col("_var") >= least_var)).select(*row), row, "left_semi")


def welch(rows: DataFrame, by: list[str], value: str, treated: Column) -> DataFrame:
    """t, degrees of freedom and p of treated against control values; p is 1 where nothing varies."""
    v = F.col(value)
    one = lambda f, on: f(F.when(on, v))
    n1, n2 = one(F.count, treated), one(F.count, ~treated)
    m1, m2 = one(F.avg, treated), one(F.avg, ~treated)
    s1, s2 = one(F.var_samp, treated) / n1, one(F.var_samp, ~treated) / n2
    both = s1 + s2
    t = F.when(both > 0, (m1 - m2) / F.sqrt(both))
    df = F.when(both > 0, both * both / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)))
    return rows.groupBy(*by).agg(t.alias("t"), df.alias("df"), (m1 - m2).alias("difference")).withColumn("p", p_of_t(F.col("t"), F.col("df")))


def slope(rows: DataFrame, by: list[str], value: str, dose: str) -> DataFrame:
    """Least-squares slope on the dose, its t and p; p is 1 where there's no residual."""
    n = F.count(value)
    sxx, syy = F.regr_sxx(value, dose), F.regr_syy(value, dose)
    sxy = F.regr_sxy(value, dose)
    residual = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    se = F.sqrt(residual / (n - 2) / sxx)
    out = rows.groupBy(*by).agg((sxy / sxx).alias("slope"), F.when((n > 2) & (se > 0), sxy / sxx / se).alias("t"), (n - 2).cast("double").alias("df"))
    return out.withColumn("p", p_of_t(F.col("t"), F.col("df")))


def pooled_difference(counts: DataFrame, row: list[str], count: str, total: str, treated: Column) -> DataFrame:
    """Inclusion of the pooled control and treated samples, and the difference: ratios of sums."""
    part = lambda on: F.sum(F.when(on, F.col(count))) / F.nullif(F.sum(F.when(on, F.col(total))), F.lit(0))
    out = counts.groupBy(*row).agg(part(~treated).alias("psi_control"), part(treated).alias("psi_treated"))
    return out.withColumn("dpsi", F.col("psi_treated") - F.col("psi_control"))


def separated(rows: DataFrame, by: list[str], value: str, treated: Column) -> DataFrame:
    """Whether every treated value lies beyond every control value."""
    v = F.col(value)
    above = F.min(F.when(treated, v)) > F.max(F.when(~treated, v))
    below = F.max(F.when(treated, v)) < F.min(F.when(~treated, v))
    return rows.groupBy(*by).agg((above | below).alias("consistent"))


def adjust_p(rows: DataFrame, p: str, into: str, by: list[str] | None = None) -> DataFrame:
    """Add Benjamini-Hochberg adjusted p-values; ties share the value of the last of them. Null p stays null.

    Distinct p-values are counted; ranks and the least values to the right of them are scans in stretches, so no task sees all p-values of a group.
    """
    by = by or []
    counts = scans.in_stretches(rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n")), p)
    ranked = scans.scan(counts, by, [p], {"_rank": scans.running_sum(F.col("_n"))}, {"_all": F.col("_n")})
    least = scans.scan(ranked, by, [p], {into: scans.running_min(F.col(p) * F.col("_all") / F.col("_rank"), backward=True)})
    values = least.select(*by, p, F.least(into, F.lit(1.0)).alias(into))
    same = [F.col(f"_row.{c}").eqNullSafe(F.col(f"_value.{c}")) for c in by] + [F.col(f"_row.{p}") == F.col(f"_value.{p}")]
    return rows.alias("_row").join(values.alias("_value"), same, "left").select("_row.*", F.col(f"_value.{into}").alias(into))


def differential(psi: DataFrame, row: list[str], count: str, treated: Column, limit: float = 0.1, effect: float = 0.1) -> DataFrame:
    """Welch tests of psi with pooled differences, adjusted p, consistency and hits (effects up only)."""
    tests = welch(psi, row, "psi", treated).join(pooled_difference(psi, row, count, "total", treated), row).join(separated(psi, row, "psi", treated), row)
    # adjusting reads its rows several times
    return adjust_p(written(tests, "tests"), "p", "padj").withColumn("hit", (F.col("padj") < limit) & (F.col("dpsi") >= effect))


def _before(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """Of `rows`, those that come before the n-th of the chosen in their group: nothing behind it can be among the first n."""
    last = first_by_order(chosen, ["_group"], ["_at"], n, "_k").where(F.col("_k") == n).select("_group", F.col("_at").alias("_last"))
    return rows.join(last, "_group", "left").where(F.col("_last").isNull() | (F.col("_at") < F.col("_last"))).drop("_last")


def greedy_distinct(rows: DataFrame, by: list[str], order: list[Column], keys: list[str], n: int = 10) -> DataFrame:
    """The first n rows of each group, or of all without `by`, in an ascending order, passing over rows of which any key has been seen; `place` counts them from 1.

    With one key these are the first rows of their keys. With several it goes by rounds: a row that is the first of all that are left under each of its keys
    is taken, as whatever comes before it shares no key with it; then what it blocks is removed, and what lies behind the n-th row taken. So no group is walked
    through in one task; each round's rows are written, and their number falls as in any greedy choice by local minima. Nulls are keys like others; rows
    that `order` doesn't part are ordered by their keys, and rows that agree in those are one.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    group = F.struct(*by) if by else F.lit(0)
    left = rows.withColumn("_group", group).withColumn("_at", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))))
    left = left.withColumns({name: F.struct(F.col("_group").alias("g"), F.col(k).alias("k")) for name, k in zip(names, keys)})
    if len(keys) == 1:
        best = left.groupBy(names[0]).agg(F.min_by(F.struct(*left.columns), "_at").alias("_best"))
        taken = best.select("_best.*")
    else:
        taken, left = None, written(left.groupBy("_group", "_at").agg(F.any_value(F.struct(*left.columns)).alias("_row")).select("_row.*"), "greedy")
        while not left.isEmpty():
            marked = left
            for name in names:
                marked = marked.join(left.groupBy(name).agg(F.min("_at").alias(f"_first{name}")), name)
            free = written(marked.where(all_of([F.col("_at") == F.col(f"_first{name}") for name in names])).select(*left.columns), "greedy")
            taken = free if taken is None else taken.unionByName(free)
            for name in names:
                left = left.join(free.select(name), name, "left_anti")
            left = written(_before(left, taken, n).select(*free.columns), "greedy")
        taken = left if taken is None else taken
    some = first_by_order(taken, ["_group"], ["_at"], n, "place") if by else taken.orderBy("_at").limit(n).withColumn("place", F.row_number().over(Window.partitionBy("_group").orderBy("_at")))
    return some.select(*rows.columns, "place")


def extents(junctions: DataFrame, event: str, start: str, end: str, least: int = 500, share: float = 0.2) -> DataFrame:
    """Span of each event, and the window padded by the larger of `least` and a share of the span."""
    out = junctions.groupBy(event).agg(F.min(start).alias("from_pos"), F.max(end).alias("to_pos"))
    pad = F.greatest(F.lit(least).cast("double"), share * (F.col("to_pos") - F.col("from_pos"))).cast("long")
    return out.withColumn("window_start", F.greatest(F.col("from_pos") - pad, F.lit(0))).withColumn("window_end", F.col("to_pos") + pad)


def strong_arcs(junctions: DataFrame, view: list[str], count: str, least: int = 2, share: float = 0.02) -> DataFrame:
    """Junctions with `least` fragments and a share of the strongest in their view."""
    top = F.max(count).over(Window.partitionBy(*view))
    return junctions.withColumn("_top", top).where((F.col(count) >= least) & (F.col(count) >= share * F.col("_top"))).drop("_top")
