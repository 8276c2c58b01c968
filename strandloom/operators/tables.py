"""Counts, shares, funnels and crosstabs of classified reads, and the algebra that merges them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile
from ..functions.statistics import ratio, wilson


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def composition(rows: DataFrame, by: list[str], kind: str, share: str = "share") -> DataFrame:
    """Rows of each class and their share of the group."""
    counts = rows.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return counts.withColumn(share, F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def pooled_and_each(rows: DataFrame, pool: list[str], each: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of each unit and of the pool, where `each` is null, in one pass (a rollup below the pool)."""
    both = rows.rollup(*pool, each).agg(*(c.alias(k) for k, c in measures.items()), F.grouping_id().alias("_g"))
    return both.where("_g <= 1").drop("_g")


def crosstab(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """One column of counts for each of the declared values; no pass to find them."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def read_fate(rows: DataFrame, by: list[str], gates: dict[str, Column]) -> DataFrame:
    """Rows in, and rows that pass each gate and all before it, with percent of those in."""
    tests, so_far = {}, F.lit(True)
    for name, test in gates.items():
        so_far = so_far & F.coalesce(test, F.lit(False))
        tests[name] = so_far
    out = rows.groupBy(*by).agg(F.count("*").alias("reads_in"), *(F.count_if(t).alias(n) for n, t in tests.items()))
    return out.select("*", *(ratio(100 * F.col(n), F.col("reads_in")).alias(f"{n}_pct") for n in tests))


def funnel_level(gates: list[Column]) -> Column:
    """How many gates are passed before the first that isn't."""
    out = F.lit(len(gates))
    for i in reversed(range(len(gates))):
        out = F.when(F.coalesce(gates[i], F.lit(False)), out).otherwise(F.lit(i))
    return out


def drop_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that isn't passed; null if all are."""
    return F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in gates))


def cumulative_funnel(rows: DataFrame, by: list[str], level: str, correct: str, deepest: int) -> DataFrame:
    """n, correct and accuracy with Wilson's interval of the rows at each level or deeper.

    Rows are counted by level once; the cumulative sums are over that many rows for each group.
    """
    counts = rows.groupBy(*by, level).agg(F.count("*").alias("_n"), F.count_if(F.col(correct)).alias("_c"))
    reached = counts.withColumn("_to", F.explode(F.sequence(F.lit(0), F.least(F.col(level), F.lit(deepest)))))
    out = reached.groupBy(*by, F.col("_to").alias("level")).agg(F.sum("_n").alias("n"), F.sum("_c").alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return out.withColumn("accuracy_pct", ratio(100 * F.col("correct"), F.col("n"))).withColumn("low", low).withColumn("high", high)


def species_call(alignments: DataFrame, read: list[str], species: str) -> DataFrame:
    """human, mouse, or ambiguous, from all alignments of each read."""
    seen = F.collect_set(species)
    return alignments.groupBy(*read).agg(F.when(F.size(seen) == 1, seen[0]).when(F.size(seen) > 1, "ambiguous").alias("call"))


def direction(rows: DataFrame, code: str, species: str, least: int) -> DataFrame:
    """Majority species of each code and its share; null below `least` rows or at a tie."""
    counts = rows.groupBy(code).agg(F.count_if(F.col(species) == "human").alias("human"), F.count_if(F.col(species) == "mouse").alias("mouse"))
    n = F.col("human") + F.col("mouse")
    call = F.when(n >= least, F.when(F.col("human") > F.col("mouse"), "human").when(F.col("mouse") > F.col("human"), "mouse"))
    return counts.withColumn("call", call).withColumn("confidence", ratio(F.greatest("human", "mouse"), n))


def merge_partials(parts: DataFrame, by: list[str], sums: list[str], maxima: list[str] | None = None, constants: list[str] | None = None) -> DataFrame:
    """Counts add up, maxima are maxima, and constants must agree in all parts of a group, else the run fails."""
    same = [F.when(F.count_distinct(c) <= 1, F.max(c)).otherwise(F.raise_error(F.lit(f"{c} differs between parts"))).alias(c) for c in constants or []]
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima or []), *same)


def merge_counters(rows: DataFrame, by: list[str], counters: str) -> DataFrame:
    """Sums a map of counters key by key."""
    return rows.select(*by, F.explode(counters).alias("path", "n")).groupBy(*by, "path").agg(F.sum("n").alias("n"))


def quantiles(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Five rules for one quantile: linear, least value with a cumulative share of q, value at floor(q n), upper median of q, and cum >= (n + 1) div 2 for the half.

    From a histogram with running counts: no group's rows are sorted or gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(value)
    h = counts.withColumn("_cum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(1)]))))
    at = lambda k: F.min(F.when(F.col("_cum") > k, F.col(value)))  # noqa: E731  the value at 0-based place k
    place = (F.col("_all") - 1) * q
    low, high = F.min(F.when(F.col("_cum") > F.floor(place), F.col(value))), F.min(F.when(F.col("_cum") > F.ceil(place), F.col(value)))
    part = F.max(place - F.floor(place))
    return h.groupBy(*by).agg(
        (low + (high - low) * part).alias("linear"),
        F.min(F.when(F.col("_cum") >= q * F.col("_all"), F.col(value))).alias("cumulative"),
        at(F.least(F.floor(q * F.col("_all")), F.col("_all") - 1)).alias("floor_index"),
        at(F.floor(F.col("_all") / 2)).alias("upper_median"),
        F.min(F.when(F.col("_cum") >= F.floor((F.col("_all") + 1) / 2), F.col(value))).alias("half_up"),
    )


def top_share(rows: DataFrame, by: list[str], count: str, key: str, tops: list[int]) -> DataFrame:
    """Share of the k largest counts, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.col(count).desc(), key)
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(*by).agg(*((F.sum(F.when(F.col("_rank") <= k, F.col(count)).otherwise(0)) / F.sum(count)).alias(f"top{k}_share") for k in tops))


def mean_interval(rows: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """n, mean, sample SD and half width of the 95 % t interval of groups of `least` values or more."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where(F.col("n") >= least)
    return out.withColumn("half_width", t_quantile(0.975, F.col("n") - 1) * F.col("sd") / F.sqrt("n"))


def code_report(rows: DataFrame, code: str, declared: DataFrame, top: int = 20) -> DataFrame:
    """Reads of each declared code (column `code` of `declared`), and of the most frequent `top` others, with shares of all and of the declared."""
    own = declared.select(code).distinct().withColumn("_declared", F.lit(True))
    counts = rows.groupBy(code).agg(F.count("*").alias("reads")).join(own, code, "left")
    counts = counts.select(code, "reads", F.when(F.col(code).isNotNull(), F.coalesce("_declared", F.lit(False))).alias("declared"))
    everything = counts.agg(F.sum("reads").alias("_all"), F.sum(F.when(F.col("declared"), F.col("reads"))).alias("_own"))
    others = counts.where("not declared").orderBy(F.col("reads").desc(), code).limit(top)
    out = counts.where("declared").unionByName(others).crossJoin(F.broadcast(everything))
    return out.select(code, "reads", "declared", (100 * F.col("reads") / F.col("_all")).alias("pct_total"), F.when(F.col("declared"), 100 * F.col("reads") / F.col("_own")).alias("pct_assigned"))


def quality_by_cycle(reads: DataFrame, seq: str, qual: str, by: list[str] | None = None) -> DataFrame:
    """Mean Phred, percent of Q30 and of N, and base shares at each cycle."""
    by = by or []
    pairs = F.arrays_zip(F.split(qual, "").alias("q"), F.split(seq, "").alias("b"))
    rows = reads.select(*by, F.posexplode(pairs).alias("cycle", "x")).select(*by, (F.col("cycle") + 1).alias("cycle"), (F.ascii("x.q") - 33).alias("q"), F.col("x.b").alias("b"))
    share = [(100 * F.count_if(F.col("b") == x) / F.count("*")).alias(f"pct_{x.lower()}") for x in "ACGTN"]
    return rows.groupBy(*by, "cycle").agg(F.avg("q").alias("mean_q"), (100 * F.count_if(F.col("q") >= 30) / F.count("*")).alias("q30_pct"), *share)


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
