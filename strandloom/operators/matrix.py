"""Long count matrices (feature, sample, value): scaling, correlation, outliers, sets, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples that the driver's linear algebra takes at most.
MOST_SAMPLES = 2000


def to_long(wide: DataFrame, ids: list[str], feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """One row for each cell; empty cells are 0."""
    columns = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, columns, sample, value).withColumn(value, F.coalesce(F.col(value), F.lit(0))).withColumnRenamed(ids[0], feature)


def per_million(counts: DataFrame, sample: str, value: str, length: str | None = None, into: str = "cpm") -> DataFrame:
    """Value, or value by length, for a million of its sample's sum: the sums are aggregated and joined back, so no sample is sorted."""
    rate = F.col(value) / F.col(length) if length else F.col(value)
    sums = counts.groupBy(sample).agg(F.sum(rate).alias("_sum"))
    return counts.join(sums, sample).withColumn(into, F.when(F.col("_sum") != 0, rate / F.col("_sum") * 1e6)).drop("_sum")


def log_per_million(counts: DataFrame, sample: str, value: str, into: str = "log_cpm") -> DataFrame:
    return per_million(counts, sample, value, into="_cpm").withColumn(into, F.log2(F.col("_cpm") + 1)).drop("_cpm")


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 in which ties share their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def sample_pairs(values: DataFrame, feature: str, sample: str, value: str, within: list[str] | None = None) -> DataFrame:
    """Values of each feature in each pair of samples a < b (of one condition); samples are few, so pairs are too."""
    within = within or []
    left = values.select(feature, *within, F.col(sample).alias("a"), F.col(value).alias("x"))
    right = values.select(feature, *within, F.col(sample).alias("b"), F.col(value).alias("y"))
    return left.join(right, [feature, *within]).where("a < b")


def pair_agreement(pairs: DataFrame, by: list[str], least: float | None = None) -> DataFrame:
    """Pearson's r and the root mean squared difference of each pair, over features that reach `least` in either sample."""
    kept = pairs if least is None else pairs.where(F.greatest("x", "y") >= least)
    d = F.col("x") - F.col("y")
    return kept.groupBy(*by).agg(F.corr("x", "y").alias("r"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("features"))


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    ranked = pairs.withColumn("_rx", average_rank("x", by)).withColumn("_ry", average_rank("y", by))
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def sample_means(pairs: DataFrame, value: str) -> DataFrame:
    """Mean of each sample over the pairs it is in."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sample"), value)
    return ends.groupBy("sample").agg(F.avg(value).alias(value))


def median_outliers(pairs: DataFrame, by: list[str], limit: float = 2.0) -> DataFrame:
    """Features whose difference is `limit` or more from the median difference."""
    d = pairs.withColumn("d", F.col("y") - F.col("x"))
    middle = d.groupBy(*by).agg(F.percentile("d", 0.5).alias("median"))
    return d.join(F.broadcast(middle), by).where(F.abs(F.col("d") - F.col("median")) >= limit)


def capped_features(values: DataFrame, feature: str, method: str, value: str, n: int) -> DataFrame:
    """The n features of largest least mean over methods; ties by name."""
    means = values.groupBy(feature, method).agg(F.avg(value).alias("_m")).groupBy(feature).agg(F.min("_m").alias("least_mean"))
    return means.orderBy(F.col("least_mean").desc(), feature).limit(n)


def variable_features(values: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """The n features of largest population variance; ties by name."""
    return values.groupBy(feature).agg(F.var_pop(value).alias("variance")).orderBy(F.col("variance").desc(), feature).limit(n)


def exclusive_sets(rows: DataFrame, item: list[str], label: str) -> DataFrame:
    """Number of items for each exact set of labels they have."""
    sets = rows.groupBy(*item).agg(F.array_join(F.sort_array(F.collect_set(label)), "+").alias("labels"))
    return sets.groupBy("labels").agg(F.count("*").alias("items"))


def discordant(rows: DataFrame, item: str, label: str, effect: str) -> DataFrame:
    """Items whose effects have opposite signs under two labels: an aggregate, no self-join."""
    return rows.groupBy(item).agg(F.min(effect).alias("least"), F.max(effect).alias("most"), F.count_distinct(label).alias("labels")).where((F.col("least") < 0) & (F.col("most") > 0) & (F.col("labels") > 1))


def fold_aliases(counts: DataFrame, feature: str, symbol: str, sample: str, value: str, primary: str) -> DataFrame:
    """Counts of copies added to the only primary feature of their symbol; symbols with several primaries stay as they are."""
    only = counts.where(primary).select(symbol, feature).distinct().groupBy(symbol).agg(F.count("*").alias("_n"), F.first(feature).alias("_target")).where("_n = 1").drop("_n")
    moved = counts.join(only, symbol, "left").withColumn(feature, F.coalesce("_target", feature))
    return moved.groupBy(feature, symbol, sample).agg(F.sum(value).alias(value))


def principal_components(values: DataFrame, feature: str, sample: str, value: str, components: int = 2) -> DataFrame:
    """Sample scores and variance shares from values standardised by feature (population SD + 1e-9).

    Samples are far fewer than features, so Spark sums the products of samples, and only that square matrix, whose size is
    checked, is taken to the driver.
    """
    spark = values.sparkSession
    n = values.select(sample).distinct().count()
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples are more than {MOST_SAMPLES}")
    stats = values.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = values.join(stats, feature).select(feature, sample, ((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-9)).alias("z"))
    other = z.select(feature, F.col(sample).alias("_b"), F.col("z").alias("_zb"))
    products = z.join(other, feature).groupBy(F.col(sample).alias("a"), F.col("_b").alias("b")).agg(F.sum(F.col("z") * F.col("_zb")).alias("dot")).collect()
    names = sorted({r.a for r in products})
    at = {x: i for i, x in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in products:
        gram[at[r.a], at[r.b]] = r.dot
    roots, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(roots)[::-1][:components]
    roots_all = np.maximum(roots, 0)
    rows = []
    for k, i in enumerate(order, 1):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        rows += [(names[j], k, float(v[j] * np.sqrt(roots_all[i])), float(roots_all[i] / roots_all.sum()) if roots_all.sum() else 0.0) for j in range(len(names))]
    kind = values.schema[sample].dataType.simpleString()
    return spark.createDataFrame(rows, f"`{sample}` {kind}, component int, score double, share double")


def average_linkage(distances: DataFrame, a: str, b: str, distance: str) -> list[tuple[list, list, float]]:
    """Merges of average linkage over a full table of pair distances between few items, on the driver; their number is checked."""
    n = distances.count()
    if n > MOST_SAMPLES * MOST_SAMPLES:
        raise ValueError(f"{n} distances are more than {MOST_SAMPLES * MOST_SAMPLES}")
    rows = distances.collect()
    groups = [[x] for x in sorted({r[a] for r in rows} | {r[b] for r in rows})]
    at = {g[0]: i for i, g in enumerate(groups)}
    far = np.full((len(groups), len(groups)), np.inf)
    for r in rows:
        far[at[r[a]], at[r[b]]] = far[at[r[b]], at[r[a]]] = r[distance]
    merges = []
    while len(groups) > 1:
        # the mean distance of a merged group to another is the mean of its parts' by their sizes
        i, j = (int(x) for x in np.unravel_index(np.where(np.tri(len(groups), k=-1, dtype=bool), far, np.inf).argmin(), far.shape))
        merges.append((groups[j], groups[i], float(far[i, j])))
        p, q = len(groups[i]), len(groups[j])
        far[j] = far[:, j] = (p * far[i] + q * far[j]) / (p + q)
        groups[j] = sorted(groups[i] + groups[j])
        del groups[i]
        far = np.delete(np.delete(far, i, 0), i, 1)
    return merges


def weighted_length(rows: DataFrame, gene: str, weight: str, length: str) -> DataFrame:
    """Weighted mean length, plain mean and sums of each gene; the weighted mean is null without weight."""
    return rows.groupBy(gene).agg(F.sum(weight).alias("weight"), (F.sum(F.col(weight) * F.col(length)) / F.nullif(F.sum(weight), F.lit(0))).alias("length"), F.avg(length).alias("plain_length"))


def complete_length(rows: DataFrame, own: str, method: str, gene: str, plain: str) -> Column:
    """Own length, else the method's mean for the gene, else the plain mean, else 1."""
    return F.coalesce(F.col(own), F.avg(own).over(Window.partitionBy(method, gene)), F.col(plain), F.lit(1.0))
