"""Coverage profiles along transcripts under different normalisations, and what they say about a method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bin_of


def gene_bins(reads: DataFrame, by: list[str], gene: str, place: str, length: str, bins: int = 50) -> DataFrame:
    """Read starts by gene and bin of equal width along the transcript."""
    return reads.groupBy(*by, gene, bin_of(F.col(place), F.col(length), bins).alias("bin")).agg(F.count("*").cast("double").alias("n"))


def normalised(bins: DataFrame, by: list[str], gene: str, rule: str = "mean") -> DataFrame:
    """Bins divided by their gene's sum, mean over all bins, maximum, or median; or 1 where any read or a fifth of the maximum is."""
    w = Window.partitionBy(*by, gene)
    n = F.col("n")
    rules: dict[str, Column] = {
        "sum": n / F.sum(n).over(w),
        "mean": n / F.avg(n).over(w),
        "max": n / F.max(n).over(w),
        "median": n / F.percentile(n, F.lit(0.5)).over(w),
        "any": (n > 0).cast("double"),
        "fifth": (n >= 0.2 * F.max(n).over(w)).cast("double"),
    }
    return bins.withColumn("level", rules[rule])


def mean_profile(bins: DataFrame, by: list[str], gene: str, value: str = "level") -> DataFrame:
    """Mean level of each bin over all genes of the group; a gene without reads in a bin counts as 0 there."""
    genes = bins.groupBy(*by).agg(F.count_distinct(gene).alias("_genes")) if by else bins.agg(F.count_distinct(gene).alias("_genes"))
    sums = bins.groupBy(*by, "bin").agg(F.sum(value).alias("_sum"))
    wide = sums.join(genes, by) if by else sums.crossJoin(F.broadcast(genes))
    return wide.select(*by, "bin", (F.col("_sum") / F.col("_genes")).alias("level"))


def quartile_of(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartile 1 to 4 of each row by percentile bounds, not by equal numbers of rows."""
    bounds = values.groupBy(*by).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("_q")) if by else values.agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("_q"))
    wide = values.join(F.broadcast(bounds), by) if by else values.crossJoin(F.broadcast(bounds))
    return wide.withColumn("quartile", F.when(F.col(value) <= F.col("_q")[0], 1).when(F.col(value) <= F.col("_q")[1], 2).when(F.col(value) <= F.col("_q")[2], 3).otherwise(4)).drop("_q")


def end_shares(reads: DataFrame, by: list[str], place: str, length: str, reach: int = 300) -> DataFrame:
    """Share of reads within `reach` of either end, in each third, and the median relative place."""
    x, n = F.col(place), F.col(length)
    rel = x / n
    share = lambda t: F.avg(t.cast("double"))
    return reads.groupBy(*by).agg(share(x < reach).alias("five_prime"), share(n - x <= reach).alias("three_prime"), share(rel < 1 / 3).alias("first_third"), share((rel >= 1 / 3) & (rel < 2 / 3)).alias("middle_third"), share(rel >= 2 / 3).alias("last_third"), F.percentile(rel, 0.5).alias("median_place"))


def breadth(bins: DataFrame, by: list[str], gene: str, width: int) -> DataFrame:
    """Occupied bins, hits of the first and last one, and the Gini coefficient over all bins of each gene."""
    w = Window.partitionBy(*by, gene)
    ranked = bins.withColumn("_rank", F.row_number().over(w.orderBy("n")) + F.lit(width) - F.count("*").over(w))
    s = F.sum("n")
    return ranked.groupBy(*by, gene).agg(F.count("*").alias("occupied"), F.max((F.col("bin") == 0).cast("int")).alias("first_hit"), F.max((F.col("bin") == width - 1).cast("int")).alias("last_hit"), (2 * F.sum(F.col("_rank") * F.col("n")) / (width * s) - (width + 1) / width).alias("gini"))


def profile_agreement(bins: DataFrame, gene: str, sample: str) -> DataFrame:
    """Correlation of each gene's profile between samples a < b; bins without reads in both are left out."""
    a = bins.select(gene, "bin", F.col(sample).alias("a"), F.col("n").alias("x"))
    b = bins.select(gene, "bin", F.col(sample).alias("b"), F.col("n").alias("y"))
    return a.join(b, [gene, "bin"]).where("a < b").groupBy(gene, "a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("bins"))


def from_three_prime(reads: DataFrame, by: list[str], gene: str, place: str, length: str, reach: int = 3000) -> DataFrame:
    """Mean of depth over the gene's mean at each distance from the 3' end, among genes that reach so far."""
    d = reads.select(*by, gene, (F.col(length) - 1 - F.col(place)).alias("distance"), F.col(length).alias("_len")).where(F.col("distance").between(0, reach - 1))
    counts = d.groupBy(*by, gene, "distance").agg(F.count("*").alias("_n"), F.first("_len").alias("_len"))
    whole = counts.groupBy(*by, gene).agg((F.sum("_n") / F.least(F.first("_len"), F.lit(reach))).alias("_mean"), F.first("_len").alias("_len"))
    rows = counts.drop("_len").join(whole, [*by, gene])
    sums = rows.groupBy(*by, "distance").agg(F.sum(F.col("_n") / F.col("_mean")).alias("_sum"))
    lengths = whole.groupBy(*by, F.least(F.col("_len"), F.lit(reach)).alias("_len")).agg(F.count("*").alias("_genes"))
    reaching = lengths.select(*by, F.explode(F.sequence(F.lit(0), F.col("_len").cast("int") - 1)).alias("distance"), "_genes").groupBy(*by, "distance").agg(F.sum("_genes").alias("genes"))
    return sums.join(reaching, [*by, "distance"]).select(*by, "distance", (F.col("_sum") / F.col("genes")).alias("level"), "genes")


def scaled_depth(steps: DataFrame, totals: DataFrame, by: list[str], total: str, to: float = 1e7) -> DataFrame:
    """Depth for `to` reads of the track."""
    return steps.join(totals, by).withColumn("scaled", F.col("depth") * to / F.col(total))


def block_max(rows: DataFrame, by: list[str], index: str, value: str, size: int) -> DataFrame:
    return rows.groupBy(*by, F.floor(F.col(index) / size).alias("block")).agg(F.max(value).alias(value))
