"""What an assay's chemistry adds: its gates as columns, structures around poly-T, artefacts, ends of reads, windows under peaks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import cigar_sum, occurrences, pair_entropy, reverse_complement, richest_window_after, run_length_at
from ..functions.statistics import ratio
from .barcodes import call_against
from .tables import cumulative_funnel, drop_reason, funnel_level


@dataclass(frozen=True)
class Chemistry:
    """One assay: columns that measure a read, and gates over them in the order of its funnel."""

    name: str
    measures: dict[str, Callable[[], Column]] = field(default_factory=dict)
    gates: tuple[tuple[str, Callable[[], Column]], ...] = ()
    correct: Callable[[], Column] | None = None

    def measured(self, reads: DataFrame) -> DataFrame:
        out = reads
        for name, make in self.measures.items():  # in order: a measure may use earlier ones
            out = out.withColumn(name, make())
        return out.withColumn("level", funnel_level([g() for _, g in self.gates])).withColumn("dropped_by", drop_reason([(n, g()) for n, g in self.gates]))

    def retained(self, reads: DataFrame) -> DataFrame:
        return self.measured(reads).where(F.col("level") == len(self.gates))

    def funnel(self, reads: DataFrame, by: list[str]) -> DataFrame:
        if self.correct is None:
            raise ValueError(f"{self.name} has no rule for a correct read")
        return cumulative_funnel(self.measured(reads).withColumn("_correct", F.coalesce(self.correct(), F.lit(False))), by, "level", "_correct", len(self.gates))


def positional_chemistry(codes: dict[str, str], offset: int = 0, least_insert: int = 30, seq: str = "seq") -> Chemistry:
    """Codes at the start of the read, a run of G behind them, then the insert; correct where the code's species is the read's `species`."""
    n = len(next(iter(codes)))

    def species_of_code() -> Column:
        out = F.lit(None).cast("string")
        for c, s in codes.items():
            out = F.when(F.col("call.code") == c, s).otherwise(out)
        return out

    return Chemistry(
        "positional",
        {
            "call": lambda: call_against(F.substring(seq, 1, n), list(codes)),
            "g_run": lambda: run_length_at(F.col(seq), n + offset),
            "insert": lambda: F.substring(F.col(seq), F.lit(n + offset + 1) + F.col("g_run"), F.length(seq)),
            "expected": species_of_code,
        },
        (("code", lambda: F.col("call").isNotNull()), ("g_run", lambda: F.col("g_run") >= 3), ("insert", lambda: F.length("insert") >= least_insert), ("complex", lambda: pair_entropy(F.col("insert")) >= 0.65)),
        lambda: F.col("expected") == F.col("species"),
    )


def polyt_structure(seq: Column, anchor: str, code: int = 6, least: int = 9, window: int = 12) -> Column:
    """struct<code, t_rich>: the letters before an anchor that is followed by a window rich in T, on either strand; null without one."""

    def on(s: Column) -> Column:
        at = occurrences(s, anchor)
        good = F.filter(at, lambda i: (i >= code) & (F.regexp_count(F.substring(s, i + 1 + len(anchor), F.lit(window)), F.lit("T")) >= least))
        first = F.get(good, F.lit(0))
        return F.when(first.isNotNull(), F.struct(F.substring(s, first + 1 - code, F.lit(code)).alias("code"), richest_window_after(s, anchor, "T", window).alias("t_rich")))

    return F.coalesce(on(seq), on(reverse_complement(seq)))


def artefacts(reads: DataFrame, seq: str, by: list[str], adapters: tuple[str, str], least: int = 30) -> DataFrame:
    """Reads in which two adapters meet with less than an insert between, and reads of both without a run of T or A."""
    a, b = (F.locate(x, F.col(seq)) for x in adapters)
    both = (a > 0) & (b > 0)
    gap = F.abs(b - a) - F.when(a < b, len(adapters[0])).otherwise(len(adapters[1]))
    rows = reads.groupBy(*by).agg(F.count("*").alias("reads"), F.count_if(both & (gap < least)).alias("empty"), F.count_if(both & ~F.col(seq).rlike("T{10,}|A{10,}")).alias("without_tail"))
    return rows.withColumn("empty_pct", ratio(100 * F.col("empty"), F.col("reads"))).withColumn("without_tail_pct", ratio(100 * F.col("without_tail"), F.col("reads")))


def end_elements(reads: DataFrame, seq: str, elements: dict[str, str], reach: int = 40) -> DataFrame:
    """Counts of the first element, by place, within `reach` of the start and of the last within `reach` of the end."""

    def named(places: list[Column], best: Callable[[Column], Column]) -> Column:
        found = F.filter(F.array(*places), lambda x: x.isNotNull())
        return F.coalesce(best(found)["name"], F.lit("none"))

    head, tail = F.substring(F.col(seq), F.lit(1), F.lit(reach)), F.expr(f"right(`{seq}`, {reach})")
    first = [F.when(F.locate(m, head) > 0, F.struct(F.locate(m, head).alias("at"), F.lit(n).alias("name"))) for n, m in elements.items()]
    back = [F.when(F.locate(m[::-1], F.reverse(tail)) > 0, F.struct((-F.locate(m[::-1], F.reverse(tail))).alias("at"), F.lit(n).alias("name"))) for n, m in elements.items()]
    rows = reads.select(F.explode(F.array(F.struct(F.lit("start").alias("end"), named(first, F.array_min).alias("element")), F.struct(F.lit("end").alias("end"), named(back, F.array_max).alias("element")))).alias("e")).select("e.*")
    return rows.groupBy("end", "element").agg(F.count("*").alias("reads"))


def window_composition(windows: DataFrame, seq: str, by: list[str], run: int = 9, width: int = 12) -> DataFrame:
    """Mean share of each letter and of windows with a stretch rich in A, under peaks and elsewhere."""
    s = F.col(seq)
    rich = F.exists(F.sequence(F.lit(1), F.greatest(F.length(s) - width + 1, F.lit(1))), lambda i: F.regexp_count(F.substring(s, i, F.lit(width)), F.lit("A")) >= run)
    share = [F.avg(F.regexp_count(s, F.lit(b)) / F.length(s)).alias(b.lower()) for b in "ACGT"]
    return windows.where(F.length(s) > 0).groupBy(*by).agg(F.count("*").alias("windows"), *share, F.avg(rich.cast("double")).alias("a_rich"))


def expected_species(reads: DataFrame, by: list[str], species: str, expected: str, rdna: Column) -> DataFrame:
    """Percent of reads of the declared species, with and without those in ribosomal loci."""
    right = F.col(species) == F.col(expected)
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    called = F.col(species).isNotNull()
    out = reads.groupBy(*by).agg(n(called).alias("called"), n(right).alias("right"), n(called & ~rdna).alias("called_no_rdna"), n(right & ~rdna).alias("right_no_rdna"))
    return out.withColumn("expected_pct", ratio(100 * F.col("right"), F.col("called"))).withColumn("expected_no_rdna_pct", ratio(100 * F.col("right_no_rdna"), F.col("called_no_rdna")))


def aligned_bases(reads: DataFrame, by: list[str], cigar: str, fragment: str, depth: int | None = None) -> DataFrame:
    """Aligned bases of a group, of a read and of a fragment; with a depth, scaled to so many fragments."""
    bases = cigar_sum(F.col(cigar), "MI=X")
    out = reads.groupBy(*by).agg(F.sum(bases).alias("bases"), F.avg(bases).alias("per_read"), F.count_distinct(fragment).alias("fragments"))
    out = out.withColumn("per_fragment", ratio(F.col("bases"), F.col("fragments")))
    return out.withColumn("at_depth", F.when(F.col("fragments") >= depth, F.col("per_fragment") * depth)) if depth else out


def peaky_genes(genes: DataFrame, peak: str, mean: str, depth: str, from_end: str, fold: float = 8, least_depth: int = 30, least_end: int = 1000) -> DataFrame:
    return genes.where((F.col(peak) >= fold * F.col(mean)) & (F.col(depth) >= least_depth) & (F.col(from_end) >= least_end))


def peakiness(depth: DataFrame, by: list[str], gene: str, length: str) -> DataFrame:
    """Covered share, evenness, peak over mean of each gene's depth (rows of covered positions)."""
    n = F.col("depth")
    out = depth.groupBy(*by, gene).agg(F.count("*").alias("covered"), F.sum(n).alias("_sum"), F.max(n).alias("peak"), F.percentile(n, 0.5).alias("median"), F.max(length).alias("_len"), F.sum(F.sqrt(n)).alias("_root"))
    mean = F.col("_sum") / F.col("_len")
    return out.select(*by, gene, (F.col("covered") / F.col("_len")).alias("covered_share"), (F.col("peak") / mean).alias("peak_to_mean"), "median", (F.col("_root") * F.col("_root") / (F.col("_sum") * F.col("_len"))).alias("evenness"))


def zoom_window(exons: DataFrame, sites: DataFrame, gene: str, start: str, end: str, site: str, least: int = 3) -> DataFrame:
    """First and last exon that a junction's sites touch in each gene, widened to `least` exons, and the span of those."""
    w = Window.partitionBy(gene).orderBy(start)
    numbered = exons.withColumn("_i", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(gene)))
    hit = numbered.join(sites.select(gene, site), gene).where((F.col(site) >= F.col(start)) & (F.col(site) <= F.col(end)))
    span = hit.groupBy(gene).agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.max("_all").alias("_n"))
    short = F.greatest(F.lit(least) - (F.col("_b") - F.col("_a") + 1), F.lit(0))
    low = F.greatest(F.col("_a") - F.ceil(short / 2), F.lit(1))
    high = F.least(low + F.greatest(F.lit(least) - 1, F.col("_b") - F.col("_a") + F.ceil(short / 2)), F.col("_n"))
    wide = span.withColumn("_lo", F.least(low, F.greatest(high - least + 1, F.lit(1)))).withColumn("_hi", F.greatest(high, F.col("_b")))
    return numbered.join(wide, gene).where((F.col("_i") >= F.col("_lo")) & (F.col("_i") <= F.col("_hi"))).groupBy(gene).agg(F.min(start).alias("window_start"), F.max(end).alias("window_end"), F.count("*").alias("exons"))
