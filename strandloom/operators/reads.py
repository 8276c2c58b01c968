"""Preparation and scoring of reads: gates, classes, inserts, footprints, and tables by library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import cigar_sum, introns_of, pair_entropy, run_length_at, species_of
from ..functions.statistics import ratio

#: Expressions for ribosomal-protein genes, by the rule's name.
RIBOSOMAL = {
    "cytosolic": "^RP[LS][0-9]",
    "with mitochondrial": "^(RP[LS]|MRP[LS])[0-9]",
    "no kinases": "^RP[LS](?!6K)",
    "plain": "^(RPL|RPS)",
    "any case": "(?i)^RP[LS][0-9]",
    "kinase-free tail": "^RP[LS][^K]*$",
    "mitochondrial too, no kinases": "(?i)^M?RP[LS][^Kk]*$",
}


def is_ribosomal(gene: Column, rule: str = "plain") -> Column:
    return gene.rlike(RIBOSOMAL[rule])


def is_messenger(gene: Column, biotype: Column, contig: Column, rule: str = "plain") -> Column:
    """Protein coding, neither mitochondrial nor ribosomal."""
    return (biotype == "protein_coding") & ~contig.rlike("(^|_)(chr)?MT?$") & ~is_ribosomal(gene, rule)


def exon_class(gene: Column, biotype: Column, rule: str = "plain") -> Column:
    """rrna, ribosomal_protein, coding or other."""
    return F.when(biotype.rlike("rRNA"), "rrna").when((biotype == "protein_coding") & is_ribosomal(gene, rule), "ribosomal_protein").when(biotype == "protein_coding", "coding").otherwise("other")


def tail_class(tail: Column, adapter: str, entropy: float = 0.65, least: int = 40) -> Column:
    """What stands behind a poly-A run: short, adapter, simple or other."""
    return F.when(F.length(tail) < least, "short").when(tail.contains(adapter), "adapter").when(pair_entropy(tail) < entropy, "simple").otherwise("other")


def run_starts_between(seq: Column, base: str, least: int, low: int, high: int) -> Column:
    """Whether a run of `least` of `base` begins at a 0-based place from `low` to `high`."""
    return seq.rlike(f"^.{{{low},{high}}}{base}{{{least},}}")


def split_barcode(seq: Column, code: int, tag: int) -> Column:
    """struct<code, tag, rest>; null where the read is too short or either holds an N."""
    out = F.struct(F.substring(seq, 1, code).alias("code"), F.substring(seq, code + 1, tag).alias("tag"), F.substring(seq, F.lit(code + tag + 1), F.length(seq)).alias("rest"))
    return F.when((F.length(seq) >= code + tag) & ~F.substring(seq, 1, code + tag).contains("N"), out)


def pick_tag(kind: Column, seq: Column, forms: dict[str, list[tuple[int, int]]]) -> Column:
    """The tag of a read's chemistry: stretches (start, length) joined; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, parts in forms.items():
        out = F.when(kind == name, F.concat(*(F.substring(seq, s + 1, n) for s, n in parts))).otherwise(out)
    return out


def long_enough(insert: Column, run: Column, least: int = 30) -> Column:
    return insert - run >= least


def distance_fits(lead: Column, expected: Column, tolerance: Column | int) -> Column:
    """Whether an insert begins about where the barcode says, or the alignment straddles that place."""
    return (F.abs(lead - expected) <= tolerance) | ((lead < expected) & (lead + tolerance >= expected))


def matches_rule(rows: DataFrame, rules: DataFrame, key: str, column: str, pattern: str = "pattern") -> DataFrame:
    """Rows whose column matches their key's expression; keys without one pass."""
    return rows.join(rules.select(key, pattern), key, "left").where(F.col(pattern).isNull() | F.expr(f"`{column}` rlike `{pattern}`")).drop(pattern)


def suffix_match(names: DataFrame, registry: DataFrame, name: str, key: str) -> DataFrame:
    """name -> key: the equal key, else the only key that ends in the name; null where several do. Keys are joined by their suffixes."""
    asked = names.select(name).distinct()
    ends = registry.select(key).distinct().withColumn("_end", F.explode(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.substring(F.col(key), i, F.length(key)))))
    pairs = asked.join(ends, F.col(name) == F.col("_end"))
    best = pairs.groupBy(name).agg(F.max(F.when(F.col(key) == F.col(name), F.col(key))).alias("_same"), F.count("*").alias("_n"), F.min(key).alias("_one"))
    return asked.join(best.select(name, F.coalesce("_same", F.when(F.col("_n") == 1, F.col("_one"))).alias(key)), name, "left")


def paired_mates(alignments: DataFrame, read: str, keep: list[str]) -> DataFrame:
    """One row for each read with both mates as structs m1 and m2: an aggregate by name, not a self-join."""
    mate = F.when(F.col("flag").bitwiseAND(0x40) != 0, 1).when(F.col("flag").bitwiseAND(0x80) != 0, 2)
    one = lambda k: F.max(F.when(mate == k, F.struct(*keep)))
    return alignments.groupBy(read).agg(one(1).alias("m1"), one(2).alias("m2"))


def genomic_insert(length: Column, start: Column, cigar: Column, mate_start: Column, mate_cigar: Column, limit: int = 1500) -> Column:
    """Insert of a pair: its span without the union of its introns, at most `limit`."""
    spans = F.array_sort(F.array_union(introns_of(start, cigar), introns_of(mate_start, mate_cigar)))
    state = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("reach"))
    union = F.aggregate(spans, state, lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], s["reach"]))).alias("sum"), F.greatest(s["reach"], x["e"]).alias("reach")), lambda s: s["sum"])
    return F.least(F.greatest(F.abs(length) - union, F.lit(0)), F.lit(limit))


def transcript_insert(t1: Column, t2: Column, gene1: Column, gene2: Column) -> Column:
    return F.when(gene1 == gene2, F.abs(t1 - t2) + 1)


def duplicate_stats(reads: DataFrame, footprint: list[str], by: list[str]) -> DataFrame:
    """Reads, footprints, reads in shared footprints, and percent of reads that repeat one."""
    groups = reads.groupBy(*dict.fromkeys([*by, *footprint])).agg(F.count("*").alias("_n"))
    out = groups.groupBy(*by).agg(F.sum("_n").alias("reads"), F.count("*").alias("footprints"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("in_groups"))
    return out.withColumn("dup_pct", ratio(100 * (F.col("reads") - F.col("footprints")), F.col("reads")))


def sequence_duplicates(reads: DataFrame, seq: str, ends: int = 20) -> DataFrame:
    """Reads, distinct sequences and distinct pairs of ends."""
    return reads.agg(F.count("*").alias("reads"), F.count_distinct(seq).alias("sequences"), F.count_distinct(F.concat(F.substring(seq, 1, ends), F.expr(f"right(`{seq}`, {ends})"))).alias("fingerprints"))


def gene_tag_duplicates(reads: DataFrame, gene: str, tag: str, contig: str) -> DataFrame:
    """Reads and molecules (tags of a gene) of each species and of both."""
    rows = reads.withColumn("species", species_of(F.col(contig))).groupBy("species", gene, tag).agg(F.count("*").alias("_n"))
    return rows.rollup("species").agg(F.sum("_n").alias("reads"), F.count("*").alias("molecules")).withColumn("dup_pct", ratio(100 * (F.col("reads") - F.col("molecules")), F.col("reads")))


def error_rate(reads: DataFrame, by: list[str], cigar: str, mismatches: str) -> DataFrame:
    """(substitutions + inserted + deleted) over (aligned + inserted + deleted) bases."""
    c = F.col(cigar)
    wrong = F.col(mismatches) + cigar_sum(c, "ID")
    return reads.groupBy(*by).agg(ratio(F.sum(wrong), F.sum(cigar_sum(c, "MID=X"))).alias("error_rate"))


def extent_histogram(reads: DataFrame, distance: str, width: int = 25, most: int = 3000) -> DataFrame:
    """Reads by distance in bins, the last one open."""
    return reads.where(F.col(distance).isNotNull()).groupBy((F.floor(F.least(F.col(distance), F.lit(most)) / width) * width).alias("bin")).agg(F.count("*").alias("reads"))


def scored(reads: DataFrame, by: list[str], exclusions: list[tuple[str, Column]], correct: Column) -> DataFrame:
    """Each read is excluded by its first reason or scored: counts of both and the accuracy of those scored."""
    reason = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in exclusions))
    rows = reads.withColumn("_reason", reason)
    out = rows.groupBy(*by).agg(*(F.count_if(F.col("_reason") == name).alias(name) for name, _ in exclusions), F.count_if(F.col("_reason").isNull()).alias("scored"), F.count_if(F.col("_reason").isNull() & F.coalesce(correct, F.lit(False))).alias("correct"))
    return out.withColumn("accuracy_pct", ratio(100 * F.col("correct"), F.col("scored")))


def accuracy_by(reads: DataFrame, by: Column, correct: Column, into: str = "class") -> DataFrame:
    """Reads and accuracy by a class, a run length or a bin of lengths."""
    return reads.groupBy(by.alias(into)).agg(F.count("*").alias("reads"), (100 * F.count_if(correct) / F.count("*")).alias("accuracy_pct"))


def length_bin(length: Column, width: int = 50) -> Column:
    return F.floor(length / width) * width


def code_filters(reads: DataFrame, code: str, species: str, filters: list[tuple[str, Column]], top: int = 10) -> DataFrame:
    """Reads of each code and species under nested filters, in one pass, for the most frequent codes."""
    so_far, columns = F.lit(True), []
    for name, test in filters:
        so_far = so_far & F.coalesce(test, F.lit(False))
        columns.append(F.count_if(so_far).alias(name))
    counts = reads.groupBy(code, species).agg(F.count("*").alias("reads"), *columns)
    leading = counts.groupBy(code).agg(F.sum("reads").alias("_n")).orderBy(F.col("_n").desc(), code).limit(top)
    return counts.join(F.broadcast(leading.select(code)), code, "left_semi")


def plate_variation(rows: DataFrame, condition: str, value: str) -> DataFrame:
    """Coefficient of variation (population SD) within each condition of two samples or more."""
    return rows.groupBy(condition).agg(F.count("*").alias("n"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0))).alias("cv")).where("n > 1")


#: Positions of a tile of peak_windows().
PEAK_TILE = 1 << 12


def peak_windows(reads: DataFrame, spots: DataFrame, on: list[str], pos: str, spot: str, tag: str, sample: str, reach: int = 25) -> DataFrame:
    """Reads, molecules and the share of the top sample within `reach` of each spot; spots without reads are left out.

    Equal reads are counted first, and positions are cut into tiles. A tile's spots meet the reads of the tile and of `reach` beyond it in one task, where windows
    are differences of running sums: work grows with reads and spots, not with their pairs, and no row comes out but a spot's.
    """
    width = max(PEAK_TILE, 2 * reach + 1)
    tile_of = lambda c: F.floor(c / width).cast("long")
    counted = reads.where(F.col(pos).isNotNull()).groupBy(*on, pos, sample, tag).agg(F.count("*").alias("_n"))
    own = counted.select(*on, F.col(pos).cast("long").alias("_at"), F.col(sample).alias("_sample"), F.col(tag).alias("_tag"), "_n")
    own = own.withColumn("_tile", F.explode(F.sequence(tile_of(F.col("_at") - reach), tile_of(F.col("_at") + reach)))).na.drop(subset=on)
    # new names: both sides may come from one table
    keys = [f"_on{i}" for i in range(len(on))]
    asked = spots.na.drop(subset=[*on, spot]).select(*(F.col(c).alias(k) for c, k in zip(on, keys)), F.col(spot).cast("long").alias("_at"), tile_of(F.col(spot)).alias("_spot_tile"))
    kinds = {f.name: f.dataType.simpleString() for f in spots.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on) + f", `{spot}` long, reads long, molecules long, top_share double"

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.unique(right.column("_at").to_numpy())
        group = [pa.array([k.as_py()] * len(at), k.type) for k in key[:-1]]
        sums = _window_sums(left, at, int(key[-1].as_py()) * width - reach, width + 2 * reach, reach)
        seen = sums[0] > 0
        columns = [*group, pa.array(at), *map(pa.array, (sums[0], sums[1], np.divide(sums[2], sums[0], out=np.zeros(len(at)), where=seen)))]
        return pa.table([c.filter(pa.array(seen)) for c in columns], names=[*on, spot, "reads", "molecules", "top_share"])

    sides = own.groupBy(*on, "_tile").cogroup(asked.groupBy(*keys, "_spot_tile"))
    return sides.applyInArrow(run, schema).select(*on, F.col(spot).cast(kinds[spot]).alias(spot), "reads", "molecules", "top_share")


def _window_sums(reads: pa.Table, spots: np.ndarray, first: int, places: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads, molecules and reads of the top sample within `reach` of each spot, from rows (_at, _sample, _tag, _n) at `first` and the `places` from there."""
    at, n = reads.column("_at").to_numpy() - first, reads.column("_n").to_numpy()
    codes = [reads.column(c).combine_chunks().dictionary_encode() for c in ("_sample", "_tag")]
    known = np.logical_and.reduce([c.indices.is_valid().to_numpy(False) for c in codes])
    s, t = (c.indices.fill_null(len(c.dictionary)).to_numpy().astype(np.int64) for c in codes)
    place = spots - first
    # a molecule is seen from `reach` before a read to `reach` behind it, and once where its reads' stretches overlap
    order = np.lexsort((at[known], t[known], s[known]))
    ka, ks, kt = at[known][order], s[known][order], t[known][order]
    since = ka - reach
    same = np.flatnonzero((ks[1:] == ks[:-1]) & (kt[1:] == kt[:-1])) + 1
    since[same] = np.maximum(since[same], ka[same - 1] + reach + 1)
    until = ka + reach + 1
    change = np.bincount(np.clip(since, 0, places), minlength=places + 1) - np.bincount(np.clip(until, 0, places), minlength=places + 1)
    molecules = np.cumsum(change)[place].astype(np.int64)
    # reads of one sample after another: of those in a spot's window, by running sums over its own rows
    total, top = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
    order = np.lexsort((at, s))
    at, n, s = at[order], n[order], s[order]
    cuts = np.flatnonzero(np.diff(s)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
        so_far = np.concatenate([[0], np.cumsum(n[a:b])])
        # only spots that this sample's reads can reach
        x, y = np.searchsorted(place, [at[a] - reach, at[b - 1] + reach + 1]) if b > a else (0, 0)
        inside = so_far[np.searchsorted(at[a:b], place[x:y] + reach, "right")] - so_far[np.searchsorted(at[a:b], place[x:y] - reach)]
        total[x:y] += inside
        top[x:y] = np.maximum(top[x:y], inside)
    return total, molecules, top


def fragment_types(reads: DataFrame, sample: str, read: str, rules: dict[str, Column]) -> DataFrame:
    """Fragments of each type by sample: a fragment has the first type of which any of its reads holds."""
    per = reads.groupBy(sample, read).agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"_{k}") for k, t in rules.items()))
    kind = F.coalesce(*(F.when(F.col(f"_{k}"), k) for k in rules), F.lit("none"))
    return per.groupBy(sample, kind.alias("type")).agg(F.count("*").alias("fragments"))


def inclusion_index(t: Column, a: Column, c: Column, g: Column) -> Column:
    """(t / a) / (c / g); null where a count of a denominator is 0."""
    return F.when((a > 0) & (c > 0) & (g > 0), t / a / (c / g))


def paralog_inclusion(own: Column, other: Column, skipped: Column) -> Column:
    """struct of inclusion of each paralog and of both, when skipping reads can't be told apart and are shared by weight."""
    both = own + other
    part = lambda x: F.when(both > 0, skipped * x / both)
    return F.struct(ratio(own, own + part(own)).alias("own"), ratio(other, other + part(other)).alias("other"), ratio(both, both + skipped).alias("both"))


def exclusions(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return rows.join(listed.select(key).distinct(), key, "left_anti")


def stage_flow(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Wide stage counts as edges: from, to and rows kept or lost between neighbouring stages."""
    edges = [F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(b).cast("long").alias("n")) for a, b in zip(stages, stages[1:])]
    lost = [F.struct(F.lit(a).alias("from"), F.lit("lost").alias("to"), (F.col(a) - F.col(b)).cast("long").alias("n")) for a, b in zip(stages, stages[1:])]
    return rows.select(*by, F.explode(F.array(*edges, *lost)).alias("_e")).select(*by, "_e.*")


def ordered_stages(fate: DataFrame, name: str, stages: list[str]) -> DataFrame:
    """Rows in which a later stage has more than an earlier one."""
    wrong = F.lit(False)
    for a, b in zip(stages, stages[1:]):
        wrong = wrong | (F.col(b) > F.col(a))
    return fate.agg(F.lit(name).alias("check"), (F.count_if(wrong) == 0).alias("passed"), F.count_if(wrong).cast("string").alias("detail"))


def group_funnel(rows: DataFrame, groups: DataFrame, sample: str, group: str, level: str, accuracy: str) -> DataFrame:
    """Mean, least and largest accuracy over samples at each level, for overlapping groups of samples."""
    return rows.join(groups, sample).groupBy(group, level).agg(F.avg(accuracy).alias("mean"), F.min(accuracy).alias("least"), F.max(accuracy).alias("most"), F.count("*").alias("samples"))


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group and its share; ties by value."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("_n", value)).alias(value), (F.max("_n") / F.sum("_n")).alias("share"))


def ranked(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def prep_counters(reads: DataFrame, seq: str, code: str, mismatches: str, insert: str, at: int, least: int = 30) -> DataFrame:
    """Reads, calls by mismatches, too short ones and written ones, in one aggregate."""
    called = F.col(code).isNotNull()
    short = called & ~long_enough(F.length(insert), run_length_at(F.col(seq), at), least)
    return reads.agg(F.count("*").alias("n"), F.count_if(~called).alias("no_code"), F.count_if(called & (F.col(mismatches) == 0)).alias("exact"), F.count_if(called & (F.col(mismatches) == 1)).alias("one_off"), F.count_if(short).alias("too_short"), F.count_if(called & ~short).alias("written"))
