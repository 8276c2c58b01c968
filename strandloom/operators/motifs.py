"""Motifs in reads, exact and fuzzy, and what structures they make: all of it expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming_fixed, occurrences, reverse_complement, run_length_at, tail_match


def seeds(motif: str, differences: int) -> list[tuple[int, str]]:
    """Offset and letters of the differences + 1 blocks of a motif: a place with at most so many differences has one of them unchanged."""
    n = differences + 1
    if n > len(motif):
        raise ValueError("a motif needs a letter more than it may differ in")
    cuts = [round(i * len(motif) / n) for i in range(n + 1)]
    return [(a, motif[a:b]) for a, b in zip(cuts, cuts[1:])]


def seed_places(seq: Column, motif: str, differences: int) -> Column:
    """Where the motif would start for each place at which one of its seeds occurs: an array without repeats, empty in a read that has no seed."""
    none = F.array().cast("array<int>")
    found = [F.when(seq.contains(block), F.transform(occurrences(seq, block), lambda i: i - at)).otherwise(none) for at, block in (seeds(motif, differences))]
    return F.array_distinct(F.concat(*found))


def fuzzy_first(seq: Column, motif: str, mismatches: int, edits: int = 0) -> Column:
    """struct<start, end, distance> of the first place with at most `mismatches` substitutions; failing that, with `edits`, of the first
    end with at most so many edits (its start is then the end less the motif's length). Null without a hit.

    Only places beside a seed are compared, and only ends beside one of the edits' seeds: a read without any is passed over by `contains`. It is an expression.
    """
    m = len(motif)

    def substituted(start: Column) -> Column:
        return F.struct(start.alias("start"), (start + m).alias("end"), hamming_fixed(F.substring(seq, start + 1, F.lit(m)), F.lit(motif), m).alias("distance"))

    fits = F.filter(seed_places(seq, motif, mismatches), lambda i: (i >= 0) & (i + m <= F.length(seq)))
    first = F.array_min(F.filter(F.transform(fits, substituted), lambda x: x["distance"] <= mismatches))
    if not edits:
        return first

    def edited(end: Column) -> Column:
        near = [F.nullif(F.when(end >= size, F.levenshtein(F.substring(seq, end - size + 1, F.lit(size)), F.lit(motif), edits)), F.lit(-1)) for size in range(m - edits, m + edits + 1)]
        return F.struct(end.alias("end"), F.array_min(F.array(*near)).alias("distance"))

    # around a seed that is unchanged the rest holds at most `edits` insertions or deletions
    around = F.flatten(F.transform(seed_places(seq, motif, edits), lambda i: F.sequence(i + (m - edits), i + (m + edits))))
    ends = F.filter(F.array_distinct(around), lambda j: (j >= 1) & (j <= F.length(seq)))
    last = F.array_min(F.filter(F.transform(ends, edited), lambda x: x["distance"].isNotNull()))
    return F.coalesce(first, F.when(last.isNotNull(), F.struct(F.greatest(last["end"] - m, F.lit(0)).alias("start"), last["end"].alias("end"), last["distance"].alias("distance"))))


def backbone_call(seq: Column, backbone: str, codes: list[str], least_tail: int = 6, mismatches: int = 1) -> Column:
    """Best code behind a backbone's tail: struct<score, at, code> by tail length, plus 100 with three G behind the code."""
    n = len(codes[0])
    last = F.length(seq) - n
    places = F.when(last >= least_tail, F.sequence(F.lit(least_tail), last)).otherwise(F.array().cast("array<int>"))

    def score(i: Column) -> Column:
        window = F.substring(seq, i + 1, F.lit(n))
        near = F.array(*(F.struct(F.levenshtein(window, F.lit(c)).alias("d"), F.lit(c).alias("code")) for c in codes))
        best = F.array_min(near)
        tied = F.size(F.filter(near, lambda x: x["d"] == best["d"])) > 1
        tail = tail_match(F.substring(seq, F.lit(1), i), F.lit(backbone))
        ggg = F.substring(seq, i + 1 + n, F.lit(3)) == "GGG"
        return F.when((best["d"] <= mismatches) & ~tied & (tail >= least_tail), F.struct((tail + F.when(ggg, 100).otherwise(0)).alias("score"), (-i).alias("at"), best["code"].alias("code")))

    return F.array_max(F.filter(F.transform(places, score), lambda x: x.isNotNull()))


def both_codes(seq: Column, a: str, b: str) -> Column:
    """Whether both codes, on either strand, are in the read."""
    has = lambda c: seq.contains(c) | reverse_complement(seq).contains(c)
    return has(a) & has(b)


def code_window(seq: Column, code: str, before: int, after: int) -> Column:
    """The stretch around a code that occurs exactly once; else null."""
    at = occurrences(seq, code)
    start = at[0] - before
    return F.when((F.size(at) == 1) & (start >= 0) & (at[0] + len(code) + after <= F.length(seq)), F.substring(seq, start + 1, F.lit(before + len(code) + after)))


def read_class(seq: Column, first: str, second: str, decoys: tuple[str, ...] = ()) -> Column:
    """both, first, second, decoy or neither, by what the read contains on either strand."""
    has = lambda c: seq.contains(c) | reverse_complement(seq).contains(c)
    out = F.when(has(first) & has(second), "both").when(has(first), "first").when(has(second), "second")
    for d in decoys:
        out = out.when(has(d), "decoy")
    return out.otherwise("neither")


def components_of(seq: Column, motifs: dict[str, str]) -> Column:
    """array<struct<start, end, name>> of all places of all motifs on both strands, ordered; neighbours of one name that touch or overlap are one."""
    parts = []
    for name, motif in motifs.items():
        for text in dict.fromkeys((motif, motif[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            parts.append(_places(seq, text, name))
    ordered = F.array_sort(F.flatten(F.array(*parts)))
    empty = F.array().cast("array<struct<start:int,end:int,name:string>>")

    def join(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        same = (F.size(kept) > 0) & (last["name"] == x["name"]) & (x["start"] <= last["end"])
        grown = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), x["name"].alias("name"))))
        return F.when(same, grown).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(ordered, empty, join)


def _places(seq: Column, text: str, name: str) -> Column:
    return F.transform(occurrences(seq, text), lambda i: F.struct(i.cast("int").alias("start"), (i + len(text)).cast("int").alias("end"), F.lit(name).alias("name")))


def largest_gap(parts: Column, length: Column) -> Column:
    """The longest stretch before, between or behind ordered components."""
    starts = F.concat(F.transform(parts, lambda p: p["start"]), F.array(length.cast("int")))
    ends = F.concat(F.array(F.lit(0)), F.transform(parts, lambda p: p["end"]))
    return F.array_max(F.zip_with(starts, ends, lambda s, e: s - e))


def structure_key(parts: Column, first: str | None = None) -> Column:
    """Names in a row, in the direction that begins with `first` if one does, else in the lesser of both."""
    names = F.transform(parts, lambda p: p["name"])
    ahead, back = F.array_join(names, " > "), F.array_join(F.reverse(names), " > ")
    plain = F.least(ahead, back)
    if first is None:
        return plain
    return F.when(F.element_at(names, 1) == first, ahead).when(F.element_at(names, -1) == first, back).otherwise(plain)


def insert_between(seq: Column, left: str, right: str, least: int = 30) -> Column:
    """The stretch between a run of T or A and an anchor, from the stricter to the looser form; null below `least` letters."""
    forms = (rf"T{{10,}}([ACGTN]*?){right}", rf"{left}([ACGTN]*?)A{{10,}}", rf"T{{10,}}([ACGTN]*)$", rf"{left}([ACGTN]*)$")
    got = [F.nullif(F.regexp_extract(seq, f, 1), F.lit("")) for f in forms]
    return F.coalesce(*(F.when(F.length(g) >= least, g) for g in got))


def context_code(seq: Column, prefix: str, suffix: str, length: int = 4) -> Column:
    """The letters between prefix and suffix, forward or else on the other strand."""
    form = f"{prefix}([ACGTN]{{{length}}}){suffix}"
    return F.coalesce(F.nullif(F.regexp_extract(seq, form, 1), F.lit("")), F.nullif(F.regexp_extract(reverse_complement(seq), form, 1), F.lit("")))


def g_run_class(seq: Column, at: int) -> Column:
    """none, short, full or long by the run of G at a place."""
    n = run_length_at(seq, at)
    return F.when(n == 0, "none").when(n < 3, "short").when(n == 3, "full").otherwise("long")


def flank_shares(reads: DataFrame, seq: str, primer: str, flank: int) -> DataFrame:
    """Share of each letter at each place before and behind a primer's first occurrence."""
    at = F.locate(primer, F.col(seq))
    offsets = F.array(*(F.lit(i) for i in [*range(-flank, 0), *range(len(primer), len(primer) + flank)]))
    rows = reads.where(at > 0).select(at.alias("_at"), F.col(seq).alias("_seq"), F.explode(offsets).alias("offset"))
    place = F.col("_at") + F.col("offset")
    letters = rows.where((place >= 1) & (place <= F.length("_seq"))).select("offset", F.expr("substring(_seq, _at + offset, 1)").alias("letter"))
    return letters.groupBy("offset").agg(*((F.count_if(F.col("letter") == b) / F.count("*")).alias(b) for b in "ACGT"))


def modal_string(reads: DataFrame, value: str, least_share: float = 0.15) -> DataFrame:
    """The most frequent value and its share, if that is large enough; ties by value."""
    counts = reads.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("reads"))
    total = counts.agg(F.sum("reads").alias("_all"))
    best = counts.orderBy(F.col("reads").desc(), value).limit(1).crossJoin(F.broadcast(total))
    return best.select(value, (F.col("reads") / F.col("_all")).alias("share")).where(F.col("share") >= least_share)


def evidence(reads: DataFrame, seq: str, seeds: list[str], least_share: float) -> DataFrame:
    """Share of reads with any of the seeds, and whether that suffices."""
    hit = F.lit(False)
    for s in seeds:
        hit = hit | F.col(seq).contains(s)
    return reads.agg(F.avg(hit.cast("double")).alias("share")).withColumn("enough", F.col("share") >= least_share)


def multiplicity(reads: DataFrame, units: str) -> DataFrame:
    """Reads with 0, 1, 2 and 3 or more units; of pairs, those of equal and unequal units, and the share of unequal ones expected by chance."""
    n = F.size(units)
    same = F.get(F.col(units), F.lit(0)) == F.get(F.col(units), F.lit(1))
    counts = reads.agg(*(F.count_if(test).alias(name) for name, test in (("none", n == 0), ("one", n == 1), ("two", n == 2), ("more", n >= 3))), F.count_if((n == 2) & same).alias("same"), F.count_if((n == 2) & ~same).alias("different"))
    each = reads.select(F.explode(units).alias("u")).groupBy("u").agg(F.count("*").alias("k"))
    chance = each.agg((1 - F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("expected_different"))
    return counts.crossJoin(F.broadcast(chance))
