"""Top lists and small positional helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import cigar_ops, hamming


def signed_top(rows: DataFrame, effect: str, by: str, key: str, n: int = 5) -> DataFrame:
    """The n rows of least `by` with effects up, and as many with effects down; ties by key."""
    side = F.when(F.col(effect) > 0, "up").when(F.col(effect) < 0, "down")
    rank = F.row_number().over(Window.partitionBy("side").orderBy(by, key))
    # each side is cut to n by a limit, so no window sees more than 2 n rows
    cut = [rows.withColumn("side", side).where(F.col("side") == s).orderBy(by, key).limit(n) for s in ("up", "down")]
    return cut[0].unionByName(cut[1]).withColumn("place", rank)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def labelled_outliers(rows: DataFrame, difference: str, mean: str, key: str, n: int = 15) -> DataFrame:
    """The n rows on each side of largest |difference| times mean."""
    weight = F.abs(F.col(difference)) * F.col(mean)
    sides = [rows.where(test).withColumn("weight", weight).withColumn("side", F.lit(name)).orderBy(F.col("weight").desc(), key).limit(n) for name, test in (("above", F.col(difference) > 0), ("below", F.col(difference) < 0))]
    return sides[0].unionByName(sides[1])


def effect_by_length(rows: DataFrame, length: str, effect: str, edges: list[float]) -> DataFrame:
    """Median effect and rows for each bin of lengths."""
    bin_no = F.lit(0)
    for e in edges:
        bin_no = bin_no + F.when(F.col(length) >= e, 1).otherwise(0)
    return rows.groupBy(bin_no.alias("bin")).agg(F.percentile(effect, 0.5).alias("median"), F.count("*").alias("rows"))


def base_at(seq: Column, cigar: Column, start: Column, pos: Column) -> Column:
    """The read's base aligned to a 0-based reference position; null in a gap or outside."""
    state = F.struct(start.cast("int").alias("ref"), F.lit(1).alias("read"), F.lit(None).cast("string").alias("base"))

    def step(s: Column, o: Column) -> Column:
        both, ref, read = o["op"].isin("M", "=", "X"), o["op"].isin("D", "N"), o["op"].isin("I", "S")
        here = both & (pos >= s["ref"]) & (pos < s["ref"] + o["n"])
        base = F.when(here, F.substring(seq, (s["read"] + pos - s["ref"]).cast("int"), F.lit(1))).otherwise(s["base"])
        return F.struct((s["ref"] + F.when(both | ref, o["n"]).otherwise(0)).alias("ref"), (s["read"] + F.when(both | read, o["n"]).otherwise(0)).alias("read"), base.alias("base"))

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: s["base"])


def aligned_sites(rows: DataFrame, key: list[str], first: str, second: str) -> DataFrame:
    """Collinear sites of two aligned strings with gaps: 0-based places in both, and their letters, where they differ."""
    pairs = rows.select(*key, F.posexplode(F.arrays_zip(F.split(first, "").alias("a"), F.split(second, "").alias("b"))).alias("i", "x")).select(*key, "i", "x.a", "x.b")
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.coalesce(F.count_if(F.col(c) != "-").over(w), F.lit(0))
    return pairs.withColumn("a_pos", at("a")).withColumn("b_pos", at("b")).where("a <> b and a <> '-' and b <> '-'").select(*key, "a_pos", "b_pos", "a", "b")


def index_in(window: Column, indexes: list[str], mismatches: int = 1) -> Column:
    """The first index found by sliding over a window, with at most so many substitutions: struct<at, index>."""
    n = len(indexes[0])
    places = F.when(F.length(window) >= n, F.sequence(F.lit(0), F.length(window) - n)).otherwise(F.array().cast("array<int>"))

    def hit(i: Column) -> Column:
        part = F.substring(window, i + 1, F.lit(n))
        near = F.array(*(F.struct(hamming(part, F.lit(x)).alias("d"), F.lit(x).alias("index")) for x in indexes))
        best = F.array_min(near)
        return F.when(best["d"] <= mismatches, F.struct(i.alias("at"), best["index"].alias("index")))

    return F.array_min(F.filter(F.transform(places, hit), lambda x: x.isNotNull()))


def barcode_list(text: Column) -> Column:
    """array<struct<code, plot>> of 'BC01(#3) BC02(#4)'."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"BC\d+\(#\d+\)"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"BC\d+", 0).alias("code"), F.regexp_extract(x, r"#(\d+)", 1).cast("int").alias("plot")))


def barcode_notes(text: Column) -> Column:
    """Map of 'BC01: note | BC02: note'."""
    return F.map_from_entries(F.transform(F.filter(F.split(text, r"\s*\|\s*"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def derived_sequences(entries: DataFrame, name: str, seq: str) -> DataFrame:
    """Entries with their reverse complements, each sequence once (the entry before the derived, then by name)."""
    from ..functions.sequence import reverse_complement

    both = entries.select(name, seq, F.lit(0).alias("_d")).unionByName(entries.select(F.concat(F.col(name), F.lit("_rc")).alias(name), reverse_complement(F.col(seq)).alias(seq), F.lit(1).alias("_d")))
    return both.groupBy(seq).agg(F.min(F.struct("_d", name)).alias("_e")).select(F.col(f"_e.{name}").alias(name), seq)


def manifest(reads: DataFrame, by: str, read: str, seq: str, qual: str) -> DataFrame:
    """Reads and an order-free digest for each library: sums of hashes, so parts can be added up."""
    h = F.xxhash64(read, seq, qual).cast("decimal(38,0)")
    return reads.groupBy(by).agg(F.count("*").alias("reads"), F.count_distinct(read).alias("read_ids"), F.sum(h).alias("digest"))
