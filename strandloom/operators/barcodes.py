"""Barcode calls: codes are a small declared list, so lookups are tables of all strings near a code."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import BASES, hamming, hamming_fixed

#: Strings that a lookup may hold at most; longer code lists are compared code by code.
LOOKUP_ROWS = 2_000_000


def neighbours(code: str, mismatches: int) -> dict[str, int]:
    """All strings of A, C, G, T, N within so many substitutions, with their number."""
    out = {code: 0}
    for k in range(1, mismatches + 1):
        for at in combinations(range(len(code)), k):
            for letters in product((*BASES, "N"), repeat=k):
                made = list(code)
                for i, x in zip(at, letters):
                    made[i] = x
                text = "".join(made)
                if text not in out:
                    out[text] = sum(a != b for a, b in zip(text, code))
    return out


def lookup(codes: list[str], mismatches: int = 1) -> dict[str, tuple[str | None, int]]:
    """Window -> (code, substitutions) for codes of one length; (None, substitutions) where two codes tie."""
    out: dict[str, tuple[str | None, int]] = {}
    for code in codes:
        for text, d in neighbours(code, mismatches).items():
            have = out.get(text)
            if have is None or d < have[1]:
                out[text] = (code, d)
            elif d == have[1]:
                out[text] = (None, d)
    if len(out) > LOOKUP_ROWS:
        raise ValueError("too many codes or mismatches for a lookup")
    return out


def call_positional(reads: DataFrame, seq: str, codes: list[str], mismatches: int = 1) -> DataFrame:
    """Add `code` and `mismatches`: the longest length at which a code is near decides; a tie there leaves both null."""
    spark, out = reads.sparkSession, reads
    lengths = sorted({len(c) for c in codes}, reverse=True)
    for n in lengths:
        rows = [(t, c, d) for t, (c, d) in lookup([c for c in codes if len(c) == n], mismatches).items()]
        table = spark.createDataFrame(rows, f"_w{n} string, _c{n} string, _d{n} int")
        out = out.withColumn(f"_w{n}", F.substring(seq, 1, n)).join(F.broadcast(table), f"_w{n}", "left")
    hit = lambda n: F.col(f"_d{n}").isNotNull()
    code, dist = F.lit(None).cast("string"), F.lit(None).cast("int")
    for n in reversed(lengths):
        code = F.when(hit(n), F.col(f"_c{n}")).otherwise(code)
        dist = F.when(hit(n), F.when(F.col(f"_c{n}").isNotNull(), F.col(f"_d{n}"))).otherwise(dist)
    out = out.withColumn("code", code).withColumn("mismatches", dist)
    return out.drop(*(f"_{k}{n}" for n in lengths for k in "wcd"))


def call_against(seq: Column, codes: list[str], mismatches: int = 1) -> Column:
    """(code, distance) of the only nearest code within the limit, by comparing with each code of a short list."""
    each = F.array(*(F.struct(hamming(seq, F.lit(c)).alias("d"), F.lit(c).alias("code")) for c in codes))
    near = F.filter(each, lambda x: x["d"] <= mismatches)
    best = F.array_min(F.transform(near, lambda x: x["d"]))
    hits = F.filter(near, lambda x: x["d"] == best)
    return F.when(F.size(hits) == 1, hits[0])


def nearest_entry(seq: Column, registry: list[str], mismatches: int) -> Column:
    """The first registry entry of least distance within the limit; ties go to the earlier entry."""
    each = F.array(*(F.struct(hamming(seq, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("code")) for i, c in enumerate(registry)))
    return F.array_min(F.filter(each, lambda x: x["d"] <= mismatches))["code"]


def call_anchored(seq: Column, anchor: str, codes: list[str], mismatches: int = 1) -> Column:
    """Best call right before an exact anchor: (exact, code, at); later G after the anchor breaks ties, then the first place."""
    n, length = len(codes[0]), len(anchor)
    last = F.length(seq) - length
    places = F.when(last >= n, F.filter(F.sequence(F.lit(n), last), lambda i: F.substring(seq, i + 1, F.lit(length)) == anchor)).otherwise(F.array().cast("array<int>"))

    def score(i: Column) -> Column:
        window = F.substring(seq, i + 1 - n, F.lit(n))
        near = F.array(*(F.struct(hamming(window, F.lit(c)).alias("d"), F.lit(c).alias("code")) for c in codes))
        best = F.array_min(near)
        tied = F.size(F.filter(near, lambda x: x["d"] == best["d"])) > 1
        runs = F.length(F.regexp_extract(F.substring(seq, i + 1 + length, F.lit(12)), "^G*", 0))
        return F.when((best["d"] <= mismatches) & ~tied, F.struct((runs >= 3).cast("int").alias("ggg"), (-best["d"]).alias("exact"), (-i).alias("at"), best["code"].alias("code")))

    return F.array_max(F.filter(F.transform(places, score), lambda x: x.isNotNull()))


def near_pairs(tags: DataFrame, tag: str, by: list[str], length: int, mismatches: int = 1) -> DataFrame:
    """Pairs a < b of distinct tags of one group within so many substitutions.

    Two such tags agree in one of mismatches + 1 blocks, so the join is on (group, block, its letters), never on all pairs.
    """
    cuts = [round(i * length / (mismatches + 1)) for i in range(mismatches + 2)]
    blocks = F.array(*(F.struct(F.lit(i).alias("b"), F.substring(tag, cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("w")) for i in range(mismatches + 1)))
    distinct = tags.where(F.length(tag) == length).select(*by, tag).distinct()
    rows = distinct.withColumn("_k", F.explode(blocks)).select(*by, "_k.b", "_k.w", tag)
    other = rows.withColumnRenamed(tag, "_other")
    pairs = rows.join(other, [*by, "b", "w"]).where(F.col(tag) < F.col("_other")).where(hamming_fixed(F.col(tag), F.col("_other"), length) <= mismatches)
    return pairs.select(*by, F.col(tag).alias("a"), F.col("_other").alias("b")).distinct()


def anchored_code_counts(reads: DataFrame, seq: str, anchor: str, codes: list[str], least: int = 20, share: float = 0.002) -> DataFrame:
    """Codes that follow an anchor in at least max(least, share of all reads) reads."""
    n = len(codes[0])
    found = reads.select(F.when(F.locate(anchor, F.col(seq)) > 0, F.expr(f"substring({seq}, locate('{anchor}', {seq}) + {len(anchor)}, {n})")).alias("code"))
    total = reads.agg(F.count("*").alias("_all"))
    counts = found.where(F.col("code").isin(codes)).groupBy("code").agg(F.count("*").alias("reads"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("reads") >= F.greatest(F.lit(least), share * F.col("_all"))).drop("_all")


def unique_kmers(spark: SparkSession, sequences: DataFrame, name: str, seq: str, k: int) -> DataFrame:
    """kmer, name, offset of the k-mers that occur once in all sequences."""
    grams = sequences.where(F.length(seq) >= k).select(name, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(F.col(seq), i, F.lit(k)))).alias("offset", "kmer"))
    return grams.groupBy("kmer").agg(F.count("*").alias("_n"), F.first(name).alias(name), F.first("offset").alias("offset")).where("_n = 1").drop("_n")
