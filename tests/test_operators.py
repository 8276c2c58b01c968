"""Unit tests of operators against small computations by hand or in plain Python."""

import gzip
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import distributions as dist
from strandloom.functions import sequence as sq
from strandloom.functions import statistics as st
from strandloom.operators import barcodes, checks, intervals, matrix, molecules, motifs, sampling, splicing, tables
from strandloom.sources import sinks
from strandloom.sources import text_formats as tf


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_sequence_expressions(spark):
    x = F.col("x")
    assert one(spark, "AACGT", sq.reverse_complement(x)) == "ACGTT"
    assert one(spark, "ACGTGGGG", sq.run_length_at(x, 4)) == 4
    assert one(spark, "ACGGGT", sq.best_run_near(x, 3)) == 3
    assert one(spark, "ACGT" + "A" * 12 + "CC", sq.cut_at_run(x)) == "ACGT"
    assert one(spark, "AAAAAA", sq.pair_entropy(x)) == 0
    assert one(spark, "AC", sq.pair_entropy(x)) == 1
    assert one(spark, "AATTTTAC", sq.longest_run(x)) == 4
    assert one(spark, "xxACGT", sq.tail_match(x, F.lit("yACGT"))) == 4
    assert one(spark, "AAAA", sq.occurrences(x, "AA")) == [0, 1, 2]
    assert one(spark, "a", sq.spaced_hits(F.array(*(F.lit(i) for i in (0, 10, 27, 40, 60))), 27)) == [0, 27, 60]
    assert one(spark, " a--b  (c) ", sq.safe_name(x)) == "a--b_c"
    assert one(spark, "CHX 50-3", sq.condition_of(x)) == "CHX 50" and one(spark, "CHX 50-3", sq.replicate_of(x)) == 3 and one(spark, "DMSO", sq.replicate_of(x)) == 1
    assert one(spark, "id_umi1_umi2_code_3_T", sq.name_part(x, 3)) == "code" and one(spark, "a_b_c_d", sq.name_head(x, 2)) == "a_b"
    assert one(spark, "m:1:f:2:1101:15:20", sq.flow_position(x)["tile"]) == 1101
    assert one(spark, "NNNLEFTACGTRIGHTNN", sq.trim_flanks(x, "LEFT", "RIGHT")) == "ACGT"
    part = one(spark, "chr7:GENE:t:4500|7:4100-4500:+", sq.junction_parts(x))
    assert (part.gene, part.anchor, part.chrom, part.start, part.end, part.strand) == ("GENE", 4500, "7", 4100, 4500, "+")


def test_cigars(spark):
    c = F.col("x")
    cigar = "3S10M2D5M100N7M1I4M2S"
    assert one(spark, cigar, sq.cigar_sum(c, "MDN=X")) == 10 + 2 + 5 + 100 + 7 + 4
    assert one(spark, cigar, sq.cigar_sum(c, "MI=X")) == 10 + 5 + 7 + 1 + 4
    assert [(b.s, b.e) for b in one(spark, cigar, sq.aligned_blocks(F.lit(50), c))] == [(50, 67), (167, 178)]
    assert [(b.s, b.e) for b in one(spark, cigar, sq.aligned_blocks(F.lit(50), c, True))] == [(50, 60), (62, 67), (167, 178)]
    assert [(b.s, b.e) for b in one(spark, cigar, sq.introns_of(F.lit(50), c))] == [(67, 167)]
    assert one(spark, "2S3M1I2M", sq.aligned_query(F.lit("ttACGTCA"), c)) == "ACGTCA"
    assert one(spark, "10M", sq.five_prime(F.lit(5), c, F.lit("-"))) == 14


def test_distributions(spark):
    # closed forms: one and two degrees of freedom, and binomial tails
    t = spark.createDataFrame([(1.0, 1), (2.0, 2)], "t double, df int").select(dist.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert np.allclose([r.p for r in t], [0.5, 1 - 2 / math.sqrt(2 + 4)])
    t = spark.createDataFrame([(1,), (2,), (10,), (10**6,)], "df int").select(dist.t_quantile(0.975, F.col("df")).alias("t")).collect()
    assert np.allclose([r.t for r in t], [12.706204736175, 4.302652729454, 2.228138851986, 1.959966356], atol=1e-9)
    for n, k, p in ((10, 3, 0.2), (25, 20, 0.7), (400, 200, 0.5)):
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        got = spark.range(1).select(dist.beta_cdf(k, n - k + 1, F.lit(p)).alias("p")).first().p
        assert math.isclose(got, tail, rel_tol=1e-12)


def test_quantiles_and_their_distributions_agree(spark):
    draw = np.random.default_rng(8)
    rows = [(float(a), float(b), float(q)) for a, b, q in zip(10 ** draw.uniform(-0.5, 5, 300), 10 ** draw.uniform(-0.3, 5, 300), draw.uniform(0.001, 0.999, 300))]
    frame = spark.createDataFrame([*rows, (2.0, 3.0, 0.0), (2.0, 3.0, 1.0)], "a double, b double, q double").withColumn("x", dist.beta_quantile(F.col("q"), F.col("a"), F.col("b")))
    got = frame.withColumn("back", dist.beta_cdf(F.col("a"), F.col("b"), F.col("x"))).collect()
    assert max(abs(r.back - r.q) for r in got) < 1e-8
    none = spark.createDataFrame([(None, 1.0, 0.5), (1.0, None, 0.5), (1.0, 1.0, None)], "a double, b double, q double")
    assert all(r.x is None for r in none.select(dist.beta_quantile(F.col("q"), F.col("a"), F.col("b")).alias("x")).collect())
    values = spark.range(1, 400).select((F.col("id") / 7).alias("x")).select("x", dist.log_gamma(F.col("x")).alias("g")).collect()
    assert max(abs(r.g - math.lgamma(r.x)) / max(1, abs(r.g)) for r in values) < 1e-13


def test_fisher_against_all_tables(spark):
    draw = np.random.default_rng(9)
    tables = [tuple(int(v) for v in draw.integers(0, k, 4)) for k in (2, 5, 30, 300) for _ in range(40)] + [(0, 0, 0, 0), (0, 0, 3, 4), (5, 0, 0, 5)]

    def plain(a, b, c, d):
        ways = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        return sum(w for w in ways.values() if w <= ways[a]) / math.comb(a + b + c + d, a + c)

    rows = spark.createDataFrame(tables, "a long, b long, c long, d long").select(*"abcd", st.fisher_exact(*(F.col(x) for x in "abcd")).alias("p")).collect()
    assert max(abs(r.p - plain(r.a, r.b, r.c, r.d)) for r in rows) < 1e-9
    large = spark.createDataFrame([(500_000, 500_300, 500_100, 500_000)], "a long, b long, c long, d long").select(st.fisher_exact(*(F.col(x) for x in "abcd")).alias("p")).first().p
    z = (abs(500_000 * 500_000 - 500_300 * 500_100) - 0.5 * 2_000_400) / math.sqrt(1_000_300 * 1_000_100 * 1_000_100 * 1_000_300 / 2_000_400)
    assert math.isclose(large, math.erfc(z / math.sqrt(2)), rel_tol=1e-4)


def test_intervals_and_tests(spark):
    d = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k int, n int")
    ci = d.select("k", "n", st.clopper_pearson(F.col("k"), F.col("n")).alias("c")).collect()
    assert ci[0].c.low == 0 and math.isclose(ci[0].c.high, 1 - 0.025**0.1, rel_tol=1e-9)
    assert ci[2].c.high == 1 and math.isclose(ci[1].c.low + ci[1].c.high, 1, rel_tol=1e-9)
    f = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int").select(st.fisher_exact(*(F.col(x) for x in "abcd")).alias("p")).first().p
    assert math.isclose(f, 0.03496503496503495, rel_tol=1e-6)
    rows = spark.createDataFrame([("g", "a", float(x)) for x in (1, 2, 3)] + [("g", "b", float(x)) for x in (4, 5, 6, 7)], "g string, arm string, v double")
    r = st.mann_whitney(rows, ["g"], "v", "arm", "a").first()
    assert r.u == 0 and math.isclose(r.p, 2 / math.comb(7, 3))
    w = splicing.welch(rows, ["g"], "v", F.col("arm") == "b").first()
    assert math.isclose(w.t, 3.5 / math.sqrt(1 / 3 + (5 / 3) / 4), rel_tol=1e-9) and 0 < w.p < 0.05
    flat = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 1.0), ("g", "b", 1.0), ("g", "b", 1.0)], "g string, arm string, v double")
    assert splicing.welch(flat, ["g"], "v", F.col("arm") == "b").first().p == 1
    line = spark.createDataFrame([("g", float(x), 2.0 * x) for x in range(5)], "g string, dose double, v double")
    s = splicing.slope(line, ["g"], "v", "dose").first()
    assert math.isclose(s.slope, 2.0)


def test_barcodes(spark):
    reads = spark.createDataFrame([("AAAATTT",), ("AAACTTT",), ("ACCATTT",), ("AA",), ("GGGGGGG",)], "seq string")
    got = [r.code for r in barcodes.call_positional(reads, "seq", ["AAAA", "CCCC", "GGGGGG"]).orderBy("seq").collect()]
    assert sorted(x for x in got if x) == ["AAAA", "AAAA", "GGGGGG"]
    tie = spark.createDataFrame([("AAAC",)], "seq string")
    assert barcodes.call_positional(tie, "seq", ["AAAA", "AACC"]).first().code is None
    assert one(spark, "TTACGTGGATTACAGGGTT", barcodes.call_anchored(F.col("x"), "ATTACA", ["CGTGG", "TTTTT"]))["code"] == "CGTGG"
    assert one(spark, "ACGA", barcodes.call_against(F.col("x"), ["ACGT", "TTTT"]))["code"] == "ACGT"


def test_near_pairs_lose_none(spark):
    draw = random.Random(1)
    tags = {"".join(draw.choice("ACGT") for _ in range(6)) for _ in range(300)}
    got = {(r.a, r.b) for r in barcodes.near_pairs(spark.createDataFrame([("w", t) for t in tags], "well string, tag string"), "tag", ["well"], 6, 2).collect()}
    want = {(a, b) for a in tags for b in tags if a < b and sum(x != y for x, y in zip(a, b)) <= 2}
    assert got == want
    clusters = {r.tag: r.cluster for r in molecules.tag_clusters(spark.createDataFrame([("w", t) for t in tags], "well string, tag string"), ["well"], "tag", 6, 1).collect()}
    links = [(a, b) for a, b in want if sum(x != y for x, y in zip(a, b)) <= 1]
    assert all(clusters[a] == clusters[b] for a, b in links) and all(clusters[t] <= t for t in tags)


def test_greedy_windows(spark):
    rows = [("w", "c", "+", 10, "ACGT", "g1"), ("w", "c", "+", 15, "ACGT", "g2"), ("w", "c", "+", 16, "ACGA", "g3"), ("w", "c", "+", 25, "ACGT", "g4"), ("w", "c", "+", 26, "ACGN", "g5"), ("w", "c", "-", 10, "ACGT", "g6")]
    frame = spark.createDataFrame(rows, "well string, contig string, strand string, pos int, umi string, gene string")
    got = sorted((r.gene, r.anchor, r.reads) for r in molecules.anchored_windows(frame, "well", "contig", "strand", "pos", "umi", "gene", 1, 10).collect())
    assert got == [("g1", 10, 3), ("g4", 25, 1), ("g6", 10, 1)]
    exact = molecules.anchored_windows(frame, "well", "contig", "strand", "pos", "umi", "gene", 0, 0)
    assert exact.count() == 5


def test_saturation_and_size(spark):
    h = spark.createDataFrame([("w", 1, 60), ("w", 2, 20)], "well string, reads_per_molecule int, molecules long")
    rows = molecules.saturation(h, ["well"]).orderBy("depth").collect()
    assert rows[-1].depth == 100 and math.isclose(rows[-1].expected, 80) and math.isclose(rows[0].expected, 1.0, rel_tol=1e-9)
    assert all(a.expected < b.expected for a, b in zip(rows, rows[1:]))
    n = spark.createDataFrame([(100.0, 80.0), (100.0, 100.0)], "n double, u double").select(molecules.library_size(F.col("n"), F.col("u")).alias("c")).collect()
    assert math.isclose(n[0].c * (1 - math.exp(-100 / n[0].c)), 80, rel_tol=1e-9) and (n[1].c is None or math.isnan(n[1].c))


def test_jitter(spark):
    frame = spark.createDataFrame([("g", 1, 10), ("g", 3, 12), ("g", 5, 14), ("g", 30, 40)], "g string, s int, e int")
    assert molecules.jitter_molecules(frame, ["g"], "s", "e", 2).first().molecules == 2
    assert molecules.jitter_molecules(frame, ["g"], "s", "e", 0).first().molecules == 4


def test_overlaps_lose_none(spark):
    draw = random.Random(2)
    left = [(i, s, s + draw.randrange(0, 90)) for i in range(150) for s in [draw.randrange(500)]]
    right = [(i, s, s + draw.randrange(0, 300)) for i in range(80) for s in [draw.randrange(500)]]
    a = spark.createDataFrame([(1, *x) for x in left], "c int, i int, s int, e int")
    b = spark.createDataFrame([(1, *x) for x in right], "c int, j int, rs int, re int")
    want = {(i, j) for i, s, e in left for j, rs, re in right if s < re and e > rs and s < e and rs < re}
    for width in (7, 64, 1000):
        rows = intervals.overlap_join(a, b, ["c"], ("s", "e"), ("rs", "re"), width).collect()
        assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == want
    assert {r.i for r in intervals.overlap_join(a, b, ["c"], ("s", "e"), ("rs", "re"), 64, "left_anti").collect()} == {x[0] for x in left} - {i for i, _ in want}


def test_fuzzy_places_against_a_table_of_all_edits(spark):
    draw = random.Random(11)
    motif = "ACGGTACCTAGA"

    def broken(n):
        text = list(motif)
        for _ in range(n):
            i = draw.randrange(len(text))
            draw.choice([lambda i=i: text.pop(i), lambda i=i: text.insert(i, draw.choice("ACGT")), lambda i=i: text.__setitem__(i, draw.choice("ACGT"))])()
        return "".join(text)

    noise = lambda n: "".join(draw.choices("ACGT", k=n))
    seqs = [noise(draw.randint(0, 20)) + broken(draw.randint(0, 4)) + noise(draw.randint(0, 20)) for _ in range(250)] + ["", motif, motif * 3, motif[1:], "N" * 40, None]

    def plain(seq, mismatches, edits):
        m = len(motif)
        for i in range(len(seq) - m + 1):
            if (d := sum(a != b for a, b in zip(seq[i : i + m], motif))) <= mismatches:
                return (i, i + m, d)
        row = list(range(m + 1))
        for j, letter in enumerate(seq if edits else "", 1):
            fresh = [0]
            for i in range(1, m + 1):
                fresh.append(min(fresh[-1] + 1, row[i] + 1, row[i - 1] + (letter != motif[i - 1])))
            row = fresh
            if row[m] <= edits:
                return (max(j - m, 0), j, row[m])
        return None

    frame = spark.createDataFrame(list(enumerate(seqs)), "i int, x string")
    for mismatches, edits in ((0, 0), (1, 0), (2, 1), (1, 2), (3, 3)):
        found = frame.select("i", motifs.fuzzy_first(F.col("x"), motif, mismatches, edits).alias("h"))
        got = {r.i: None if r.h is None else tuple(r.h) for r in found.collect()}
        assert got == {i: None if s is None else plain(s, mismatches, edits) for i, s in enumerate(seqs)}
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    # of reads without a seed none gets to a comparison
    empty = frame.select(F.size(motifs.seed_places(F.col("x"), motif, 1)).alias("n"), "x").where("x is not null").collect()
    assert all(bool(r.n) == any(b in r.x for _, b in motifs.seeds(motif, 1)) for r in empty) and any(not r.n for r in empty)


def test_fuzzy_motifs(spark):
    x = F.col("x")
    assert one(spark, "TTTTACGTACGTTT", motifs.fuzzy_first(x, "ACGAACG", 1))["start"] == 4
    hit = one(spark, "TTTTACGTACTTTT", motifs.fuzzy_first(x, "ACGGTAC", 0, 1))
    assert hit["distance"] == 1 and hit["end"] in (9, 10)
    assert one(spark, "TTTT", motifs.fuzzy_first(x, "ACGAACG", 1, 1)) in (None,) or one(spark, "TTTT", motifs.fuzzy_first(x, "ACGAACG", 1, 1))["start"] is None
    parts = motifs.components_of(x, {"a": "ACCA", "g": "GGATG"})
    assert [(p.start, p.end, p.name) for p in one(spark, "ACCAACCATTGGATGTGGT", parts)] == [(0, 8, "a"), (10, 15, "g"), (15, 19, "a")]  # TGGT is ACCA on the other strand
    assert one(spark, "ACCATTTTTTTTGGATG", motifs.structure_key(parts)) == "a > g"
    assert one(spark, "GGATGTTTTTTTTACCA", motifs.structure_key(parts)) == "a > g"
    assert one(spark, "ACCATTTTTTTTGGATG", motifs.largest_gap(parts, F.length(x))) == 8
    assert one(spark, "AAACCCCGGG", motifs.context_code(x, "AAA", "GGG")) == "CCCC"
    assert one(spark, "NNACGTNNN", motifs.code_window(x, "ACGT", 2, 3)) == "NNACGTNNN"


def test_tables(spark):
    rows = spark.createDataFrame([("a", 3, True), ("a", 1, False), ("b", 2, True)], "k string, lv int, ok boolean")
    got = {(r.level): (r.n, r.correct) for r in tables.cumulative_funnel(rows, [], "lv", "ok", 3).collect()}
    assert got == {0: (3, 2), 1: (3, 2), 2: (2, 2), 3: (1, 1)}
    with pytest.raises(Exception):
        tables.merge_partials(rows, ["k"], ["lv"], constants=["ok"]).collect()
    m = tables.mean_interval(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)], "k string, v double"), ["k"], "v").first()
    assert math.isclose(m.half_width, 4.302652730 * 1 / math.sqrt(3), rel_tol=1e-7)
    maps = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"x": 5})], "k string, c map<string,int>")
    assert {(r.path, r.n) for r in tables.merge_counters(maps, ["k"], "c").collect()} == {("x", 6), ("y", 2)}


def test_sampling_is_nested_and_exact(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    a = {r.id for r in sampling.exact_sample(rows, ["id"], 10).collect()}
    b = {r.id for r in sampling.exact_sample(rows.repartition(7), ["id"], 30).collect()}
    assert len(a) == 10 and a < b
    counts = spark.createDataFrame([("s", "x", 30), ("s", "y", 10), ("t", "x", 3)], "s string, f string, n int")
    thin = sampling.thin_counts(counts, ["s"], "f", "n", 20).collect()
    assert sum(r.n for r in thin) == 20 and {r.s for r in thin} == {"s"} and all(r.n <= {"x": 30, "y": 10}[r.f] for r in thin)
    assert sampling.to_smallest(rows, ["g"], ["id"]).count() == 99
    p = spark.createDataFrame([(5, 0.3)], "n int, p double").select(sampling.at_least_in_binomial(F.col("n"), F.col("p"), 3).alias("x")).first().x
    assert math.isclose(p, sum(math.comb(5, i) * 0.3**i * 0.7 ** (5 - i) for i in range(3, 6)))


def test_greedy_distinct(spark):
    rows = spark.createDataFrame([("c", "l1", "j1", 9.0), ("c", "l1", "j2", 8.0), ("c", "l2", "j1", 7.0), ("c", "l2", "j2", 6.0), ("c", "l3", "j3", 5.0)], "c string, l string, j string, v double")
    got = [(r.place, r.l, r.j) for r in splicing.greedy_distinct(rows, ["c"], [-F.col("v")], ["l", "j"], 3).orderBy("place").collect()]
    assert got == [(1, "l1", "j1"), (2, "l2", "j2"), (3, "l3", "j3")]


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_greedy_rounds_against_a_walk(spark, keys):
    draw = random.Random(len(keys))
    pick = lambda n: draw.choice([None, *range(n)])
    rows = [(draw.choice(["x", "y", None]), pick(12), pick(12), pick(12), draw.randint(0, 40)) for _ in range(150)]
    rows += [("chain", i // 2, (i + 1) // 2, i, i) for i in range(40)]  # each row blocks the next
    frame = spark.createDataFrame(rows, "g string, a int, b int, c int, v int")
    for by, n in ((["g"], 4), (["g"], 100), ([], 5)):
        want = {}
        for g in {r[0] for r in rows} if by else {0}:
            seen, place = [set() for _ in keys], 0
            own = [dict(zip("gabcv", r)) for r in rows if not by or r[0] == g]
            first = lambda r: (r["v"], *((r[k] is not None, r[k] or 0) for k in keys))
            for r in sorted(own, key=first):
                if place < n and not any(r[k] in s for k, s in zip(keys, seen)):
                    place += 1
                    want[g, place] = (r["v"], *(r[k] for k in keys))
                    for k, s in zip(keys, seen):
                        s.add(r[k])
        got = splicing.greedy_distinct(frame, by, [F.col("v")], keys, n).collect()
        assert {(r.g if by else 0, r.place): (r.v, *(r[k] for k in keys)) for r in got} == want and len(got) == len(want)


def test_components_match_numpy(spark):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(40, 6))
    frame = spark.createDataFrame([(f, s, float(v[f, s])) for f in range(40) for s in range(6)], "f int, s int, v double")
    got = matrix.principal_components(frame, "f", "s", "v").collect()
    z = (v - v.mean(1, keepdims=True)) / (v.std(1, keepdims=True) + 1e-9)
    roots = np.linalg.svd(z, compute_uv=False) ** 2
    shares = {r.component: r.share for r in got}
    assert np.allclose([shares[1], shares[2]], (roots / roots.sum())[:2])
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0)], "a string, b string, d double")
    assert matrix.average_linkage(d, "a", "b", "d") == [(["a"], ["b"], 1.0), (["a", "b"], ["c"], 5.0)]


def test_checks(spark):
    codes = spark.createDataFrame([("a", 990, True), ("b", 9, True), ("x", 1, False)], "code string, reads long, declared boolean")
    assert checks.declared_codes(codes, "code", "reads", "declared").first().passed
    shares = spark.createDataFrame([("w", 60.0), ("w", 39.0)], "w string, pct double")
    assert not checks.hundred_percent(shares, "sum", ["w"], "pct").first().passed
    a, b = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("a",)], "k string")
    assert not checks.same_keys(a, b, "k", "keys").first().passed


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "r1.fastq.gz", "wt") as f:
        f.write("@a/1 x\nACGT\n+\nIIII\n@b/1\nGG\n+\n!!\n")
    (tmp_path / "r2.fastq").write_text("@a/2\nTTTT\n+\nIIII\n@b/2\nCC\n+\nII\n")
    r1, r2 = tf.read_fastq(spark, str(tmp_path / "r1.fastq.gz")), tf.read_fastq(spark, str(tmp_path / "r2.fastq"))
    assert sorted((r.read_id, r.r1.seq, r.r2.seq) for r in tf.paired(r1, r2).collect()) == [("a", "ACGT", "TTTT"), ("b", "GG", "CC")]
    with pytest.raises(Exception):
        tf.paired(r1, r2.where("index = 0")).select("read_id").collect()
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nq1\t0\tHUMAN_1\t5\t255\t4M\t*\t0\t0\tACGT\tIIII\tNH:i:1\tnM:i:0\nq2\t256\tHUMAN_1\t5\t3\t4M\t*\t0\t0\tACGT\tIIII\nq3\t0\tHUMAN_1\t5\t3\t4M\t*\t0\t0\tACGT\tIIII\n")
    sam = tf.read_sam(spark, str(tmp_path / "x.sam"))
    assert sorted((r.qname, len(r.tags)) for r in sam.collect()) == [("q1", 2), ("q3", 0)]
    assert [(r.qname, r.tags["NH"]) for r in sam.where(tf.is_unique()).collect()] == [("q1", "1")]
    gtf = 'chr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "G"; gene_name "N"; transcript_id "T1"; gene_biotype "protein_coding"; tag "Ensembl_canonical";\nchr1\ts\texon\t31\t50\t.\t+\t.\tgene_id "G"; gene_name "N"; transcript_id "T1"; gene_biotype "protein_coding";\nchr1\ts\tCDS\t15\t20\t.\t+\t0\tgene_id "G"; gene_name "N"; transcript_id "T1";\n'
    (tmp_path / "x.gtf").write_text("#c\n" + gtf)
    exons = tf.read_gtf(spark, str(tmp_path / "x.gtf"), "exon")
    assert [(r.start, r.end, r.biotype) for r in exons.orderBy("start").collect()] == [(10, 20, "protein_coding"), (30, 50, "protein_coding")]
    assert tf.terminal_exons(exons).first().start == 30 and tf.transcript_ends(exons).first().ends == [50]
    flat = tf.to_refflat(exons, tf.read_gtf(spark, str(tmp_path / "x.gtf"), "CDS")).first()
    assert (flat.starts, flat.cds_start, flat.cds_end) == ([10, 30], 14, 20)
    assert tf.canonical_transcripts(exons).first().length == 30
    (tmp_path / "x.bed").write_text("track a\n#c\nchr1\t5\t9\tn\nchr2 1 2\n")
    assert [(r.contig, r.start, r.name) for r in tf.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 5, "n"), ("chr2", 1, None)]
    assert len(tf.resolve(spark, f"{tmp_path}/*.bed;{tmp_path}/*.gtf")) == 2
    with pytest.raises(FileNotFoundError):
        tf.resolve(spark, f"{tmp_path}/none*")
    (tmp_path / "s.txt").write_text("[one]\na\nb\n[two]\nc\n")
    assert [(r.section, r.line) for r in tf.read_sections(spark, str(tmp_path / "s.txt")).orderBy("n").collect()] == [("one", "a"), ("one", "b"), ("two", "c")]
    assert tf.parse_guide("x\nBEGIN_CONFIG\na\t1\nEND_CONFIG\n") == {"a": "1"}
    both = tf.concat_distinct([spark.createDataFrame([("a", 0), ("b", 1)], "id string, i int"), spark.createDataFrame([("a", 0), ("c", 1)], "id string, i int")], "id", "i", 2)
    assert sorted(r.id for r in both.collect()) == ["a", "b"]
    sinks.write_fastq(r2, str(tmp_path / "out"))
    assert tf.read_fastq(spark, str(tmp_path / "out" / "*.gz")).count() == 2
    sinks.write_by_key(r2, str(tmp_path / "keyed"), "read_id")
    assert spark.read.parquet(str(tmp_path / "keyed")).count() == 2


def test_stream(spark, tmp_path):
    from strandloom.streaming import reads as sr

    pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 03:00:00"]), "seq": ["ACGTACGGGGT", "ACGTACGTTT", "TTTTTTTGG"]}).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "a.parquet")
    stream = sr.prepared(spark.readStream.schema("ts timestamp, seq string").parquet(str(tmp_path)))
    q = sr.code_counts(stream, "ts").writeStream.format("memory").queryName("codes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.code, r.reads) for r in spark.table("codes").collect()} == {("ACGTACG", 2)}


def test_rankings_and_sites(spark):
    from strandloom.operators import ranking as rk

    x = F.col("x")
    rows = spark.createDataFrame([(i, float(i - 5), i * 0.01) for i in range(11)], "id int, e double, p double")
    got = [(r.side, r.place, r.id) for r in rk.signed_top(rows, "e", "p", "id", 2).orderBy("side", "place").collect()]
    assert got == [("down", 1, 0), ("down", 2, 1), ("up", 1, 6), ("up", 2, 7)]
    assert one(spark, "ACGTAC", rk.base_at(x, F.lit("2M3N1I3M"), F.lit(10), F.lit(15))) == "T"
    assert one(spark, "ACGTAC", rk.base_at(x, F.lit("2M3N1I3M"), F.lit(10), F.lit(13))) is None
    s = rk.aligned_sites(spark.createDataFrame([("k", "AC-GT", "ACCTT")], "k string, a string, b string"), ["k"], "a", "b").collect()
    assert [(r.a_pos, r.b_pos, r.a, r.b) for r in s] == [(2, 3, "G", "T")]
    assert one(spark, "TTACGAACGT", rk.index_in(x, ["ACGT"], 1))["at"] == 2
    assert [(b.code, b.plot) for b in one(spark, "BC01(#3) BC12(#4)", rk.barcode_list(x))] == [("BC01", 3), ("BC12", 4)]
    assert one(spark, "BC01: a: b | BC02: c", rk.barcode_notes(x)) == {"BC01": "a: b", "BC02": "c"}
    d = rk.derived_sequences(spark.createDataFrame([("p", "AACC"), ("q", "ACGT")], "n string, s string"), "n", "s").collect()
    assert {(r.n, r.s) for r in d} == {("p", "AACC"), ("p_rc", "GGTT"), ("q", "ACGT")}


def test_read_preparation(spark):
    from strandloom.operators import reads as rd

    a = spark.createDataFrame([("q", 0x41, 100, "10M100N10M", 170), ("q", 0x81, 200, "5M60N25M", -170), ("r", 0x41, 5, "4M", 0)], "read string, flag int, start int, cigar string, tlen int")
    pairs = {r.read: r for r in rd.paired_mates(a, "read", ["start", "cigar", "tlen"]).withColumn("ins", rd.genomic_insert(F.col("m1.tlen"), F.col("m1.start"), F.col("m1.cigar"), F.col("m2.start"), F.col("m2.cigar"))).collect()}
    assert pairs["q"].ins == 170 - (265 - 110) and pairs["r"].m2 is None
    rules = spark.createDataFrame([("w1", "^HUMAN")], "well string, pattern string")
    rows = spark.createDataFrame([("w1", "HUMAN_1"), ("w1", "MOUSE_1"), ("w2", "MOUSE_1")], "well string, contig string")
    assert rd.matches_rule(rows, rules, "well", "contig").count() == 2
    names = spark.createDataFrame([("A1",), ("B2",), ("C",)], "n string")
    keys = spark.createDataFrame([("A1",), ("xA1",), ("yB2",), ("1C",), ("2C",)], "k string")
    assert {(r.n, r.k) for r in rd.suffix_match(names, keys, "n", "k").collect()} == {("A1", "A1"), ("B2", "yB2"), ("C", None)}
    assert one(spark, "RPS6KA1", rd.is_ribosomal(F.col("x"), "no kinases")) is False and one(spark, "RPL8", rd.is_ribosomal(F.col("x")))
    flow = rd.stage_flow(spark.createDataFrame([("s", 10, 7, 7)], "s string, a long, b long, c long"), ["s"], ["a", "b", "c"]).collect()
    assert {(r["from"], r.to, r.n) for r in flow} == {("a", "b", 7), ("b", "c", 7), ("a", "lost", 3), ("b", "lost", 0)}


def test_run_settings():
    from strandloom.plans.config import Run

    good = Run.from_json('{"codes": {"ACGTACG": "human"}, "offsets": {"ACGTACG": 2}, "labels": {"ACGTACG": "s1"}, "read_lengths": [50, 50]}', {"species": "codes"})
    assert good.checked().measurable() == {"code": True, "g_run": True, "mate_tail": True}
    assert tf.parse_guide(good.guide())["species.ACGTACG"] == "human"
    bad = Run({"ACGX": "yeast"}, {"AC": 1}, {}, (), (3, 10))
    assert len(bad.problems()) >= 5
    with pytest.raises(ValueError):
        bad.checked()


def test_corrected_molecules(spark):
    draw = random.Random(6)
    rows = [("w", "".join(draw.choice("ACGT") for _ in range(4)), f"{draw.choice(['RPL', 'G'])}{draw.randrange(12)}") for _ in range(1500)]
    got = molecules.corrected_molecules(spark.createDataFrame(rows, "w string, u string, g string"), "w", "u", "g").first()
    pairs = sorted(set(rows))
    n = {}
    for _, u, _ in pairs:
        n[u] = n.get(u, 0) + 1
    total = sum(n.values())
    share = [{b: sum(c for u, c in n.items() if u[j] == b) / total for b in "ACGT"} for j in range(4)]
    bad = {u for u, c in n.items() if max(u.count(b) for b in "ACGT") >= 3 or c > 8 * max(math.prod(share[j][x] for j, x in enumerate(u)) * total, 1)}
    assert len(n) >= 100 and got.tags == len(n) and got.b_raw == len(pairs)
    kept = [(u, g) for _, u, g in pairs if u not in bad]
    assert got.b_kept == len(kept) and got.genes == len({g for _, g in kept}) and got.genes_no_rp == len({g for _, g in kept if g[0] == "G"})
    p = np.array([c for u, c in n.items() if u not in bad], float)
    p /= p.sum()
    assert math.isclose(got.simpson, 1 / (p * p).sum(), rel_tol=1e-9)
    k = {}
    for _, g in kept:
        k[g] = k.get(g, 0) + 1
    grid = np.unique(np.round(np.logspace(0, math.log10(50 * len(p)), 600)).astype(int))
    seen = np.array([(1 - (1 - p) ** m).sum() for m in grid])
    assert math.isclose(got.b_corr, sum(np.interp(min(c, 0.995 * seen[-1]), seen, grid) if c > 1 else c for c in k.values()), rel_tol=1e-9)


def test_assays(spark, tmp_path):
    from strandloom.operators import assays

    x = F.col("x")
    insert = "ACGTTGCATCGGATCTAGGCTTACGATCGTAGCTAGC"
    reads = spark.createDataFrame([("ACGTACG" + "GGG" + insert, "human"), ("ACGTACC" + "GGGG" + insert, "mouse"), ("TTTTTTT" + "GGG" + insert, "mouse"), ("ACGTACG" + "GGG" + "A" * 40, "human"), ("CCCCCCC" + insert, "human")], "seq string, species string")
    assay = assays.positional_chemistry({"ACGTACG": "human", "TTTTTTT": "mouse"})
    got = [(r.level, r.dropped_by) for r in assay.measured(reads).orderBy(F.monotonically_increasing_id()).collect()]
    assert got == [(4, None), (4, None), (4, None), (3, "complex"), (0, "code")]
    f = {r.level: (r.n, r.correct) for r in assay.funnel(reads, []).collect()}
    assert f[4] == (3, 2) and f[0] == (5, 3)
    assert assay.retained(reads).count() == 3
    assert one(spark, "CCCAACCGGATTACATTTTTTTTTTTT", assays.polyt_structure(x, "GATTACA"))["code"] == "CAACCG"
    ends = {(r.end, r.element): r.reads for r in assays.end_elements(spark.createDataFrame([("AAACCC" + "T" * 50 + "GGGTTA",)], "s string"), "s", {"a": "AAAC", "g": "GGGT"}).collect()}
    assert ends == {("start", "a"): 1, ("end", "g"): 1}
    w = assays.window_composition(spark.createDataFrame([("p", "AAAAAAAAAAAACC"), ("b", "ACGTACGTACGTAC")], "k string, s string"), "s", ["k"]).collect()
    assert {r.k: r.a_rich for r in w} == {"p": 1.0, "b": 0.0}
    e = assays.expected_species(spark.createDataFrame([("w", "human", "human", False), ("w", "mouse", "human", True), ("w", None, "human", False)], "w string, s string, e string, r boolean"), ["w"], "s", "e", F.col("r")).first()
    assert (e.expected_pct, e.expected_no_rdna_pct) == (50.0, 100.0)
    a = assays.aligned_bases(spark.createDataFrame([("w", "10M5N5M", "q"), ("w", "20M", "q")], "w string, c string, q string"), ["w"], "c", "q", 1).first()
    assert (a.bases, a.per_fragment, a.at_depth) == (35, 35.0, 35.0)
    exons = spark.createDataFrame([("g", i * 100, i * 100 + 50) for i in range(6)], "g string, s int, e int")
    z = assays.zoom_window(exons, spark.createDataFrame([("g", 310)], "g string, site int"), "g", "s", "e", "site").first()
    assert z.exons == 3 and z.window_start <= 300 <= z.window_end
    art = assays.artefacts(spark.createDataFrame([("AACCGG" + "T" * 12 + "CCTTGG",), ("AACCGGACCTTGG",)], "s string"), "s", [], ("AACCGG", "CCTTGG")).first()
    assert (art.reads, art.empty, art.without_tail) == (2, 2, 1)


def test_more_checks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 10.0, 5.0), ("b", 20.0, 10.0)], "k string, x double, y double").withColumn("g", F.lit(1))
    assert checks.proportional(frame, "p", ["g"], "x", "y").first().passed
    assert checks.kept_within(frame, "k", "y", "x").first().passed is False
    assert checks.some_denominator(frame, "d", ["x", "y"]).first().passed and checks.not_all_zero(frame, "z", ["x"]).first().passed
    assert not checks.right_direction(frame.withColumn("s", F.lit(0.4)).withColumn("n", F.lit(60)), "r", "s", "n").first().passed
    (tmp_path / "a.tsv").write_text("code\tname\nAC\tone\n")
    (tmp_path / "b.tsv").write_text("code\tname\nAC\tother\nGT\ttwo\n")
    got = tf.read_registry(spark, [str(tmp_path / "none.tsv"), str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")], "code string, name string", "code")
    assert {(r.code, r.name) for r in got.collect()} == {("AC", "one"), ("GT", "two")}
    with pytest.raises(FileNotFoundError):
        tf.read_registry(spark, [str(tmp_path / "none.tsv")], "code string", "code")
