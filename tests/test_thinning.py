"""Thinned counts: exact totals, the hypergeometric law, and rows that don't grow with counts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import sampling


def law(x, good, bad, draws):
    return math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws) if 0 <= draws - x <= bad else 0.0


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (3, 40, 20), (60, 50, 70), (1, 1, 1), (200, 3, 150), (0, 5, 3), (4, 0, 2)])
def test_inversion_meets_the_law_at_every_step(good, bad, draws):
    bounds, total = [], 0.0
    for x in range(good + 1):
        bounds.append((total, total := total + law(x, good, bad, draws), x))
    for a, b, x in bounds:
        if b - a > 1e-9:
            for u in (a + (b - a) * 1e-3, (a + b) / 2, b - (b - a) * 1e-3):
                assert sampling.hypergeometric(u, good, bad, draws) == x


def test_large_counts_stay_near_their_share():
    draws = [sampling.hypergeometric(u, 3 * 10**12, 10**12, 10**9) for u in np.linspace(0.0005, 0.9995, 1000)]
    sd = math.sqrt(10**9 * 0.75 * 0.25)
    assert abs(np.mean(draws) - 0.75e9) < 0.05 * sd and abs(np.std(draws) / sd - 1) < 0.02


@pytest.mark.parametrize("branches", [2, 1024])
def test_margins_of_many_groups(spark, monkeypatch, branches):
    monkeypatch.setattr(sampling, "BRANCHES", branches)
    sizes = {"a": 5, "b": 1, "c": 12, "d": 3, None: 4}
    groups = 1500
    rows = spark.range(groups).select(F.col("id").alias("g"), F.explode(F.array(*(F.struct(F.lit(f).cast("string").alias("f"), F.lit(n).alias("n")) for f, n in sizes.items()))).alias("x")).select("g", "x.f", "x.n")
    thin = sampling.thin_counts(rows, ["g"], "f", "n", 10)
    got = thin.collect()
    totals = Counter()
    for r in got:
        totals[r.g] += r.n
        assert 0 < r.n <= sizes[r.f]
    assert len(totals) == groups and set(totals.values()) == {10}
    for f, n in sizes.items():
        seen = Counter(r.n for r in got if r.f == f)
        seen[0] = groups - sum(seen.values())
        for x in range(n + 1):
            p = law(x, n, 25 - n, 10)
            assert abs(seen[x] - groups * p) < 5 * math.sqrt(groups * p * (1 - p)) + 1, (f, x)
    both = Counter((r.g, r.f) for r in got)
    assert len(both) == len(got)
    assert Counter(map(tuple, sampling.thin_counts(rows.repartition(5), ["g"], "f", "n", 10).collect())) == Counter(map(tuple, got))


def test_groups_too_small_and_counts_too_large_to_list(spark):
    rows = spark.createDataFrame([("x", "f", 3), ("x", "g", 2), ("y", "f", 10**13), ("y", "g", 10**12), ("y", "f", 5), ("z", "f", 100), ("z", "g", 0)], "s string, f string, n long")
    got = {(r.s, r.f): r.n for r in sampling.thin_counts(rows, ["s"], "f", "n", 100).collect()}
    assert got["z", "f"] == 100 and got["y", "f"] + got["y", "g"] == 100 and 70 < got["y", "f"] < 100 and "x" not in {s for s, _ in got}
    everything = sampling.thin_counts(rows.where("s <> 'y'"), ["s"], "f", "n", 5)
    assert {(r.s, r.f): r.n for r in everything.where("s = 'x'").collect()} == {("x", "f"): 3, ("x", "g"): 2}
    assert sampling.thin_counts(rows, [], "f", "n", 50).agg(F.sum("n")).first()[0] == 50
