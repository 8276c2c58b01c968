"""Scans in stretches against plain loops, with stretches so short that every group crosses many of their borders."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, scans, splicing


@pytest.fixture(params=[1, 3, 17, 10**6])
def short(request, monkeypatch):
    monkeypatch.setattr(scans, "ROWS", request.param)


def keyed(rows):
    return sorted(rows, key=str)


def test_sums_minima_and_next_values(spark, short):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), p, draw.randint(-9, 9)) for p in draw.sample(range(500), 90)]
    frame = scans.in_stretches(spark.createDataFrame(rows, "k string, p long, v long"), "p")
    made = scans.scan(frame, ["k"], ["p"], {"total": scans.running_sum(F.col("v")), "least": scans.running_min(F.col("v"), backward=True), "after": scans.following(F.col("p"))}, {"whole": F.col("v")})
    want = []
    for k in {r[0] for r in rows}:
        own = sorted((p, v) for g, p, v in rows if g == k)
        for i, (p, v) in enumerate(own):
            want.append((k, p, v, sum(x for _, x in own[: i + 1]), min(x for _, x in own[i:]), own[i + 1][0] if i + 1 < len(own) else None, sum(x for _, x in own)))
    assert keyed(tuple(r) for r in made.select("k", "p", "v", "total", "least", "after", "whole").collect()) == keyed(want)


def test_last_mark_of_all_rows_and_of_groups(spark, short):
    draw = random.Random(2)
    start = datetime.datetime(2024, 3, 30)
    at = lambda: start + datetime.timedelta(minutes=draw.randint(0, 3000))
    marks = [(draw.choice(["x", "y", None]), at(), i) for i in range(12)]
    points = [(draw.choice(["x", "y", "z", None]), None if i % 9 == 0 else at(), i) for i in range(70)]
    m, p = spark.createDataFrame(marks, "g string, mark timestamp, n int"), spark.createDataFrame(points, "g string, ts timestamp, id int")
    for on in ([], ["g"]):
        got = {r.id: r.mark for r in intervals.last_before(p, m, on, "ts", "mark", ["n"]).collect()}
        fits = lambda g, t: max((b for h, b, _ in marks if t is not None and b <= t and (not on or h == g)), default=None)
        assert got == {i: fits(g, t) for g, t, i in points}


def test_coverage_against_single_positions(spark, short):
    draw = random.Random(3)
    spans = [(draw.choice("AAAB"), s, s + draw.randint(0, 40)) for s in (draw.randint(0, 200) for _ in range(60))]
    steps = intervals.depth_steps(spark.createDataFrame(spans, "contig string, s long, e long"), ["contig"], "s", "e").collect()
    got = {(r.contig, p): r.depth for r in steps for p in range(r.from_pos, r.to_pos)}
    want = {}
    for c, s, e in spans:
        for p in range(s, e):
            want[c, p] = want.get((c, p), 0) + 1
    assert got == want


def test_adjusted_p(spark, short):
    draw = random.Random(4)
    rows = [(draw.choice(["g", "h", None]), None if i % 11 == 0 else draw.choice([draw.random(), 0.25, 1e-300]), i) for i in range(80)]
    for by in ([], ["g"]):
        got = {r.i: r.q for r in splicing.adjust_p(spark.createDataFrame(rows, "g string, p double, i int"), "p", "q", by).collect()}
        assert len(got) == len(rows)
        for k in {r[0] for r in rows} if by else {None}:
            own = sorted(p for g, p, _ in rows if p is not None and (not by or g == k))
            for g, p, i in rows:
                if not by or g == k:
                    q = None if p is None else min([1.0] + [x * len(own) / (j + 1) for j, x in enumerate(own) if x >= p])
                    assert (got[i] is None and q is None) or abs(got[i] - q) < 1e-12


def test_no_stretch_is_long_and_empty_tables_work(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROWS", 100)
    sizes = [r["count"] for r in scans.in_stretches(spark.range(5000).select((F.col("id") * F.col("id")).alias("p")), "p").groupBy(scans.STRETCH).count().collect()]
    assert len(sizes) == 50 and max(sizes) <= 130
    none = scans.in_stretches(spark.createDataFrame([], "k string, p long"), "p")
    assert scans.scan(none, ["k"], ["p"], {"n": scans.running_sum(F.col("p"))}).count() == 0
