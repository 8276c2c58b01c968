"""Work that must spread over more tasks as rows grow, with tasks so small that few rows are many tasks' work."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals, molecules, scans


@pytest.mark.parametrize("few", [0, 10**6])
def test_best_overlaps_are_dealt_by_their_number(spark, monkeypatch, few):
    monkeypatch.setattr(scans, "ROWS", 10)
    monkeypatch.setattr(intervals, "FEW", few, raising=False)
    draw = random.Random(few)
    left = [("ab"[i % 2], i, s, s + draw.randrange(0, 90)) for i in range(150) for s in [draw.randrange(-300, 500)]] + [("a", 150, None, 3), (None, 151, 2, 9)]
    right = [("ab"[i % 2], s, s + draw.randrange(0, 120), i) for i in range(60) for s in [draw.randrange(-300, 500)]]
    a = spark.createDataFrame(left, "c string, i int, s int, e int")
    b = spark.createDataFrame(right, "c string, rs int, re int, j int")
    found = intervals.best_overlap(a, b, ["c"], ("s", "e"), ("rs", "re"), 64, ["i"], ["rs", "j"])
    want = {}
    for c, i, s, e in left:
        over = [(min(e, q) - max(s, p), p, j, q) for d, p, q, j in right if c == d and s is not None and s < e and p < q and s < q and e > p]
        want[i] = max(over, default=None)
    got = {r.i: None if r.overlap is None else (r.overlap, r.rs, r.j, r.re) for r in found.collect()}
    assert got == want
    assert found.rdd.getNumPartitions() >= len(left) // 10


def plain_windows(reads, edits, reach):
    """Molecules of one isle after another, each held whole."""
    out, live, last = [], {}, None
    sizes = {}
    for w, c, s, p, t, _ in sorted(reads, key=lambda r: (r[0], r[1] or "", r[2] or "", r[3], r[4])):
        sizes.setdefault(w, len(t))
    for w, c, s, p, t, g in sorted(reads, key=lambda r: (r[0], r[1] or "", r[2] or "", r[3], r[4], r[5] is None, r[5] or "")):
        if len(t) != sizes[w] or set(t) - set("ACGT"):
            continue
        if (w, c, s) != last:
            last, live = (w, c, s), {}
        near = [t[:i] + x + t[i + 1 :] for i in range(len(t)) for x in "ACGT" if x != t[i]] if edits else []
        mol = next((live[x] for x in [t, *near] if x in live and p - live[x][1] <= reach), None)
        if mol is None:
            mol = [g, p, 0, w]
            out.append(mol)
        live[t] = mol
        mol[2] += 1
    return sorted((w, g or "", p, n) for g, p, n, w in out)


@pytest.mark.parametrize("isles", [[-60, 0, 0, 300], [-500, -200, 100, 400]])
@pytest.mark.parametrize("reach, edits", [(1, 1), (7, 1), (40, 1), (40, 0)])
def test_reads_in_windows_are_dealt_and_forgotten(spark, monkeypatch, reach, edits, isles):
    monkeypatch.setattr(scans, "ROWS", 20)
    monkeypatch.setattr(molecules, "SWEEP", 5, raising=False)
    draw = random.Random(reach)
    tag = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    reads = [(draw.choice(["v", "w"]), draw.choice(["c", "d", None]), draw.choice(["+", "-"]), draw.choice(isles) + draw.randint(0, 90), tag(3 if draw.random() < 0.97 else 2), draw.choice(["g", "h", None])) for _ in range(400)]
    frame = spark.createDataFrame([*reads, ("w", "c", "+", 3, "ACN", "g"), (None, "c", "+", 3, "ACG", "g"), ("w", "c", "+", None, "ACG", "g")], "well string, contig string, strand string, pos int, umi string, gene string")
    found = molecules.anchored_windows(frame, "well", "contig", "strand", "pos", "umi", "gene", edits, reach)
    assert sorted((r.well, r.gene or "", r.anchor, r.reads) for r in found.collect()) == plain_windows(reads, edits, reach)
    assert found.rdd.getNumPartitions() > 4


def test_what_a_window_leaves_behind_is_given_back(monkeypatch):
    monkeypatch.setattr(molecules, "SWEEP", 5)
    row = lambda i: {"w": "w", "c": "c", "s": "+", "k": 0, "p": 10 * i, "t": "ACGT"[i % 4] + "ACGT"[i // 4 % 4], "g": "g", "n": 1}
    batches = (pa.RecordBatch.from_pylist([row(i) for i in range(k, k + 10)]) for k in range(0, 200, 10))
    given = [len(b) for b in molecules._greedy(batches, 0, 15)]
    assert sum(given) == 200 and max(given) <= 12


@pytest.mark.parametrize("reach", [1, 4, 30])
@pytest.mark.parametrize("rows_of_a_task, longest", [(7, 10**6), (40, 10**6), (10**6, 16), (7, 1)])
def test_jitter_in_stretches_against_all_pairs(spark, monkeypatch, reach, rows_of_a_task, longest):
    monkeypatch.setattr(scans, "ROWS", rows_of_a_task)
    monkeypatch.setattr(molecules, "LONGEST", longest, raising=False)
    draw = random.Random(reach)
    places = sorted({(draw.choice("AAB"), s, s + draw.randint(5, 25)) for s in (draw.randint(-40, 60) for _ in range(90))} | {("C", 5 * i, 5 * i + 3) for i in range(-10, 12)} | {("D", 9, e) for e in range(0, 200, 9)})
    head = list(range(len(places)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, (g, s, e) in enumerate(places):
        for j, (h, t, f) in enumerate(places[:i]):
            if g == h and abs(s - t) <= reach and abs(e - f) <= reach:
                a, b = sorted((root(i), root(j)))
                head[b] = a
    want = {g: len({root(i) for i, x in enumerate(places) if x[0] == g}) for g in "ABCD"}
    rows = spark.createDataFrame([(g, 1, s, e) for g, s, e in places * 2] + [("A", None, 1, 3), ("A", 1, None, 3), (None, 1, 1, 2)], "g string, k int, s long, e int")
    assert {r.g: r.molecules for r in molecules.jitter_molecules(rows, ["g", "k"], "s", "e", reach).collect()} == want


def test_jitter_links_only_what_lies_at_cuts(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROWS", 100)
    asked = []
    whole = molecules.near_ends
    monkeypatch.setattr(molecules, "near_ends", lambda places, *rest: asked.append(places.count()) or whole(places, *rest))
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (4 * F.col("id")).alias("s"), (4 * F.col("id") + 9).alias("e"))
    assert {r.g: r.molecules for r in molecules.jitter_molecules(rows, ["g"], "s", "e", 5).collect()} == {0: 334, 1: 333, 2: 333}
    assert all(n < 100 for n in asked)
