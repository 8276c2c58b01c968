"""Mined negatives against brute force, with small trees so that cells, shares, blocks and both rounds are used."""

import numpy as np
import pytest

from strandloom.llm import hard_negatives as hn


def plain(rows, positives=5, negatives=10, lowest=30, highest=90):
    """Each anchor's negatives, by comparing it with every row."""
    fine = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = tuple(int(x) for x in np.floor(256 * np.array(vector, np.float64)))
        if sum(x * x for x in whole) < 2**62:
            fine.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    fine, out = sorted(set(fine)), []
    for a, label, v in fine:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in fine if b != a and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and lowest * -s <= 100 * -x[0] <= highest * -s][:negatives]
            out += [(a, b, r, x[1], -s, -x[0]) for r, x in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted(tuple(r) for r in hn.negatives_report(frame).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in {"GROUP": 40, "LEAF": 4, "BLOCK": 7, "SAMPLE": 4}.items():
        monkeypatch.setattr(hn, name, value)


def test_clusters_and_scattered_vectors(spark, small):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 9))
    rows = []
    for i in range(420):
        at = centres[i % 6] + 0.2 * draw.normal(size=9) if i % 2 else draw.normal(size=9) * draw.uniform(0.1, 2)
        rows.append((int(i * 5), [float(x) for x in at], int(draw.integers(0, 10)) if i % 3 else 4))
    want = plain(rows)
    assert len({x[0] for x in want}) > 15 and mined(spark, rows) == want


def test_ties_copies_lengths_and_rows_that_take_no_part(spark, small):
    rows = [(i, [1.0, 0.5, float(i % 3) / 2], i % 4) for i in range(150)] + [(200, [1.0, 0.5, 0.0], 2)] * 3  # many equal scores, equal rows
    rows += [(300 + i, [1.0, 2.0], i % 2) for i in range(30)]
    rows += [(500, [1.0, 0.5, 0.5], 1), (500, [1.0, 0.5, 0.5], 3), (500, [0.5, 0.5, 0.5], 1)]  # one id, three rows
    rows += [(600, None, 1), (700, [1.0, None, 2.0], 1), (800, [float("nan"), 1.0, 1.0], 1), (900, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (1000, [1.0, 1.0, 1.0], None), (1100, [], 1), (1101, [], 2)]
    rows += [(1200, [0.0, 0.0, 0.0], 3), (1300, [-1.0, -0.5, 0.0], 2), (1400, [1e300, 1.0, 1.0], 2)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows[:0]) == []


def test_scores_beyond_exact_doubles(spark, small):
    draw = np.random.default_rng(5)
    rows = [(i * 20, [float(x) for x in draw.integers(-(2**20), 2**20, 4)], i % 3) for i in range(120)]
    assert mined(spark, rows) == plain(rows)


def test_far_leaves_are_passed_over(small):
    """Nearest-first search of a cell looks at few of its rows when they lie in clusters, and at none twice for an anchor's windows."""
    import pyarrow as pa

    draw = np.random.default_rng(6)
    rows = (1000 * draw.normal(size=(16, 8))[np.arange(1600) % 16] + 10 * draw.normal(size=(1600, 8))).astype(np.int64)
    most = float((rows**2).sum(1).max())
    looked = []
    count = hn.scores
    hn.scores = lambda part, *a: (looked.append(len(part)), count(part, *a))[1]
    try:
        members = pa.table({"vec_id": np.arange(1600), "label": pa.array(np.zeros(1600), pa.int32()), "vector": pa.array(rows.tolist(), pa.list_(pa.int64()))})
        asked = pa.table({"anchor_id": [7, 7], "twin": ["t", "t"], "item": pa.array([0, 1], pa.int32()), "label": pa.array([0, 0], pa.int32()), "vector": pa.array([rows[7].tolist()] * 2, pa.list_(pa.int64())), "low": [-hn.ALL] * 2, "high": [hn.ALL] * 2})
        got = hn.search(asked, members, 8, most, True, 5)
    finally:
        hn.scores = count
    value = rows @ rows[7]
    want = [i for i in np.lexsort((np.arange(1600), -value)) if i != 7][:5]
    assert got.column("vec_id").to_pylist() == want * 2
    assert sum(looked) < 800
