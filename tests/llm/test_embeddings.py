import math
from collections import Counter

import numpy as np

from strandloom.llm import embedding_dedup


def brute(rows, limit=0.9):
    def usable(r):
        v = r.embedding
        return r.vec_id is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    vectors = [np.array(r.embedding, float) if usable(r) else None for r in rows]
    links = [0] * len(rows)
    head = {r.vec_id: r.vec_id for r in rows if r.vec_id is not None}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= limit:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(rows[i].vec_id), root(rows[j].vec_id)))
                head[y] = x
    return Counter((r.vec_id, n, None if r.vec_id is None else root(r.vec_id), r.vec_id is not None and root(r.vec_id) == r.vec_id) for r, n in zip(rows, links))


def check(frame):
    got = Counter(tuple(r) for r in embedding_dedup.similar_vectors(frame).collect())
    assert got == brute(frame.collect())
    return got


def test_embeddings_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [0.0, 0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0, 0.0], 1), (6, [inf, 0.0, 0.0], 1), (7, [None, 1.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.0], 1), (10, [-1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (11, [1.0, -0.0, 0.0], 1), (12, [0.9, 0.43588989435406735, 0.0], 1)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int"))
    check(spark.createDataFrame([], "vec_id long, embedding array<float>"))


def test_dense_clusters(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 24))
    made = [centres[draw.integers(12)] + draw.normal(size=24) * draw.choice([0.0, 0.2, 0.45]) for _ in range(500)]
    monkeypatch.setattr(embedding_dedup, "GROUP", 70)
    check(spark.createDataFrame([(int(i * 31 % 997), [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<float>"))


def test_bounds_hold():
    draw = np.random.default_rng(9)
    for d in (3, 64, 1500):
        v = draw.normal(size=(300, d)) * draw.lognormal(size=(300, 1))
        c = embedding_dedup.Coded.of(v, np.sqrt((v * v).sum(1)))
        told = embedding_dedup.products(c.codes, c.codes) * c.scale[:, None].astype(float) * c.scale.astype(float)
        assert (np.abs(told - c.unit @ c.unit.T) <= c.bound[:, None].astype(float) + c.bound + 1e-6).all()


def test_extreme_values(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [0.0, 1e200]), (4, [1e190, 3e200]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308]), (7, [1e-300, 1e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (1, 6), 7: (1, 6)}


def test_far_cells_are_not_sent(spark, monkeypatch):
    """On clusters that lie apart a vector goes to few groups, and links are the same."""
    draw = np.random.default_rng(6)
    centres = np.eye(40)
    made = [centres[i % 40] + draw.normal(size=40) * 0.03 for i in range(1200)]
    monkeypatch.setattr(embedding_dedup, "GROUP", 20)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<float>")
    check(frame)
    classes = frame.selectExpr("vec_id as id", "1L as weight", "embedding as vector")
    pivots = embedding_dedup.chosen_pivots(classes)
    placed = embedding_dedup.in_cells(classes, pivots)
    sent = embedding_dedup.dealt_to_groups(placed, pivots, 0.9)
    groups = sent.select("own").distinct().count()
    assert groups >= 40 and sent.count() < 1200 * groups / 4
    assert max(r["count"] for r in sent.groupBy("low", "high").count().collect()) <= 160


def test_rare_lengths(spark, monkeypatch):
    draw = np.random.default_rng(8)
    monkeypatch.setattr(embedding_dedup, "MOST_SIZES", 2)
    monkeypatch.setattr(embedding_dedup, "GROUP", 9)
    rows = [(i, [float(x) for x in draw.normal(size=2 + i % 5)]) for i in range(150)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
