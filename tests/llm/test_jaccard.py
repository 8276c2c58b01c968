import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import jaccard_join
from strandloom.operators.components import local_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    sets = [shingles(r.text, width) for r in rows]
    head = {}
    for r in rows:
        if r.doc_id is not None:
            head[r.doc_id] = r.doc_id

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i].doc_id is not None and rows[j].doc_id is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(rows[i].doc_id), root(rows[j].doc_id)))
                head[y] = x
    return Counter((r.doc_id, len(s), None if r.doc_id is None else root(r.doc_id)) for r, s in zip(rows, sets))


def check(frame, width=4, percent=85):
    got = Counter(tuple(r) for r in jaccard_join.join_report(frame, jaccard_join.Limit(width, percent)).collect())
    want = brute(frame.collect(), width, percent)
    assert got == want
    return got


def test_documents(documents, awkward, empty):
    assert any(k[0] != k[2] for k in check(documents))
    check(awkward)
    check(empty)


def near_copies(draw, groups, size, words=60):
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(words)]
        for _ in range(draw.randrange(1, size)):
            own = list(base)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
            rows.append(" ".join(own[: words - draw.randrange(6)]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_made_up(spark, seed):
    draw = random.Random(seed)
    texts = near_copies(draw, 25, 14) + ["common passage of some words " * 3 + f"tail {i}" for i in range(30)] + ["a b", "A B", "a", "b c d", ""]
    draw.shuffle(texts)
    frame = spark.createDataFrame([(i * 7 % 1000, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(frame)
    check(frame, 5, 80)


def counted(monkeypatch, name):
    """The calls of a function of the module."""
    calls, real = [], getattr(jaccard_join, name)
    monkeypatch.setattr(jaccard_join, name, lambda *args: calls.append(1) or real(*args))
    return calls


def variants(draw, n, words=60, most=6, kinds=3):
    """Texts of one base with words changed to a few others each: many are near each other, few as near as a link."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in draw.sample(range(words), draw.randrange(1, most)):
            own[k] = f"x{k}-{draw.randrange(kinds)}"
        out.append(" ".join(own))
    return out


def test_regions_cut_across_tasks(spark, monkeypatch):
    draw = random.Random(5)
    texts = near_copies(draw, 3, 60) + variants(draw, 120)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("REGION_SETS", 20), ("PIVOTS", 4), ("CHUNK", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    cut, again = counted(monkeypatch, "cells"), counted(monkeypatch, "shingle_regions")
    check(frame)
    assert cut and again


def test_large_regions(spark, monkeypatch):
    """Regions that are cut across tasks as they come, of near copies that drift away from their beginning."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(3000)}" for _ in range(80)]
    texts = []
    for i in range(900):
        own = list(base)
        for _ in range(draw.randrange(5)):
            own[draw.randrange(80)] = f"x{draw.randrange(40)}"
        texts.append(" ".join(own))
        if i % 25 == 0:
            base[draw.randrange(80)] = f"y{i}"
    cut = counted(monkeypatch, "cells")
    check(spark.createDataFrame([*enumerate(texts), (3, texts[5]), (3, texts[3]), (None, texts[7])], "doc_id long, text string"))
    assert cut


@pytest.mark.parametrize("seed", range(6))
def test_cells_and_windows(seed):
    """Pivots, balls and cells against all pairs, with sets at every distance, many just outside each other's balls."""
    draw = np.random.default_rng(seed)
    limit = jaccard_join.Limit(4, [85, 80, 60][seed % 3])
    core = draw.permutation(4000)[:40]
    sets = []
    for i in range(150):
        kept = core[draw.random(40) > [0.02, 0.08, 0.15, 0.5][i % 4]]
        sets.append(np.unique(np.concatenate([kept, draw.integers(5000, 5060, draw.integers(0, 9)), [9000 + i % 70]])).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    found = jaccard_join.voronoi_links(jaccard_join.Sets(np.concatenate(sets), bounds), limit)
    label = list(range(150))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= limit.percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = local_labels(150, np.array([a for a, _ in found], int), np.array([b for _, b in found], int))
    assert got.tolist() == label and len(found) < 150


def test_one_of_each(spark, awkward, empty):
    draw = random.Random(8)
    texts = near_copies(draw, 10, 6)
    frame = spark.createDataFrame([*enumerate(texts), *list(enumerate(texts))[:7]], "doc_id long, text string")
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(frame).collect())
    assert kept == sorted({k[2] for k in brute(frame.collect(), 5, 80)})
    assert jaccard_join.one_of_each(empty).count() == 0
    assert jaccard_join.one_of_each(awkward).columns == awkward.columns
    assert jaccard_join.one_of_each(awkward).count() == 9
