"""Components of links against a plain search, with one task's share so small that rounds are needed, and with hashes that clash."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import components as co
from strandloom.operators import molecules


def plain(n, links):
    head = list(range(n))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        head[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("flush", [3, 1 << 21])
@pytest.mark.parametrize("buckets", [None, 5])
def test_groups_of_random_links(spark, monkeypatch, flush, buckets):
    monkeypatch.setattr(co, "FLUSH", flush)
    draw = random.Random(flush)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 75)] + [(80, 80)]
    want = plain(90, links)
    nodes = spark.createDataFrame([(i % 7, f"n{i:02}") for i in range(90)], "g int, name string")
    node = lambda c: F.struct((F.col(c) % 7).cast("int").alias("g"), F.format_string("n%02d", c).alias("name"))
    pairs = spark.createDataFrame(links, "a int, b int").select(node("a").alias("a"), node("b").alias("b"))
    number = F.xxhash64 if buckets is None else lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    got = {r.name: r.least for r in co.linked_groups(nodes, pairs, "least", number).collect()}
    assert len(got) == 90
    parts = {}
    for i, top in enumerate(want):
        parts.setdefault(top, []).append((i % 7, f"n{i:02}"))
    for members in parts.values():
        assert {tuple(got[name]) for _, name in members} == {min(members)}


@pytest.mark.parametrize("reach", [1, 4, 5])
def test_jitter_against_all_pairs(spark, monkeypatch, reach):
    monkeypatch.setattr(co, "FLUSH", 10)
    draw = random.Random(reach)
    places = sorted({(draw.choice("AAB"), s, s + draw.randint(5, 25)) for s in (draw.randint(-40, 60) for _ in range(90))})
    links = [(i, j) for i, (g, s, e) in enumerate(places) for j, (h, t, f) in enumerate(places) if i < j and g == h and abs(s - t) <= reach and abs(e - f) <= reach]
    head = plain(len(places), links)
    want = {g: len({head[i] for i, x in enumerate(places) if x[0] == g}) for g in "AB"}
    rows = spark.createDataFrame(places * 2 + [("A", None, 3), (None, 1, 2)], "g string, s long, e long")
    assert {r.g: r.molecules for r in molecules.jitter_molecules(rows, ["g"], "s", "e", reach).collect()} == want


def test_a_long_chain_in_one_group_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(co, "FLUSH", 40)
    chain = spark.range(500).select(F.struct(F.col("id")).alias("a"), F.struct((F.col("id") + 1).alias("id")).alias("b"))
    got = co.linked_groups(spark.range(501), chain, "least").select("least.id").distinct().collect()
    assert [r.id for r in got] == [0]
