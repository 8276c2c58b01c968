"""Queries over all reads against brute force: nothing but an operator's own conditions may leave a read out."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import matrix, molecules
from strandloom.operators import reads as rd
from strandloom.plans import catalogue
from strandloom.plans.fixture import reads


def test_near_tag_pairs_of_all_reads(spark, sf_dir):
    tags = {(r.well, r.umi) for r in reads(spark, sf_dir).select("well", "umi").collect()}
    near = {(w, t, t[:i] + x + t[i + 1 :]) for w, t in tags for i in range(6) for x in "ACGT"}
    want = {(w, a, b) for w, a, b in near if a < b and (w, b) in tags}
    got = [tuple(r) for r in catalogue.near_tag_pairs(spark, sf_dir).select("well", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_optical_neighbours_of_all_reads(spark, sf_dir):
    tiles = {}
    for r in reads(spark, sf_dir).select("well", "contig", "pos", "span", "orderkey", "lineno").collect():
        tiles.setdefault((r.well, r.contig), []).append((r.pos, r.span, r.orderkey * 100 + r.lineno))
    near = {(w, i) for (w, _), spots in tiles.items() for x, y, i in spots for u, v, j in spots if i != j and (x - u) ** 2 + (y - v) ** 2 <= 400}
    got = {r.well: r.neighbours for r in catalogue.optical_neighbours(spark, sf_dir).collect()}
    assert got == Counter(w for w, _ in near)


def test_kmer_index_of_all_reads(spark, sf_dir):
    names = {(f"{r.gene}:{r.umi}", 2 * r.umi) for r in reads(spark, sf_dir).select("gene", "umi").collect()}
    grams = [(s[i : i + 9], name, i) for name, s in names for i in range(4)]
    times = Counter(k for k, _, _ in grams)
    got = {tuple(r) for r in catalogue.kmer_unique_index(spark, sf_dir).select("kmer", "name", "offset").collect()}
    assert got == {g for g in grams if times[g[0]] == 1}


def test_slice_has_only_its_own_gates(spark, sf_dir):
    columns = ["well", "umi", "contig", "pos", "gene", "strand"]
    rows = reads(spark, sf_dir).select(*columns, "region", "nh").collect()
    want = Counter(tuple(r[c] for c in columns) for r in rows if r.region == "E" and r.nh == "U" and r.contig.startswith("HUMAN") and r.well != "W05")
    assert Counter(tuple(r[c] for c in columns) for r in catalogue.read_table_slice(spark, sf_dir).collect()) == want


def test_every_read_position_is_a_spot(spark, sf_dir):
    places = {}
    for r in reads(spark, sf_dir).select("contig", "pos", "well", "umi").collect():
        places.setdefault((r.contig, r.pos), []).append((r.well, r.umi))
    want = {}
    for contig, spot in places:
        near = [x for p in range(spot - 25, spot + 26) for x in places.get((contig, p), ())]
        want[contig, spot] = (len(near), len(set(near)), max(Counter(w for w, _ in near).values()) / len(near))
    got = {(r.contig, r.spot): r for r in catalogue.peak_molecules(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all((got[k].reads, got[k].molecules) == (n, m) and abs(got[k].top_share - share) < 1e-6 for k, (n, m, share) in want.items())


def test_every_declared_code_counts(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(1)
    codes = spark.range(1, 1501).withColumnRenamed("id", "_i")
    part.crossJoin(codes).withColumns({"p_partkey": F.col("_i"), "p_brand": F.concat(F.lit("Brand#1"), F.col("_i"))}).drop("_i").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1)
    lines.crossJoin(codes).withColumn("l_partkey", F.col("_i")).drop("_i").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalogue.demux_code_report(spark, str(tmp_path)).collect()
    assert len(rows) == 1500 and all(r.declared and r.pct_assigned == r.pct_total == round(100 / 1500, 6) for r in rows)


def test_too_many_distances_are_refused(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MOST_SAMPLES", 1)
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0)], "a string, b string, d double")
    with pytest.raises(ValueError):
        matrix.average_linkage(d, "a", "b", "d")


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_and_spots_on_any_places(spark, seed):
    rng = np.random.default_rng(seed)
    places = rng.integers(-60, 60, (250, 2)).tolist()
    rows = [(f"f{i % 3}", "t" if i % 5 else None, None if i == 7 else x, y, i, f"s{i % 4}", f"u{i % 6}" if i % 9 else None) for i, (x, y) in enumerate(places)]
    table = spark.createDataFrame(rows, "family string, tile string, x long, y long, id long, sample string, tag string")
    fine = [r for r in rows if r[1] and r[2] is not None]
    near = {a[4]: a[0] for a in fine for b in fine if a[0] == b[0] and a[4] != b[4] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 49}
    got = {r.family: r.neighbours for r in molecules.optical_neighbours(table, ["family"], "tile", "x", "y", "id", 7).collect()}
    assert got == Counter(near.values())
    spots = spark.createDataFrame([("t", s) for s in range(-70, 70, 3)], "tile string, spot long")
    got = {r.spot: (r.reads, r.molecules, r.top_share) for r in rd.peak_windows(table, spots, ["tile"], "x", "spot", "tag", "sample", 5).collect()}
    want = {}
    for s in range(-70, 70, 3):
        inside = [r for r in fine if abs(r[2] - s) <= 5]
        if inside:
            most = max(Counter(r[5] for r in inside).values())
            want[s] = (len(inside), len({(r[5], r[6]) for r in inside if r[6]}), most / len(inside))
    assert got == want


def test_spots_next_to_tiles_and_a_spot_asked_for_twice(spark, monkeypatch):
    """Tiles of 11 places: windows reach over their borders, and the sums of a spot aren't doubled when it is asked for twice."""
    monkeypatch.setattr(rd, "PEAK_TILE", 11, raising=False)
    rng = np.random.default_rng(9)
    rows = [("c", int(x), f"s{i % 3}", f"u{i % 5}") for i, x in enumerate(rng.integers(-40, 40, 300))]
    spots = spark.createDataFrame([("c", s) for s in range(-50, 50)] * 2, "contig string, spot int")
    found = rd.peak_windows(spark.createDataFrame(rows, "contig string, pos long, sample string, tag string"), spots, ["contig"], "pos", "spot", "tag", "sample", 5)
    want = {}
    for s in range(-50, 50):
        near = [r for r in rows if abs(r[1] - s) <= 5]
        if near:
            want[s] = (len(near), len({r[2:] for r in near}), max(Counter(r[2] for r in near).values()) / len(near))
    assert {r.spot: (r.reads, r.molecules, r.top_share) for r in found.collect()} == want
    assert found.count() == len(want) and found.schema["spot"].dataType.simpleString() == "int"
