"""Cases that tables of the usual shape don't reach: nulls in keys, gaps between rows, names at the edge of a rule."""

import gzip
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import intervals, matrix, molecules, sampling
from strandloom.operators import reads as rd
from strandloom.sources import text_formats as tf


def test_null_keys_meet_nothing(spark):
    left = spark.createDataFrame([("chr1", None, 2, 4), (None, "chr1", 2, 4), ("chr1", "x", 2, 4), ("chr1", "x", 2, 4), ("chr1", "y", 9, 12)], "c string, k string, s long, e long")
    right = spark.createDataFrame([("chr1", 2, 5), (None, 2, 5)], "c string, rs long, re long")
    rows = lambda how: Counter(map(tuple, intervals.overlap_join(left, right, ["c"], ("s", "e"), ("rs", "re"), 4, how).select("c", "k", "s", "e").collect()))
    assert rows("left_semi") == {("chr1", None, 2, 4): 1, ("chr1", "x", 2, 4): 2}
    assert rows("left_anti") == {(None, "chr1", 2, 4): 1, ("chr1", "y", 9, 12): 1}
    spans = spark.createDataFrame([("chr1", 2, 5, "g"), (None, 2, 5, "h")], "c string, s long, e long, name string")
    points = spark.createDataFrame([("chr1", None, 3), (None, "chr1", 3), ("chr1", "x", 8)], "c string, k string, at long")
    got = {(r.c, r.k): r.name for r in intervals.containing_interval(points, spans, ["c"], "at", ("s", "e"), 4).collect()}
    assert got == {("chr1", None): "g", (None, "chr1"): None, ("chr1", "x"): None}


def dense_peaks(depth, median, fold, width):
    """The rule read off a whole vector, position by position."""
    kept = []
    for i in range(1, len(depth) - 1):
        top = median > 0 and depth[i] >= fold * median and depth[i] >= depth[i - 1] and depth[i] > depth[i + 1]
        low = [x for x in range(len(depth)) if 2 * depth[x] < depth[i]]
        left = max([x for x in low if x < i], default=-1) + 1
        right = min([x for x in low if x > i], default=len(depth)) - 1
        if top and right - left < width and (not kept or i - kept[-1] >= width):
            kept.append(i)
    return len(kept)


@pytest.mark.parametrize("seed", range(4))
def test_peaks_on_positions(spark, seed):
    draw = random.Random(seed)
    depth = [0] * 900
    for _ in range(14):
        centre, size, high = draw.randrange(900), draw.choice([1, 3, 40, 100]), draw.randrange(1, 40)
        for x in range(max(centre - size, 0), min(centre + size, 900)):
            depth[x] = max(depth[x], high - abs(x - centre) % 7)
    depth[0] = depth[-1] = 1
    rows = [("g", i + 5000, float(d), 2.0) for i, d in enumerate(depth) if d]
    got = intervals.peaks(spark.createDataFrame(rows, "g string, p long, d double, m double"), ["g"], "p", "d", "m", 5, 150).first()
    assert got.n_peaks == dense_peaks(depth, 2.0, 5, 150)


def test_peaks_far_apart_on_few_rows(spark):
    rows = [("g", p, d, 1.0) for p, d in ((0, 1.0), (100, 9.0), (101, 3.0), (700, 9.0), (701, 2.0), (900, 1.0))]
    assert intervals.peaks(spark.createDataFrame(rows, "g string, p long, d double, m double"), ["g"], "p", "d", "m").first().n_peaks == 2


def test_ribosomal_genes_of_corrected_molecules(spark):
    names = ["MRPL12", "mrps7", "RPS6KA1", "RPL8", "RPLP0", "Rps3", "GAPDH", "RPS6KB2"]
    rows = [("w", u, g) for g in names for u in ("ACGTAC", "CATGCA")]
    got = molecules.corrected_molecules(spark.createDataFrame(rows, "w string, u string, g string"), "w", "u", "g").first()
    assert (got.genes, got.genes_no_rp) == (8, 3)
    frame = spark.createDataFrame([(n,) for n in names], "g string")
    rule = rd.is_ribosomal(F.col("g"), "mitochondrial too, no kinases")
    assert {r.g for r in frame.where(rule).collect()} == {"MRPL12", "mrps7", "RPL8", "RPLP0", "Rps3"}


def test_collisions_without_tags_or_with_one():
    one = molecules.Collisions(np.array([1.0]), np.array([1.0]))
    assert one.behind(np.array([1.0])).tolist() == [1.0]
    even = molecules.Collisions(np.array([1 / 64]), np.array([64.0]))
    back = even.behind(np.array([1.0, 10.0, 60.0]))
    assert back[0] == 1 and abs(64 * (1 - (63 / 64) ** back[1]) - 10) < 0.01 and abs(64 * (1 - (63 / 64) ** back[2]) - 60) < 0.05


def test_suffixes(spark):
    names = spark.createDataFrame([("well_A1",), ("A1",), ("B2",), ("C3",), (None,)], "n string")
    keys = spark.createDataFrame([("well_A1",), ("plate_well_A1",), ("x_B2",), ("y_C3",), ("z_C3",), (None,)], "k string")
    assert {r.n: r.k for r in rd.suffix_match(names, keys, "n", "k").collect()} == {"well_A1": "well_A1", "A1": None, "B2": "x_B2", "C3": None, None: None}


def test_average_linkage_against_all_pairs(spark):
    draw = np.random.default_rng(4)
    far = draw.random((9, 9)) + 0.1
    far = far + far.T
    rows = [(f"s{i}", f"s{j}", float(far[i, j])) for i in range(9) for j in range(i)]
    got = matrix.average_linkage(spark.createDataFrame(rows, "a string, b string, d double"), "a", "b", "d")
    groups = [[i] for i in range(9)]
    for low, high, d in got:
        best, p, q = min((np.mean([far[x, y] for x in p for y in q]), p, q) for p in groups for q in groups if p > q)
        assert abs(best - d) < 1e-9 and sorted([low, high]) == sorted([[f"s{x}" for x in p], [f"s{x}" for x in q]])
        groups = [g for g in groups if g not in (p, q)] + [sorted(p + q)]


@pytest.mark.parametrize("copies", [1, 3])
def test_ranks_by_hash_are_those_of_one_window(spark, copies):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id % 7) AS g", f"id DIV {copies} AS id", "id AS n")
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(sampling.hash_order("id", seed=4), "id")))
    got = sampling.hashed_rank(rows, ["g"], ["id"], 4, "r")
    assert Counter((r.g, r.id, r.r) for r in got.collect()) == Counter((r.g, r.id, r.r) for r in one.collect())
    assert got.columns == [*rows.columns, "r"]
    assert sampling.hashed_rank(rows.limit(0), ["g"], ["id"]).count() == 0


def test_rarefaction_keeps_null_groups_and_drops_depths_too_deep(spark):
    rows = spark.range(50).selectExpr("IF(id < 30, NULL, 'a') AS g", "id")
    got = {(r.g, r.depth): (r.n, r.last) for r in sampling.rarefy(rows, ["g"], ["id"], [5, 20, 25], {"n": F.count("*"), "last": F.max("id")}).collect()}
    assert got == {(None, 5): (5, 4), (None, 20): (20, 19), (None, 25): (25, 24), ("a", 5): (5, 34), ("a", 20): (20, 49)}


def test_fastq_plain_and_gzipped(spark, tmp_path):
    want = set()
    for name, ends, n in [("a.fastq.gz", "\n", 25001), ("b.fastq.gz", "\r\n", 7), ("c.fastq", "\r\n", 25), ("d.fastq", "\n", 0), ("e.fastq.gz", "\n", 0), ("f.fastqz", "\n", 3)]:
        rows = [(f"{name}:{i}", "ACGT"[: i % 5], "@+I?"[: i % 5]) for i in range(n)]
        text = "".join(f"@{r} more{ends}{s}{ends}+{ends}{q}{ends}" for r, s, q in rows)
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        want |= {(name, i, *r) for i, r in enumerate(rows)}
    got = [(r.path.rsplit("/", 1)[1], r["index"], r.read_id, r.seq, r.qual) for r in tf.read_fastq(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    one = tf.read_fastq(spark, [str(tmp_path / "b.fastq.gz"), str(tmp_path / "c.fastq")])
    assert one.count() == 32


@pytest.mark.parametrize("text", ["@a\nAC\n+\nI", "@a\nAC\n+\nII\n@b\nAC\n", "a\nAC\n+\nII\n", "@ \nAC\n+\nII\n"])
@pytest.mark.parametrize("name", ["x.fastq", "x.fastq.gz"])
def test_fastq_that_is_none(spark, tmp_path, name, text):
    (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    with pytest.raises(Exception, match="isn't FASTQ"):
        tf.read_fastq(spark, str(tmp_path)).collect()


@pytest.fixture
def cut_at(spark):
    """Sets how many bytes of a file are one task's block."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        for name, value in zip(names, (size, 1, 1)):
            spark.conf.set(name, value)

    yield to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("shuffled", [False, True])
def test_one_file_is_cut_anywhere(spark, tmp_path, monkeypatch, cut_at, shuffled):
    """Qualities that look like the head of a record or its third line, reads without bases, and records longer than a block."""
    rows = [(f"r{i}", "ACGT"[: i % 5] * 3, "@+@I"[: i % 5] * 3) for i in range(60)] + [("long", "A" * 9000, "@" * 9000)] + [(f"s{i}", "AC", "+@") for i in range(9)]
    for name, ends in (("a.fastq", "\n"), ("b.fastq", "\r\n")):
        (tmp_path / name).write_text("".join(f"@{r}{ends}{s}{ends}+{ends}{q}{ends}" for r, s, q in rows), newline="")
    want = Counter((name, i, *r) for name in ("a.fastq", "b.fastq") for i, r in enumerate(rows))
    if shuffled:
        monkeypatch.setattr(tf, "MOST_BLOCKS", 0)
        monkeypatch.setattr(tf, "DEALT_RECORDS", 3)
    for size in (900, 911) if shuffled else range(900, 932, 3):
        cut_at(size)
        frame = tf.read_fastq(spark, str(tmp_path))
        assert Counter((r.path.rsplit("/", 1)[1], r["index"], r.read_id, r.seq, r.qual) for r in frame.collect()) == want, size


def test_a_plain_file_is_many_tasks_work(spark, tmp_path, cut_at):
    (tmp_path / "x.fastq").write_text("".join(f"@r{i}\nACGTACGT\n+\nIIIIIIII\n" for i in range(20000)))
    cut_at(50_000)
    rows = tf.read_fastq(spark, str(tmp_path / "x.fastq"))
    tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).where("n > 1000").count()
    assert rows.count() == 20000 and tasks >= 8
    assert rows.agg(F.count_distinct("index"), F.max("index")).first()[:] == (20000, 19999)


def test_sections_and_histograms_of_several_files(spark, tmp_path):
    (tmp_path / "s1").write_text("\n".join(["[one]", "a1", "a2", "a3", "[two]", "b1"]))
    (tmp_path / "s2").write_text("\n".join(["loose", "[first]", "x1", "x2", "x3", "[second]", "y1"]))
    got = {}
    for r in tf.read_sections(spark, str(tmp_path / "s*")).orderBy("path", "n").collect():
        got.setdefault(r.section, []).append(r.line)
    assert got == {"one": ["a1", "a2", "a3"], "two": ["b1"], "first": ["x1", "x2", "x3"], "second": ["y1"]}
    (tmp_path / "h1").write_text("## METRICS\n1\n2\n## HISTOGRAM\tx\nposition\tcoverage\n0\t1.5\n1\t2\n")
    (tmp_path / "h2").write_text("## HISTOGRAM\tx\nposition\tcoverage\n0\t3\n")
    rows = tf.read_histogram(spark, str(tmp_path / "h*")).collect()
    assert Counter((r.path[-2:], r.position, r.coverage) for r in rows) == Counter([("h1", 0, 1.5), ("h1", 1, 2.0), ("h2", 0, 3.0)])


def test_a_gzipped_file_is_read_once(spark, tmp_path, monkeypatch):
    """No first pass counts its lines; ids end at any white space, records go on from file to file, and a cut file fails."""
    passes = []
    monkeypatch.setattr(tf, "written", lambda rows, name: passes.append(name) or rows)
    want = set()
    for k in range(3):
        with gzip.open(f"{tmp_path}/{k}.fq.gz", "wt") as f:
            for i in range(25_000):
                f.write(f"@r{k}_{i}\tx\n{'ACGT'[i % 4]}\n+\n@\n")
                want.add((k, i, f"r{k}_{i}"))
    got = tf.read_fastq(spark, f"{tmp_path}/*.fq.gz").selectExpr("int(regexp_extract(path, '([0-9]).fq', 1))", "index", "read_id").collect()
    assert passes == [] and len(got) == len(want) and {tuple(r) for r in got} == want
    with gzip.open(f"{tmp_path}/cut.fq.gz", "wt") as f:
        f.write("@a\nA\n+\nI\n@b\nA\n")
    with pytest.raises(Exception, match="record 1 isn't FASTQ"):
        tf.read_fastq(spark, f"{tmp_path}/cut.fq.gz").count()


def test_work_is_cut_and_done_once(spark, sf_dir, monkeypatch):
    """Tags of wells are written once, a stream's files grow in number with its reads, and a CIGAR is matched by one expression."""
    from glob import glob

    from strandloom.functions import sequence
    from strandloom.plans import structure_queries

    names, real = [], molecules.__dict__.get("written")
    monkeypatch.setattr(molecules, "written", lambda rows, name: names.append(name) or real(rows, name), raising=False)
    rows = spark.createDataFrame([("W", "ACGT", "g"), ("W", "ACGT", "g"), ("W", "CCGT", "h")], "well string, tag string, gene string")
    assert molecules.corrected_molecules(rows, "well", "tag", "gene").first().b_raw == 2 and names == ["tags"]
    paths, place = {}, structure_queries.work_path
    monkeypatch.setattr(structure_queries, "STREAM_READS", 500, raising=False)
    monkeypatch.setattr(structure_queries, "work_path", lambda s, n: paths.setdefault(n, place(s, n)))
    assert structure_queries.streamed_molecules(spark, sf_dir).count() > 0
    assert len(glob(paths["reads"].removeprefix("file://") + "/*.parquet")) > 3
    ops = spark.createDataFrame([("12M3N4S",)], "c string").select(sequence.cigar_ops(F.col("c")).alias("o"))
    assert [tuple(o) for o in ops.first().o] == [(12, "M"), (3, "N"), (4, "S")] and "regexp_extract(" not in ops._jdf.queryExecution().toString()
