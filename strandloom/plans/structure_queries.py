"""Queries on tags, ends, profiles and exons, each by the operator of its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import assays, intervals, matrix, molecules, motifs, profiles, sampling, tables
from ..operators import reads as rd
from ..sources import text_formats as tf
from ..sources.work import work_path
from ..streaming import reads as stream
from .catalogue import _DEPTH, _SPANS, _genes, _span_reads, query, r6
from .fixture import reads, table

#: Reads of a file of a stream, about: each is dealt to one task and read by one.
STREAM_READS = 1_000_000

# Tags and molecules -------------------------------------------------------------------------------------------


@query("""
, t AS (SELECT well, region, umi || well AS seq FROM reads)
SELECT well, region, count(DISTINCT CASE region WHEN 'E' THEN left(seq, 4) WHEN 'I' THEN left(seq, 2) || substr(seq, 5, 2) END) AS tags, count(*) AS reads FROM t GROUP BY well, region""")
def tags_by_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chemistries with tags of their own, and one that has none."""
    tag = rd.pick_tag(F.col("region"), F.concat("umi", "well"), {"E": [(0, 4)], "I": [(0, 2), (4, 2)]})
    return reads(spark, sf_dir).groupBy("well", "region").agg(F.count_distinct(tag).alias("tags"), F.count("*").alias("reads"))


@query("""
, k AS (SELECT well, CASE WHEN nh = 'U' THEN {'at': pos - span, 'size': span, 'strand': strand, 'tag': umi} ELSE {'at': pos, 'size': 0, 'strand': strand, 'tag': umi} END AS key FROM reads)
SELECT well, count(*) AS reads, count(DISTINCT key) AS molecules FROM k GROUP BY well""")
def pair_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are one by their lower end, insert, strand and tag; reads without a mate by end, strand and tag."""
    key = molecules.pair_key(F.col("nh") == "U", F.col("pos"), F.col("pos") - F.col("span"), -F.col("span"), F.col("strand"), F.col("umi"))
    rows = reads(spark, sf_dir).groupBy("well", key.alias("key")).agg(F.count("*").alias("n"))
    return rows.groupBy("well").agg(F.sum("n").alias("reads"), F.count("*").alias("molecules"))


@query(", s AS (SELECT umi || well || gene AS seq FROM reads) SELECT count(*) AS reads, count(DISTINCT seq) AS sequences, count(DISTINCT left(seq, 5) || right(seq, 5)) AS fingerprints FROM s")
def sequence_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.sequence_duplicates(reads(spark, sf_dir).select(F.concat("umi", "well", "gene").alias("seq")), "seq", 5)


@query(", n AS (SELECT well, count(*) AS n FROM reads GROUP BY well) SELECT well, (SELECT min(n) FROM n) AS n FROM n")
def sampled_to_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.to_smallest(reads(spark, sf_dir), ["well"], ["orderkey", "lineno", "partkey", "suppkey"])
    return rows.groupBy("well").agg(F.count("*").alias("n"))


@query("SELECT well, region AS path, count(*) AS n FROM reads GROUP BY 1, 2")
def structural_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counters of each well and year, summed key by key."""
    each = reads(spark, sf_dir).groupBy("well", "ship_year", "region").agg(F.count("*").alias("n"))
    parts = each.groupBy("well", "ship_year").agg(F.map_from_entries(F.collect_list(F.struct("region", "n"))).alias("counters"))
    return tables.merge_counters(parts, ["well"], "counters")


@query("SELECT well, CAST(count(DISTINCT umi || gene) AS BIGINT) AS molecules FROM reads GROUP BY well")
def streamed_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as a stream of three batches whose state forgets nothing."""
    source, sink, marks = (work_path(spark, name) for name in ("reads", "molecules", "marks"))
    rows = reads(spark, sf_dir).select(F.make_date("ship_year", F.lit(1), F.lit(1)).cast("timestamp").alias("ts"), "well", "umi", "gene")
    each = max(1, -(-rows.count() // (3 * STREAM_READS)))
    rows.repartition(3 * each).write.parquet(source)
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(source)
    first = stream.first_molecules(files, "ts", ["well", "umi", "gene"], "40000 days")
    first.writeStream.outputMode("append").format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink).groupBy("well").agg(F.count("*").alias("molecules"))


# Reads --------------------------------------------------------------------------------------------------------


@query("""
, x AS (SELECT well, 'TTG' || umi || 'AAC' AS seq FROM reads), y AS (SELECT *, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM x)
SELECT well, count(*) FILTER ((contains(seq, 'GACG') OR contains(rc, 'GACG')) AND (contains(seq, 'CAAC') OR contains(rc, 'CAAC'))) AS chimeric FROM y GROUP BY well""")
def chimeric_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.concat(F.lit("TTG"), "umi", F.lit("AAC"))
    return reads(spark, sf_dir).groupBy("well").agg(F.count_if(motifs.both_codes(seq, "GACG", "CAAC")).alias("chimeric"))


@query("SELECT well, count(*) FILTER (regexp_matches(repeat('C', CAST(lineno * 4 AS INTEGER)) || repeat('T', CAST(span AS INTEGER)), '^.{18,40}T{12,}')) AS ended FROM reads GROUP BY well")
def rt_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates in which a run of T begins from place 18 to 40."""
    mate = F.concat(F.repeat(F.lit("C"), (F.col("lineno") * 4).cast("int")), F.repeat(F.lit("T"), F.col("span").cast("int")))
    return reads(spark, sf_dir).groupBy("well").agg(F.count_if(rd.run_starts_between(mate, "T", 12, 18, 40)).alias("ended"))


@query("""
, x AS (SELECT umi, gene, count(*) AS n FROM (SELECT umi, 'ACGTTGCAAC' AS gene FROM reads) GROUP BY 1, 2),
  t AS (SELECT umi, n, coalesce(max(k), 0) AS k FROM x LEFT JOIN (SELECT unnest(range(1, 7)) AS k) ON right(umi, k) = right(gene, k) GROUP BY umi, n)
SELECT CAST(k AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS reads FROM t GROUP BY k""")
def tail_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many letters of a fixed element's end stand at the end of each tag."""
    tags = reads(spark, sf_dir).groupBy("umi").agg(F.count("*").alias("n"))
    return tags.groupBy(sq.tail_match(F.col("umi"), F.lit("ACGTTGCAAC")).cast("long").alias("matched")).agg(F.sum("n").alias("reads"))


@query("""
, p AS (SELECT DISTINCT orderkey, pos FROM reads), k AS (SELECT orderkey, min(pos) AS pos FROM p GROUP BY orderkey UNION ALL SELECT k.orderkey, min(p.pos) FROM k JOIN p ON p.orderkey = k.orderkey AND p.pos >= k.pos + 3000 GROUP BY k.orderkey)
SELECT orderkey, count(*) AS kept, CAST(max(pos) AS BIGINT) AS last FROM k GROUP BY orderkey""")
def spaced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = reads(spark, sf_dir).groupBy("orderkey").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("places"))
    kept = sites.select("orderkey", sq.spaced_hits(F.col("places"), 3000).alias("kept"))
    return kept.select("orderkey", F.size("kept").cast("long").alias("kept"), F.element_at("kept", -1).cast("long").alias("last"))


@query("""
, g AS (SELECT gene, CAST(count(*) FILTER (region = 'E') AS DOUBLE) AS a, CAST(count(*) FILTER (region = 'I') AS DOUBLE) AS b, CAST(count(*) FILTER (region = 'R') AS DOUBLE) AS s FROM reads GROUP BY gene)
SELECT gene, round(a / nullif(a + s * a / nullif(a + b, 0), 0), 6) AS own, round(b / nullif(b + s * b / nullif(a + b, 0), 0), 6) AS other, round((a + b) / nullif(a + b + s, 0), 6) AS "both" FROM g""")
def paralog_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("gene").agg(*(F.count_if(F.col("region") == r).cast("double").alias(r) for r in "EIR"))
    shares = counts.select("gene", rd.paralog_inclusion(F.col("E"), F.col("I"), F.col("R")).alias("x"))
    return shares.select("gene", *(r6(F.col(f"x.{c}")).alias(c) for c in ("own", "other", "both")))


@query("""
, m AS (SELECT CASE WHEN nh = 'U' THEN 'long' ELSE 'short' END AS chemistry, replicate, CASE WHEN nh = 'U' THEN CASE WHEN NOT umi < 'G' THEN 0 WHEN NOT span >= 10 THEN 1 ELSE 2 END ELSE CASE WHEN NOT umi >= 'C' THEN 0 ELSE 1 END END AS level,
    CASE WHEN nh = 'U' THEN strand = '+' ELSE region = 'E' END AS correct FROM reads)
SELECT chemistry, replicate, CAST(l AS BIGINT) AS level, count(*) FILTER (m.level >= l) AS n, count(*) FILTER (m.level >= l AND correct) AS correct
FROM m, range(0, 3) t(l) WHERE l <= CASE chemistry WHEN 'long' THEN 2 ELSE 1 END GROUP BY chemistry, replicate, l""")
def chemistry_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of two constructs, each through the measures, gates and rule of its own chemistry."""
    of_tag = {"tag": lambda: F.col("umi")}
    known = {
        "U": assays.Chemistry("long", of_tag, (("tag", lambda: F.col("tag") < "G"), ("insert", lambda: F.col("span") >= 10)), lambda: F.col("strand") == "+"),
        "M": assays.Chemistry("short", of_tag, (("tag", lambda: F.col("tag") >= "C"),), lambda: F.col("region") == "E"),
    }
    rows = None
    for kind, chemistry in known.items():
        part = chemistry.funnel(reads(spark, sf_dir).where(F.col("nh") == kind), ["replicate"]).withColumn("chemistry", F.lit(chemistry.name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("chemistry", "replicate", F.col("level").cast("long").alias("level"), "n", "correct")


# Ends, profiles, exons ----------------------------------------------------------------------------------------


@query(f"""
, p AS (SELECT DISTINCT gene, pos, strand FROM reads), e AS (SELECT DISTINCT brand, e FROM {_SPANS})
SELECT p.gene, p.pos, p.strand, CASE WHEN p.strand = '+' THEN min(e) FILTER (e >= pos) ELSE max(e) FILTER (e <= pos) END AS nearest_end FROM p LEFT JOIN e ON e.brand = p.gene GROUP BY p.gene, p.pos, p.strand""")
def nearest_transcript_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reads(spark, sf_dir).select("gene", "pos", "strand").distinct()
    ends = _genes(spark, sf_dir).select(F.col("brand").alias("gene"), "e")
    return intervals.nearest_ends(points, ends, ["gene"], "pos", "strand", "e")


@query("""
, l AS (SELECT gene, max(pos) + 1 AS len FROM reads GROUP BY gene), d AS (SELECT r.contig, r.gene, len - 1 - pos AS distance, len FROM reads r JOIN l ON l.gene = r.gene WHERE len - 1 - pos BETWEEN 0 AND 2999),
  c AS (SELECT contig, gene, distance, len, count(*) AS n FROM d GROUP BY ALL), w AS (SELECT contig, gene, len, sum(n) / least(len, 3000) AS mean FROM c GROUP BY contig, gene, len),
  g AS (SELECT contig, distance, count(*) AS genes FROM w, range(0, 3000) t(distance) WHERE distance < least(len, 3000) GROUP BY ALL)
SELECT c.contig, c.distance, round(sum(n / mean) / any_value(genes), 6) AS level, any_value(genes) AS genes FROM c JOIN w ON w.contig = c.contig AND w.gene = c.gene JOIN g ON g.contig = c.contig AND g.distance = c.distance GROUP BY c.contig, c.distance""")
def three_prime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    placed = r.select("contig", "gene", "pos").join(r.groupBy("gene").agg((F.max("pos") + 1).alias("len")), "gene")
    return profiles.from_three_prime(placed, ["contig"], "gene", "pos", "len").withColumn("level", r6(F.col("level")))


@query(_DEPTH + " SELECT gene, CAST(sum(to_pos - from_pos) AS BIGINT) AS positions, CAST(sum((to_pos - from_pos) * depth) AS BIGINT) AS bases FROM steps WHERE depth > 0 GROUP BY gene")
def depth_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = intervals.depth_grid(intervals.depth_steps(_span_reads(spark, sf_dir), ["gene"], "pos", "stop"), ["gene"])
    return grid.groupBy("gene").agg(F.count("*").alias("positions"), F.sum("depth").alias("bases"))


@query("""
, d AS (SELECT gene, pos, count(*) AS depth FROM reads GROUP BY 1, 2), g AS (SELECT gene, max(depth) AS peak, avg(depth) AS mean, CAST(sum(depth) AS BIGINT) AS depth, max(pos) - arg_min(pos, {'a': -depth, 'b': pos}) AS from_end FROM d GROUP BY gene)
SELECT gene, peak, round(mean, 6) AS mean, depth, from_end FROM g WHERE peak >= 1.5 * mean AND depth >= 30 AND from_end >= 1000""")
def peaky_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reads(spark, sf_dir).groupBy("gene", "pos").agg(F.count("*").alias("depth"))
    top = F.min_by("pos", F.struct((-F.col("depth")).alias("a"), F.col("pos").alias("b")))
    g = d.groupBy("gene").agg(F.max("depth").alias("peak"), F.avg("depth").alias("mean"), F.sum("depth").alias("depth"), (F.max("pos") - top).alias("from_end"))
    return assays.peaky_genes(g, "peak", "mean", "depth", "from_end", 1.5).withColumn("mean", r6(F.col("mean")))


@query(f"""
, x AS (SELECT brand, s, e, row_number() OVER (PARTITION BY brand ORDER BY s) AS i, count(*) OVER (PARTITION BY brand) AS n FROM {_SPANS}), t AS (SELECT DISTINCT gene, pos FROM reads WHERE region = 'R' AND lineno = 7),
  h AS (SELECT brand, min(i) AS a, max(i) AS b, any_value(n) AS n FROM x JOIN t ON t.gene = x.brand AND pos >= s AND pos <= e GROUP BY brand),
  w AS (SELECT *, greatest(a - CAST(ceil(greatest(3 - (b - a + 1), 0) / 2.0) AS BIGINT), 1) AS low, CAST(ceil(greatest(3 - (b - a + 1), 0) / 2.0) AS BIGINT) AS more FROM h), v AS (SELECT *, least(low + greatest(2, b - a + more), n) AS high FROM w),
  u AS (SELECT brand, least(low, greatest(high - 2, 1)) AS lo, greatest(high, b) AS hi FROM v)
SELECT x.brand, min(s) AS window_start, max(e) AS window_end, count(*) AS exons FROM x JOIN u ON u.brand = x.brand AND i >= lo AND i <= hi GROUP BY x.brand""")
def zoom_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = reads(spark, sf_dir).where("region = 'R' and lineno = 7").select(F.col("gene").alias("brand"), "pos").distinct()
    return assays.zoom_window(_genes(spark, sf_dir).select("brand", "s", "e"), sites, "brand", "s", "e", "pos")


@query("""WITH x AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'rrna' WHEN p_type = 'PROMO' THEN 'ribosomal_protein' WHEN p_type IN ('STANDARD', 'SMALL') THEN 'coding' ELSE 'other' END AS class, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e FROM part),
  g AS (SELECT *, max(e) OVER (PARTITION BY class ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY class ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM g)
SELECT class, min(s) AS s, max(e) AS e FROM i GROUP BY class, isle""")
def merged_exon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of each class as disjoint stretches; types stand for the genes' kinds."""
    kind = F.col("p_type")
    gene, biotype = F.when(kind == "PROMO", "RPL3").otherwise("ACTB"), F.when(kind == "ECONOMY", "rRNA").when(kind.isin("PROMO", "STANDARD", "SMALL"), "protein_coding").otherwise("lncRNA")
    exons = table(spark, sf_dir, "part").select(rd.exon_class(gene, biotype).alias("class"), (F.col("p_partkey") * 10).alias("s"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("e"))
    return intervals.merge_intervals(exons, ["class"], "s", "e")


@query("SELECT contig, pos, umi, count(*) AS n FROM reads WHERE contig = 'HUMAN_2' AND pos >= 500 AND pos < 900 GROUP BY 1, 2, 3")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "regions")
    tf.write_by_region(reads(spark, sf_dir).select("contig", "pos", "umi"), path, "contig", "pos", 400)
    rows = tf.read_region(spark, path, "pos long, umi string, contig string", "contig", "pos", ("HUMAN_2", 500, 900))
    return rows.groupBy("contig", "pos", "umi").agg(F.count("*").alias("n"))


@query("""
, c AS (SELECT gene, well, count(*) AS n FROM reads GROUP BY 1, 2), p AS (SELECT a.well AS a, b.well AS b, a.n AS x, b.n AS y FROM c a JOIN c b USING (gene) WHERE a.well < b.well),
  r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p)
SELECT a, b, round(corr(rx, ry), 6) AS rho FROM r GROUP BY a, b""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", "well").agg(F.count("*").alias("n"))
    return matrix.spearman(matrix.sample_pairs(c, "gene", "well", "n"), ["a", "b"]).withColumn("rho", r6(F.col("rho")))
