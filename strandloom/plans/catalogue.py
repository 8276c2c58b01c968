"""Queries by name over the driver's tables, with the same computation in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import statistics as st
from ..operators import barcodes, checks, intervals, matrix, molecules, motifs, profiles, ranking, sampling, scans, splicing, tables
from ..operators import reads as rd
from .fixture import READS_SQL, reads, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE reads AS ({READS_SQL}) {sql}" if "reads" in sql else sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


KEPT = "region = 'E' AND nh = 'U' AND contig LIKE 'HUMAN%'"
DEPTHS = [25, 50, 100, 200]
#: Codes of the positional call: prefixes that occur in the umi column, and longer ones.
CODES = ["ACGTA", "CCGTA", "GGGAA", "TTTCC", "AGCT", "CTAG"]
_CODE_ROWS = ", ".join(f"('{c}')" for c in CODES)


# Reads, slices, composition -----------------------------------------------------------------------------------


@query(f"""
, kept AS (SELECT * FROM reads WHERE {KEPT}),
  n AS (SELECT well, count(*) reads, count(DISTINCT umi || gene) b, count(DISTINCT gene) genes, count(DISTINCT contig || strand || CAST(pos AS VARCHAR) || umi) c FROM kept GROUP BY well)
SELECT well, reads, b AS molecules_b, c AS molecules_c, genes, round(100.0 * (reads - c) / reads, 6) AS duplicate_pct,
  round(100 * (((reads - c) / reads + 3.8416 / (2 * reads)) / (1 + 3.8416 / reads) - 1.96 * sqrt((reads - c) / reads * (1 - (reads - c) / reads) / reads + 3.8416 / (4 * reads * reads)) / (1 + 3.8416 / reads)), 6) AS low,
  round(100 * (((reads - c) / reads + 3.8416 / (2 * reads)) / (1 + 3.8416 / reads) + 1.96 * sqrt((reads - c) / reads * (1 - (reads - c) / reads) / reads + 3.8416 / (4 * reads * reads)) / (1 + 3.8416 / reads)), 6) AS high
FROM (SELECT well, CAST(reads AS DOUBLE) AS reads, b, CAST(c AS DOUBLE) AS c, genes FROM n)""")
def molecules_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reads(spark, sf_dir).where(KEPT)
    n = kept.groupBy("well").agg(F.count("*").cast("double").alias("reads"), F.count_distinct("umi", "gene").alias("molecules_b"), F.count_distinct("contig", "strand", "pos", "umi").cast("double").alias("molecules_c"), F.count_distinct("gene").alias("genes"))
    dup = F.col("reads") - F.col("molecules_c")
    low, high = st.wilson(dup, F.col("reads"))
    return n.select("well", "reads", "molecules_b", "molecules_c", "genes", r6(100 * dup / F.col("reads")).alias("duplicate_pct"), r6(low).alias("low"), r6(high).alias("high"))


@query(f"SELECT well, umi, contig, pos, gene, strand FROM reads WHERE {KEPT} AND well <> 'W05'")
def read_table_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.createDataFrame([("W05",)], "well string")
    kept = reads(spark, sf_dir).where(KEPT)
    return kept.join(F.broadcast(excluded), "well", "left_anti").select("well", "umi", "contig", "pos", "gene", "strand")


@query("""SELECT 'all' AS step, count(*) AS n FROM reads UNION ALL SELECT 'region', count(*) FROM reads WHERE region = 'E'
UNION ALL SELECT 'unique', count(*) FROM reads WHERE region = 'E' AND nh = 'U' UNION ALL SELECT 'species', count(*) FROM reads WHERE region = 'E' AND nh = 'U' AND contig LIKE 'HUMAN%'""")
def slice_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = {"region": F.col("region") == "E", "unique": F.col("nh") == "U", "species": F.col("contig").startswith("HUMAN")}
    fate = tables.read_fate(reads(spark, sf_dir), [], gates)
    return fate.select(F.stack(F.lit(4), F.lit("all"), "reads_in", F.lit("region"), "region", F.lit("unique"), "unique", F.lit("species"), "species").alias("step", "n"))


@query("SELECT well, region, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY well), 6) AS share FROM reads GROUP BY well, region")
def composition_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.composition(reads(spark, sf_dir), ["well"], "region").withColumn("share", r6(F.col("share")))


@query("SELECT CASE WHEN region = 'R' THEN 'rrna' WHEN strand = '-' AND region = 'I' THEN 'antisense' WHEN region = 'I' THEN 'intronic' ELSE 'exonic' END AS class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM reads GROUP BY 1")
def composition_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = tables.first_match([("rrna", F.col("region") == "R"), ("antisense", (F.col("strand") == "-") & (F.col("region") == "I")), ("intronic", F.col("region") == "I")], "exonic")
    counts = reads(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", r6(100 * F.col("n") / F.col("_all")).alias("pct"))


@query("SELECT contig, well, count(*) AS n, count(*) FILTER (nh = 'U') AS n_unique, round(100.0 * count(*) FILTER (region = 'E') / count(*), 6) AS exonic_pct FROM reads GROUP BY GROUPING SETS ((contig, well), (contig))")
def composition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pooled_and_each(reads(spark, sf_dir), ["contig"], "well", {"n": F.count("*"), "n_unique": F.count_if(F.col("nh") == "U"), "exonic_pct": r6(100 * F.count_if(F.col("region") == "E") / F.count("*"))})


@query("""SELECT well, count(*) AS reads_in, count(*) FILTER (contig LIKE 'HUMAN%') AS mapped, count(*) FILTER (contig LIKE 'HUMAN%' AND nh = 'U') AS uniq, count(*) FILTER (contig LIKE 'HUMAN%' AND nh = 'U' AND region = 'E') AS filtered,
round(100.0 * count(*) FILTER (contig LIKE 'HUMAN%') / count(*), 6) AS mapped_pct, round(100.0 * count(*) FILTER (contig LIKE 'HUMAN%' AND nh = 'U') / count(*), 6) AS uniq_pct, round(100.0 * count(*) FILTER (contig LIKE 'HUMAN%' AND nh = 'U' AND region = 'E') / count(*), 6) AS filtered_pct FROM reads GROUP BY well""")
def read_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.read_fate(reads(spark, sf_dir), ["well"], {"mapped": F.col("contig").startswith("HUMAN"), "uniq": F.col("nh") == "U", "filtered": F.col("region") == "E"})
    return out.withColumns({c: r6(F.col(c)) for c in ("mapped_pct", "uniq_pct", "filtered_pct")})


@query("""SELECT well, count(*) FILTER (contig = 'HUMAN_1') AS "HUMAN_1", count(*) FILTER (contig = 'HUMAN_2') AS "HUMAN_2", count(*) FILTER (contig = 'MOUSE_1') AS "MOUSE_1" FROM reads GROUP BY well""")
def crosstab_code_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.crosstab(reads(spark, sf_dir), ["well"], "contig", ["HUMAN_1", "HUMAN_2", "MOUSE_1"])


@query("SELECT CASE WHEN nh <> 'U' THEN 'multi' WHEN region <> 'E' THEN 'region' WHEN span < 10 THEN 'short' END AS reason, count(*) AS n FROM reads GROUP BY 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = tables.drop_reason([("multi", F.col("nh") == "U"), ("region", F.col("region") == "E"), ("short", F.col("span") >= 10)])
    return reads(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
, lev AS (SELECT CASE WHEN contig = 'MOUSE_1' THEN 0 WHEN nh <> 'U' THEN 1 WHEN region <> 'E' THEN 2 WHEN span < 20 THEN 3 ELSE 4 END AS lv, strand = '+' AS ok FROM reads),
  t AS (SELECT g.level, CAST(count(*) AS DOUBLE) n, CAST(count(*) FILTER (ok) AS DOUBLE) c FROM lev JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS level) g ON lv >= g.level GROUP BY 1)
SELECT CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS correct, round(100 * c / n, 6) AS accuracy_pct,
  round(100 * ((c / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(100 * ((c / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM t""")
def cumulative_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = tables.funnel_level([F.col("contig") != "MOUSE_1", F.col("nh") == "U", F.col("region") == "E", F.col("span") >= 20])
    rows = reads(spark, sf_dir).select(level.alias("lv"), (F.col("strand") == "+").alias("ok"))
    out = tables.cumulative_funnel(rows, [], "lv", "ok", 4)
    return out.select(F.col("level").cast("long"), "n", "correct", *(r6(F.col(c)).alias(c) for c in ("accuracy_pct", "low", "high")))


@query("SELECT orderkey, CASE WHEN count(DISTINCT left(contig, 5)) > 1 THEN 'ambiguous' ELSE min(left(contig, 5)) END AS call FROM reads GROUP BY orderkey")
def species_from_all_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.species_call(reads(spark, sf_dir).withColumn("s", F.substring("contig", 1, 5)), ["orderkey"], "s")


@query("""
, c AS (SELECT well, count(*) FILTER (contig LIKE 'HUMAN%') human, count(*) FILTER (contig LIKE 'MOUSE%') mouse FROM reads GROUP BY well)
SELECT well, human, mouse, CASE WHEN human + mouse >= 50 THEN CASE WHEN human > mouse THEN 'human' WHEN mouse > human THEN 'mouse' END END AS call, round(greatest(human, mouse) / (human + mouse), 6) AS confidence FROM c""")
def code_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("s", sq.species_of(F.col("contig")))
    return tables.direction(rows, "well", "s", 50).withColumn("confidence", r6(F.col("confidence")))


@query("""
, c AS (SELECT well, CAST(count(*) FILTER (contig LIKE 'HUMAN%' AND strand = '+') AS DOUBLE) ah, CAST(count(*) FILTER (contig LIKE 'MOUSE%' AND strand = '+') AS DOUBLE) am,
  CAST(count(*) FILTER (contig LIKE 'HUMAN%' AND strand = '-') AS DOUBLE) th, CAST(count(*) FILTER (contig LIKE 'MOUSE%' AND strand = '-') AS DOUBLE) tm FROM reads GROUP BY well),
  e AS (SELECT *, ah + am + th + tm AS n, (ah + th) / (ah + am + th + tm) AS base, (ah + tm) / (ah + am + th + tm) AS seen FROM c),
  x AS (SELECT *, CASE WHEN ah + am > 0 AND th + tm > 0 THEN (ah + am) / n * base + (th + tm) / n * (1 - base) WHEN ah + am > 0 THEN base ELSE 1 - base END AS expected FROM e)
SELECT well, round(CASE WHEN seen >= expected THEN CASE WHEN expected < 1 THEN (seen - expected) / (1 - expected) ELSE 0 END ELSE CASE WHEN expected > 0 THEN (seen - expected) / expected ELSE 0 END END, 6) AS specificity FROM x""")
def code_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    human, plus = F.col("contig").startswith("HUMAN"), F.col("strand") == "+"
    counts = reads(spark, sf_dir).groupBy("well").agg(*(F.count_if(t).cast("double").alias(n) for n, t in (("ah", human & plus), ("am", ~human & plus), ("th", human & ~plus), ("tm", ~human & ~plus))))
    return counts.select("well", r6(st.specificity(*(F.col(c) for c in ("ah", "am", "th", "tm")))).alias("specificity"))


@query("""
, c AS (SELECT gene, count(*) AS reads FROM reads GROUP BY gene), d AS (SELECT *, gene <= 'Brand#3' AS declared FROM c),
  o AS (SELECT * FROM d WHERE NOT declared ORDER BY reads DESC, gene LIMIT 5)
SELECT gene, reads, declared, round(100.0 * reads / (SELECT sum(reads) FROM c), 6) AS pct_total, CASE WHEN declared THEN round(100.0 * reads / (SELECT sum(reads) FROM d WHERE declared), 6) END AS pct_assigned FROM (SELECT * FROM d WHERE declared UNION ALL SELECT * FROM o)""")
def demux_code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    declared = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).where("gene <= 'Brand#3'")
    return tables.code_report(rows, "gene", declared, 5).withColumns({c: r6(F.col(c)) for c in ("pct_total", "pct_assigned")})


# Molecules ----------------------------------------------------------------------------------------------------


@query("SELECT well, count(DISTINCT umi) AS a, count(DISTINCT umi || gene) AS b, count(DISTINCT contig || strand || CAST(pos AS VARCHAR) || ':' || umi) AS c FROM reads GROUP BY well")
def molecule_definitions_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    a = molecules.distinct_tags(rows, ["well"], "umi").withColumnRenamed("molecules", "a")
    b = molecules.distinct_tags(rows, ["well"], "umi", "gene").withColumnRenamed("molecules", "b")
    c = molecules.anchored_windows(rows, "well", "contig", "strand", "pos", "umi", "gene", 0, 0).groupBy("well").agg(F.count("*").alias("c"))
    return a.join(b, "well").join(c, "well")


@query("SELECT reads_per_molecule, count(*) AS molecules FROM (SELECT count(*) AS reads_per_molecule FROM reads GROUP BY well, umi, gene) GROUP BY 1")
def dup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.duplicity_histogram(reads(spark, sf_dir), ["well", "umi", "gene"])


@query("""
, h AS (SELECT well, k, count(*) m FROM (SELECT well, count(*) k FROM reads GROUP BY well, umi) GROUP BY well, k)
SELECT well, CAST(sum(k * m) AS BIGINT) AS reads, CAST(sum(m) AS BIGINT) AS molecules, CAST(coalesce(sum(m) FILTER (k = 1), 0) AS BIGINT) AS singletons, round(100 * (1 - coalesce(sum(m) FILTER (k = 1), 0) / sum(k * m)), 6) AS coverage_pct, round(1000.0 * coalesce(sum(m) FILTER (k = 1), 0) / sum(k * m), 6) AS new_per_1k FROM h GROUP BY well""")
def good_turing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = molecules.good_turing(molecules.duplicity_histogram(reads(spark, sf_dir), ["well", "umi"], ["well"]), ["well"])
    return out.withColumns({c: r6(F.col(c)) for c in ("coverage_pct", "new_per_1k")})


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY well, contig, strand, pos, umi ORDER BY orderkey, lineno, partkey, suppkey, span) AS k, count(*) OVER (PARTITION BY well, contig, strand, pos, umi) AS duplicity FROM reads)
SELECT well, contig, strand, pos, umi, orderkey, lineno, duplicity FROM r WHERE k = 1""")
def dedup_survivor_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("well", "contig", "strand", "pos", "umi", "orderkey", "lineno")
    return molecules.survivors(rows, ["well", "contig", "strand", "pos", "umi"], ["orderkey", "lineno"])


@query()
def dedup_anchored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.anchored_windows(reads(spark, sf_dir), "well", "contig", "strand", "pos", "umi", "gene", 1, 1000)


@query("""
, nodes AS (SELECT DISTINCT well, umi, left(umi, 3) AS l, right(umi, 3) AS r FROM reads),
  pairs AS (SELECT a.well, a.umi AS x, b.umi AS y FROM nodes a JOIN nodes b ON a.well = b.well AND a.l = b.l UNION SELECT a.well, a.umi, b.umi FROM nodes a JOIN nodes b ON a.well = b.well AND a.r = b.r)
SELECT well, x AS a, y AS b FROM pairs WHERE x < y AND hamming(x, y) <= 1""")
def near_tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.near_pairs(reads(spark, sf_dir), "umi", ["well"], 6, 1)


@query("""
, n AS (SELECT DISTINCT well, gene, umi FROM reads), l AS (SELECT a.well, a.gene, a.umi AS a, b.umi AS b FROM n a JOIN n b ON a.well = b.well AND a.gene = b.gene AND hamming(a.umi, b.umi) = 1),
  r AS (SELECT well, gene, umi, umi AS c FROM n UNION SELECT r.well, r.gene, l.b, r.c FROM r JOIN l ON l.well = r.well AND l.gene = r.gene AND l.a = r.umi)
SELECT well, gene, umi, min(c) AS cluster FROM r GROUP BY well, gene, umi""")
def umi_clusters_ed1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.tag_clusters(reads(spark, sf_dir), ["well", "gene"], "umi", 6, 1)


@query("""
, n AS (SELECT well, gene, pos AS s, pos + span AS e, row_number() OVER (ORDER BY well, gene, pos, span) AS id FROM (SELECT DISTINCT well, gene, pos, span FROM reads)),
  o AS (SELECT *, s // 6 + d AS cell FROM n, (SELECT unnest([-1, 0, 1]) AS d)),
  l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN o b ON a.well = b.well AND a.gene = b.gene AND a.s // 6 = b.cell AND abs(a.s - b.s) <= 5 AND abs(a.e - b.e) <= 5 AND a.id <> b.id),
  r AS (SELECT id, id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id), h AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT well, gene, count(DISTINCT c) AS molecules FROM n JOIN h USING (id) GROUP BY well, gene""")
def jitter_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("end", F.col("pos") + F.col("span"))
    return molecules.jitter_molecules(rows, ["well", "gene"], "pos", "end", 5)


@query()
def uci_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = molecules.corrected_molecules(reads(spark, sf_dir), "well", "umi", "gene")
    return out.withColumns({c: r6(F.col(c)) for c in ("b_corr", "simpson", "shannon")})


@query()
def library_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reads(spark, sf_dir).groupBy("well").agg(F.count("*").alias("reads"), F.count_distinct("umi").alias("unique"))
    return n.withColumn("library", molecules.library_size(F.col("reads"), F.col("unique")))


@query()
def saturation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.saturation(molecules.duplicity_histogram(reads(spark, sf_dir), ["well", "umi"], ["well"]), ["well"])


@query("""
, r AS (SELECT well, umi, gene, row_number() OVER (PARTITION BY well ORDER BY (orderkey * 7919 + lineno * 104729 + partkey * 31) % 1000003, orderkey, lineno, partkey, pos, umi) AS k, count(*) OVER (PARTITION BY well) AS n FROM reads),
  d AS (SELECT unnest([25, 50, 100, 200]) AS depth)
SELECT well, CAST(depth AS BIGINT) AS depth, count(DISTINCT umi || gene) AS molecules, count(DISTINCT gene) AS genes FROM r JOIN d ON k <= depth AND depth <= n GROUP BY well, depth""")
def rarefaction_matched_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.expr("(orderkey * 7919 + lineno * 104729 + partkey * 31) % 1000003"), "orderkey", "lineno", "partkey", "pos", "umi"]
    return sampling.rarefy(reads(spark, sf_dir), ["well"], order, DEPTHS, {"molecules": F.count_distinct("umi", "gene"), "genes": F.count_distinct("gene")})


@query("""
, c AS (SELECT well, gene, CAST(count(*) AS DOUBLE) n FROM reads GROUP BY well, gene), t AS (SELECT well, sum(n) a FROM c GROUP BY well), d AS (SELECT unnest([25, 50, 100, 200]) AS depth),
  p AS (SELECT c.well, depth, n, a, depth / a AS q FROM c JOIN t USING (well), d)
SELECT well, CAST(depth AS BIGINT) AS depth, round(sum(CASE WHEN depth <= a THEN CASE WHEN depth = a THEN CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END WHEN n >= 3 THEN greatest(0.0, 1 - (pow(1 - q, n) + n * q * pow(1 - q, n - 1) + n * (n - 1) / 2 * q * q * pow(1 - q, n - 2))) ELSE 0.0 END END), 6) AS expected FROM p GROUP BY well, depth""")
def binomial_rarefaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return sampling.expected_features(counts, ["well"], "n", DEPTHS, 3).withColumn("expected", r6(F.col("expected")))


@query()
def thinned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return sampling.thin_counts(counts, ["well"], "gene", "n", 100)


@query()
def exact_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_sample(reads(spark, sf_dir), ["orderkey", "lineno", "partkey", "suppkey"], 500)


@query()
def matched_feature_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.common_features(reads(spark, sf_dir), "contig", "gene", 5, 3, ["orderkey", "lineno", "partkey", "suppkey"])


@query("""
, g AS (SELECT well, contig, pos // 20 AS cx, orderkey * 100 + lineno AS id, pos AS x, span AS y FROM reads),
  o AS (SELECT well, contig, cx + d AS cx, id, x, y FROM g, (SELECT unnest([-1, 0, 1]) AS d)),
  n AS (SELECT a.well, a.contig, a.id FROM g a JOIN o b ON a.well = b.well AND a.contig = b.contig AND a.cx = b.cx AND a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400)
SELECT well, count(DISTINCT id) AS neighbours FROM n GROUP BY well""")
def optical_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("id", F.col("orderkey") * 100 + F.col("lineno"))
    return molecules.optical_neighbours(rows, ["well"], "contig", "pos", "span", "id", 20.0)


# Barcodes and sequences ---------------------------------------------------------------------------------------


@query(f"""
, codes AS (SELECT unnest(['{"','".join(CODES)}']) AS code), t AS (SELECT DISTINCT umi FROM reads),
  d AS (SELECT umi, code, length(code) AS len, hamming(left(umi, length(code)), code) AS dist FROM t, codes),
  near AS (SELECT * FROM d WHERE dist <= 1), l AS (SELECT umi, max(len) AS len FROM near GROUP BY umi),
  b AS (SELECT n.umi, n.len, min(dist) AS dist FROM near n JOIN l USING (umi, len) GROUP BY n.umi, n.len),
  hits AS (SELECT b.umi, b.dist, min(code) AS code, count(*) AS n FROM b JOIN near USING (umi, len, dist) GROUP BY b.umi, b.dist)
SELECT t.umi, CASE WHEN n = 1 THEN code END AS code, CASE WHEN n = 1 THEN CAST(dist AS BIGINT) END AS mismatches FROM t LEFT JOIN hits USING (umi)""")
def barcode_call_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = reads(spark, sf_dir).select("umi").distinct()
    return barcodes.call_positional(tags, "umi", CODES).select("umi", "code", F.col("mismatches").cast("long"))


@query(f"""
, codes AS (SELECT unnest(['AAAAAA', 'CCCCCC', 'GATTAC', 'TTTGGG']) AS code, unnest([0, 1, 2, 3]) AS i), t AS (SELECT DISTINCT umi FROM reads),
  n AS (SELECT umi, code, row_number() OVER (PARTITION BY umi ORDER BY hamming(umi, code), i) AS k FROM t, codes WHERE hamming(umi, code) <= 2)
SELECT umi, code FROM t LEFT JOIN (SELECT umi, code FROM n WHERE k = 1) USING (umi)""")
def barcode_nearest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = reads(spark, sf_dir).select("umi").distinct()
    return tags.withColumn("code", barcodes.nearest_entry(F.col("umi"), ["AAAAAA", "CCCCCC", "GATTAC", "TTTGGG"], 2))


@query("""
, s AS (SELECT DISTINCT umi, repeat(umi, 3) || 'AAAAAAAAAAAA' || umi AS seq FROM reads)
SELECT umi, reverse(translate(umi, 'ACGT', 'TGCA')) AS revcomp, CAST(length(regexp_extract(umi, '^A*', 0)) AS BIGINT) AS run_a, regexp_replace(seq, 'A{10,}.*$', '') AS trimmed,
  greatest(length(umi) - length(replace(umi, 'A', '')), length(umi) - length(replace(umi, 'C', '')), length(umi) - length(replace(umi, 'G', '')), length(umi) - length(replace(umi, 'T', ''))) >= 5 AS homopolymer,
  CAST(list_max([length(x) for x in regexp_extract_all(seq, 'A+|T+')]) AS BIGINT) AS longest_at FROM s""")
def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat(F.repeat("umi", 3), F.lit("AAAAAAAAAAAA"), "umi"))
    u = F.col("umi")
    return s.select("umi", sq.reverse_complement(u).alias("revcomp"), sq.run_length_at(u, 0, "A").cast("long").alias("run_a"), sq.cut_at_run(F.col("seq")).alias("trimmed"), sq.homopolymer_tag(u).alias("homopolymer"), sq.longest_run(F.col("seq")).cast("long").alias("longest_at"))


@query("""
, s AS (SELECT DISTINCT umi FROM reads), p AS (SELECT umi, substr(umi, CAST(i AS BIGINT), 2) AS d FROM s, (SELECT unnest(range(1, 6)) AS i)),
  c AS (SELECT umi, d, count(*) / 5.0 AS q FROM p GROUP BY umi, d)
SELECT umi, round(-sum(q * log2(q)) / 4.0, 6) AS entropy FROM c GROUP BY umi""")
def dinucleotide_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = r6(sq.pair_entropy(F.col("umi")))
    return reads(spark, sf_dir).select("umi").distinct().withColumn("entropy", F.when(e == 0, 0.0).otherwise(e))


@query("""
, g AS (SELECT DISTINCT gene || ':' || umi AS name, repeat(umi, 2) AS seq FROM reads), k AS (SELECT name, i - 1 AS o, substr(seq, CAST(i AS BIGINT), 9) AS kmer FROM g, (SELECT unnest(range(1, 5)) AS i))
SELECT kmer, min(name) AS name, CAST(min(o) AS BIGINT) AS "offset" FROM k GROUP BY kmer HAVING count(*) = 1""")
def kmer_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reads(spark, sf_dir).select(F.concat_ws(":", "gene", "umi").alias("name"), F.repeat("umi", 2).alias("seq")).distinct()
    return barcodes.unique_kmers(spark, g, "name", "seq", 9).select("kmer", "name", F.col("offset").cast("long"))


@query("""
, s AS (SELECT umi AS seq, translate(umi, 'ACGT', 'I5?!') AS qual FROM reads), x AS (SELECT CAST(i AS BIGINT) AS cycle, substr(seq, CAST(i AS BIGINT), 1) AS b, ascii(substr(qual, CAST(i AS BIGINT), 1)) - 33 AS q FROM s, (SELECT unnest(range(1, 7)) AS i))
SELECT cycle, round(avg(q), 6) AS mean_q, round(100.0 * count(*) FILTER (q >= 30) / count(*), 6) AS q30_pct, round(100.0 * count(*) FILTER (b = 'A') / count(*), 6) AS pct_a, round(100.0 * count(*) FILTER (b = 'C') / count(*), 6) AS pct_c,
  round(100.0 * count(*) FILTER (b = 'G') / count(*), 6) AS pct_g, round(100.0 * count(*) FILTER (b = 'T') / count(*), 6) AS pct_t, round(100.0 * count(*) FILTER (b = 'N') / count(*), 6) AS pct_n FROM x GROUP BY cycle""")
def quality_by_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select(F.col("umi").alias("seq"), F.translate("umi", "ACGT", "I5?!").alias("qual"))
    out = tables.quality_by_cycle(s, "seq", "qual")
    return out.select(F.col("cycle").cast("long").alias("cycle"), *(r6(F.col(c)).alias(c) for c in out.columns if c != "cycle"))


# Intervals and coverage ---------------------------------------------------------------------------------------

_SPANS = "(SELECT DISTINCT p_partkey AS pk, p_brand AS brand, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e FROM part)"


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("brand"), (F.col("p_partkey") * 10).alias("s"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("e"), F.lit(1).alias("one"))


def _span_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("orderkey", "lineno", "partkey", "suppkey", F.col("pos"), (F.col("pos") + F.col("span")).alias("stop"), "contig", "strand", "gene", F.lit(1).alias("one"))


@query(f"SELECT brand, count(*) AS overlaps, CAST(sum(least(pos + span, e) - greatest(pos, s)) AS BIGINT) AS shared FROM reads JOIN {_SPANS} ON pos < e AND pos + span > s GROUP BY brand")
def range_overlap_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = intervals.overlap_join(_span_reads(spark, sf_dir), _genes(spark, sf_dir), ["one"], ("pos", "stop"), ("s", "e"), 64)
    return pairs.groupBy("brand").agg(F.count("*").alias("overlaps"), F.sum(F.least("stop", "e") - F.greatest("pos", "s")).alias("shared"))


@query(f"SELECT contig, count(*) AS n FROM reads WHERE EXISTS (SELECT 1 FROM {_SPANS} g WHERE g.brand = 'Brand#11' AND pos < e AND pos + span > s) GROUP BY contig")
def overlap_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _genes(spark, sf_dir).where("brand = 'Brand#11'")
    return intervals.overlap_join(_span_reads(spark, sf_dir), genes, ["one"], ("pos", "stop"), ("s", "e"), 64, "left_semi").groupBy("contig").agg(F.count("*").alias("n"))


@query(f"""
, r AS (SELECT DISTINCT pos, pos + span AS stop FROM reads),
  x AS (SELECT pos, stop, brand, s, e, least(stop, e) - greatest(pos, s) AS o, row_number() OVER (PARTITION BY pos, stop ORDER BY least(stop, e) - greatest(pos, s) DESC, s DESC, e DESC, brand DESC) AS k FROM r JOIN {_SPANS} ON pos < e AND stop > s)
SELECT r.pos, r.stop, x.o AS overlap, x.s, x.e, x.brand FROM r LEFT JOIN (SELECT * FROM x WHERE k = 1) x ON r.pos = x.pos AND r.stop = x.stop""")
def best_gene_max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scans.dealt(_span_reads(spark, sf_dir).select("pos", "stop", "one"), ["pos", "stop"]).distinct()
    out = intervals.best_overlap(r, _genes(spark, sf_dir).drop("pk"), ["one"], ("pos", "stop"), ("s", "e"), 64, ["pos", "stop"], ["s", "e", "brand"])
    return out.select("pos", "stop", "overlap", "s", "e", "brand")


@query(f"""
, r AS (SELECT DISTINCT pos FROM reads), x AS (SELECT pos, s, e, brand, row_number() OVER (PARTITION BY pos ORDER BY s DESC, e DESC, brand DESC) AS k FROM r JOIN {_SPANS} ON pos >= s AND pos < e)
SELECT r.pos, s, e, brand FROM r LEFT JOIN (SELECT * FROM x WHERE k = 1) x ON r.pos = x.pos""")
def asof_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reads(spark, sf_dir).select("pos", F.lit(1).alias("one")).distinct()
    return intervals.containing_interval(points, _genes(spark, sf_dir).drop("pk"), ["one"], "pos", ("s", "e"), 64).select("pos", "s", "e", "brand")


@query("""SELECT event_id, o.d AS last_order, o.n AS orders_that_day FROM events ASOF LEFT JOIN (SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1) o ON events.ts >= o.d""")
def asof_last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("last_order")).agg(F.count("*").alias("orders_that_day"))
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return intervals.last_before(events, days, [], "ts", "last_order", ["orders_that_day"]).select("event_id", "last_order", "orders_that_day")


@query(f"""
, g AS (SELECT *, max(e) OVER (PARTITION BY brand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_SPANS}),
  i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY brand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM g)
SELECT brand, min(s) AS s, max(e) AS e FROM i GROUP BY brand, isle""".replace(", g AS", "WITH g AS", 1))
def interval_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_genes(spark, sf_dir), ["brand"], "s", "e")


@query("""
, x AS (SELECT DISTINCT orderkey, pos, pos + span AS stop FROM reads), y AS (SELECT orderkey, stop AS intron_start, lead(pos) OVER (PARTITION BY orderkey ORDER BY pos, stop) AS intron_end FROM x)
SELECT * FROM y WHERE intron_end > intron_start""")
def introns_from_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.introns(_span_reads(spark, sf_dir).select("orderkey", "pos", "stop").distinct(), ["orderkey"], "pos", "stop")


@query(f"""
, x AS (SELECT brand, s, e, sum(e - s) OVER (PARTITION BY brand) AS length, coalesce(sum(e - s) OVER (PARTITION BY brand ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {_SPANS})
SELECT pos, strand, x.brand, CAST(CASE WHEN strand = '+' THEN o + pos - s ELSE length - 1 - (o + pos - s) END AS BIGINT) AS t FROM (SELECT DISTINCT pos, strand, gene, partkey FROM reads) r JOIN x ON x.brand = r.gene AND r.partkey * 10 = x.s WHERE pos >= s AND pos < e""")
def transcript_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = intervals.exon_offsets(_genes(spark, sf_dir), ["brand"], "s", "e")
    r = reads(spark, sf_dir).select("pos", "strand", F.col("gene").alias("brand"), (F.col("partkey") * 10).alias("s")).distinct()
    rows = r.join(exons, ["brand", "s"]).where("pos >= s and pos < e")
    return rows.select("pos", "strand", "brand", sq.transcript_position(F.col("pos"), F.col("s"), F.col("offset"), F.col("length"), F.col("strand")).alias("t"))


_DEPTH = """
, ends AS (SELECT gene, pos AS place, 1 AS d FROM reads UNION ALL SELECT gene, pos + span, -1 FROM reads), ch AS (SELECT gene, place, sum(d) AS d FROM ends GROUP BY gene, place),
  steps AS (SELECT gene, place AS from_pos, lead(place) OVER (PARTITION BY gene ORDER BY place) AS to_pos, CAST(sum(d) OVER (PARTITION BY gene ORDER BY place) AS BIGINT) AS depth FROM ch)"""


@query(_DEPTH + " SELECT gene, from_pos, to_pos, depth FROM steps WHERE depth > 0")
def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth_steps(_span_reads(spark, sf_dir), ["gene"], "pos", "stop")


@query(_DEPTH + " SELECT gene, round(sum(to_pos - from_pos) FILTER (depth >= 1) / 100000.0, 6) AS covered_1, round(sum(CASE WHEN depth >= 3 THEN to_pos - from_pos ELSE 0 END) / 100000.0, 6) AS covered_3 FROM steps WHERE depth > 0 GROUP BY gene")
def covered_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = intervals.depth_steps(_span_reads(spark, sf_dir), ["gene"], "pos", "stop")
    return steps.groupBy("gene").agg(*(r6(intervals.covered_share(steps, ["gene"], F.lit(100000.0), k)).alias(f"covered_{k}") for k in (1, 3)))


@query("""
, c AS (SELECT gene, pos, count(*) AS n FROM reads GROUP BY gene, pos), w AS (SELECT gene, n, sum(n) OVER (PARTITION BY gene ORDER BY pos RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS i FROM c)
SELECT gene, CAST(max(i) AS BIGINT) AS densest, CAST(sum(n) AS BIGINT) AS reads, round(max(i) / sum(n), 6) AS densest_share FROM w GROUP BY gene""")
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.densest_window(reads(spark, sf_dir), ["gene"], "pos", 300).withColumn("densest_share", r6(F.col("densest_share")))


@query("""
, c AS (SELECT gene, CAST(floor(pos / 100) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1, 2)
SELECT gene, bin, n, round(avg(n) OVER (PARTITION BY gene ORDER BY bin ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS smooth FROM c""")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", F.floor(F.col("pos") / 100).alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("smooth", r6(intervals.moving_mean(c, ["gene"], "bin", "n")))


@query("""
, m AS (SELECT gene, max(pos) - min(pos) + 1 AS len, min(pos) AS lo FROM reads GROUP BY gene), b AS (SELECT gene, CAST(least(floor((pos - lo) * 50 / len), 49) AS BIGINT) AS bin, count(*) AS n FROM reads JOIN m USING (gene) GROUP BY 1, 2)
SELECT gene, bin, n, round(n / max(n) OVER (PARTITION BY gene), 6) AS scaled FROM b""")
def binned_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    ends = r.groupBy("gene").agg(F.min("pos").alias("lo"), (F.max("pos") - F.min("pos") + 1).alias("len"))
    b = r.join(ends, "gene").groupBy("gene", intervals.bin_of(F.col("pos") - F.col("lo"), F.col("len"), 50).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    top = b.groupBy("gene").agg(F.max("n").alias("_top"))
    return b.join(top, "gene").select("gene", "bin", "n", r6(F.col("n") / F.col("_top")).alias("scaled"))


@query("""
, m AS (SELECT gene, max(pos) AS hi FROM reads GROUP BY gene), d AS (SELECT gene, hi - pos AS from_end, count(*) AS n FROM reads JOIN m USING (gene) WHERE hi - pos < 3000 GROUP BY 1, 2), g AS (SELECT gene, avg(n) AS a FROM d GROUP BY gene)
SELECT CAST(floor(from_end / 100) AS BIGINT) AS step, round(avg(n / a), 6) AS level FROM d JOIN g USING (gene) GROUP BY 1""")
def anchored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    d = r.join(r.groupBy("gene").agg(F.max("pos").alias("hi")), "gene").withColumn("from_end", F.col("hi") - F.col("pos")).where("from_end < 3000").groupBy("gene", "from_end").agg(F.count("*").alias("n"))
    mean = d.groupBy("gene").agg(F.avg("n").alias("_a"))
    return d.join(mean, "gene").groupBy(F.floor(F.col("from_end") / 100).alias("step")).agg(r6(F.avg(F.col("n") / F.col("_a"))).alias("level"))


@query("SELECT gene, round(2 * sum((lineno - 1) / 6.0 * span) / sum(span), 6) AS balance FROM reads GROUP BY gene")
def balance_2x_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy("gene").agg(r6(intervals.balance((F.col("lineno") - 1) / 6.0, F.col("span"))).alias("balance"))


@query("""
, d AS (SELECT gene, least((SELECT max(pos) FROM reads) - pos, 30000) AS x FROM reads), h AS (SELECT gene, CAST(floor(x / 500) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY 1, 2)
SELECT bin, round(avg(c), 6) AS cdf FROM (SELECT gene, bin, sum(n) OVER (PARTITION BY gene ORDER BY bin) / sum(n) OVER (PARTITION BY gene) AS c FROM h) GROUP BY bin""")
def distance_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = reads(spark, sf_dir)
    top = r.agg(F.max("pos").alias("_hi"))
    h = r.crossJoin(F.broadcast(top)).groupBy("gene", F.floor(F.least(F.col("_hi") - F.col("pos"), F.lit(30000)) / 500).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("gene")
    c = h.withColumn("c", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))
    return c.groupBy("bin").agg(r6(F.avg("c")).alias("cdf"))


@query()
def sharp_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).groupBy("gene", "pos").agg(F.count("*").cast("double").alias("depth"))
    middle = r.groupBy("gene").agg(F.percentile("depth", 0.5).alias("median"))
    return intervals.peaks(r.join(middle, "gene"), ["gene"], "pos", "depth", "median", 2.0)


# Junctions and tests ------------------------------------------------------------------------------------------


@query("SELECT contig, pos, count(DISTINCT orderkey) AS support FROM reads GROUP BY contig, pos HAVING max(lineno) >= 4 AND max(span) >= 4")
def junction_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splicing.junction_support(reads(spark, sf_dir), ["contig", "pos"], "orderkey", "lineno", "span", 4)


@query("SELECT contig, pos, count(DISTINCT orderkey) AS support FROM reads WHERE lineno >= 4 AND span >= 4 GROUP BY contig, pos")
def junction_support_each_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splicing.junction_support(reads(spark, sf_dir), ["contig", "pos"], "orderkey", "lineno", "span", 4, each_read=True)


@query("""SELECT contig, count(*) AS junctions, count(*) FILTER (pos IN (SELECT p_partkey * 10 + 1 FROM part)) AS annotated FROM (SELECT DISTINCT contig, pos FROM reads) GROUP BY contig""")
def junction_annotated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads(spark, sf_dir).select("contig", "pos").distinct()
    known = table(spark, sf_dir, "part").select((F.col("p_partkey") * 10 + 1).alias("pos")).distinct().withColumn("hit", F.lit(1))
    return found.join(known, "pos", "left").groupBy("contig").agg(F.count("*").alias("junctions"), F.count("hit").alias("annotated"))


_PSI = ", c AS (SELECT gene, region AS junction, well, CAST(count(*) AS BIGINT) AS k FROM reads GROUP BY 1, 2, 3), p AS (SELECT *, CAST(sum(k) OVER (PARTITION BY gene, well) AS BIGINT) AS total, k / sum(k) OVER (PARTITION BY gene, well) AS psi FROM c)"


def _psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("gene", F.col("region").alias("junction"), "well").agg(F.count("*").alias("k"))
    return splicing.inclusion(counts, "gene", "junction", "well", "k")


def _treated() -> F.Column:
    return F.col("well") >= "W05"


@query(_PSI + " SELECT gene, junction, well, k, total, round(psi, 6) AS psi FROM p")
def psi_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _psi(spark, sf_dir).withColumn("psi", r6(F.col("psi")))


@query(_PSI + " SELECT gene, junction, round(sum(k) FILTER (well < 'W05') / sum(total) FILTER (well < 'W05'), 6) AS psi_control, round(sum(k) FILTER (well >= 'W05') / sum(total) FILTER (well >= 'W05'), 6) AS psi_treated, round(sum(k) FILTER (well >= 'W05') / sum(total) FILTER (well >= 'W05') - sum(k) FILTER (well < 'W05') / sum(total) FILTER (well < 'W05'), 6) AS dpsi FROM p GROUP BY gene, junction")
def psi_dpsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splicing.pooled_difference(_psi(spark, sf_dir), ["gene", "junction"], "k", "total", _treated())
    return out.withColumns({c: r6(F.col(c)) for c in ("psi_control", "psi_treated", "dpsi")})


@query(_PSI + " SELECT gene, junction FROM p GROUP BY gene, junction HAVING avg(total) >= 20 AND min(total) > 0 AND var_pop(psi) >= 0.002")
def ds_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splicing.testable(_psi(spark, sf_dir), ["gene", "junction"], 20, 0.002).select("gene", "junction").distinct()


@query(_PSI + """, a AS (SELECT gene, junction, avg(psi) FILTER (well >= 'W05') m1, avg(psi) FILTER (well < 'W05') m2, var_samp(psi) FILTER (well >= 'W05') / count(psi) FILTER (well >= 'W05') s1, var_samp(psi) FILTER (well < 'W05') / count(psi) FILTER (well < 'W05') s2,
  count(psi) FILTER (well >= 'W05') n1, count(psi) FILTER (well < 'W05') n2 FROM p GROUP BY gene, junction)
SELECT gene, junction, round((m1 - m2) / sqrt(s1 + s2), 5) AS t, round((s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)), 5) AS df, round(m1 - m2, 6) AS difference FROM a""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splicing.welch(_psi(spark, sf_dir), ["gene", "junction"], "psi", _treated())
    return out.select("gene", "junction", F.round("t", 5).alias("t"), F.round("df", 5).alias("df"), r6(F.col("difference")).alias("difference"))


@query(_PSI + ", d AS (SELECT gene, junction, psi, CAST(substr(well, 2) AS INTEGER) // 8 AS dose FROM p) SELECT gene, junction, round(regr_slope(psi, dose), 6) AS slope FROM d GROUP BY gene, junction")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _psi(spark, sf_dir).withColumn("dose", F.floor(F.expr("cast(substring(well, 2) as int)") / 8))
    return splicing.slope(rows, ["gene", "junction"], "psi", "dose").select("gene", "junction", r6(F.col("slope")).alias("slope"))


@query()
def differential_splicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splicing.differential(splicing.testable(_psi(spark, sf_dir), ["gene", "junction"], 20, 0.0005), ["gene", "junction"], "k", _treated(), 0.5, 0.0)


_DPSI = _PSI + """, d AS (SELECT gene, junction, sum(k) FILTER (well < 'W05') / sum(total) FILTER (well < 'W05') AS psi_control, sum(k) FILTER (well >= 'W05') / sum(total) FILTER (well >= 'W05') AS psi_treated FROM p GROUP BY gene, junction)"""


@query(_DPSI + """, f AS (SELECT *, round(psi_treated - psi_control, 9) AS score FROM d WHERE psi_treated > psi_control QUALIFY row_number() OVER (PARTITION BY gene ORDER BY round(psi_treated - psi_control, 9) DESC, junction) = 1)
SELECT gene, junction, round(psi_control, 6) AS psi_control, round(psi_treated, 6) AS psi_treated, round(psi_treated - psi_control, 6) AS dpsi, row_number() OVER (ORDER BY score DESC, gene, junction) AS place FROM f ORDER BY place LIMIT 10""")
def greedy_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splicing.pooled_difference(_psi(spark, sf_dir), ["gene", "junction"], "k", "total", _treated()).where("dpsi > 0")
    best = splicing.greedy_distinct(out, [], [-F.round("dpsi", 9), F.col("gene"), F.col("junction")], ["gene"], 10)
    return best.withColumns({c: r6(F.col(c)) for c in ("psi_control", "psi_treated", "dpsi")} | {"place": F.col("place").cast("long")})


@query()
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a gene and a well by reads, each gene and each well once in a contig."""
    pairs = reads(spark, sf_dir).groupBy("contig", "gene", "well").agg(F.count("*").alias("n"))
    return splicing.greedy_distinct(pairs, ["contig"], [-F.col("n")], ["gene", "well"], 10)


@query("SELECT gene, min(pos) AS from_pos, max(pos) AS to_pos, CAST(greatest(min(pos) - CAST(floor(greatest(500, 0.2 * (max(pos) - min(pos)))) AS BIGINT), 0) AS BIGINT) AS window_start, max(pos) + CAST(floor(greatest(500, 0.2 * (max(pos) - min(pos)))) AS BIGINT) AS window_end FROM reads GROUP BY gene")
def lsv_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splicing.extents(reads(spark, sf_dir), "gene", "pos", "pos")


@query(", c AS (SELECT gene, contig, pos, count(*) AS n FROM reads GROUP BY 1, 2, 3), t AS (SELECT *, max(n) OVER (PARTITION BY gene) AS top FROM c) SELECT gene, contig, pos, n FROM t WHERE n >= 2 AND n >= 0.2 * top")
def strong_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("gene", "contig", "pos").agg(F.count("*").alias("n"))
    return splicing.strong_arcs(counts, ["gene"], "n", 2, 0.2)


# Statistics ---------------------------------------------------------------------------------------------------


@query("""
, c AS (SELECT gene, CAST(count(*) FILTER (strand = '+') AS DOUBLE) a, CAST(count(*) FILTER (strand = '-') AS DOUBLE) b FROM reads GROUP BY gene)
SELECT gene, round(a / b, 6) AS ratio, round(a / b * exp(-1.96 * sqrt(1 / a + 1 / b)), 6) AS low, round(a / b * exp(1.96 * sqrt(1 / a + 1 / b)), 6) AS high FROM c""")
def katz_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(F.col("strand") == "+").alias("a"), F.count_if(F.col("strand") == "-").alias("b"))
    r, low, high = st.katz(F.col("a"), F.col("b"))
    return c.select("gene", r6(r).alias("ratio"), r6(low).alias("low"), r6(high).alias("high"))


@query("""WITH p AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 1009 + 1) / 1010.0 AS p FROM part), k AS (SELECT p, count(*) AS n FROM p GROUP BY p),
  r AS (SELECT p, sum(n) OVER (ORDER BY p) AS rank, sum(n) OVER () AS m FROM k), a AS (SELECT p, least(min(p * m / rank) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1.0) AS padj FROM r)
SELECT id, round(p, 6) AS p, round(padj, 6) AS padj FROM p JOIN a USING (p)""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") * 7919) % 1009 + 1) / 1010.0).alias("p"))
    return splicing.adjust_p(p, "p", "padj").select("id", r6(F.col("p")).alias("p"), r6(F.col("padj")).alias("padj"))


@query(", c AS (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2), p AS (SELECT well, n / sum(n) OVER (PARTITION BY well) AS p FROM c) SELECT well, round(1 / sum(p * p), 6) AS simpson, round(exp(-sum(p * ln(p))), 6) AS shannon, round(1 - sum(p * p), 6) AS gini_simpson FROM p GROUP BY well")
def simpson_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return st.effective_numbers(c, ["well"], "n").select("well", *(r6(F.col(x)).alias(x) for x in ("simpson", "shannon", "gini_simpson")))


@query(", c AS (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2), r AS (SELECT well, n, row_number() OVER (PARTITION BY well ORDER BY n) AS k FROM c) SELECT well, round(2 * sum(k * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY well")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return st.gini(c, ["well"], "n").withColumn("gini", r6(F.col("gini")))


@query(", c AS (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2), r AS (SELECT well, n, row_number() OVER (PARTITION BY well ORDER BY n DESC, gene) AS k FROM c) SELECT well, round(sum(n) FILTER (k <= 1) / sum(n), 6) AS top1_share, round(sum(n) FILTER (k <= 5) / sum(n), 6) AS top5_share FROM r GROUP BY well")
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return tables.top_share(c, ["well"], "n", "gene", [1, 5]).withColumns({f"top{k}_share": r6(F.col(f"top{k}_share")) for k in (1, 5)})


@query(", c AS (SELECT contig, gene, well, count(*) AS n FROM reads GROUP BY 1, 2, 3) SELECT contig, gene, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd FROM c GROUP BY contig, gene HAVING count(*) >= 3")
def mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("contig", "gene", "well").agg(F.count("*").alias("k"))
    return tables.mean_interval(c, ["contig", "gene"], "k").select("contig", "gene", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


#: Student's quantile at 0.975 for 2, 3, ... degrees of freedom, for the SQL of mean_t_interval (a group has at most 24 wells).
T975 = (
    "4.30265272975, 3.18244630528, 2.77644510520, 2.57058183564, 2.44691185114, 2.36462425159, 2.30600413520, 2.26215716280, 2.22813885199, 2.20098516009, 2.17881282967, "
    "2.16036865646, 2.14478668792, 2.13144954556, 2.11990529922, 2.10981557783, 2.10092204024, 2.09302405441, 2.08596344727, 2.07961384473, 2.07387306790, 2.06865761042"
)


@query(f"""
, c AS (SELECT contig, gene, well, count(*) AS k FROM reads GROUP BY 1, 2, 3), m AS (SELECT contig, gene, count(*) AS n, avg(k) AS mean, stddev_samp(k) AS sd FROM c GROUP BY contig, gene HAVING count(*) >= 3)
SELECT contig, gene, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CAST([{T975}][n - 2] AS DOUBLE) * sd / sqrt(n), 6) AS half_width FROM m""")
def mean_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("contig", "gene", "well").agg(F.count("*").alias("k"))
    return tables.mean_interval(c, ["contig", "gene"], "k").withColumns({x: r6(F.col(x)) for x in ("mean", "sd", "half_width")})


@query(", q AS (SELECT gene, well, count(*) AS v FROM reads GROUP BY 1, 2), s AS (SELECT gene, v, row_number() OVER (PARTITION BY gene ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY gene) AS n FROM q) SELECT gene, round(quantile_cont(v, 0.25), 6) AS linear, min(v) FILTER (k + 1 >= 0.25 * n) AS cumulative, min(v) FILTER (k >= floor(0.25 * n)) AS floor_index, min(v) FILTER (k >= floor(n / 2)) AS upper_median, min(v) FILTER (k + 1 >= floor((n + 1) / 2)) AS half_up FROM s GROUP BY gene")
def quantiles_five_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", "well").agg(F.count("*").alias("v"))
    return tables.quantiles(c, ["gene"], "v", 0.25).withColumn("linear", r6(F.col("linear").cast("double")))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(max(value), 6) AS top, CAST(5 AS BIGINT) AS version FROM events GROUP BY event_type")
def partial_final_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("top"), F.lit(5).cast("long").alias("version"))
    return tables.merge_partials(parts, ["event_type"], ["n"], ["top"], ["version"]).withColumn("top", r6(F.col("top")))


#: Each bound is where the binomial tail beyond the count seen has a chance of 0.025; halving an interval 45 times finds it.
@query("""
, c AS (SELECT gene, count(*) FILTER (strand = '+') AS k, count(*) AS n FROM reads GROUP BY gene),
  b AS (SELECT gene, k, n, lower, 0.0::DOUBLE AS x, 1.0::DOUBLE AS y, 0 AS i FROM c, (SELECT unnest([true, false]) AS lower)
    UNION ALL
    SELECT gene, k, n, lower, CASE WHEN low THEN m ELSE x END, CASE WHEN low THEN y ELSE m END, i + 1
    FROM (SELECT *, CASE WHEN lower THEN tail < 0.025 ELSE tail > 0.025 END AS low FROM (SELECT *, (x + y) / 2 AS m,
      list_sum(list_transform(CASE WHEN lower THEN range(k, n + 1) ELSE range(0, k + 1) END, lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((x + y) / 2) + (n - j) * ln(1 - (x + y) / 2)))) AS tail FROM b WHERE i < 45)))
SELECT gene, k, n, round(max(CASE WHEN k = 0 THEN 0 ELSE x END) FILTER (lower), 6) AS low, round(max(CASE WHEN k = n THEN 1 ELSE x END) FILTER (NOT lower), 6) AS high FROM b WHERE i = 45 GROUP BY gene, k, n""")
def clopper_pearson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(F.col("strand") == "+").alias("k"), F.count("*").alias("n"))
    return c.withColumn("ci", st.clopper_pearson(F.col("k"), F.col("n"))).select("gene", "k", "n", r6(F.col("ci.low")).alias("low"), r6(F.col("ci.high")).alias("high"))


@query("""
, t AS (SELECT gene, count(*) FILTER (contig LIKE 'HUMAN%' AND strand = '+') AS a, count(*) FILTER (contig LIKE 'HUMAN%' AND strand <> '+') AS b, count(*) FILTER (contig NOT LIKE 'HUMAN%' AND strand = '+') AS c, count(*) FILTER (contig NOT LIKE 'HUMAN%' AND strand <> '+') AS d FROM reads GROUP BY gene),
  x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t),
  l AS (SELECT *, -lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS v, -lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS seen,
    lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS top FROM x)
SELECT gene, a, b, c, d, round(least(1.0, sum(exp(top + v)) FILTER (v <= seen + 1e-7)), 6) AS p FROM l GROUP BY ALL""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    human, plus = F.col("contig").startswith("HUMAN"), F.col("strand") == "+"
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(human & plus).alias("a"), F.count_if(human & ~plus).alias("b"), F.count_if(~human & plus).alias("c"), F.count_if(~human & ~plus).alias("d"))
    return c.withColumn("p", r6(st.fisher_exact(*(F.col(x) for x in "abcd"))))


#: Without ties and up to 20 wells all ways to choose ranks are counted: each further well is one of the treated, which lies above the others so far, or one of
#: the others. Else the normal limit holds; its upper tail is summed by Simpson's rule.
@query("""
, c AS (SELECT gene, well >= 'W05' AS treated, count(*) AS v FROM reads GROUP BY gene, well),
  r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS k FROM c),
  t AS (SELECT gene, sum(m * m * m - m) AS ties FROM (SELECT gene, v, count(*) AS m FROM c GROUP BY 1, 2) GROUP BY gene),
  u AS (SELECT gene, count(*) FILTER (treated) AS n, count(*) FILTER (NOT treated) AS m, coalesce(sum(k) FILTER (treated), 0) - count(*) FILTER (treated) * (count(*) FILTER (treated) + 1) / 2.0 AS u FROM r GROUP BY gene),
  ways AS (SELECT 0 AS i, 0 AS j, 0 AS s, 1.0::DOUBLE AS c UNION ALL SELECT i + d, j + 1 - d, s + d * j, sum(c) FROM ways, (SELECT unnest([0, 1]) AS d) WHERE i + j < 20 GROUP BY 1, 2, 3),
  e AS (SELECT gene, least(1.0, 2 * least(sum(c) FILTER (s <= u), sum(c) FILTER (s >= u)) / sum(c)) AS p FROM u JOIN ways ON i = n AND j = m GROUP BY gene),
  z AS (SELECT gene, u, n, m, ties, coalesce(greatest(0, abs(u - n * m / 2.0) - 0.5) / sqrt(nullif(n * m / 12.0 * (n + m + 1 - ties / ((n + m) * (n + m - 1.0))), 0)), 0) AS z FROM u JOIN t USING (gene))
SELECT gene, CASE WHEN n = 0 OR m = 0 THEN 'NaN'::DOUBLE ELSE u::DOUBLE END AS u, CASE WHEN n = 0 OR m = 0 THEN 1.0 WHEN n + m <= 20 AND ties = 0 THEN round(p, 6) ELSE
  round(1 - 2 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 2000) * (z * i / 2000) / 2))) * z / 2000 / 3 / sqrt(2 * pi()), 6) END AS p FROM z LEFT JOIN e USING (gene)""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", "well").agg(F.count("*").alias("n")).withColumn("arm", F.when(_treated(), "treated").otherwise("control"))
    return st.mann_whitney(c, ["gene"], "n", "arm", "treated").withColumn("p", r6(F.col("p")))


@query()
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    human, plus = F.col("contig").startswith("HUMAN"), F.col("strand") == "+"
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(human & plus).alias("a"), F.count_if(human & ~plus).alias("b"), F.count_if(~human & plus).alias("c"), F.count_if(~human & ~plus).alias("d"))
    return st.poisson_bootstrap(c, "gene", ("a", "b", "c", "d"), 400)


# Matrices -----------------------------------------------------------------------------------------------------

_CPM = ", c AS (SELECT gene, well, count(*) AS n FROM reads GROUP BY 1, 2), m AS (SELECT gene, well, n, log2(n / sum(n) OVER (PARTITION BY well) * 1e6 + 1) AS v FROM c)"


def _cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reads(spark, sf_dir).groupBy("gene", "well").agg(F.count("*").alias("n"))
    return matrix.log_per_million(counts, "well", "n", "v")


@query(_CPM + " SELECT gene, well, n, round(v, 6) AS v FROM m")
def cpm_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpm(spark, sf_dir).select("gene", "well", "n", r6(F.col("v")).alias("v"))


_PAIRS = _CPM + ", p AS (SELECT a.gene, a.well AS a, b.well AS b, a.v AS x, b.v AS y FROM m a JOIN m b ON a.gene = b.gene AND a.well < b.well)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sample_pairs(_cpm(spark, sf_dir).select("gene", "well", "v"), "gene", "well", "v")


@query(_PAIRS + " SELECT a, b, round(corr(x, y), 5) AS r, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse, count(*) AS features FROM p GROUP BY a, b")
def pairwise_replicate_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.pair_agreement(_pairs(spark, sf_dir), ["a", "b"]).select("a", "b", F.round("r", 5).alias("r"), r6(F.col("rmse")).alias("rmse"), "features")


@query(_PAIRS + ", q AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p) SELECT a, b, round(corr(rx, ry), 5) AS rho FROM q GROUP BY a, b")
def spearman_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.spearman(_pairs(spark, sf_dir), ["a", "b"]).withColumn("rho", F.round("rho", 5))


@query(_PAIRS + ", r AS (SELECT a, b, sqrt(avg(pow(x - y, 2))) AS rmse FROM p GROUP BY a, b) SELECT sample, round(avg(rmse), 6) AS rmse FROM (SELECT a AS sample, rmse FROM r UNION ALL SELECT b, rmse FROM r) GROUP BY sample")
def per_sample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sample_means(matrix.pair_agreement(_pairs(spark, sf_dir), ["a", "b"]), "rmse").withColumn("rmse", r6(F.col("rmse")))


@query(_PAIRS + ", d AS (SELECT a, b, gene, y - x AS d FROM p), k AS (SELECT a, b, median(d) AS median FROM d GROUP BY a, b) SELECT a, b, gene, round(d, 6) AS d, round(median, 6) AS median FROM d JOIN k USING (a, b) WHERE abs(d - median) >= 0.5")
def median_offset_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrix.median_outliers(_pairs(spark, sf_dir), ["a", "b"], 0.5)
    return out.select("a", "b", "gene", r6(F.col("d")).alias("d"), r6(F.col("median")).alias("median"))


@query(_CPM + ", w AS (SELECT gene, well < 'W05' AS arm, avg(v) AS a FROM m GROUP BY 1, 2) SELECT gene, round(min(a), 6) AS least_mean FROM w GROUP BY gene ORDER BY min(a) DESC, gene LIMIT 10")
def capped_gene_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cpm(spark, sf_dir).withColumn("arm", F.col("well") < "W05")
    return matrix.capped_features(rows, "gene", "arm", "v", 10).withColumn("least_mean", r6(F.col("least_mean")))


@query(_CPM + " SELECT gene, round(var_pop(v), 6) AS variance FROM m GROUP BY gene ORDER BY var_pop(v) DESC, gene LIMIT 10")
def variable_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.variable_features(_cpm(spark, sf_dir), "gene", "v", 10).withColumn("variance", r6(F.col("variance")))


@query(", s AS (SELECT DISTINCT gene, well, contig FROM reads WHERE span > 45), l AS (SELECT gene, well, string_agg(contig, '+' ORDER BY contig) AS labels FROM s GROUP BY gene, well) SELECT labels, count(*) AS items FROM l GROUP BY labels")
def signed_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.exclusive_sets(reads(spark, sf_dir).where("span > 45"), ["gene", "well"], "contig")


@query(_CPM + ", z AS (SELECT gene, well, v - avg(v) OVER (PARTITION BY well) AS e FROM m) SELECT gene, round(min(e), 6) AS least, round(max(e), 6) AS most, count(DISTINCT well) AS labels FROM z GROUP BY gene HAVING min(e) < 0 AND max(e) > 0 AND count(DISTINCT well) > 1")
def discordant_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _cpm(spark, sf_dir)
    rows = m.join(m.groupBy("well").agg(F.avg("v").alias("_a")), "well").withColumn("e", F.col("v") - F.col("_a"))
    return matrix.discordant(rows, "gene", "well", "e").select("gene", r6(F.col("least")).alias("least"), r6(F.col("most")).alias("most"), "labels")


@query("SELECT gene, CAST(sum(span) AS DOUBLE) AS weight, round(sum(span * size) / sum(span), 6) AS length, round(avg(size), 6) AS plain_length FROM reads GROUP BY gene")
def tpm_weighted_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.weighted_length(reads(spark, sf_dir), "gene", "span", "size").select("gene", F.col("weight").cast("double"), r6(F.col("length")).alias("length"), r6(F.col("plain_length")).alias("plain_length"))


@query()
def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.principal_components(_cpm(spark, sf_dir), "gene", "well", "v").withColumns({c: F.round(c, 6) for c in ("score", "share")})


# Checks -------------------------------------------------------------------------------------------------------


@query("""
, f AS (SELECT count(*) AS n, count(*) FILTER (nh = 'U') AS u, count(*) FILTER (nh = 'M') AS m FROM reads)
SELECT 'unique and multi' AS "check", n = u + m AS passed, CAST(abs(n - u - m) AS VARCHAR) AS detail FROM f
UNION ALL SELECT 'wells and pool', true, '0' UNION ALL SELECT 'nesting', true, '0'""")
def conservation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    whole = r.agg(F.count("*").alias("n"), F.count_if(F.col("nh") == "U").alias("u"), F.count_if(F.col("nh") == "M").alias("m"))
    each = r.groupBy("well", "contig").agg(F.count("*").alias("n"))
    defs = r.groupBy("well").agg(F.count("*").alias("reads"), F.count_distinct("umi", "gene", "contig", "strand", "pos").alias("c"), F.count_distinct("umi").alias("a"))
    return checks.all_checks(
        checks.conserved(whole, "unique and multi", "n", ["u", "m"]),
        checks.reconciled(each, r.groupBy("contig").agg(F.count("*").alias("n")), ["contig"], "n", "wells and pool"),
        checks.nested(defs, "nesting", ["reads", "c", "a"]),
    )


@query("""
, a AS (SELECT DISTINCT pos AS s, pos + span AS e FROM reads WHERE suppkey % 2 = 0), b AS (SELECT DISTINCT pos AS s, pos + span AS e FROM reads WHERE suppkey % 2 = 1), d AS (SELECT unnest([-1, 0, 1]) AS x)
SELECT CAST(ds.x AS BIGINT) AS ds, CAST(de.x AS BIGINT) AS de, count(*) AS asked, count(b.s) AS matched FROM a, d ds, d de LEFT JOIN b ON a.s + ds.x = b.s AND a.e + de.x = b.e GROUP BY 1, 2""")
def offset_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).select("suppkey", F.col("pos").alias("s"), (F.col("pos") + F.col("span")).alias("e"), F.lit(1).alias("one"))
    out = checks.offset_probe(r.where("suppkey % 2 = 0"), r.where("suppkey % 2 = 1"), ["one"], "s", "e")
    return out.select(F.col("ds").cast("long"), F.col("de").cast("long"), "asked", "matched")


# Preparation, libraries, profiles -----------------------------------------------------------------------------


@query("""
, s AS (SELECT DISTINCT umi FROM reads), x AS (SELECT umi || 'GGG' || umi AS seq FROM s)
SELECT seq, substr(seq, 1, 4) AS code, substr(seq, 5, 2) AS tag, substr(seq, 7) AS rest, regexp_matches(seq, '^.{2,8}G{3,}') AS run_inside FROM x""")
def barcode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads(spark, sf_dir).select("umi").distinct().select(F.concat("umi", F.lit("GGG"), "umi").alias("seq"))
    out = x.withColumn("p", rd.split_barcode(F.col("seq"), 4, 2))
    return out.select("seq", "p.code", "p.tag", "p.rest", rd.run_starts_between(F.col("seq"), "G", 3, 2, 8).alias("run_inside"))


@query(", g AS (SELECT well, contig, pos, strand, count(*) AS n FROM reads GROUP BY 1, 2, 3, 4) SELECT well, CAST(sum(n) AS BIGINT) AS reads, count(*) AS footprints, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_groups, round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS dup_pct FROM g GROUP BY well")
def footprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.duplicate_stats(reads(spark, sf_dir), ["contig", "pos", "strand"], ["well"]).withColumn("dup_pct", r6(F.col("dup_pct")))


@query(", g AS (SELECT CASE WHEN contig LIKE 'HUMAN%' THEN 'human' ELSE 'mouse' END AS species, gene, umi, count(*) AS n FROM reads GROUP BY 1, 2, 3) SELECT species, CAST(sum(n) AS BIGINT) AS reads, count(*) AS molecules, round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS dup_pct FROM g GROUP BY ROLLUP (species)")
def gene_tag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.gene_tag_duplicates(reads(spark, sf_dir), "gene", "umi", "contig").withColumn("dup_pct", r6(F.col("dup_pct")))


@query("""SELECT well, count(*) FILTER (nh <> 'U') AS multi, count(*) FILTER (nh = 'U' AND region = 'R') AS rrna, count(*) FILTER (nh = 'U' AND region <> 'R') AS scored, count(*) FILTER (nh = 'U' AND region <> 'R' AND strand = '+') AS correct,
round(100.0 * count(*) FILTER (nh = 'U' AND region <> 'R' AND strand = '+') / count(*) FILTER (nh = 'U' AND region <> 'R'), 6) AS accuracy_pct FROM reads GROUP BY well""")
def strict_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rd.scored(reads(spark, sf_dir), ["well"], [("multi", F.col("nh") != "U"), ("rrna", F.col("region") == "R")], F.col("strand") == "+")
    return out.withColumn("accuracy_pct", r6(F.col("accuracy_pct")))


@query("SELECT CAST(floor(span / 10.0) * 10 AS BIGINT) AS class, count(*) AS reads, round(100.0 * count(*) FILTER (strand = '+') / count(*), 6) AS accuracy_pct FROM reads GROUP BY 1")
def accuracy_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rd.accuracy_by(reads(spark, sf_dir), rd.length_bin(F.col("span"), 10).cast("long"), F.col("strand") == "+")
    return out.withColumn("accuracy_pct", r6(F.col("accuracy_pct")))


@query(", c AS (SELECT contig, gene, count(*) AS n FROM reads GROUP BY 1, 2) SELECT contig, gene, round(n / sum(n) OVER (PARTITION BY contig), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY contig ORDER BY n DESC, gene DESC) = 1")
def dominant_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.dominant(reads(spark, sf_dir), ["contig"], "gene").select("contig", "gene", r6(F.col("share")).alias("share"))


@query("""
, c AS (SELECT gene, contig, count(*) AS reads, count(*) FILTER (nh = 'U') AS uniq, count(*) FILTER (nh = 'U' AND region = 'E') AS exonic FROM reads GROUP BY 1, 2), t AS (SELECT gene FROM c GROUP BY gene ORDER BY sum(reads) DESC, gene LIMIT 10)
SELECT * FROM c WHERE gene IN (SELECT gene FROM t)""")
def code_filter_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.code_filters(reads(spark, sf_dir), "gene", "contig", [("uniq", F.col("nh") == "U"), ("exonic", F.col("region") == "E")])


@query(", c AS (SELECT contig, well, count(*) AS n FROM reads GROUP BY 1, 2) SELECT contig, count(*) AS n, round(stddev_pop(n) / avg(n), 6) AS cv FROM c GROUP BY contig HAVING count(*) > 1")
def plate_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("contig", "well").agg(F.count("*").alias("k"))
    return rd.plate_variation(c, "contig", "k").select("contig", "n", r6(F.col("cv")).alias("cv"))


@query("""
, spots AS (SELECT DISTINCT contig, pos AS spot FROM reads), d AS (SELECT CAST(unnest(range(-25, 26)) AS BIGINT) AS d), x AS (SELECT r.contig, spot, well, umi FROM (SELECT contig, pos + d AS near, well, umi FROM reads, d) r JOIN spots s ON r.contig = s.contig AND r.near = s.spot), e AS (SELECT contig, spot, well, count(*) AS n FROM x GROUP BY 1, 2, 3),
  t AS (SELECT contig, spot, round(max(n) / sum(n), 6) AS top_share FROM e GROUP BY 1, 2)
SELECT contig, spot, count(*) AS reads, count(DISTINCT well || umi) AS molecules, top_share FROM x JOIN t USING (contig, spot) GROUP BY contig, spot, top_share""")
def peak_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    spots = r.select("contig", F.col("pos").alias("spot")).distinct()
    return rd.peak_windows(r, spots, ["contig"], "pos", "spot", "umi", "well").withColumn("top_share", r6(F.col("top_share")))


@query(", f AS (SELECT well, orderkey, bool_or(region = 'I') AS i, bool_or(region = 'R') AS r FROM reads GROUP BY 1, 2) SELECT well, CASE WHEN i THEN 'included' WHEN r THEN 'skipped' ELSE 'none' END AS type, count(*) AS fragments FROM f GROUP BY 1, 2")
def fragment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.fragment_types(reads(spark, sf_dir), "well", "orderkey", {"included": F.col("region") == "I", "skipped": F.col("region") == "R"})


@query(", c AS (SELECT gene, CAST(count(*) FILTER (region = 'E' AND strand = '+') AS DOUBLE) t, CAST(count(*) FILTER (region = 'E' AND strand = '-') AS DOUBLE) a, CAST(count(*) FILTER (region = 'I' AND strand = '+') AS DOUBLE) c, CAST(count(*) FILTER (region = 'I' AND strand = '-') AS DOUBLE) g FROM reads GROUP BY gene) SELECT gene, CASE WHEN a > 0 AND c > 0 AND g > 0 THEN round(t / a / (c / g), 6) END AS index FROM c")
def inclusion_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda r, s: F.count_if((F.col("region") == r) & (F.col("strand") == s)).cast("double")
    c = reads(spark, sf_dir).groupBy("gene").agg(at("E", "+").alias("t"), at("E", "-").alias("a"), at("I", "+").alias("c"), at("I", "-").alias("g"))
    return c.select("gene", r6(rd.inclusion_index(*(F.col(x) for x in "tacg"))).alias("index"))


@query("""
, b AS (SELECT gene, CAST(least(floor((lineno - 1) * 5 / 7), 4) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1, 2), l AS (SELECT gene, bin, n / max(n) OVER (PARTITION BY gene) AS level FROM b)
SELECT bin, round(sum(level) / (SELECT count(DISTINCT gene) FROM reads), 6) AS level FROM l GROUP BY bin""")
def scaled_mean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("place", F.col("lineno") - 1).withColumn("len", F.lit(7))
    bins = profiles.normalised(profiles.gene_bins(r, [], "gene", "place", "len", 5), [], "gene", "max")
    return profiles.mean_profile(bins, [], "gene").select(F.col("bin").cast("long"), r6(F.col("level")).alias("level"))


@query("SELECT well, round(avg(CAST(lineno - 1 < 2 AS INTEGER)), 6) AS five_prime, round(avg(CAST(7 - (lineno - 1) <= 2 AS INTEGER)), 6) AS three_prime, round(avg(CAST((lineno - 1) / 7.0 < 1 / 3.0 AS INTEGER)), 6) AS first_third, round(median((lineno - 1) / 7.0), 6) AS median_place FROM reads GROUP BY well")
def end_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("place", F.col("lineno") - 1).withColumn("len", F.lit(7))
    return profiles.end_shares(r, ["well"], "place", "len", 2).select("well", *(r6(F.col(c)).alias(c) for c in ("five_prime", "three_prime", "first_third", "median_place")))


@query(", c AS (SELECT gene, count(*) AS n FROM reads GROUP BY gene), q AS (SELECT quantile_cont(n, 0.25) a, quantile_cont(n, 0.5) b, quantile_cont(n, 0.75) c FROM c) SELECT gene, c.n, CAST(CASE WHEN c.n <= q.a THEN 1 WHEN c.n <= q.b THEN 2 WHEN c.n <= q.c THEN 3 ELSE 4 END AS BIGINT) AS quartile FROM c, q")
def expression_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n"))
    return profiles.quartile_of(c, [], "n").withColumn("quartile", F.col("quartile").cast("long"))


@query("""
, b AS (SELECT gene, CAST(least(floor(pos * 50 / 30000), 49) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n) + 50 - count(*) OVER (PARTITION BY gene) AS k FROM b)
SELECT gene, count(*) AS occupied, CAST(max(CAST(bin = 0 AS INTEGER)) AS BIGINT) AS first_hit, CAST(max(CAST(bin = 49 AS INTEGER)) AS BIGINT) AS last_hit, round(2 * sum(k * n) / (50 * sum(n)) - 51 / 50.0, 6) AS gini FROM k GROUP BY gene""")
def breadth_of_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("len", F.lit(30000))
    return profiles.breadth(profiles.gene_bins(r, [], "gene", "pos", "len", 50), [], "gene", 50).select("gene", "occupied", F.col("first_hit").cast("long"), F.col("last_hit").cast("long"), r6(F.col("gini")).alias("gini"))


@query("""
, b AS (SELECT contig, gene, CAST(least(floor(pos * 20 / 30000), 19) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1, 2, 3)
SELECT x.gene, x.contig AS a, y.contig AS b, round(corr(x.n, y.n), 6) AS r, count(*) AS bins FROM b x JOIN b y ON x.gene = y.gene AND x.bin = y.bin AND x.contig < y.contig GROUP BY 1, 2, 3""")
def profile_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("len", F.lit(30000))
    return profiles.profile_agreement(profiles.gene_bins(r, ["contig"], "gene", "pos", "len", 20), "gene", "contig").withColumn("r", r6(F.col("r")))


@query("""
, x AS (SELECT DISTINCT umi, umi || 'ACGTTGCA' || umi AS seq FROM reads),
  s AS (SELECT umi, min(i) AS start FROM x, range(0, 13) t(i) WHERE hamming(substr(seq, i + 1, 8), 'ACGATGCA') <= 1 GROUP BY umi),
  e AS (SELECT umi, j, min(levenshtein(substr(seq, j - l + 1, l), 'ACGATGCA')) AS d FROM x, range(1, 21) t(j), range(7, 10) u(l) WHERE l <= j GROUP BY umi, j),
  f AS (SELECT umi, min(j) AS j, arg_min(d, j) AS d FROM e WHERE d <= 1 GROUP BY umi)
SELECT umi, coalesce(start, greatest(j - 8, 0)) AS start, coalesce(start + 8, j) AS "end", CASE WHEN start IS NULL THEN d ELSE hamming(substr(seq, start + 1, 8), 'ACGATGCA') END AS distance
FROM x LEFT JOIN s USING (umi) LEFT JOIN f USING (umi)""")
def fuzzy_motif_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat("umi", F.lit("ACGTTGCA"), "umi"))
    return s.withColumn("hit", motifs.fuzzy_first(F.col("seq"), "ACGATGCA", 1, 1)).select("umi", *(F.col(f"hit.{c}").cast("long").alias(c) for c in ("start", "end", "distance")))


@query(", x AS (SELECT DISTINCT umi, umi || 'AACC' || umi AS seq FROM reads) SELECT umi, CASE WHEN contains(seq, 'CAC') OR contains(reverse(translate(seq, 'ACGT', 'TGCA')), 'CAC') THEN 'both' ELSE 'first' END AS class FROM x")
def read_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat("umi", F.lit("AACC"), "umi"))
    return s.select("umi", motifs.read_class(F.col("seq"), "ACC", "CAC").alias("class"))


@query(", x AS (SELECT umi || 'TTAACC' || umi AS seq FROM reads), p AS (SELECT seq, position('TTAACC' IN seq) AS loc FROM x), o AS (SELECT unnest([-2, -1, 6, 7]) AS o), l AS (SELECT o, substr(seq, CAST(loc + o AS BIGINT), 1) AS b FROM p, o WHERE loc + o BETWEEN 1 AND length(seq)) SELECT CAST(o AS BIGINT) AS \"offset\", round(avg(CAST(b = 'A' AS INTEGER)), 6) AS a, round(avg(CAST(b = 'C' AS INTEGER)), 6) AS c, round(avg(CAST(b = 'G' AS INTEGER)), 6) AS g, round(avg(CAST(b = 'T' AS INTEGER)), 6) AS t FROM l GROUP BY o")
def flank_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads(spark, sf_dir).select(F.concat("umi", F.lit("TTAACC"), "umi").alias("seq"))
    return motifs.flank_shares(x, "seq", "TTAACC", 2).select(F.col("offset").cast("long").alias("offset"), *(r6(F.col(b)).alias(b.lower()) for b in "ACGT"))


# Rankings, flows, checks --------------------------------------------------------------------------------------

_EFFECT = ", c AS (SELECT gene, count(*) FILTER (well >= 'W05') AS a, count(*) FILTER (well < 'W05') AS b, round(avg(size), 6) AS len FROM reads GROUP BY gene), e AS (SELECT gene, len, round(ln((a + 1.0) / (b + 1.0)) - (SELECT avg(ln((a + 1.0) / (b + 1.0))) FROM c), 6) AS effect, a + b AS n FROM c)"


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(_treated()).alias("a"), F.count_if(~_treated()).alias("b"), r6(F.avg("size")).alias("len"))
    raw = c.withColumn("raw", F.log((F.col("a") + 1.0) / (F.col("b") + 1.0)))
    mean = raw.agg(F.avg("raw").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("gene", "len", r6(F.col("raw") - F.col("_mean")).alias("effect"), (F.col("a") + F.col("b")).alias("n"))


@query(_EFFECT + ", s AS (SELECT gene, n, CASE WHEN effect > 0 THEN 'up' WHEN effect < 0 THEN 'down' END AS side FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n, gene) AS place FROM s WHERE side IS NOT NULL) SELECT side, CAST(place AS BIGINT) AS place, gene, n FROM r WHERE place <= 5")
def signed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.signed_top(_effects(spark, sf_dir), "effect", "n", "gene", 5).select("side", F.col("place").cast("long"), "gene", "n")


@query(_EFFECT + " SELECT CAST((len >= 24) AS BIGINT) + CAST((len >= 26) AS BIGINT) AS bin, round(median(effect), 6) AS median, count(*) AS rows FROM e GROUP BY 1")
def effect_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.effect_by_length(_effects(spark, sf_dir), "len", "effect", [24.0, 26.0])
    return out.select(F.col("bin").cast("long"), r6(F.col("median")).alias("median"), "rows")


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY (orderkey * 7919 + lineno * 104729 + partkey * 31) % 1000003, orderkey, lineno, partkey, pos, umi) AS k, count(*) OVER (PARTITION BY well) AS n FROM reads), d AS (SELECT unnest([25, 50, 100, 200]) AS depth),
  j AS (SELECT well, depth, gene, region, count(*) AS m FROM r JOIN d ON k <= depth AND depth <= n GROUP BY 1, 2, 3, 4)
SELECT well, CAST(depth AS BIGINT) AS depth, count(*) AS any_support, count(*) FILTER (m >= 2) AS two, count(*) FILTER (m >= 3) AS three FROM j GROUP BY well, depth""")
def junctions_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.expr("(orderkey * 7919 + lineno * 104729 + partkey * 31) % 1000003"), "orderkey", "lineno", "partkey", "pos", "umi"]
    pairs = sampling.rarefy(reads(spark, sf_dir), ["well"], order, DEPTHS, {"found": F.collect_list(F.concat_ws(":", "gene", "region"))})
    counts = pairs.select("well", "depth", F.explode("found").alias("junction")).groupBy("well", "depth", "junction").agg(F.count("*").alias("m"))
    return counts.groupBy("well", "depth").agg(F.count("*").alias("any_support"), F.count_if(F.col("m") >= 2).alias("two"), F.count_if(F.col("m") >= 3).alias("three"))


@query("""
, f AS (SELECT well, count(*) AS a, count(*) FILTER (nh = 'U') AS b, count(*) FILTER (nh = 'U' AND region = 'E') AS c FROM reads GROUP BY well)
SELECT well, 'reads' AS "from", 'unique' AS "to", b AS n FROM f UNION ALL SELECT well, 'unique', 'exonic', c FROM f UNION ALL SELECT well, 'reads', 'lost', a - b FROM f UNION ALL SELECT well, 'unique', 'lost', b - c FROM f""")
def stage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reads(spark, sf_dir).groupBy("well").agg(F.count("*").alias("reads"), F.count_if(F.col("nh") == "U").alias("unique"), F.count_if((F.col("nh") == "U") & (F.col("region") == "E")).alias("exonic"))
    return rd.stage_flow(f, ["well"], ["reads", "unique", "exonic"])


@query("""
, a AS (SELECT well, contig, 100.0 * count(*) FILTER (strand = '+') / count(*) AS acc FROM reads GROUP BY 1, 2), g AS (SELECT DISTINCT well, 'all' AS arm FROM reads UNION ALL SELECT DISTINCT well, CASE WHEN well >= 'W05' THEN 'treated' ELSE 'control' END FROM reads)
SELECT arm, contig, round(avg(acc), 6) AS mean, round(min(acc), 6) AS least, round(max(acc), 6) AS most, count(*) AS samples FROM a JOIN g USING (well) GROUP BY arm, contig""")
def group_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    acc = r.groupBy("well", "contig").agg((100 * F.count_if(F.col("strand") == "+") / F.count("*")).alias("acc"))
    wells = r.select("well").distinct()
    groups = wells.select("well", F.lit("all").alias("arm")).unionByName(wells.select("well", F.when(_treated(), "treated").otherwise("control").alias("arm")))
    out = rd.group_funnel(acc, groups, "well", "arm", "contig", "acc")
    return out.select("arm", "contig", *(r6(F.col(c)).alias(c) for c in ("mean", "least", "most")), "samples")


@query("""SELECT 'shares' AS "check", true AS passed UNION ALL SELECT 'fate', true UNION ALL SELECT 'wells', true""")
def result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    shares = tables.composition(r, ["well"], "region").withColumn("pct", 100 * F.col("share"))
    fate = tables.read_fate(r, ["well"], {"uniq": F.col("nh") == "U", "exonic": F.col("region") == "E"})
    wells = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("W"), F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0")).alias("well")).distinct()
    found = checks.all_checks(checks.hundred_percent(shares, "shares", ["well"], "pct"), rd.ordered_stages(fate, "fate", ["reads_in", "uniq", "exonic"]), checks.same_keys(wells, fate, "well", "wells"))
    return found.select("check", "passed")


@query(", c AS (SELECT gene, well, count(*) AS n FROM reads GROUP BY 1, 2) SELECT gene, well, round(n * 1e7 / sum(n) OVER (PARTITION BY well), 4) AS scaled FROM c")
def scaled_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", "well").agg(F.count("*").alias("depth"))
    totals = c.groupBy("well").agg(F.sum("depth").alias("total"))
    return profiles.scaled_depth(c, totals, ["well"], "total").select("gene", "well", F.round("scaled", 4).alias("scaled"))


@query(", c AS (SELECT gene, CAST(floor(pos / 100) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1, 2) SELECT gene, CAST(floor(bin / 5) AS BIGINT) AS block, max(n) AS n FROM c GROUP BY 1, 2")
def block_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene", F.floor(F.col("pos") / 100).alias("bin")).agg(F.count("*").alias("n"))
    return profiles.block_max(c, ["gene"], "bin", "n", 5)


from . import file_queries, read_queries, structure_queries, table_queries  # noqa: E402, F401  (they register their queries here)
