"""Queries on rankings, sets, checks, reports and wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assays, checks, matrix, profiles, ranking, reports, sampling, tables
from ..operators import reads as rd
from .catalogue import query, r6
from .fixture import reads, table

# Ranks and sets -----------------------------------------------------------------------------------------------


@query("SELECT well, gene, n, row_number() OVER (PARTITION BY well ORDER BY n DESC, gene) AS rank FROM (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2)")
def ranked_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return rd.ranked(c, ["well"], [F.col("n").desc(), F.col("gene")]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT well, gene, n, place FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY n DESC, gene) AS place FROM (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2)) WHERE place <= 3")
def top_genes_per_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("well", "gene").agg(F.count("*").alias("n"))
    return ranking.top_per_group(c, ["well"], [F.col("n").desc(), F.col("gene")], 3).withColumn("place", F.col("place").cast("long"))


@query("""
, c AS (SELECT gene, count(*) FILTER (strand = '+') AS a, count(*) FILTER (strand = '-') AS b FROM reads GROUP BY gene), d AS (SELECT gene, a - b AS d, (a + b) / 2.0 AS m FROM c),
  s AS (SELECT gene, CASE WHEN d > 0 THEN 'above' WHEN d < 0 THEN 'below' END AS side, abs(d) * m AS weight FROM d)
SELECT gene, side, round(weight, 6) AS weight FROM s WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY side ORDER BY weight DESC, gene) <= 4""")
def labelled_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count_if(F.col("strand") == "+").alias("a"), F.count_if(F.col("strand") == "-").alias("b"))
    rows = c.select("gene", (F.col("a") - F.col("b")).alias("d"), ((F.col("a") + F.col("b")) / 2.0).alias("m"))
    return ranking.labelled_outliers(rows, "d", "m", "gene", 4).select("gene", "side", r6(F.col("weight")).alias("weight"))


@query("""
, r AS (SELECT orderkey, lineno, partkey, suppkey, well, row_number() OVER (PARTITION BY well ORDER BY orderkey, lineno, partkey, suppkey, pos, umi) - 1 AS k FROM reads)
SELECT well, orderkey, lineno, partkey, suppkey FROM r WHERE k % 7 = 0""")
def strided_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("well", "orderkey", "lineno", "partkey", "suppkey", "pos", "umi")
    return sampling.strided(rows, ["well"], ["orderkey", "lineno", "partkey", "suppkey", "pos", "umi"], 7).drop("pos", "umi")


@query("SELECT DISTINCT orderkey FROM reads WHERE region = 'I' AND orderkey NOT IN (SELECT orderkey FROM reads WHERE region = 'E')")
def intronic_only_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda region: reads(spark, sf_dir).where(F.col("region") == region).select("orderkey")
    return rd.exclusions(names("I"), names("E"), "orderkey").distinct()


@query("SELECT gene FROM (SELECT contig, gene FROM reads GROUP BY contig, gene HAVING count(*) >= 20) GROUP BY gene HAVING count(*) = 3")
def genes_of_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    return sampling.common_features(rows, "contig", "gene", 20, 3, ["orderkey", "lineno", "partkey", "suppkey"]).select("gene").distinct()


@query("SELECT part, gene, count(*) AS n FROM (SELECT 1 AS part, gene FROM reads WHERE strand = '+' UNION ALL SELECT 2, gene FROM reads WHERE nh = 'U') GROUP BY 1, 2")
def chunks_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    both = r.where("strand = '+'").select(F.lit(1).alias("part"), "gene").unionByName(r.where("nh = 'U'").select(F.lit(2).alias("part"), "gene"))
    return both.groupBy("part", "gene").agg(F.count("*").alias("n"))


@query("""
, c AS (SELECT gene AS symbol, gene || '-' || CAST(replicate AS VARCHAR) AS feature, well, count(*) AS n FROM reads GROUP BY ALL), p AS (SELECT symbol, min(feature) AS target, count(DISTINCT feature) AS k FROM c WHERE ends_with(feature, '-0') GROUP BY symbol)
SELECT CASE WHEN k = 1 THEN target ELSE feature END AS feature, c.symbol, well, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN p USING (symbol) GROUP BY 1, 2, 3""")
def folded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy(F.col("gene").alias("symbol"), F.concat("gene", F.lit("-"), "replicate").alias("feature"), "well").agg(F.count("*").alias("n"))
    return matrix.fold_aliases(c.withColumn("main", F.col("feature").endswith("-0")), "feature", "symbol", "well", "n", "main")


@query("""
, n AS (SELECT DISTINCT right(well, 1) AS name FROM reads), k AS (SELECT DISTINCT well FROM reads), p AS (SELECT name, count(*) AS c, min(well) AS one, max(CASE WHEN well = name THEN well END) AS same FROM n JOIN k ON ends_with(well, name) GROUP BY name)
SELECT n.name, coalesce(same, CASE WHEN c = 1 THEN one END) AS well FROM n LEFT JOIN p USING (name)""")
def reconciled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = reads(spark, sf_dir).select("well").distinct()
    return rd.suffix_match(wells.select(F.right("well", F.lit(1)).alias("name")).distinct(), wells, "name", "well")


# Profiles -----------------------------------------------------------------------------------------------------

_BINS = ", b AS (SELECT gene, CAST(least(floor(pos * 20 / 30000), 19) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1, 2)"


@query(_BINS + """
SELECT gene, bin, round(n / sum(n) OVER w, 6) AS by_sum, round(n / avg(n) OVER w, 6) AS by_mean, round(n / max(n) OVER w, 6) AS by_max, round(n / median(n) OVER w, 6) AS by_median, CAST(n >= 0.2 * max(n) OVER w AS DOUBLE) AS fifth FROM b WINDOW w AS (PARTITION BY gene)""")
def normalised_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = profiles.gene_bins(reads(spark, sf_dir).withColumn("len", F.lit(30000)), [], "gene", "pos", "len", 20)
    out = b.select("gene", F.col("bin").cast("long").alias("bin"), "n")
    for rule, name in (("sum", "by_sum"), ("mean", "by_mean"), ("max", "by_max"), ("median", "by_median"), ("fifth", "fifth")):
        out = profiles.normalised(out, [], "gene", rule).withColumn(name, r6(F.col("level"))).drop("level")
    return out.drop("n")


@query("""
, d AS (SELECT gene, pos, CAST(count(*) AS DOUBLE) AS depth FROM reads GROUP BY 1, 2)
SELECT gene, round(count(*) / 30000.0, 6) AS covered_share, round(max(depth) / (sum(depth) / 30000), 6) AS peak_to_mean, round(median(depth), 6) AS median, round(pow(sum(sqrt(depth)), 2) / (sum(depth) * 30000), 6) AS evenness FROM d GROUP BY gene""")
def gene_peakiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reads(spark, sf_dir).groupBy("gene", "pos").agg(F.count("*").cast("double").alias("depth")).withColumn("len", F.lit(30000))
    return assays.peakiness(d, [], "gene", "len").select("gene", *(r6(F.col(c)).alias(c) for c in ("covered_share", "peak_to_mean", "median", "evenness")))


@query("""
, c AS (SELECT well, gene, region, CASE WHEN count(*) >= 4 THEN avg(size) END AS own FROM reads GROUP BY 1, 2, 3), p AS (SELECT gene, avg(size) AS plain FROM reads WHERE nh = 'U' GROUP BY gene)
SELECT well, c.gene, region, round(coalesce(own, avg(own) OVER (PARTITION BY well, c.gene), plain, 1.0), 6) AS length FROM c LEFT JOIN p ON p.gene = c.gene""")
def completed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    c = r.groupBy("well", "gene", "region").agg(F.when(F.count("*") >= 4, F.avg("size")).alias("own"))
    rows = c.join(r.where("nh = 'U'").groupBy("gene").agg(F.avg("size").alias("plain")), "gene", "left")
    return rows.withColumn("length", r6(matrix.complete_length(rows, "own", "well", "gene", "plain"))).select("well", "gene", "region", "length")


# Checks -------------------------------------------------------------------------------------------------------


@query("""
, w AS (SELECT well, count(*) AS n, count(*) FILTER (nh = 'U') AS u, CAST(sum(span) AS DOUBLE) AS s FROM reads GROUP BY well), a AS (SELECT sum(n) AS n, sum(u) AS u FROM w)
SELECT 'denominators' AS "check", count(*) FILTER (u = 0 AND n = 0) = 0 AS passed FROM w UNION ALL SELECT 'columns', max(n) > 0 AND max(u) > 0 FROM w
UNION ALL SELECT 'kept', (SELECT count(*) FILTER (u > n) FROM w) = 0 AND abs(u - n) / n <= 0.02 FROM a
UNION ALL SELECT 'direction', count(*) FILTER (n >= 50 AND u / n < 0.5) = 0 FROM w
UNION ALL SELECT 'shares', max(abs(s / (SELECT sum(s) FROM w) - 2 * s / (SELECT sum(2 * s) FROM w))) <= 1e-6 FROM w
UNION ALL SELECT 'unequal shares', max(abs(n / (SELECT sum(n) FROM w) - s / (SELECT sum(s) FROM w))) <= 1e-6 FROM w
UNION ALL SELECT 'declared codes', (SELECT count(*) FILTER (well < 'W20' AND n < greatest(1.0, 0.001 * (SELECT n FROM a))) FROM w) = 0 AND (SELECT coalesce(sum(n) FILTER (well >= 'W20'), 0) FROM w) / (SELECT n FROM a) <= 0.005""")
def more_result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reads(spark, sf_dir).groupBy("well").agg(F.count("*").alias("n"), F.count_if(F.col("nh") == "U").alias("u"), F.sum("span").cast("double").alias("s"))
    w = w.withColumn("share", F.col("u") / F.col("n")).withColumn("twice", 2 * F.col("s")).withColumn("all", F.lit(1))
    found = checks.all_checks(
        checks.some_denominator(w, "denominators", ["u", "n"]),
        checks.not_all_zero(w, "columns", ["n", "u"]),
        checks.kept_within(w, "kept", "u", "n"),
        checks.right_direction(w, "direction", "share", "n"),
        checks.proportional(w, "shares", ["all"], "s", "twice"),
        checks.proportional(w, "unequal shares", ["all"], "n", "s"),
        checks.declared_codes(w.withColumn("declared", F.col("well") < "W20"), "well", "n", "declared"),
    )
    return found.select("check", "passed")


# Preparation and reports --------------------------------------------------------------------------------------


@query("""
, x AS (SELECT umi || repeat('G', CAST(lineno AS INTEGER) % 5) || repeat(umi, CAST(lineno AS INTEGER)) AS seq, CASE WHEN umi < 'G' THEN left(umi, 4) END AS code, CASE WHEN umi < 'G' THEN CAST(umi >= 'C' AS INTEGER) END AS mm, repeat('C', CAST(span AS INTEGER)) AS insert FROM reads),
  y AS (SELECT *, length(regexp_extract(substr(seq, 7), '^G*', 0)) AS run FROM x)
SELECT count(*) AS n, count(*) - count(code) AS no_code, count(*) FILTER (mm = 0) AS exact, count(*) FILTER (mm = 1) AS one_off, count(*) FILTER (code IS NOT NULL AND length(insert) - run < 30) AS too_short, count(*) FILTER (code IS NOT NULL AND length(insert) - run >= 30) AS written FROM y""")
def prep_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("lineno").cast("int"), F.col("umi")
    x = reads(spark, sf_dir).select(F.concat(u, F.repeat(F.lit("G"), n % 5), F.repeat(u, n)).alias("seq"), F.when(u < "G", F.substring(u, 1, 4)).alias("code"), F.when(u < "G", (u >= "C").cast("int")).alias("mm"), F.repeat(F.lit("C"), F.col("span").cast("int")).alias("insert"))
    return rd.prep_counters(x, "seq", "code", "mm", "insert", 6)


@query("""
, g AS (SELECT gene, count(*) AS n, 100.0 * count(*) FILTER (nh = 'U') / count(*) AS uniq, 100.0 * count(*) FILTER (region = 'I') / count(*) AS intronic, count(DISTINCT well) AS wells, max(span) AS top, avg(size) AS size FROM reads GROUP BY gene),
  l AS (SELECT 'even' AS list, gene, n, -uniq AS k0, intronic AS k1 FROM g WHERE n >= 100 AND uniq >= 60 AND intronic <= 40 AND wells >= 10 AND top >= 40 AND size >= 20
    UNION ALL SELECT 'intronic', gene, n, -intronic, CAST(NULL AS DOUBLE) FROM g WHERE n >= 50 AND uniq >= 50 AND intronic >= 10 AND wells >= 5 AND top >= 30 AND size <= 40)
SELECT list, gene, n, row_number() OVER (PARTITION BY list ORDER BY k0, k1 NULLS FIRST, gene) AS place FROM l""")
def candidate_gene_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of genes by six conditions each, in each list's order."""
    pct = lambda test: 100 * F.count_if(test) / F.count("*")
    g = reads(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n"), pct(F.col("nh") == "U").alias("uniq"), pct(F.col("region") == "I").alias("intronic"), F.count_distinct("well").alias("wells"), F.max("span").alias("top"), F.avg("size").alias("size"))
    c = F.col
    found = reports.candidate_lists(
        g,
        {
            "even": ([c("n") >= 100, c("uniq") >= 60, c("intronic") <= 40, c("wells") >= 10, c("top") >= 40, c("size") >= 20], [-c("uniq"), c("intronic")]),
            "intronic": ([c("n") >= 50, c("uniq") >= 50, c("intronic") >= 10, c("wells") >= 5, c("top") >= 30, c("size") <= 40], [-c("intronic")]),
        },
    )
    placed = rd.ranked(found, ["list"], [F.col("order"), F.col("gene")])
    return placed.select("list", "gene", "n", F.col("rank").cast("long").alias("place"))


@query("""
, s AS (SELECT DISTINCT well FROM reads), f AS (SELECT well, count(*) AS reads, count(*) FILTER (nh = 'U') AS uniq FROM reads GROUP BY well), m AS (SELECT well, count(DISTINCT umi || gene) AS molecules FROM reads WHERE region = 'E' GROUP BY well),
  i AS (SELECT well, count(*) AS n FROM reads WHERE region = 'I' AND span > 45 GROUP BY well), p AS (SELECT well, count(*) FILTER (region = 'E') AS "E", count(*) FILTER (region = 'R') AS "R" FROM reads GROUP BY well),
  g AS (SELECT well, max(n) AS most FROM (SELECT well, gene, count(*) AS n FROM reads GROUP BY 1, 2) GROUP BY well), z AS (SELECT well, round(avg(size), 6) AS mean FROM reads WHERE strand = '+' GROUP BY well), l AS (SELECT well, min(pos) AS first, max(pos) AS last FROM reads GROUP BY well)
SELECT s.well, f.reads AS fate_reads, f.uniq AS fate_uniq, m.molecules AS tags_molecules, coalesce(i.n, 0) AS long_n, p."E" AS class_E, p."R" AS class_R, g.most AS gene_most, z.mean AS size_mean, l.first AS span_first, l.last AS span_last
FROM s LEFT JOIN f USING (well) LEFT JOIN m USING (well) LEFT JOIN i USING (well) LEFT JOIN p USING (well) LEFT JOIN g USING (well) LEFT JOIN z USING (well) LEFT JOIN l USING (well)""")
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each well from seven tables."""
    r = reads(spark, sf_dir)
    by = lambda rows, *aggs: rows.groupBy("well").agg(*aggs)
    sources = {
        "fate": by(r, F.count("*").alias("reads"), F.count_if(F.col("nh") == "U").alias("uniq")),
        "tags": by(r.where("region = 'E'"), F.count_distinct("umi", "gene").alias("molecules")),
        "long": by(r.where("region = 'I' and span > 45"), F.count("*").alias("n")),
        "class": reports.pivoted(r.groupBy("well", "region").agg(F.count("*").alias("n")), ["well"], "region", "n", ["E", "R"]),
        "gene": by(r.groupBy("well", "gene").agg(F.count("*").alias("n")), F.max("n").alias("most")),
        "size": by(r.where("strand = '+'"), r6(F.avg("size")).alias("mean")),
        "span": by(r, F.min("pos").alias("first"), F.max("pos").alias("last")),
    }
    return reports.sample_table(r, ["well"], sources, {"long_n": 0})


@query("""
, m AS (SELECT contig AS method, well, count(DISTINCT umi) AS tags, count(DISTINCT gene) AS genes, 100.0 * count(*) FILTER (strand = '+') / count(*) AS acc FROM reads GROUP BY 1, 2)
SELECT method, round(avg(tags), 6) AS tags, count(tags) AS tags_samples, round(avg(genes), 6) AS genes, count(genes) AS genes_samples, round(avg(acc) FILTER (well < 'W12'), 6) AS accuracy, count(acc) FILTER (well < 'W12') AS accuracy_samples FROM m GROUP BY method""")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumnRenamed("contig", "method")
    by = lambda rows, value: rows.groupBy("method", "well").agg(value.alias("v"))
    parts = {"tags": (by(r, F.count_distinct("umi")), "v"), "genes": (by(r, F.count_distinct("gene")), "v"), "accuracy": (by(r.where("well < 'W12'"), 100 * F.count_if(F.col("strand") == "+") / F.count("*")), "v")}
    return reports.method_summary(parts, "method").withColumns({c: r6(F.col(c)) for c in parts})


@query("SELECT contig, well, count(*) AS reads, round(avg(span), 6) AS span, count(DISTINCT gene) AS genes FROM reads GROUP BY contig, well")
def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of units of which some are known from before, and some from an older make."""
    r = reads(spark, sf_dir)
    metrics, wanted = {"reads": F.count("*"), "span": r6(F.avg("span")), "genes": F.count_distinct("gene")}, {"reads": "bigint", "span": "double", "genes": "bigint"}
    known = reports.unit_metrics(r.where("well < 'W08'"), ["contig", "well"], metrics, wanted, r.select("well").distinct())
    return reports.unit_metrics(r, ["contig", "well"], metrics, wanted, known)


@query("""
, s AS (SELECT umi, lineno, umi || CASE WHEN lineno >= 2 THEN 'NACNACNA' ELSE 'NACNAC' END || umi || CASE WHEN lineno >= 4 THEN 'NGTNGTNG' WHEN lineno >= 3 THEN 'NGTNGT' ELSE '' END || CASE WHEN lineno >= 6 THEN 'NCCNCCNC' ELSE '' END AS seq FROM reads)
SELECT CAST(CASE WHEN lineno < 2 THEN 0 WHEN lineno < 4 THEN 1 WHEN lineno < 6 THEN 2 ELSE 3 END AS BIGINT) AS reach, lineno IN (1, 3) AS "partial", count(*) AS n FROM s GROUP BY 1, 2""")
def deepest_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("lineno")
    seq = F.concat("umi", F.when(n >= 2, "NACNACNA").otherwise("NACNAC"), "umi", F.when(n >= 4, "NGTNGTNG").when(n >= 3, "NGTNGT").otherwise(""), F.when(n >= 6, "NCCNCCNC").otherwise(""))
    x = reads(spark, sf_dir).select(reports.deepest_element(seq, ["NACNACNA", "NGTNGTNG", "NCCNCCNC"]).alias("x"))
    return x.groupBy(F.col("x.reach").cast("long").alias("reach"), "x.partial").agg(F.count("*").alias("n"))


@query("""
SELECT gene, CASE WHEN regexp_matches(gene, '^(RPL|RPS)') THEN 'ribosomal' ELSE 'other' END AS kind, n, row_number() OVER (ORDER BY blank, gene) AS place FROM (SELECT gene, count(*) AS n, gene > 'Brand#4' AS blank FROM reads GROUP BY gene)""")
def table_order_blanks_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reads(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)).withColumn("key", F.when(~(F.col("gene") > "Brand#4"), F.col("gene")))
    out = rd.ranked(c, ["one"], [F.col("key").asc_nulls_last(), F.col("gene")])
    return out.select("gene", F.when(rd.is_ribosomal(F.col("gene")), "ribosomal").otherwise("other").alias("kind"), "n", F.col("rank").cast("long").alias("place"))


@query("SELECT CASE WHEN p_type = 'PROMO' THEN 'rrna' WHEN p_type = 'ECONOMY' AND p_brand < 'Brand#3' THEN 'ribosomal_protein' WHEN p_type = 'ECONOMY' THEN 'coding' ELSE 'other' END AS class, count(*) FILTER (p_type = 'ECONOMY' AND NOT p_brand < 'Brand#3') AS messenger, count(*) AS n FROM part GROUP BY 1")
def exon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    gene = F.when(F.col("p_brand") < "Brand#3", F.concat(F.lit("RPL"), "p_size")).otherwise(F.concat(F.lit("G"), "p_size"))
    biotype = F.when(F.col("p_type") == "PROMO", "Mt_rRNA").when(F.col("p_type") == "ECONOMY", "protein_coding").otherwise("lncRNA")
    return p.groupBy(rd.exon_class(gene, biotype).alias("class")).agg(F.count_if(rd.is_messenger(gene, biotype, F.lit("HUMAN_1"))).alias("messenger"), F.count("*").alias("n"))


@query("""
, d AS (SELECT DISTINCT contig, gene, well FROM reads), n AS (SELECT contig, gene, count(*) AS wells FROM d GROUP BY 1, 2)
SELECT contig, CAST(wells AS BIGINT) AS reads_per_molecule, count(*) AS molecules FROM n GROUP BY 1, 2""")
def wells_per_gene_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import molecules

    return molecules.duplicity_histogram(reads(spark, sf_dir).select("contig", "gene", "well").distinct(), ["contig", "gene"], ["contig"])


@query(", c AS (SELECT well, region, count(*) AS n FROM reads GROUP BY 1, 2) SELECT well, CAST(sum(n) AS BIGINT) AS n, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY well")
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = reads(spark, sf_dir).groupBy("well", "region").agg(F.count("*").alias("n"), F.count("*").alias("most"))
    return tables.merge_partials(parts, ["well"], ["n"], ["most"], [])
