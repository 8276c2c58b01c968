"""Queries that write the driver's rows in a text format, read them back, and compare with the rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, ranking
from ..sources import sinks
from ..sources import text_formats as tf
from ..sources.work import work_path
from .catalogue import query, r6
from .fixture import reads, table

_ID = "'r' || CAST(orderkey AS VARCHAR) || ':' || CAST(lineno AS VARCHAR) || ':' || CAST(partkey AS VARCHAR) || ':' || CAST(suppkey AS VARCHAR)"

#: Reads of a gzipped file, about: each is one task's work.
FILE_READS = 500_000


def _read_id() -> Column:
    return F.concat(F.lit("r"), F.concat_ws(":", "orderkey", "lineno", "partkey", "suppkey"))


def _fastq(spark: SparkSession, sf_dir: str, seq: Column) -> DataFrame:
    rows = reads(spark, sf_dir).select(_read_id().alias("read_id"), seq.alias("seq"))
    return rows.withColumn("qual", F.translate("seq", "ACGT", "I5?!"))


@query(f"SELECT {_ID} AS read_id, umi || well AS seq, count(*) AS n FROM reads GROUP BY 1, 2")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "fastq")
    sinks.write_fastq(_fastq(spark, sf_dir, F.concat("umi", "well")), path)
    back = tf.read_fastq(spark, path).where(F.col("qual") == F.translate("seq", "ACGT", "I5?!"))
    return back.groupBy("read_id", "seq").agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} AS read_id, umi AS seq, count(*) AS n FROM reads GROUP BY 1, 2")
def fastq_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads in one plain file, which is read in blocks. Qualities begin with the sign of a record's head."""
    path = work_path(spark, "lane")
    rows = reads(spark, sf_dir).select(_read_id().alias("read_id"), F.col("umi").alias("seq"), F.translate("umi", "ACGT", "@+?!").alias("qual"))
    sinks.write_fastq(rows, path, compression="none")
    back = tf.read_fastq(spark, path).where(F.col("qual") == F.translate("seq", "ACGT", "@+?!"))
    return back.groupBy("read_id", "seq").agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} AS read_id, umi AS seq1, reverse(umi) AS seq2, count(*) AS n FROM reads GROUP BY 1, 2, 3")
def fastq_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [work_path(spark, f"mates{k}") for k in (1, 2)]
    rows = _fastq(spark, sf_dir, F.col("umi"))
    rows = rows.repartition(max(4, -(-rows.count() // FILE_READS)), "read_id").sortWithinPartitions("read_id", "seq")
    sinks.write_fastq(rows.withColumn("read_id", F.concat("read_id", F.lit("/1"))), paths[0])
    sinks.write_fastq(rows.select(F.concat("read_id", F.lit("/2")).alias("read_id"), F.reverse("seq").alias("seq"), F.reverse("qual").alias("qual")), paths[1])
    both = tf.paired(tf.read_fastq(spark, paths[0]), tf.read_fastq(spark, paths[1]))
    return both.groupBy("read_id", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2")).agg(F.count("*").alias("n"))


_FLAG = "CASE lineno WHEN 7 THEN 2304 WHEN 6 THEN 4 WHEN 5 THEN 256 ELSE CASE WHEN strand = '-' THEN 16 ELSE 0 END END"


@query(f"""
SELECT contig, flag, count(*) AS n, count(*) FILTER (nh = 'U' OR lineno = 1) AS uniq, CAST(sum(pos) AS BIGINT) AS place, count(DISTINCT umi) AS tags
FROM (SELECT *, CAST({_FLAG} AS BIGINT) AS flag FROM reads) WHERE flag & 2308 = 0 GROUP BY contig, flag""")
def sam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "sam")
    rows = reads(spark, sf_dir)
    tags = F.when(F.col("lineno") == 1, F.concat(F.lit("XT:Z:"), "well")).when(F.col("nh") == "U", "NH:i:1").otherwise("NH:i:3")
    mapq = F.when(F.col("lineno") == 1, 255).otherwise(3)
    line = F.concat_ws("\t", _read_id(), F.expr(_FLAG.replace("VARCHAR", "string")), "contig", "pos", mapq, F.concat("span", F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), "umi", F.lit("*"), tags)
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:HUMAN_1\tLN:9",)], "value string")
    rows.select(line.alias("value")).unionByName(head).write.text(path)
    back = tf.read_sam(spark, path)
    return back.groupBy("contig", F.col("flag").cast("long").alias("flag")).agg(F.count("*").alias("n"), F.count_if(tf.is_unique()).alias("uniq"), F.sum("pos").alias("place"), F.count_distinct("seq").alias("tags"))


@query("SELECT contig, pos AS start, pos + span AS \"end\", gene AS name, count(*) AS n FROM reads GROUP BY 1, 2, 3, 4")
def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "bed")
    rows = reads(spark, sf_dir).select("contig", "pos", (F.col("pos") + F.col("span")).alias("stop"), "gene", (F.col("span") / 60).alias("effect"), "strand")
    sinks.write_bed(rows, path, "contig", "pos", "stop", "gene", "effect", "strand")
    spark.createDataFrame([("# a comment",), ("track name=x",), ("browser position chr1",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return tf.read_bed(spark, path).groupBy("contig", "start", "end", "name").agg(F.count("*").alias("n"))


@query("SELECT least(CAST(round(1000 * span / 40.0) AS BIGINT), 1000) AS score, count(*) AS n FROM reads GROUP BY 1")
def bed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "bed")
    rows = reads(spark, sf_dir).select("contig", "pos", (F.col("pos") + F.col("span")).alias("stop"), "gene", (F.col("span") / 40).alias("effect"), "strand")
    sinks.write_bed(rows, path, "contig", "pos", "stop", "gene", "effect", "strand")
    back = spark.read.csv(path, sep="\t", schema="contig string, s long, e long, name string, score long, strand string")
    return back.groupBy("score").agg(F.count("*").alias("n"))


_EXONS = """WITH x AS (SELECT 'c' || CAST(p_partkey % 2 AS VARCHAR) AS contig, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS gene_name, p_brand || '-' || CAST(p_partkey % 6 AS VARCHAR) AS transcript_id,
  p_partkey * 10 AS s, p_partkey * 10 + p_size AS e, p_partkey % 6 = 3 AS canonical FROM part)"""


def _gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as exons of their brands' transcripts, written as GTF and read back."""
    path = work_path(spark, "gtf")
    k = F.col("p_partkey")
    text = F.concat(F.lit('gene_id "'), "p_brand", F.lit('"; gene_name "'), "p_brand", F.lit('"; transcript_id "'), "p_brand", F.lit("-"), (k % 6).cast("string"), F.lit('"; gene_biotype "protein_coding";'), F.when(k % 6 == 3, F.lit(' tag "Ensembl_canonical";')).otherwise(""))
    line = F.concat_ws("\t", F.concat(F.lit("c"), (k % 2).cast("string")), F.lit("made"), F.lit("exon"), (k * 10 + 1).cast("string"), (k * 10 + F.col("p_size")).cast("string"), F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), text)
    lines = table(spark, sf_dir, "part").select(line.alias("value"))
    other = spark.createDataFrame([("#!genome-build made",), ('c0\tmade\tgene\t1\t9\t.\t+\t.\tgene_id "x";',)], "value string")
    lines.unionByName(other).write.text(path)
    return tf.read_gtf(spark, path, "exon")


@query(_EXONS + " SELECT contig, strand, gene_name, transcript_id, canonical, s AS start, e AS \"end\", 'protein_coding' AS biotype, count(*) AS n FROM x GROUP BY ALL")
def gtf_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gtf(spark, sf_dir).groupBy("contig", "strand", "gene_name", "transcript_id", "canonical", "start", "end", "biotype").agg(F.count("*").alias("n"))


@query(_EXONS + """, t AS (SELECT contig, strand, gene_name, transcript_id, CASE WHEN strand = '+' THEN arg_max({'s': s, 'e': e}, e) ELSE arg_min({'s': s, 'e': e}, s) END AS x FROM x GROUP BY 1, 2, 3, 4)
SELECT DISTINCT contig, strand, gene_name, x.s AS start, x.e AS "end" FROM t""")
def gtf_terminal_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.terminal_exons(_gtf(spark, sf_dir))


@query(_EXONS + """, t AS (SELECT contig, strand, gene_name, transcript_id, CASE WHEN strand = '+' THEN max(e) ELSE min(s) END AS x FROM x GROUP BY 1, 2, 3, 4)
SELECT contig, strand, gene_name, string_agg(DISTINCT x, ',' ORDER BY x) AS ends FROM t GROUP BY 1, 2, 3""")
def gtf_transcript_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.transcript_ends(_gtf(spark, sf_dir)).withColumn("ends", F.array_join(F.col("ends").cast("array<string>"), ","))


@query(_EXONS + """, t AS (SELECT gene_name, transcript_id, max(canonical) AS canonical, CAST(sum(e - s) AS BIGINT) AS length FROM x GROUP BY 1, 2)
SELECT gene_name, transcript_id, canonical, length FROM t QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY canonical DESC, length DESC, transcript_id) = 1""")
def gtf_canonical_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.canonical_transcripts(_gtf(spark, sf_dir)).select("gene_name", "transcript_id", "canonical", "length")


@query(_EXONS + """, t AS (SELECT gene_name AS gene, transcript_id AS transcript, contig, strand, min(s) AS tx_start, max(e) AS tx_end, count(*) AS exons, string_agg(s, ',' ORDER BY s, e) AS starts, string_agg(e, ',' ORDER BY s, e) AS ends,
  min(s) FILTER (s % 4 = 0) AS cs, max(e) FILTER (s % 4 = 0) AS ce FROM x GROUP BY 1, 2, 3, 4)
SELECT gene, transcript, contig, strand, tx_start, tx_end, coalesce(cs, tx_end) AS cds_start, coalesce(ce, tx_end) AS cds_end, exons, starts, ends FROM t""")
def refflat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "refflat")
    exons = _gtf(spark, sf_dir)
    rows = tf.to_refflat(exons, exons.where("start % 4 = 0"))
    numbers = lambda c: F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns[:9]), numbers("starts"), numbers("ends")).alias("value")).write.text(path)
    back = tf.read_refflat(spark, path)
    return back.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("starts", "ends")})


@query("SELECT well, umi, gene, CASE WHEN nh = 'U' THEN span END AS span, count(*) AS n FROM reads GROUP BY ALL")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a header, empty cells and a sidecar that says where it came from."""
    path = work_path(spark, "table")
    rows = reads(spark, sf_dir).select("well", "umi", "gene", F.when(F.col("nh") == "U", F.col("span")).alias("span"))
    sinks.write_table(rows, path, {"rows": "reads", "columns": 4})
    if {r.key: r.value for r in spark.read.json(f"{path}.provenance").collect()} != {"rows": "reads", "columns": "4"}:
        raise ValueError("the sidecar was not read back as it was written")
    return tf.read_table(spark, path, "well string, umi string, gene string, span long").groupBy("well", "umi", "gene", "span").agg(F.count("*").alias("n"))


@query("SELECT gene, well, CAST(count(*) AS DOUBLE) AS n FROM reads GROUP BY 1, 2 UNION ALL SELECT g.gene, w.well, 0.0 FROM (SELECT DISTINCT gene FROM reads) g, (SELECT DISTINCT well FROM reads) w WHERE (g.gene, w.well) NOT IN (SELECT (gene, well) FROM reads)")
def wide_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a wide table with empty cells, written, read, and made long with zeros."""
    path = work_path(spark, "matrix")
    # there are 24 wells, whatever the size of the table
    found = [r.well for r in reads(spark, sf_dir).select("well").distinct().orderBy("well").collect()]
    wide = reads(spark, sf_dir).groupBy("gene").agg(*(F.nullif(F.count_if(F.col("well") == w), F.lit(0)).alias(w) for w in found))
    sinks.write_table(wide, path)
    back = tf.read_table(spark, path, "gene string, " + ", ".join(f"{w} double" for w in found))
    return matrix.to_long(back, ["gene"], "gene", "well", "n")


@query("SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "log")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    lines = counts.select(F.concat(F.lit("      "), "event_type", F.lit(" |\t"), F.col("n").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([("   UNIQUE READS:",), ("",)], "value string")).write.text(path)
    return tf.read_log(spark, path)


@query("SELECT r_name AS section, n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "sections")
    lines = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lines.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("t")).select(F.concat(F.lit("["), "r_name", F.lit("]\n"), "t", F.lit("\n")).alias("value"))
    text.coalesce(1).write.text(path)
    return tf.read_sections(spark, path).select("section", "line")


@query("SELECT CAST(l_linenumber AS BIGINT) AS position, CAST(count(*) AS DOUBLE) AS coverage FROM lineitem GROUP BY 1")
def histogram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "histogram")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    rows = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))), lambda x: F.concat_ws("\t", x["l_linenumber"].cast("string"), x["n"].cast("string"))), "\n").alias("t"))
    rows.select(F.concat(F.lit("## METRICS\nA\tB\n1\t2\n\n## HISTOGRAM\tjava.lang.Integer\nposition\tcoverage\n"), "t", F.lit("\n\n")).alias("value")).write.text(path)
    return tf.read_histogram(spark, path).select(F.col("position").cast("long"), "coverage")


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'first' ELSE 'second' END AS sheet, s_name AS name FROM supplier""")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of the suppliers in debt and one of all suppliers, the first one's rows winning, and one sheet that isn't there."""
    path = work_path(spark, "registry")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    for sheet, rows in (("first", s.where("s_acctbal < 0")), ("second", s)):
        sinks.write_table(rows.select("id", F.lit(sheet).alias("sheet"), "name").coalesce(1), f"{path}/{sheet}")
    return tf.read_registry(spark, [f"{path}/none*/*.csv", f"{path}/first/*.csv", f"{path}/second/*.csv"], "id long, sheet string, name string", "id").select("id", "sheet", "name")


@query("SELECT well, count(*) AS n, CAST(sum(pos) AS BIGINT) AS place FROM reads GROUP BY 1")
def one_output_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "keys")
    sinks.write_by_key(reads(spark, sf_dir).select("well", "pos", "umi"), path, "well")
    return spark.read.schema("pos long, umi string, well string").parquet(path).groupBy("well").agg(F.count("*").alias("n"), F.sum("pos").alias("place"))


@query("SELECT orderkey, umi, pos FROM reads WHERE orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def keep_list_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "kept")
    keep = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("orderkey"))
    sinks.keep_reads(reads(spark, sf_dir).select("orderkey", "umi", "pos"), keep, "orderkey", path)
    return spark.read.schema("orderkey long, umi string, pos long").parquet(path)


@query(f"""
, d AS (SELECT {_ID} AS read_id, 0 AS part, pos, umi FROM reads WHERE strand = '+' UNION ALL SELECT {_ID}, 1, pos, umi FROM reads)
SELECT read_id, pos, umi FROM d QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY part, pos, umi) = 1""")
def concat_distinct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select(_read_id().alias("read_id"), "pos", "umi", "strand")
    return tf.concat_distinct([rows.where("strand = '+'").drop("strand"), rows.drop("strand")], "read_id", "pos").select("read_id", "pos", "umi")


@query(f"SELECT well, count(*) AS reads, count(DISTINCT {_ID}) AS read_ids FROM reads GROUP BY well")
def library_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("well", _read_id().alias("read_id"), "umi", F.translate("umi", "ACGT", "I5?!").alias("qual"))
    return ranking.manifest(rows, "well", "read_id", "umi", "qual").select("well", "reads", "read_ids")


@query("SELECT p_brand AS gene_id, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1")
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes from a table by its ending, joined with their parts."""
    path = work_path(spark, "genes")
    genes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_brand").alias("gene_name"), F.lit("protein_coding").alias("biotype"), F.lit("c1").alias("contig")).distinct()
    sinks.write_table(genes.coalesce(1), f"{path}.tsv")
    known = tf.read_annotation(spark, f"{path}.tsv")
    return table(spark, sf_dir, "part").join(known, F.col("p_brand") == F.col("gene_id")).groupBy("gene_id").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("price"))
