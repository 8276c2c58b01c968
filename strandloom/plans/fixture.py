"""The driver's tables seen as reads: the same columns in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS_SQL = """
  SELECT 'W' || lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') AS well,
         translate(to_base((l_orderkey * 31 + l_partkey * 7 + l_linenumber * 13) % 4096, 4, 6), '0123', 'ACGT') AS umi,
         CASE l_returnflag WHEN 'A' THEN 'HUMAN_1' WHEN 'N' THEN 'HUMAN_2' ELSE 'MOUSE_1' END AS contig,
         l_partkey * 10 + l_linenumber AS pos,
         CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
         CASE WHEN l_linenumber <= 5 THEN 'U' ELSE 'M' END AS nh,
         p_brand AS gene,
         CASE p_type WHEN 'ECONOMY' THEN 'I' WHEN 'PROMO' THEN 'R' ELSE 'E' END AS region,
         CAST(l_quantity AS BIGINT) AS span, l_partkey AS partkey, l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS lineno,
         l_suppkey % 3 AS replicate, year(l_shipdate) AS ship_year, l_suppkey AS suppkey, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part as reads. The part table isn't hinted: Spark broadcasts it where its size allows."""
    h = F.expr("(l_orderkey * 31 + l_partkey * 7 + l_linenumber * 13) % 4096")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat(F.lit("W"), F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0")).alias("well"),
        F.translate(F.lpad(F.conv(h.cast("string"), 10, 4), 6, "0"), "0123", "ACGT").alias("umi"),
        F.when(F.col("l_returnflag") == "A", "HUMAN_1").when(F.col("l_returnflag") == "N", "HUMAN_2").otherwise("MOUSE_1").alias("contig"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        F.when(F.col("l_linenumber") <= 5, "U").otherwise("M").alias("nh"),
        F.col("p_brand").alias("gene"),
        F.when(F.col("p_type") == "ECONOMY", "I").when(F.col("p_type") == "PROMO", "R").otherwise("E").alias("region"),
        F.col("l_quantity").cast("long").alias("span"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").cast("long").alias("lineno"),
        (F.col("l_suppkey") % 3).alias("replicate"),
        F.year("l_shipdate").cast("long").alias("ship_year"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("p_size").alias("size"),
    )
