"""Queries on sequences, names, alignments and mates made of the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import assays, barcodes, motifs, ranking
from ..operators import reads as rd
from .catalogue import query, r6
from .fixture import reads, table

# Alignments ---------------------------------------------------------------------------------------------------

_CIGAR = "CAST(lineno AS VARCHAR) || 'S' || CAST(span AS VARCHAR) || 'M' || CAST(size AS VARCHAR) || 'N' || CAST(lineno AS VARCHAR) || 'M2I3M1D4M'"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a CIGAR of a clip, an intron, an insertion and a deletion, and a sequence of its length."""
    rows = reads(spark, sf_dir)
    cigar = F.concat(F.col("lineno"), F.lit("S"), F.col("span"), F.lit("M"), F.col("size"), F.lit("N"), F.col("lineno"), F.lit("M2I3M1D4M"))
    length = F.col("lineno") * 2 + F.col("span") + 9
    return rows.withColumn("cigar", cigar).withColumn("seq", F.substring(F.repeat(F.col("umi"), 14), F.lit(1), length.cast("int")))


@query(f"""
SELECT well, strand, count(*) AS n, CAST(sum(span + size + lineno + 8) AS BIGINT) AS reference, CAST(sum(span + lineno + 9) AS BIGINT) AS aligned, CAST(sum(3 * 1) AS BIGINT) AS gaps,
  CAST(sum(CASE WHEN strand = '+' THEN pos ELSE pos + span + size + lineno + 8 - 1 END) AS BIGINT) AS anchor FROM reads GROUP BY 1, 2""")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _aligned(spark, sf_dir), F.col("cigar")
    return rows.groupBy("well", "strand").agg(
        F.count("*").alias("n"),
        F.sum(sq.cigar_sum(c, "MDN=X")).alias("reference"),
        F.sum(sq.cigar_sum(c, "MI=X")).alias("aligned"),
        F.sum(sq.cigar_sum(c, "ID")).alias("gaps"),
        F.sum(sq.five_prime(F.col("pos"), c, F.col("strand"))).alias("anchor"),
    )


@query("""
, b AS (SELECT well, unnest([{'s': pos, 'e': pos + span}, {'s': pos + span + size, 'e': pos + span + size + lineno + 8}]) AS x FROM reads)
SELECT well, count(*) AS blocks, CAST(sum(x.s) AS BIGINT) AS starts, CAST(sum(x.e) AS BIGINT) AS ends FROM b GROUP BY well""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir).select("well", F.explode(sq.aligned_blocks(F.col("pos"), F.col("cigar"))).alias("x"))
    return rows.groupBy("well").agg(F.count("*").alias("blocks"), F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


@query("""SELECT contig, pos + span AS s, pos + span + size AS e, count(*) AS n FROM reads GROUP BY 1, 2, 3""")
def cigar_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir).select("contig", F.explode(sq.introns_of(F.col("pos"), F.col("cigar"))).alias("x"))
    return rows.groupBy("contig", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e")).agg(F.count("*").alias("n"))


@query("""
SELECT umi, lineno, span, substr(repeat(umi, 14), lineno + 1, span + lineno + 9) AS bases, substr(repeat(umi, 14), lineno + 1, 1) AS first, substr(repeat(umi, 14), lineno + span + 1, 1) AS behind_intron, count(*) AS n FROM reads GROUP BY ALL""")
def aligned_query_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, s, c, p = _aligned(spark, sf_dir), F.col("seq"), F.col("cigar"), F.col("pos")
    at = lambda place: ranking.base_at(s, c, p, place)
    return rows.groupBy("umi", "lineno", "span", sq.aligned_query(s, c).alias("bases"), at(p).alias("first"), at(p + F.col("span") + F.col("size")).alias("behind_intron")).agg(F.count("*").alias("n"))


@query("SELECT well, round(CAST(sum(lineno % 3) + 3 * count(*) AS DOUBLE) / sum(span + lineno + 10), 6) AS error_rate FROM reads GROUP BY well")
def alignment_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir).withColumn("mismatches", F.col("lineno") % 3)
    return rd.error_rate(rows, ["well"], "cigar", "mismatches").select("well", r6(F.col("error_rate")).alias("error_rate"))


@query("""
, f AS (SELECT well, count(DISTINCT umi) AS fragments, CAST(sum(span + lineno + 9) AS BIGINT) AS bases, count(*) AS n FROM reads GROUP BY well)
SELECT well, bases, round(bases / n, 6) AS per_read, fragments, round(bases / fragments, 6) AS per_fragment, CASE WHEN fragments >= 50 THEN round(bases / fragments * 50, 6) END AS at_depth FROM f""")
def aligned_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assays.aligned_bases(_aligned(spark, sf_dir), ["well"], "cigar", "umi", 50)
    return out.select("well", "bases", r6(F.col("per_read")).alias("per_read"), "fragments", r6(F.col("per_fragment")).alias("per_fragment"), r6(F.col("at_depth")).alias("at_depth"))


@query("SELECT CAST(floor(least(span * size, 500) / 25.0) * 25 AS BIGINT) AS bin, count(*) AS reads FROM reads WHERE nh = 'U' GROUP BY 1")
def extent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("d", F.when(F.col("nh") == "U", F.col("span") * F.col("size")))
    return rd.extent_histogram(rows, "d", 25, 500)


# Mates --------------------------------------------------------------------------------------------------------

_MATES = """, k AS (SELECT orderkey * 10 + lineno AS read, 64 AS flag, max(pos) AS pos, max(span) AS span FROM reads GROUP BY 1 UNION ALL SELECT orderkey * 10 + lineno, 128, max(pos) + 200, max(size) FROM reads WHERE strand = '+' GROUP BY 1),
  m AS (SELECT read, max(pos) FILTER (flag = 64) AS p1, max(span) FILTER (flag = 64) AS s1, max(pos) FILTER (flag = 128) AS p2, max(span) FILTER (flag = 128) AS s2 FROM k GROUP BY read)"""


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("read", F.col("orderkey") * 10 + F.col("lineno"))
    one = rows.groupBy("read").agg(F.max("pos").alias("pos"), F.max("span").alias("span")).withColumn("flag", F.lit(64 + 1))
    two = rows.where("strand = '+'").groupBy("read").agg((F.max("pos") + 200).alias("pos"), F.max("size").cast("long").alias("span")).withColumn("flag", F.lit(128 + 1))
    return rd.paired_mates(one.unionByName(two), "read", ["pos", "span"])


@query(_MATES + " SELECT read, p1, p2 FROM m")
def paired_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mates(spark, sf_dir).select("read", F.col("m1.pos").alias("p1"), F.col("m2.pos").alias("p2"))


@query(_MATES + " SELECT read, CAST(least(greatest(abs(p2 + s2 - p1) - least(200, s1 + 60) + s1, 0), 1500) AS BIGINT) AS insert FROM m WHERE p2 IS NOT NULL")
def genomic_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first mate has an intron of up to 200 - span that the insert doesn't count."""
    m = _mates(spark, sf_dir).where("m2 is not null")
    p1, s1, p2, s2 = (F.col(x) for x in ("m1.pos", "m1.span", "m2.pos", "m2.span"))
    intron = F.least(F.lit(200), s1 + 60) - s1
    c1, c2 = F.concat(s1, F.lit("M"), intron, F.lit("N5M")), F.concat(s2, F.lit("M"))
    return m.select("read", rd.genomic_insert(p2 + s2 - p1, p1, c1, p2, c2).cast("long").alias("insert"))


@query("SELECT a.well, count(*) AS pairs, CAST(sum(abs(a.pos - b.pos) + 1) FILTER (a.gene = b.gene) AS BIGINT) AS inserts FROM (SELECT well, orderkey, max(pos) AS pos, max(gene) AS gene FROM reads WHERE lineno = 1 GROUP BY 1, 2) a JOIN (SELECT well, orderkey, max(pos) AS pos, max(gene) AS gene FROM reads WHERE lineno = 2 GROUP BY 1, 2) b USING (well, orderkey) GROUP BY a.well")
def transcript_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: reads(spark, sf_dir).where(F.col("lineno") == k).groupBy("well", "orderkey").agg(F.max("pos").alias(f"p{k}"), F.max("gene").alias(f"g{k}"))
    both = side(1).join(side(2), ["well", "orderkey"])
    return both.groupBy("well").agg(F.count("*").alias("pairs"), F.sum(rd.transcript_insert(F.col("p1"), F.col("p2"), F.col("g1"), F.col("g2"))).alias("inserts"))


# Calls and structures -----------------------------------------------------------------------------------------

_ANCHOR, _FOUR = "CAGT", ["ACGT", "TTGA", "CCCC", "GATA"]
_LIST = "[" + ", ".join(f"'{c}'" for c in _FOUR) + "]"


@query(f"""
, s AS (SELECT DISTINCT umi, umi || '{_ANCHOR}' || 'GGGG' || umi AS seq FROM reads), p AS (SELECT umi, seq, CAST(unnest(range(4, length(seq) - 3)) AS BIGINT) AS i FROM s),
  h AS (SELECT umi, seq, i, substr(seq, i - 3, 4) AS w FROM p WHERE substr(seq, i + 1, 4) = '{_ANCHOR}'), d AS (SELECT umi, seq, i, c, hamming(w, c) AS dist FROM h, (SELECT unnest({_LIST}) AS c)),
  b AS (SELECT umi, seq, i, min(dist) AS dist, arg_min(c, dist) AS code, count(*) FILTER (dist = m) AS n FROM (SELECT *, min(dist) OVER (PARTITION BY umi, seq, i) AS m FROM d) GROUP BY 1, 2, 3),
  g AS (SELECT *, length(regexp_extract(substr(seq, i + 5, 12), '^G*', 0)) >= 3 AS ggg FROM b WHERE dist <= 1 AND n = 1),
  best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY umi ORDER BY ggg DESC, dist, i) = 1)
SELECT s.umi, code, CAST(dist AS BIGINT) AS mismatches, i AS place FROM s LEFT JOIN best USING (umi)""")
def anchored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat("umi", F.lit(_ANCHOR + "GGGG"), "umi"))
    call = s.withColumn("call", barcodes.call_anchored(F.col("seq"), _ANCHOR, _FOUR))
    return call.select("umi", "call.code", (-F.col("call.exact")).cast("long").alias("mismatches"), (-F.col("call.at")).cast("long").alias("place"))


@query(f"""
, s AS (SELECT DISTINCT umi, 'AACCGGTT' || umi || 'GGG' AS seq FROM reads), p AS (SELECT umi, seq, CAST(unnest(range(6, length(seq) - 3)) AS BIGINT) AS i FROM s),
  t AS (SELECT *, (SELECT max(k) FROM (SELECT unnest(range(0, 9)) AS k) WHERE k <= i AND right(left(seq, i), k) = right('AACCGGTT', k)) AS tail FROM p),
  d AS (SELECT umi, seq, i, tail, c, levenshtein(substr(seq, i + 1, 4), c) AS dist FROM t, (SELECT unnest({_LIST}) AS c) WHERE tail >= 6),
  b AS (SELECT umi, seq, i, tail, min(dist) AS dist, min(c) FILTER (dist = m) AS code, count(*) FILTER (dist = m) AS n FROM (SELECT *, min(dist) OVER (PARTITION BY umi, i) AS m FROM d) GROUP BY 1, 2, 3, 4),
  best AS (SELECT *, tail + CASE WHEN substr(seq, i + 5, 3) = 'GGG' THEN 100 ELSE 0 END AS score FROM b WHERE dist <= 1 AND n = 1 QUALIFY row_number() OVER (PARTITION BY umi ORDER BY score DESC, i) = 1)
SELECT s.umi, CAST(score AS BIGINT) AS score, code FROM s LEFT JOIN best USING (umi)""")
def backbone_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat(F.lit("AACCGGTT"), "umi", F.lit("GGG")))
    call = s.withColumn("call", motifs.backbone_call(F.col("seq"), "AACCGGTT", _FOUR))
    return call.select("umi", F.col("call.score").cast("long").alias("score"), "call.code")


@query("""
, s AS (SELECT DISTINCT umi, umi || 'GATTACA' || umi || 'TTTTTT' AS seq FROM reads), t AS (SELECT *, length(umi) - length(replace(umi, 'T', '')) + 6 AS t FROM s)
SELECT umi, CASE WHEN t >= 9 THEN umi END AS code, CASE WHEN t >= 9 THEN CAST(t AS BIGINT) END AS t_rich FROM t""")
def polyt_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat("umi", F.lit("GATTACA"), "umi", F.lit("TTTTTT")))
    found = s.withColumn("x", assays.polyt_structure(F.col("seq"), "GATTACA"))
    return found.select("umi", "x.code", F.col("x.t_rich").cast("long").alias("t_rich"))


@query("""
, s AS (SELECT DISTINCT umi FROM reads), x AS (SELECT umi, umi || 'TTAA' || umi || 'AAAAAAAAAAAA' || umi AS seq FROM s)
SELECT umi, regexp_replace(seq, 'A{10,}.*$', '') AS cut, left(seq, 9) AS short, CASE WHEN length(umi) < 40 THEN 'short' END AS tail FROM x""")
def trimmed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat("umi", F.lit("TTAA"), "umi", F.lit("AAAAAAAAAAAA"), "umi"))
    return x.select("umi", sq.cut_at_run(F.col("seq")).alias("cut"), F.substring("seq", 1, 9).alias("short"), rd.tail_class(F.col("umi"), "ACGT").alias("tail"))


@query("""
, s AS (SELECT DISTINCT umi FROM reads), x AS (SELECT umi, 'GATTACAGATTACA' || repeat(umi, 8) || 'CNGGTNCCGNTT' AS seq FROM s)
SELECT umi, repeat(umi, 8) AS inside FROM x WHERE position('GATTACAGATTACA' IN umi) = 0""")
def trimmed_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat(F.lit("GATTACAGATTACA"), F.repeat("umi", 8), F.lit("CNGGTNCCGNTT")))
    return x.select("umi", sq.trim_flanks(F.col("seq"), "GATTACAGATTACA", "CNGGTNCCGNTT", 40).alias("inside"))


@query("""
SELECT well || '_' || umi || '_' || CAST(lineno AS VARCHAR) AS name, umi AS tag, well AS head, CASE WHEN contig LIKE 'HUMAN%' THEN 'human' ELSE 'mouse' END AS species, 'chr' || contig AS track, count(*) AS n FROM reads GROUP BY ALL""")
def packed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = sq.pack_name(F.col("well"), F.col("umi"), F.col("lineno").cast("string"))
    rows = reads(spark, sf_dir).withColumn("name", name)
    return rows.groupBy("name", sq.name_part(F.col("name"), 2).alias("tag"), sq.name_head(F.col("name"), 2).alias("head"), sq.species_of(F.col("contig")).alias("species"), sq.track_contig(F.col("contig")).alias("track")).agg(F.count("*").alias("n"))


@query(r"""
, x AS (SELECT DISTINCT gene, replicate, gene || ' (' || well || ')/-' || CAST(replicate AS VARCHAR) AS raw, gene || '-' || CAST(replicate AS VARCHAR) AS sample FROM reads)
SELECT raw, trim(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '_') AS safe, sample, gene AS condition, CAST(replicate AS BIGINT) AS replicate FROM x""")
def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("gene", "well", "replicate").distinct()
    rows = rows.select(F.concat("gene", F.lit(" ("), "well", F.lit(")/-"), "replicate").alias("raw"), F.concat("gene", F.lit("-"), "replicate").alias("sample"))
    return rows.select("raw", sq.safe_name(F.col("raw")).alias("safe"), "sample", sq.condition_of(F.col("sample")).alias("condition"), sq.replicate_of(F.col("sample")).cast("long").alias("replicate"))


@query("""
SELECT orderkey, lineno, partkey, suppkey, lineno AS lane, 1100 + replicate AS tile, partkey AS x, suppkey AS y, (lineno << 56) | ((1100 + replicate) << 40) | (partkey << 20) | suppkey AS packed, count(*) AS n FROM reads GROUP BY ALL""")
def flow_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("M1:7:FC:"), F.col("lineno"), F.lit(":"), F.col("replicate") + 1100, F.lit(":"), F.col("partkey"), F.lit(":"), F.col("suppkey"), F.lit(" 1:N:0"))
    rows = reads(spark, sf_dir).withColumn("p", sq.flow_position(name)).select("orderkey", "lineno", "partkey", "suppkey", "p.*")
    rows = rows.withColumn("packed", sq.packed_position(*(F.col(c) for c in ("lane", "tile", "x", "y"))))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("""
SELECT contig || ':' || gene || ':t:' || CAST(pos AS VARCHAR) AS lsv, gene, 't' AS side, pos AS anchor, contig || ':' || CAST(pos AS VARCHAR) || '-' || CAST(pos + span AS VARCHAR) || ':' || strand AS junction, contig AS chrom, pos AS start, pos + span AS "end", strand, count(*) AS n FROM reads GROUP BY ALL""")
def junction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    row_id = F.concat("contig", F.lit(":"), "gene", F.lit(":t:"), "pos", F.lit("|"), "contig", F.lit(":"), "pos", F.lit("-"), F.col("pos") + F.col("span"), F.lit(":"), "strand")
    rows = reads(spark, sf_dir).select(sq.junction_parts(row_id).alias("p")).select("p.*")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("""
, x AS (SELECT umi, span, size, lineno FROM reads)
SELECT count(*) FILTER (span - lineno >= 30) AS long_enough, count(*) FILTER (abs(span - size) <= 5 OR (span < size AND span + 5 >= size)) AS fits, count(*) FILTER (span BETWEEN 10 AND 30) AS within FROM x""")
def insert_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    return rows.agg(F.count_if(rd.long_enough(F.col("span"), F.col("lineno"))).alias("long_enough"), F.count_if(rd.distance_fits(F.col("span"), F.col("size"), 5)).alias("fits"), F.count_if(F.col("span").between(10, 30)).alias("within"))


@query("SELECT well, gene, umi, count(*) AS n FROM reads WHERE CASE WHEN gene = 'Brand#11' THEN regexp_matches(umi, '^A') WHEN gene = 'Brand#12' THEN regexp_matches(umi, 'GG') ELSE true END GROUP BY ALL")
def rule_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("Brand#11", "^A"), ("Brand#12", "GG"), ("Brand#99", "x")], "gene string, pattern string")
    return rd.matches_rule(reads(spark, sf_dir).select("well", "gene", "umi"), rules, "gene", "umi").groupBy("well", "gene", "umi").agg(F.count("*").alias("n"))


@query("""
, s AS (SELECT umi, 'AAC' || umi || 'CAG' AS seq FROM reads), c AS (SELECT substr(seq, position('AAC' IN seq) + 3, 4) AS code FROM s WHERE position('AAC' IN seq) > 0), t AS (SELECT code, count(*) AS reads FROM c GROUP BY code)
SELECT * FROM t WHERE code IN ('ACGT', 'TTGA', 'CCCC', 'GATA') AND reads >= greatest(2, 0.002 * (SELECT count(*) FROM reads))""")
def anchored_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).withColumn("seq", F.concat(F.lit("AAC"), "umi", F.lit("CAG")))
    return barcodes.anchored_code_counts(s, "seq", "AAC", _FOUR, 2)


@query(", c AS (SELECT gene, count(*) AS n FROM reads GROUP BY gene) SELECT gene, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, gene LIMIT 1")
def modal_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.modal_string(reads(spark, sf_dir), "gene", 0.0).withColumn("share", r6(F.col("share")))


@query("SELECT round(avg(CAST(contains(umi, 'ACG') OR contains(umi, 'TTT') AS INTEGER)), 6) AS share, avg(CAST(contains(umi, 'ACG') OR contains(umi, 'TTT') AS INTEGER)) >= 0.1 AS enough FROM reads")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.evidence(reads(spark, sf_dir), "umi", ["ACG", "TTT"], 0.1).withColumn("share", r6(F.col("share")))


@query("""
, s AS (SELECT DISTINCT umi, 'CC' || umi || 'GATTACAG' || umi AS seq FROM reads)
SELECT umi, CASE WHEN len(regexp_extract_all(seq, 'GATTACAG')) = 1 THEN substr(seq, 7, 16) END AS around FROM s""")
def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat(F.lit("CC"), "umi", F.lit("GATTACAG"), "umi"))
    return s.select("umi", motifs.code_window(F.col("seq"), "GATTACAG", 2, 6).alias("around"))


@query("""
, s AS (SELECT DISTINCT umi, 'CAGTCAGT' || umi || 'AACCAACC' || umi || 'CAGTCAGT' AS seq FROM reads)
SELECT umi, 6 AS gap, 'B > A > B' AS structure FROM s WHERE NOT regexp_matches(umi, 'ZZ')""")
def read_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().withColumn("seq", F.concat(F.lit("CAGTCAGT"), "umi", F.lit("AACCAACC"), "umi", F.lit("CAGTCAGT")))
    parts = motifs.components_of(F.col("seq"), {"A": "AACCAACC", "B": "CAGTCAGT"})
    return s.withColumn("p", parts).select("umi", motifs.largest_gap(F.col("p"), F.length("seq")).alias("gap"), motifs.structure_key(F.col("p"), "B").alias("structure"))


@query("""
, s AS (SELECT umi, 'CCGGCC' || repeat(umi, 6) || 'AAAAAAAAAAAA' AS seq FROM (SELECT DISTINCT umi FROM reads) WHERE NOT contains(repeat(umi, 2), 'CCGGCC') AND NOT ends_with(umi, 'A') AND NOT regexp_matches(umi, '^T+$'))
SELECT umi, repeat(umi, 6) AS insert, umi AS context FROM s""")
def insert_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("umi").distinct().where(~F.repeat("umi", 2).contains("CCGGCC") & ~F.col("umi").endswith("A") & ~F.col("umi").rlike("^T+$"))
    seq = F.concat(F.lit("CCGGCC"), F.repeat("umi", 6), F.lit("A" * 12))
    context = F.concat(F.lit("GATTACA"), "umi", F.lit("TGTAATC"))
    return s.select("umi", motifs.insert_between(seq, "CCGGCC", "GATTACA").alias("insert"), motifs.context_code(context, "GATTACA", "TGTAATC", 6).alias("context"))


@query("""
, u AS (SELECT orderkey, list(umi ORDER BY lineno, pos, umi)[1:3] AS units FROM reads GROUP BY orderkey), e AS (SELECT unnest(units) AS u FROM u), k AS (SELECT u, count(*) AS k FROM e GROUP BY u)
SELECT count(*) FILTER (len(units) = 0) AS none, count(*) FILTER (len(units) = 1) AS one, count(*) FILTER (len(units) = 2) AS two, count(*) FILTER (len(units) >= 3) AS more, count(*) FILTER (len(units) = 2 AND units[1] = units[2]) AS same,
  count(*) FILTER (len(units) = 2 AND units[1] <> units[2]) AS different, (SELECT round(1 - sum(k * k) / (sum(k) * sum(k)), 6) FROM k) AS expected_different FROM u""")
def unit_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = reads(spark, sf_dir).groupBy("orderkey").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "pos", "umi"))), lambda x: x["umi"]), 1, 3).alias("units"))
    return motifs.multiplicity(u, "units").withColumn("expected_different", r6(F.col("expected_different")))


@query("""
, s AS (SELECT well, repeat('C', CAST(span AS INTEGER)) || 'AGAGAG' || umi || 'TCTCTC' AS seq, umi FROM reads)
SELECT well, count(*) AS reads, count(*) AS empty, count(*) AS without_tail FROM s GROUP BY well""")
def adapter_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select("well", F.concat(F.repeat(F.lit("C"), F.col("span").cast("int")), F.lit("AGAGAG"), "umi", F.lit("TCTCTC")).alias("seq"))
    return assays.artefacts(s, "seq", ["well"], ("AGAGAG", "TCTCTC")).select("well", "reads", "empty", "without_tail")


@query("""
, s AS (SELECT left(seq, 40) AS head, right(seq, 40) AS tail FROM (SELECT umi || 'CACACA' || repeat(umi, 12) || 'GTGTGT' || well AS seq FROM reads)),
  e AS (SELECT 'start' AS "end", CASE WHEN position('CACACA' IN head) > 0 AND (position('GTGTGT' IN head) = 0 OR position('CACACA' IN head) < position('GTGTGT' IN head)) THEN 'a' WHEN position('GTGTGT' IN head) > 0 THEN 'g' ELSE 'none' END AS element FROM s
    UNION ALL SELECT 'end', CASE WHEN position(reverse('GTGTGT') IN reverse(tail)) > 0 AND (position(reverse('CACACA') IN reverse(tail)) = 0 OR position(reverse('GTGTGT') IN reverse(tail)) <= position(reverse('CACACA') IN reverse(tail))) THEN 'g' WHEN position(reverse('CACACA') IN reverse(tail)) > 0 THEN 'a' ELSE 'none' END FROM s)
SELECT "end", element, count(*) AS reads FROM e GROUP BY 1, 2""")
def read_end_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads(spark, sf_dir).select(F.concat("umi", F.lit("CACACA"), F.repeat("umi", 12), F.lit("GTGTGT"), "well").alias("seq"))
    return assays.end_elements(s, "seq", {"a": "CACACA", "g": "GTGTGT"}, 40)


@query("""
, w AS (SELECT gene, repeat(umi, 4) AS s FROM reads)
SELECT gene, count(*) AS windows, round(avg((length(s) - length(replace(s, 'A', ''))) / length(s)), 6) AS a, round(avg((length(s) - length(replace(s, 'T', ''))) / length(s)), 6) AS t,
  round(avg(CAST(list_max(list_transform(range(1, 14), lambda i: length(substr(s, i, 12)) - length(replace(substr(s, i, 12), 'A', '')))) >= 9 AS INTEGER)), 6) AS a_rich FROM w GROUP BY gene""")
def window_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reads(spark, sf_dir).select("gene", F.repeat("umi", 4).alias("s"))
    return assays.window_composition(w, "s", ["gene"]).select("gene", "windows", *(r6(F.col(c)).alias(c) for c in ("a", "t", "a_rich")))


@query("""
SELECT well, count(*) FILTER (contig LIKE 'HUMAN%' OR contig LIKE 'MOUSE%') AS called, count(*) FILTER (contig LIKE 'HUMAN%') AS "right", round(100.0 * count(*) FILTER (contig LIKE 'HUMAN%') / count(*), 6) AS expected_pct,
  round(100.0 * count(*) FILTER (contig LIKE 'HUMAN%' AND region <> 'R') / count(*) FILTER (region <> 'R'), 6) AS expected_no_rdna_pct FROM reads GROUP BY well""")
def expected_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).withColumn("species", sq.species_of(F.col("contig"))).withColumn("expected", F.lit("human"))
    out = assays.expected_species(rows, ["well"], "species", "expected", F.col("region") == "R")
    return out.select("well", "called", "right", *(r6(F.col(c)).alias(c) for c in ("expected_pct", "expected_no_rdna_pct")))


@query("SELECT p_type AS text, CAST(3 AS BIGINT) AS codes, 'BC01' AS first, CAST(4 AS BIGINT) AS plot, 'low: few' AS note, count(*) AS n FROM part GROUP BY 1")
def barcode_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("text"), F.concat("p_type", F.lit(" BC01(#4) and BC07(#2), BC11(#9)")).alias("l"), F.concat(F.lit("BC01: low: few | BC02: "), "p_type").alias("m"))
    rows = rows.withColumn("c", ranking.barcode_list(F.col("l"))).withColumn("notes", ranking.barcode_notes(F.col("m")))
    return rows.groupBy("text", F.size("c").cast("long").alias("codes"), F.col("c")[0]["code"].alias("first"), F.col("c")[0]["plot"].cast("long").alias("plot"), F.col("notes")["BC01"].alias("note")).agg(F.count("*").alias("n"))


@query("""
, e AS (SELECT DISTINCT umi AS name, umi AS seq FROM reads), b AS (SELECT name, seq, 0 AS d FROM e UNION ALL SELECT name || '_rc', reverse(translate(seq, 'ACGT', 'TGCA')), 1 FROM e)
SELECT name, seq FROM b QUALIFY row_number() OVER (PARTITION BY seq ORDER BY d, name) = 1""")
def derived_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reads(spark, sf_dir).select(F.col("umi").alias("name"), F.col("umi").alias("seq")).distinct()
    return ranking.derived_sequences(e, "name", "seq")


@query("""
, p AS (SELECT DISTINCT umi, 'A-' || umi AS a, reverse(umi) || '-C' AS b FROM reads), i AS (SELECT umi, i, substr(a, i + 1, 1) AS a, substr(b, i + 1, 1) AS b FROM p, (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS i)),
  c AS (SELECT *, coalesce(sum(CAST(a <> '-' AS INTEGER)) OVER w, 0) AS a_pos, coalesce(sum(CAST(b <> '-' AS INTEGER)) OVER w, 0) AS b_pos FROM i WINDOW w AS (PARTITION BY umi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT umi, CAST(a_pos AS BIGINT) AS a_pos, CAST(b_pos AS BIGINT) AS b_pos, a, b FROM c WHERE a <> b AND a <> '-' AND b <> '-'""")
def aligned_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reads(spark, sf_dir).select("umi").distinct().select("umi", F.concat(F.lit("A-"), "umi").alias("x"), F.concat(F.reverse("umi"), F.lit("-C")).alias("y"))
    return ranking.aligned_sites(p, ["umi"], "x", "y")


@query("""
, x AS (SELECT DISTINCT umi AS seq FROM reads), d AS (SELECT seq, i, c, hamming(substr(seq, i + 1, 4), c) AS dist FROM x, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS i), (SELECT unnest(['ACGT', 'TTGA', 'CCCC', 'GATA']) AS c)),
  h AS (SELECT seq, i, c FROM d WHERE dist <= 1 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY i, dist, c) = 1)
SELECT x.seq, i AS place, c AS index FROM x LEFT JOIN h USING (seq)""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads(spark, sf_dir).select(F.col("umi").alias("seq")).distinct().withColumn("hit", ranking.index_in(F.col("seq"), _FOUR))
    return x.select("seq", F.col("hit.at").cast("long").alias("place"), "hit.index")
