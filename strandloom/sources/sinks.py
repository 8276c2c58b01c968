"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fastq(reads: DataFrame, path: str, name: str = "read_id", seq: str = "seq", qual: str = "qual", compression: str = "gzip") -> None:
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.lit("+"), qual).alias("value")).write.text(path, compression=compression)


def write_by_key(rows: DataFrame, path: str, key: str, max_records: int = 5_000_000) -> None:
    """One folder for each key, many files for a large one."""
    rows.repartition(key, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.option("maxRecordsPerFile", max_records).partitionBy(key).parquet(path)


def write_table(rows: DataFrame, path: str, provenance: dict[str, str] | None = None) -> None:
    """Tab-separated with a header, and a sidecar of provenance."""
    rows.write.csv(path, sep="\t", header=True, emptyValue="")
    if provenance is not None:
        rows.sparkSession.createDataFrame([(k, str(v)) for k, v in provenance.items()], "key string, value string").write.json(f"{path}.provenance")


def write_bed(rows: DataFrame, path: str, contig: str, start: str, end: str, name: str, effect: str, strand: str) -> None:
    """BED6 with the score 1000 times the effect, from 0 to 1000."""
    score = F.greatest(F.lit(0), F.least(F.lit(1000), F.round(1000 * F.col(effect)))).cast("int")
    rows.select(contig, start, end, name, score.alias("score"), strand).write.csv(path, sep="\t")


def keep_reads(reads: DataFrame, keep: DataFrame, read: str, path: str) -> None:
    """The reads of a keep list, to a new place: what was read stays as it is."""
    reads.join(keep.select(read).distinct(), read, "left_semi").write.parquet(path)
