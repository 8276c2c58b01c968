"""Readers of the text formats of sequencing, into columns. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import written

SAM_FIELDS = ("qname string", "flag int", "contig string", "pos long", "mapq int", "cigar string", "rnext string", "pnext long", "tlen long", "seq string", "qual string")
GTF_FIELDS = ("contig string", "source string", "feature string", "start long", "end long", "score string", "strand string", "frame string", "attributes string")


def resolve(spark: SparkSession, patterns: str) -> list[str]:
    """Files of patterns separated by ';', in order; a pattern without a file is an error."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for pattern in filter(None, (p.strip() for p in patterns.split(";"))):
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        if not found:
            raise FileNotFoundError(pattern)
        out += sorted(str(f.getPath().toString()) for f in found)
    return out


FASTQ_FIELDS = "path string, index long, read_id string, seq string, qual string"
#: Blocks of text whose places are sent to all tasks (about 100 bytes each); with more of them lines are dealt by a shuffle instead.
MOST_BLOCKS = 100_000
#: Records that are dealt together by that shuffle.
DEALT_RECORDS = 100_000


#: White space as str.split() takes it.
_WHITE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HEAD = f"^@[{_WHITE}]*(?P<id>[^{_WHITE}]+)"


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.Array]]:
    """Lines in stretches of equal `names`, and those."""
    n = len(batch)
    new = np.zeros(max(n - 1, 0), bool)
    for c in names:
        column = batch.column(c)
        new |= pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(new) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, n]):
        if b > a:
            yield tuple(batch.column(c)[a].as_py() for c in names), batch.column("value").slice(a, b - a)


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of lines (path, start, value) that come in order: how many they are, and the first and last three."""
    key, n, head, tail = None, 0, [], []

    def row() -> pa.RecordBatch:
        ends = [pa.array([x], pa.list_(pa.string())) for x in (head, tail)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()), *ends], ["path", "start", "n", "head", "tail"])

    for batch in batches:
        for own, lines in _runs(batch, ["path", "start"]):
            if own != key:
                if key:
                    yield row()
                key, n, head, tail = own, 0, [], []
            n += len(lines)
            head = (head + lines.slice(0, 3).to_pylist())[:3]
            tail = (tail + lines.slice(max(0, len(lines) - 3)).to_pylist())[-3:]
    if key:
        yield row()


def _record_batch(path: str, first: int, lines: pa.Array) -> pa.RecordBatch:
    """As fastq_records(), for many lines."""
    heads, seqs, pluses, quals = (lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4))
    ids = pc.struct_field(pc.extract_regex(heads, _HEAD), "id")
    fine = pc.and_(pc.and_(ids.is_valid(), pc.starts_with(pluses, "+")), pc.equal(pc.utf8_length(seqs), pc.utf8_length(quals)))
    if not pc.all(fine).as_py():
        raise ValueError(f"{path}: record {first + pc.index(fine, False).as_py()} isn't FASTQ")
    n = len(heads)
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(first, first + n)), ids, seqs, quals], ["path", "index", "read_id", "seq", "qual"])


def fastq_records(path: str, first: int, lines: list[str]) -> pd.DataFrame:
    """Records number `first` and on from lines in fours."""
    heads, seqs, pluses, quals = (lines[k::4] for k in range(4))
    for i, (head, seq, plus, qual) in enumerate(zip(heads, seqs, pluses, quals)):
        if head[:1] != "@" or not head[1:].split() or plus[:1] != "+" or len(seq) != len(qual):
            raise ValueError(f"{path}: record {first + i} isn't FASTQ")
    return pd.DataFrame({"path": path, "index": range(first, first + len(heads)), "read_id": [h[1:].split()[0] for h in heads], "seq": seqs, "qual": quals})


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one block, from lines (path, start, before, value) in order; `before` lines of the file come before the block."""
    key, index, skip, rest = None, 0, 0, None
    for batch in batches:
        for (path, start, before), lines in _runs(batch, ["path", "start", "before"]):
            if (path, start) != key:
                key, index, skip, rest = (path, start), -(-before // 4), -before % 4, lines.slice(0, 0)
            skip, lines = max(0, skip - len(lines)), lines.slice(min(skip, len(lines)))
            rest = pa.concat_arrays([rest, lines])
            whole = len(rest) - len(rest) % 4
            if whole:
                yield _record_batch(path, index, rest.slice(0, whole))
            index, rest = index + whole // 4, rest.slice(whole)


def _file_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of files that are one block each, from their lines (path, value) in order."""
    key, index, rest = None, 0, None

    def ended() -> None:
        if key and len(rest):
            raise ValueError(f"{key}: record {index} isn't FASTQ")

    for batch in batches:
        for (path,), lines in _runs(batch, ["path"]):
            if path != key:
                ended()
                key, index, rest = path, 0, lines.slice(0, 0)
            rest = pa.concat_arrays([rest, lines])
            whole = len(rest) - len(rest) % 4
            if whole:
                yield _record_batch(path, index, rest.slice(0, whole))
            index, rest = index + whole // 4, rest.slice(whole)
    ended()


def _cut_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records that lie in several blocks, from their lines: path, record, lines (n, value)."""
    for pdf in batches:
        for path, record, lines in zip(pdf["path"], pdf["record"], pdf["lines"]):
            if len(lines) != 4:
                raise ValueError(f"{path}: record {record} isn't FASTQ")
            yield fastq_records(path, record, [x["value"] for x in sorted(lines, key=lambda x: x["n"])])


def _dealt_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records from lines (path, n, value) that are sorted; those of a record follow each other."""
    rest = pd.DataFrame()
    for pdf in batches:
        rest = pd.concat([rest, pdf])
        new = (rest["path"] != rest["path"].shift()) | (rest["n"] % 4 == 0)
        last = int(np.flatnonzero(new.to_numpy())[-1]) if new.any() else 0
        ready, rest = rest.iloc[:last], rest.iloc[last:]
        yield from _in_fours(ready)
    yield from _in_fours(rest)


def _in_fours(lines: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(lines):
        n, path = lines["n"].to_numpy(), lines["path"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(n) != 1) | (path[1:] != path[:-1])) + 1).tolist(), len(n)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if n[a] % 4 or (b - a) % 4:
                raise ValueError(f"{path[a]}: record {n[b - 1] // 4} isn't FASTQ")
            yield fastq_records(path[a], int(n[a]) // 4, lines["value"].iloc[a:b].tolist())


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, index, read_id, seq and qual of four-line records. Text after the id's first space is dropped; other lines fail the run.

    Plain files are read in the blocks of spark.sql.files.maxPartitionBytes, each by a task of its own; a gzipped file can't be cut and is one block. Where all are gzipped each is read
    once, by one task. Else a first job counts each block's lines and keeps its first and last three. So every task knows which line of a record its block begins with, whatever a quality line looks like,
    and the number of its first record; records over a border are put together from those ends. Lines have no other order than their place in a
    block, so where the table of blocks is too large to send to all tasks, lines are numbered and dealt by a shuffle instead.
    """
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(paths).select(block.alias("block"), "value").select("block.path", "block.start", "value")
    if all(f.endswith(".gz") for f in lines.inputFiles()):
        return lines.select("path", "value").mapInArrow(_file_records, FASTQ_FIELDS)
    ends = written(lines.mapInArrow(_block_ends, "path string, start long, n long, head array<string>, tail array<string>"), "blocks")
    order = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    if ends.count() > MOST_BLOCKS:
        placed = lines.withColumn("at", F.monotonically_increasing_id())
        first = placed.groupBy("path", "start").agg(F.min("at").alias("first"))
        known = placed.join(first.join(blocks.select("path", "start", "before"), ["path", "start"]), ["path", "start"])
        numbered = known.select("path", (F.col("before") + F.col("at") - F.col("first")).alias("n"), "value")
        return numbered.repartition("path", F.floor(F.col("n") / (4 * DEALT_RECORDS))).sortWithinPartitions("path", "n").mapInPandas(_dealt_records, FASTQ_FIELDS)
    whole = lines.join(F.broadcast(blocks.select("path", "start", "before")), ["path", "start"]).select("path", "start", "before", "value").mapInArrow(_whole_records, FASTQ_FIELDS)
    after = F.col("before") + F.col("n")
    at_head, at_tail = F.least(F.pmod(-F.col("before"), F.lit(4)), F.col("n")).cast("int"), F.least(after % 4, F.col("n")).cast("int")
    place = lambda ends, first: F.transform(ends, lambda x, i: F.struct((first + i).alias("n"), x.alias("value")))
    head = place(F.slice("head", F.lit(1), at_head), F.col("before"))
    tail = place(F.slice("tail", F.size("tail") - at_tail + 1, at_tail), after - at_tail)
    pieces = blocks.select("path", F.explode(F.array_union(head, tail)).alias("line"))
    cut = pieces.groupBy("path", F.floor(F.col("line.n") / 4).alias("record")).agg(F.collect_set("line").alias("lines"))
    return whole.unionByName(cut.mapInPandas(_cut_records, FASTQ_FIELDS))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by place in their files, files by the order of their paths; the run fails where ids differ or one is missing.

    The records of both are written first, so that files are numbered without reading them again.
    """

    def placed(reads: DataFrame, name: str) -> DataFrame:
        reads = written(reads, "mates")
        files = reads.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")))
        return reads.join(F.broadcast(files), "path").select("file", "index", F.struct("read_id", "seq", "qual").alias(name))

    both = placed(first, "r1").join(placed(second, "r2"), ["file", "index"], "full")
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    same = F.coalesce(bare(F.col("r1.read_id")) == bare(F.col("r2.read_id")), F.lit(False))
    return both.withColumn("read_id", F.when(same, bare(F.col("r1.read_id"))).otherwise(F.raise_error(F.concat(F.lit("mates differ at record "), F.col("index").cast("string")))))


def concat_distinct(parts: list[DataFrame], read_id: str, order: str, at_most: int | None = None) -> DataFrame:
    """Parts one after another, each read once (its first), and the first `at_most` of them."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("_part", F.lit(i)))
    names = [c for c in rows.columns if c not in (read_id, "_part", order)]
    once = rows.groupBy(read_id).agg(F.min(F.struct("_part", order, *names)).alias("_r")).select(read_id, "_r.*")
    return (once.orderBy("_part", order).limit(at_most) if at_most else once).drop("_part")


def write_by_region(rows: DataFrame, path: str, contig: str, pos: str, places: int = 1 << 20) -> None:
    """Rows in a folder for each contig, in files by stretches of positions and in their order, so that read_region() opens little else than what it is asked for."""
    rows.repartition(contig, F.floor(F.col(pos) / places)).sortWithinPartitions(contig, pos).write.partitionBy(contig).parquet(path)


def read_region(spark: SparkSession, path: str, schema: str, contig: str, pos: str, region: tuple[str, int, int]) -> DataFrame:
    """Rows of a half-open region of write_by_region(): other contigs' folders aren't listed, and row groups beyond it are passed over by their bounds."""
    name, start, end = region
    return spark.read.schema(schema).parquet(path).where((F.col(contig) == name) & (F.col(pos) >= start) & (F.col(pos) < end))


def read_sam(spark: SparkSession, paths: str | list[str], drop_flags: int = 0x904) -> DataFrame:
    """Alignment records without headers and without any of `drop_flags`; tags as a map of their text."""
    text = spark.read.text(paths).where(~F.col("value").startswith("@"))
    parts = F.split("value", "\t", 12)
    fields = [parts[i].cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(SAM_FIELDS)]
    tags = F.map_from_entries(F.transform(F.filter(F.split(F.coalesce(F.get(parts, F.lit(11)), F.lit("")), "\t"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:.:")), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_extract(x, "^[^:]*:[^:]*:(.*)$", 1))))
    rows = text.select(*fields, tags.alias("tags"))
    return rows.where(F.col("flag").bitwiseAND(drop_flags) == 0)


def is_unique() -> Column:
    """One reported place: NH of 1, or a mapping quality of 255 without it."""
    return F.coalesce(F.element_at("tags", F.lit("NH")) == "1", F.col("mapq") == 255)


def attribute(attributes: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(attributes, rf'(?:^|[; ]){name} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, paths: str | list[str], feature: str | None = None) -> DataFrame:
    """Annotation rows with 0-based half-open coordinates and the usual attributes."""
    rows = spark.read.csv(paths, sep="\t", comment="#", schema=", ".join(f"`{f.split()[0]}` {f.split()[1]}" for f in GTF_FIELDS), quote="")
    rows = rows.where(F.col("feature") == feature) if feature else rows
    named = {n: attribute(F.col("attributes"), n) for n in ("gene_id", "gene_name", "transcript_id", "tag")}
    biotype = F.coalesce(attribute(F.col("attributes"), "gene_biotype"), attribute(F.col("attributes"), "gene_type"))
    canonical = F.col("attributes").contains("Ensembl_canonical")
    return rows.withColumn("start", F.col("start") - 1).withColumns(named).withColumn("biotype", biotype).withColumn("canonical", canonical)


def terminal_exons(exons: DataFrame) -> DataFrame:
    """The exon at the 3' end of each transcript, each once."""
    last = F.when(F.max("strand") == "+", F.max_by(F.struct("start", "end"), "end")).otherwise(F.min_by(F.struct("start", "end"), "start"))
    per = exons.groupBy("contig", "strand", "gene_name", "transcript_id").agg(last.alias("_e"))
    return per.select("contig", "strand", "gene_name", "_e.start", "_e.end").distinct()


def transcript_ends(exons: DataFrame) -> DataFrame:
    """All 3' ends of a gene's transcripts, ascending."""
    end = F.when(F.max("strand") == "+", F.max("end")).otherwise(F.min("start"))
    per = exons.groupBy("contig", "strand", "gene_name", "transcript_id").agg(end.alias("_end"))
    return per.groupBy("contig", "strand", "gene_name").agg(F.sort_array(F.collect_set("_end")).alias("ends"))


def canonical_transcripts(exons: DataFrame) -> DataFrame:
    """One transcript for each gene: the canonical one, else the longest, else the first by name."""
    per = exons.groupBy("gene_name", "transcript_id").agg(F.max("canonical").alias("canonical"), F.sum(F.col("end") - F.col("start")).alias("length"))
    w = Window.partitionBy("gene_name").orderBy(F.col("canonical").desc(), F.col("length").desc(), "transcript_id")
    return per.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.text(paths).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    parts = F.split("value", "[\t ]+")
    return text.select(parts[0].alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), F.get(parts, F.lit(3)).alias("name"))


def read_refflat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Transcripts with arrays of exon starts and ends."""
    names = ("gene", "transcript", "contig", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exons", "starts", "ends")
    parts = F.split("value", "\t")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    out = [parts[i].cast("long" if 4 <= i <= 8 else "string").alias(n) for i, n in enumerate(names[:9])]
    return spark.read.text(paths).where("value <> ''").select(*out, numbers(parts[9]).alias("starts"), numbers(parts[10]).alias("ends"))


def to_refflat(exons: DataFrame, coding: DataFrame) -> DataFrame:
    """Transcripts as refFlat columns; without coding parts the coding span is empty at the transcript's end."""
    tx = exons.groupBy("gene_name", "transcript_id", "contig", "strand").agg(F.min("start").alias("tx_start"), F.max("end").alias("tx_end"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_x"))
    cds = coding.groupBy("transcript_id").agg(F.min("start").alias("_cs"), F.max("end").alias("_ce"))
    rows = tx.join(cds, "transcript_id", "left")
    return rows.select("gene_name", "transcript_id", "contig", "strand", "tx_start", "tx_end", F.coalesce("_cs", "tx_end").alias("cds_start"), F.coalesce("_ce", "tx_end").alias("cds_end"), F.size("_x").alias("exons"), F.col("_x.start").alias("starts"), F.col("_x.end").alias("ends"))


def read_table(spark: SparkSession, paths: str | list[str], schema: str, sep: str = "\t", comment: str = "#") -> DataFrame:
    """A table with a header; 'NA' and empty cells are null."""
    rows = spark.read.csv(paths, sep=sep, header=True, comment=comment, schema=schema, nullValue="NA")
    return rows


def read_sections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, section, n and line of texts in which '[name]' begins a section. Each file is a short list, read whole; its sections end with it."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    in_file = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.expr("substring(line, 2, length(line) - 2)")), ignorenulls=True).over(in_file))
    return named.where(F.col("section").isNotNull() & ~F.col("line").rlike(r"^\[.*\]$") & (F.trim("line") != "")).select("path", "section", "n", "line")


def read_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """key, value of 'key | value' lines."""
    parts = F.split("value", r"\|")
    return spark.read.text(paths).where(F.col("value").contains("|")).select(F.trim(parts[0]).alias("key"), F.trim(F.regexp_replace(parts[1], "\t", "")).alias("value"))


def read_histogram(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, position and coverage of the histogram part of metrics files."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    start = F.max(F.when(F.col("line").startswith("## HISTOGRAM"), F.col("n"))).over(Window.partitionBy("path"))
    rows = lines.withColumn("_at", start).where((F.col("n") > F.col("_at") + 1) & F.col("line").rlike(r"^\d"))
    parts = F.split("line", "\t")
    return rows.select("path", parts[0].cast("int").alias("position"), parts[1].cast("double").alias("coverage"))


def parse_guide(text: str) -> dict[str, str]:
    """Key and value pairs, separated by tabs, between BEGIN_CONFIG and END_CONFIG."""
    block = re.search(r"^BEGIN_CONFIG\s*$(.*?)^END_CONFIG\s*$", text, re.M | re.S)
    if block is None:
        raise ValueError("no block of settings")
    return dict(line.split("\t", 1) for line in block[1].splitlines() if "\t" in line)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene_name, biotype and contig of genes, from a table (.tsv, .txt) with those columns or from GTF."""
    if re.search(r"\.(tsv|txt)(\.gz)?$", path):
        return read_table(spark, path, "gene_id string, gene_name string, biotype string, contig string")
    return read_gtf(spark, path, "gene").select("gene_id", "gene_name", "biotype", "contig").distinct()


def read_registry(spark: SparkSession, patterns: list[str], schema: str, key: str) -> DataFrame:
    """Rows of the sheets that exist, in that order, the first row of each key; an error if none does."""
    found, out = [], None
    for p in patterns:
        try:
            found += resolve(spark, p)
        except FileNotFoundError:
            continue
    if not found:
        raise FileNotFoundError("; ".join(patterns))
    for i, p in enumerate(found):
        part = spark.read.csv(p, sep="\t", header=True, comment="#", schema=schema).withColumn("_sheet", F.lit(i))
        out = part if out is None else out.unionByName(part)
    names = [c for c in out.columns if c not in (key, "_sheet")]
    return out.groupBy(key).agg(F.min(F.struct("_sheet", *names)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in names))
