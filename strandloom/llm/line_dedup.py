"""Lines that many documents have, dropped from every document.

Lines are exploded under their normalised key's digest; documents are counted for each digest, each document once; lines of a digest over the threshold
are dropped and the others put together again by position. Only digests and positions are moved for the counts and for the search of dropped lines: a
document's text moves once, to meet the positions that it loses. A line of very many documents is one row a task when it is counted, and one of the rows
that Spark splits when it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .membership import possible

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.btrim(F.translate(line, UPPER, UPPER.lower()), F.lit(SPACE))


def _digest(text: Column) -> Column:
    """32 bytes that stand for the text: no two texts with the same are known."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _digests(lines: Column, min_chars: int) -> Column:
    """The digest of each line's key, null where the key is too short to count."""
    keys = F.transform(lines, line_key)
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, _digest(key)))


def common_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key): digests of keys of at least `min_chars` code points that at least `min_docs` documents have. Rows of one doc_id are one document, those of none too."""
    each = docs.select("doc_id", F.explode(F.array_distinct(_digests(F.split(F.coalesce("text", F.lit("")), "\n"), min_chars))).alias("key"))
    once = each.where("key is not null").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row of `docs`: its lines without those whose key `min_docs` documents have, joined by newlines.

    A null or empty text is one empty line, and stays so. Keys shorter than `min_chars` are never dropped. A document that loses all lines keeps an empty text.
    Rows of one doc_id count as one document, rows of a null doc_id together as one; each is returned, equal rows with equal results. An empty table gives
    no rows. Further columns of `docs` aren't carried along.
    """
    text = F.coalesce("text", F.lit(""))
    # what is found for a row is found for its equals: they may share a name
    row = _digest(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text))
    named = docs.select("doc_id", row.alias("row"), F.split(text, "\n").alias("lines"))
    common = written(common_keys(docs, min_docs, min_chars), "lines")
    each = named.select("row", F.posexplode(_digests(F.col("lines"), min_chars)).alias("pos", "key")).where("key is not null")
    dropped = possible(each, "key", common)[0].join(common, "key", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    both = named.join(dropped, "row", "left")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return both.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of drop_common_lines()."""
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
