"""Three-way merge of two branches of a table of documents, inside each row and without exploding it.

A branch's edits are codes of a row's parts: the row itself, its columns, and each line of its text. A text is split, each line is made a struct of itself
and both branches' codes, that a struct of the lines which stand in its place and of what was counted; counts are aggregated, lines flattened and joined. Documents
aren't shuffled at all. Only rows that a branch adds meet by their id: a few short values, aggregated before they move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCHES = ("L", "R")
COLUMNS = ("lang", "source")
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
#: What a branch does with a part, by its code; other codes leave it. FIRST and SECOND are inserted behind a line, or added as a row, by ADD_FIRST and ADD_SECOND.
DROP, APPEND_FIRST, APPEND_SECOND, ADD_FIRST, ADD_SECOND = range(5)
FIRST, SECOND = "!", "?"

#: The code of a part: of branch, row id as text, and the part's name.
Code = Callable[[str, Column, Column], Column]


def hashed_code(branch: str, key: Column, name: Column) -> Column:
    return F.crc32(F.concat(F.lit(f"{branch}:"), key, F.lit(":"), name).cast("binary")) % 11


def _edited(value: Column, code: Column, dropped: Column) -> Column:
    return F.when(code == DROP, dropped).when(code == APPEND_FIRST, F.concat(value, F.lit(FIRST))).when(code == APPEND_SECOND, F.concat(value, F.lit(SECOND))).otherwise(value)


def _taken(left: Column, right: Column) -> Column:
    """Of two changes, null where there is none, the one to make: none if they differ."""
    return F.when(left.isNull(), right).when(right.isNull() | (left == right), left)


def _counted(left: Column, right: Column) -> tuple[Column, Column]:
    """Whether there is a clean change, and whether there is a conflict."""
    clash = F.coalesce(left != right, F.lit(False))
    return (left.isNotNull() | right.isNotNull()) & ~clash, clash


def _one_if(test: Column) -> Column:
    return F.when(test, 1).otherwise(0).cast("long")


def _merged_line(part: Column) -> Column:
    """The lines in place of one line and behind it, and its counts."""
    on_line, behind = ([F.when(test(part[b]), part[b]) for b in BRANCHES] for test in (lambda c: c <= APPEND_SECOND, lambda c: c.between(ADD_FIRST, ADD_SECOND)))
    edit, add = _taken(*on_line), _taken(*behind)
    own = F.when(edit == DROP, F.array().cast("array<string>")).otherwise(F.array(_edited(part["line"], F.coalesce(edit, F.lit(-1)), part["line"])))
    more = F.when(add == ADD_FIRST, F.array(F.lit(FIRST))).when(add == ADD_SECOND, F.array(F.lit(SECOND))).otherwise(F.array().cast("array<string>"))
    (line_clean, line_clash), (gap_clean, gap_clash) = _counted(*on_line), _counted(*behind)
    deleted = reduce(lambda a, b: a | b, (F.coalesce(c == DROP, F.lit(False)) for c in on_line))
    counts = (_one_if(line_clean) + _one_if(gap_clean), _one_if(line_clash & ~deleted), _one_if(line_clash & deleted), _one_if(gap_clash))
    return F.struct(F.concat(own, more).alias("lines"), *(c.alias(n) for c, n in zip(counts, COUNTS)))


def merge_documents(docs: DataFrame, code: Code = hashed_code) -> DataFrame:
    """doc_id, lang, source, text and the four counts for every row of `docs`, changed as both branches ask where they agree, and for every row that a branch adds.

    Nulls in lang, source and text become empty first. A row that is gone has nulls in these three. A row of null doc_id is merged with an empty id in its
    parts' names, and what it adds has a null id. Rows of one doc_id are merged one by one. Added rows of one id are merged by value: if all are equal they
    are one clean insertion, else one conflict and no row. A document of negative id doesn't meet added rows of the same id; both are returned. An empty table
    gives no rows. Further columns aren't carried along.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS), F.coalesce("text", F.lit("")).alias("text"))
    return _merged_rows(base, code).unionByName(_added_rows(base, code))


def _merged_rows(base: DataFrame, code: Code) -> DataFrame:
    left, right = BRANCHES
    of_line = lambda line, i: F.struct(line.alias("line"), *(code(b, F.col("key"), i.cast("string")).alias(b) for b in BRANCHES))
    marked = base.select("*", F.transform(F.split("text", "\n"), of_line).alias("parts"), *(code(b, F.col("key"), F.lit("row")).alias(f"{b}_row") for b in BRANCHES))
    marked = marked.withColumns({f"{b}_{c}": F.nullif(_edited(F.col(c), code(b, F.col("key"), F.lit(c)), F.lit("")), F.col(c)) for b in BRANCHES for c in COLUMNS})
    on_lines = lambda b: F.exists("parts", lambda p: p[b] <= ADD_SECOND)
    changed = {f"{b}_changed": reduce(lambda x, y: x | y, (F.col(f"{b}_{c}").isNotNull() for c in COLUMNS), on_lines(b)) for b in BRANCHES}
    states = marked.withColumns(changed | {"states": F.transform("parts", _merged_line)}).drop("parts")

    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in COUNTS))
    sums = states.withColumn("sums", F.aggregate("states", zero, lambda a, s: F.struct(*((a[n] + s[n]).alias(n) for n in COUNTS))))
    by_column = [_counted(F.col(f"{left}_{c}"), F.col(f"{right}_{c}")) for c in COLUMNS]
    merged = dict(zip(COUNTS, (F.col("sums")[n] for n in COUNTS)))
    merged["n_clean"] = sum((_one_if(clean) for clean, _ in by_column), merged["n_clean"])
    merged["n_edit_edit"] = sum((_one_if(clash) for _, clash in by_column), merged["n_edit_edit"])

    drops = [F.col(f"{b}_row") == DROP for b in BRANCHES]
    any_drop = drops[0] | drops[1]
    clash = any_drop & ~(drops[0] & drops[1]) & F.when(drops[0], F.col(f"{right}_changed")).otherwise(F.col(f"{left}_changed"))
    alone = {"n_clean": _one_if(~clash), "n_edit_delete": _one_if(clash)}
    values = {c: F.coalesce(_taken(F.col(f"{left}_{c}"), F.col(f"{right}_{c}")), F.col(c)) for c in COLUMNS}
    values["text"] = F.array_join(F.flatten(F.col("states.lines")), "\n")
    return sums.select(
        "doc_id",
        *(F.when(clash, F.col(c)).when(~any_drop, v).alias(c) for c, v in values.items()),
        *(F.when(any_drop, alone.get(n, F.lit(0).cast("long"))).otherwise(v).alias(n) for n, v in merged.items()),
    )


def _added_rows(base: DataFrame, code: Code) -> DataFrame:
    added = []
    for k, branch in enumerate(BRANCHES):
        own = code(branch, F.col("key"), F.lit("row"))
        text = F.when(own == ADD_FIRST, FIRST).when(own == ADD_SECOND, SECOND)
        added.append(base.select((-1 - k - F.col("doc_id")).alias("doc_id"), F.struct(*COLUMNS, text.alias("text")).alias("row")).where("row.text is not null"))
    ends = reduce(DataFrame.unionByName, added).groupBy("doc_id").agg(F.min("row").alias("row"), F.max("row").alias("other"))
    same = F.col("row") == F.col("other")
    counts = {"n_clean": _one_if(same), "n_insert_insert": _one_if(~same)}
    return ends.select("doc_id", *(F.when(same, F.col("row")[c]).alias(c) for c in (*COLUMNS, "text")), *(counts.get(n, F.lit(0).cast("long")).alias(n) for n in COUNTS))


def merge_report(docs: DataFrame) -> DataFrame:
    """merge_documents() with the digest of each text in its place."""
    return merge_documents(docs).select("doc_id", *COLUMNS, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *COUNTS)
