"""Quality rules on documents, line first, in DataFrame expressions alone.

Each line is judged by itself; lines that fail a rule are removed, and a document is rejected when
too little of it is left. Boilerplate is known by fixed phrases and, in any language, by the corpus itself: short lines that many
different texts have. Base figures of the whole text (symbols, repeated lines, words in repeated windows) stand beside the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .membership import possible

#: What separates words, as a regular expression's class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Phrases of site furniture and legal notes, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under the",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
)

#: A line of up to so many words that so many different texts have is boilerplate.
COMMON_WORDS = 20
COMMON_TEXTS = 20

#: Characters a sentence may end with.
SENTENCE_END = r"[.!?…。！？:;\"'”’)\]]" + SPACE + "*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, SPACE, " "), " "), "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of `width` words found twice or more; windows are told apart by a 64-bit hash.

    Distinct hashes settle a text without repeats in one pass; only the others sort their windows.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            twins = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

        def total(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(ordered, starts), total)

    windows = let(words, lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>")))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def line_fails(line: Column, max_symbols: float = 0.3, max_shouts: float = 0.3, max_separators: float = 0.2, short_words: int = 3) -> Column:
    """Whether a line that has words breaks a rule.

    Punctuation: over `max_symbols` symbols or `max_shouts` exclamation marks a word, or letters in capitals alone over
    `short_words` words, or no sentence end on a line of up to `short_words` words. Navigation: over `max_separators` bars,
    arrows or bullets a word. Boilerplate: one of the fixed phrases.
    """

    def judge(n: Column) -> Column:
        shouted = (n > short_words) & (F.upper(line) == line) & (F.lower(line) != line)
        punctuation = (F.regexp_count(line, F.lit(SYMBOLS)) > max_symbols * n) | (F.regexp_count(line, F.lit("!")) > max_shouts * n) | shouted | ((n <= short_words) & ~line.rlike(SENTENCE_END))
        navigation = F.regexp_count(line, F.lit("[|»«›>•·→]")) > max_separators * n
        boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
        return punctuation | navigation | boilerplate

    return let(F.regexp_count(line, F.lit(NOT_SPACE + "+")), judge)


def line_key(line: Column) -> Column:
    """128 bits of hash that tell lines, or texts, apart."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _figures(body: Column, common_words: int) -> Column:
    """struct of a text's figures; `short` holds key and letters of the short lines that no rule of their own fails."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    chars = lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")).cast("long")
    good = lambda ls: F.filter(ls, lambda x: ~line_fails(x))
    short = lambda ls: F.filter(ls, lambda x: F.regexp_count(x, F.lit(NOT_SPACE + "+")) <= common_words)
    kept = lambda ls: F.struct(
        F.aggregate(ls, F.lit(0).cast("long"), lambda acc, x: acc + chars(x)).alias("chars"),
        F.transform(short(ls), lambda x: F.struct(line_key(x).alias("key"), chars(x).alias("chars"))).alias("short"),
    )
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_window_words(w).alias("n_repeat_words"))
    of_lines = lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), let(good(ls), kept).alias("kept"))
    return F.struct(let(words_of(body), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), line_key(body).alias("text"))


def common_lines(rows: DataFrame, common_texts: int) -> DataFrame:
    """key of the lines in rows of (text, short) that `common_texts` different texts or more have. A line that all have is counted in parts first."""
    each = rows.select("text", F.explode(F.array_distinct(F.col("short.key"))).alias("key")).distinct()
    return each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= common_texts).select("key")


def measure(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_left_percent: int = 50, text: str = "text", common_words: int = COMMON_WORDS, common_texts: int = COMMON_TEXTS, carry: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars and kept to every row.

    A null or empty text has zeros and fails the base. Word-less lines count for nothing. Rows of equal texts get equal figures, and count as one text
    among those that have a line; an empty table stays empty. Columns of `docs` named as these are replaced. `carry` names the columns that
    go along, all by default; figures without texts are what is written between the two passes.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in (*added, "base_failed", "kept_chars", "kept")]
    told = docs.select(*names, _figures(F.coalesce(F.col(text), F.lit("")), common_words).alias("_f"))
    figures = [F.col(f"_f.{c}").alias(c.split(".")[-1]) for c in ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words")]
    rows = written(told.select(*names, *figures, F.col("_f.l.kept.chars").alias("_chars"), F.col("_f.l.kept.short").alias("_short"), F.col("_f.text").alias("_text")), "lines")
    common = common_lines(rows.select(F.col("_text").alias("text"), F.col("_short").alias("short")), common_texts)
    # letters of common lines in each text, whose rows are equal
    lines = rows.select("_text", F.explode("_short").alias("_line")).select("_text", F.col("_line.key").alias("key"), F.col("_line.chars").alias("_c"))
    lost = lines.groupBy("_text", "key").agg(F.sum("_c").alias("_c")).join(common, "key").groupBy("_text").agg(F.sum("_c").alias("_lost"))
    times = rows.where(F.size("_short") > 0).groupBy("_text").agg(F.count("*").alias("_times"))
    lost = lost.join(times, "_text").select("_text", F.expr("_lost div _times").alias("_lost"))
    out = rows.join(lost, "_text", "left").withColumn("kept_chars", F.col("_chars") - F.coalesce("_lost", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = 100 * F.col("kept_chars") >= min_left_percent * F.col("word_chars")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)
    return out.select(*names, *added, "base_failed", "kept_chars", "kept")


def clean(docs: DataFrame, text: str = "text", common_words: int = COMMON_WORDS, common_texts: int = COMMON_TEXTS, **limits: int) -> DataFrame:
    """Documents that pass, their failing and common lines removed from the text; columns as before. Rows are judged as in measure()."""
    judged = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"))
    judged = measure(judged, common_words=common_words, common_texts=common_texts, **limits).where("kept")
    body = F.coalesce(F.col("text"), F.lit(""))
    judged = judged.select("_doc", "text", line_key(body).alias("_text"))
    short = _figures(body, common_words)["l"]["kept"]["short"]
    rows = written(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(line_key(F.col("text")).alias("text"), short.alias("short")).where(F.size("short") > 0), "lines")
    common = common_lines(rows, common_texts)
    each = rows.select("text", F.explode(F.array_distinct(F.col("short.key"))).alias("key")).distinct().join(common, "key")
    gone = written(each.groupBy(F.col("text").alias("_text")).agg(F.collect_set("key").alias("_gone")), "common")
    touched, rest = possible(judged, "_text", gone.select("_text"))
    parts = touched.join(gone, "_text", "left").unionByName(rest.withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType)))
    fails = lambda x: x.rlike(NOT_SPACE) & (line_fails(x) | F.coalesce(F.array_contains("_gone", line_key(x)), F.lit(False)))
    good = F.filter(F.split(body, "\n"), lambda x: ~fails(x))
    return parts.select(*(F.array_join(good, "\n").alias(c) if c == text else F.col(f"_doc.`{c}`") for c in docs.columns))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: figures of the base rules and the verdict."""
    return measure(docs.select("doc_id", "text"), carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
