"""Personal data: identifiers of known form, and others found by the contexts that the known ones stand in.

Base spans of four kinds are found by expressions of form. They are the seeds of a bootstrap: each occurrence of
a seed, or of a run of words that could be an identifier, gives lexical patterns (the words around it); a graph links patterns with the
values seen in them. In each round a pattern's confidence in a kind is the share of its values that are of that
kind so far, and an unknown value's score is the noisy-or of its patterns' confidences. Values that are near
certain, by several patterns that enough seeds support, are seeds of the next round, so that they induce patterns of their own, and in the end
further spans. All of it is DataFrame expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .membership import possible
from .quality_rules import let

#: The kinds in the order of their spans, and their forms. Lookbehinds and possessive loops don't change what
#: matches; they keep the search linear in long runs of the same class.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Fixed value: an address part of at most 255, leading zeros allowed.
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What may be an identifier of unknown form, in this order: an address whose sign is spelt out or bracketed, a word with the sign in it, a
#: code in groups that begins with two letters and two digits, figures in groups, a word with at least six digits.
_BEGIN = r"(?<![^\x20\x09-\x0D(\[<\"':;,=])"
_HOST = r"[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]++)"
ADDRESS_FORMS = _BEGIN + r"(?:[A-Za-z0-9._%+-]++(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?" + _HOST + r"*+|\x20at\x20" + _HOST + r"++)|[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++)"
FIGURE_FORMS = (
    _BEGIN + r"(?:[A-Z]{2}[0-9]{2}(?:\x20[0-9A-Z]{4}){2,7}+(?:\x20[0-9A-Z]{1,4}(?![^\x20\x09-\x0D.,;:]))?|[+(]?[0-9][0-9().\/-]*+(?:\x20[0-9(][0-9().\/-]*+)++)"
    r"|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+(?:[0-9][^\x20\x09-\x0D0-9]*+){6,}+"
)
#: What every text with a match of ADDRESS_FORMS has.
ADDRESS_SIGN = r"@|[\[({]at[\])}]|\x20at\x20[A-Za-z0-9-]++(?:[.\[({]|\x20dot|\x20?[\[({]dot)"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"

#: Seeds that a pattern needs; patterns and score that a value needs; what is added to a pattern's count.
LEAST_SEEDS = 5
LEAST_PATTERNS = 2
LEAST_SCORE = 0.95
PRIOR = 0.5
#: Characters on either side that patterns are taken from.
CONTEXT = 80


def _matches(text: Column, form: str, kind: str, valid: Callable[[Column], Column]) -> Column:
    """Spans (kind, start, end, value) of a form's valid matches, in code points."""

    def place(found: Column, between: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
            return F.struct(end.alias("at"), F.when(valid(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, empty, step)["out"]

    hits = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, F.array().cast(SPAN)).otherwise(place(h, F.split(text, form, -1))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds in the order of KINDS, then start; a null text has none."""
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    email = F.when(body.contains("@"), _matches(body, EMAIL, "email", lambda x: F.lit(True))).otherwise(none)
    ip = _matches(body, IP, "ip", lambda x: x.rlike(rf"^(?:{BYTE_PART}\.){{3}}{BYTE_PART}$"))
    card = _matches(body, CARD, "card", lambda x: let(_digits(x), lambda d: F.length(d).between(16, 19) & luhn(d)))
    phone = F.when(body.contains("+"), _matches(body, PHONE, "phone", lambda x: F.length(_digits(x)).between(8, 15))).otherwise(none)
    return F.when(body.rlike("[0-9@]"), F.concat(email, ip, card, phone)).otherwise(none)


def unknown_spans(text: Column, base: Column) -> Column:
    """Runs of words that may be identifiers and touch no base span, without the signs around them: those with an address's sign, or six digits."""
    body = F.coalesce(text, F.lit(""))

    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["value"], "^[^A-Za-z0-9]*", 0))
        value = F.regexp_replace(x["value"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        return F.struct(x["kind"].alias("kind"), (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(value)).alias("end"), value.alias("value"))

    apart = lambda spans, others: F.filter(spans, lambda x: ~F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    none = F.array().cast(SPAN)
    addresses = F.when(body.rlike(ADDRESS_SIGN), F.transform(_matches(body, ADDRESS_FORMS, "?", lambda x: F.lit(True)), trimmed)).otherwise(none)
    six = lambda x: x.rlike("(?:[0-9][^0-9]*+){6}")
    figures = F.when(body.rlike("[0-9]"), F.transform(_matches(body, FIGURE_FORMS, "?", six), trimmed)).otherwise(none)
    return let(apart(addresses, base), lambda a: F.concat(a, apart(apart(figures, base), a)))


def _with_contexts(text: Column, spans: Column) -> Column:
    """Spans with `patterns`: the word before, the two words before, and the words on both sides, in lower case."""

    def add(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT))))
        before = F.regexp_replace(before, "[(\\[{<\"']+$", "")
        after = F.lower(F.substring(text, x["end"] + 1, F.lit(CONTEXT)))
        word = r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$"
        one, two = F.regexp_extract(before, word, 1), F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
        right = F.regexp_extract(after, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
        patterns = F.array(F.concat(F.lit("L "), one), F.concat(F.lit("LL "), two), F.concat(F.lit("R "), right), F.concat(F.lit("LR "), one, F.lit(" _ "), right))
        return F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value")), patterns.alias("patterns"))

    return F.transform(spans, add)


def _row_key() -> Column:
    parts = (F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def occurrences(docs: DataFrame) -> DataFrame:
    """key, base and unknown spans of each row, without its text; key is 128 bits of hash of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _row_key().alias("key"), "text").withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("unknown", unknown_spans(F.col("text"), F.col("base")))
    return rows.select("doc_id", "key", F.when(F.size("base") > 0, _with_contexts(text, F.col("base"))).alias("base"), F.when(F.size("unknown") > 0, _with_contexts(text, F.col("unknown"))).alias("unknown"))


def score_values(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """value, kind: unknown values that the graph's patterns make near certain.

    edges: pattern, value and the kind of a seed or '?'. A pattern's total is over its distinct values. A pattern counts for a kind once
    LEAST_SEEDS of its values are seeds of that kind or were accepted in the round before; its confidence is the sum of its values' scores
    by its total. Scores only rise from round to round, so no value is ever given up; it goes on until a round accepts none, or for `rounds`.
    """
    graph = edges.distinct()
    totals = graph.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    unknown = graph.where("kind = '?'").select("pattern", "value")
    seeds = graph.where("kind <> '?'").groupBy("pattern", "kind").agg(F.count("*").alias("sure"), F.count("*").cast("double").alias("mass"))
    scored, accepted_before = None, 0
    for done in itertools.count(1):
        weights = seeds
        if scored is not None:
            gained = unknown.join(scored, "value").groupBy("pattern", "kind").agg(F.count_if("accepted").alias("sure"), F.sum("score").alias("mass"))
            weights = seeds.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("sure").alias("sure"), F.sum("mass").alias("mass"))
        strong = weights.where(F.col("sure") >= LEAST_SEEDS).join(totals, "pattern")
        confidence = F.least(F.lit(0.999), F.col("mass") / (F.col("total") + PRIOR))
        found = unknown.join(strong.select("pattern", "kind", confidence.alias("confidence")), "pattern")
        values = found.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.count("*").alias("patterns"))
        accepted = (F.col("score") >= LEAST_SCORE) & (F.col("patterns") >= LEAST_PATTERNS)
        scored = written(values.select("value", "kind", "score", accepted.alias("accepted")), "pii-scores")
        accepted_now = scored.where("accepted").count()
        if accepted_now == accepted_before or done == rounds:
            break
        accepted_before = accepted_now
    return scored.where("accepted").groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def discovered(rows: DataFrame) -> DataFrame:
    """key, found: further spans of the rows of occurrences()."""
    each = rows.select("key", F.explode(F.concat(F.coalesce("base", F.array()), F.coalesce("unknown", F.array()))).alias("s")).select("key", "s.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "kind")
    edges = written(edges.where(~F.col("pattern").rlike("^[A-Z]+ ?(_ )?$")).distinct(), "pii-graph")
    sure = written(score_values(edges), "pii-values")
    spans = rows.where("unknown is not null").select("key", F.explode("unknown").alias("s")).select("key", "s.start", "s.end", "s.value").join(sure, "value")
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("found"))


def _ordered(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    keyed = F.transform(spans, lambda x: F.struct(F.array_position(F.lit(list(KINDS)), x["kind"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans, of every row.

    Null and empty texts have no spans. Repeated rows get equal results; an empty table gives none. Other columns of `docs` aren't carried along.
    """
    rows = written(occurrences(docs.select("doc_id", "text")), "pii")
    found = discovered(rows)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    plain = F.transform(F.coalesce("base", F.array().cast(SPAN[:-2] + ",patterns:array<string>>>")), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value"))))
    out = rows.join(found, "key", "left").select("doc_id", plain.alias("base"), F.coalesce("found", none).alias("found"))
    counts = [_count_of(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(_ordered(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct((-x["stop"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        return F.when(x["start"] >= acc["at"], more).otherwise(acc)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def mask_documents(docs: DataFrame) -> DataFrame:
    """Documents with their personal data replaced; columns as before, null texts stay null.

    Base spans are replaced row by row; only rows with further spans are joined with them.
    """
    found = written(discovered(written(occurrences(docs.select("doc_id", "text")), "pii")), "pii-found")
    keyed = docs.withColumn("_pii_key", _row_key())
    likely, rest = possible(keyed, "_pii_key", found.select("key"))
    none = F.array().cast(SPAN)
    more = found.select(F.col("key").alias("_pii_key"), F.col("found").alias("_pii_found"))
    likely = likely.join(more, "_pii_key", "left").withColumn("_pii_spans", F.concat(base_spans(F.col("text")), F.coalesce("_pii_found", none)))
    rest = rest.withColumn("_pii_spans", base_spans(F.col("text")))
    parts = [x.withColumn("text", masked_text(F.col("text"), F.col("_pii_spans"))).select(*docs.columns) for x in (likely, rest)]
    return parts[0].unionByName(parts[1])
