"""Rates per document that bring the expected tokens of soft domains to target totals.

A softmax classifier learnt from a labelled table gives each document a posterior over domains. Rates
r >= 0 minimise the squared distance between sum(tokens * r * posterior) and the targets: each round of
projected gradient aggregates the totals and the curvature over all rows, and every row's rate is the
projection of its last one, so a rate is a function of the posterior and of the few step vectors so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import written
from .document_features import BUCKETS, N_FORM, form, word_buckets
from .membership import possible
from .text_arrays import pieces

#: Domains told from the labels, in this order; targets are shares of the corpus's tokens, factors multiples of a domain's own total.
DOMAINS = ("clean", "toxic", "junk")
#: Factors leave out the domain that a quality stage has emptied: its few soft members would only make the fit unstable.
TARGETS = {"clean": 0.92, "toxic": 0.02, "junk": 0.06}
FACTORS = {"clean": 1.2, "toxic": 0.3}
#: How many standard errors a word's share in a domain must lie from its share elsewhere for the word to count.
LEAST_Z = 4.0
#: Labelled rows that the classifier is fitted on at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 9000


@dataclass
class Model:
    word: np.ndarray
    form: np.ndarray
    bias: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def posteriors(self, buckets: np.ndarray, bounds: np.ndarray, features: np.ndarray) -> np.ndarray:
        sums = np.vstack([np.zeros((1, self.word.shape[1])), np.cumsum(self.word[buckets], axis=0)])
        logits = sums[bounds[1:]] - sums[bounds[:-1]] + np.clip((features - self.centre) / self.spread, -8, 8) @ self.form + self.bias
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)


def telling(buckets: np.ndarray, owner: np.ndarray, domain: np.ndarray, domains: int, least: float = LEAST_Z) -> np.ndarray:
    """Which word buckets occur clearly more or less often in some domain than elsewhere."""
    n, total = len(domain), np.bincount(buckets, minlength=BUCKETS)
    keep = np.zeros(BUCKETS, bool)
    for d in range(domains):
        inside = int((domain == d).sum())
        if 0 < inside < n:
            here = np.bincount(buckets[domain[owner] == d], minlength=BUCKETS)
            p = total / n
            spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / inside + 1 / (n - inside)))
            keep |= np.abs(here / inside - (total - here) / (n - inside)) > least * spread
    return keep


def fit(buckets: np.ndarray, bounds: np.ndarray, features: np.ndarray, domain: np.ndarray, domains: int, rounds: int = 120, ridge: float = 1e-3) -> Model:
    """Softmax weights by Adam over all rows given; without rows of two domains, the same posterior for every domain."""
    n = len(domain)
    centre, spread = (features.mean(0), features.std(0) + 1e-3) if n else (np.zeros(N_FORM), np.ones(N_FORM))
    model = Model(np.zeros((BUCKETS, domains)), np.zeros((N_FORM, domains)), np.zeros(domains), centre, spread)
    if len(np.unique(domain)) < 2:
        return model
    want = np.eye(domains)[domain]
    x = np.clip((features - centre) / spread, -8, 8)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    some = telling(buckets, owner, domain, domains)[buckets]
    buckets, owner = buckets[some], owner[some]
    bounds = np.concatenate([[0], np.cumsum(some)])[bounds]
    state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in (model.word, model.form, model.bias)]
    for k in range(1, rounds + 1):
        error = (model.posteriors(buckets, bounds, features) - want) / n
        slopes = (np.column_stack([np.bincount(buckets, weights=error[owner, d], minlength=BUCKETS) for d in range(domains)]) + ridge * model.word, x.T @ error + ridge * model.form, error.sum(0))
        for (w, m, v), g in zip(state, slopes):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of the domain in DOMAINS; null without a label."""
    return F.when(toxic == 1, 1).when(quality == 0, 2).when((quality == 1) & (toxic == 0), 0)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents; rows without a usable label are passed over, and of several documents of one id the least text is learnt from."""
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null and doc_id is not null")
    chosen = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("domain").alias("domain"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, forms = [], []
            for low, w in zip(pieces(batch.column("text"), lower=True), pieces(batch.column("text"))):
                hashes = low.hashes()
                own, at = word_buckets(low, hashes)
                words += [own[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                forms += [f.tobytes() for f in form(w, hashes).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(words, pa.binary()), pa.array(forms, pa.binary())], ["domain", "words", "form"])

    got = rows.mapInArrow(run, "domain int, words binary, form binary").collect()
    got.sort(key=lambda r: (r.domain, bytes(r.words), bytes(r.form)))
    if not got:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, N_FORM)), np.zeros(0, int), len(DOMAINS))
    words = [np.frombuffer(r.words, np.int32) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return fit(np.concatenate(words), bounds, np.vstack([np.frombuffer(r.form, np.float32) for r in got]).astype(float), np.array([r.domain for r in got]), len(DOMAINS))


def with_posteriors(docs: DataFrame, model: Model, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Columns of `docs` with `_tokens` (words, and one for the end) and `_p_<domain>`."""
    names = [*docs.columns, "_tokens", *(f"_p_{d}" for d in domains)]
    schema = T.StructType([*docs.schema.fields, T.StructField("_tokens", T.LongType()), *(T.StructField(f"_p_{d}", T.DoubleType()) for d in domains)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, parts = [np.zeros(0, np.int64)], [np.zeros((0, len(domains)))]
            for low, w in zip(pieces(batch.column("text"), lower=True), pieces(batch.column("text"))):
                hashes = low.hashes()
                own, at = word_buckets(low, hashes)
                parts.append(model.posteriors(own, at, form(w, hashes)))
                counts.append(w.counts + 1)
            p = np.vstack(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts)), *(pa.array(np.ascontiguousarray(p[:, d])) for d in range(len(domains)))], names)

    return docs.mapInArrow(run, schema)


def solve_rates(rows: DataFrame, targets: dict[str, float], factors: bool = False, rounds: int = 40, tolerance: float = 1e-7) -> tuple[Column, dict[str, float]]:
    """The rate of a row as a column of its posteriors, and the expected totals it gives, as shares of all tokens.

    Starts at rate 1. Each round's gradient is scaled by the curvature of the rows whose rate isn't held at 0;
    a step that doesn't bring the totals nearer is halved. Targets that no rates meet are met as nearly as found.
    With `factors`, a target is that multiple of the total that the domain has at rate 1.
    """
    domains = list(targets)
    p = [F.col(f"_p_{d}") for d in domains]
    one = F.lit(1.0)

    def after(steps: list[np.ndarray]) -> Column:
        return reduce(lambda r, v: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (x * F.lit(float(c)) for x, c in zip(p, v)))), steps, one)

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        r = rows.select(F.col("_tokens").cast("double").alias("t"), after(steps).alias("r"), *p)
        live = F.when(F.col("r") > 0, F.col("t")).otherwise(F.lit(0.0))
        sums = [F.sum(F.col("t") * F.col("r") * x) for x in p] + [F.sum(live * a * b) for a in p for b in p] + [F.sum("t")]
        got = [float(x or 0.0) for x in r.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        d, all_tokens = len(p), max(got[-1], 1.0)
        return np.array(got[:d]) / all_tokens, np.array(got[d:-1]).reshape(d, d) / all_tokens, all_tokens

    goal = np.array([targets[d] for d in domains])
    steps: list[np.ndarray] = []
    reached, curve, _ = totals(steps)
    goal = goal * reached if factors else goal
    size = 1.0
    for _ in range(rounds):
        miss = reached - goal
        if np.abs(miss).max() <= tolerance or size < 1e-3:
            break
        step = size * np.linalg.solve(curve + (1e-6 * np.trace(curve) + 1e-12) * np.eye(len(goal)), miss)
        now, curve_now, _ = totals([*steps, step])
        if np.linalg.norm(now - goal) < np.linalg.norm(miss):
            steps, reached, curve, size = [*steps, step], now, curve_now, min(1.0, 2 * size)
        else:
            size /= 2
    return after(steps), dict(zip(domains, reached.tolist()))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, rate and posteriors of every row; null texts are empty ones of one token, an empty table gives no rows."""
    goals = targets or TARGETS
    rows = written(with_posteriors(docs.select("doc_id", "text"), learn(docs, labels)).drop("text"), "posteriors")
    rate, _ = solve_rates(rows, goals)
    return rows.select("doc_id", F.col("_tokens").alias("tokens"), rate.alias("rate"), *(F.col(f"_p_{d}").alias(f"p_{d}") for d in goals))


def mixed_documents(docs: DataFrame, labels: DataFrame, factors: dict[str, float] | None = None) -> DataFrame:
    """The documents as often as their rates say: floor(rate) copies, and one more where what is left of the rate is above a draw; columns as before.

    The draw is a hash of the row's own columns of documents, whatever others go along, so rows of one id, or of none, are drawn each by its text;
    n equal rows are one of n times the rate.
    The targets are `factors` of the domains' own totals. Without labelled rows of two domains nothing is known of them and all documents stay.
    """
    model = learn(docs, labels)
    if not model.form.any():
        return docs.select(*docs.columns)
    # a hash passes over nulls, so where they are goes into it too
    own = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    key = F.xxhash64(*own, *(F.col(c).isNull() for c in own))
    rows = written(with_posteriors(docs.withColumn("_mix_key", key), model), "posteriors")
    rate, _ = solve_rates(rows, factors or FACTORS, factors=True)
    again = rows.groupBy("_mix_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_mix_key")
    rows = rows.select(*docs.columns, "_mix_key", rate.alias("_rate"))
    equal, single = possible(rows, "_mix_key", again)
    rows = single.unionByName(equal.groupBy(*docs.columns, "_mix_key").agg(F.sum("_rate").alias("_rate")))
    draw = F.pmod(F.xxhash64(F.col("_mix_key"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("_rate") + (F.col("_rate") - F.floor("_rate") > draw).cast("int")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)
