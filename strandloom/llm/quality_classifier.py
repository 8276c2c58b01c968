"""Quality scores learnt from preference pairs (Bradley-Terry).

A text of label 1 is preferred to one of label 0. The logistic loss on differences of feature vectors
gives a linear score; the score's quantile at the labelled share of 0 is the threshold between good and bad.
Every labelled text outside the held-out third counts: for centre and spread, in one pair at least, and for the threshold. Features and pairs are tables of
blocks, and each Newton step sums up what tasks add up over theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import hashed_rank
from ..sources.work import discard, written
from .document_features import N_FORM, form
from .text_arrays import pieces

#: Preference pairs at least, where there are so many: each row of the larger class is in one, and with fewer rows in several.
PAIRS = 40000
#: Rows of a block of features, and pairs of a block.
BLOCK = 4096
#: Sums over blocks are added up in units of 2 ** -UNIT, so that they are the same in any order.
UNIT = 30
#: Scores that are brought to the driver to find one of a given rank, at most; more are counted in BINS bins first.
FEW = 10_000
BINS = 4096


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float
    scale: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold."""
        raw = np.clip((features - self.centre) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.threshold) / self.scale, -30, 30)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; a null key isn't held out, and has no label."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(features: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 2e-3, rounds: int = 25) -> Model:
    """Weights of the preference model by Newton's method. Without rows of both kinds every score is 0.5."""
    if not good.any() or good.all():
        return Model(np.zeros(N_FORM), np.zeros(N_FORM), np.ones(N_FORM), 0.0, 1.0)
    centre, spread = features.mean(0), features.std(0) + 1e-3
    x = np.clip((features - centre) / spread, -8, 8)
    draw = np.random.default_rng(11)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    gap = x[better[draw.integers(len(better), size=pairs)]] - x[worse[draw.integers(len(worse), size=pairs)]]
    w = _solved(lambda w: _slopes(gap, w), lambda step: float(np.abs(gap @ step).max()), pairs, ridge, rounds)
    raw = np.sort(x @ w)
    k = int((~good).sum())
    return _model(w, centre, spread, raw[k - 1], raw[k], np.quantile(raw, 0.75) - np.quantile(raw, 0.25))


def _slopes(gap: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, summed over pairs."""
    p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
    return -(gap.T @ p), (gap * (p * (1 - p))[:, None]).T @ gap


def _solved(slopes: Callable, longest: Callable, pairs: int, ridge: float, rounds: int) -> np.ndarray:
    """Newton's method; a step moves no pair's score by more than 4."""
    w = np.zeros(N_FORM)
    for _ in range(rounds):
        slope, curve = slopes(w)
        step = np.linalg.solve(curve / pairs + ridge * np.eye(N_FORM), slope / pairs + ridge * w)
        far = 16 * np.abs(step).sum()  # features lie between -8 and 8
        w = w - step * (1.0 if far <= 4 else min(1.0, 4 / (longest(step) + 1e-9)))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(w: np.ndarray, centre: np.ndarray, spread: np.ndarray, below: float, above: float, quartiles: float) -> Model:
    return Model(w, centre, spread, float((below + above) / 2), max((float(quartiles) or 1.0) / 4, 1e-6))


def _features(docs: DataFrame, schema: str) -> DataFrame:
    """doc_id, quality and features of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for w in pieces(batch.column("text")) for x in form(w, w.hashes()).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc_id", "quality", "features"])

    return docs.select("doc_id", "quality", "text").mapInArrow(run, schema)


def _matrix(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32).reshape(-1, N_FORM).astype(float)


def _blocks(rows: DataFrame, name: str, make: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Rows with `block` and `place` as one row a block, written: what `make` gives for a block's rows, in the order of their places."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "x": pa.array([make(table.sort_by("place")).astype(np.float32).tobytes()], pa.binary())})

    return written(rows.groupBy("block").applyInArrow(run, "block long, x binary"), name)


def _summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `part` of all blocks: each is rounded to UNIT, tasks add up theirs, and one row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("x"):
                own = np.rint(part(_matrix(blob.as_py())) * 2.0**UNIT).astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    return sum(np.frombuffer(r.x, np.int64) for r in blocks.select("x").mapInArrow(run, "x binary").collect()) / 2.0**UNIT


def _longest(blocks: DataFrame, step: np.ndarray) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_matrix(b.as_py()) @ step).max()) for b in batch.column("x")], pa.float64())], ["far"])

    return blocks.select("x").mapInArrow(run, "far double").agg(F.max("far")).first()[0]


def value_of_rank(rows: DataFrame, value: str, rank: int) -> tuple[float, float]:
    """The value that `rank` rows come before in rising order, and the one after it (the same, for the last). Values are numbers, without nulls.

    Exact: the bin in which it lies is cut into bins again until FEW rows are in it, so few rows come to the driver and none is sorted.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    inside, left = rows, rank
    while low < high:
        width = (high - low) / BINS
        number = F.least(F.floor((F.col(value) - low) / width), F.lit(BINS - 1)).alias("bin")
        found = sorted(inside.groupBy(number).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()) if width > 0 else []
        for r in found:
            if left < r.n:
                break
            left -= r.n
        else:
            r = None
        if r is None:
            break
        inside, low, high = inside.where(F.col(value).between(r.low, r.high)), r.low, r.high
        if r.n <= FEW:
            low = high = sorted(x[0] for x in inside.select(value).collect())[left]
    upto, after = rows.agg(F.count_if(F.col(value) <= low), F.min(F.when(F.col(value) > low, F.col(value)))).first()
    return low, (low if upto > rank + 1 or after is None else after)


def _quantile(rows: DataFrame, n: int, share: float) -> float:
    """As numpy.quantile: on a straight line between neighbouring values."""
    place = (n - 1) * share
    low, high = value_of_rank(rows, "raw", int(place))
    return low + (high - low) * (place - int(place))


def _pairs(rows: DataFrame, n: dict[int, int], centre: np.ndarray, spread: np.ndarray) -> tuple[DataFrame, int]:
    """Blocks of differences of a text of label 1 and one of label 0, and how many there are.

    Row i of the larger class, in the order of hashes, meets row i of the smaller one, whose rows are gone through again and again; where that makes fewer than
    PAIRS, the rows that follow, too.
    """
    large, small = (1, 0) if n[1] >= n[0] else (0, 1)
    each = min(n[small], -(-PAIRS // n[large]))
    more = rows.where(F.col("quality") == large).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    more = more.select((F.col("rank") * each + F.col("_turn")).alias("place"), F.pmod(F.col("rank") + F.col("_turn"), F.lit(n[small])).alias("rank"), F.col("features").alias("a"))
    other = rows.where(F.col("quality") == small).select("rank", F.col("features").alias("b"))
    met = more.join(other, "rank").withColumn("block", F.floor(F.col("place") / BLOCK))

    def gaps(table: pa.Table) -> np.ndarray:
        a, b = (np.clip((_matrix(b"".join(table.column(c).to_pylist())) - centre) / spread, -8, 8) for c in "ab")
        return a - b if large == 1 else b - a

    return _blocks(met, "pairs", gaps), n[large] * each


def learn(docs: DataFrame, labels: DataFrame, ridge: float = 2e-3, rounds: int = 25) -> Model:
    """Fit on every labelled document outside the held-out third.

    Labels that aren't 0 or 1 and null ids are passed over; of several labels of one id the highest counts, and of several documents of one id the least text:
    what is learnt from is one row for each id, however many documents have it.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    texts = labelled.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    each = written(_features(texts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, features binary"), "features")
    n = {0: 0, 1: 0} | {r.quality: r.n for r in each.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return fit(np.zeros((0, N_FORM)), np.zeros(0, bool))
    every = n[0] + n[1]
    rows = hashed_rank(each, ["quality"], ["doc_id"], into="rank").select("quality", (F.col("rank") - 1).alias("rank"), "features")
    block = 2 * F.floor(F.col("rank") / BLOCK) + F.col("quality")
    shown = _blocks(rows.select(block.alias("block"), F.col("rank").alias("place"), "features"), "known", lambda t: _matrix(b"".join(t.column("features").to_pylist())))
    sums = _summed(shown, lambda x: np.concatenate([x.sum(0), (x * x).sum(0)])) / every
    centre = sums[:N_FORM]
    spread = np.sqrt(np.maximum(sums[N_FORM:] - centre**2, 0)) + 1e-3
    gaps, pairs = _pairs(rows, n, centre, spread)

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = _summed(gaps, lambda x: np.concatenate([p.ravel() for p in _slopes(x, w)]))
        return got[:N_FORM], got[N_FORM:].reshape(N_FORM, N_FORM)

    w = _solved(slopes, lambda step: _longest(gaps, step), pairs, ridge, rounds)

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("x"):
                yield pa.RecordBatch.from_arrays([pa.array(np.clip((_matrix(blob.as_py()) - centre) / spread, -8, 8) @ w)], ["raw"])

    raw = written(shown.select("x").mapInArrow(raw_scores, "raw double"), "scores")
    model = _model(w, centre, spread, *value_of_rank(raw, "raw", n[0] - 1), _quantile(raw, every, 0.75) - _quantile(raw, every, 0.25))
    for table in (each, shown, gaps, raw):
        discard(table)
    return model


def score(docs: DataFrame, model: Model, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns of `docs` with score and predicted, named `into`; null texts are scored as empty ones."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([model.score(form(w, w.hashes())) for w in pieces(batch.column("text"))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, *into])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; an empty table gives none, repeated rows get equal scores."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject; columns as before."""
    return score(docs, learn(docs, labels), ("_quality_score", "_quality_predicted")).where("_quality_predicted = 1").select(*docs.columns)
