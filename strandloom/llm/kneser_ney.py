"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each task sorts and sums its pairs (context, token), cuts them by the context's hash into ranges and
sends each range's arrays as one row, so a frequent pair is sent once a task. A range's arrays are summed and
written to the shared folder as sorted hash arrays; numbers of distinct contexts go on to ranges of the token.
Scoring: workers map the files into memory and look up the distinct pairs of some texts at a time by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hash_files import Lookup, every_range, new_folder, range_bits, range_of, runs, save
from .text_arrays import mixed, pieces

U64 = np.uint64
#: Tokens that aren't words, and the multiplier that joins a pair's hashes to one.
BEGIN, END, JOIN = U64(0x5BD1E9955BD1E995), U64(0xC2B2AE3D27D4EB4F), U64(0x9FB21C651E98DF25)
#: Columns of a range's file: key and count of each pair; context, its count and its pairs counted once, twice and more.
PAIR_COLUMNS = (U64, np.uint32, U64, np.int64, np.uint32, np.uint32, np.uint32)
#: Pairs that a task gathers before it sorts them, and bytes of text scored at once.
FLUSH_PAIRS = 1 << 21
PIECE_BYTES = 6 << 20


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pair_keys(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(contexts * JOIN + tokens)


def tokens_of(words) -> tuple[np.ndarray, np.ndarray]:
    """Context and token hashes of all texts in a row; each text has one token more than words."""
    hashes = words.hashes()
    return np.insert(hashes, words.bounds[:-1], BEGIN), np.insert(hashes, words.bounds[1:], END)


def summed(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of context, then token, with the sums of their counts."""
    order = np.lexsort((tokens, contexts))
    contexts, tokens, counts = contexts[order], tokens[order], counts[order]
    new = np.ones(len(contexts), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (tokens[1:] != tokens[:-1])
    at = np.flatnonzero(new)
    return contexts[at], tokens[at], np.add.reduceat(counts, at) if len(at) else counts


@dataclass
class Model:
    """Where the arrays lie, and the figures that all tokens share."""

    pairs: Lookup
    spreads: Lookup
    tokens: int = 0
    types: int = 0
    pair_types: int = 0
    pair_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    type_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    type_counts: tuple[int, ...] = (0, 0, 0)

    def scores(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after its context, and the token's training count."""
        pair, first, back = np.unique(pair_keys(contexts, tokens), return_index=True, return_inverse=True)
        context, token = contexts[first], tokens[first]
        (count,) = self.pairs.found(context, pair, 0, (1,))
        kinds, back_c = np.unique(context, return_inverse=True)
        total, n1, n2, n3 = self.pairs.found(kinds, kinds, 2, (3, 4, 5, 6))
        words, back_t = np.unique(token, return_inverse=True)
        (spread,) = self.spreads.found(words, words, 0, (1,))
        # every word is the context of what follows it; there are as many ends as beginnings
        (seen,) = self.pairs.found((own := np.where(words == END, BEGIN, words)), own, 2, (3,))
        d, e = np.array([0.0, *self.pair_discounts]), np.array([0.0, *self.type_discounts])
        left = sum(x * y for x, y in zip(self.type_discounts, self.type_counts)) / self.pair_types if self.pair_types else 1.0
        low = (spread - e[np.minimum(spread, 3)]) / max(self.pair_types, 1) + left / (self.types + 1)
        whole = np.maximum(total, 1)
        back_off = np.where(total > 0, (self.pair_discounts[0] * n1 + self.pair_discounts[1] * n2 + self.pair_discounts[2] * n3) / whole, 1.0)
        p = (count - d[np.minimum(count, 3)]) / whole[back_c] + back_off[back_c] * low[back_t]
        return np.log10(p)[back], seen[back_t][back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types counted 1 to 4 times, held between 0 and the count; 0.75 of a count where a number is 0."""
    if not n1 or not n2 or not n3:
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in enumerate(raw, 1))


def train(docs: DataFrame) -> Model:
    """Count the bigrams of all texts of `docs` and write the model's arrays to the shared folder."""
    bits, folder = range_bits(docs), new_folder(docs.sparkSession, "bigrams")

    def blobs(contexts: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        c, t, n = summed(np.concatenate(contexts), np.concatenate(tokens), np.ones(sum(map(len, tokens)), np.uint32))
        number = range_of(c, bits)
        at = np.append(runs(number), len(c))
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(at[:-1], at[1:]):
            start = runs(c[a:b])
            for row, x in zip(rows, (int(number[a]), c[a:b][start].tobytes(), np.diff(np.append(start, b - a)).astype(np.uint32).tobytes(), t[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes())):
                row.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["range", "contexts", "lengths", "tokens", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        for batch in batches:
            for w in pieces(batch.column("text"), lower=True):
                c, t = tokens_of(w)
                contexts.append(c)
                tokens.append(t)
                if sum(map(len, tokens)) >= FLUSH_PAIRS:
                    yield from blobs(contexts, tokens)
                    contexts, tokens = [], []
        if tokens:
            yield from blobs(contexts, tokens)

    figures = ["n1", "n2", "n3", "n4", "total"]

    def write_pairs(key: tuple, table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        c, t, n = summed(np.repeat(joined("contexts", U64), joined("lengths", np.uint32)), joined("tokens", U64), joined("counts", np.uint32).astype(np.int64))
        start = runs(c)
        each = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        keys = pair_keys(c, t)
        order = np.argsort(keys)
        save(f"{folder}/pairs-{key[0].as_py()}", keys[order], n[order].astype(np.uint32), c[start], each(n), *(each(test).astype(np.uint32) for test in (n == 1, n == 2, n >= 3)))
        types, spread = np.unique(t, return_counts=True)
        number = range_of(types, bits)
        at = np.append(runs(number), len(types))
        out = {"range": number[at[:-1]], "tokens": [types[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], "spread": [spread[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:])]}
        for k, name in enumerate(figures):
            value = int((n == k + 1).sum()) if k < 4 else int(n.sum())
            out[name] = [value] + [0] * (len(at) - 2) if len(types) else []
        return pa.table({k: pa.array(v, pa.int32() if k == "range" else pa.binary() if k in ("tokens", "spread") else pa.int64()) for k, v in out.items()})

    def write_types(key: tuple, table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table.column("tokens")])
        spread = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("spread")]).astype(np.int64)
        types, back = np.unique(tokens, return_inverse=True)
        sums = np.bincount(back, weights=spread).astype(np.int64)
        save(f"{folder}/types-{key[0].as_py()}", types, sums.astype(np.uint32))
        values = [len(types), int(sums.sum()), *(int((sums == k).sum()) for k in range(1, 5)), int((sums >= 3).sum()), *(sum(table.column(x).to_pylist()) for x in figures)]
        return pa.table([pa.array([v], pa.int64()) for v in values], names=["types", "pair_types", "m1", "m2", "m3", "m4", "m3_up", *figures])

    pairs = docs.select("text").mapInArrow(count, "range int, contexts binary, lengths binary, tokens binary, counts binary")
    spreads = every_range(pairs, bits).groupBy("range").applyInArrow(write_pairs, "range int, tokens binary, spread binary, " + ", ".join(f"{x} long" for x in figures))
    names = ["types", "pair_types", "m1", "m2", "m3", "m4", "m3_up", *figures]
    sums = every_range(spreads, bits).groupBy("range").applyInArrow(write_types, ", ".join(f"{x} long" for x in names))
    got = {k: int(v or 0) for k, v in sums.agg(*(F.sum(x).alias(x) for x in names)).first().asDict().items()}
    return Model(Lookup(folder, "pairs", bits, PAIR_COLUMNS), Lookup(folder, "types", bits, (U64, np.uint32)), got["total"], got["types"], got["pair_types"], discounts(*(got[f"n{k}"] for k in range(1, 5))), discounts(*(got[f"m{k}"] for k in range(1, 5))), (got["m1"], got["m2"], got["m3_up"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; log10 sums over the words and the end."""
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for w in pieces(batch.column("text"), lower=True, piece_bytes=PIECE_BYTES):
                logs, seen = model.scores(*tokens_of(w))
                text = np.repeat(np.arange(len(w.counts)), w.counts + 1)
                base = np.log10((seen + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                each = lambda x, n=len(w.counts), text=text: np.bincount(text, weights=x, minlength=n)
                parts.append((w.counts + 1, each(seen > 0).astype(np.int64), each(base), each(logs)))
            if parts:
                n, known, base, logs = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(logs)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Every row scored by a model of the rows that aren't held out.

    A null text is an empty one and has the end as its only token. Without training rows each token has probability 1.
    Rows with equal texts get equal scores; an empty table gives no rows. Further columns of `docs` aren't carried along.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
