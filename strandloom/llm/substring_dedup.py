"""Removal of passages that a document with a smaller id has too, by windows of doubling length.

Levels have windows of 13, 25 and 50 words: each is twice the one before, less one where that would overshoot. What is followed
are the runs of 50 words. At each level a run stands for its window of least hash, so equal runs stand for equal windows; runs whose
window no other document has are dropped, and the others go on to the next length, until none are left or the last length, that of the run
itself, decides: a run that starts in a smaller document loses all its words. Rows are sorted by hash and streamed, never gathered, so one
passage in many documents takes no more memory than another; and each task settles what its own documents share before rows are dealt out by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .membership import possible
from .text_arrays import SEEDS, Words, pieces, signed

#: Words of a window whose repetition counts, lengths on the way to it and itself, and rows that a task compares among themselves before it deals them out.
WINDOW = 50
LEVELS = 3
FLUSH = 1 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i; the last width - 1 results are of no use."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def levels(window: int) -> list[int]:
    """Lengths of windows, LEVELS of them at most, the last being `window`: each is half the next, rounded up."""
    out = [window]
    while len(out) < LEVELS and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def chosen(words: Words, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the hash of `width` words that stands for the run of `window` words starting there, and whether such a run exists."""
    hashes, _ = words.windows(words.hashes(), width)
    n = len(hashes)
    inside = np.arange(n) + window <= np.repeat(words.bounds[1:], words.counts)
    return sliding_least(hashes, window - width + 1) if n else hashes, inside


def surviving(words: Words, window: int, width: int, wanted: pa.Array) -> np.ndarray:
    """Which runs stand for one of their document's `wanted` hashes (a list for each text) at this width."""
    least, inside = chosen(words, window, width)
    values = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(words.counts)), np.diff(wanted.offsets.to_numpy()))
    # a hash is looked for among its own document's only
    salt = np.uint64(0x9E3779B97F4A7C15)
    return inside & np.isin(least + (words.texts.astype(np.uint64) + np.uint64(1)) * salt, values + (owner.astype(np.uint64) + np.uint64(1)) * salt)


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows of one id apart, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("row"), "text")


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    first = np.zeros(len(sorted_columns[0]), bool)
    first[:1] = True
    for c in sorted_columns:
        first[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(first)


def _dealt(rows: DataFrame, settled: str, order: list[str]) -> DataFrame:
    """Rows dealt by their hash h and sorted; those that are settled already are dealt anywhere."""
    return rows.repartition(F.when(F.col(settled), F.xxhash64(*order, "row")).otherwise(F.col("h"))).sortWithinPartitions(*order)


def level_windows(docs: DataFrame, window: int, width: int, before: int | None) -> DataFrame:
    """h, doc_id, row, shared, settled: the windows that stand for each document's runs at this level, each once.

    Of the level `before` only the runs in the column `wanted` are followed. Of a window that several of the task's documents have, one row is
    dealt by its hash; the others are known to be shared and dealt anywhere, so a window in very many documents doesn't fill one task.
    """

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, doc, row = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, h))
        h, doc, row = h[order], doc[order], row[order]
        start = _runs(h)
        size = np.diff(np.append(start, len(h)))
        shared = np.repeat(doc[start] != doc[start + size - 1], size)
        settled = shared.copy()
        settled[start] = False
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(row), pa.array(shared), pa.array(settled)], ["h", "doc_id", "row", "shared", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            at = 0
            for w in pieces(batch.column("text")):
                least, alive = chosen(w, window, width)
                if before is not None:
                    alive = surviving(w, window, before, batch.column("wanted").slice(at, len(w.counts)))
                at += len(w.counts)
                least, text = least[alive], w.texts[alive]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                own = w.first + text[new]
                parts.append((signed(least[new]), ids[own], keys[own]))
                if sum(len(p[0]) for p in parts) >= FLUSH:
                    yield flush(parts)
                    parts = []
        if parts:
            yield flush(parts)

    return docs.mapInArrow(run, "h long, doc_id long, row int, shared boolean, settled boolean")


def shared_only(sorted_rows: DataFrame) -> DataFrame:
    """h, doc_id and row, of rows sorted by h, then doc_id: those whose h has two doc_ids, or is known to be shared."""
    names = ["h", "doc_id", "row", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last h while it isn't known to be shared: all of one document
        last: int | None = None  # the last h, if it is shared
        for batch in batches:
            table = pa.Table.from_batches([batch.select(names)])
            if last is not None and table.num_rows:
                h = table.column("h").to_numpy()
                more = int(np.searchsorted(h, last, side="right")) if h[0] == last else 0
                if more:
                    yield from table.slice(0, more).select(names[:3]).to_batches()
                    table = table.slice(more)
                if table.num_rows:
                    last = None
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
                held = None
            if not table.num_rows:
                continue
            h, doc = table.column("h").to_numpy(), table.column("doc_id").to_numpy()
            starts = _runs(h)
            ends = np.append(starts[1:], len(h))
            many = (doc[starts] != doc[ends - 1]) | (np.add.reduceat(table.column("shared").to_numpy().astype(np.int64), starts) > 0)
            if many[-1]:
                last, stop = int(h[-1]), len(h)
            else:
                stop = int(starts[-1])
                held = table.slice(stop)
            keep = np.repeat(many, ends - starts)
            keep[stop:] = False
            if keep.any():
                yield from table.select(names[:3]).filter(pa.array(keep)).to_batches()

    return sorted_rows.mapInArrow(run, "h long, doc_id long, row int")


def full_windows(docs: DataFrame, window: int, before: int) -> DataFrame:
    """h, g, doc_id, row, start, later: the runs of `docs` that are left of the level `before`; h and g make 96 bits of hash, from two hashes of each word.

    A window that a smaller document of the task has too is known to be a later one and dealt anywhere; so of a window in very many
    documents each task deals one row by its hash.
    """
    names = ["h", "g", "doc_id", "row", "start", "later"]

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, g, doc, row, start = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, g, h))
        h, g, doc, row, start = h[order], g[order], doc[order], row[order], start[order]
        begin = _runs(h, g)
        later = doc > np.repeat(doc[begin], np.diff(np.append(begin, len(h))))
        h, g = np.where(later, 0, h), np.where(later, np.int32(0), g)  # nothing else is asked of these rows
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, doc, row, start, later)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            at = 0
            for w in pieces(batch.column("text")):
                hit = surviving(w, window, before, batch.column("wanted").slice(at, len(w.counts)))
                at += len(w.counts)
                text = w.texts
                spot = np.flatnonzero(hit)
                if not len(spot):
                    continue
                h, _ = w.windows(w.hashes(), window)
                g, _ = w.windows(w.hashes(SEEDS[1]), window)
                rows = w.first + text[spot]
                parts.append((signed(h[spot]), (g[spot] >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[rows], keys[rows], (spot - w.bounds[text[spot]]).astype(np.int32)))
                if sum(len(p[0]) for p in parts) >= FLUSH:
                    yield flush(parts)
                    parts = []
        if parts:
            yield flush(parts)

    return docs.mapInArrow(run, "h long, g int, doc_id long, row int, start int, later boolean")


def later_only(sorted_rows: DataFrame) -> DataFrame:
    """Of rows sorted by h, g and doc_id: those whose (h, g) has a smaller doc_id too, or that are known to be later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, doc = (batch.column(x).to_numpy() for x in ("h", "g", "doc_id"))
            starts = _runs(h, g)
            least = doc[starts].copy()
            if last is not None and (h[0], g[0]) == last[:2]:
                least[0] = last[2]
            last = (h[-1], g[-1], least[-1])
            later = (doc > np.repeat(least, np.diff(np.append(starts, len(h))))) | batch.column("later").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(later)) for x in ("doc_id", "row", "start")], ["doc_id", "row", "start"])

    return sorted_rows.mapInArrow(run, "doc_id long, row int, start int")


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which of n_words words lie in a window that begins at one of `starts`."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n_words), -1)
    return np.cumsum(change)[:-1] > 0


def _kept(docs: DataFrame, window: int, as_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed and the digest or text of the kept words, given an array `starts` or none."""
    last = "kept_text" if as_text else "kept_sha256"
    has_starts = "starts" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for w in pieces(batch.column("text")):
                raw = w.data.tobytes()
                for i in range(len(w.counts)):
                    words = raw[w.offsets[i] : w.offsets[i + 1]].split()
                    n = len(words)
                    starts = batch.column("starts")[w.first + i].values if has_starts and batch.column("starts")[w.first + i].is_valid else None
                    if starts is not None and len(starts):
                        gone = covered(starts.to_numpy(), n, window)
                        words = [x for x, y in zip(words, gone.tolist()) if not y]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    text = b" ".join(words)
                    out.append(text.decode() if as_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", last])

    return docs.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, as_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or kept_text) of every row.

    Null and empty texts have no words. Rows with a null id are left whole and take nothing from others; rows of one id
    take nothing from each other. An empty table gives no rows. Further columns of `docs` aren't carried along.
    """
    rows = _with_key(docs)
    known = rows.where("doc_id is not null")
    lengths = levels(window)[:-1] or [window]
    candidates, before = known, None
    for width in lengths:
        shared = shared_only(_dealt(level_windows(candidates, window, width, before), "settled", ["h", "doc_id"]))
        per_document = written(shared.groupBy("doc_id", "row").agg(F.collect_set("h").alias("wanted")), "windows")
        if per_document.isEmpty():
            return _kept(rows.select("doc_id", "text"), window, as_text)
        likely, _ = possible(known, "doc_id", per_document.select("doc_id"))
        candidates, before = likely.join(per_document, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted"), width
    extended = full_windows(candidates, window, before)
    starts = later_only(_dealt(extended, "later", ["h", "g", "doc_id"]))

    removals = written(starts.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts")), "removals")
    touched, whole = possible(rows, "doc_id", removals.select("doc_id"))
    cut = touched.join(removals, ["doc_id", "row"], "left").select("doc_id", "text", "starts")
    return _kept(cut, window, as_text).unionByName(_kept(whole.select("doc_id", "text"), window, as_text))
