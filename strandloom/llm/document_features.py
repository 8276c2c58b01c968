"""Numbers that describe a text's form and its words, for the models of this subpackage."""

from __future__ import annotations

import numpy as np

from .text_arrays import Words

#: Classes of bytes by which a text's form is described.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", "!?", "|", "#*$%&<>", "\"'()-:;[]{}/\\+=@^_`~")
N_CLASSES = len(CLASSES) + 2
CLASS = np.full(256, len(CLASSES), np.uint8)
CLASS[128:] = len(CLASSES) + 1
for _i, _chars in enumerate(CLASSES):
    CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
N_FORM = N_CLASSES * N_CLASSES + 8
BUCKETS = 1 << 14


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeats(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each text's values are equal to another one before them; each text is sorted by itself."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    same = np.zeros(len(values) + 1, np.int64)
    if len(values) > 1:
        same[2:] = values[1:] == values[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(values))]
        same[inner + 1] = 0
    sums = np.cumsum(same)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def form(words: Words, hashes: np.ndarray) -> np.ndarray:
    """N_FORM numbers for each text: roots of the shares of neighbouring byte classes, length, word and line repetition. Zeros for empty texts."""
    n, text = len(words.bounds) - 1, words.texts
    size = np.diff(words.offsets)
    kinds = CLASS[words.data].astype(np.int64)
    pairs = np.zeros((n, N_CLASSES * N_CLASSES))
    if len(kinds) > 1:
        owner = np.repeat(np.arange(n), size)
        same = owner[1:] == owner[:-1]
        code = owner[:-1] * (N_CLASSES * N_CLASSES) + kinds[:-1] * N_CLASSES + kinds[1:]
        pairs = np.bincount(code[same], minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1) / np.maximum(size, 1)[:, None]
    count = words.counts
    again = repeats(hashes, words.bounds)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    grams, inside = words.windows(hashes, 4)
    copied = repeats(grams[inside], np.concatenate([[0], np.cumsum(inside)])[words.bounds])
    lines = np.bincount(np.repeat(np.arange(n), size)[words.data == 10], minlength=n) + (size > 0)
    lengths = np.bincount(text, weights=(words.ends - words.starts), minlength=n)
    last = words.data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    stops = np.bincount(text[np.isin(last, np.frombuffer(b".!?", np.uint8))], minlength=n)
    dense = np.column_stack(
        [
            np.log1p(count),
            _share(lengths, count) / 10,
            _share(again, count) / np.log1p(np.maximum(count, 1)),
            _share(np.bincount(text[twin], minlength=n), count),
            _share(copied, count),
            np.log1p(_share(count, lines)),
            _share(stops, count),
            (count < 20).astype(float),
        ]
    )
    return np.hstack([np.sqrt(pairs), dense])


def word_buckets(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash buckets of each text's words, text by text, and their bounds."""
    code = np.unique(words.texts * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
    return (code % BUCKETS).astype(np.int32), np.searchsorted(code, np.arange(len(words.bounds)) * BUCKETS)


