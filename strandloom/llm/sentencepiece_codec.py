"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct segments of a batch lie in flat numpy symbol arrays. In each round every segment finds its
least pair rank (a segmented minimum) and merges that pair's occurrences from the left; the arrays are
then compacted, and segments without a known pair leave. The library pops one pair at a time; merging
all occurrences of a segment's best pair at once gives the same pieces unless a merge makes a new pair
that ranks no worse, and a segment where that happens merges only its leftmost pair in that round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_arrays import flat, run_hashes

META = "▁"
NEVER = np.int32(2**31 - 1)
#: Symbols that are merged together, and bytes of text that are worked on at once, unless one text has more.
CHUNK_SYMBOLS = 1 << 17
PIECE_BYTES = 3 << 20
_space = ord(" ")
_newline = ord("\n")


class Codec:
    """Tables of one BPE model with byte fallback, dummy prefix and no other normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        if any(sp.is_unused(i) for i in range(size)) or sum(map(sp.is_byte, range(size))) != 256:
            raise ValueError("a BPE model with all byte pieces and no unused ones is needed")
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(META in p.lstrip(META) or ("\n" in p and len(p) > 1) for p in normal):
            raise ValueError("a piece of this model runs over the start of a word")
        self.size = size
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[_space] = self.char[ord(META)]
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        #: a character that only longer pieces hold can't be merged by id
        if any(self.char[ord(c)] < 0 for p in normal for c in p):
            raise ValueError("a piece of this model has a character that is no piece")
        pairs = sorted((normal[p[:k]] * size + normal[p[k:]], levels[sp.get_score(i)], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs], np.int32)
        self.into = np.array([x[2] for x in pairs], np.int32)
        self.byte = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
        self.texts = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        self.decimals = [b"%d," % i for i in range(size)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NEVER), self.into[at]

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each owner's run of symbols as far as pairs go; owners ascend, and do so in the result."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NEVER, np.int32)
        into = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            r, m = self.pair(symbols[:-1], symbols[1:])
            rank[:-1], into[:-1] = np.where(same, r, NEVER), m
        while len(symbols):
            first = np.ones(len(symbols), bool)
            first[1:] = owner[1:] != owner[:-1]
            starts = np.flatnonzero(first)
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            if (ended := best == NEVER).any():
                done.append((owner[ended], symbols[ended]))
                live = ~ended
                symbols, owner, rank, into, best = symbols[live], owner[live], rank[live], into[live], best[live]
                if not len(symbols):
                    break
            hit = rank == best
            # of pairs that overlap in a run of equal ones, every second one is merged
            at = np.flatnonzero(hit)
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) > 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            at = self._safe(symbols, owner, rank, into, best, at)
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.zeros(len(symbols), bool)
            moved[at] = True
            symbols, owner, rank, into, moved = symbols[keep], owner[keep], rank[keep], into[keep], moved[keep]
            # pairs whose left or right symbol is new
            changed = moved.copy()
            changed[:-1] |= moved[1:]
            redo = np.flatnonzero(changed)
            after = np.minimum(redo + 1, len(symbols) - 1)
            r, m = self.pair(symbols[redo], symbols[after])
            rank[redo] = np.where((after > redo) & (owner[after] == owner[redo]), r, NEVER)
            into[redo] = m
        if not done:
            return np.zeros(0, owner.dtype), np.zeros(0, np.int32)
        owner, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return owner[order], symbols[order]

    def _safe(self, symbols, owner, rank, into, best, at):
        """The merges of `at` that can be made at once: all of an owner's, or the leftmost where order matters."""
        n = len(symbols)
        merged, own, limit = into[at], owner[at], best[at]
        alone = np.ones(len(at), bool)
        alone[1:] &= own[1:] != own[:-1]
        alone[:-1] &= own[1:] != own[:-1]
        if alone.all():
            return at
        right = np.minimum(at + 2, n - 1)
        r = np.where((right == at + 2) & (owner[right] == own), self.pair(merged, symbols[right])[0], NEVER)
        left = np.maximum(at - 1, 0)
        before = symbols[left].copy()
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] - at[:-1] == 2
        before[follows] = merged[np.flatnonzero(follows) - 1]
        left_owner = owner[left]
        r = np.minimum(r, np.where((at > 0) & (left_owner == own), self.pair(before, merged)[0], NEVER))
        other = np.zeros(len(at), bool)
        other[1:] = (own[1:] == own[:-1]) & (merged[1:] != merged[:-1])
        risky = np.unique(own[(r <= limit) | other])
        if not len(risky):
            return at
        head = np.ones(len(at), bool)
        head[1:] = own[1:] != own[:-1]
        return at[head | ~np.isin(own, risky)]

    def segments(self, text: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Of segments that lie in a row in `text`: ids as decimals with commas, decoded text, and number of ids."""
        decimals: list[bytes] = []
        decoded: list[bytes] = []
        counts: list[np.ndarray] = []
        i, n = 0, len(bounds) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_SYMBOLS, side="right")) - 1)
            part = text[bounds[i] : bounds[j]]
            points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.flatnonzero((part & 0xC0) != 0x80)
            owner = (np.searchsorted(bounds[i : j + 1] - bounds[i], starts, side="right") - 1).astype(np.int32)
            symbols = self.char[points]
            unknown = symbols < 0
            symbols[unknown] = -points[unknown].astype(np.int32) - 1
            owner, symbols = self.merge(symbols, owner)
            if (symbols < 0).any():
                owner, symbols = self._bytes(owner, symbols)
            at = np.searchsorted(owner, np.arange(j - i + 1))
            ids, ends = symbols.tolist(), at.tolist()
            digits, texts = [self.decimals[x] for x in ids], [self.texts[x] for x in ids]
            decimals += [b"".join(digits[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            decoded += [b"".join(texts[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            counts.append(np.diff(at))
            i = j
        return decimals, decoded, np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _bytes(self, owner, symbols):
        """Characters that aren't pieces become the pieces of their UTF-8 bytes."""
        spelled: dict[int, np.ndarray] = {int(x): self.byte[np.frombuffer(chr(-int(x) - 1).encode("utf-8", "surrogatepass"), np.uint8)] for x in np.unique(symbols[symbols < 0])}
        widths = np.ones(len(symbols), np.int64)
        for x, ids in spelled.items():
            widths[symbols == x] = len(ids)
        out = np.repeat(symbols, widths)
        starts = np.cumsum(widths) - widths
        for x, ids in spelled.items():
            at = starts[symbols == x]
            for k, y in enumerate(ids):
                out[at + k] = y
        return np.repeat(owner, widths), out


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def encode_texts(coder: Codec, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
    """For each text: number of ids, ids in decimal joined by commas, and the decoded text in UTF-8."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        full = np.diff(own) > 0
        # a space goes before each text that isn't empty
        part = np.insert(data[offsets[i] : offsets[j]], own[:-1][full], np.uint8(_space))
        own = own + np.concatenate([[0], np.cumsum(full)])
        blank, line = part == _space, part == _newline
        start = line.copy()
        start[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
        if (sign := np.flatnonzero((part[:-3] == 0xE2) & (part[1:-2] == 0x96) & (part[2:-1] == 0x81) & blank[3:])).size:
            start[sign + 3] = False  # the sign itself stands for a space
        start[own[:-1][full]] = True
        starts = np.flatnonzero(start)
        bounds = np.append(starts, len(part))
        first, inverse = _distinct(part, bounds)
        lengths = (bounds[1:] - bounds[:-1])[first]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(bounds[:-1][first] - ends[:-1], lengths) + np.arange(ends[-1])
        decimals, decoded, counts = coder.segments(part[gather], ends)
        at = np.searchsorted(starts, own)
        sums = np.concatenate([[0], np.cumsum(counts[inverse])]) if len(inverse) else np.zeros(1, np.int64)
        picks = inverse.tolist()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            mine = picks[a:b]
            yield int(sums[b] - sums[a]), b"".join([decimals[x] for x in mine])[:-1], b"".join([decoded[x] for x in mine])[1:]
        i = j


def _distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct run of bytes between bounds, and for each run which it equals: by hash, and then by all their bytes."""
    starts, lengths = bounds[:-1], np.diff(bounds)
    _, first, inverse = np.unique(run_hashes(data, starts, bounds[1:]), return_index=True, return_inverse=True)
    twin = first[inverse]
    same = lengths == lengths[twin]
    checked = np.flatnonzero(same & (twin != np.arange(len(twin))))
    if len(checked):
        n = lengths[checked]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        equal = data[np.repeat(starts[checked], n) + place] == data[np.repeat(starts[twin[checked]], n) + place]
        same[checked] = np.logical_and.reduceat(equal, begin)
    if not same.all():  # runs that only their hash makes equal
        raw = data.tobytes()
        _, first, inverse = np.unique(np.array([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], object), return_index=True, return_inverse=True)
    return first, inverse


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if `keep_ids`.

    A null text counts as empty: no ids, and the digests of nothing. Rows are taken one by one, repeated ones too; an
    empty table gives none. Further columns of `docs` aren't carried along. The model's bytes go to the executors with the tasks.
    """
    model = Path(model_path).read_bytes()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            n, ids, texts, lists = [], [], [], []
            for count, digits, text in encode_texts(coder, batch.column("text")):
                n.append(count)
                ids.append(hashlib.sha256(digits).hexdigest())
                texts.append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    lists.append(np.array(digits.split(b","), np.int32) if digits else np.zeros(0, np.int32))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(lists, pa.list_(pa.int32()))] if keep_ids else []), names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)
