"""N-gram Jaccard join in the metric space of shingle sets, with distance 1 - intersection / union.

1. Texts with the same set are one class; classes are what is joined.
2. Regions. The pivots of the whole space are its shingles, in an order of rising document frequency: a set lies
   nearest the pivot that comes first in it. A set within the distance limit of one in that region holds one of its
   own first n - ceil(t n) + 1 shingles as a pivot, by the triangle inequality through the empty set on the part of
   the space before the pivot; that window replicates it to the regions of those shingles. Sets that meet in a
   region, directly or by others, make up a larger region that no link leaves.
3. Inside such a region documents are pivots. A document's home is its nearest pivot; a pivot's ball holds the documents linked
   with it. By the triangle inequality a document can be linked with one in the ball of pivot j only if it lies within twice the distance of a
   link from j, and with one whose home is j only if it lies at most that much further from j than from its own home: these windows
   replicate documents to other pivots' balls and cells, which are regions again. Pivots are compared with everything in their
   region and go nowhere, so it ends, with a region of a handful in which all are pivots. What is joined already isn't compared again: a dense
   group is settled by its pivots, however large it is.

Common passages come last in the order, so regions are about as small as the groups of near copies. Any order gives
the same links. Shingles are told apart by 64 bits of hash, sets of them by 128.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, local_labels
from ..sources.work import written
from .hash_files import Lookup, every_range, new_folder, range_bits, range_of, runs, save
from .membership import possible
from .text_arrays import Words, mixed, pieces, signed, span_hashes

U64 = np.uint64
#: Share of all shingles, those of least hash, whose document frequency is counted, and the frequency from which it is kept.
COUNTED = 0.4
FREQUENT = 2
#: Shingles that a task gathers before it sorts them.
FLUSH = 1 << 20
#: What makes a second hash of a set.
OTHER_SALT = 0x8EBC6AF09C88C6E3
#: Sets of a region that is cut inside one task; larger ones are cut across tasks.
REGION_SETS = 512
#: Sets that are all pivots.
HANDFUL = 4
#: Pivots by which a region of many tasks is cut: one for so many sets, but at first at least and always at most so many; and its documents that a task
#: compares with them at once.
SETS_PER_PIVOT = 4
PIVOTS = 24
MOST_PIVOTS = 1024
CHUNK = 512
#: Shingles of a matrix product, and pairs that are listed, at once.
DENSE = 2048
LISTED = 1 << 19
#: Turns from one division by shingles to the next.
SHINGLE_TURNS = 2


@dataclass(frozen=True)
class Limit:
    """Words of a shingle and the least similarity, in percent."""

    width: int = 4
    percent: int = 85

    @property
    def share(self) -> Fraction:
        return Fraction(self.percent, 100)

    def linked(self, both: np.ndarray, union: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * union

    def near(self, both: np.ndarray, union: np.ndarray) -> np.ndarray:
        """At up to twice the distance of a link."""
        return 100 * both >= (2 * self.percent - 100) * union

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        return sizes - -(-self.percent * sizes // 100) + 1


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, ascending within each, and the texts' bounds among them.

    A text of fewer words than `width` has its whole sequence as one; one without words has none.
    """
    hashes, counts = words.hashes(), words.counts
    grams, inside = words.windows(hashes, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = span_hashes(hashes, words.bounds[short], words.bounds[short + 1])
    if len(short):
        at = words.bounds[short]
        grams = grams.copy()
        grams[at], inside[at] = whole, True
    bounds = np.concatenate([[0], np.cumsum(inside)])[words.bounds]
    grams = grams[inside]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams[a:b].sort()
    text = np.repeat(np.arange(len(counts)), np.diff(bounds))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def class_hashes(grams: np.ndarray, bounds: np.ndarray, salt: int = 0x632BE59BD9B4E019) -> np.ndarray:
    """One hash for each set."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(grams + U64(salt)), dtype=U64)])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64) * U64(0x9E3779B97F4A7C15))


def sets_of(docs: DataFrame, limit: Limit) -> DataFrame:
    """doc_id, row (a hash that tells rows of one id apart), n_shingles, and set and set2 (two hashes, null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in pieces(batch.column("text"), lower=True):
                grams, bounds = shingle_sets(w, limit.width)
                n = np.diff(bounds)
                own = [batch.column(c).slice(w.first, len(n)) for c in ("doc_id", "row")]
                both = (pa.array(signed(class_hashes(grams, bounds, *salt)), mask=n == 0) for salt in ((), (OTHER_SALT,)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *both], ["doc_id", "row", "n_shingles", "set", "set2"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, set long, set2 long")


def _ranged(kind: int, values: np.ndarray, others: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows (range, values, others) of hashes in ascending order."""
    number = range_of(values, bits)
    at = np.append(runs(number), len(values))
    for a, b in zip(at[:-1], at[1:]):
        yield int(number[a]) + kind, values[a:b].tobytes(), others[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "a", "b"])


_RANGED = "range int, a binary, b binary"


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def frequencies(docs: DataFrame, limit: Limit, bits: int, counted: float = COUNTED) -> Lookup:
    """Files of the shingles among the counted ones that FREQUENT documents or more have, with the rounded logarithm of how many."""
    folder = new_folder(docs.sparkSession, "frequencies")
    most = U64(min(int(counted * 2**64), 2**64 - 1))

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        if len(values):
            yield _batch(list(_ranged(0, values, counts.astype(np.uint32), bits)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            for w in pieces(batch.column("text"), lower=True):
                grams, _ = shingle_sets(w, limit.width)
                parts.append(grams[grams < most])
                if sum(map(len, parts)) >= FLUSH:
                    yield from flush(parts)
                    parts = []
        if parts:
            yield from flush(parts)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        values, back = np.unique(_joined(table, "a", U64), return_inverse=True)
        counts = np.bincount(back, weights=_joined(table, "b", np.uint32))
        keep = counts >= FREQUENT
        save(f"{folder}/shingles-{key[0].as_py()}", values[keep], np.log2(counts[keep]).astype(np.uint8))
        return pa.table([pa.array([int(keep.sum())], pa.int64())], names=["n"])

    every_range(docs.select("text").mapInArrow(count, _RANGED), bits).groupBy("range").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return Lookup(folder, "shingles", bits, (U64, np.uint8))


def region_links(docs: DataFrame, limit: Limit, order: Lookup, bits: int, counted: float = COUNTED) -> DataFrame:
    """a, b: links of sets that lie in one shingle's region; each region's sets are linked with one of them.

    Regions are joined inside each task first, so a shingle goes from a task to its range once, however many sets have it.
    """
    most = U64(min(int(counted * 2**64), 2**64 - 1))

    def flush(tokens: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, s = np.concatenate(tokens), np.concatenate(sets)
        if not len(t):
            return
        by = np.lexsort((s, t))
        t, s = t[by], s[by]
        start = runs(t)
        first = np.repeat(s[start], np.diff(np.append(start, len(t))))
        pairs = np.unique(np.column_stack([s, first])[s != first], axis=0)
        rows = list(_ranged(0, t[start], s[start], bits))
        if len(pairs):
            rows.append((-1 - int(pairs[0, 0] >> U64(64 - 6)), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
        yield _batch(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            for w in pieces(batch.column("text"), lower=True):
                grams, bounds = shingle_sets(w, limit.width)
                n = np.diff(bounds)
                level = np.where(grams < most, 0, 100).astype(np.uint8)
                asked = np.flatnonzero(grams < most)
                values, back = np.unique(grams[asked], return_inverse=True)
                level[asked] = order.found(values, values, 0, (1,))[0][back]
                text = np.repeat(np.arange(len(n)), n)
                by = np.lexsort((grams, level, text))
                place_in_text = np.arange(len(grams)) - np.repeat(bounds[:-1], n)
                chosen = by[place_in_text < np.repeat(limit.prefix(n), n)]
                tokens.append(grams[chosen])
                sets.append(class_hashes(grams, bounds)[text[chosen]])
                if sum(map(len, tokens)) >= FLUSH:
                    yield from flush(tokens, sets)
                    tokens, sets = [], []
        if tokens:
            yield from flush(tokens, sets)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        a, b = _joined(table, "a", U64), _joined(table, "b", U64)
        if key[0].as_py() >= 0:
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            start = runs(a)
            first = np.repeat(b[start], np.diff(np.append(start, len(a))))
            a, b = b[b != first], first[b != first]
        pairs = np.unique(np.column_stack([a, b]), axis=0)
        return pa.table([pa.array(signed(np.ascontiguousarray(pairs[:, 0]))), pa.array(signed(np.ascontiguousarray(pairs[:, 1])))], names=["a", "b"])

    return docs.select("text").mapInArrow(place, _RANGED).groupBy("range").applyInArrow(link, "a long, b long")


class Sets:
    """Some sets in one task, with for each shingle the sets that have it."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray):
        self.sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        by = np.argsort(grams, kind="stable")
        self.owners = owner[by]
        start = runs(grams[by])
        self.n_tokens = len(start)
        self.tokens = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(by))))

    def _at(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle and place among `chosen` of each entry of theirs, in the order of shingles."""
        place = np.full(len(self.sizes), -1)
        place[chosen] = np.arange(len(chosen))
        at = place[self.owners]
        return self.tokens[at >= 0], at[at >= 0]

    def shared(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """How many shingles each of `rows` shares with each of `columns`.

        Shingles that many of both have are columns of a matrix product, some at a time (counts below 2**24 are exact in float32); of the others
        the pairs are listed, some at a time.
        """
        (t, r), (u, c) = self._at(rows), self._at(columns)
        k, n = len(rows), len(columns)
        in_rows, in_columns = np.bincount(t, minlength=self.n_tokens), np.bincount(u, minlength=self.n_tokens)
        pairs = in_rows * in_columns
        out = np.zeros((k, n), np.int64)
        many = np.flatnonzero(pairs * 64 > k * n)
        spot = np.full(self.n_tokens, -1)
        spot[many] = np.arange(len(many))
        for at in range(0, len(many), DENSE):
            width = min(DENSE, len(many) - at)
            left, right = np.zeros((k, width), np.float32), np.zeros((n, width), np.float32)
            for matrix, token, place in ((left, t, r), (right, u, c)):
                own = spot[token] - at
                here = (own >= 0) & (own < width)
                matrix[place[here], own[here]] = 1
            out += (left @ right.T).astype(np.int64)
        few = (spot < 0) & (pairs > 0)
        t_start = np.cumsum(in_rows) - in_rows
        u, c = u[few[u]], c[few[u]]
        times = in_rows[u]
        ends = np.cumsum(times)
        at = 0
        while at < len(u):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + LISTED, side="right")))
            own = times[at:stop]
            first = np.cumsum(own) - own
            entry = np.repeat(t_start[u[at:stop]] - first, own) + np.arange(own.sum())
            out += np.bincount(r[entry] * n + np.repeat(c[at:stop], own), minlength=k * n).reshape(k, n)
            at = stop
        return out


@dataclass
class Placed:
    """Where the sets of a region lie among its pivots: all arrays are pivots x sets but `home`."""

    home: np.ndarray
    ball: np.ndarray
    near: np.ndarray
    window: np.ndarray

    @classmethod
    def of(cls, both: np.ndarray, pivot_sizes: np.ndarray, sizes: np.ndarray, limit: Limit) -> Placed:
        """From the shared shingles of each pivot and set: the nearest pivot; who lies within the distance of a link of a pivot,
        within twice that, and no more than twice that further from it than from the nearest one."""
        union = pivot_sizes[:, None] + sizes[None, :] - both
        similarity = both / union
        home = similarity.argmax(0)
        widest = 2 * (1 - float(limit.share)) + 1e-9
        return cls(home, limit.linked(both, union), limit.near(both, union), similarity >= similarity.max(0) - widest)

    def guests(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inside, guests of balls and guests of cells, given which pivots are joined (by equal numbers).

        A set inside the ball of its home is linked with it. A set can be linked with what lies in the ball of pivot j and isn't joined with it
        only at up to twice the distance of a link from j. Sets that no ball takes meet among themselves in the cell of the lower of their
        homes, which the other's window reaches.
        """
        inside = self.ball[self.home, np.arange(len(self.home))]
        to_balls = self.near & ~(inside & (group[:, None] == group[self.home][None, :]))
        to_cells = self.window & (np.arange(len(group))[:, None] < self.home[None, :])
        return inside, to_balls, to_cells


def pivot_number(n: int, depth: int) -> int:
    """Pivots of a region in one task: about the root of its sets, more where it was cut before, all of a handful."""
    return n if n <= HANDFUL else min(n, math.isqrt(n) << min(depth, 20))


def voronoi_links(sets: Sets, limit: Limit) -> list[tuple[int, int]]:
    """Links that join whatever sets are linked, directly or by others: fewer than there are sets.

    A region's pivots are compared with all of its sets and settled by that. A ball with no more guests than natives is a region with them, a dense
    one settled at once if it has none. Other sets go to their cells and, where the windows would only copy them, on together with more
    pivots. Each region is smaller than its parent by the pivots at least.
    """
    label = np.arange(len(sets.sizes))
    links: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        if label[a] != label[b]:
            links.append((a, b))
            label[label == label[a]] = label[b]

    open_regions = [(np.arange(len(label)), 0)]
    while open_regions:
        members, depth = open_regions.pop()
        if len(members) < 2 or (label[members] == label[members[0]]).all():
            continue
        chosen = np.unique(np.linspace(0, len(members) - 1, pivot_number(len(members), depth)).astype(int))
        pivots = members[chosen]
        placed = Placed.of(sets.shared(pivots, members), sets.sizes[pivots], sets.sizes[members], limit)
        for j, x in np.argwhere(placed.ball).tolist():
            join(int(pivots[j]), int(members[x]))
        inside, to_balls, to_cells = placed.guests(label[pivots])
        free = np.ones(len(members), bool)
        free[chosen] = False
        rest = free & ~inside
        for j in range(len(pivots)):
            native, guests = free & inside & (placed.home == j), free & to_balls[j]
            if guests.sum() > native.sum():
                rest |= native
            elif guests.any():
                open_regions.append((members[native | guests], depth + 1))
        to_cells &= rest
        if to_cells.sum() > rest.sum():
            open_regions.append((members[rest], depth + 1))
        else:
            homes = np.unique(placed.home[rest])
            open_regions += [(members[(rest & (placed.home == j)) | to_cells[j]], depth + 1) for j in homes.tolist()]
    return links


def _table_sets(table: pa.Table, limit: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, bounds and set hashes of a table's texts."""
    grams, bounds, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for w in pieces(table.column("text"), lower=True):
        g, b = shingle_sets(w, limit.width)
        grams.append(g)
        bounds.append(b[1:] + at)
        at += b[-1]
    grams, bounds = np.concatenate(grams), np.concatenate(bounds)
    return grams, bounds, class_hashes(grams, bounds)


def region_join(regions: DataFrame, limit: Limit) -> DataFrame:
    """a, b: doc_ids of linked sets, enough of them to join all that are linked within each region (region, doc_id, set, text)."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("set", "ascending")])
        grams, bounds, hashes = _table_sets(table, limit)
        asked, owners = table.column("set").to_numpy(), table.column("doc_id").to_numpy()
        fresh = np.ones(len(asked), bool)  # rows of equal id and set come once
        fresh[1:] = (asked[1:] != asked[:-1]) | (owners[1:] != owners[:-1])
        good = signed(hashes) == asked
        # of rows of one id only those of the asked set count, the first of them
        right = np.flatnonzero(good & (fresh | ~np.concatenate([[False], good[:-1]])))
        ids = table.column("doc_id").to_numpy()[right]
        keep = np.zeros(len(hashes), bool)
        keep[right] = True
        sizes = np.diff(bounds)
        sets = Sets(grams[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[right])]))
        pairs = np.array(voronoi_links(sets, limit), np.int64).reshape(-1, 2)
        return pa.table([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    return regions.groupBy("region").applyInArrow(join, "a long, b long")


def _pivot_groups(key: tuple, table: pa.Table) -> pa.Table:
    """For each of a region's pivots that shared documents join with another, the least pivot that they join it with."""
    a, b = table.column("a").to_numpy().astype(np.int64), table.column("b").to_numpy().astype(np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = nodes[local_labels(len(nodes), at[: len(a)], at[len(a) :])]
    groups = pa.array([list(zip(nodes.tolist(), label.tolist()))], pa.map_(pa.int32(), pa.int32()))
    return pa.table([pa.array([key[0].as_py()]), groups], names=["region", "groups"])


def cells(regions: DataFrame, sizes: DataFrame, limit: Limit, turn: int) -> tuple[DataFrame, DataFrame]:
    """Smaller regions for large ones, and links found on the way: the rules of voronoi_links with a region's documents in many tasks.

    A task holds the texts of some of a region's documents and of its pivots, whose share doubles with each turn, up to MOST_PIVOTS.
    Pivots are settled and go nowhere, so every region ends. What neither balls nor windows divide is divided by shingles again, every
    SHINGLE_TURNS turns, or goes on together.
    """
    names = ["region", "doc_id", "set", "text"]
    draw = F.xxhash64("doc_id", "set", F.lit(turn))
    slots = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(PIVOTS), F.ceil(F.col("n") / SETS_PER_PIVOT)) * 2 ** min(turn, 20))
    picked = regions.join(sizes, "region").groupBy("region", F.pmod(draw, slots).alias("slot")).agg(F.min_by(F.struct("doc_id", "set", "text"), F.struct(draw, "doc_id", "set")).alias("p"))
    parts = sizes.select("region", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64("doc_id", "set", F.lit("chunk")), F.col("parts")).cast("int")
    dealt = regions.join(parts, "region").select(*names, chunk.alias("chunk")).groupBy("region", "chunk")
    pivots = picked.join(parts, "region").select(F.col("region").alias("of"), "p.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at")).groupBy("of", "at")
    schema = "region string, doc_id long, set long, text string, home int, inside boolean, near array<int>, lower array<int>, a long, b long, i int, j int"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = [f.split()[0] for f in schema.split(", ")]

    def place(key: tuple, docs: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("set", "ascending")])
        grams, bounds, hashes = _table_sets(pa.concat_tables([own.select(names[1:]), docs.select(names[1:])]), limit)
        k, sizes = len(own), np.diff(bounds)
        if not k or not len(docs):
            return pa.table([pa.array([], kind) for kind in kinds], names=columns)
        ids = np.concatenate([own.column("doc_id").to_numpy(), docs.column("doc_id").to_numpy()])
        asked = np.concatenate([own.column("set").to_numpy(), docs.column("set").to_numpy()])
        sets = Sets(grams, bounds)
        placed = Placed.of(sets.shared(np.arange(k), np.arange(k, len(sizes))), sizes[:k], sizes[k:], limit)
        inside, near, lower = placed.guests(np.arange(k))
        settled = set(zip(ids[:k].tolist(), asked[:k].tolist()))
        region, texts = key[0].as_py(), docs.column("text").to_pylist()
        rows: list[tuple] = []
        joined: set[tuple] = set()
        for x in np.flatnonzero(signed(hashes)[k:] == asked[k:]).tolist():  # not another row of this id
            ball = np.flatnonzero(placed.ball[:, x]).tolist()
            joined |= {(ball[0], j) for j in ball[1:]}
            doc, of = int(ids[k + x]), int(asked[k + x])
            if (doc, of) not in settled:
                home = int(placed.home[x])
                link = (int(ids[home]), doc) if inside[x] else (None, None)
                rows.append((region, doc, of, texts[x], home, bool(inside[x]), np.flatnonzero(near[:, x]).tolist(), np.flatnonzero(lower[:, x]).tolist(), *link, None, None))
        rows += [(region, *[None] * 7, int(ids[i]), int(ids[j]), i, j) for i, j in joined]
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=columns)

    rows = written(dealt.cogroup(pivots).applyInArrow(place, schema), "cells")
    edges = rows.where("i is not null").select("region", F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    groups = edges.groupBy("region").applyInArrow(_pivot_groups, "region string, groups map<int,int>")
    group = lambda j: F.coalesce(F.element_at("groups", j), j)
    strange = F.filter("near", lambda j: ~F.col("inside") | (group(j) != group(F.col("home"))))
    placed = rows.where("doc_id is not null").join(groups, "region", "left").withColumn("near", strange)
    # balls with no more guests than natives
    natives = placed.where("inside").groupBy("region", F.col("home").alias("j")).agg(F.count("*").alias("natives"))
    asked = placed.select("region", F.explode("near").alias("j")).groupBy("region", "j").agg(F.count("*").alias("guests"))
    balls = natives.join(asked, ["region", "j"], "left").where("coalesce(guests, 0) <= natives")
    balls = balls.groupBy("region").agg(F.collect_list("j").alias("taken"), F.collect_list(F.when(F.col("guests") > 0, F.col("j"))).alias("open"))
    placed = placed.drop("groups").join(written(balls, "balls"), "region", "left").withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("taken", "open")})
    cell = lambda kind, j: F.concat_ws(".", F.col("region"), F.lit(turn).cast("string"), F.concat(F.lit(kind), j.cast("string")))
    to_balls = placed.withColumn("_j", F.explode(F.concat(F.array_intersect("near", "open"), F.when(F.col("inside") & F.array_contains("open", F.col("home")), F.array("home")).otherwise(F.array().cast("array<int>")))))
    rest = placed.where(~F.col("inside") | ~F.array_contains("taken", F.col("home")))
    copies = rest.groupBy("region").agg(F.sum(F.size("lower")).alias("more"), F.count("*").alias("n"))
    rest = rest.join(copies.select("region", (F.col("more") > F.col("n")).alias("stuck")), "region")
    divided = rest.where("not stuck").withColumn("_j", F.explode(F.concat(F.array("home"), "lower")))
    stuck = written(rest.where("stuck").select(*names), "stuck")
    out = to_balls.select(cell("b", F.col("_j")).alias("region"), *names[1:]).unionByName(divided.select(cell("o", F.col("_j")).alias("region"), *names[1:]))
    if turn % SHINGLE_TURNS:
        out = out.unionByName(stuck.select(cell("r", F.lit("")).alias("region"), *names[1:]))
    elif not stuck.isEmpty():
        out = out.unionByName(shingle_regions(stuck, limit).select(cell("r", F.col("part")).alias("region"), *names[1:]))
    return out, rows.where("a is not null").select("a", "b")


def shingle_regions(stuck: DataFrame, limit: Limit) -> DataFrame:
    """Rows of `stuck` with `part`: the larger regions of step 2 among these sets alone, with all of their shingles counted; sets that meet none are left out."""
    bits = range_bits(stuck)
    near = components(region_links(stuck, limit, frequencies(stuck, limit, bits, 1.0), bits, 1.0))
    return stuck.join(near.select(F.col("node").alias("set"), F.col("component").alias("part")), "set")


def linked_sets(regions: DataFrame, sizes: DataFrame, limit: Limit) -> DataFrame:
    """a, b: links that join all linked documents of regions of any size.

    A region of up to REGION_SETS sets is cut by pivots inside one task (voronoi_links), a larger one across tasks (cells) until its parts
    are as small: the same rule, only the place differs.
    """
    found: list[DataFrame] = []
    for turn in itertools.count():
        large = sizes.where(F.col("n") > REGION_SETS)
        if large.isEmpty():
            found.append(region_join(regions, limit))
            break
        found.append(region_join(regions.join(sizes.where((F.col("n") > REGION_SETS) | (F.col("n") < 2)).select("region"), "region", "left_anti"), limit))
        smaller, links = cells(regions.join(large.select("region"), "region", "left_semi"), large, limit, turn)
        regions = written(smaller, "regions")
        sizes = written(regions.groupBy("region").agg(F.count("*").alias("n")), "region-sizes")
        found.append(links)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def similar_documents(docs: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """doc_id, row, n_shingles and component_id of every row of `docs`.

    component_id is the least doc_id that is reached by links, the row's own included. Rows without words link with
    nothing. So do rows of a null doc_id, whose component_id is null. Repeated rows have equal sets and are one class; rows
    of one id with different texts count as one document's. An empty table gives no rows.
    """
    bits = range_bits(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    known = rows.where("doc_id is not null")
    sets = written(sets_of(rows, limit), "sets")
    heads = sets.where("set is not null and doc_id is not null").groupBy("set", "set2").agg(F.min(F.struct("doc_id", "row")).alias("_h"))
    classes = written(heads.select("set", "set2", F.col("_h.doc_id").alias("head"), F.col("_h.row").alias("row")), "classes")
    near = components(region_links(known, limit, frequencies(known, limit, bits), bits))
    members = classes.join(near.withColumnRenamed("node", "set"), "set").select(F.col("head").alias("doc_id"), "row", "set", F.col("component").cast("string").alias("region"))
    members = written(members, "members")
    sizes = written(members.groupBy("region").agg(F.count("*").alias("n")), "region-sizes")
    likely, _ = possible(known, "doc_id", members.select("doc_id"))
    regions = written(likely.dropDuplicates(["doc_id", "row"]).join(members, ["doc_id", "row"]).select("region", "doc_id", "set", "text"), "regions")
    joined = components(linked_sets(regions, sizes, limit))
    labels = classes.join(joined.withColumnRenamed("node", "head"), "head", "left").select("set", "set2", F.coalesce("component", "head").alias("_component"))
    out = sets.join(labels, ["set", "set2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("_component")))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"))


def join_report(docs: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; null, empty, repeated and clashing rows as in similar_documents()."""
    return similar_documents(docs, limit).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, limit: Limit = Limit(5, 80)) -> DataFrame:
    """The document of least id of each group of similar ones, once; columns as before.

    Rows without words and rows of a null id stay. Only texts whose id may be dropped are moved.
    """
    found = similar_documents(docs, limit)
    counts = found.where("doc_id is not null").groupBy("doc_id", "row").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    troubled = written(counts.where("component_id < doc_id or n > 1").select("doc_id", "row", (F.col("component_id") < F.col("doc_id")).alias("gone")), "dropped")
    likely, rest = possible(docs, "doc_id", troubled.select("doc_id"))
    asked = troubled.select(F.col("doc_id").alias("_jaccard_id"), F.col("row").alias("_jaccard_row"), F.col("gone").alias("_jaccard_gone"))
    marked = likely.withColumn("_jaccard_hash", F.xxhash64("text")).join(asked, (F.col("doc_id") == F.col("_jaccard_id")) & (F.col("_jaccard_hash") == F.col("_jaccard_row")), "left")
    single = marked.where("_jaccard_gone is null").select(*docs.columns)
    repeated = marked.where("not _jaccard_gone").dropDuplicates(["doc_id", "_jaccard_hash"]).select(*docs.columns)
    return rest.unionByName(single).unionByName(repeated)
