"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Vectors of integers get one coordinate more that brings all to the same length, M; an anchor gets 0 there. The squared distance of anchor q to vector v is then
|q|^2 + M^2 - 2 q.v: high scores are near, and a window of scores is an annulus around the anchor. The upper levels of the tree are grown on the driver from a
bounded sample and divide all vectors into cells; each cell keeps the range of its vectors' distances to the vantage points above it, so the triangle inequality
bounds an anchor's distance to any of them. An anchor visits the nearest cells of its annulus first, then those that can still hold something nearer than
what it has. In a cell a task grows the lower levels and goes through their leaves nearest first, until enough rows are found or the annulus ends.

All bounds leave room for rounding and scores are exact integers, so results are exact; the sample only decides how much is visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score in hundredths of its positive's.
LOWEST, HIGHEST = 30, 90
#: Vectors of a task's share of a cell, of a leaf in it, and anchors' windows that meet it in one task.
GROUP, LEAF, BLOCK = 4096, 32, 4096
#: Cells that are visited first.
FIRST = 2
#: Levels of the upper tree at most, sampled vectors for each of its cells, bytes of the sample, and lengths of vectors that have such a tree.
MOST_LEVELS, SAMPLE, SAMPLE_BYTES, MOST_SIZES = 10, 16, 8 << 20, 16
#: Squared lengths beyond this could give scores that a long can't hold.
MOST_NORM = 2.0**62
#: Share of M by which rounding may move a distance.
SLACK = 1e-6
ALL = 1 << 62


def distances(a: np.ndarray, a_height: np.ndarray, b: np.ndarray, b_height: np.ndarray) -> np.ndarray:
    """Between rows of a and of b, with their further coordinate."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T) + (a_height[:, None] - b_height) ** 2
    return np.sqrt(np.maximum(squares, 0))


def heights(rows: np.ndarray, most: float) -> np.ndarray:
    rows = rows.astype(np.float64)
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", rows, rows), 0))


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: rows are doubles where all partial sums fit them, else longs."""
    return (rows @ query.astype(rows.dtype)).astype(np.int64)


@dataclass
class Tree:
    """Vantage points of a complete tree in the order of a heap, and the distance at which each divides."""

    levels: int
    vantages: np.ndarray
    vantage_heights: np.ndarray
    radii: np.ndarray

    @classmethod
    def grown(cls, rows: np.ndarray, row_heights: np.ndarray, levels: int) -> Tree:
        """Each node's vantage point is the farthest from its first row; half of its rows are nearer to it than its radius."""
        points, radii, level = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), [np.arange(len(rows))]
        for k in range(levels):
            below = []
            for node, own in enumerate(level, 2**k - 1):
                if len(own):
                    corner = own[distances(rows[own], row_heights[own], rows[own[:1]], row_heights[own[:1]])[:, 0].argmax()]
                    far = distances(rows[own], row_heights[own], rows[[corner]], row_heights[[corner]])[:, 0]
                    points[node], radii[node] = corner, np.median(far)
                    below += [own[far < radii[node]], own[far >= radii[node]]]
                else:
                    below += [own, own]
            level = below
        return cls(levels, rows[points], row_heights[points], radii)

    def path(self, leaf: np.ndarray, k: int) -> np.ndarray:
        """The node at level k above a leaf."""
        return (1 << k) - 1 + (leaf >> (self.levels - k))

    def far(self, rows: np.ndarray, row_heights: np.ndarray) -> np.ndarray:
        return distances(rows, row_heights, self.vantages, self.vantage_heights)

    def descend(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the vantage points on the way."""
        every, leaf, on_way = np.arange(len(far)), np.zeros(len(far), np.int64), np.zeros((len(far), self.levels))
        for k in range(self.levels):
            node = (1 << k) - 1 + leaf
            on_way[:, k] = far[every, node]
            leaf = 2 * leaf + (on_way[:, k] >= self.radii[node])
        return leaf, on_way

    def bounds(self, far: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that the rows of each leaf can have, when they lie from low to high (leaf x level) of the points above."""
        leaf = np.arange(1 << self.levels)
        nearest, farthest = np.zeros((len(far), len(leaf))), np.full((len(far), len(leaf)), np.inf)
        for k in range(self.levels):
            d = far[:, self.path(leaf, k)]
            nearest = np.maximum(nearest, np.maximum(d - high[:, k], low[:, k] - d))
            farthest = np.minimum(farthest, d + high[:, k])
        return np.maximum(nearest - slack, 0), farthest + slack


@dataclass
class Cells:
    """The upper tree of vectors of one length: what is known of each cell's rows, and its shares: starts[c] to starts[c + 1]."""

    tree: Tree
    low: np.ndarray
    high: np.ndarray
    starts: np.ndarray


def score_bounds(nearest: np.ndarray, farthest: np.ndarray, queries: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least score at these distances."""
    whole = np.einsum("ij,ij->i", queries.astype(np.float64), queries.astype(np.float64))[:, None] + most
    return (whole - nearest**2) / 2, (whole - farthest**2) / 2


def _rows(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    column = batch.column("vector")
    lengths = np.diff(column.offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, _rows(column.take(pa.array(at)), size)


def upper_trees(rows: DataFrame, most: float) -> dict[int, Tree]:
    """For each of the most frequent lengths a tree with cells of about GROUP rows, from SAMPLE vectors of least hash for each cell. Vectors of other lengths are one cell."""
    trees = {}
    for r in rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(MOST_SIZES).collect():
        fit = max(1, SAMPLE_BYTES // (8 * max(1, r.size) * SAMPLE))
        levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, r.n / GROUP))))), int(np.log2(fit)))
        if levels:
            picked = rows.where(F.size("vector") == r.size).orderBy(F.xxhash64("vector"), "vec_id").limit(SAMPLE << levels).select("vector").toArrow()
            some = _rows(picked.column("vector"), r.size)
            trees[r.size] = Tree.grown(some, heights(some, most), levels)
    return trees


def placed(rows: DataFrame, trees: dict[int, Tree], most: float) -> DataFrame:
    """The rows with their length, cell, and distances to the vantage points above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells, far = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32), np.zeros((len(batch), MOST_LEVELS))
            for size, at, own in _by_size(batch):
                sizes[at] = size
                if size in trees:
                    cells[at], far[at, : trees[size].levels] = trees[size].descend(trees[size].far(own, heights(own, most)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(cells), pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, MOST_LEVELS, np.int32)), pa.array(far.ravel()))], [*batch.schema.names, "size", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, label int, vector array<long>, size int, cell int, far array<double>")


def cells_of(rows: DataFrame, trees: dict[int, Tree]) -> dict[int, Cells]:
    """From the rows of placed(); at most 2**MOST_LEVELS cells for each of MOST_SIZES lengths, and those of the rarer lengths that need several shares."""
    ends = [f(F.get("far", F.lit(k))).alias(f"{name}{k}") for k in range(MOST_LEVELS) for name, f in (("low", F.min), ("high", F.max))]
    stats = rows.groupBy("size", "cell").agg(F.count("*").alias("n"), *ends)
    out = {}
    known: dict[int, list] = {}
    for r in stats.where((F.col("n") > GROUP) | F.col("size").isin(list(trees))).collect():
        known.setdefault(r["size"], []).append(r)
    for size, found in known.items():
        tree = trees.get(size) or Tree(0, np.zeros((0, size), np.int64), np.zeros(0), np.zeros(0))
        n = 1 << tree.levels
        low, high, shares = np.full((n, tree.levels), np.inf), np.full((n, tree.levels), -np.inf), np.zeros(n, np.int64)
        for r in found:
            low[r["cell"]], high[r["cell"]] = ([r[f"{name}{k}"] for k in range(tree.levels)] for name in ("low", "high"))
            shares[r["cell"]] = -(-r["n"] // GROUP)
        out[size] = Cells(tree, low, high, np.concatenate([[0], np.cumsum(shares)]))
    return out


def _dealt(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """The rows of placed() with the share of their cell, by hash."""
    spread = F.lit(0)
    for size, own in cells.items():
        starts = F.array(*(F.lit(int(x)) for x in own.starts))
        first, after = (F.get(starts, F.col("cell") + k) for k in (0, 1))
        spread = F.when(F.col("size") == size, first + F.pmod(F.xxhash64("vec_id"), F.greatest(after - first, F.lit(1)))).otherwise(spread)
    return rows.select("size", spread.cast("int").alias("share"), "vec_id", "label", "vector")


REQUEST = "anchor_id long, twin string, item int, label int, vector array<long>, low long, high long"
REQUEST_NAMES = [x.split()[0] for x in REQUEST.split(", ")]


def _sent(requests: DataFrame, cells: dict[int, Cells], most: float, first: bool) -> DataFrame:
    """Requests once for each share of the cells that their annulus meets: the FIRST nearest cells, or all others."""
    slack = SLACK * np.sqrt(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = (batch.column(c).to_numpy() for c in ("low", "high"))
            for size, at, own in _by_size(batch):
                if size in cells:
                    c = cells[size]
                    nearest, farthest = c.tree.bounds(c.tree.far(own, np.zeros(len(own))), c.low, c.high, slack)
                    top, bottom = score_bounds(nearest, farthest, own, most)
                    meets = (top >= lows[at][:, None]) & (bottom <= highs[at][:, None]) & (np.diff(c.starts) > 0)
                    place = np.argsort(np.argsort(np.where(meets, nearest, np.inf), axis=1, kind="stable"), axis=1)
                    i, cell = np.nonzero(meets & ((place < FIRST) if first else (place >= FIRST)))
                    times = np.diff(c.starts)[cell]
                    share = np.repeat(c.starts[cell] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    i = np.repeat(at[i], times)
                else:  # one share holds all rows of this length
                    i, share = (at, np.zeros(len(at), np.int64)) if first else (at[:0], at[:0])
                for k in range(0, len(i), 4096):
                    part = batch.take(pa.array(i[k : k + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), size, np.int32)), pa.array(share[k : k + 4096].astype(np.int32)), *part.columns], ["size", "share", *part.schema.names])

    return requests.select(*REQUEST_NAMES).mapInArrow(run, f"size int, share int, {REQUEST}")


def search(requests: pa.Table, members: pa.Table, size: int, most: float, same: bool, k: int) -> pa.Table:
    """The first k members of each request's window, of its label or of others, that aren't the anchor: anchor_id, twin, item, vec_id, score."""
    rows, ids, labels = _rows(members.column("vector"), size), members.column("vec_id").to_numpy(), members.column("label").to_numpy()
    up = heights(rows, most)
    tree = Tree.grown(rows, up, max(0, int(np.ceil(np.log2(len(rows) / LEAF)))))
    leaf, on_way = tree.descend(tree.far(rows, up))
    order = np.argsort(leaf, kind="stable")
    rows, ids, labels, leaf, on_way = rows[order], ids[order], labels[order], leaf[order], on_way[order]
    at = np.searchsorted(leaf, np.arange((1 << tree.levels) + 1))
    full, places = at[1:] > at[:-1], [np.arange(a, b) for a, b in zip(at[:-1], at[1:])]
    low, high = np.full((len(full), tree.levels), np.inf), np.full((len(full), tree.levels), -np.inf)
    low[full], high[full] = np.minimum.reduceat(on_way, at[:-1][full]), np.maximum.reduceat(on_way, at[:-1][full])

    queries = _rows(requests.column("vector"), size)
    nearest, farthest = tree.bounds(tree.far(queries, np.zeros(len(queries))), low, high, SLACK * np.sqrt(most))
    top, bottom = score_bounds(nearest, farthest, queries, most)
    whole = rows.astype(np.float64) if most < 2.0**52 else rows
    anchor, label, lows, highs = (requests.column(c).to_numpy() for c in ("anchor_id", "label", "low", "high"))
    out_request, out_id, out_score = [], [], []
    # windows of one anchor share the scores of leaves that either has visited; rows that none of them wants have one below all
    _, group = np.unique(np.column_stack([anchor, label, queries]), axis=0, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    value, known, last = np.zeros(len(rows), np.int64), np.zeros(len(full), bool), -1
    for r in by_group.tolist():
        if group[r] != last:
            last, known[:], value[:] = group[r], False, -ALL
            wanted = ((labels == label[r]) == same) & (ids != anchor[r])
        ways = np.flatnonzero(full & (top[r] >= lows[r]) & (bottom[r] <= highs[r]))
        ways = ways[np.argsort(-top[r, ways], kind="stable")]
        have_id, have_score, step, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
        if known[ways].all():  # another window of the anchor has been here: nothing is left to visit
            some = np.flatnonzero((value >= max(lows[r], 1 - ALL)) & (value <= highs[r]))
            if len(some) > k:
                some = some[value[some] >= np.partition(value[some], len(some) - k)[len(some) - k]]
            best = some[np.lexsort((ids[some], -value[some]))[:k]]
            have_id, have_score, done = ids[best], value[best], len(ways)
        while done < len(ways) and (len(have_id) < k or top[r, ways[done]] >= have_score[-1]):
            now = ways[done : done + step]
            done, step = done + step, 2 * step
            new = now[~known[now]]
            if len(new):
                part = np.concatenate([places[w] for w in new])
                value[part] = np.where(wanted[part], scores(whole[part], queries[r]), -ALL)
                known[new] = True
            some = np.concatenate([places[w] for w in now])
            got = value[some]
            least = have_score[-1] if len(have_id) == k else lows[r]
            some = some[(got >= max(least, 1 - ALL)) & (got <= highs[r])]
            have_id, have_score = np.concatenate([have_id, ids[some]]), np.concatenate([have_score, value[some]])
            best = np.lexsort((have_id, -have_score))[:k]
            have_id, have_score = have_id[best], have_score[best]
        out_request.append(np.full(len(have_id), r))
        out_id.append(have_id)
        out_score.append(have_score)
    picked = requests.select(["anchor_id", "twin", "item"]).take(pa.array(np.concatenate(out_request).astype(np.int64)))
    return picked.append_column("vec_id", pa.array(np.concatenate(out_id), pa.int64())).append_column("score", pa.array(np.concatenate(out_score), pa.int64()))


FOUND = "anchor_id long, twin string, item int, vec_id long, score long"
NAME = ["anchor_id", "twin", "item"]


@dataclass
class Index:
    """All rows in their cells' shares, ready to be searched."""

    members: DataFrame
    cells: dict[int, Cells]
    most: float

    @classmethod
    def of(cls, rows: DataFrame) -> Index:
        most = float(rows.agg(F.max("norm")).first()[0] or 0)
        rows = rows.select("vec_id", "label", "vector")
        trees = upper_trees(rows, most)
        inside = written(placed(rows, trees, most), "placed")
        cells = cells_of(inside, trees)
        return cls(_dealt(inside, cells), cells, most)

    def visited(self, requests: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        most = self.most
        blocks = max(1, -(-requests.count() // BLOCK))
        block = F.pmod(F.xxhash64("anchor_id", "twin", "item"), F.lit(blocks)).cast("int")
        asked = _sent(requests, self.cells, most, first).withColumn("block", block)
        members = self.members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else self.members.withColumn("block", F.lit(0))
        empty = pa.table({"anchor_id": pa.array([], pa.int64()), "twin": pa.array([], pa.string()), "item": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return search(left, right, key[0].as_py(), most, same, k) if len(left) and len(right) else empty

        keys = ("size", "share", "block")
        return asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, FOUND)

    def nearest(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """The first k of each request with their rank, by score, then vec_id."""
        near = written(self.visited(requests, same, k, True), "near")
        enough = near.groupBy(*NAME).agg(F.array_sort(F.collect_list("score")).alias("all")).select(*NAME, F.get("all", F.size("all") - k).alias("floor"))
        rest = requests.join(enough, NAME, "left").withColumn("low", F.greatest("low", "floor")).drop("floor")
        every = near.unionByName(self.visited(rest, same, k, False))
        order = Window.partitionBy(*NAME).orderBy(F.desc("score"), "vec_id")
        return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector and its squared length of the rows that take part: labels of ids divisible by 7 are moved by one, components are floor(256 x)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * 256).cast("double"), F.lit(2.0))).alias("norm"),
        whole.alias("vector"),
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("fine"),
    )
    return rows.where("fine and vec_id is not null and label is not null").where(F.col("norm") < MOST_NORM).drop("fine")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for each anchor of `rows` (vec_id, label, vector of longs, norm) and each of its positives.

    Positives are the first rows of the anchor's label and another vec_id, negatives the first rows of other labels whose score lies between `lowest` and
    `highest` hundredths of the positive's. Only vectors of one length have a score. Equal rows count once; rows of one vec_id that differ are rows of their
    own, as anchors too. An empty table, a label without positives and a window without rows give no rows.
    """
    # of equal vectors of one label only the first ids can be wanted, and one more as an anchor isn't its own positive
    keep = Window.partitionBy("label", "vector").orderBy("vec_id")
    rows = written(rows.select("vec_id", "label", "vector", "norm").distinct(), "vectors")
    index = Index.of(rows.withColumn("_copy", F.row_number().over(keep)).where(F.col("_copy") <= max(positives + 1, negatives)).drop("_copy"))
    twin = F.md5(F.to_json(F.struct("label", "vector")).cast("binary"))
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), twin.alias("twin"), "label", "vector")
    every = anchors.select("*", F.lit(0).alias("item"), F.lit(-ALL).alias("low"), F.lit(ALL).alias("high"))
    positive = index.nearest(every, True, positives).select("anchor_id", "twin", F.col("rank").alias("item"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positive = written(positive, "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    window = positive.withColumns({"low": F.ceil(score * lowest / 100).cast("long"), "high": F.floor(score * highest / 100).cast("long")})
    windows = window.where("low <= high").select("anchor_id", "twin", "item", "low", "high").join(anchors, ["anchor_id", "twin"])
    negative = index.nearest(windows, False, negatives).join(positive, NAME)
    return negative.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(vectors: DataFrame) -> DataFrame:
    """hard_negatives() for every row of `vectors` (vec_id, embedding, label) whose id is divisible by 100.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, take no part; nor do those whose whole-number vector has a squared length of
    2**62 or more, as their scores needn't fit a long. Further columns aren't looked at.
    """
    return hard_negatives(of_integers(vectors), F.col("vec_id") % 100 == 0)
