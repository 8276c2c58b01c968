"""Near-duplicate vectors by cosine, from tile products of int8 codes with rigorous error bounds.

A vector of length 1, x, is coded as s * q with q in int8; e = |x - s q| is known exactly enough to bound the product of
two vectors by that of their codes within e + e' + 3 e e'. Pairs whose bound stays below the limit aren't links, pairs whose
lower bound reaches it are, and only those between are computed again in double precision. Code products are integers below
2**24, so float32 matrix products give them without error. Equal vectors are one class with a weight.

Classes are dealt to cells, each by its nearest pivot, with the cell's widest angle as its radius. By the triangle inequality a vector can be linked with
one of another cell only if its angle to that cell's pivot is at most the radius and the angle of a link: to other cells it isn't sent at all. Cells of many
vectors are dealt to groups by hash. A task joins two groups, so its memory is that of two groups and some tiles; tiles whose spherical caps are too far
apart are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, local_labels
from ..sources.work import written

LIMIT = 0.9
#: Vectors of a group and of a tile; least number of pivots, so that small inputs use several tasks.
GROUP = 8192
TILE = 2048
LEAST_GROUPS = 6
#: Lengths of vectors that have pivots, and the number and bytes of a length's pivots, at most.
MOST_SIZES = 16
MOST_PIVOTS = 1024
PIVOT_BYTES = 8 << 20
SPREAD = 4
#: Rows that are sent at once.
SENT = 4096
#: What float32 arithmetic on bounds may lose, and dimensions whose products are summed in float32.
SLACK = 1e-5
SLICE = 1024


@dataclass
class Coded:
    """Vectors of length 1, their codes, scales and error bounds, tile by tile in an order that keeps near ones together."""

    unit: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    bound: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, norms: np.ndarray) -> Coded:
        unit = vectors / norms[:, None]
        draw = np.random.default_rng(7)
        pivots = unit[draw.choice(len(unit), min(32, len(unit)), replace=False)]
        nearest = unit @ pivots.T
        order = np.lexsort((-nearest.max(1), nearest.argmax(1)))
        unit = unit[order]
        scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
        return cls(unit, codes, scale.astype(np.float32), (error + 1.5 * error * error).astype(np.float32), order)

    def tiles(self):
        for at in range(0, len(self.unit), TILE):
            part = slice(at, at + TILE)
            centre = self.unit[part].mean(0)
            length = np.sqrt(centre @ centre)
            centre = centre / length if length > 1e-9 else self.unit[at]
            yield at, part, centre, float(np.arccos(np.clip((self.unit[part] @ centre).min(), -1, 1)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, without error in float32 up to SLICE dimensions and in float64 sums of them beyond."""
    if a.shape[1] <= SLICE:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k : k + SLICE].astype(np.float32) @ b[:, k : k + SLICE].astype(np.float32).T).astype(np.float64) for k in range(0, a.shape[1], SLICE))


def tile_links(a: Coded, b: Coded, same: bool, raw_a, raw_b, limit: float = LIMIT):
    """For each pair of tiles that isn't passed over: indices, in the original order, of linked vectors of a and b.

    raw_a and raw_b are (vectors, norms) as given; with `same`, each pair comes once and no vector with itself.
    """
    widest = float(np.arccos(limit)) + 1e-6
    second = list(b.tiles())
    for at, rows, centre, radius in a.tiles():
        for bt, cols, other, other_radius in second:
            if same and bt < at:
                continue
            if float(np.arccos(np.clip(centre @ other, -1, 1))) - radius - other_radius > widest:
                continue
            value = products(a.codes[rows], b.codes[cols])
            value *= b.scale[cols]
            value *= a.scale[rows][:, None]
            room = a.bound[rows][:, None] + b.bound[cols]
            possible = value + room >= limit - SLACK
            if same and bt == at:
                possible &= np.tri(*possible.shape, k=0, dtype=bool).T ^ np.eye(*possible.shape, dtype=bool)
            i, j = np.nonzero(possible)
            if not len(i):
                continue
            sure = value[i, j] - room[i, j] >= limit + SLACK
            i, j = a.order[rows][i], b.order[cols][j]
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), 1 << 17):
                some = unsure[k : k + (1 << 17)]
                dots = np.einsum("ij,ij->i", raw_a[0][i[some]], raw_b[0][j[some]])
                sure[some] = dots / (raw_a[1][i[some]] * raw_b[1][j[some]]) >= limit
            if sure.any():
                yield i[sure], j[sure]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, each times a power of 2 that brings its largest component near 1: cosines stay as they are, to the last bit."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None]) if len(rows) else rows


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def chosen_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors its pivots: one for GROUP vectors, at least LEAST_GROUPS; their number and bytes are bounded.

    They are taken from SPREAD times as many vectors of least hash, each the farthest from those taken before, so that clusters get their own.
    Lengths that are rarer than the MOST_SIZES most frequent ones have none: their vectors are one cell.
    """
    sizes = classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(MOST_SIZES).collect()
    pivots = {}
    for r in sizes:
        k = max(1, min(max(LEAST_GROUPS, -(-r.n // GROUP)), MOST_PIVOTS, PIVOT_BYTES // (8 * r.size)))
        rows = classes.where(F.size("vector") == r.size).orderBy(F.xxhash64("vector"), "id").limit(SPREAD * k).select("vector").toArrow()
        some = _unit(_vectors(rows.column("vector")))
        taken, closest = [0], some @ some[0]
        while len(taken) < min(k, len(some)):
            taken.append(int(closest.argmin()))
            closest = np.maximum(closest, some @ some[taken[-1]])
        pivots[r.size] = some[taken]
    return pivots


def _by_length(column: pa.Array):
    """Places and rows of the vectors of each length in a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, _vectors(column.take(pa.array(at)))


def in_cells(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, weight and vector with size, cell (the nearest pivot of its length, else 0) and angle to it."""

    def run(batches):
        for batch in batches:
            cell, angle = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            size = np.zeros(len(batch), np.int32)
            for n, at, rows in _by_length(batch.column("vector")):
                size[at] = n
                if n in pivots:
                    for k in range(0, len(at), TILE):
                        far = angles(_unit(rows[k : k + TILE]), pivots[n])
                        cell[at[k : k + TILE]], angle[at[k : k + TILE]] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "weight", "vector")), pa.array(size), pa.array(cell), pa.array(angle)], ["id", "weight", "vector", "size", "cell", "angle"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("id", "weight", "vector").mapInArrow(run, f"id long, weight long, vector {kind}, size int, cell int, angle double")


def dealt_to_groups(placed: DataFrame, pivots: dict[int, np.ndarray], limit: float) -> DataFrame:
    """Rows of in_cells() once for each pair of groups (low, high) that may hold a link of theirs, with their own group.

    Cells are at most MOST_SIZES x MOST_PIVOTS and one for each rarer length; of those only the ones of more than GROUP vectors are gathered.
    """
    stats = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = {(r.size, r.cell): (max(1, -(-r.n // GROUP)), r.radius) for r in stats.where((F.col("n") > GROUP) | F.col("size").isin([int(x) for x in pivots])).collect()}
    widest = float(np.arccos(limit)) + 1e-6
    first: dict[int, np.ndarray] = {}
    reach: dict[int, np.ndarray] = {}
    for size, of in pivots.items():
        parts = [known.get((size, c), (0, 0.0))[0] for c in range(len(of))]
        first[size] = np.concatenate([[0], np.cumsum(parts)])
        reach[size] = np.array([known[size, c][1] + widest if parts[c] else -1.0 for c in range(len(of))])

    def run(batches):
        for batch in batches:
            where, own, other = [], [], []
            hashed = batch.column("hash").to_numpy()
            cells = batch.column("cell").to_numpy()
            for n, at, rows in _by_length(batch.column("vector")):
                starts = first.get(n, np.array([0, known.get((n, 0), (1, 0.0))[0]]))
                parts = np.diff(starts)
                mine = starts[cells[at]] + hashed[at] % parts[cells[at]]
                near = np.zeros((len(at), len(parts)), bool)
                if n in pivots:
                    for k in range(0, len(at), TILE):
                        near[k : k + TILE] = angles(_unit(rows[k : k + TILE]), pivots[n]) <= reach[n]
                near[np.arange(len(at)), cells[at]] = True
                i, c = np.nonzero(near)
                times = parts[c]
                ends = np.cumsum(times)
                where.append(np.repeat(at[i], times))
                own.append(np.repeat(mine[i], times))
                other.append(np.repeat(starts[c] - (ends - times), times) + np.arange(times.sum()))
            at, own, other = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (where, own, other))
            groups = [pa.array(x.astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own)]
            for k in range(0, len(at), SENT):
                some = slice(k, k + SENT)
                rows = batch.select(["size", "id", "weight", "vector"]).take(pa.array(at[some]))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(g[some] for g in groups), *(rows.column(c) for c in (1, 2, 3))], ["size", "low", "high", "own", "id", "weight", "vector"])

    kind = placed.schema["vector"].dataType.simpleString()
    hashed = placed.withColumn("hash", F.pmod(F.xxhash64("vector", F.lit("group")), F.lit(1 << 30)))
    return hashed.mapInArrow(run, f"size int, low int, high int, own int, id long, weight long, vector {kind}")


def _cell(key: tuple, table: pa.Table, limit: float) -> pa.Table:
    """Rows of one cell: (id, null, weight of links) and (id, id, 0) for links that join what is linked."""
    table = table.sort_by([("own", "ascending"), ("id", "ascending")])
    low, high = key[1].as_py(), key[2].as_py()
    own = table.column("own").to_numpy()
    ids, weights, vectors = table.column("id").to_numpy(), table.column("weight").to_numpy(), _vectors(table.column("vector"))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    same = low == high
    cut = len(ids) if same else int(np.searchsorted(own, high))
    links, marks = np.zeros(len(ids)), [np.zeros((0, 2), np.int64)]
    if len(ids) > 1 and (same or 0 < cut < len(ids)):
        first = Coded.of(vectors[:cut], norms[:cut])
        second = first if same else Coded.of(vectors[cut:], norms[cut:])
        shift = 0 if same else cut
        for i, j in tile_links(first, second, same, (vectors[:cut], norms[:cut]), (vectors[shift:], norms[shift:]), limit):
            j = j + shift
            links += np.bincount(i, weights=weights[j], minlength=len(ids)) + np.bincount(j, weights=weights[i], minlength=len(ids))
            nodes, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            label = local_labels(len(nodes), back[: len(i)], back[len(i) :])
            marks.append(np.column_stack([nodes, nodes[label]])[label != np.arange(len(nodes))])
    pairs = np.vstack(marks)
    label = local_labels(len(ids), pairs[:, 0], pairs[:, 1])
    joined, linked = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links > 0)
    none = pa.nulls(len(linked), pa.int64())
    return pa.table(
        [
            pa.array(np.concatenate([ids[joined], ids[linked]])),
            pa.chunked_array([pa.array(ids[label[joined]]), none]).combine_chunks(),
            pa.array(np.concatenate([np.zeros(len(joined), np.int64), links[linked].astype(np.int64)])),
        ],
        names=["a", "b", "links"],
    )


def similar_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Vectors that are null, empty, zero, or hold a null or a number that isn't finite link with nothing; nor do those of
    a null vec_id, whose component_id is null, and vectors of different lengths. Rows of one vec_id count as rows in n_links
    and as one node of a component. An empty table gives no rows; labels and further columns aren't looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), F.col("vector")))
    classes = written(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vectors")
    pivots = chosen_pivots(classes)
    placed = written(in_cells(classes, pivots), "placed")
    dealt = dealt_to_groups(placed, pivots, limit)
    cells = written(dealt.groupBy("size", "low", "high").applyInArrow(lambda key, table: _cell(key, table, limit), "a long, b long, links long"), "cells")
    degrees = cells.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(cells.where("b is not null").select("a", "b")).select(F.col("node").alias("id"), "component")
    known = classes.join(degrees, "id", "left").join(joined, "id", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("_component"))
    out = rows.join(known, "vector", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
