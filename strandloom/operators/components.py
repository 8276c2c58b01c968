"""Connected components: in one task by numpy, over a whole table by rounds of star contractions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import discard, written

#: Links that a task contracts at once, about.
FLUSH = 1 << 21


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of the nodes 0 .. n - 1 by the links a - b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u) of a task replaced by links that join the same nodes: each node that isn't its group's least with the least."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        v, u = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("v", "u"))
        nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        label = local_labels(len(nodes), at[: len(v)], at[len(v) :])
        low = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[label[low]])], ["v", "u"])

    parts: list[pa.RecordBatch] = []
    for batch in batches:
        parts.append(batch)
        if sum(map(len, parts)) > 2 * FLUSH:
            yield flush(parts)
            parts = []
    if parts:
        yield flush(parts)


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked with one smaller node at most, and that one with none."""
    sides = edges.select(F.col("v").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    each = sides.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not each.agg(F.count_if((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("top") > 0)))).first()[0]


def _round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: the same groups with shorter ways to their least nodes."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
    least = large.groupBy("v").agg(F.min("u").alias("m"))
    small = large.join(least, "v")
    return small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on a link of `links` (a, b; longs), component being the least node reachable.

    Tasks contract up to FLUSH links at once; where there are more, rounds of large-star and small-star contractions follow, each written
    to the shared folder, their number growing with the logarithm of the nodes. A hub's neighbours are never gathered in one row: minima are
    aggregated and joined back.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), "links")
    for _ in range(rounds):
        n = edges.count()
        contracted = written(edges.coalesce(-(-n // FLUSH) or 1).mapInArrow(_stars, "v long, u long"), "stars")
        discard(edges)
        if n <= FLUSH or _settled(contracted):
            break
        edges = written(_round(contracted), "links")
        discard(contracted)
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    tops = contracted.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return contracted.select(F.col("v").alias("node"), F.col("u").alias("component")).union(tops)


def linked_groups(nodes: DataFrame, links: DataFrame, into: str, number: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """`nodes` with `into`: the least node of those that each reaches by `links` (structs a and b of the columns of `nodes`), as a struct.

    Nodes of links are numbered by a hash; the few that share one get another from their rank among those. The least of a component is found by an aggregate,
    so neither a component nor a group is gathered anywhere. Nodes are rows without nulls.
    """
    known = written(links.select("a", "b").where("a <> b"), "pairs")
    ends = written(known.select(F.col("a").alias("node")).union(known.select(F.col("b").alias("node"))).distinct().withColumn("number", number(F.col("node"))), "ends")
    rank = F.row_number().over(Window.partitionBy("number").orderBy("node"))
    shared = ends.groupBy("number").agg(F.count("*").alias("n")).where("n > 1").select("number")
    if shared.isEmpty():
        numbered = known.select(*(number(F.col(c)).alias(c) for c in "ab"))
    else:
        other = F.when(F.col("rank") > 1, F.xxhash64("number", "rank", F.lit("twin"))).otherwise(F.col("number"))
        twins = ends.join(shared, "number").withColumn("rank", rank).select("node", other.alias("other"))
        ends = ends.join(twins, "node", "left").select("node", F.coalesce("other", "number").alias("number"))
        numbered = known
        for c in "ab":
            numbered = numbered.join(ends.select(F.col("node").alias(c), F.col("number").alias(f"_{c}")), c)
        numbered = numbered.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    joined = ends.join(components(numbered).withColumnRenamed("node", "number"), "number")
    least = joined.groupBy("component").agg(F.min("node").alias(into))
    found = joined.join(least, "component").select("node.*", into)
    return nodes.join(found, nodes.columns, "left").withColumn(into, F.coalesce(into, F.struct(*nodes.columns)))
