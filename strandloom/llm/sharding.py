"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard. At each level every child draws -ln(u) / weight with u
from a hash of (key, child), and the least draw wins, so a child wins in proportion to its weight
and changing one child's weight moves rows only into or out of that child's subtree. A new shard
joins as a region of its own: the weights of all other subtrees stay as they were, so rows move into
the new shard alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that make one draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. The weight of an inner node is the sum of its children's."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int = -1


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, founded: int | None = None, racks_per_region: int = 2, shards_per_rack: int = 2) -> Node:
    """Shards 0..shards-1 of weight 1. The first `founded`, by default all, are dealt to racks and racks to regions in order; each later
    one is a rack of a region of its own. A cluster keeps the number it was founded with as it grows, so the weights of all other
    subtrees stay as they were, and one shard more takes rows only into itself."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    first = shards if founded is None else founded
    if not 1 <= first <= shards:
        raise ValueError("a cluster has at least the shards it was founded with")
    leaves = [Node(f"s{i}", 1.0, (), i) for i in range(shards)]
    racks = [inner(f"k{i}", leaves[i * shards_per_rack : min((i + 1) * shards_per_rack, first)]) for i in range(-(-first // shards_per_rack))]
    regions = [inner(f"g{i}", racks[i * racks_per_region : (i + 1) * racks_per_region]) for i in range(-(-len(racks) // racks_per_region))]
    regions += [inner(f"g-s{i}", [inner(f"k-s{i}", [leaves[i]])]) for i in range(first, shards)]
    return inner("root", regions)


def _draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{node.name}"))), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard number that `key` (a string column, not null) falls to below `node`."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no child of {node.name} has a weight")
    if len(live) == 1:
        return descend(key, live[0])
    first = F.least(*(F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)))["i"]
    out = descend(key, live[-1])
    for i, c in reversed(list(enumerate(live[:-1]))):
        out = F.when(first == i, descend(key, c)).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", into: str = "shard", layout: Node | None = None) -> DataFrame:
    """Add the shard of each row. A null key counts as the text 'null' and so has one shard."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return docs.withColumn(into, descend(name, layout or tree(shards)).cast("int"))


def number_slots(rows: DataFrame, shard: str, key: str, order: list[str], buckets: int = 1024) -> DataFrame:
    """Add `slot`: 0, 1, 2, ... without gaps in each shard, in the order of a hash bucket of the key, then of `order`.

    No task sees a whole shard: rows are numbered inside (shard, bucket), and the buckets' counts, at
    most shards x buckets rows, are summed up to offsets. `buckets` should grow with the rows of a shard.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    bucketed = rows.withColumn("_bucket", (F.conv(F.substring(F.md5(name), 25, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = bucketed.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_within", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), [shard, "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_before", "_within")


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = 1024) -> DataFrame:
    """All documents with shard, slot and, by law `key`, the shard they'd have with one shard more.

    A null text has size 1 and the checksum of an empty one. Rows with a null doc_id share one shard; repeated
    rows get slots of their own. An empty table gives no rows. Other columns of `docs` are not carried along.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = assign(rows, shards)
    rows = assign(rows, layout=tree(shards + 1, founded=shards), into="grown_shard")
    rows = number_slots(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"], buckets)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
