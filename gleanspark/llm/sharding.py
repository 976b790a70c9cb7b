"""Sharding: a hierarchical weighted hash tree.

A document descends from the root through regions and racks to a shard.  At each node every child draws
``-ln(u) / weight`` with ``u`` taken from a hash of the child's name and the document's id; the smallest draw wins, so a
child wins in proportion to its weight, and changing one child's weight moves documents only from or to that child.
Movement is therefore confined to the subtrees whose weights change.

The first ``base`` places of the tree are regions of two racks of two shards, whatever the shard count; each further shard
comes as a region of its own.  While there are fewer shards than places, a document that reaches an empty place descends
again with a new draw, and after ``TRIES`` descents the shards draw among themselves.  So no weight above a shard ever
changes, all shards fill evenly, and growing by one moves documents into the new shard only.

Defined cases: a null doc_id draws as the text ``null``; a null text has size 1 and CRC 0; repeated rows fall into the same
shard and take consecutive slots; ties in the order of slots are between equal rows; texts of any length are only measured;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import once, slices

#: Rows that one task numbers.
SLOT_ROWS = 250_000
#: Descents before the shards draw among themselves; one is enough where no place is empty.
TRIES = 3


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set) or an inner node; ``weight`` of an inner node is the sum of its children's."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def topology(n_shards: int, base: int = 8, weights: dict[int, float] | None = None) -> Node:
    """The tree for ``n_shards`` shards, with ``base`` places at least; weights default to 1."""
    if n_shards < 1:
        raise ValueError("a tree needs at least one shard")
    leaf = lambda i: Node(f"shard{i}", (weights or {}).get(i, 1.0), (), i)
    regions = []
    for first in range(0, base, 4):
        ids = range(first, min(first + 4, base))
        racks = [inner(f"rack{ids[k]}", [leaf(i) for i in ids[k : k + 2]]) for k in range(0, len(ids), 2)]
        regions.append(inner(f"region{first}", racks))
    regions += [inner(f"region{i}", [inner(f"rack{i}", [leaf(i)])]) for i in range(base, n_shards)]
    return inner("root", regions)


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u from the first 48 bits of an MD5 of the node's name and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node.name + ":"), key)), 1, 12), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**48))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [draw(key, c) for c in node.children]
    least = reduce(lambda a, b: F.least(a, b), draws)
    out = descend(key, node.children[-1])
    for c, d in reversed(list(zip(node.children[:-1], draws[:-1], strict=True))):
        out = F.when(d == least, descend(key, c)).otherwise(out)
    return out


def shard_of(key: Column, n_shards: int) -> Column:
    """The shard of ``key`` among ``n_shards``."""
    tree = topology(n_shards)
    there = [x for x in leaves(tree) if x.shard < n_shards]
    if len(there) == len(leaves(tree)):
        return descend(key, tree)
    draws = [draw(F.concat(key, F.lit("#last")), x) for x in there]
    last = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(x.shard).alias("shard")) for d, x in zip(draws, there, strict=True)]))["shard"]
    tried = [descend(F.concat(key, F.lit(f"#{i}")) if i else key, tree) for i in range(TRIES)]
    return F.coalesce(*[once(t, lambda s: F.when(s < n_shards, s)) for t in tried], last)


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); ``slot`` counts from 0 without gaps in each shard.

    Slots follow a hash of doc_id: rows are dealt into slices of bounded size, the slices' row counts give each slice's
    first slot, and only the rows of one (shard, slice) are numbered together.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, n_shards).cast("int").alias("shard"),
        shard_of(key, n_shards + 1).cast("int").alias("grown_shard"),
    )
    n = slices(spark, docs.select(F.lit(1)).count(), SLOT_ROWS)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n)).cast("int"))
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within).cast("long"))
        .join(first, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )
