"""Shards by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name,
and the smallest draw wins, so a child wins in proportion to its weight.
Raising one child's weight moves rows only into that child, lowering it moves
rows only out of it; the draws under all other nodes stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that make one uniform draw.
DIGITS = 12


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack]`` is a tuple of shard weights; shards are numbered in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own: it takes rows only into itself.

        A shard put into an existing rack would raise its region's and rack's
        weight, and part of what they then win would fall to their old shards.
        """
        return Tree((*self.weights, ((weight,),)))


def regular(regions: int, racks: int, shards: int) -> Tree:
    return Tree(tuple(tuple(tuple(1.0 for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _winner(key: Column, level: str, parent: Column, parents: list[list[float]]) -> Column:
    """The child of ``parent`` with the smallest draw; ``parents[p]`` are the weights of p's children.

    The parent is bound by a lambda, so the levels above are evaluated once.
    """
    width = max(len(p) for p in parents)
    flat = F.array(*(F.lit(float(w)) for p in parents for w in (*p, *[0.0] * (width - len(p)))))

    def under(p: Column) -> Column:
        def draw(c: Column) -> Column:
            weight = F.element_at(flat, p * width + c + 1)
            u = _uniform(key, F.lit(level), p.cast("string"), c.cast("string"))
            return F.struct(F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf"))).alias("draw"), c.alias("child"))

        return F.array_min(F.transform(F.array(*map(F.lit, range(width))), draw))["child"]

    return F.transform(F.array(parent), under)[0]


def assign(docs: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add int ``out``, the shard of each row.  Null keys share one shard."""
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    regions = [sum(sum(rack) for rack in region) for region in tree.weights]
    racks = [[sum(rack) for rack in region] for region in tree.weights]
    flat = [list(rack) for region in tree.weights for rack in region]
    first_rack, first_shard = [], []
    for region in tree.weights:
        first_rack.append(sum(len(r) for r in tree.weights[: len(first_rack)]))
    for rack in flat:
        first_shard.append(sum(len(r) for r in flat[: len(first_shard)]))
    at = lambda numbers, i: F.element_at(F.array(*map(F.lit, numbers)), i + 1)
    return (
        docs.withColumn("_region", _winner(text_key, "region", F.lit(0), [regions]))
        .withColumn("_rack", at(first_rack, F.col("_region")) + _winner(text_key, "rack", F.col("_region"), racks))
        .withColumn(out, (at(first_shard, F.col("_rack")) + _winner(text_key, "shard", F.col("_rack"), flat)).cast("int"))
        .drop("_region", "_rack")
    )


def shard_slots(docs: DataFrame, tree: Tree, grown: Tree, id_col: str = "doc_id", text_col: str = "text", lanes: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: every row's place.

    * size is the text's UTF-8 bytes (null: none) plus 16; a null text's CRC is
      that of no bytes, 0
    * slots of a shard run gapless from 0.  A shard's rows are numbered in
      ``lanes`` hashed lanes, each from the total of the lanes before it, so no
      task sorts a whole shard
    * repeated ids share a shard and get slots of their own; null ids share one
      shard and lane
    * an empty table gives an empty result; other columns are not read
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("text_crc32"),
    )
    placed = assign(assign(narrow, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard").withColumn(
        "_lane", F.floor(_uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lane")) * lanes).cast("int")
    )
    ids = assign(docs.select(F.col(id_col).alias("doc_id")), "doc_id", tree, "shard").withColumn(
        "_lane", F.floor(_uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lane")) * lanes).cast("int")
    )
    # At most shards * lanes rows, whatever the input: small enough to broadcast.
    counts = ids.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_lane").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_lane"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
