"""Exact dedup by a 128-bit content hash, with the bytes compared inside groups.

DataFrame functions only.  Three steps, none of which gathers a group:

1. every row becomes (id, hash, digest, length), a narrow row kept by a
   checkpoint; only narrow rows are ever shuffled in bulk;
2. hashes that occur twice enter a bitmap of at most 16 MiB; the rows that hit
   it are read again and their bytes compared by a map-side combined
   ``min(text) = max(text)`` for each hash, so that a group of any size ships
   two texts from each map task;
3. groups that fail the comparison (a collision) are split by the bytes
   themselves; the others by the hash.  Rows outside the bitmap are groups of
   their own and take no part; groups that hold more than a thousandth of all
   rows meet their best row by broadcast, the others by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, in_bitmap, spread, wrapped

#: The characters that equality ignores: space and U+0009 to U+000D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_spaces(text: Column) -> Column:
    """``text`` (null: empty) without the six ASCII white-space characters."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows whose texts are equal without white space, the one with the most
    code points in its original text stays, then the smallest id.

    * null text is empty; all empty texts are one group
    * rows that also share the id are told apart by an arbitrary but fixed row
      number, so exactly one row of a group is kept; a null id ranks last
    * very long texts are hashed whole; an empty table gives an empty result
    * other columns of ``docs`` are neither read nor returned
    """
    norm = without_spaces(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), norm.alias("_norm"))
    rows = cut(
        base.select(
            "doc_id",
            content_hash(F.col("_norm")).alias("_hash"),
            F.sha2(F.col("_norm"), 256).alias("text_sha256"),
            F.char_length(F.coalesce("_text", F.lit(""))).alias("_len"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    total = rows.count()
    twice = rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    bits, buckets = bitmap_of(twice, "_hash")
    again = base.select("_norm", content_hash(F.col("_norm")).alias("_hash"))
    collided = cut(
        in_bitmap(again, F.col("_hash"), bits, buckets)
        .where("_hit")
        .groupBy("_hash")
        .agg(F.min("_norm").alias("_low"), F.max("_norm").alias("_high"))
        .where("_low <> _high")
        .select("_hash", F.lit(True).alias("_split"))
    )
    rows = rows.withColumn("_key", F.col("_hash"))
    if not collided.isEmpty():
        # Under a hash that texts collide in, the key of a group is hash and text.
        exact = base.select(
            "doc_id",
            content_hash(F.col("_norm")).alias("_hash"),
            F.sha2(F.col("_norm"), 256).alias("text_sha256"),
            F.char_length(F.coalesce("_text", F.lit(""))).alias("_len"),
            F.monotonically_increasing_id().alias("_row"),
            "_norm",
        ).join(collided, "_hash", "left")
        rows = cut(exact.withColumn("_key", F.when(F.col("_split"), F.concat("_hash", F.lit("|"), "_norm")).otherwise(F.col("_hash"))).drop("_norm", "_split"))
    order = F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    marked = in_bitmap(rows, F.col("_hash"), bits, buckets)
    several = marked.where("_hit").drop("_hit")
    best = several.groupBy("_key").agg(F.min(order).alias("_best"), F.count("*").alias("group_size"))
    grouped = spread(several, best, ["_key"], "group_size", total).select(
        "doc_id",
        F.col("_best.d").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.r")).alias("kept"),
        "text_sha256",
    )
    # A hash outside the bitmap occurs once: its row is its group.
    alone = marked.where("not _hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, all columns as they are.

    Only rows whose id hits the bitmap of dropped ids are shuffled.  Of rows
    that share id and text (without white space), the one with the longest text stays if
    their group keeps that id, else none; they are combined on the map side,
    so that no task holds a row repeated many times.

    * null texts count as empty and null ids as one id; very long texts are compared by their SHA-256
    * an empty table gives an empty result; names of other columns do not matter
    """
    verdict = cut(exact_groups(docs, id_col, text_col))
    gone = verdict.where("not kept").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("gone")).distinct()
    bits, buckets = bitmap_of(gone, "gone")
    row = F.col("row")
    marked = in_bitmap(wrapped(docs), F.coalesce(row[id_col].cast("long"), F.lit(-1).cast("long")), bits, buckets)
    stay = verdict.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    text = F.coalesce(row[text_col], F.lit(""))
    hit = marked.where("_hit").groupBy(row[id_col].alias("id"), F.sha2(without_spaces(row[text_col]), 256).alias("sha"))
    one = hit.agg(F.max_by("row", F.struct(F.char_length(text).alias("n"), text.alias("t"))).alias("row"))
    checked = one.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha"))).select("row")
    return marked.where("not _hit").select("row").unionByName(checked).select("row.*")
