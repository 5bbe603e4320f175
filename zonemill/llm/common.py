"""Helpers shared by the corpus operators: checkpoints, and set membership by a bitmap of fixed size."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One bitmap row covers this many positions (the width of ``bitmap_construct_agg``).
BITS = 32768
#: Upper bound of bitmap rows: 4096 rows of 4 KiB, 16 MiB in all, whatever the input.
MAX_BUCKETS = 4096


T = TypeVar("T")
_STATE: list = []


def worker_state(key: Hashable, make: Callable[[], T]) -> T:
    """The state that this Python worker holds under ``key``.

    A worker serves one operator after another and holds the state of one only:
    another key drops the state held before it makes its own.
    """
    if not _STATE or _STATE[0] != key:
        drop_state()
        _STATE.extend((key, make()))
    return _STATE[1]


def drop_state() -> None:
    """Give the memory of the state that this Python worker holds back; operators without a state of their own begin with it.

    Spark hands tasks to its idle workers in turn, so that each of them would keep the state of an
    operator that ended long ago.
    """
    if not _STATE:
        return
    _STATE.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system: beside a full heap of the JVM it counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where all run in one process on one machine (a local test) may it be
    unset, and is then a temporary folder; anywhere else that raises.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="zonemill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bitmap_of(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap over the hashes of ``key``: (rows of bucket and bits, number of buckets).

    The number of buckets follows the number of keys up to ``MAX_BUCKETS``, so
    the bitmap never exceeds 16 MiB and may be broadcast.  Membership has no
    false negatives; false positives only let more rows take the exact path.
    """
    count = keys.count()
    buckets = 1
    while buckets < MAX_BUCKETS and buckets * BITS < 16 * count:
        buckets *= 2
    at = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    bits = (
        keys.select((at / BITS).cast("int").alias("_bucket"), (at % BITS).alias("_at"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_at").alias("_bits"))
    )
    return bits, buckets


def in_bitmap(df: DataFrame, key: Column, bits: DataFrame, buckets: int) -> DataFrame:
    """Add boolean ``_hit``: true for every key in the bitmap, and for a few others."""
    at = F.pmod(F.xxhash64(key), F.lit(buckets * BITS))
    return (
        df.withColumns({"_bucket": (at / BITS).cast("int"), "_at": (at % BITS).cast("int")})
        .join(F.broadcast(bits), "_bucket", "left")
        .withColumn(
            "_hit",
            F.coalesce(F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1") == 1, F.lit(False)),
        )
        .drop("_bucket", "_at", "_bits")
    )


#: A key is hot if it has more than one in so many of all rows; so many keys are hot at most.
HOT = 1000


def spread(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose keys are unique and whose column ``weight`` counts the rows of ``left`` that a key has.

    Keys with more than ``total / HOT`` rows are ``HOT`` at most, whatever the input,
    and are joined by broadcast; no other key is more than that share of a shuffle.
    """
    hot = right.where(F.col(weight) * HOT > total)
    cold = right.where(F.col(weight) * HOT <= total)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``: helper columns beside it clash with none of its own."""
    return docs.select(F.struct("*").alias("row"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column, not null), all columns as they are.

    Only rows that hit the bitmap of ``ids`` are shuffled; the others pass.
    """
    ids = ids.toDF("gone").distinct()
    bits, buckets = bitmap_of(ids, "gone")
    marked = in_bitmap(wrapped(docs), F.col("row")[id_col].cast("long"), bits, buckets)
    passed = marked.where("not _hit").select("row")
    checked = marked.where("_hit").join(ids, F.col("row")[id_col] == F.col("gone"), "left_anti").select("row")
    return passed.unionByName(checked).select("row.*")
