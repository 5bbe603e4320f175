"""The registered corpus queries ``opN_<name>`` and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import documents
from .exact_dedup import exact_groups
from .langid import identify, train
from .packing import pack
from .quality import judge
from .repair_store import read_tokens, store_path, write_tokens
from .setsketch import near_groups
from .sharding import regular, shard_slots
from .spiece import encode_decode
from .surrogates import KINDS, replace_entities

#: Stands for a secret that a deployment would supply.
KEY = "surrogate-key"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Five regions of two racks of four shards.
TREE_40 = regular(5, 2, 4)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), WORD_BPE).drop("ids")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("failed_rules")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), PIECES)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=3, percent=85)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda entity: entity["kind"] == kind


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    done = replace_entities(docs, KEY, found="found")
    kinds = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("found").cast("long").alias("n_entities"), *kinds, "text")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store_path(spark)
    write_tokens(documents(spark, sf_dir), path, WORD_BPE)
    return read_tokens(spark, path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(documents(spark, sf_dir), TREE_40, TREE_40.grow())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op4_quality": op4_quality,
    "op5_pieces": op5_pieces,
    "op7_near_dedup": op7_near_dedup,
    "op8_surrogates": op8_surrogates,
    "op9_token_store": op9_token_store,
    "op3_sharding": op3_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op10_chat": op10_chat,
}

ORACLES: dict[str, str] = {"op6_exact_dedup": OP6_SQL}
