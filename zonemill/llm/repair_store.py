"""Token-id files compressed by Re-Pair.

A shard is the ids of consecutive documents, about ``SHARD_IDS`` of them, as one
self-contained blob.  Frequent adjacent symbol pairs are replaced by new symbols
(nonterminals) again and again; the blob holds the rules, each rule's expansion
length, where every document starts among the symbols, and the symbols (of two bytes, or of
four where a shard needs more than 65,536).  One
document is decoded by expanding its own symbols only, since no rule crosses
the end of a document.

Blob, little-endian: magic, then counts (documents, rules, symbols, first rule,
symbol width), document ids and a null flag each, symbol offsets, id counts,
rule pairs, expansion lengths, symbols.  Blobs are kept one per row in Parquet,
so a write commits or fails as a whole on any file system.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import UnitEncoder, runs, slices

MAGIC = b"ZMRP0002"
HEAD = struct.Struct("<8sIIIII")
#: Ids after which a shard is closed; a longer document makes a longer shard.
SHARD_IDS = 400_000
#: The least count of a pair that earns a rule: a rule takes 8 bytes and each use saves 2.
LEAST = 6
_SLOTS = 20
_U64 = np.uint64


def _slot(keys: np.ndarray) -> np.ndarray:
    """A number of ``_SLOTS`` bits for each pair of symbols."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)
    return (keys * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - _SLOTS)


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of the keys that occur ``least`` times or more."""
    ordered = np.sort(keys)
    if not len(ordered):
        return ordered, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(at, len(ordered)))
    often = counts >= least
    return ordered[at[often]], counts[often]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (symbols, rules of two symbols each, expansion lengths of the rules, last-of-document flags).

    A round replaces every pair that occurs ``least`` times or more; of pairs that
    overlap, the more frequent one, and every other one of a run of equal pairs.
    A pair can only become frequent where a symbol is new, so a round counts the
    places beside new symbols and those that lost an overlap in the round before.
    It ends when no pair occurs ``least`` times.  ``ends`` flags the last id of
    each document, which never starts a pair.
    """
    n = len(ids)
    symbols, last = ids.astype(np.uint32), ends.copy()
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive = np.ones(n, dtype=bool)
    marked = np.zeros(n + 1, dtype=bool)
    rank = np.zeros(n + 1, dtype=np.int32)  # of the pair at a place, 0 where there is none
    table = np.zeros(1 << _SLOTS, dtype=np.int32)
    rules, lengths = [np.zeros((0, 2), dtype=np.uint32)], np.ones(first, dtype=np.int64)
    made = first
    at = np.flatnonzero(~last[:-1]) if n else np.zeros(0, dtype=np.int64)
    while len(at):
        if made <= 65536:
            keys = (symbols[at] << np.uint32(16)) | symbols[after[at]]
        else:
            keys = (symbols[at].astype(_U64) << _U64(32)) | symbols[after[at]]
        pairs, counts = _frequent(keys, least)
        if not len(pairs):
            break
        slots = _slot(pairs)
        table[slots] = np.arange(1, len(pairs) + 1)
        found = table[_slot(keys)]
        table[slots] = 0
        hit = np.flatnonzero(found)
        where, which, keys = at[hit], found[hit] - 1, keys[hit]
        other = np.flatnonzero(pairs[which] != keys)  # two pairs in one slot, or a rare pair
        which[other] = np.minimum(np.searchsorted(pairs, keys[other]), len(pairs) - 1)
        right = pairs[which] == keys
        where, which = where[right], which[right]
        lost = where
        # Every other one of a run of equal pairs that overlap.
        linked = np.concatenate(([False], (after[where[:-1]] == where[1:]) & (which[:-1] == which[1:])))
        if linked.any():
            starts = np.maximum.accumulate(np.where(linked, 0, np.arange(len(where))))
            even = ((np.arange(len(where)) - starts) & 1) == 0
            where, which = where[even], which[even]
        place = np.empty(len(pairs), dtype=np.int32)
        place[np.argsort(counts, kind="stable")] = np.arange(1, len(pairs) + 1)
        own = place[which]
        rank[where] = own
        wins = (own > rank[before[where]]) & (own > rank[after[where]])
        rank[where] = 0
        chosen, which = where[wins], which[wins]
        flags = np.zeros(len(pairs), dtype=np.int32)
        flags[which] = 1
        index = np.cumsum(flags)
        used = pairs[flags == 1]
        if used.dtype == np.uint32:
            rule = np.stack((used >> np.uint32(16), used & np.uint32(0xFFFF)), axis=1)
        else:
            rule = np.stack((used >> _U64(32), used & _U64(0xFFFFFFFF)), axis=1).astype(np.uint32)
        lengths = np.concatenate((lengths, lengths[rule[:, 0]] + lengths[rule[:, 1]]))
        rules.append(rule)
        gone = after[chosen]
        symbols[chosen] = made - 1 + index[which]
        last[chosen] = last[gone]
        alive[gone] = False
        follow = after[gone]
        after[chosen] = follow
        inner = follow < n
        before[follow[inner]] = chosen[inner]
        made += len(used)
        # Next: beside new symbols, and what lost an overlap.
        marked[lost] = marked[chosen] = marked[before[chosen]] = True
        marked[n] = False  # the place before the first
        at = np.flatnonzero(marked)
        marked[at] = False
        at = at[alive[at] & ~last[at]]
    return symbols[alive], np.concatenate(rules), lengths[first:], last[alive]


def pack_shard(doc_ids: list[int | None], docs: list[np.ndarray], first: int) -> bytes:
    """A blob of the ids of some documents, each of at least one id below ``first``; an id from ``first`` on raises ValueError."""
    sizes = np.array([len(d) for d in docs], dtype=np.uint32)
    ids = np.concatenate(docs) if docs else np.zeros(0, dtype=np.uint32)
    if len(ids) and int(ids.max()) >= first:
        raise ValueError(f"id {int(ids.max())} is not below {first}")
    if len(sizes) and not sizes.min():
        raise ValueError("a document without ids cannot be stored")
    ends = np.zeros(len(ids), dtype=bool)
    ends[np.cumsum(sizes, dtype=np.int64) - 1] = True
    symbols, rules, lengths, last = compress(ids, ends, first)
    offsets = np.concatenate(([0], np.flatnonzero(last) + 1)).astype("<u4")
    known = [0 if d is None else d for d in doc_ids]
    width = 2 if first + len(rules) <= 65536 else 4
    return b"".join(
        (
            HEAD.pack(MAGIC, len(docs), len(rules), len(symbols), first, width),
            np.array(known, dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
            offsets.tobytes(),
            sizes.astype("<u4").tobytes(),
            rules.astype(f"<u{width}").tobytes(),
            lengths.astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        )
    )


class Shard:
    """Reads a blob; ``document(i)`` decodes one document, ``documents()`` all."""

    def __init__(self, blob: bytes) -> None:
        magic, n, r, s, self.first, width = HEAD.unpack_from(blob)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.offsets, self.sizes = take("<u4", n + 1), take("<u4", n)
        self.rules = take(f"<u{width}", 2 * r).reshape(r, 2)
        lengths = take("<u4", r).astype(np.int64)
        self.symbols = take(f"<u{width}", s)
        self.lengths = np.concatenate((np.ones(self.first, dtype=np.int64), lengths))
        self.base = np.concatenate((np.arange(self.first), self.first + np.cumsum(lengths) - lengths))
        self.pool = np.arange(self.first + int(lengths.sum()), dtype=np.uint32)
        # Rules in the order in which their parts are known: a rule's parts come from rounds before its own.
        ready, left = np.arange(self.first + r) < self.first, np.arange(r)
        while len(left):
            now = ready[self.rules[left, 0]] & ready[self.rules[left, 1]]
            these, left = left[now], left[~now]
            if not len(these):
                raise ValueError("rules of a token shard refer to themselves")
            to = self.base[self.first + these]
            for part in (self.rules[these, 0], self.rules[these, 1]):
                self.pool[runs(to, self.lengths[part])] = self.pool[runs(self.base[part], self.lengths[part])]
                to = to + self.lengths[part]
            ready[self.first + these] = True

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[runs(self.base[symbols], self.lengths[symbols])]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[i] : self.offsets[i + 1]])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self.expand(self.symbols)
        at = 0
        for doc, size in zip(self.doc_ids, self.sizes.tolist()):
            yield doc, ids[at : at + size]
            at += size


STORED = "part int, seq int, start long, n_docs int, n_ids long, first_doc long, last_doc long, blob binary"
READ = "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) range-partitioned and sorted by id, null ids first; null text is empty.

    Rows of one id are ordered by a hash of their text, so that many equal or
    null ids are still dealt over several partitions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write shards in ascending id order to ``path``.

    Null and empty texts have the end id alone; repeated ids are documents of
    their own, ordered by text; a text of any length stays in one shard; an
    empty table writes an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.shared(tokenizer)
        first = len(encoder.final)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names, held, count = [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal seq, start, count
            blob = pack_shard(names, held, first)
            known = [n for n in names if n is not None]
            row = [part, seq, start, len(names), count, min(known, default=None), max(known, default=None), blob]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in STORED.split(", ")])
            seq, start, count = seq + 1, start + count, 0
            names.clear()
            held.clear()
            return out

        for batch in batches:
            known = batch["doc_id"].to_pylist()
            for lo, texts in slices(batch["text"]):
                for doc, ids in zip(known[lo:], encoder.encode(texts)):
                    names.append(doc)
                    held.append(np.concatenate((ids, end)))
                    count += len(held[-1])
                    if count >= SHARD_IDS:
                        yield close()
        if names:
            yield close()

    in_order(docs, id_col, text_col).mapInArrow(run, STORED).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files at ``path``.

    ``start`` counts the ids of all documents before.  Only one total for each
    written partition is gathered and broadcast.
    """
    from pyspark.sql import Window

    stored = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, start, blob in zip(*(batch[c].to_pylist() for c in ("part", "seq", "start", "blob"))):
                rows = [(d, len(ids), zlib.crc32(ids.astype("<u4"))) for d, ids in Shard(blob).documents()]
                sizes = np.array([r[1] for r in rows], dtype=np.int64)
                columns = [
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array([seq] * len(rows), pa.int32()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(start + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([r[2] for r in rows], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    read = stored.select("part", "seq", "start", "blob").mapInArrow(run, READ)
    return read.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("_base")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def store_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
