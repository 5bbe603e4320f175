"""Order-preserving packing into sequences of fixed size, by dynamic programming.

Documents are one stream of ids in ascending id order.  Cuts may fall at the end
of a document (free), of a sentence or line, or, where neither comes for a
while, at a grid of positions (dearer).  With p the positions, c their prices
and a sequence from i to k padded to ``size``,

    f(k) = c(k) + min over i with p(k) - p(i) <= size of f(i) + size - (p(k) - p(i))

which is a sliding-window minimum of f(i) + p(i): a monotone queue gives it in
constant time.  A sequence whose length is a power of two is not padded; those
transitions have a fixed price instead, so that they only end what a full
sequence would pad.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back
from .repair_store import in_order
from .tokens import END_FLAG, UnitEncoder, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
#: Bytes of text that a worker has in work at a time (one text at least); buffers end with slices, which are larger.
PART_BYTES = 1_000_000


@dataclass(frozen=True)
class Prices:
    """In tokens of padding.  ``grid`` must divide the sequence size."""

    sentence: int = 2
    anywhere: int = 24
    power: int = 40
    grid: int = 64


def cut_points(flags: np.ndarray, ends: np.ndarray, prices: Prices) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the stream may be cut, with 0 first, and their prices."""
    soft = flags.copy()
    soft[ends - 1] = True
    at = np.concatenate(([0], np.flatnonzero(soft) + 1))
    cost = np.full(len(at), prices.sentence, dtype=np.int64)
    cost[np.searchsorted(at, ends)] = 0
    cost[0] = 0
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > prices.grid)
    if len(wide):
        more = np.concatenate([np.arange(at[w] + prices.grid, at[w + 1], prices.grid) for w in wide.tolist()])
        at, cost = np.concatenate((at, more)), np.concatenate((cost, np.full(len(more), prices.anywhere)))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int, prices: Prices) -> list[int]:
    """The cheapest cuts, as positions from ``at[0]`` to ``at[-1]``."""
    n = len(at)
    froms, tos = [], []
    power = 1
    while power < size:
        where = np.searchsorted(at, at - power)
        ok = np.flatnonzero(at[where] == at - power)
        froms.append(where[ok])
        tos.append(ok)
        power *= 2
    to = np.concatenate(tos)
    order = np.argsort(to, kind="stable")
    short_from, short_to = np.concatenate(froms)[order].tolist(), to[order].tolist()
    p, c = at.tolist(), cost.tolist()
    f, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(p[0], 0)])
    s, shorts = 0, len(short_to)
    for k in range(1, n):
        pos = p[k]
        low = pos - size
        while p[queue[0][1]] < low:
            queue.popleft()
        best, via = queue[0]
        best += size - pos
        while s < shorts and short_to[s] == k:
            other = f[short_from[s]] + prices.power
            if other < best:
                best, via = other, short_from[s]
            s += 1
        best += c[k]
        f[k], back[k] = best, via
        g = best + pos
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, k))
    cuts, k = [p[-1]], n - 1
    while k:
        k = back[k]
        cuts.append(p[k])
    return cuts[::-1]


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, prices: Prices = Prices(), id_col: str = "doc_id", text_col: str = "text", buffer_ids: int = 1_000_000) -> DataFrame:
    """One row for each piece of a document in a sequence; ``PIECES`` is the schema.

    Each partition packs its own run of documents, ``buffer_ids`` ids at a time;
    what the last sequence of a buffer holds goes on to the next buffer.

    * a null or empty text is the end id alone; repeated ids are documents of
      their own, in the order of a hash of their texts; null ids come first
    * a document of any length is cut over as many sequences as it needs
    * ``sequence_id`` is unique (the partition in its upper bits), pieces of a
      sequence follow each other by ``offset``; an empty table gives no rows
    * other columns are not read
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.shared(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc, start in it, its ids in all, flagged ids
        count = 0
        end = np.array([end_id], dtype=np.uint32)

        def solve(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, sequence
            flagged = np.concatenate([h[3] for h in held])
            ends = np.cumsum([len(h[3]) for h in held])
            ids = (flagged & np.uint32(END_FLAG - 1)).astype("<u4")
            cuts = best_cuts(*cut_points((flagged & np.uint32(END_FLAG)) != 0, ends, prices), size, prices)
            if not final:
                cuts.pop()
            data = ids.tobytes()
            rows: list[tuple] = []
            marks = np.union1d(ends, cuts)
            marks = marks[marks <= cuts[-1]].tolist()
            doc, lo, cut = 0, 0, 1
            starts = (ends - [len(h[3]) for h in held]).tolist()
            stops = ends.tolist()
            for hi in marks:
                if hi == 0:
                    continue
                if lo >= stops[doc]:
                    doc += 1
                if lo >= cuts[cut]:
                    cut += 1
                    sequence += 1
                name, first, total, _ = held[doc]
                piece = data[4 * lo : 4 * hi]
                rows.append((name, first + lo - starts[doc], hi - lo, zlib.crc32(piece), total, sequence, lo - cuts[cut - 1], cuts[cut] - cuts[cut - 1], piece))
                lo = hi
            if rows:
                sequence += 1
            rest = []
            for h, a, b in zip(held, starts, stops):
                if b > lo:
                    skip = max(0, lo - a)
                    rest.append((h[0], h[1] + skip, h[2], h[3][skip:]))
            held, count = rest, sum(len(r[3]) for r in rest)
            if rows:
                kinds = [pa.int64()] * 8 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            known = batch["doc_id"].to_pylist()
            for lo, texts in slices(batch["text"]):
                for at, part in slices(texts, PART_BYTES):
                    for doc, ids in zip(known[lo + at :], encoder.flagged(part)):
                        whole = np.concatenate((ids, end))
                        held.append((doc, 0, len(whole), whole))
                        count += len(whole)
                if count >= buffer_ids:
                    yield from solve(False)
                give_back()
        if held:
            yield from solve(True)

    return in_order(docs, id_col, text_col).mapInArrow(run, PIECES)
