"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into machines over the tropical semiring, in which weights
of a path are added and the lightest path wins.

* The normaliser N rewrites characters as the model file asks: a space becomes
  U+2581, and the start of the text emits one more.  A model that maps other
  characters or removes spaces is refused.
* The piece machine P is the trie of all pieces: its arcs read characters, and
  an accepting state emits its piece with weight minus the piece's score and
  goes back to the root.
* The byte machine B reads one character that no piece covers and emits its
  UTF-8 bytes, with a weight above all pieces.
* A model of BPE type has a merge machine M too.  Its states are pieces; the
  arc from one piece to the next has weight 0 if merging leaves the two apart,
  else infinity.  So the only finite path is what the merges end in.

Each input is composed with them: the states of the composition are (place in
the input, state of M), and its arcs are the pieces and bytes that read on
from there.  It has no cycles, so relaxing the states in the order of their
places gives the shortest path.  Where no piece holds the two characters beside
a border, every path has a border, so an input is composed unit by unit between
such borders, and a worker keeps the paths of units.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state
from .tokens import UnitStore, bytes_of, runs, slices

SPACE = "▁"
ENCODED = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean, decoded_crc32 long"
#: Arcs of the merge machine that a worker keeps.
PAIRS = 400_000
UNIGRAM, BPE = 1, 2


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, blob[at : at + size]
        at += size


class Normaliser:
    """The transducer N of a model file: one state before the text and one in it."""

    def __init__(self, model: bytes) -> None:
        parts = dict(x for x in _fields(model) if x[0] in (2, 3))
        trainer, spec = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        why = [
            what
            for what, bad in (
                ("its type is neither BPE nor unigram", self.kind not in (UNIGRAM, BPE)),
                ("a space may be a suffix", trainer.get(24, 0)),
                ("its normaliser maps characters", spec.get(2, b"")),
                ("it removes extra spaces", spec.get(4, 1)),
                ("it leaves spaces as they are", not spec.get(5, 1)),
            )
            if bad
        ]
        if why:
            raise ValueError(f"this model is not supported: {', '.join(why)}")
        #: What the start of a text emits, and the arcs that do not copy their character.
        self.start = " " if spec.get(3, 1) else ""
        self.arcs = {ord(" "): SPACE}

    def unit(self, text: str) -> str:
        """The output for a unit (the start of a text is already written as the space that it emits)."""
        return text.translate(self.arcs)


class PieceMachine:
    """P and B, and M if the model is of BPE type; ``shortest_paths`` composes normalised units with them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], merges: bool) -> None:
        self.pieces, self.byte_ids, self.merges = pieces, byte_ids, merges
        self.weight = {p: -score for p, (_, score) in pieces.items()}
        self.byte_weight = 10.0 + max((abs(w) for w in self.weight.values()), default=0.0)
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.trie: list[dict[str, int]] = [{}]
        self.accept: list[int] = [-1]
        self.out: list[float] = [0.0]
        for piece, (i, _) in pieces.items():
            # A piece that its own characters do not merge into is on no finite path of a BPE model.
            if merges and len(piece) > 1 and self.merged(piece) != [piece]:
                continue
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.accept.append(-1)
                    self.out.append(0.0)
                at = self.trie[at][c]
            self.accept[at], self.out[at] = i, self.weight[piece]
        self.apart: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: best score first, then from the left."""
        parts, weight = list(text), self.weight
        while len(parts) > 1:
            best, i = min([(weight.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))])
            if best == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, p: int, q: int) -> bool:
        """True if M's arc from piece p to piece q has weight 0, False if it is infinite."""
        got = self.apart.get((p, q))
        if got is None:
            a, b = self.text_of[p], self.text_of[q]
            parts = self.merged(a + b)
            got = len(parts) == 2 and parts[0] == a
            if len(self.apart) > PAIRS:
                self.apart.clear()
            self.apart[p, q] = got
        return got

    def shortest_paths(self, units: list[str]) -> list[list[int]]:
        """The ids of the lightest path of each unit; of equal weights, the one whose last piece starts first.

        The units are composed together as a prefix tree: in their sorted order,
        the states over a prefix that two units share are built once.
        """
        found: list[list[int]] = [[]] * len(units)
        trie, accept, out, merges, apart = self.trie, self.accept, self.out, self.merges, self.apart
        # For each place: pieces begun before it that may still go on, as (start, trie node); and for each state of M
        # (the last piece; one state for all if there is no M) weight, start of the last piece, state before, last piece.
        begun: list[list[tuple[int, int]]] = [[]]
        states: list[dict[int, tuple[float, int, int, int]]] = [{-1: (0.0, 0, -1, -1)}]
        previous = ""
        for k in sorted(range(len(units)), key=units.__getitem__):
            unit = units[k]
            shared, most = 0, min(len(previous), len(unit))
            while shared < most and previous[shared] == unit[shared]:
                shared += 1
            del begun[shared + 1 :], states[shared + 1 :]
            for at in range(shared, len(unit)):
                c = unit[at]
                going, here = [], {}
                options = begun[at] + [(at, 0)] if states[at] else begun[at]
                single = False
                for start, node in options:
                    node = trie[node].get(c)
                    if node is None:
                        continue
                    going.append((start, node))
                    piece = accept[node]
                    if piece < 0:
                        continue
                    single = single or start == at
                    weight = out[node]
                    for before, state in states[start].items():
                        if merges and before >= 0:
                            free = apart.get((before, piece))
                            if not (self.stay_apart(before, piece) if free is None else free):
                                continue
                        total = state[0] + weight
                        key = piece if merges else -1
                        if key not in here or total < here[key][0]:
                            here[key] = (total, start, before, piece)
                if not single:  # an arc of B
                    for before, state in states[at].items():
                        total = state[0] + self.byte_weight
                        if -1 not in here or total < here[-1][0]:
                            here[-1] = (total, at, before, -1)
                begun.append(going)
                states.append(here)
            previous = unit
            found[k] = self._back(unit, states)
        return found

    def _back(self, unit: str, states: list[dict[int, tuple[float, int, int, int]]]) -> list[int]:
        at = len(unit)
        last = min(states[at], key=lambda state: states[at][state][0], default=None)
        if last is None:
            raise ValueError("no path of finite weight")
        ids: list[int] = []
        while at:
            _, start, before, piece = states[at][last]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in reversed(unit[start].encode("utf-8", "surrogatepass"))]
            at, last = start, before
        return ids[::-1]


class Transducer(UnitStore):
    """All machines of a model file and the paths of the units met; ``shared`` gives a worker's own."""

    @classmethod
    def shared(cls, path: str) -> Transducer:
        return worker_state(("pieces", path), lambda: cls(path))

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(model.serialized_model_proto())
        size = model.get_piece_size()
        pieces: dict[str, tuple[int, float]] = {}
        self.byte_of = np.full(size, -1, dtype=np.int64)
        texts = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                texts[i] = bytes([self.byte_of[i]])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i, model.get_score(i)
                texts[i] = piece.replace(SPACE, " ").encode()
        byte_ids = {int(b): i for i, b in enumerate(self.byte_of.tolist()) if b >= 0}
        if len(byte_ids) < 256:
            raise ValueError("this model is not supported: it has no byte fallback")
        self.machine = PieceMachine(pieces, byte_ids, self.normaliser.kind == BPE)
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.text_size = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size

        # Bytes that may stand beside each other within a piece: the last of a character and the first of the next.
        self.joined = np.zeros(1 << 16, dtype=bool)
        self.joined.reshape(256, 256)[:, 0x80:0xC0] = True  # nothing is cut inside a character
        for piece in pieces:
            chars = [c.encode() for c in piece.replace(SPACE, " ")]
            for a, b in zip(chars, chars[1:]):
                self.joined[a[-1] << 8 | b[0]] = True

    def cut(self, data: np.ndarray) -> np.ndarray:
        """Units start where no piece holds the characters on both sides."""
        starts = np.zeros(len(data), dtype=bool)
        starts[1:] = ~self.joined[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        return starts

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        paths = self.machine.shortest_paths([self.normaliser.unit(u) for u in units.cast(pa.string()).to_pylist()])
        size = np.array([len(p) for p in paths], dtype=np.int64)
        return np.array([i for p in paths for i in p], dtype=np.uint32), np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls)."""
        plain = pc.replace_substring(texts, SPACE, " ")
        begun = pc.if_else(pc.equal(pc.binary_length(plain), 0), "", pc.binary_join_element_wise(self.normaliser.start, plain, ""))
        data, places = bytes_of(begun)
        return self.gather(data, places)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: U+2581 a space, the one that the start of the text emitted left out."""
        out = self.text[runs(self.text_start[ids], self.text_size[ids])].tobytes()
        return out[1:] if self.normaliser.start and out[:1] == b" " else out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bad UTF-8 sequences become U+FFFD."""
        return self.spell(ids).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``ENCODED`` of every whole text, with ``ids binary, decoded string`` too if ``keep``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers;
    ``round_trip`` tells whether decoding gives the text back (U+2581 counts as
    the space that it encodes).

    * null is empty: no pieces; a text of any length is encoded whole
    * repeated rows are encoded each; an empty table gives an empty result;
      other columns are not read
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ENCODED + (", ids binary, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.shared(model)
        for batch in batches:
            known = batch["doc_id"]
            for lo, texts in slices(batch["text"]):
                coded = machine.encode(texts)
                spelled = [machine.spell(c) for c in coded]
                plain = pc.replace_substring(texts, SPACE, " ").cast(pa.binary()).to_pylist()
                columns = [
                    known.slice(lo, len(texts)),
                    pa.array([len(c) for c in coded], pa.int64()),
                    pa.array([int((machine.byte_of[c] >= 0).sum()) for c in coded], pa.int64()),
                    pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in coded], pa.int64()),
                    pa.array([d == t for d, t in zip(spelled, plain)], pa.bool_()),
                    pa.array([zlib.crc32(d) for d in spelled], pa.int64()),
                ]
                if keep:
                    columns += [pa.array([c.astype("<u4").tobytes() for c in coded], pa.binary()), pa.array([d.decode("utf-8", "replace") for d in spelled], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
