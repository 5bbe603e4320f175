"""Token ids of whole texts, by the tokenizers library, with a store of units that a worker has met.

A text's bytes are cut into units at places where the tokenizer itself always
cuts, so that the text's ids are those of its units in order.  Units follow a
steep frequency law: a slice of texts is dictionary-encoded by Arrow, only its
distinct units are looked up, only new ones go to the library, and the ids of
all units are gathered by numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: Set in the last id of a unit that ends a sentence or line; ids are far below it.
END_FLAG = 0x80000000
#: Bytes of text encoded at a time (one text at least).
SLICE_BYTES = 3_000_000
#: What a worker keeps before it forgets the units met in one slice only: units, bytes of units, ids.
MOST_UNITS, MOST_BYTES, MOST_IDS = 450_000, 12_000_000, 4_000_000
#: New words in one text for the library, which takes longer a word in longer texts.
TEXT_WORDS = 200
#: Texts given to the library at a time: an encoding takes many times the memory of its ids.
LIBRARY_TEXTS = 2000

#: Letters of ASCII and Latin-1 only; a stop, with closing signs after it, at the end.
_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_ENDED = "[.!?][\"')\\]}»”’]*$"
_OTHER, _LETTER, _HIGH, _SPACE, _LINE, _QUOTE = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _HIGH
_CLASS[[32, 10, 39]] = _SPACE, _LINE, _QUOTE


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of ``texts`` (no nulls) of about ``most`` bytes, each with the place of its first text."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one place more than texts)."""
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[places[0] : places[-1]], (places - places[0]).astype(np.int64)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class UnitStore:
    """Ids of units; ``cut`` says where units start, ``learn`` gives the ids of new ones."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.start, self.size, self.met = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.pool, self.used, self.bytes = np.zeros(1 << 18, dtype=np.uint32), 0, 0

    def cut(self, data: np.ndarray) -> np.ndarray:
        """True at every byte that starts a unit (the first byte of a text starts one anyway)."""
        raise NotImplementedError

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new units: all ids in a row, and of each unit where its ids start there and how many they are."""
        raise NotImplementedError

    def _shrink(self) -> None:
        """Start anew with the units met in more than one slice, the half met most often at most."""
        often = [u for u, i in self.at.items() if self.met[i] > 1 and len(u) < 100]
        often.sort(key=lambda u: -self.met[self.at[u]])
        often = often[: MOST_UNITS // 2]
        rows = np.array([self.at[u] for u in often], dtype=np.int64)
        start, size, met, pool = self.start[rows], self.size[rows], self.met[rows], self.pool
        self._forget()
        self._add(often, pool[runs(start, size)], np.cumsum(size) - size, size)
        self.met[: len(often)] = met

    def _add(self, units: list[bytes], flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        first, last = len(self.at), len(self.at) + len(units)
        while last > len(self.start):
            self.start, self.size, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.met))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.size[first:last] = size
        self.start[first:last] = self.used + start
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.bytes += sum(map(len, units))
        self.at.update(zip(units, range(first, last)))

    def gather(self, data: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``data`` are the bytes of all, ``places`` their starts and the end."""
        if not len(data):
            return [np.zeros(0, dtype=np.uint32) for _ in places[1:]]
        if len(self.at) > MOST_UNITS or self.bytes > MOST_BYTES or self.used > MOST_IDS:
            self._shrink()
        starts = self.cut(data)
        starts[places[:-1][places[:-1] < len(data)]] = True
        bounds = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        keys = units.dictionary.to_pylist()
        where = list(map(self.at.get, keys))
        if None in where:
            new, first = [k for k, i in enumerate(where) if i is None], len(self.at)
            self._add([keys[k] for k in new], *self.learn(units.dictionary.take(pa.array(new, pa.int32()))))
            for i, k in enumerate(new, first):
                where[k] = i
        rows = np.array(where, dtype=np.int64)
        self.met[rows] += 1
        rows = rows[units.indices.to_numpy(zero_copy_only=False)]
        size = self.size[rows]
        ends = np.cumsum(size)
        out = self.pool[runs(self.start[rows], size)]
        cuts = np.append(0, ends)[np.searchsorted(bounds, places)]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class UnitEncoder(UnitStore):
    """Encodes texts with one tokenizer file whose word-final tokens end in ``</w>``; ``shared`` gives a worker's own."""

    @classmethod
    def shared(cls, path: str) -> UnitEncoder:
        return worker_state(("tokens", path), lambda: cls(path))

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.final[i] = token.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        parts = (texts[k : k + LIBRARY_TEXTS] for k in range(0, len(texts), LIBRARY_TEXTS))
        return [np.array(e.ids, dtype="<u4") for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and sizes, of words of letters: each has one final token, its last, so they are encoded as few texts."""
        if words:
            ids = np.concatenate(self._whole([" ".join(words[k : k + TEXT_WORDS]) for k in range(0, len(words), TEXT_WORDS)]))
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        return self._rest(words)

    def _rest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole(texts)
        return np.concatenate([np.zeros(0, dtype=np.uint32), *ids]), np.array([len(i) for i in ids], dtype=np.int64)

    def cut(self, data: np.ndarray) -> np.ndarray:
        """Units start at the first of some spaces, after line feeds, and where an ASCII or Latin-1 letter meets other ASCII.

        The tokenizer drops white space and never joins a letter and a sign or
        digit.  An apostrophe may belong to a contraction, and other characters may be
        combining: nothing is cut beside them.
        """
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7)]  # all but the signs for multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
        left, right = kind[:-1], kind[1:]
        starts = np.zeros(len(data), dtype=bool)
        starts[1:] = ((right == _SPACE) & (left != _SPACE)) | ((left == _LINE) & (right != _LINE)) | (left + right == _OTHER + _LETTER) & (left != right)
        return starts

    @staticmethod
    def lowered(data: np.ndarray) -> np.ndarray:
        """ASCII and Latin-1 letters in lower case, as the tokenizer would do, but for those before a character that may combine."""
        out = data.copy()
        plain = np.append(data[1:] < 0xC4, True)
        out[(data - np.uint8(65) < 26) & plain] |= 0x20
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[(data[lead] < 0x9F) & (data[lead] != 0x97) & plain[lead]]
        out[lead] += 0x20
        return out

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters go to the library many in a text, others one by one; units that end a sentence or line have their own copy."""
        units = units.cast(pa.string())
        cores = pc.utf8_trim(units, " \n").dictionary_encode()
        core, which = cores.dictionary, cores.indices.to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(core, _WORD)
        is_word = plain.to_numpy(zero_copy_only=False)
        flat, size = self._words(core.filter(plain).to_pylist())
        more, sizes = self._rest(core.filter(pc.invert(plain)).to_pylist())
        flat = np.concatenate((flat, more))
        all_sizes = np.concatenate((size, sizes))
        starts = np.cumsum(all_sizes) - all_sizes
        of_core = np.empty(len(core), dtype=np.int64)
        of_core[is_word], of_core[~is_word] = np.arange(len(size)), np.arange(len(size), len(all_sizes))
        start, size = starts[of_core][which], all_sizes[of_core][which]
        ends = pc.or_(pc.ends_with(units, "\n"), pc.match_substring_regex(units, _ENDED)).to_numpy(zero_copy_only=False) & (size > 0)
        if ends.any():
            copy = flat[runs(start[ends], size[ends])]
            tails = np.cumsum(size[ends])
            copy[tails - 1] |= np.uint32(END_FLAG)
            start[ends] = len(flat) + tails - size[ends]
            flat = np.concatenate((flat, copy))
        return flat, start, size

    def flagged(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls) as uint32, with ``END_FLAG`` in ids that end a sentence or line."""
        special = pc.match_substring(texts, "<|")  # may be a special token, in which nothing must be cut or lowered
        if pc.any(special).as_py():
            whole = iter(self._whole(texts.filter(special).to_pylist()))
            plain = iter(self.flagged(texts.filter(pc.invert(special))))
            return [next(whole if s else plain) for s in special.to_pylist()]
        data, places = bytes_of(texts)
        return self.gather(self.lowered(data), places)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [a & np.uint32(END_FLAG - 1) for a in self.flagged(texts)]
