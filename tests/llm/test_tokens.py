"""Tokenizer cache, packing, token store, pieces."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from zonemill.llm import tokens
from zonemill.llm.packing import Prices, best_cuts, cut_points, pack
from zonemill.llm.repair_store import Shard, pack_shard, read_tokens, store_path, write_tokens
from zonemill.llm.spiece import Normaliser, PieceMachine, Transducer, encode_decode
from zonemill.llm.tokens import UnitEncoder

from .conftest import HARD

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
LETTERS = "aAbtheinrÉßẞİΣσ'́  \x1c\x85\t\r\n  .,9٣½漢😀ﬁª×<>s▁"


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def texts(n, seed):
    random.seed(seed)
    return ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 30))) + random.choice(("", "<|endoftext|>", " " * 20)) for _ in range(n)]


def want(word):
    return {k: [np.array(word.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in HARD if i == k] for k, _ in HARD}


def test_units_equal_the_library(word):
    enc = UnitEncoder(WORD)
    given = texts(3000, 1)
    assert [list(x) for x in enc.encode(pa.array(given))] == [e.ids for e in word.encode_batch(given, add_special_tokens=False)]


def test_pieces_equal_the_library():
    machine, model = Transducer(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    given = texts(3000, 2)
    coded = machine.encode(pa.array(given))
    assert [list(x) for x in coded] == model.encode(given)
    assert [machine.decode(x) for x in coded] == [t.replace("▁", " ") for t in given]


def message(number, *fields):
    """One embedded protocol buffer message of (number, value) fields."""
    body = b"".join(bytes([n << 3 | 0, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v for n, v in fields)
    return bytes([number << 3 | 2, len(body)]) + body


def test_normaliser_is_read_or_refused():
    plain = {2: b"", 3: 1, 4: 0, 5: 1}
    build = lambda kind=2, **other: message(2, (3, kind)) + message(3, *(plain | {int(k[1:]): v for k, v in other.items()}).items())
    made = Normaliser(build())
    assert made.kind == 2 and made.start == " " and made.unit(" a b") == "▁a▁b"
    assert Normaliser(build(_3=0)).start == "" and Normaliser(build(1)).kind == 1
    for bad in (build(3), build(_2=b"map"), build(_4=1), build(_5=0)):
        with pytest.raises(ValueError, match="not supported"):
            Normaliser(bad)


def segmentations(text, pieces):
    if not text:
        yield []
    for j in range(1, len(text) + 1):
        if text[:j] in pieces or (j == 1 and text[0] not in pieces):
            yield from ([text[:j], *rest] for rest in segmentations(text[j:], pieces))


@pytest.mark.parametrize("merges", [False, True])
def test_paths_are_the_lightest(merges):
    rng = random.Random(5)
    for _ in range(30):
        names = {"a", "b", "c"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(8)}
        scores = rng.sample(range(100), len(names))
        pieces = {p: (256 + k, -float(s)) for k, (p, s) in enumerate(zip(sorted(names), scores))}
        machine = PieceMachine(pieces, {b: b for b in range(256)}, merges)
        units = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 8))) for _ in range(25)]
        for unit, got in zip(units, machine.shortest_paths(units)):
            spelled = [machine.text_of[i] if i >= 256 else chr(i) for i in got]
            assert "".join(spelled) == unit
            if merges:
                assert spelled == machine.merged(unit)
            else:
                cost = lambda path: sum(machine.weight.get(p, machine.byte_weight) for p in path)
                assert cost(spelled) == min(map(cost, segmentations(unit, pieces)))


def test_piece_edges(hard, docs):
    got = encode_decode(hard, PIECE, keep=True).collect()
    assert len(got) == 10 and all(r["round_trip"] for r in got)
    assert [r["n_pieces"] for r in got if r["doc_id"] in (3, 4)] == [0, 0]
    assert encode_decode(docs([(1, "x")]).limit(0), PIECE).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    for vocab in (2, 3, 50, 40000):
        made = [np.append(rng.integers(0, vocab, rng.integers(0, 400)), 1).astype(np.uint32) for _ in range(60)]
        made += [np.full(999, 5, dtype=np.uint32)]
        shard = Shard(pack_shard([None, *range(len(made) - 1)], made, 49408))
        assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(made))
        assert [list(x) for _, x in shard.documents()] == [list(d) for d in made] and shard.doc_ids[0] is None
        if vocab < 50:
            assert len(shard.symbols) < sum(map(len, made)) * 0.7


def test_wide_ids_and_many_rules():
    rng = np.random.default_rng(4)
    made = [rng.choice([70000, 90000, 5], 300).astype(np.uint32) for _ in range(20)]
    shard = Shard(pack_shard(list(range(20)), made, 100_000))
    assert all(np.array_equal(shard.document(i), d) for i, d in enumerate(made)) and len(shard.rules)
    full = [rng.integers(0, 40, 3000).astype(np.uint32) for _ in range(20)]
    few, many = (Shard(pack_shard(list(range(20)), full, first)) for first in (100, 65_530))
    assert len(few.rules) == len(many.rules) > 6  # rules go on beyond 65,536 symbols
    assert all(np.array_equal(many.document(i), d) for i, d in enumerate(full))
    with pytest.raises(ValueError, match="not below"):
        pack_shard([1], [np.array([70000], dtype=np.uint32)], 49408)


def test_store_grows_and_forgets(word, monkeypatch):
    for name, most in (("MOST_UNITS", 60), ("MOST_BYTES", 500)):
        monkeypatch.setattr(tokens, name, most)
    enc, given = UnitEncoder(WORD), texts(400, 6)
    for lo in range(0, 400, 40):
        part = given[lo : lo + 40] + given[:5]
        assert [list(x) for x in enc.encode(pa.array(part))] == [e.ids for e in word.encode_batch(part, add_special_tokens=False)]


def test_repair_goes_on_until_no_pair_repeats_often():
    run = np.full(1 << 14, 5, dtype=np.uint32)
    shard = Shard(pack_shard([1], [run], 49408))
    assert len(shard.symbols) < 16 and np.array_equal(shard.document(0), run)


def test_a_round_of_few_pairs_takes_little():
    """The late rounds of Re-Pair count a few hundred places, and should not pay for a table of all slots."""
    import tracemalloc

    from zonemill.llm.repair_store import _frequent

    rng = np.random.default_rng(9)
    for kind in (np.uint32, np.uint64):
        keys = rng.integers(0, 60, 300).astype(kind)
        tracemalloc.start()
        pairs, counts = _frequent(keys, 6)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = {k: int((keys == k).sum()) for k in set(keys.tolist()) if (keys == k).sum() >= 6}
        assert dict(zip(pairs.tolist(), counts.tolist())) == want and most < 100_000


def test_store(spark, hard, docs, word):
    path = store_path(spark)
    write_tokens(hard, path, WORD)
    got = sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for k in sorted({k for k, _ in HARD}, key=lambda k: (k is not None, k)):
        for ids in want(word)[k]:
            expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got == expected
    empty = store_path(spark)
    write_tokens(docs([(1, "x")]).limit(0), empty, WORD)
    assert read_tokens(spark, empty).count() == 0


def test_pack(hard, docs, word):
    got = [r.asDict() for r in pack(hard, WORD, buffer_ids=5000).collect()]
    whole = want(word)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(whole)
    for k, pieces in by.items():
        assert sum(p["length"] for p in pieces) == sum(len(x) for x in whole[k])
        for p in pieces:
            assert any(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in whole[k])
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for p in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert pack(docs([(1, "x")]).limit(0), WORD).count() == 0


def test_cuts_are_the_cheapest():
    prices = Prices(sentence=2, anywhere=6, power=5, grid=4)
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, size = int(rng.integers(1, 70)), 16
        flags, ends = rng.random(n) < 0.2, np.unique(np.append(rng.integers(1, n + 1, 3), n))
        at, cost = cut_points(flags, ends, prices)
        p = dict(zip(at.tolist(), cost.tolist()))
        f = {0: 0}
        for k in sorted(p)[1:]:
            f[k] = p[k] + min(min(f[i] + size - (k - i), f[i] + prices.power if (k - i) & (k - i - 1) == 0 and k - i < size else 10**9) for i in f if k - i <= size)
        cuts = best_cuts(at, cost, size, prices)
        paid = sum(p[b] + min(size - (b - a), prices.power if (b - a) & (b - a - 1) == 0 and b - a < size else 10**9) for a, b in zip(cuts, cuts[1:]))
        assert paid == f[n] and cuts[0] == 0 and cuts[-1] == n


def test_a_worker_has_little_in_work(word, monkeypatch):
    """Few texts go to the library at a time and few bytes to the encoder; buffers, and so the cuts, stay as they are."""
    from zonemill.llm import packing

    class Library:
        def encode_batch_fast(self, given, **more):
            most.append(len(given))
            return word.encode_batch_fast(given, **more)

    class Rows:
        def mapInArrow(self, run, kinds):
            return run

    most, parts = [], []
    enc = UnitEncoder(WORD)
    enc.tokenizer = Library()
    given = [f"{k}x" for k in range(5000)]
    assert [list(x) for x in enc.encode(pa.array(given))] == [e.ids for e in word.encode_batch(given, add_special_tokens=False)]
    assert max(most) <= 2000

    flagged = UnitEncoder.flagged
    monkeypatch.setattr(UnitEncoder, "flagged", lambda self, part: parts.append(part.nbytes) or flagged(self, part))
    monkeypatch.setattr(packing, "in_order", lambda *a: Rows())
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "text": [f"Number {k} of many. " * 250 for k in range(900)]})
    run = pack(None, WORD, buffer_ids=100_000)
    got = pa.Table.from_batches(run(iter([batch])))
    assert max(parts) < 1_100_000 < batch.nbytes
    monkeypatch.setattr(packing, "PART_BYTES", 100_000_000)
    assert got == pa.Table.from_batches(run(iter([batch])))
