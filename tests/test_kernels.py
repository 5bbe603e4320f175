"""Arbitration and sessions, without Spark."""

import itertools
import random

import pytest

from zonemill.operators.arbitrate import Cell, is_satisfied, options, plausible_date, satisfy, snap, structural
from zonemill.streaming.session import FRAME, Session, fold_all, fold_batch, fold_stream


def test_plausible_dates():
    want = {"740431": False, "740430": True, "000229": True, "990229": False, "74<<<<": True, "740<30": False, "<<0229": True}
    assert {k: plausible_date(k) for k in want} == want


def test_snap():
    assert snap(Cell((("O", 0.9), ("0", 0.8)), "Digit")).char == "0"
    assert snap(Cell((("X", 0.95), ("M", 0.5)), "SexChar")).char == "X"
    assert snap(Cell((("X", 0.8), ("M", 0.7)), "SexChar")).char == "M"


def test_satisfy_finds_the_best_assignment():
    random.seed(3)
    for _ in range(150):
        cells = []
        for _ in range(5):
            chars = random.sample("0123456789ABC<", 3)
            scores = sorted((round(random.uniform(0.5, 0.95), 3) for _ in chars), reverse=True)
            cells.append(Cell(tuple(zip(chars, scores))))
        protected, check = cells[:4], Cell(tuple((c, s) for c, (_, s) in zip(random.sample("0123456789", 3), cells[4].candidates)), "Digit")
        best = None
        for pick in itertools.product(*map(options, [*protected, check])):
            made = [Cell(c.candidates, c.kind, p[0]) for c, p in zip([*protected, check], pick)]
            if is_satisfied(made[:4], made[4]):
                total = sum(p[1] for p in pick)
                best = total if best is None else max(best, total)
        got = satisfy(protected, check)
        assert (got is None) == (best is None)
        if got and not is_satisfied(protected, check):
            assert is_satisfied(*got) and abs(sum(c.score for c in [*got[0], got[1]]) - best) < 1e-9


def test_satisfy_with_dates_and_fillers_tries_all():
    random.seed(4)
    for turn in range(60):
        protected = [Cell(tuple(zip(random.sample("0123456789B<", 4), (0.9, 0.88, 0.86, 0.84))), "DigitOrFiller") for _ in range(6)]
        check = Cell(tuple(zip(random.sample("0123456789<", 2), (0.7, 0.6))), "DigitOrFiller")
        dates = ((0, 6),) if turn % 2 else ()
        best = None
        choices = [structural(c, i) if dates else options(c) for i, c in enumerate(protected)] + [options(check)]
        for pick in itertools.product(*choices):
            made = [Cell(c.candidates, c.kind, p[0]) for c, p in zip([*protected, check], pick)]
            if is_satisfied(made[:6], made[6], True) and (not dates or plausible_date("".join(c.char for c in made[:6]))):
                best = max(best or 0.0, sum(p[1] for p in pick))
        got = satisfy(protected, check, True, dates=dates)
        if not is_satisfied(protected, check, True) or dates and not plausible_date("".join(c.char for c in protected)):
            assert (got is None) == (best is None)
            assert got is None or is_satisfied(*got, True) and abs(sum(c.score for c in [*got[0], got[1]]) - best) < 1e-9


def test_satisfy_past_many_implausible_months():
    month = Cell((("9", 0.99), ("8", 0.98), ("7", 0.97), ("0", 0.5)), "DigitOrFiller")
    digit = Cell((("1", 0.9), ("2", 0.89), ("0", 0.88), ("3", 0.87)), "DigitOrFiller")
    got = satisfy([digit, digit, month, digit, digit, digit], Cell((("0", 0.95),), "Digit"), dates=((0, 6),))
    assert got and got[0][2].char == "0" and is_satisfied(*got)


def test_structural_date_digits():
    cell = Cell((("7", 0.9), ("B", 0.8), ("3", 0.4), ("1", 0.3)), "DigitOrFiller")
    assert [[c for c, _ in structural(cell, k)] for k in (0, 2, 4)] == [["7", "3", "1"], ["1"], ["3", "1"]]


def frame(n, identity, valid=True, text=None, confidence=0.8):
    return {"session_id": "s", "frame_no": n, "mrz_found": True, "is_valid": valid, "doc_type": "Td3", "identity": identity, "lines": [text or identity * 4], "checks_valid": 5 if valid else 3, "confidence": confidence}


def test_identity_switch_and_collision():
    stable = [(r[3], r[4]) for r in fold_all([frame(0, "A"), frame(1, "A"), frame(2, "B"), frame(3, "B")], Session())]
    assert stable == [("A", False), ("A", True), ("A", False), ("B", True)]
    assert fold_all([frame(0, "A"), frame(1, "B"), frame(2, "A")], Session())[-1][3:5] == ("A", True)


def test_long_corroboration_and_votes():
    rows = fold_all([frame(i, "A") for i in range(18)], Session(stable_frames=18))
    assert [r[4] for r in rows].index(True) == 17
    s = Session()
    fold_all([frame(0, "x", False, "KA", 0.8), frame(1, "x", False, "LA", 0.9), {**frame(2, "x"), "mrz_found": False}], s)
    assert s.fused() == ["LA"] and not s.stable


def numbered(n, number, valid=False, text=None, **more):
    return {**frame(n, number, valid, text), "number_valid": True, "issuer": "UTO", "number": number, **more}


def test_frames_of_another_number_do_not_vote():
    s = Session()
    fold_all([numbered(0, "A", True), numbered(1, "A", True)], s)
    assert s.stable
    s.fold(numbered(2, "B", text="BBBB", confidence=0.99))
    assert not s.stable and [lines for lines, _, _ in s.ledger.entries["1x4"]] == [["AAAA"]] * 2 and s.fused() == ["AAAA"]
    for k, differs in enumerate(({"issuer": "D<<"}, {"doc_type": "MrvA"})):
        s.fold(numbered(3 + k, "A", **differs))
        assert len(s.ledger.entries["1x4"]) == 2
    s.fold(numbered(5, "B", text="BBBB", number_valid=False))
    assert len(s.ledger.entries["1x4"]) == 3


def test_first_valid_frame_drops_votes_of_another_number():
    s = Session()
    fold_all([numbered(0, "B", text="BBBB"), numbered(1, "A", True), numbered(2, "A", True)], s)
    assert s.stable and s.fused() == ["AAAA"]


def test_ragged_frames_do_not_vote():
    s = Session()
    fold_all([frame(0, "A"), frame(1, "A")], s)
    s.fold({**frame(2, "A", False), "lines": ["AAAA", "AAA"]})
    assert not s.stable and len(s.ledger.entries) == 1


def test_sessions_survive_a_restart_and_reset():
    frames = [numbered(k, "AB"[k // 3 % 2], k % 4 != 3) for k in range(14)]
    whole, cut = Session(), Session()
    for f in frames:
        whole.fold(f)
        cut = Session.restored(cut.state())
        cut.fold(f)
        assert whole.row("s", f["frame_no"]) == cut.row("s", f["frame_no"])
    whole.reset()
    assert whole.state() == Session().state()
    with pytest.raises(ValueError):
        Session(0)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [{"session_id": f"s{k % 3}", **{n: v for n, v in numbered(k, "AB"[k // 9 % 2], k % 5 != 4).items() if n != "session_id"}} for k in range(36)]
    want = sorted(r for k in range(3) for r in fold_all([r for r in rows if r["session_id"] == f"s{k}"], Session()))
    given = spark.createDataFrame([tuple(r[c.split()[0]] for c in FRAME.split(", ")) for r in rows], FRAME)
    key = lambda got: sorted((tuple(r[:5]) + (list(r[5]) if r[5] is not None else None, r[6]) for r in got), key=lambda r: r[:2])
    assert key(fold_batch(given).collect()) == want
    given.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = fold_stream(spark.readStream.schema(given.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/at").trigger(once=True).start()
    query.awaitTermination()
    assert key(spark.table("folded").collect()) == want
