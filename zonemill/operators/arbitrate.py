"""Checksum-guided correction of recognised characters, as a pure function of cells.

A cell is its ranked candidates (character, score).  For one check digit, the
least certain protected cells may change within their candidates so that the
weighted sum fits; the change of highest total score wins, the first found in a
tie.  The search is exhaustive: a branch ends only where the best scores that can
still complete its sum modulo 10 fall behind, or where a date is not plausible.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..formats import VALUES

#: Cells that may change, candidates of each, and how far under the best a candidate may score.
MOST_CELLS, MOST_CANDIDATES, REACH = 8, 4, 0.35
#: Candidates of a cell in a date, where only digits that can stand at its place count.
MOST_DIGITS = 6
ALLOWED = {
    "Any": set(VALUES) | {"<"},
    "Alpha": set(VALUES[10:]) | {"<"},
    "Digit": set(VALUES[:10]),
    "DigitOrFiller": set(VALUES[:10]) | {"<"},
    "SexChar": {"M", "F", "<"},
}


@dataclass(frozen=True)
class Cell:
    """Candidates best first; ``kind`` is the character class of its position."""

    candidates: tuple[tuple[str, float], ...]
    kind: str = "Any"
    chosen: str = ""

    @property
    def char(self) -> str:
        return self.chosen or self.candidates[0][0]

    @property
    def score(self) -> float:
        return dict(self.candidates).get(self.char, 0.0)


def value(c: str) -> int:
    return 0 if c == "<" else VALUES.find(c)


def snap(cell: Cell) -> Cell:
    """The first candidate that its class allows; a decisive X in the sex field stays."""
    if cell.kind == "SexChar" and cell.candidates[0][0] == "X":
        second = cell.candidates[1][1] if len(cell.candidates) > 1 else 0.0
        if cell.candidates[0][1] >= 0.90 and cell.candidates[0][1] - second >= 0.15:
            return cell
    for char, _ in cell.candidates:
        if char in ALLOWED[cell.kind]:
            return Cell(cell.candidates, cell.kind, char)
    return cell


def options(cell: Cell) -> list[tuple[str, float]]:
    top = cell.candidates[0][1]
    out = [(c, s) for c, s in cell.candidates if c in ALLOWED[cell.kind] and s >= top - REACH][:MOST_CANDIDATES]
    return out or [(cell.char, cell.score)]


def structural(cell: Cell, offset: int) -> list[tuple[str, float]]:
    """Of a cell at ``offset`` of a date: its digits that can stand there, best first, within reach or not; its options if it has none."""
    legal = {2: "01", 4: "0123"}.get(offset, "0123456789")
    digits = [(c, s) for c, s in cell.candidates if c in legal and s >= 0]
    return sorted(digits, key=lambda x: -x[1])[:MOST_DIGITS] or options(cell)


def plausible_date(text: str) -> bool:
    """Six characters that can be a date: filler pairs are unknown, an unknown year counts as a leap year."""
    pairs = [text[i : i + 2] for i in (0, 2, 4)]
    if any(p != "<<" and not (p.isascii() and p.isdigit()) for p in pairs):
        return False
    yy, mm, dd = (None if p == "<<" else int(p) for p in pairs)
    if mm is not None and not 1 <= mm <= 12 or dd is not None and not 1 <= dd <= 31:
        return False
    if mm is None or dd is None:
        return True
    leap = yy is None or yy % 4 == 0
    return dd <= (29 if leap else 28) if mm == 2 else dd <= (30 if mm in (4, 6, 9, 11) else 31)


def is_satisfied(protected: list[Cell], check: Cell, filler_allowed: bool = False) -> bool:
    values = [value(c.char) for c in protected]
    if min(values, default=0) < 0:
        return False
    if check.char == "<":
        return filler_allowed and all(c.char == "<" for c in protected)
    return check.char.isdigit() and sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(values)) % 10 == int(check.char)


def satisfy(protected: list[Cell], check: Cell, filler_allowed: bool = False, fixed: frozenset[int] = frozenset(), dates: tuple[tuple[int, int], ...] = ()) -> tuple[list[Cell], Cell] | None:
    """Cells and check cell that fit, or None.

    ``fixed`` are indices that may not change (``len(protected)`` is the check
    cell); ``dates`` are spans that must stay plausible.
    """
    cells = [*protected, check]
    good = lambda cs: all(plausible_date("".join(c.char for c in cs[a:b])) for a, b in dates)
    if is_satisfied(protected, check, filler_allowed) and good(cells):
        return protected, check
    free = sorted((i for i in range(len(cells)) if i not in fixed), key=lambda i: (cells[i].score, i))[:MOST_CELLS]
    base, filled = 0, True
    for i, c in enumerate(protected):
        if i not in free:
            if value(c.char) < 0:
                return None
            base += value(c.char) * (7, 3, 1)[i % 3]
            filled = filled and c.char == "<"
    at_check = len(protected)
    choices = [structural(cells[i], offset) if (offset := next((i - a for a, b in dates if a <= i < b), None)) is not None else options(cells[i]) for i in free]
    choices = [[(c, s) for c, s in o if i == at_check or value(c) >= 0] for i, o in zip(free, choices)]
    # Dates to test once the last of their searched cells is chosen.
    due = [[(a, b) for a, b in dates if a <= i < b and not any(a <= j < b for j in free[d + 1 :])] for d, i in enumerate(free)]
    if any(not plausible_date("".join(c.char for c in cells[a:b])) for a, b in dates if not any(a <= j < b for j in free)):
        return None
    # rest[d][r]: the most that cells from d on can add if they make the weighted sum less the check digit r modulo 10.
    lowest = float("-inf")
    rest = [[lowest] * 10 for _ in free] + [[0.0] + [lowest] * 9]
    any_rest = [0.0] * (len(free) + 1)
    step = lambda i, c: -value(c) if i == at_check else value(c) * (7, 3, 1)[i % 3]
    for d in range(len(free) - 1, -1, -1):
        any_rest[d] = any_rest[d + 1] + max((s for _, s in choices[d]), default=lowest)
        for r in range(10):
            rest[d][r] = max((s + rest[d + 1][(r - step(free[d], c)) % 10] for c, s in choices[d] if free[d] != at_check or c.isdigit()), default=lowest)
    best: tuple[float, list[str]] | None = None
    now = [c.char for c in cells]

    def search(d: int, score: float, total: int, fillers: bool) -> None:
        nonlocal best
        # A filler check asks for no sum; while one is possible the bound is the sum of the best scores.
        open_filler = filler_allowed and fillers and (now[at_check] == "<" or at_check in free[d:])
        bound = score + (any_rest[d] if open_filler else rest[d][-total % 10])
        if bound == lowest or best is not None and bound < best[0] - 1e-7:
            return
        if d == len(free):
            fits = fillers and filler_allowed if now[at_check] == "<" else now[at_check].isdigit() and total % 10 == 0
            if fits and (best is None or score > best[0]):
                best = score, list(now)
            return
        i = free[d]
        was = now[i]
        for char, s in choices[d]:
            now[i] = char
            if all(plausible_date("".join(now[a:b])) for a, b in due[d]):
                search(d + 1, score + s, total + step(i, char), fillers and (i == at_check or char == "<"))
        now[i] = was

    search(0, 0.0, base if at_check in free or not check.char.isdigit() else base - int(check.char), filled)
    if best is None:
        return None
    made = [Cell(c.candidates, c.kind, best[1][i]) if i in free else c for i, c in enumerate(cells)]
    return made[:-1], made[-1]
