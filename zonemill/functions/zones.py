"""Zones of a whole Arrow batch as typed records, on numpy arrays and Arrow's string kernels.

The zones of one layout are a matrix of characters: check digits are weighted
sums of its columns and character classes one lookup.  Row by row go only
numbers that continue in the optional data, and the messages of issues.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from itertools import cycle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..formats import CODE_FIRST, COMPOSITE, FIELDS, LINE_COUNT, LINE_LENGTH, ORDER, TYPES, VALUES, field_class

#: Fields of the raw record and their columns.
RAW = {
    "DocumentCode": "document_code", "IssuingCountry": "issuing_country", "Name": "name", "DocumentNumber": "document_number", "Nationality": "nationality",
    "BirthDate": "birth_date", "Sex": "sex", "ExpiryDate": "expiry_date", "OptionalData1": "optional_data1", "OptionalData2": "optional_data2",
}
CHECKS = ("document_number", "birth_date", "expiry_date", "optional_data", "composite")
#: Issue kinds that make a record invalid.
ERRORS = ("NotFound", "BadFormat", "CheckDigitFailed", "InvalidValue")
NOT_FOUND = "The text does not match any ICAO 9303 MRZ format."
#: Sub-records of the result; ``is_valid`` comes with checks and issues.
PARTS = ("document", "raw", "checks", "issues")

_DATE = [("y", pa.int32()), ("m", pa.int32()), ("d", pa.int32()), ("iso", pa.string()), ("date", pa.date32())]
_DOCUMENT = ("type", "document_code", "issuing_country", "nationality", "document_number", "primary_identifier", "secondary_identifier", "sex", "birth_date", "expiry_date", "optional_data1", "optional_data2")
_ISSUE = pa.struct([(n, pa.string()) for n in ("field", "kind", "message")])
_DDL_DATE = "struct<y:int,m:int,d:int,iso:string,date:date>"
_DDL = {
    "is_valid": "boolean",
    "document": f"struct<{','.join(f'{n}:{_DDL_DATE if n.endswith("_date") else "string"}' for n in _DOCUMENT)}>",
    "raw": f"struct<lines:array<string>,{','.join(f'{n}:string' for n in RAW.values())}>",
    "checks": f"struct<{','.join(f'{n}:string' for n in CHECKS)},all_valid:boolean>",
    "issues": "array<struct<field:string,kind:string,message:string>>",
}

_FILLER = ord("<")
#: What ends of lines are trimmed of: separators, line breaks and tabs.
_SPACE = "\t\n\x0b\f\r\x85" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp"))
_CHARS = {"Any": VALUES + "<", "Alpha": VALUES[10:] + "<", "Digit": VALUES[:10], "DigitOrFiller": VALUES[:10] + "<", "SexChar": "MFX<"}
_FITS = {name: np.isin(np.arange(128), [ord(c) for c in chars]) for name, chars in _CHARS.items()}
_VALUE = {"<": 0, **{c: v for v, c in enumerate(VALUES)}}
_VALUES = np.full(128, -1, np.int16)
_VALUES[[ord(c) for c in _VALUE]] = list(_VALUE.values())
_WEIGHTS = np.resize(np.array([7, 3, 1], np.int16), 128)
_STATUS = pa.array(["Valid", "Invalid", "NotPresent"])
_VALID, _INVALID, _ABSENT = range(3)
_SEXES = pa.array(["Male", "Female", "Unspecified"])
_NO_CONTINUATION = "Extended document number marker found but no continuation and check digit in optional data."
_DAYS = np.array([31, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_YEARS = pa.array(["????", *map(str, range(1900, 2100))])
_TWO = pa.array(["??", *(f"{i:02d}" for i in range(1, 32))])


def schema(parts: Iterable[str]) -> str:
    """DDL of the record with these sub-records."""
    wanted = [*(["is_valid"] if "issues" in parts else []), *(p for p in PARTS if p in parts)]
    inner = [f"{n}:{_DDL[n]}" for n in wanted]
    return f"struct<{','.join(['mrz_found:boolean', *inner, 'confidence:double', 'correction_count:int'])}>"


def digit_of(text: str) -> int:
    """Check digit of a text, -1 if it has a character outside the alphabet."""
    try:
        return sum(_VALUE[c] * w for c, w in zip(text, cycle((7, 3, 1)))) % 10
    except KeyError:
        return -1


def _take(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at))


def _trim(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, characters="<")


def _ints(values: np.ndarray, known: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), kind or pa.int32(), mask=~known)


class _Issues:
    """Issues of the batch's rows; those of a row come in the order in which they were added."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.parts: tuple[list[str], list[str], list[str]] = ([], [], [])

    def add(self, rows: np.ndarray, field: str | Sequence[str], kind: str, texts: str | Sequence[str]) -> None:
        if len(rows):
            self.rows.append(rows)
            for held, x in zip(self.parts, (field, kind, texts)):
                held.extend([x] * len(rows) if isinstance(x, str) else x)

    def arrays(self, n: int) -> tuple[pa.Array, np.ndarray]:
        """(list of issues of each row, whether one of them makes it invalid)."""
        rows = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
        field, kind, text = (pa.array(x, pa.string()) for x in self.parts)
        bad = np.zeros(n, bool)
        bad[rows[np.array([k in ERRORS for k in self.parts[1]], bool)]] = True
        values = pa.StructArray.from_arrays([_take(x, order) for x in (field, kind, text)], fields=list(_ISSUE))
        return pa.ListArray.from_arrays(pa.array(offsets), values), bad


class _Given:
    """Trimmed, upper-cased lines without blank ones, and the layout that each row's lines have (0: none)."""

    def __init__(self, source: pa.Array) -> None:
        lists = pc.split_pattern(source, "\n") if pa.types.is_string(source.type) or pa.types.is_large_string(source.type) else source
        n = len(lists)
        flat = pc.fill_null(pc.ascii_upper(pc.utf8_trim(lists.flatten().cast(pa.string()), characters=_SPACE)), "")
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        length = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
        some = length > 0
        self.lines, self.row, self.length = flat.filter(pa.array(some)), row[some], length[some].astype(np.int64)
        self.count = np.bincount(self.row, minlength=n)
        self.start = np.cumsum(self.count) - self.count
        self.expected = self._expected()
        near = np.abs(self.length - self.expected[self.row]) <= 2
        fits = (self.expected > 0) & (self.count == np.where(self.expected == 30, 3, 2)) & (np.bincount(self.row[~near], minlength=n) == 0)
        self.kind = np.zeros(n, np.int64)
        rows = np.flatnonzero(fits)
        visa = pc.starts_with(_take(self.lines, self.start[rows]), "V").to_numpy(zero_copy_only=False).astype(bool)
        self.kind[rows] = np.select([self.expected[rows] == 30, self.expected[rows] == 36], [1, np.where(visa, 5, 2)], np.where(visa, 4, 3))

    def _expected(self) -> np.ndarray:
        """30, 36 or 44 by the most lines of that length, the smaller in a tie; else what is within 2 of line 1; else 0."""
        n = len(self.count)
        votes = [np.bincount(self.row[self.length == size], minlength=n) for size in (30, 36, 44)]
        first = np.zeros(n, np.int64)
        some = self.count > 0
        first[some] = self.length[self.start[some]]
        near = np.select([np.abs(first - size) <= 2 for size in (30, 36, 44)], (30, 36, 44), 0)
        a, b, c = votes
        return np.select([(a > 0) & (a >= b) & (a >= c), (b > 0) & (b >= c), c > 0], (30, 36, 44), near)


class _Layout:
    """The zones of one layout: their lines at full length, and their characters as a matrix (non-ASCII ones as ``?``)."""

    def __init__(self, given: _Given, kind: int, rows: np.ndarray) -> None:
        self.kind, self.type, self.rows = kind, TYPES[kind - 1], rows
        self.width = LINE_LENGTH[self.type]
        count = LINE_COUNT[self.type]
        at = [given.start[rows] + i for i in range(count)]
        self.lines = [pc.utf8_slice_codeunits(pc.utf8_rpad(_take(given.lines, a), width=self.width, padding="<"), 0, self.width) for a in at]
        self.zone = pc.binary_join_element_wise(*self.lines, "")
        plain = self.zone if pc.all(pc.string_is_ascii(self.zone)).as_py() else pc.replace_substring_regex(self.zone, r"[^\x00-\x7f]", "?")
        ends = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1]
        self.chars = np.frombuffer(plain.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(rows), count * self.width)
        self.values = _VALUES[self.chars]

    def span(self, field: str) -> range | None:
        at = FIELDS[field][1][self.kind - 1]
        return at and range(at[0] * self.width + at[1], at[0] * self.width + at[1] + at[2])

    def text(self, field: str) -> pa.Array:
        at = self.span(field)
        return pc.utf8_slice_codeunits(self.zone, at.start, at.stop) if at else pa.array([""] * len(self.rows))

    def char(self, field: str) -> np.ndarray:
        return self.chars[:, self.span(field).start]

    def protected(self) -> list[int]:
        """Columns that the composite check protects."""
        return [line * self.width + i for line, start, size in COMPOSITE[self.type] for i in range(start, start + size)]


class _Check:
    """Status of one check digit over the columns it protects, and the messages of the rows where it fails."""

    def __init__(self, zones: _Layout, check: str, protected: Sequence[int] | None, may_be_empty: bool = False) -> None:
        n = len(zones.rows)
        self.failed: dict[int, str] = {}
        if zones.span(check) is None:
            self.status = np.full(n, _ABSENT, np.int8)
            return
        values = zones.values[:, protected]
        digit = np.where((values < 0).any(axis=1), -1, (values * _WEIGHTS[: len(protected)]).sum(axis=1) % 10)
        char = zones.char(check)
        filler = char == _FILLER
        empty = (zones.chars[:, protected] == _FILLER).all(axis=1) if may_be_empty and filler.any() else np.zeros(n, bool)
        self.status = np.where(filler & empty, _ABSENT, np.where(char == digit + ord("0"), _VALID, _INVALID)).astype(np.int8)
        self.status[digit < 0] = np.where(self.status[digit < 0] == _ABSENT, _ABSENT, _INVALID)
        self.zones, self.check, self.digit, self.char_codes = zones, check, digit, char

    def message(self, i: int) -> str:
        if i in self.failed:
            return self.failed[i]
        at = self.zones.span(self.check).start
        char = self.zones.zone[i].as_py()[at]
        if char == "<":
            return "Check digit position contains a filler but the protected field is not empty."
        if not "0" <= char <= "9":
            return f"Check digit position contains '{char}', expected a digit."
        if self.digit[i] < 0:
            return "The protected characters contain a character outside the MRZ alphabet."
        return f"Check digit is {char}, computed {self.digit[i]}."


class _Dates:
    """Years, months and days of a six-character date, with masks of what is known."""

    def __init__(self, zones: _Layout, field: str, expiry: bool, reference: tuple[np.ndarray, ...]) -> None:
        c = zones.chars[:, zones.span(field)].astype(np.int32)
        ten, one = c[:, ::2], c[:, 1::2]
        digits = (ten >= 48) & (ten <= 57) & (one >= 48) & (one <= 57)
        two = np.where(digits, (ten - 48) * 10 + one - 48, 0)
        self.mixed = (~digits & ~((ten == _FILLER) & (one == _FILLER))).any(axis=1)
        yy, self.mm, self.dd = two.T
        self.has_y = digits[:, 0]
        self.has_m, self.has_d = digits[:, 1] & (self.mm >= 1) & (self.mm <= 12), digits[:, 2] & (self.dd >= 1) & (self.dd <= 31)
        self.bad_month, self.bad_day = digits[:, 1] & ~self.has_m, digits[:, 2] & ~self.has_d
        m, d = np.where(self.has_m, self.mm, 0), np.where(self.has_d, self.dd, 0)
        if expiry:
            y = np.where(yy >= 90, yy + 1900, yy + 2000)
        else:
            known, ry, rm, rd = (x[zones.rows] for x in reference)
            later_in_year = self.has_m & ((m > rm) | ((m == rm) & self.has_d & (d > rd)))
            y = np.where(known & ((yy + 2000 > ry) | ((yy + 2000 == ry) & later_in_year)), yy + 1900, yy + 2000)
        self.y, self.m, self.d = np.where(self.has_y, y, 1899), m, d
        whole = self.has_y & self.has_m & self.has_d
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        self.real = whole & (d <= _DAYS[m] + ((m == 2) & leap))
        self.impossible = whole & ~self.real
        self.empty = ~(self.has_y | self.has_m | self.has_d)

    def array(self) -> pa.Array:
        iso = pc.binary_join_element_wise(_take(_YEARS, self.y - 1899), _take(_TWO, self.m), _take(_TWO, self.d), "-")
        months = np.where(self.real, (self.y - 1970) * 12 + self.m - 1, 0).astype("datetime64[M]")
        days = months.astype("datetime64[D]").astype(np.int64) + self.d - 1
        date = _ints(days, self.real).cast(pa.date32())
        return pa.StructArray.from_arrays([_ints(self.y, self.has_y), _ints(self.m, self.has_m), _ints(self.d, self.has_d), iso, date], fields=[pa.field(*f) for f in _DATE])

    def issues(self, zones: _Layout, field: str, issues: _Issues) -> None:
        rows = zones.rows
        mixed = np.flatnonzero(self.mixed)
        texts = _take(zones.text(field), mixed).to_pylist() if len(mixed) else []
        issues.add(rows[mixed], field, "InvalidValue", [f"Date field '{t}' mixes digits and fillers within a component." for t in texts])
        issues.add(rows[self.bad_month], field, "InvalidValue", [f"Month {m} is out of range." for m in self.mm[self.bad_month]])
        issues.add(rows[self.bad_day], field, "InvalidValue", [f"Day {d} is out of range." for d in self.dd[self.bad_day]])
        wrong = self.impossible
        issues.add(rows[wrong], field, "InvalidValue", [f"Day {d} does not exist in {y}-{m:02d}." for d, y, m in zip(self.d[wrong], self.y[wrong], self.m[wrong])])


def _extended(zones: _Layout, check: _Check) -> tuple[dict[int, str], dict[int, str]]:
    """Numbers that go on in the optional data, and the rest of that, by place in ``zones``; their status goes to ``check``."""
    numbers, rest = {}, {}
    if zones.kind not in (1, 2):
        return numbers, rest
    number, optional = zones.span("DocumentNumber"), zones.span("OptionalData1")
    at = np.flatnonzero(zones.char("DocumentNumberCheck") == _FILLER)
    for i, zone in zip(at.tolist(), _take(zones.zone, at).to_pylist()):
        own, data = zone[number.start : number.stop], zone[optional.start : optional.stop]
        more, _, after = data.partition("<")
        status, text = _INVALID, ""
        if len(more) < 2:
            numbers[i], rest[i], text = own.strip("<"), data.strip("<"), _NO_CONTINUATION
        else:
            full, last = own + more[:-1], more[-1]
            numbers[i], rest[i], digit = full.strip("<"), after.strip("<"), digit_of(full)
            if not "0" <= last <= "9":
                text = f"Extended document number check digit is '{last}', expected a digit."
            elif str(digit) != last:
                text = f"Extended document number check digit is {last}, computed {digit}."
            else:
                status = _VALID
        check.status[i], check.failed[i] = status, text
    return numbers, rest


def _replaced(values: pa.Array, by: dict[int, str]) -> pa.Array:
    if not by:
        return values
    mask = np.zeros(len(values), bool)
    mask[list(by)] = True
    return pc.replace_with_mask(values, pa.array(mask), pa.array([by[i] for i in sorted(by)], pa.string()))


def _names(name: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(primary, secondary) identifier, split at the first double filler."""
    both = pc.split_pattern(name, "<<", max_splits=1)
    size = pc.list_value_length(both).to_numpy(zero_copy_only=False)
    values, at = both.flatten(), np.cumsum(size) - size
    spaced = lambda x: pc.replace_substring_regex(_trim(x), "<+", " ")
    values = pa.concat_arrays([spaced(values), pa.array([""])])
    return _take(values, at), _take(values, np.where(size == 2, at + 1, len(values) - 1))


def _class_issues(zones: _Layout, issues: _Issues) -> None:
    """An issue for each character outside the alphabet or its field's class, in the layout's field order."""
    spans = [(zones.span(field), field, field_class(zones.type, field)) for field in ORDER[zones.type]]
    bad = np.concatenate([~_FITS[name][zones.chars[:, at]] for at, _, name in spans], axis=1)
    column, of = np.concatenate([list(at) for at, _, _ in spans]), np.repeat(np.arange(len(spans)), [len(at) for at, _, _ in spans])
    row, at = np.nonzero(bad)
    if not len(row):
        return
    zone = dict(zip(row.tolist(), _take(zones.zone, row).to_pylist()))
    column, of = column[at], of[at]
    texts = []
    for i, j, k, place, outside in zip(row.tolist(), column.tolist(), of.tolist(), (column % zones.width + 1).tolist(), (zones.values[row, column] < 0).tolist()):
        texts.append(f"Character '{zone[i][j]}' at position {place} is outside the MRZ alphabet." if outside else f"Character '{zone[i][j]}' is not allowed at position {place} ({spans[k][2]}).")
    issues.add(zones.rows[row], [spans[k][1] for k in of.tolist()], "BadFormat", texts)


def _length_issues(given: _Given, issues: _Issues) -> None:
    row, expected = given.row, given.expected[given.row]
    off = np.flatnonzero((given.kind[row] > 0) & (given.length != expected))
    texts = [f"Line {n + 1} is {size} characters, {'padded' if size < e else 'truncated'} to the expected {e}." for n, size, e in zip(off - given.start[row[off]], given.length[off], expected[off])]
    issues.add(row[off], "", "BadFormat", texts)


def _where(issues: _Issues, zones: _Layout, wrong: np.ndarray | pa.Array, field: str, kind: str, text: str | Callable[..., str], *values: pa.Array) -> None:
    """The same issue at each place where ``wrong`` is true, with a text made of ``values`` there."""
    at = np.flatnonzero(wrong.to_numpy(zero_copy_only=False) if isinstance(wrong, pa.Array) else wrong)
    if len(at):
        issues.add(zones.rows[at], field, kind, text if isinstance(text, str) else list(map(text, *(_take(v, at).to_pylist() for v in values))))


def _layout_columns(zones: _Layout, parts: Sequence[str], codes: pa.Array, reference: tuple[np.ndarray, ...], issues: _Issues) -> dict[str, pa.Array]:
    """Columns of one layout's records; their issues go to ``issues``."""
    full, rows = "issues" in parts, zones.rows
    out: dict[str, pa.Array] = {}
    cell = {name: zones.text(name) for name in RAW}
    number = _Check(zones, "DocumentNumberCheck", zones.span("DocumentNumber")) if full or "checks" in parts or "document" in parts else None
    numbers, rest = _extended(zones, number) if number else ({}, {})
    if full or "checks" in parts:
        checks = {
            "DocumentNumber": number, "BirthDate": _Check(zones, "BirthDateCheck", zones.span("BirthDate")), "ExpiryDate": _Check(zones, "ExpiryDateCheck", zones.span("ExpiryDate")),
            "OptionalData": _Check(zones, "OptionalDataCheck", zones.span("OptionalData1"), True), "Composite": _Check(zones, "CompositeCheck", zones.protected()),
        }
        for name, check in zip(CHECKS, checks.values()):
            out[f"checks.{name}"] = _take(_STATUS, check.status)
        out["checks.all_valid"] = pa.array(~np.any([c.status == _INVALID for c in checks.values()], axis=0))
    if full or "document" in parts:
        birth, expiry = _Dates(zones, "BirthDate", False, reference), _Dates(zones, "ExpiryDate", True, reference)
        primary, secondary = _names(cell["Name"])
        code, of_number = _trim(cell["DocumentCode"]), _replaced(_trim(cell["DocumentNumber"]), numbers)
    if "document" in parts:
        sex = zones.char("Sex")
        document = (
            pa.array([zones.type] * len(rows)), code, _trim(cell["IssuingCountry"]), _trim(cell["Nationality"]), of_number, primary, secondary,
            _take(_SEXES, np.select([sex == ord("M"), sex == ord("F")], [0, 1], 2)), birth.array(), expiry.array(), _replaced(_trim(cell["OptionalData1"]), rest), _trim(cell["OptionalData2"]),
        )
        out |= {f"document.{n}": v for n, v in zip(_DOCUMENT, document)}
    if "raw" in parts:
        k, n = len(zones.lines), len(rows)
        lines = _take(pa.concat_arrays(zones.lines), np.arange(k * n).reshape(k, n).T.ravel())
        out["raw.lines"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), lines)
        out |= {f"raw.{column}": cell[name] for name, column in RAW.items()}
    if full:
        for name in ("IssuingCountry", "Nationality"):
            unknown = ~pc.is_in(cell[name], value_set=codes).to_numpy(zero_copy_only=False) & (zones.chars[:, zones.span(name)] != _FILLER).any(axis=1)
            _where(issues, zones, unknown, name, "UnknownValue", lambda c: f"Code '{c}' is not a known ICAO issuing state or nationality code.", cell[name])
        _class_issues(zones, issues)
        for name, check in checks.items():
            failed = np.flatnonzero(check.status == _INVALID)
            issues.add(rows[failed], name, "CheckDigitFailed", [check.message(i) for i in failed])
        birth.issues(zones, "BirthDate", issues)
        expiry.issues(zones, "ExpiryDate", issues)
        _where(issues, zones, ~np.isin(zones.char("Sex"), [ord(c) for c in "MF<"]), "Sex", "InvalidValue", lambda c: f"Unexpected sex character '{c}'.", cell["Sex"])
        first = pc.utf8_slice_codeunits(code, 0, 1)
        wrong = pc.invert(pc.is_in(first, value_set=pa.array(list(CODE_FIRST[zones.type]))))
        _where(issues, zones, wrong, "DocumentCode", "InvalidValue", lambda c: f"Document code '{c}' is not valid for {zones.type}.", code)
        _where(issues, zones, pc.equal(of_number, ""), "DocumentNumber", "InvalidValue", "Document number is empty.")
        _where(issues, zones, pc.equal(primary, ""), "Name", "InvalidValue", "Name is empty.")
        _where(issues, zones, expiry.empty, "ExpiryDate", "InvalidValue", "Expiry date is missing.")
    return out


def records(source: pa.Array, reference: pa.Array, parts: Sequence[str], codes: Sequence[str]) -> pa.Array:
    """The record of each text (or list of lines) of ``source``, as ``schema(parts)``; dates are read against ``reference``."""
    n, full = len(source), "issues" in parts
    given, issues, known = _Given(source), _Issues(), pa.array(codes)
    days = pc.fill_null(reference.cast(pa.int32()), 0).to_numpy(zero_copy_only=False).astype("datetime64[D]")
    months = days.astype("datetime64[M]")
    ref = (
        pc.is_valid(reference).to_numpy(zero_copy_only=False), months.astype("datetime64[Y]").astype(np.int64) + 1970,
        months.astype(np.int64) % 12 + 1, (days - months.astype("datetime64[D]")).astype(np.int64) + 1,
    )
    if full:
        _length_issues(given, issues)
    groups = [rows for k in range(1, len(TYPES) + 1) for rows in [np.flatnonzero(given.kind == k)] if len(rows)]
    made = [_layout_columns(_Layout(given, int(given.kind[rows[0]]), rows), parts, known, ref, issues) for rows in groups]
    found = given.kind > 0
    none = np.flatnonzero(~found)
    place = np.empty(n, np.int64)
    place[np.concatenate([*groups, none])] = np.arange(n)
    issues.add(none, "", "NotFound", NOT_FOUND)

    def column(name: str, kind: pa.DataType) -> pa.Array:
        return _take(pa.concat_arrays([*(m[name] for m in made), pa.nulls(len(none), kind)]), place)

    def struct(part: str, fields: dict[str, pa.DataType]) -> pa.Array:
        return pa.StructArray.from_arrays([column(f"{part}.{f}", t) for f, t in fields.items()], fields=[pa.field(f, t) for f, t in fields.items()], mask=pa.array(~found))

    text = pa.string()
    out: dict[str, pa.Array] = {"mrz_found": pa.array(found)}
    if full:
        listed, bad = issues.arrays(n)
        out["is_valid"] = pa.array(found & ~bad & pc.fill_null(column("checks.all_valid", pa.bool_()), False).to_numpy(zero_copy_only=False))
    if "document" in parts:
        out["document"] = struct("document", {f: pa.struct(_DATE) if f.endswith("_date") else text for f in _DOCUMENT})
    if "raw" in parts:
        out["raw"] = struct("raw", {"lines": pa.list_(text), **{f: text for f in RAW.values()}})
    if "checks" in parts:
        out["checks"] = struct("checks", {**{f: text for f in CHECKS}, "all_valid": pa.bool_()})
    if full:
        out["issues"] = listed
    out["confidence"] = pa.array(found.astype(np.float64))
    out["correction_count"] = pa.array(np.zeros(n, np.int32))
    return pa.StructArray.from_arrays(list(out.values()), names=list(out))
