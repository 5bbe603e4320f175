"""Column functions for machine-readable zones: no Python on the executors, every branch total under ANSI."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats import COMPOSITE, FIELDS, LINE_COUNT, LINE_LENGTH, ORDER, TYPES, VALUES, field_class

FILLER = "<"
_ALPHABET = "^[0-9A-Z<]*$"
#: Character classes as patterns of one character that fits.
CLASS = {"Any": "[0-9A-Z<]", "Alpha": "[A-Z<]", "Digit": "[0-9]", "DigitOrFiller": "[0-9<]", "SexChar": "[MFX<]"}
_SPACE = r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ISSUE = "struct<field:string,kind:string,message:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def char_value(c: Column) -> Column:
    """Check value of one character, -1 outside the alphabet."""
    return F.when(c == FILLER, 0).when(F.length(c) != 1, -1).otherwise(F.instr(F.lit(VALUES), c) - 1)


def _weighted(text: Column, k: int, weight: int) -> Column:
    """Characters k, k + 3, k + 6, ... (from 0), each as the last digit of its value times ``weight``."""
    digits = "".join(str(v * weight % 10) for v in range(len(VALUES)))
    return F.translate(F.regexp_replace(F.substring(text, k + 1, MOST), "(.).?.?", "$1"), VALUES + FILLER, digits + "0")


#: More characters than any protected text has.
MOST = 1_000_000


def check_digit(text: Column) -> Column:
    """Check digit of a text (0 if empty), -1 if it has a character outside the alphabet.

    Weights 7, 3, 1 repeat, so the characters are sorted by their weight, written as digits
    mod 10, and summed by counting each digit: no step goes character by character.
    """
    total = lambda s: sum(d * (F.length(s) - F.length(F.replace(s, F.lit(str(d)), F.lit("")))) for d in range(1, 10))
    digits = F.concat(*(_weighted(text, k, w) for k, w in enumerate((7, 3, 1))))
    return F.when(~text.rlike(_ALPHABET), -1).otherwise(let(digits, total) % 10)


def check_digit_of(segments: Iterable[Column]) -> Column:
    """Check digit over segments, weights running on across them."""
    return check_digit(F.concat(*segments))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def upper_ascii(text: Column) -> Column:
    return F.translate(text, _LOWER, _UPPER)


def clean_lines(lines: Column) -> Column:
    """Trimmed, upper-cased lines without blank ones."""
    return F.filter(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: upper_ascii(trim_space(x))), lambda x: x != "")


def split_lines(text: Column) -> Column:
    return clean_lines(F.split(text, "\n"))


def expected_length(lines: Column) -> Column:
    """30, 36 or 44 by the most lines of that length, the smaller in a tie; else what is within 2 of line 1; else 0."""
    votes = {n: F.size(F.filter(lines, _has_length(n))) for n in (30, 36, 44)}
    first = F.length(F.get(lines, F.lit(0)))
    near = F.coalesce(*(F.when(F.abs(first - n) <= 2, n) for n in (30, 36, 44)), F.lit(0))
    return (
        F.when((votes[30] > 0) & (votes[30] >= votes[36]) & (votes[30] >= votes[44]), 30)
        .when((votes[36] > 0) & (votes[36] >= votes[44]), 36)
        .when(votes[44] > 0, 44)
        .otherwise(near)
    )


def _has_length(n: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x) == n


def fitted(lines: Column, expected: Column) -> Column:
    """Lines padded or cut to the expected length, or null if one is off by more than 2 or their number is wrong."""
    ok = (
        F.size(lines).isin(2, 3)
        & (expected > 0)
        & F.when(expected == 30, F.size(lines) == 3).otherwise(F.size(lines) == 2)
        & F.forall(lines, lambda x: F.abs(F.length(x) - expected) <= 2)
    )
    return F.when(ok, F.transform(lines, lambda x: F.rpad(x, expected, FILLER)))


def length_issues(lines: Column, expected: Column) -> Column:
    def issue(x: Column, i: Column) -> Column:
        what = F.when(F.length(x) < expected, F.lit("padded")).otherwise(F.lit("truncated"))
        text = F.format_string("Line %d is %d characters, %s to the expected %d.", i + 1, F.length(x), what, expected)
        return F.when(F.length(x) != expected, F.struct(F.lit("").alias("field"), F.lit("BadFormat").alias("kind"), text.alias("message")))

    return F.array_compact(F.transform(lines, issue))


def detect(lines: Column) -> Column:
    """Number of the layout in ``TYPES``, from 1; null if none."""
    n, first = F.size(lines), F.get(lines, F.lit(0))
    visa = F.substring(first, 1, 1) == "V"
    size = F.length(first)
    return (
        F.when((n == 3) & (size == 30), 1)
        .when((n == 2) & (size == 36), F.when(visa, 5).otherwise(2))
        .when((n == 2) & (size == 44), F.when(visa, 4).otherwise(3))
    )


def pick(kind: Column, values: Iterable) -> Column:
    """The value at the layout's number."""
    return F.element_at(F.array(*map(F.lit, values)), kind)


def trim_fillers(text: Column) -> Column:
    return F.btrim(text, F.lit(FILLER))


def fillers_to_spaces(text: Column) -> Column:
    return F.regexp_replace(trim_fillers(text), "<+", " ")


def name_parts(name: Column) -> tuple[Column, Column]:
    """(primary, secondary) identifier, split at the first double filler."""
    at = F.instr(name, "<<")
    primary = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)
    secondary = F.when(at > 0, F.substring(name, at + 2, F.length(name))).otherwise(F.lit(""))
    return fillers_to_spaces(primary), fillers_to_spaces(secondary)


def sex_of(c: Column) -> Column:
    return F.when(c == "M", "Male").when(c == "F", "Female").otherwise("Unspecified")


def pair(text: Column, at: int) -> Column:
    """Two digits as an int, else null."""
    two = F.substring(text, at + 1, 2)
    return F.when(two.rlike("^[0-9]{2}$"), two.try_cast("int"))


def _is_mixed(text: Column, at: int) -> Column:
    two = F.substring(text, at + 1, 2)
    return ~two.rlike("^[0-9]{2}$") & (two != "<<")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def mrz_date(text: Column, expiry: bool, reference: Column) -> Column:
    """struct<y,m,d,iso,date,mixed,bad_month,bad_day,impossible> of a six-character date.

    Expiry years 90-99 are 19yy, others 20yy; births are the latest date not
    after ``reference``, an unknown month or day not counting as later.
    """
    yy, mm, dd = pair(text, 0), pair(text, 2), pair(text, 4)
    m = F.when(mm.between(1, 12), mm)
    d = F.when(dd.between(1, 31), dd)
    if expiry:
        y = F.when(yy >= 90, yy + 1900).otherwise(yy + 2000)
    else:
        later = (yy + 2000 > F.year(reference)) | (
            (yy + 2000 == F.year(reference))
            & F.coalesce((m > F.month(reference)) | ((m == F.month(reference)) & F.coalesce(d > F.dayofmonth(reference), F.lit(False))), F.lit(False))
        )
        y = F.when(later, yy + 1900).otherwise(yy + 2000)
    parts = F.struct(
        y.alias("y"),
        m.alias("m"),
        d.alias("d"),
        (_is_mixed(text, 0) | _is_mixed(text, 2) | _is_mixed(text, 4)).alias("mixed"),
        F.when(mm.isNotNull() & m.isNull(), mm).alias("bad_month"),
        F.when(dd.isNotNull() & d.isNull(), dd).alias("bad_day"),
    )
    two = lambda c: F.coalesce(F.lpad(c.cast("string"), 2, "0"), F.lit("??"))

    def done(p: Column) -> Column:
        whole = p["y"].isNotNull() & p["m"].isNotNull() & p["d"].isNotNull()
        possible = F.coalesce(p["d"] <= days_in_month(p["y"], p["m"]), F.lit(False))
        safe = F.when(whole & possible, F.concat_ws("-", F.lpad(p["y"].cast("string"), 4, "0"), two(p["m"]), two(p["d"])))
        return F.struct(
            p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"),
            F.concat_ws("-", F.coalesce(F.lpad(p["y"].cast("string"), 4, "0"), F.lit("????")), two(p["m"]), two(p["d"])).alias("iso"),
            safe.try_cast("date").alias("date"),
            p["mixed"].alias("mixed"), p["bad_month"].alias("bad_month"), p["bad_day"].alias("bad_day"),
            (whole & ~possible).alias("impossible"),
        )

    return let(parts, done)


def is_complete(date: Column) -> Column:
    return date["y"].isNotNull() & date["m"].isNotNull() & date["d"].isNotNull()


def is_empty(date: Column) -> Column:
    return date["y"].isNull() & date["m"].isNull() & date["d"].isNull()


def issue(when: Column, name: Column | str, kind: str, message: Column) -> Column:
    """An issue struct, or null."""
    named = name if isinstance(name, Column) else F.lit(name)
    return F.when(when, F.struct(named.alias("field"), F.lit(kind).alias("kind"), message.alias("message")))


#: Columns of ``cells`` beside the raw fields: check digits, what the composite check protects, and which checks the layout has.
CHECK_CELLS = {"DocumentNumberCheck": "number_check", "BirthDateCheck": "birth_check", "ExpiryDateCheck": "expiry_check", "OptionalDataCheck": "optional_check", "CompositeCheck": "composite_check"}


def cells(lines: str, kind: str, raw: dict[str, str]) -> Column:
    """struct of all fields of the columns ``lines`` and ``kind``: one branch for each layout, with its positions written out."""

    def cut(at: tuple[int, int, int] | None) -> str:
        return f"coalesce(substr(get({lines}, {at[0]}), {at[1] + 1}, {at[2]}), '')" if at else "''"

    def layout(i: int, t: str) -> str:
        parts = [f"'{column}', {cut(FIELDS[name][1][i])}" for name, column in {**raw, **CHECK_CELLS}.items()]
        protected = ", ".join(map(cut, COMPOSITE[t])) or "''"
        parts += [f"'protected', concat({protected})", f"'has_optional_check', {str(FIELDS['OptionalDataCheck'][1][i] is not None).lower()}", f"'has_composite_check', {str(FIELDS['CompositeCheck'][1][i] is not None).lower()}"]
        return f"WHEN {i + 1} THEN named_struct({', '.join(parts)})"

    return F.expr(f"CASE {kind} {' '.join(layout(i, t) for i, t in enumerate(TYPES))} END")


def _zone_pattern(i: int) -> str:
    """What the joined lines of layout ``i`` match if every character fits its field."""
    t, n = TYPES[i], LINE_LENGTH[TYPES[i]]
    at = ["."] * (n * LINE_COUNT[t])
    for name in ORDER[t]:
        line, start, length = FIELDS[name][1][i]
        at[line * n + start : line * n + start + length] = [CLASS[field_class(t, name)]] * length
    return "(?s)^" + "".join(c + (f"{{{len(list(g))}}}") for c, g in groupby(at)) + "$"


def class_issues(lines: str, kind: str) -> Column:
    """An issue for each character of the column ``lines`` outside the alphabet or its field's class, in the layout's field order.

    One pattern for each layout passes zones without such a character; only the others are taken apart.
    """
    fits = F.expr(f"CASE {kind} {' '.join(f'WHEN {i + 1} THEN z RLIKE {chr(39)}{_zone_pattern(i)}{chr(39)}' for i in range(len(TYPES)))} END".replace("z RLIKE", f"array_join({lines}, '') RLIKE"))
    table = [";".join(f"{name}:{field_class(t, name)}:{':'.join(map(str, FIELDS[name][1][i]))}" for name in ORDER[t]) for i, t in enumerate(TYPES)]
    one = F.create_map(*(F.lit(x) for k, v in CLASS.items() for x in (k, f"^{v}$")))

    def of_field(spec: Column) -> Column:
        def of_parts(f: Column) -> Column:
            start = f[3].cast("int")
            value = F.substring(F.get(F.col(lines), f[2].cast("int")), start + 1, f[4].cast("int"))

            def of_char(c: Column, i: Column) -> Column:
                outside = ~c.rlike("[0-9A-Z<]")
                at = start + i + 1
                return F.when(
                    outside | ~F.regexp(c, F.element_at(one, f[1])),
                    F.struct(
                        f[0].alias("field"),
                        F.lit("BadFormat").alias("kind"),
                        F.when(outside, F.format_string("Character '%s' at position %d is outside the MRZ alphabet.", c, at))
                        .otherwise(F.format_string("Character '%s' is not allowed at position %d (%s).", c, at, f[1]))
                        .alias("message"),
                    ),
                )

            return F.array_compact(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), of_char))

        return let(F.split(spec, ":"), of_parts)

    apart = F.flatten(F.transform(F.split(F.element_at(F.array(*map(F.lit, table)), F.col(kind)), ";"), of_field))
    return F.when(fits, F.array().cast(f"array<{ISSUE}>")).otherwise(apart)


def is_known(code: Column, codes: Iterable[str]) -> Column:
    """True if a code of three characters is one of ``codes``."""
    return F.instr(F.lit(f",{','.join(codes)},"), F.concat(F.lit(","), code, F.lit(","))) > 0


def verify(check: Column, protected: Column, filler_allowed: Column, present: Column) -> Column:
    """struct<status, message> of one check digit over the characters it protects."""
    out = lambda status, message: F.struct(F.lit(status).alias("status"), message.alias("message"))
    none = F.lit(None).cast("string")
    return let(
        check_digit(protected),
        lambda digit: F.when(~present, out("NotPresent", none))
        .when(
            check == FILLER,
            F.when(filler_allowed & protected.rlike("^<*$"), out("NotPresent", none)).otherwise(
                out("Invalid", F.lit("Check digit position contains a filler but the protected field is not empty."))
            ),
        )
        .when(~check.rlike("^[0-9]$"), out("Invalid", F.format_string("Check digit position contains '%s', expected a digit.", check)))
        .when(digit < 0, out("Invalid", F.lit("The protected characters contain a character outside the MRZ alphabet.")))
        .when(digit.cast("string") != check, out("Invalid", F.format_string("Check digit is %s, computed %d.", check, digit)))
        .otherwise(out("Valid", none)),
    )


def extended_number(number: Column, optional: Column) -> Column:
    """struct<number, optional, status, message> of a number that goes on in the optional data."""
    at = F.instr(optional, FILLER)
    length = F.when(at == 0, F.length(optional)).otherwise(at - 1)
    more = F.substring(optional, F.lit(1), length)
    rest = F.when(at > 0, F.substring(optional, at + 1, F.length(optional))).otherwise(F.lit(""))
    check = F.substring(more, length, F.lit(1))
    full = F.concat(number, F.substring(more, F.lit(1), F.greatest(length - 1, F.lit(0))))
    out = lambda n, o, s, m: F.struct(trim_fillers(n).alias("number"), trim_fillers(o).alias("optional"), F.lit(s).alias("status"), m.alias("message"))
    return let(
        check_digit(full),
        lambda digit: F.when(length < 2, out(number, optional, "Invalid", F.lit("Extended document number marker found but no continuation and check digit in optional data.")))
        .when(~check.rlike("^[0-9]$"), out(full, rest, "Invalid", F.format_string("Extended document number check digit is '%s', expected a digit.", check)))
        .when(digit.cast("string") != check, out(full, rest, "Invalid", F.format_string("Extended document number check digit is %s, computed %d.", check, digit)))
        .otherwise(out(full, rest, "Valid", F.lit(None).cast("string"))),
    )
