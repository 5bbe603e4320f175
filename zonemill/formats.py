"""The five layouts of ICAO 9303 machine-readable zones, as data.

Fixed values of the standard: field positions (line, start, length, character
class), check relations and special country codes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Alphabet of check values: 0-9 count 0-9, A-Z count 10-35; the filler counts 0.
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Order of glyphs where votes tie.
GLYPHS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"
#: Layouts in the order of their number, from 1.
TYPES = ("Td1", "Td2", "Td3", "MrvA", "MrvB")
LINE_COUNT = {"Td1": 3, "Td2": 2, "Td3": 2, "MrvA": 2, "MrvB": 2}
LINE_LENGTH = {"Td1": 30, "Td2": 36, "Td3": 44, "MrvA": 44, "MrvB": 36}
CODE_FIRST = {"Td1": "IAC", "Td2": "IAC", "Td3": "P", "MrvA": "V", "MrvB": "V"}

# Line, start and length of each field in each layout (None: absent), and its character class.
FIELDS: dict[str, tuple[str, tuple[tuple[int, int, int] | None, ...]]] = {
    "DocumentCode": ("Alpha", ((0, 0, 2), (0, 0, 2), (0, 0, 2), (0, 0, 2), (0, 0, 2))),
    "IssuingCountry": ("Alpha", ((0, 2, 3), (0, 2, 3), (0, 2, 3), (0, 2, 3), (0, 2, 3))),
    "Name": ("Alpha", ((2, 0, 30), (0, 5, 31), (0, 5, 39), (0, 5, 39), (0, 5, 31))),
    "DocumentNumber": ("Any", ((0, 5, 9), (1, 0, 9), (1, 0, 9), (1, 0, 9), (1, 0, 9))),
    "DocumentNumberCheck": ("Digit", ((0, 14, 1), (1, 9, 1), (1, 9, 1), (1, 9, 1), (1, 9, 1))),
    "Nationality": ("Alpha", ((1, 15, 3), (1, 10, 3), (1, 10, 3), (1, 10, 3), (1, 10, 3))),
    "BirthDate": ("DigitOrFiller", ((1, 0, 6), (1, 13, 6), (1, 13, 6), (1, 13, 6), (1, 13, 6))),
    "BirthDateCheck": ("Digit", ((1, 6, 1), (1, 19, 1), (1, 19, 1), (1, 19, 1), (1, 19, 1))),
    "Sex": ("SexChar", ((1, 7, 1), (1, 20, 1), (1, 20, 1), (1, 20, 1), (1, 20, 1))),
    "ExpiryDate": ("DigitOrFiller", ((1, 8, 6), (1, 21, 6), (1, 21, 6), (1, 21, 6), (1, 21, 6))),
    "ExpiryDateCheck": ("Digit", ((1, 14, 1), (1, 27, 1), (1, 27, 1), (1, 27, 1), (1, 27, 1))),
    "OptionalData1": ("Any", ((0, 15, 15), (1, 28, 7), (1, 28, 14), (1, 28, 16), (1, 28, 8))),
    "OptionalData2": ("Any", ((1, 18, 11), None, None, None, None)),
    "OptionalDataCheck": ("DigitOrFiller", (None, None, (1, 42, 1), None, None)),
    "CompositeCheck": ("Digit", ((1, 29, 1), (1, 35, 1), (1, 43, 1), None, None)),
}
#: Layouts whose number check may hold a filler, where it marks a longer number.
NUMBER_CHECK_FILLER = ("Td1", "Td2")
#: Fields in the order in which each layout reports them.
ORDER: dict[str, tuple[str, ...]] = {
    "Td1": ("DocumentCode", "IssuingCountry", "DocumentNumber", "DocumentNumberCheck", "OptionalData1", "BirthDate", "BirthDateCheck", "Sex", "ExpiryDate", "ExpiryDateCheck", "Nationality", "OptionalData2", "CompositeCheck", "Name"),
    "Td2": ("DocumentCode", "IssuingCountry", "Name", "DocumentNumber", "DocumentNumberCheck", "Nationality", "BirthDate", "BirthDateCheck", "Sex", "ExpiryDate", "ExpiryDateCheck", "OptionalData1", "CompositeCheck"),
    "Td3": ("DocumentCode", "IssuingCountry", "Name", "DocumentNumber", "DocumentNumberCheck", "Nationality", "BirthDate", "BirthDateCheck", "Sex", "ExpiryDate", "ExpiryDateCheck", "OptionalData1", "OptionalDataCheck", "CompositeCheck"),
    "MrvA": ("DocumentCode", "IssuingCountry", "Name", "DocumentNumber", "DocumentNumberCheck", "Nationality", "BirthDate", "BirthDateCheck", "Sex", "ExpiryDate", "ExpiryDateCheck", "OptionalData1"),
    "MrvB": ("DocumentCode", "IssuingCountry", "Name", "DocumentNumber", "DocumentNumberCheck", "Nationality", "BirthDate", "BirthDateCheck", "Sex", "ExpiryDate", "ExpiryDateCheck", "OptionalData1"),
}
#: Spans that the composite check digit protects.
COMPOSITE: dict[str, tuple[tuple[int, int, int], ...]] = {
    "Td1": ((0, 5, 25), (1, 0, 7), (1, 8, 7), (1, 18, 11)),
    "Td2": ((1, 0, 10), (1, 13, 7), (1, 21, 14)),
    "Td3": ((1, 0, 10), (1, 13, 7), (1, 21, 22)),
    "MrvA": (),
    "MrvB": (),
}
#: Codes of the standard besides ISO 3166-1.
SPECIAL_CODES = "GBD GBN GBO GBP GBS RKS EUE UNO UNA UNK XBA XIM XCC XCO XEC XPO XOM XXA XXB XXC XXX ANT NTZ UTO D<<".split()
#: An ISO code that documents do not use.
UNUSED_CODES = {"ALA"}


_codes: list[str] = []


def country_codes(spark: SparkSession) -> list[str]:
    """Valid issuer and nationality codes: the JVM's ISO 3166-1 alpha-3 codes and the special ones."""
    if not _codes:
        locale = spark._jvm.java.util.Locale
        iso = {locale("", c).getISO3Country() for c in locale.getISOCountries()}
        _codes.extend(sorted((iso - UNUSED_CODES) | set(SPECIAL_CODES)))
    return _codes


@dataclass(frozen=True)
class Span:
    line: int
    start: int
    length: int


def field_class(kind: str, field: str) -> str:
    if field == "DocumentNumberCheck" and kind in NUMBER_CHECK_FILLER:
        return "DigitOrFiller"
    return FIELDS[field][0]
