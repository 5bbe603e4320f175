"""Parsing of MRZ text columns into typed, validated records: one projection, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formats import country_codes
from ..functions import zones as Z
from ..functions.zones import CHECKS, PARTS

def parse(df: DataFrame, text_col: str, reference: Column | str = "2026-08-03", out: str = "mrz", lines: bool = False, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``df`` with struct column ``out``, the parsed record of ``text_col``.

    ``text_col`` holds text (or, with ``lines``, an array of lines).  Dates are
    read against ``reference`` (a date column or literal).  Text that is not an
    MRZ, null included, has ``mrz_found`` false, confidence 0 and one issue;
    other columns stay as they are, but a column named ``out`` is replaced.
    Filter on other columns before parsing: no filter moves below it.

    ``parts`` names the sub-records that are wanted: the others are neither
    computed nor in the result (``is_valid`` needs checks and issues).  Texts
    are parsed in Arrow batches; the function counts as nondeterministic, so
    the optimizer neither copies it into its users nor pushes filters on its
    result down.
    """
    ref = (F.lit(reference) if isinstance(reference, str) else reference).cast("date")
    codes = country_codes(df.sparkSession)

    def records(source: pa.Array, reference: pa.Array) -> pa.Array:
        return Z.records(source, reference, parts, codes)

    source = F.transform(F.col(text_col), F.make_valid_utf8) if lines else F.make_valid_utf8(F.col(text_col))
    parsed = F.arrow_udf(records, Z.schema(parts)).asNondeterministic()
    return df.select(*(c for c in df.columns if c != out), parsed(source, ref).alias(out))


def issue_text(i: Column) -> Column:
    """``Kind (Field): Message``, without an empty field."""
    return F.concat(i["kind"], F.when(i["field"] != "", F.concat(F.lit(" ("), i["field"], F.lit(")"))).otherwise(F.lit("")), F.lit(": "), i["message"])


def count_checks(checks: Column) -> tuple[Column, Column]:
    """(valid, present) of the five checks."""
    each = F.array(*(checks[c] for c in CHECKS))
    return F.size(F.filter(each, lambda s: s == "Valid")), F.size(F.filter(each, lambda s: s != "NotPresent"))


def line_of(raw: Column, i: int) -> Column:
    """Line ``i`` (from 0) of a raw record, empty if absent."""
    return F.coalesce(F.get(raw["lines"], F.lit(i)), F.lit(""))
