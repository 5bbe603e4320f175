"""Ranking, confidence and capture hints of recognised zones, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.parse import count_checks

#: Cap of every reported confidence, and the floors of valid records with few and with many corrections.
CAP, FEW_CORRECTIONS, FLOOR_FEW, FLOOR_MANY = 0.999, 2, 0.95, 0.85


def _bounded(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quality(raw: Column) -> Column:
    """Expected share of characters read correctly, from a raw score: piecewise linear with knees at 0.80 and 0.94."""
    upper = (raw - 0.94) * 0.5 + 0.97
    middle = (raw - 0.80) * (0.27 / 0.14) + 0.70
    return _bounded(F.when(raw >= 0.94, upper).when(raw >= 0.80, middle).otherwise(raw * 0.85), 0.0, CAP)


def confidence(mean_score: Column, checks: Column, corrections: Column) -> Column:
    """Calibrated confidence of a record: a quarter of the raw score is the share of present checks that hold."""
    valid, present = count_checks(checks)
    raw = F.when(present > 0, mean_score * 0.75 + valid / present * 0.25).otherwise(mean_score)
    floor = F.when(~checks["all_valid"], 0.0).when(corrections <= FEW_CORRECTIONS, FLOOR_FEW).otherwise(FLOOR_MANY)
    return F.least(F.greatest(quality(raw), floor), F.lit(CAP))


def is_low(conf: Column) -> Column:
    """True where a LowConfidence issue is due."""
    return conf < 0.5


def rank_key(checks: Column, issues: Column, corrections: Column) -> Column:
    """Valid checks, less format and value issues, less a third of the corrections (whole thirds)."""
    bad = F.size(F.filter(issues, lambda i: i["kind"].isin("BadFormat", "InvalidValue")))
    return count_checks(checks)[0] - bad - F.floor(corrections / 3).cast("int")


def is_convincing(is_valid: Column, checks: Column, corrections: Column) -> Column:
    return (is_valid | (count_checks(checks)[0] >= 3)) & (corrections < 3)


def passes_gate(visual: Column, is_valid: Column, checks: Column, corrections: Column, exhaustive: Column) -> Column:
    """True if a found zone is to be reported: a good picture with one valid check, or a trusted valid record."""
    trusted = exhaustive | (corrections <= FEW_CORRECTIONS)
    return ((visual >= 0.75) & (count_checks(checks)[0] > 0)) | (is_valid & trusted)


def field_confidence(scores: Column, text: Column, status: Column) -> Column:
    """Confidence of one field from its cell scores; 0 without cells or with fillers alone."""
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + _bounded(x.cast("double"))) / F.greatest(F.size(scores), F.lit(1))
    moved = F.when(status == "Valid", 1 - (1 - mean) * 0.3).when(status == "Invalid", mean * 0.5).otherwise(mean)
    return F.when((F.size(scores) == 0) | text.rlike("^<*$"), 0.0).otherwise(_bounded(moved, 0.0, CAP))


def character_scores(scores: Column) -> Column:
    """Scores of lines of cells, each within 0 and 1."""
    return F.transform(scores, lambda line: F.transform(line, lambda x: _bounded(x.cast("double"))))


def hints(is_valid: Column, corrections: Column, visual: Column, hint_quality: Column, pitch: Column, at_edge: Column, glare: Column, contrast: Column) -> Column:
    """What to change in the next capture; nothing for a valid record that was read well."""
    named = F.array_compact(
        F.array(
            F.when(pitch < 10, "TooSmall"),
            F.when(at_edge, "CutOff"),
            F.when(glare > 0.10, "Glare"),
            F.when(contrast < 50, "LowContrast"),
        )
    )
    either = F.when(F.size(named) > 0, named).when(visual < 0.75, F.array(F.lit("Blurry"))).otherwise(F.array().cast("array<string>"))
    return F.when(is_valid & (corrections <= FEW_CORRECTIONS) & (hint_quality >= 0.75), F.array().cast("array<string>")).otherwise(either)
