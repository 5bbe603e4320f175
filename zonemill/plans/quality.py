"""Aggregations over parsed records: counts, tallies, histograms, percentiles and labelled evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formats import FIELDS, LINE_COUNT, LINE_LENGTH, TYPES
from ..operators.parse import CHECKS


def checks_tally(parsed: DataFrame) -> DataFrame:
    """Count of each status of each check over found records."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"mrz.checks.{c}").alias("status")) for c in CHECKS))
    return parsed.where("mrz.mrz_found").select(F.inline(each)).groupBy("field", "status").agg(F.count("*").alias("n"))


def format_counts(parsed: DataFrame) -> DataFrame:
    """Records, valid ones and mean confidence by layout (null: not found)."""
    return parsed.groupBy(F.col("mrz.document.type").alias("doc_type")).agg(
        F.count("*").alias("n"), F.count_if("mrz.is_valid").alias("n_valid"), F.round(F.avg("mrz.confidence"), 6).alias("confidence")
    )


def issue_histogram(parsed: DataFrame, most: int = 8) -> DataFrame:
    """Issues by record state, kind, field and first word; all of clean records, the ``most`` commonest of others.  The records are read once."""
    clean = F.col("mrz.checks.all_valid") & F.col("mrz.mrz_found")
    each = parsed.select(F.when(clean, "clean").otherwise("dirty").alias("state"), F.explode("mrz.issues").alias("i"))
    counted = each.groupBy("state", F.col("i.kind").alias("kind"), F.col("i.field").alias("field"), F.substring_index("i.message", " ", 1).alias("word")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "kind", "field", "word"))
    return counted.withColumn("_rank", rank).where((F.col("state") == "clean") | (F.col("_rank") <= most)).drop("_rank")


def nearest_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank 25th, 50th and 90th percentile by ``keys``; nulls are left out."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def read_stats(parsed: DataFrame) -> DataFrame:
    """One row: records, found and valid ones, mean confidence of the found (0 if none), and those with a capture hint in array column ``hints``."""
    return parsed.agg(
        F.count("*").alias("files"), F.count_if("mrz.mrz_found").alias("found"), F.count_if("mrz.is_valid").alias("valid"),
        F.coalesce(F.avg(F.when(F.col("mrz.mrz_found"), F.col("mrz.confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(F.size("hints") > 0).alias("with_hints"),
    )


def _name_field(label: Column) -> Column:
    """(line, start, length) of the name in the layout of ``label``, null for none."""
    length, visa = F.length(F.get(label, 0)), F.substring(F.get(label, 0), 1, 1) == "V"
    out = F.lit(None)
    for at, kind in enumerate(TYPES):
        line, start, size = FIELDS["Name"][1][at]
        fits = (F.size(label) == LINE_COUNT[kind]) & (length == LINE_LENGTH[kind]) & (F.lit(True) if kind == "Td1" else visa if kind.startswith("Mrv") else ~visa)
        out = F.when(fits, F.struct(F.lit(line).alias("line"), F.lit(start).alias("start"), F.lit(size).alias("length"))).otherwise(out)
    return out


def _points(lines: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32)


def _characters(want: pa.Array, got: pa.Array, name: pa.Array) -> pa.Array:
    """Counted characters of ``want``, those that ``got`` has at their place, and the others within ``name``, of each row."""
    n = len(want)
    size, has = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (want, got))
    file = np.repeat(np.arange(n), size)
    line = np.arange(len(file)) - (np.cumsum(size) - size)[file]
    wanted = pc.fill_null(want.flatten(), "")
    read = pa.concat_arrays([pc.fill_null(got.flatten(), ""), pa.array([""], wanted.type)])
    read = read.take(pa.array(np.where(line < has[file], (np.cumsum(has) - has)[file] + line, len(read) - 1)))
    length, reach = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (wanted, read))
    at = np.repeat(np.arange(len(file)), length)
    column = np.arange(len(at)) - (np.cumsum(length) - length)[at]
    points = _points(wanted)
    others = np.append(_points(read), np.uint32(0))
    within = column < reach[at]
    right = within & (others[np.where(within, (np.cumsum(reach) - reach)[at] + column, 0)] == points)
    row, start, width = (pc.fill_null(pc.struct_field(name, i), -1).to_numpy(zero_copy_only=False)[file] for i in range(3))
    in_name = (line == row)[at] & (column >= start[at]) & (column < (start + width)[at])
    counted = points != ord("?")
    sums = [np.bincount(file[at[x]], minlength=n) for x in (counted, counted & right, counted & ~right & in_name)]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sums], names=["characters", "correct", "name_errors"])


def evaluate_files(labels: DataFrame, reads: DataFrame) -> DataFrame:
    """A row for each file of ``labels(file, label)``: how ``reads(file, read)`` fits it line by line; both are arrays of lines.

    ``?`` in a label is not counted.  A file without a row in ``reads`` is
    missing; an empty label means no zone: a file where one is found is a false
    positive, another is exact.  ``reads`` may have ``found`` (default: any
    line), ``valid`` and ``composite_conflict`` (default: false).
    ``perfect``: as many lines as the label, and no counted character wrong.
    """
    has = lambda c, other: F.coalesce(F.col(c), other) if c in reads.columns else other
    got = F.coalesce("read", F.array().cast("array<string>"))
    said = reads.select("file", got.alias("_got"), has("found", F.size(got) > 0).alias("found"), has("valid", F.lit(False)).alias("valid"), has("composite_conflict", F.lit(False)).alias("composite_conflict"))
    j = labels.select("file", F.coalesce("label", F.array().cast("array<string>")).alias("_want")).join(said, "file", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    j = j.select("file", "_want", F.coalesce("_got", F.array().cast("array<string>")).alias("_got"), F.col("_got").isNull().alias("missing"), no("found"), no("valid"), no("composite_conflict"), _name_field(F.col("_want")).alias("_name"))

    each = F.arrow_udf(_characters, "struct<characters:long,correct:long,name_errors:long>")
    j = j.withColumn("_each", each("_want", "_got", "_name"))
    j = j.select(*(c for c in j.columns if c != "_each"), "_each.characters", "_each.correct", F.when(F.col("missing"), 0).otherwise(F.col("_each.name_errors")).cast("long").alias("name_errors"))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    all_right = F.col("correct") == F.col("characters")
    zone = F.size("_want") > 0
    exact = ~F.col("missing") & F.when(zone, all_right & (lengths("_want") == lengths("_got"))).otherwise(~F.col("found"))
    j = j.withColumns({"exact": exact, "perfect": ~F.col("missing") & (F.size("_want") == F.size("_got")) & all_right})
    return j.select(
        "file", "missing", "found", "valid", "characters", "correct", "exact", "perfect", "name_errors", "composite_conflict",
        (~F.col("missing") & zone & ~F.col("exact") & F.col("valid")).alias("wrong_valid"), (~zone & F.col("found")).alias("false_positive"),
    )


def evaluate(labels: DataFrame, reads: DataFrame) -> DataFrame:
    """One row of metrics over ``evaluate_files(labels, reads)``.

    ``images`` and ``characters`` count all labels; ``images_read`` and
    ``characters_read`` leave the missing files out.
    """
    count = lambda c: F.count_if(c).alias(c)
    return evaluate_files(labels, reads).agg(
        F.count("*").alias("images"), count("missing"), F.count_if(~F.col("missing")).alias("images_read"),
        F.sum("characters").alias("characters"), F.sum(F.when(F.col("missing"), 0).otherwise(F.col("characters"))).alias("characters_read"), F.sum("correct").alias("correct"),
        count("exact"), count("false_positive"), count("wrong_valid"), count("found"), count("valid"),
        F.count_if("composite_conflict").alias("composite_conflicts"), F.sum("name_errors").alias("name_errors"), F.count_if("perfect").alias("perfect_files"),
    )


def regressed(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """One boolean: a metric got worse than the saved one-row baseline, other files or characters were read, or files are missing."""
    names = ("images_read", "characters_read", "correct", "exact", "wrong_valid", "false_positive")
    b = baseline.select(*(F.col(c).alias(f"was_{c}") for c in names))
    other = "missing > 0 or images_read = 0 or images_read <> was_images_read or characters_read <> was_characters_read"
    worse = "correct < was_correct or exact < was_exact or wrong_valid > was_wrong_valid or false_positive > was_false_positive"
    return metrics.crossJoin(b).select(F.expr(f"{other} or {worse}").alias("regressed"))
