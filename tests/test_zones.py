"""What keeps the queries over zones in step with their input: one Arrow pass, read once, no character at a time."""

import io
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

from zonemill.operators.parse import parse
from zonemill.plans import quality
from zonemill.sources.bridge import cd
from zonemill.streaming.session import agreeing, fuse

L1, L2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def reads(spark):
    texts = [f"{L1}\n{L2}", f"{L1.replace('A', 'É')}\n{L2}", "I<UTOD23145890<12<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<", "no zone", None]
    return spark.createDataFrame(list(enumerate(texts)), "file int, t string")


def test_parse_is_one_arrow_pass(reads):
    shown = plan(parse(reads, "t").where("mrz.is_valid").select("file", "mrz.issues", "mrz.checks"))
    assert shown.count("ArrowEvalPython") == 1 and "lambda" not in shown


def test_line_break_in_a_number_is_outside_the_alphabet(spark):
    df = spark.createDataFrame([(f"{L1}\nL898902C\r6{L2[10:]}",)], "t string")
    r = parse(df, "t").first()["mrz"]
    assert "outside the MRZ alphabet" in [i["message"] for i in r["issues"] if i["kind"] == "CheckDigitFailed" and i["field"] == "DocumentNumber"][0]


def test_parts_and_empty_batches(reads):
    assert parse(reads, "t", parts=("checks",)).schema["mrz"].dataType.names == ["mrz_found", "checks", "confidence", "correction_count"]
    assert parse(reads.where("false"), "t").count() == 0
    r = {x["file"]: x["mrz"] for x in parse(reads, "t", parts=("raw", "document")).collect()}
    assert r[1]["raw"]["name"].startswith("ERIKSSON<<ÉNNÉ") and r[2]["document"]["document_number"] == "D231458901" and r[3]["raw"] is None


def test_histogram_reads_once(reads):
    df = quality.issue_histogram(parse(reads, "t", parts=("checks", "issues")), most=1)
    assert plan(df).count("ArrowEvalPython") == 1
    assert {(r["state"], r["kind"], r["n"]) for r in df.collect()} == {("clean", "BadFormat", 4), ("dirty", "NotFound", 2)}


def test_evaluation_is_one_arrow_pass(spark):
    labels = spark.createDataFrame([(1, ["AÉ😀?", "XY"]), (2, None)], "file int, label array<string>")
    got = spark.createDataFrame([(1, ["AÉ😀"]), (2, ["A"])], "file int, read array<string>")
    df = quality.evaluate_files(labels, got)
    assert "lambda" not in plan(df.select("characters", "correct"))
    assert {r["file"]: (r["characters"], r["correct"]) for r in df.collect()} == {1: (5, 3), 2: (0, 0)}


class Weight(float):
    added = 0

    def __radd__(self, other):
        Weight.added += 1
        return float(self) + other


def test_only_differing_characters_are_voted_on():
    held = [[[L1, L2], Weight(0.5), None] for _ in range(16)]
    assert fuse(held) == [L1, L2] and agreeing(held, [L1, L2]) == 16 and Weight.added == 0
    held[3][0] = [L1, "M" + L2[1:]]
    assert fuse(held) == [L1, L2] and Weight.added == 16


def test_bridge_check_digits_agree_with_the_sql(spark):
    texts = ["", "<", "A", "L898902C3", "Z" * 15, "9" * 16, "C00000012<", "D23145890", "ZZ<" * 16 + "A9"]
    mine = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(cd("t", False, 50)).alias("d"))
    assert "regexp" not in cd("t", False, 50)
    assert {r["t"]: r["d"] for r in mine.collect()} == {t: duckdb.execute(f"SELECT CAST({cd('t', True)} AS INT) FROM (SELECT '{t}' AS t)").fetchone()[0] for t in texts}
