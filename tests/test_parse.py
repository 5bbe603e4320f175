"""Text cases of the MRZ parser, all in one projection."""

import pytest
from pyspark.sql import functions as F

from zonemill.functions import mrz as M
from zonemill.operators.parse import parse

L1, L2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
FILLED = "P<UTO" + "<" * 39
CASES = {
    "td3": f"{L1}\n{L2}",
    "td1": "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<",
    "td2": "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6",
    "mrva": "V<UTOTRAVELER<<HAPPY".ljust(44, "<") + "\n17103813<3UTO8002155M2812312" + "<" * 16,
    "lower": f"{L1.lower()}\r\n{L2}",
    "bad_number": f"{L1}\n{L2.replace('L898902C3', 'L898902C3')[:9]}0{L2[10:]}",
    "short": f"{L1[:-2]}\n{L2}",
    "space": f"{L1.replace('ERIKSSON', 'ERIKS ON')}\n{L2}",
    "sex_q": f"{L1}\n{L2[:20]}Q{L2[21:]}",
    "sex_x": f"{L1}\n{L2[:20]}X{L2[21:]}",
    "wrong_code": f"I{L1[1:]}\n{L2}",
    "mononym": "P<UTOMADONNA".ljust(44, "<") + f"\n{L2}",
    "unknown": f"{L1}\n{L2[:10]}ZZZ{L2[13:]}",
    "filler": f"{FILLED}\n" + "<" * 9 + "0" + "<<<" + "<" * 6 + "0" + "<" + "<" * 6 + "0" + "<" * 14 + "00",
    "long_line": f"{L1}<<<\n{L2}",
    "tie": f"{L1}\n{L2[:36]}",
    "garbage": "hello world\nthis is not an mrz",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, v, 1) for k, v in CASES.items()], "case string, t string, mrz int")
    return {r["case"]: r["mrz"] for r in parse(df, "t").collect()}


def kinds(r):
    return {(i["field"], i["kind"]) for i in r["issues"]}


def test_valid(parsed):
    for case in ("td3", "td1", "td2", "lower", "mononym", "unknown"):
        assert parsed[case]["is_valid"], (case, parsed[case]["issues"])
    d = parsed["td3"]["document"]
    assert (d["document_number"], d["primary_identifier"], d["secondary_identifier"]) == ("L898902C3", "ERIKSSON", "ANNA MARIA")
    assert (d["birth_date"]["iso"], d["expiry_date"]["iso"], d["sex"]) == ("1974-08-12", "2012-04-15", "Female")
    assert parsed["td1"]["checks"]["optional_data"] == "NotPresent"
    assert parsed["mrva"]["checks"]["composite"] == "NotPresent"
    assert parsed["mononym"]["document"]["secondary_identifier"] == ""
    assert kinds(parsed["unknown"]) == {("Nationality", "UnknownValue")}


def test_invalid(parsed):
    for case in ("bad_number", "short", "space", "sex_q", "sex_x", "wrong_code", "filler"):
        assert parsed[case]["mrz_found"] and not parsed[case]["is_valid"], case
    assert parsed["bad_number"]["checks"]["document_number"] == "Invalid"
    assert ("", "BadFormat") in kinds(parsed["short"])
    assert ("Name", "BadFormat") in kinds(parsed["space"])
    assert {("Sex", "BadFormat"), ("Sex", "InvalidValue")} <= kinds(parsed["sex_q"])
    assert kinds(parsed["sex_x"]) >= {("Sex", "InvalidValue")} and ("Sex", "BadFormat") not in kinds(parsed["sex_x"])
    assert ("DocumentCode", "InvalidValue") in kinds(parsed["wrong_code"])
    assert {("DocumentNumber", "InvalidValue"), ("Name", "InvalidValue"), ("ExpiryDate", "InvalidValue")} <= kinds(parsed["filler"])


def test_not_found(parsed):
    for case in ("garbage", "empty", "null", "long_line", "tie"):
        assert not parsed[case]["mrz_found"] and parsed[case]["confidence"] == 0.0, case
        assert kinds(parsed[case]) == {("", "NotFound")}


def test_check_digits(spark):
    want = {"L898902C3": 6, "740812": 2, "120415": 9, "ZE184226B<<<<<": 1, "D23145890": 7, "<" * 14: 0, "": 0, "a": -1, "A#": -1}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", M.check_digit(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == want


def test_dates(spark):
    born = {"740812": "1974-08-12", "260101": "2026-01-01", "270101": "1927-01-01", "000229": "2000-02-29", "261231": "1926-12-31", "74<<<<": "1974-??-??", "<<<<<<": "????-??-??", "741315": "1974-??-15"}
    ends = {"961210": "1996-12-10", "891231": "2089-12-31", "900101": "1990-01-01", "301231": "2030-12-31", "250229": "2025-02-29"}
    df = spark.createDataFrame([(k, False) for k in born] + [(k, True) for k in ends], "t string, e boolean")
    ref = F.lit("2026-08-03").cast("date")
    rows = df.select("t", "e", F.when(F.col("e"), M.mrz_date(F.col("t"), True, ref)).otherwise(M.mrz_date(F.col("t"), False, ref)).alias("d")).collect()
    assert {r["t"]: r["d"]["iso"] for r in rows if not r["e"]} == born
    assert {r["t"]: r["d"]["iso"] for r in rows if r["e"]} == ends
    impossible = [r["d"] for r in rows if r["t"] == "250229"][0]
    assert impossible["date"] is None and impossible["impossible"] and impossible["d"] == 29
