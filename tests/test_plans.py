from pyspark.sql import functions as F

from zonemill.plans import quality, votes


def test_fusion_prefers_weight_then_glyph(spark):
    f = spark.createDataFrame([("s", "KA<", 1.0), ("s", "LA0", 1.0), ("s", "LB<", 0.5), ("t", "", 1.0)], "session_id string, line string, weight double")
    assert {r["session_id"]: r["fused"] for r in votes.fuse_characters(f).collect()} == {"s": "LA<"}


def test_agreement(spark):
    f = spark.createDataFrame([("s", "ABCD", 1.0), ("s", "ABCX", 1.0)], "session_id string, line string, weight double")
    row = votes.agreement(f, spark.createDataFrame([("s", "ABCD")], "session_id string, fused string")).first()
    assert (row["frames"], row["agreeing"]) == (2, 1)


def test_evaluate(spark):
    labels = spark.createDataFrame([("a", ["AB?"]), ("b", ["XY"]), ("c", []), ("d", ["Q"])], "file string, label array<string>")
    reads = spark.createDataFrame([("a", ["ABC"]), ("b", ["XZ"]), ("c", ["N"])], "file string, read array<string>")
    r = quality.evaluate(labels, reads).first()
    assert (r["images"], r["missing"], r["characters"], r["correct"], r["exact"], r["false_positive"]) == (4, 1, 5, 3, 1, 1)


LABEL = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]


def evaluated(spark):
    short = [LABEL[0][:43], LABEL[1]]
    wrong = [LABEL[0].replace("ANNA", "ANNE"), LABEL[1]]
    labels = spark.createDataFrame([("short", LABEL), ("wrong", LABEL), ("none", []), ("gone", []), ("free", ["?"]), ("lost", LABEL)], "file string, label array<string>")
    reads = spark.createDataFrame(
        [("short", short, True, False, False), ("wrong", wrong, True, True, True), ("none", None, False, False, False), ("free", ["Z"], True, False, False)],
        "file string, read array<string>, found boolean, valid boolean, composite_conflict boolean",
    )
    return labels, reads


def test_evaluate_files_line_by_line(spark):
    by = {r["file"]: r for r in quality.evaluate_files(*evaluated(spark)).collect()}
    assert {k: (r["correct"], r["characters"], r["name_errors"]) for k, r in by.items()} == {"short": (87, 88, 1), "wrong": (87, 88, 1), "none": (0, 0, 0), "gone": (0, 0, 0), "free": (0, 0, 0), "lost": (0, 88, 0)}
    assert [k for k in by if by[k]["exact"]] == [k for k in by if by[k]["perfect"]] and {k for k in by if by[k]["exact"]} == {"none", "free"}
    assert {k for k in by if by[k]["wrong_valid"]} == {"wrong"}


def test_evaluate_counts_and_gate(spark):
    labels, reads = evaluated(spark)
    m = quality.evaluate(labels, reads)
    r = m.first()
    assert (r["images"], r["images_read"], r["missing"], r["characters_read"], r["found"], r["valid"], r["wrong_valid"], r["composite_conflicts"], r["name_errors"], r["perfect_files"]) == (6, 4, 2, 176, 3, 1, 1, 1, 2, 2)
    whole = labels.where("file not in ('gone', 'lost')")
    now, before = quality.evaluate(whole, reads), quality.evaluate(whole, reads.withColumn("valid", F.lit(False)))
    assert not quality.regressed(now, now).first()[0] and quality.regressed(now, before).first()[0] and quality.regressed(m, m).first()[0]


def test_read_stats(spark):
    rows = [((True, True, 0.9), []), ((True, False, 0.7), ["blur"]), ((False, False, 0.0), ["dark"])]
    df = spark.createDataFrame(rows, "mrz struct<mrz_found: boolean, is_valid: boolean, confidence: double>, hints array<string>")
    r = quality.read_stats(df).first()
    assert (r["files"], r["found"], r["valid"], round(r["confidence"], 6), r["with_hints"]) == (3, 2, 1, 0.8, 2)
