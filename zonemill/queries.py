"""Registered queries over the driver's tables and their DuckDB SQL.

The SQL is formulated on its own: positions are spelled out for each layout
instead of looked up, and check digits are summed over lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import FIELDS, ORDER, SPECIAL_CODES, TYPES, VALUES, field_class
from .functions import confidence as C
from .functions import mrz as M
from .operators.parse import CHECKS, PARTS, count_checks, issue_text, parse
from .plans import quality, signals, votes
from .sources.bridge import bridge, cd, sql
from .streaming.session import fold_batch, frames

REFERENCE = "2026-08-03"
_NULL = "CAST(NULL AS VARCHAR)"


def _parsed(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return parse(bridge(spark, sf_dir), "mrz_text", REFERENCE, parts=parts or PARTS)


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = M.split_lines(F.col("mrz_text"))
    b = bridge(spark, sf_dir).withColumn("given", lines)
    b = b.withColumn("expected", M.expected_length(F.col("given")))
    return b.withColumn("lines", M.fitted(F.col("given"), F.col("expected"))).withColumn("kind", M.detect(F.col("lines")))


def check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT1-4: digits of the first line, and of both lines as segments; -1 outside the alphabet."""
    b = bridge(spark, sf_dir).select("doc_id", F.split("mrz_text", "\n").alias("l"))
    return b.select("doc_id", M.check_digit(F.col("l")[0]).cast("int").alias("first"), M.check_digit_of([F.col("l")[0], F.col("l")[1]]).cast("int").alias("both"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT5-9: expected length, padding issues and layout of every text."""
    n = _normal(spark, sf_dir)
    issues = F.when(F.col("kind").isNotNull(), F.size(M.length_issues(F.col("given"), F.col("expected")))).otherwise(0)
    return n.select("doc_id", F.size("given").alias("n_lines"), "expected", F.when(F.col("kind").isNotNull(), M.pick(F.col("kind"), M.TYPES)).alias("doc_type"), issues.alias("n_length_issues"))


def field_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT10-11: the raw fields."""
    p = _parsed(spark, sf_dir, "raw").where("mrz.mrz_found")
    return p.select("doc_id", *(F.col(f"mrz.raw.{c}").alias(c) for c in ("document_code", "issuing_country", "name", "document_number", "nationality", "birth_date", "sex", "expiry_date", "optional_data1", "optional_data2")))


def verify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT15-17: status of the five check digits, the number's with its extension."""
    p = _parsed(spark, sf_dir, "checks", "document").where("mrz.mrz_found")
    return p.select("doc_id", *(F.col(f"mrz.checks.{c}").alias(f"{c}_check") for c in CHECKS), F.col("mrz.checks.all_valid").alias("all_valid"), F.col("mrz.document.document_number").alias("number"), F.col("mrz.document.optional_data1").alias("optional"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT18-20."""
    return _parsed(spark, sf_dir, "document").where("mrz.mrz_found").select("doc_id", F.col("mrz.document.primary_identifier").alias("primary_name"), F.col("mrz.document.secondary_identifier").alias("secondary_name"))


def sex_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT21."""
    return _parsed(spark, sf_dir, "document", "issues").where("mrz.mrz_found").select("doc_id", F.col("mrz.document.sex").alias("sex"), F.exists("mrz.issues", lambda i: (i["field"] == "Sex") & (i["kind"] == "InvalidValue")).alias("reported"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT22-27: partial dates, centuries and calendar."""
    p = _parsed(spark, sf_dir, "document").where("mrz.mrz_found")
    b, e = F.col("mrz.document.birth_date"), F.col("mrz.document.expiry_date")
    return p.select("doc_id", b["iso"].alias("birth"), e["iso"].alias("expiry"), b["date"].cast("string").alias("birth_day"), e["date"].cast("string").alias("expiry_day"), M.is_complete(b).alias("complete"))


def country_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT28: unknown issuers and nationalities."""
    p = _parsed(spark, sf_dir, "raw", "issues").where("mrz.mrz_found").select(F.explode("mrz.issues").alias("i"), F.col("mrz.raw.issuing_country").alias("issuer"))
    return p.where("i.kind = 'UnknownValue'").groupBy(F.col("i.field").alias("field"), "issuer").agg(F.count("*").alias("n"))


def char_class_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT12-14: characters that do not fit their field."""
    p = _parsed(spark, sf_dir, "issues").where("mrz.mrz_found").select("doc_id", F.explode("mrz.issues").alias("i"))
    return p.where("i.kind = 'BadFormat' and i.field <> ''").select("doc_id", F.col("i.field").alias("field"), F.col("i.message").alias("message"))


def mandatory_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT29."""
    p = _parsed(spark, sf_dir, "issues").where("mrz.mrz_found")
    has = lambda f: F.exists("mrz.issues", lambda i: (i["field"] == f) & (i["kind"] == "InvalidValue"))
    return p.select("doc_id", has("Name").alias("no_name"), has("DocumentNumber").alias("no_number"), has("DocumentCode").alias("bad_code"))


def parse_full_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT30-35: the whole record, flattened."""
    m = F.col("mrz")
    valid, present = count_checks(m["checks"])
    return _parsed(spark, sf_dir).select(
        "doc_id", m["mrz_found"].alias("mrz_found"), m["is_valid"].alias("is_valid"), m["document"]["type"].alias("doc_type"), m["document"]["document_number"].alias("number"),
        m["document"]["primary_identifier"].alias("primary_name"), m["document"]["birth_date"]["iso"].alias("birth"), m["confidence"].alias("confidence"),
        F.coalesce(valid, F.lit(0)).alias("checks_valid"), F.coalesce(present, F.lit(0)).alias("checks_present"), F.size(m["issues"]).alias("n_issues"), F.array_join(F.transform(m["issues"], issue_text), "; ").alias("issues"),
    )


def checks_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3."""
    return quality.checks_tally(_parsed(spark, sf_dir, "checks"))


def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1-2."""
    return quality.format_counts(_parsed(spark, sf_dir))


def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4."""
    return quality.issue_histogram(_parsed(spark, sf_dir, "checks", "issues"))


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: nearest-rank percentiles, of event values by type."""
    return quality.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value")


def labelled_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6, AGG13's totals: read lines against their labels; reads are the bridge lines, those of one file in 50 with C turned into G, labels the lines."""
    b = bridge(spark, sf_dir).select(F.col("doc_id").alias("file"), F.split(F.upper("mrz_text"), "\n").alias("label"))
    reads = b.where("file % 7 <> 0").select("file", F.transform("label", lambda x: F.when(F.col("file") % 50 == 0, F.regexp_replace(x, "C", "G")).otherwise(x)).alias("read"))
    checked = parse(reads.withColumn("_text", F.array_join("read", "\n")), "_text", parts=("checks", "issues"))
    status = F.col("mrz.checks")
    passed = sum(F.when(status[c] == "Valid", 1).otherwise(0) for c in ("document_number", "birth_date", "expiry_date"))
    return quality.evaluate(
        b, checked.select("file", "read", F.col("mrz.mrz_found").alias("found"), F.col("mrz.is_valid").alias("valid"), ((status["composite"] == "Invalid") & (passed >= 2)).alias("composite_conflict"))
    )


def vote_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7-8: character votes by event type; one frame for each event, its id as text, its value as confidence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("line"), F.round(F.col("value"), 2).cast("decimal(18,2)").alias("weight"))
    return votes.fuse_characters(e)


def rolling_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4-5: sightings of an identity within the last 16 frames of a session."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_no"), F.col("event_type").alias("identity"))
    return votes.rolling_sightings(e)


def template_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG13, IMG15, AGG10, REC20: mean vector of each label, normalised; the three best labels of every 20th vector."""
    return signals.template_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def mean_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10."""
    return signals.mean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("label", "dim", F.round("mean", 6).alias("mean"), "n")


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOC2-3: smoothed daily counts of each event type and their runs above a quarter of the peak."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long")
    counts = e.groupBy("event_type", days.alias("x")).agg(F.count("*").alias("v"))
    return signals.runs(counts, "event_type")


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1-6, 8, 10, 12, 13: reads of the bridge in sessions of up to 40 orders, three reads a document; the state after each read."""
    b = bridge(spark, sf_dir).where("defect in (0, 1, 3, 8)")
    reads = b.select(F.floor(F.col("doc_id") / 40).alias("session_id"), F.explode(F.sequence(F.col("doc_id") * 3, F.col("doc_id") * 3 + 2)).alias("frame_no"), "mrz_text", (F.lit(0.5) + F.col("doc_id") % 5 / 10).alias("confidence"))
    return fold_batch(frames(reads))


def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK5-7: confidence of each record and of its number, at made-up mean scores and numbers of corrections."""
    p = _parsed(spark, sf_dir, "checks", "raw").where("mrz.mrz_found")
    score, corrections = F.col("doc_id") % 101 / 100, F.col("doc_id") % 5
    of_record = C.confidence(score, F.col("mrz.checks"), corrections)
    of_number = C.field_confidence(F.array(score, score / 2), F.col("mrz.raw.document_number"), F.col("mrz.checks.document_number"))
    return p.select("doc_id", F.round(of_record, 6).alias("confidence"), C.is_low(of_record).alias("is_low"), F.round(of_number, 6).alias("number_confidence"))


def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG12: percentiles from a 256-bin histogram of event values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int").alias("bin"))
    return signals.histogram_percentiles(e)


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC16: slope and intercept of line numbers against quantity, by order line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fit = li.groupBy("l_linenumber").agg(F.regr_slope(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")).alias("s"), F.regr_intercept(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")).alias("i"))
    return fit.select(F.col("l_linenumber").cast("int").alias("line"), F.round("s", 3).alias("slope"), F.round("i", 2).alias("intercept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        check_digit, detect_format, field_project, verify_checks, split_names, sex_map, parse_dates, country_check, char_class_violations, mandatory_content, parse_full_flat,
        checks_tally, format_counts, issue_histogram, value_percentiles, labelled_eval, vote_fusion, rolling_sightings, template_topk, mean_template, text_runs, histogram_percentile, least_squares, session_states, calibrated_confidence,
    )
}

# ---- DuckDB SQL -------------------------------------------------------------

_NORMAL = f"""
g AS (SELECT doc_id, list_filter(list_transform(string_split(upper(mrz_text), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS g FROM bridge),
e AS (SELECT doc_id, g, (SELECT coalesce((SELECT x FROM (SELECT length(u) AS x, count(*) AS n FROM unnest(g) t(u) WHERE length(u) IN (30, 36, 44) GROUP BY 1) ORDER BY n DESC, x LIMIT 1),
  CASE WHEN abs(length(g[1]) - 30) <= 2 THEN 30 WHEN abs(length(g[1]) - 36) <= 2 THEN 36 WHEN abs(length(g[1]) - 44) <= 2 THEN 44 ELSE 0 END)) AS expected FROM g),
n AS (SELECT doc_id, g, CAST(expected AS INT) AS expected, CASE WHEN len(g) = CASE WHEN expected = 30 THEN 3 ELSE 2 END AND expected > 0
  AND len(list_filter(g, lambda x: abs(length(x) - expected) > 2)) = 0 THEN list_transform(g, lambda x: substr(rpad(x, 44, '<'), 1, expected)) END AS l FROM e),
t AS (SELECT doc_id, g, expected, l, CASE WHEN l IS NULL THEN NULL WHEN expected = 30 THEN 'Td1' WHEN expected = 36 THEN CASE WHEN l[1][1] = 'V' THEN 'MrvB' ELSE 'Td2' END
  ELSE CASE WHEN l[1][1] = 'V' THEN 'MrvA' ELSE 'Td3' END END AS kind FROM n),
r AS (SELECT doc_id, g, expected, kind, l,
  substr(l[1], 1, 2) AS code, substr(l[1], 3, 3) AS iss, CASE kind WHEN 'Td1' THEN l[3] ELSE substr(l[1], 6) END AS name,
  CASE kind WHEN 'Td1' THEN substr(l[1], 6, 9) ELSE substr(l[2], 1, 9) END AS num, CASE kind WHEN 'Td1' THEN substr(l[1], 15, 1) ELSE substr(l[2], 10, 1) END AS nchk,
  CASE kind WHEN 'Td1' THEN substr(l[2], 16, 3) ELSE substr(l[2], 11, 3) END AS nat,
  CASE kind WHEN 'Td1' THEN substr(l[2], 1, 6) ELSE substr(l[2], 14, 6) END AS bir, CASE kind WHEN 'Td1' THEN substr(l[2], 7, 1) ELSE substr(l[2], 20, 1) END AS bchk,
  CASE kind WHEN 'Td1' THEN substr(l[2], 8, 1) ELSE substr(l[2], 21, 1) END AS sx,
  CASE kind WHEN 'Td1' THEN substr(l[2], 9, 6) ELSE substr(l[2], 22, 6) END AS ex, CASE kind WHEN 'Td1' THEN substr(l[2], 15, 1) ELSE substr(l[2], 28, 1) END AS echk,
  CASE kind WHEN 'Td1' THEN substr(l[1], 16, 15) WHEN 'Td2' THEN substr(l[2], 29, 7) WHEN 'Td3' THEN substr(l[2], 29, 14) ELSE substr(l[2], 29) END AS opt1,
  CASE kind WHEN 'Td1' THEN substr(l[2], 19, 11) ELSE '' END AS opt2, CASE kind WHEN 'Td3' THEN substr(l[2], 43, 1) END AS ochk,
  CASE kind WHEN 'Td1' THEN substr(l[2], 30, 1) WHEN 'Td2' THEN substr(l[2], 36, 1) WHEN 'Td3' THEN substr(l[2], 44, 1) END AS cchk,
  CASE kind WHEN 'Td1' THEN concat(substr(l[1], 6, 25), substr(l[2], 1, 7), substr(l[2], 9, 7), substr(l[2], 19, 11)) WHEN 'Td2' THEN concat(substr(l[2], 1, 10), substr(l[2], 14, 7), substr(l[2], 22, 14))
    WHEN 'Td3' THEN concat(substr(l[2], 1, 10), substr(l[2], 14, 7), substr(l[2], 22, 22)) END AS protected FROM t)"""


def _status(text: str, check: str) -> str:
    return f"CASE WHEN {check} IS NULL THEN 'NotPresent' WHEN regexp_matches({text}, '[^0-9A-Z<]') THEN 'Invalid' WHEN CAST({cd(text, True)} AS VARCHAR) = {check} THEN 'Valid' ELSE 'Invalid' END"


_CHECKED = f"""
x AS (SELECT *, kind IN ('Td1', 'Td2') AND nchk = '<' AS ext, CASE WHEN instr(opt1, '<') = 0 THEN opt1 ELSE substr(opt1, 1, instr(opt1, '<') - 1) END AS more FROM r WHERE kind IS NOT NULL),
w AS (SELECT *, concat(num, substr(more, 1, greatest(length(more) - 1, 0))) AS longer FROM x),
c AS (SELECT *, CASE WHEN NOT ext THEN {_status("num", "nchk")} WHEN length(more) < 2 THEN 'Invalid' ELSE {_status("longer", "substr(more, length(more), 1)")} END AS s1,
  {_status("bir", "bchk")} AS s2, {_status("ex", "echk")} AS s3, CASE WHEN ochk = '<' AND replace(opt1, '<', '') = '' THEN 'NotPresent' ELSE {_status("opt1", "ochk")} END AS s4,
  {_status("protected", "cchk")} AS s5,
  CASE WHEN ext AND length(more) >= 2 THEN trim(longer, '<') ELSE trim(num, '<') END AS number,
  CASE WHEN ext AND length(more) >= 2 THEN trim(substr(opt1, length(more) + 2), '<') ELSE trim(opt1, '<') END AS optional FROM w)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((sql(True), *parts)) + " "


def _iso(y: str, d: str) -> str:
    mm, dd = f"substr({d}, 3, 2)", f"substr({d}, 5, 2)"
    return f"concat({y}, '-', CASE WHEN {mm} BETWEEN '01' AND '12' THEN {mm} ELSE '??' END, '-', CASE WHEN {dd} BETWEEN '01' AND '31' THEN {dd} ELSE '??' END)"


def _day(iso: str) -> str:
    return f"CAST(TRY_CAST(CASE WHEN instr({iso}, '?') = 0 THEN {iso} END AS DATE) AS VARCHAR)"


_BIRTH_YEAR = "CASE WHEN 2000 + CAST(substr(bir, 1, 2) AS INT) > 2026 OR (substr(bir, 1, 2) = '26' AND substr(bir, 3, 2) BETWEEN '01' AND '12' AND (substr(bir, 3, 2) > '08' OR (substr(bir, 3, 2) = '08' AND substr(bir, 5, 2) BETWEEN '04' AND '31'))) THEN concat('19', substr(bir, 1, 2)) ELSE concat('20', substr(bir, 1, 2)) END"
_EXPIRY_YEAR = "concat(CASE WHEN substr(ex, 1, 2) >= '90' THEN '19' ELSE '20' END, substr(ex, 1, 2))"
_SPACED = lambda x: f"regexp_replace(trim({x}, '<'), '<+', ' ', 'g')"
_KNOWN = "('UTO', 'D<<', 'GBR', 'USA', 'FRA', 'ITA', 'ESP', 'NLD', 'BEL', 'CHE', 'AUT', 'POL', 'SWE', 'NOR', 'DNK', 'FIN', 'IRL', 'PRT', 'GRC', 'CZE', 'HUN', 'ROU', 'JPN', 'CAN', 'AUS')"

_SPANS = ", ".join(f"('{t}', {k}, '{name}', '{field_class(t, name)}', {line + 1}, {start}, {length})" for i, t in enumerate(TYPES) for k, name in enumerate(ORDER[t]) for line, start, length in [FIELDS[name][1][i]])
_RAW_SCORE = "CASE WHEN present > 0 THEN 0.75 * score + 0.25 * valid / present ELSE score END"
_FLOOR = "CASE WHEN NOT ok THEN 0 WHEN corrections <= 2 THEN 0.95 ELSE 0.85 END"
_KNEES = "CASE WHEN raw >= 0.94 THEN 0.97 + (raw - 0.94) * 0.5 WHEN raw >= 0.80 THEN 0.70 + (raw - 0.80) * 0.27 / 0.14 ELSE raw * 0.85 END"
_MEAN = "SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2 HAVING count(*) >= 2"
_UNIT = "SELECT {key}, i, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS u FROM (SELECT {key}, i, m - avg(m) OVER (PARTITION BY {key}) AS c FROM ({rows}))"
_QUERY = "SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS m FROM embeddings WHERE vec_id % 20 = 0"
_STATUSES = "[s1, s2, s3, s4, s5]"
_MISFIT = "CASE class WHEN 'Any' THEN '[0-9A-Z<]' WHEN 'Alpha' THEN '[A-Z<]' WHEN 'Digit' THEN '[0-9]' WHEN 'DigitOrFiller' THEN '[0-9<]' ELSE '[MFX<]' END"

ORACLES: dict[str, str] = {
    "char_class_violations": _with(_NORMAL, f"spans(kind, k, field, class, line, first, size) AS (VALUES {_SPANS})", "ch AS (SELECT doc_id, field, class, first + p AS place, substr(l[line], first + p, 1) AS c FROM r JOIN spans USING (kind), range(1, 45) t(p) WHERE p <= size)")
    + f"SELECT doc_id, field, CASE WHEN NOT regexp_matches(c, '[0-9A-Z<]') THEN format('Character ''{{}}'' at position {{}} is outside the MRZ alphabet.', c, place) ELSE format('Character ''{{}}'' is not allowed at position {{}} ({{}}).', c, place, class) END AS message FROM ch WHERE NOT regexp_matches(c, {_MISFIT})",
    "calibrated_confidence": _with(
        _NORMAL, _CHECKED, f"v AS (SELECT doc_id, num, s1, (doc_id % 101) / 100.0 AS score, doc_id % 5 AS corrections, len(list_filter({_STATUSES}, lambda s: s = 'Valid')) AS valid, len(list_filter({_STATUSES}, lambda s: s <> 'NotPresent')) AS present, NOT list_contains({_STATUSES}, 'Invalid') AS ok FROM c)",
        f"m AS (SELECT *, {_RAW_SCORE} AS raw FROM v)", f"q AS (SELECT *, least(greatest(least(greatest({_KNEES}, 0), 0.999), {_FLOOR}), 0.999) AS conf FROM m)",
    ) + "SELECT doc_id, round(CAST(conf AS DOUBLE), 6) AS confidence, conf < 0.5 AS is_low, round(CAST(CASE WHEN replace(num, '<', '') = '' THEN 0 ELSE least(greatest(CASE s1 WHEN 'Valid' THEN 1 - (1 - score * 0.75) * 0.3 WHEN 'Invalid' THEN score * 0.75 * 0.5 ELSE score * 0.75 END, 0), 0.999) END AS DOUBLE), 6) AS number_confidence FROM q",
    "text_runs": "WITH e AS (SELECT event_type, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 86400) AS BIGINT) AS x, count(*) AS v FROM events GROUP BY 1, 2), b AS (SELECT event_type, unnest(range(min(x), max(x) + 1)) AS x FROM e GROUP BY 1), f AS (SELECT event_type, x, coalesce(v, 0) AS v FROM b LEFT JOIN e USING (event_type, x)), s AS (SELECT *, floor(avg(v) OVER (PARTITION BY event_type ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS s FROM f), p AS (SELECT *, max(s) OVER (PARTITION BY event_type) AS peak FROM s), o AS (SELECT *, x - row_number() OVER (PARTITION BY event_type ORDER BY x) AS g FROM p WHERE peak >= 20 AND s >= greatest(12, floor(peak / 4))) SELECT event_type, min(x) AS first, max(x) + 1 AS past, CAST(sum(v) AS BIGINT) AS total FROM o GROUP BY event_type, g",
    "template_topk": f"WITH t AS ({_UNIT.format(key='label', rows=_MEAN)}), q AS ({_UNIT.format(key='vec_id', rows=_QUERY)}), d AS (SELECT vec_id, label, sum(q.u * t.u) AS s FROM q JOIN t USING (i) GROUP BY 1, 2), k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS rank FROM d) SELECT vec_id, CAST(label AS INT) AS label, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3",
    "check_digit": _with("l AS (SELECT doc_id, string_split(mrz_text, chr(10)) AS l FROM bridge)", f"u AS (SELECT doc_id, w, unnest(range(1, length(s) + 1)) AS i, s FROM (SELECT doc_id, 1 AS w, l[1] AS s FROM l UNION ALL SELECT doc_id, 2, concat(l[1], l[2]) FROM l))", f"s AS (SELECT doc_id, w, CASE WHEN bool_or(NOT regexp_matches(substr(s, i, 1), '[0-9A-Z<]')) THEN -1 ELSE sum(CASE WHEN substr(s, i, 1) = '<' THEN 0 ELSE greatest(instr('{VALUES}', substr(s, i, 1)) - 1, 0) END * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END) % 10 END AS v FROM u GROUP BY 1, 2)") + "SELECT doc_id, CAST(max(v) FILTER (w = 1) AS INT) AS first, CAST(max(v) FILTER (w = 2) AS INT) AS \"both\" FROM s GROUP BY 1",
    "detect_format": _with(_NORMAL) + "SELECT doc_id, CAST(len(g) AS INT) AS n_lines, expected, kind AS doc_type, CAST(CASE WHEN kind IS NULL THEN 0 ELSE len(list_filter(g, lambda x: length(x) <> expected)) END AS INT) AS n_length_issues FROM r",
    "field_project": _with(_NORMAL) + "SELECT doc_id, code AS document_code, iss AS issuing_country, name, num AS document_number, nat AS nationality, bir AS birth_date, sx AS sex, ex AS expiry_date, opt1 AS optional_data1, opt2 AS optional_data2 FROM r WHERE kind IS NOT NULL",
    "verify_checks": _with(_NORMAL, _CHECKED) + "SELECT doc_id, s1 AS document_number_check, s2 AS birth_date_check, s3 AS expiry_date_check, s4 AS optional_data_check, s5 AS composite_check, 'Invalid' NOT IN (s1, s2, s3, s4, s5) AS all_valid, number, optional FROM c",
    "split_names": _with(_NORMAL) + f"SELECT doc_id, {_SPACED('string_split(name, ' + chr(39) + '<<' + chr(39) + ')[1]')} AS primary_name, {_SPACED('substr(name, CASE WHEN instr(name, ' + chr(39) + '<<' + chr(39) + ') = 0 THEN length(name) + 1 ELSE instr(name, ' + chr(39) + '<<' + chr(39) + ') + 2 END)')} AS secondary_name FROM r WHERE kind IS NOT NULL",
    "sex_map": _with(_NORMAL) + "SELECT doc_id, CASE sx WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE 'Unspecified' END AS sex, sx NOT IN ('M', 'F', '<') AS reported FROM r WHERE kind IS NOT NULL",
    "parse_dates": _with(_NORMAL, f"d AS (SELECT doc_id, {_iso(_BIRTH_YEAR, 'bir')} AS birth, {_iso(_EXPIRY_YEAR, 'ex')} AS expiry FROM r WHERE kind IS NOT NULL)") + f"SELECT doc_id, birth, expiry, {_day('birth')} AS birth_day, {_day('expiry')} AS expiry_day, instr(birth, '?') = 0 AS complete FROM d",
    "country_check": _with(_NORMAL) + f"SELECT field, issuer, count(*) AS n FROM (SELECT 'IssuingCountry' AS field, iss AS issuer FROM r WHERE kind IS NOT NULL AND iss NOT IN {_KNOWN} UNION ALL SELECT 'Nationality', iss FROM r WHERE kind IS NOT NULL AND nat NOT IN {_KNOWN}) GROUP BY 1, 2",
    "mandatory_content": _with(_NORMAL, _CHECKED) + "SELECT doc_id, replace(name, '<', '') = '' OR name LIKE '<<%' AS no_name, number = '' AS no_number, CASE WHEN kind = 'Td3' THEN code[1] <> 'P' WHEN kind LIKE 'Mrv%' THEN code[1] <> 'V' ELSE code[1] NOT IN ('I', 'A', 'C') END AS bad_code FROM c",
    "checks_tally": _with(_NORMAL, _CHECKED) + "SELECT field, status, count(*) AS n FROM (SELECT unnest(['document_number', 'birth_date', 'expiry_date', 'optional_data', 'composite']) AS field, unnest([s1, s2, s3, s4, s5]) AS status FROM c) GROUP BY 1, 2",
    "value_percentiles": "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, max(value) FILTER (i = ceil(0.25 * n)) AS p25, max(value) FILTER (i = ceil(0.5 * n)) AS p50, max(value) FILTER (i = ceil(0.9 * n)) AS p90 FROM s GROUP BY 1",
    "rolling_sightings": "SELECT user_id AS session_id, event_id AS frame_no, event_type AS identity, CAST((SELECT count(*) FROM (SELECT 1)) AS BIGINT) * CAST(len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), lambda t: t = event_type)) AS BIGINT) AS sightings FROM events",
    "vote_fusion": "WITH f AS (SELECT event_type AS session_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS line, CAST(round(value, 2) AS DECIMAL(18, 2)) AS weight FROM events), c AS (SELECT session_id, i AS pos, substr(line, i, 1) AS ch, sum(weight) AS w FROM f, range(1, 9) r(i) GROUP BY 1, 2, 3), b AS (SELECT session_id, pos, ch, row_number() OVER (PARTITION BY session_id, pos ORDER BY w DESC, ch) AS k FROM c) SELECT session_id, string_agg(ch, '' ORDER BY pos) AS fused FROM b WHERE k = 1 GROUP BY 1",
    "mean_template": "WITH u AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim FROM embeddings) SELECT CAST(label AS INT) AS label, CAST(dim AS INT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 2",
    "histogram_percentile": "WITH h AS (SELECT event_type, CAST(least(greatest(floor(value), 0), 255) AS INT) AS bin FROM events), s AS (SELECT event_type, bin, row_number() OVER (PARTITION BY event_type ORDER BY bin) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h) SELECT event_type, coalesce(min(bin) FILTER (i >= t05 AND t05 > 0), 0) AS p05, coalesce(min(bin) FILTER (i >= t50 AND t50 > 0), 0) AS p50, coalesce(min(bin) FILTER (i >= t95 AND t95 > 0), 0) AS p95 FROM (SELECT *, n * 5 // 100 AS t05, n * 50 // 100 AS t50, n * 95 // 100 AS t95 FROM s) GROUP BY 1",
    "least_squares": "SELECT CAST(l_linenumber AS INT) AS line, round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 3) AS slope, round(regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 2) AS intercept FROM lineitem GROUP BY 1",
}
