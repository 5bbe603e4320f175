"""Machine-readable zones made from the driver's ``orders`` and ``customer`` tables.

Test scaffolding: the tables hold no MRZ, so rows become MRZ text of the five
layouts with known defects.  One template renders to Spark SQL and DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..formats import VALUES

CODES = "UTO D<< GBR USA FRA ITA ESP NLD BEL CHE AUT POL SWE NOR DNK FIN IRL PRT GRC CZE HUN ROU JPN CAN AUS".split()


#: Every third of fifteen hexadecimal digits, from the last.
_THIRDS = 0xF00F00F00F00F


def cd(x: str, duck: bool, most: int = 15) -> str:
    """SQL of the check digit of ``x``, a text of up to ``most`` characters; those outside the alphabet count 0.

    Spark's form writes the values' last digits as hexadecimal numbers of fifteen digits.  Every
    third digit of one, by a mask, adds up to its remainder by 4095: no step goes character by character.
    """
    if duck:
        return f"(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: greatest(instr('{VALUES}', substr({x}, i, 1)) - 1, 0) * list_extract([7, 3, 1], (i - 1) % 3 + 1))), 0) % 10)"
    size = -(-most // 15) * 15
    digits = f"translate(rpad({x}, {size}, '<'), '{VALUES}<#-', '{"".join(str(v % 10) for v in range(len(VALUES)))}000')"
    words = ", ".join(f"CAST(conv(substr(s, {at + 1}, 15), 16, 10) AS BIGINT)" for at in range(0, size, 15))
    total = f"7 * ((shiftright(n, 8) & {_THIRDS}) % 4095) + 3 * ((shiftright(n, 4) & {_THIRDS}) % 4095) + (n & {_THIRDS}) % 4095"
    return f"CAST(aggregate(element_at(transform(array({digits}), s -> array({words})), 1), 0L, (t, n) -> t + {total}) % 10 AS INT)"


def sql(duck: bool) -> str:
    """Common table expressions ending in ``bridge(doc_id, fmt, defect, ext, mrz_text)``."""
    c = lambda x, most=15: f"CAST({cd(x, duck, most)} AS {'VARCHAR' if duck else 'STRING'})"
    text = "VARCHAR" if duck else "STRING"
    listed = ", ".join(f"'{x}'" for x in CODES)
    code = lambda i: f"list_extract([{listed}], CAST({i} AS INT) + 1)" if duck else f"element_at(array({listed}), CAST({i} AS INT) + 1)"
    two = lambda x: f"lpad(CAST({x} AS {text}), 2, '0')"
    fill = lambda n: f"repeat('<', {n})"
    return f"""
b0 AS (SELECT o_orderkey AS k, o_orderkey % 5 AS f, o_orderkey % 23 AS d, c_custkey, c_nationkey, o_orderstatus, c_mktsegment, o_orderpriority,
  year(o_orderdate) AS y, {two("month(o_orderdate)")} AS mm, {two("day(o_orderdate)")} AS dd FROM orders JOIN customer ON o_custkey = c_custkey),
b1 AS (SELECT k, f, d,
  CASE f WHEN 0 THEN 'P<' WHEN 1 THEN 'I<' WHEN 2 THEN 'I<' ELSE 'V<' END AS code,
  CASE WHEN d = 4 THEN 'ZZZ' ELSE {code("c_nationkey")} END AS iss, {code("k % 25")} AS nat,
  CASE WHEN k % 4 = 0 THEN concat('C', lpad(CAST(k AS {text}), 7, '0'), '<') ELSE concat('C', lpad(CAST(k AS {text}), 8, '0')) END AS num,
  concat({two("(y + k % 60 - 30) % 100")}, CASE d WHEN 6 THEN '<<<<' WHEN 5 THEN concat('13', dd) ELSE concat(mm, dd) END) AS bir,
  concat({two("(y + 10 + k % 25) % 100")}, mm, dd) AS ex,
  CASE WHEN d = 7 THEN 'X' WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderstatus = 'O' THEN 'M' ELSE '<' END AS sex,
  CASE WHEN d = 10 THEN '' ELSE concat(translate(c_mktsegment, ' -', '<<'), CASE WHEN d = 8 THEN '#' ELSE '' END, '<<', translate(substr(o_orderpriority, 3), ' -', '<<')) END AS name,
  CASE WHEN k % 6 = 0 THEN '' ELSE CAST(c_custkey AS {text}) END AS opt,
  CASE WHEN f IN (1, 2) AND k % 3 = 0 AND k % 4 <> 0 THEN 1 ELSE 0 END AS ext FROM b0),
b2 AS (SELECT *, CASE WHEN ext = 1 THEN '<' ELSE {c("num")} END AS nchk,
  CASE WHEN ext = 1 THEN concat('12', {c("concat(num, '12')")}) ELSE opt END AS odata,
  CASE WHEN d = 1 THEN CAST(({cd("bir", duck)} + 1) % 10 AS {text}) ELSE {c("bir")} END AS bchk, {c("bir")} AS bgood, {c("ex")} AS echk FROM b1),
b3 AS (SELECT *,
  CASE f WHEN 1 THEN concat(code, iss, num, nchk, rpad(odata, 15, '<')) WHEN 2 THEN rpad(concat(code, iss, name), 36, '<') WHEN 4 THEN rpad(concat(code, iss, name), 36, '<')
    ELSE rpad(concat(code, iss, name), 44, '<') END AS l1,
  CASE f WHEN 1 THEN concat(bir, bgood, sex, ex, echk, nat, {fill(11)})
    WHEN 0 THEN concat(num, nchk, nat, bir, bgood, sex, ex, echk, rpad(odata, 14, '<'), CASE WHEN odata = '' THEN '<' ELSE {c("rpad(odata, 14, '<')")} END)
    WHEN 2 THEN concat(num, nchk, nat, bir, bgood, sex, ex, echk, rpad(odata, 7, '<'))
    WHEN 3 THEN concat(num, nchk, nat, bir, bgood, sex, ex, echk, rpad(odata, 16, '<'))
    ELSE concat(num, nchk, nat, bir, bgood, sex, ex, echk, rpad(odata, 8, '<')) END AS m2 FROM b2),
b4 AS (SELECT *, CASE f WHEN 1 THEN concat(m2, {c("concat(substr(l1, 6, 25), substr(m2, 1, 7), substr(m2, 9, 7), substr(m2, 19, 11))", 50)})
    WHEN 0 THEN concat(m2, {c("concat(substr(m2, 1, 10), substr(m2, 14, 7), substr(m2, 22, 22))", 39)})
    WHEN 2 THEN concat(m2, {c("concat(substr(m2, 1, 10), substr(m2, 14, 7), substr(m2, 22, 14))", 31)}) ELSE m2 END AS g2 FROM b3),
b5 AS (SELECT *, CASE WHEN d <> 1 THEN g2 WHEN f = 1 THEN concat(substr(g2, 1, 6), bchk, substr(g2, 8)) ELSE concat(substr(g2, 1, 19), bchk, substr(g2, 21)) END AS l2,
  CASE WHEN d = 2 THEN substr(l1, 1, length(l1) - 2) WHEN d = 9 THEN concat(l1, '<<<') ELSE l1 END AS p1 FROM b4),
b6 AS (SELECT *, CASE WHEN f = 1 THEN concat(p1, chr(10), l2, chr(10), rpad(name, 30, '<')) ELSE concat(p1, chr(10), l2) END AS whole FROM b5),
bridge AS (SELECT k AS doc_id, CAST(f AS INT) AS fmt, CAST(d AS INT) AS defect, ext, CASE WHEN d = 3 THEN lower(whole) ELSE whole END AS mrz_text FROM b6)"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fmt, defect, ext, mrz_text``; the customer side joins on its key, whatever its size.

    The driver's table is one file of one row group, which one task would read and
    all that follows with it: its narrow rows are dealt out first.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(f"WITH orders AS (SELECT * FROM {{orders}}), customer AS (SELECT * FROM {{customer}}), {sql(False)} SELECT * FROM bridge".replace("{{", "{").replace("}}", "}"), orders=orders, customer=customer)
