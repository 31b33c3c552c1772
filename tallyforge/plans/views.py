"""Statement-shaped inputs derived from the star schema, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TXN = """
SELECT o_orderkey AS row_id, 'ACC-' || CAST(o_custkey % 50 AS STRING) AS account, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
  (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount,
  CASE o_custkey % 4 WHEN 0 THEN 'SGD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'JPY' END AS currency,
  o_orderpriority AS description, CAST(o_orderkey % 3 AS INT) AS file
FROM {orders}
"""

#: Orders seen by two or three files: what cross-file duplicates are found in.
SEEN = f"""
SELECT row_id * 10 AS row_id, account, date, amount, currency, description, file FROM ({TXN}) a
UNION ALL SELECT row_id * 10 + 1, account, date, amount, currency, description, (file + 1) % 3 FROM ({TXN}) b WHERE row_id % 4 = 0
UNION ALL SELECT row_id * 10 + 2, account, date, amount, currency, 'other ' || description, (file + 1) % 3 FROM ({TXN}) c WHERE row_id % 7 = 0
UNION ALL SELECT row_id * 10 + 3, account, date, amount, currency, description, file FROM ({TXN}) d WHERE row_id % 5 = 0
"""

#: Statements with a running balance per account; every 97th row states a wrong one.
RUNNING = f"""
SELECT *, 100000 + sum(amount) OVER (PARTITION BY account ORDER BY date, row_id ROWS UNBOUNDED PRECEDING) + (CASE WHEN row_id % 97 = 0 THEN 500 ELSE 0 END) AS stated
FROM ({TXN}) t
"""

_DAY = "lpad(CAST(EXTRACT(DAY FROM d) AS STRING), 2, '0') || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(EXTRACT(MONTH FROM d) AS INT) * 3 - 2, 3) || ' ' || CAST(EXTRACT(YEAR FROM d) AS STRING)"
_NUMBER = "CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS STRING)"
#: A customer's orders as the lines of a grouped statement: preamble, dates, descriptions above or before amounts, type lines, footers and balances.
LINES = f"""
SELECT o_custkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey, k) AS INT) AS line, k, o_orderkey, {_DAY} AS day_text, CAST(d AS STRING) AS iso,
  CASE k WHEN 0 THEN 'Statement of account ' || CAST(o_custkey AS STRING) WHEN 1 THEN {_DAY} WHEN 2 THEN 'Paid to ' || substr(o_orderpriority, 3) WHEN 4 THEN 'Card service'
    WHEN 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Shop ' || substr(o_orderpriority, 3) || ' ' END || CASE WHEN o_orderkey % 5 = 0 THEN 'EUR ' ELSE 'SGD ' END || CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '' END || {_NUMBER}
    WHEN 5 THEN 'Available balance SGD ' || {_NUMBER} ELSE 'Page ' || CAST(o_orderkey % 9 + 1 AS STRING) || ' of 9' END AS text
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS of_day FROM {{orders}}) o
JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) kinds
ON k = 0 AND nth = 1 OR k = 1 AND of_day = 1 OR k = 2 AND o_orderkey % 3 = 0 OR k = 3 OR k = 4 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 OR k = 5 AND o_orderkey % 11 = 0 OR k = 6 AND o_orderkey % 13 = 0
"""

#: A customer's orders as items of a columns statement: date, description and money out, money in or a balance at their places.
ITEMS = """
SELECT o_custkey AS file_id, line, CAST(c AS INT) AS c,
  CAST(CASE c WHEN 0 THEN 40 WHEN 1 THEN 130 WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 330 ELSE 420 END + o_orderkey % 7 ELSE 510 + o_orderkey % 5 END AS DOUBLE) AS x,
  CASE c WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN o_orderpriority WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS STRING) ELSE CAST(o_orderkey AS STRING) || '.00' END AS str
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS line FROM {orders}) o JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) cs ON c < 3 OR o_custkey % 2 = 0
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TXN, orders=orders(spark, sf_dir))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEEN, orders=orders(spark, sf_dir))


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(RUNNING, orders=orders(spark, sf_dir))
    return df.selectExpr("row_id", "account", "date", "amount", "currency", "CASE WHEN row_id % 11 <> 0 THEN CAST(stated AS BIGINT) END AS balance")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, orders=orders(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS, orders=orders(spark, sf_dir))


def duck(view: str) -> str:
    return view.replace("{orders}", "orders")


DUCK_RUNNING = f"SELECT row_id, account, date, amount, currency, CASE WHEN row_id % 11 <> 0 THEN CAST(stated AS BIGINT) END AS balance FROM ({duck(RUNNING)}) r"
