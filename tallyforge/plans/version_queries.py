"""Queries over files that carry their own version, and over candidates that are tried on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import versions
from tallyforge.operators.grid import Rule, Window
from tallyforge.operators.normalise import Transform, Version
from tallyforge.plans.registry import query, read

_FORMATS = {0: "DD/MM/YYYY", 1: "YYYY-MM-DD", 2: "MM/DD/YYYY", 3: "DD MMM YYYY"}
_SHOWN = {0: "dd/MM/yyyy", 1: "yyyy-MM-dd", 2: "MM/dd/yyyy", 3: "dd MMM yyyy"}


def _version(v: int) -> dict:
    """Ten statement types: even ones have a preamble row and one amount column, odd ones debit and credit and a line to pass over."""
    even = v % 2 == 0
    sources = {"date": ["Date"], "description_raw": ["Details"], "amount": ["Amount"]} if even else {"date": ["Posted"], "description_raw": ["Text", "More"], "debit": ["Debit"], "credit": ["Credit"]}
    return versions.config_of(
        Window(int(even), footers=(Rule("startsWith", "total"),), ignored=(Rule("contains", "brought forward"), Rule("regex", "^never$"))),
        Version(sources, _FORMATS[v % 4], "1.234,56" if v in (6, 8) else "1,234.56", "positiveIsOut" if v % 4 == 2 else "signed", "SGD", (Transform("description_raw", "lower"), Transform("description_raw", "replace", "-", " ")) if v % 5 == 0 else ()),
    )


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the file of the customer's statement type: file_id, type, v, ocr, grid."""
    v, out = F.col("o_custkey") % 10, F.col("o_orderstatus") == "F"
    price = F.format_number((F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long") + 100000).cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    price = F.when(v.isin(6, 8), F.translate(price, ",.", ".,")).otherwise(price)
    day: Column = F.date_format("o_orderdate", _SHOWN[3])
    for k in (0, 1, 2):
        day = F.when(v % 4 == k, F.date_format("o_orderdate", _SHOWN[k])).otherwise(day)
    signed = F.when(F.when(v % 4 == 2, ~out).otherwise(out), F.concat(F.lit("-"), price)).otherwise(price)
    cells = F.when(v % 2 == 0, F.array(day, "o_orderpriority", signed)).otherwise(F.array(day, "o_orderpriority", F.lit("x"), F.when(out, price).otherwise(""), F.when(out, "").otherwise(price)))
    files = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("cells")))).alias("body"))
    row = lambda *x: F.array(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    top = F.when(F.col("file_id") % 2 == 0, F.array(row("Statement of account", F.col("file_id").cast("string")), row(" Date", "Details", "Amount "))).otherwise(F.array(row("Posted", "Text", "More", "Debit", "Credit"), row("", "Balance brought forward", "", "", "9.99")))
    end = F.array(row("Total", "", "1.00"), row("2020-01-01", "after the end", "1.00", "1.00", "1.00"))
    grid = F.concat(top, F.transform("body", lambda x: x["cells"]), end)
    return files.select("file_id", F.lit("csv").alias("type"), (F.col("file_id") % 10).alias("v"), (F.col("file_id") % 3 == 0).alias("ocr"), grid.alias("grid"))


def _saved(spark: SparkSession) -> DataFrame:
    made = [{"profile_id": f"p{v}", "version_id": n, "built_in": v > 7, "created": f"2024-0{v + 1}", "config": _version(v) if n == 2 else _version((v + 1) % 10)} for v in range(10) for n in (1, 2)]
    return versions.saved_versions(spark, [*made, {"profile_id": "none", "version_id": 2, "config": {**_version(0), "first_row": 100000}}])


#: What a version reads of an order: every statement type's rows, for DuckDB.
_ROWS = """
SELECT o_custkey AS file_id, o_custkey % 10 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
  CASE WHEN o_custkey % 5 = 0 THEN replace(lower(o_orderpriority), '-', ' ') ELSE o_orderpriority END || CASE WHEN o_custkey % 2 = 1 THEN ' x' ELSE '' END AS description_raw,
  CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * (CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + 100000) AS amount
FROM orders
"""


@query(f"""
SELECT file_id, row::INT AS row, date, description_raw, amount, 'SGD' AS currency, false AS skipped,
  CASE WHEN row_number() OVER (PARTITION BY file_id, date, amount, lower(description_raw) ORDER BY row) > 1 THEN 'possible_duplicate' ELSE '' END AS flags
FROM ({_ROWS})
""")
def norm_05_grid_01_02_versions_as_a_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten statement types, each read by its own version, in one plan."""
    own = _saved(spark).filter("version_id = 2").select(F.col("profile_id").alias("own"), "config")
    files = _grids(spark, sf_dir).withColumn("own", F.concat(F.lit("p"), F.col("v").cast("string"))).join(F.broadcast(own), "own")  # eleven rows
    return versions.file_rows(files, "file_id").select("file_id", "row", "date", "description_raw", "amount", "currency", "skipped", F.array_join("flags", ";").alias("flags"))


#: Candidates of a file: types with its columns. The right one is sometimes unlikely, or missing; every 13th file has a useless one alone.
_CANDIDATES = """
SELECT file_id, profile_id, confidence, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, profile_id) AS rank FROM (
  SELECT file_id, CASE WHEN file_id % 13 = 0 THEN 'none' ELSE 'p' || CAST((v + 2 * k) % 10 AS STRING) END AS profile_id,
    CAST(CASE k WHEN 0 THEN CASE WHEN file_id % 7 = 0 THEN 0.75 ELSE 0.92 END WHEN 1 THEN 0.95 WHEN 2 THEN 0.93 WHEN 3 THEN 0.90 ELSE 0.60 END AS DOUBLE) AS confidence
  FROM {files} f JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks ON file_id % 13 <> 0 AND NOT (k = 0 AND file_id % 11 = 0) OR file_id % 13 = 0 AND k = 1
) c
"""
_F = "(SELECT o_custkey AS file_id, o_custkey % 10 AS v, count(*) AS n, count(*) FILTER (day(CAST(o_orderdate AS DATE)) <= 12) AS early FROM orders GROUP BY o_custkey)"
#: Quality by hand: equal formats read all, day and month swapped read days up to 12, the others nothing; one more line of a file looks like a transaction.
_QUALITY = f"""
c AS (SELECT c.*, v, n, early, CASE WHEN profile_id = 'none' THEN -1 ELSE CAST(substr(profile_id, 2) AS INT) END AS p FROM ({_CANDIDATES.replace("{files}", _F).replace("AS STRING", "AS VARCHAR")}) c JOIN {_F} f USING (file_id)),
q AS (SELECT *, CASE WHEN p < 0 THEN 0 WHEN p % 4 = v % 4 THEN n WHEN v % 2 = 0 THEN early ELSE 0 END AS valid FROM c),
t AS (SELECT *, CASE WHEN p < 0 THEN 0.0 ELSE round(valid / (n + 1) - 0.5 * ((n - valid) / n), 9) END AS quality, p < 0 OR (n - valid) * 2 > n AS failed, p > 7 AS built_in, CASE WHEN p < 0 THEN '' ELSE '2024-0' || (p + 1) END AS created,
  max(confidence) OVER (PARTITION BY file_id) - confidence <= 0.1 + 1e-9 AND rank <= 4 AS near FROM q)
"""


def _tried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _grids(spark, sf_dir)
    candidates = spark.sql(_CANDIDATES, files=files)
    return files, candidates.join(F.broadcast(_saved(spark).filter("version_id = 2")), "profile_id")  # eleven rows


@query(f"WITH {_QUALITY} SELECT file_id, profile_id, quality, failed FROM t")
def uix_03_agg_05_09_candidate_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate tried on its file: what it reads, against the lines that look like transactions."""
    return versions.try_candidates(*_tried(spark, sf_dir)).select("file_id", "profile_id", "quality", "failed")


@query(f"""
WITH RECURSIVE {_QUALITY},
walk AS (
  SELECT file_id, rank, profile_id, quality, built_in, created FROM t WHERE near AND rank = 1
  UNION ALL
  SELECT b.file_id, x.rank, CASE WHEN won THEN x.profile_id ELSE b.profile_id END, CASE WHEN won THEN x.quality ELSE b.quality END, CASE WHEN won THEN x.built_in ELSE b.built_in END, CASE WHEN won THEN x.created ELSE b.created END
  FROM walk b JOIN t x ON x.file_id = b.file_id AND x.rank = b.rank + 1 AND x.near, LATERAL (SELECT x.quality > b.quality OR round(b.quality - x.quality, 9) <= 0.02 AND NOT x.built_in AND (b.built_in OR x.created > b.created) AS won) w
), picked AS (SELECT file_id, arg_max(profile_id, rank) AS profile_id FROM walk GROUP BY file_id),
tried AS (SELECT t.*, pk.profile_id IS NOT NULL AS picked FROM t LEFT JOIN picked pk ON pk.file_id = t.file_id AND pk.profile_id = t.profile_id WHERE pk.profile_id IS NOT NULL OR NOT t.near OR NOT t.failed),
s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY picked DESC, rank) AS step FROM tried),
e AS (SELECT file_id, min(step) FILTER (NOT failed) AS good, max(step) AS last FROM s GROUP BY file_id)
SELECT file_id, profile_id, quality, NOT picked AS fell_back, CASE WHEN good IS NOT NULL THEN 'applied' WHEN file_id % 3 = 0 AND p < 0 THEN 'ocrFailed' ELSE 'matchFailed' END AS state FROM s JOIN e USING (file_id) WHERE step = coalesce(good, last)
""")
def win_15_uix_05_07_apply_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version used for each file: picked among near ties by what it reads, else the next that reads anything."""
    return versions.apply_matches(*_tried(spark, sf_dir)).select("file_id", "profile_id", "quality", "fell_back", "state")


@query(f"""
WITH f AS {_F}, c AS (SELECT *, (v + 2 * (file_id // 10 % 3)) % 10 AS p FROM f), r AS (SELECT *, CASE WHEN p % 4 = v % 4 THEN n WHEN v % 2 = 0 THEN early ELSE 0 END AS valid FROM c)
SELECT file_id, 'p' || p AS profile_id, 2 AS version_id, 1.0::DOUBLE AS confidence, CASE WHEN (n - valid) * 2 > n THEN 'layoutChanged' ELSE 'learn' END AS outcome FROM r
""")
def uix_08_use_existing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chosen profile's last version on each file, without fallback."""
    files = _grids(spark, sf_dir)
    choices = files.select("file_id", F.concat(F.lit("p"), ((F.col("v") + 2 * (F.floor(F.col("file_id") / 10) % 3)) % 10).cast("string")).alias("profile_id"))
    return versions.use_chosen(files, choices, _saved(spark)).select("file_id", "profile_id", "version_id", "confidence", "outcome")
