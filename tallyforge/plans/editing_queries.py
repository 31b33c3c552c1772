"""Queries over edits, layouts, exports, resolved duplicates and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import export, layouts, ledger, review, status
from tallyforge.plans.queries import _FP, _NK, S
from tallyforge.plans.registry import T, query, read
from tallyforge.plans.views import seen, txn
from tallyforge.streaming import ingest
from tallyforge.streaming.folders import shared_folder

# --- edits -----------------------------------------------------------------

#: Events of transactions: up to seven a row, of every kind, in an order that differs from row to row.
_LOG = """
SELECT row_id, row_id * 10 + k AS seq, CASE (row_id * 7 + k * 5 + row_id DIV 3) % 11 WHEN 0 THEN 'edit' WHEN 1 THEN 'exclude' WHEN 2 THEN 'restore' WHEN 3 THEN 'confirm' WHEN 4 THEN 'use_alt' WHEN 5 THEN 'edit' WHEN 6 THEN 'edit_cell' WHEN 7 THEN 'treat' WHEN 8 THEN 'confirm_low' WHEN 9 THEN 'edit_cell' ELSE 'undo' END AS action,
  CASE WHEN (row_id + k) % 3 = 0 THEN 'amount' ELSE 'date' END AS field,
  CASE WHEN (row_id + k) % 13 = 0 THEN NULL WHEN (row_id + k) % 3 = 0 THEN CAST(row_id * 3 + k AS STRING) ELSE '2020-01-0' || CAST(k + 1 AS STRING) END AS value
FROM (SELECT o_orderkey AS row_id FROM {orders}) o JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) ks ON k < row_id % 8
"""

#: The walk keeps a row's whole state and a stack of earlier ones, and takes one event at a time.
_S = "struct_pack(amount := {a}, date := {d}, flags := {f}, excluded := {x}, edited := {e}, confirmed := {c}, skipped := {k}, oa := {oa}, od := {od})"
_AFTER_EDIT = _S.format(
    a="CASE WHEN put AND field = 'amount' THEN CAST(value AS BIGINT) WHEN alt THEN other ELSE s.amount END", d="CASE WHEN put AND field = 'date' THEN value ELSE s.date END",
    f="CASE WHEN alt THEN [f FOR f IN s.flags IF f <> 'low_confidence_ocr'] ELSE s.flags END", x="CASE action WHEN 'exclude' THEN true WHEN 'restore' THEN false ELSE s.excluded END", e="s.edited OR put OR alt", c="s.confirmed",
    k="s.skipped AND action <> 'treat'", oa="CASE WHEN s.oa IS NULL AND (alt OR put AND field = 'amount') THEN coalesce(CAST(s.amount AS VARCHAR), 'none') ELSE s.oa END",
    od="CASE WHEN s.od IS NULL AND put AND field = 'date' THEN coalesce(s.date, 'none') ELSE s.od END",
)
_LACKS = "(f = 'missing_amount' AND n.amount IS NULL OR f = 'unparseable_date' AND n.date IS NULL)"
_AFTER_FLAGS = _S.format(
    a="n.amount", d="n.date", x="n.excluded", e="n.edited", k="n.skipped", oa="n.oa", od="n.od",
    f=f"CASE WHEN sure THEN [f FOR f IN n.flags IF f IN ('ocr', 'manually_added') OR {_LACKS}] WHEN action = 'treat' THEN list_concat(list_concat(n.flags, CASE WHEN n.date IS NULL AND NOT list_contains(n.flags, 'unparseable_date') THEN ['unparseable_date'] ELSE [] END), CASE WHEN n.amount IS NULL AND NOT list_contains(n.flags, 'missing_amount') THEN ['missing_amount'] ELSE [] END) ELSE n.flags END",
    c=f"CASE WHEN sure THEN len([f FOR f IN n.flags IF {_LACKS}]) = 0 ELSE n.confirmed END",
)


@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY seq) AS nth FROM ({_LOG.replace("{orders}", "orders").replace(" DIV ", " // ")})),
t AS (SELECT row_id, CASE WHEN row_id % 6 <> 0 THEN amount END AS amount, CASE WHEN row_id % 8 <> 0 THEN date END AS date, CASE WHEN row_id % 3 = 0 THEN amount * 2 END AS other, row_id % 5 = 0 AS skipped,
  [f FOR f IN ['ocr', CASE WHEN row_id % 2 = 0 THEN 'low_confidence_ocr' END, CASE WHEN row_id % 6 = 0 THEN 'missing_amount' END, CASE WHEN row_id % 16 = 0 THEN 'unparseable_date' END] IF f IS NOT NULL] AS flags FROM {T}),
walk AS (
  SELECT row_id, 0::BIGINT AS nth, other, s, [s][2:] AS stack FROM (SELECT row_id, other, {_S.format(a="amount", d="date", f="flags", x="false", e="false", c="false", k="skipped", oa="NULL::VARCHAR", od="NULL::VARCHAR")} AS s FROM t)
  UNION ALL
  SELECT row_id, nth, other, CASE WHEN action = 'undo' THEN CASE WHEN len(stack) > 0 THEN stack[len(stack)] ELSE s END ELSE {_AFTER_FLAGS} END,
    CASE WHEN action IN ('edit', 'exclude', 'confirm', 'use_alt') THEN list_append(stack, s) WHEN action = 'undo' AND len(stack) > 0 THEN stack[1 : len(stack) - 1] ELSE stack END
  FROM (
    SELECT row_id, nth, other, s, stack, action, action IN ('edit', 'confirm') OR action = 'confirm_low' AND list_contains(s.flags, 'low_confidence_ocr') AS sure, {_AFTER_EDIT} AS n
    FROM (SELECT e.row_id, e.nth, other, s, stack, action, field, value, action IN ('edit', 'edit_cell') AS put, action = 'use_alt' AND other IS NOT NULL AS alt FROM walk w JOIN e ON e.row_id = w.row_id AND e.nth = w.nth + 1) x
  ) y
)
SELECT row_id, s.amount AS amount, s.date AS date, s.excluded AS excluded, s.edited AS edited, s.confirmed AS confirmed, s.skipped AS skipped, array_to_string(s.flags, ';') AS flags, s.oa AS amount_was, s.od AS date_was
FROM (SELECT row_id, arg_max(s, nth) AS s FROM walk GROUP BY row_id)
""")
def edit_01_to_09_13_to_16_join_17_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a log of every kind of event, applied in order, with what was there before the first edit of a field."""
    i = F.col("row_id")
    flags = F.array_compact(F.array(F.lit("ocr"), *[F.when(i % n == 0, f) for n, f in ((2, "low_confidence_ocr"), (6, "missing_amount"), (16, "unparseable_date"))]))
    rows = txn(spark, sf_dir).select("row_id", F.when(i % 6 != 0, F.col("amount")).alias("amount"), F.when(i % 8 != 0, F.col("date")).alias("date"), F.when(i % 3 == 0, F.col("amount") * 2).alias("amount_alt"), (i % 5 == 0).alias("skipped"), flags.alias("flags"))
    out = review.apply_events(rows, spark.sql(_LOG, orders=read(spark, sf_dir, "orders")), {"amount": "bigint", "date": "string"})
    was = lambda f: F.when(F.map_contains_key("edited_fields", f), F.coalesce(F.col("edited_fields")[f], F.lit("none"))).alias(f"{f}_was")
    return out.select("row_id", "amount", "date", "excluded", "edited", "confirmed", "skipped", F.array_join("flags", ";").alias("flags"), was("amount"), was("date"))


@query("SELECT place, description FROM (SELECT o_orderkey::DOUBLE AS place, o_orderpriority AS description FROM orders UNION ALL SELECT o_orderkey + 1 / 3, 'first' FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey + 2 / 3, 'second' FROM orders WHERE o_orderkey % 4 = 0)")
def edit_12_add_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows added behind every fourth."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("description"))
    after = o.filter("place % 4 = 0").select(F.col("place").alias("after"))
    added = after.select("after", F.lit(1).alias("n"), F.lit("first").alias("description")).unionByName(after.select("after", F.lit(2).alias("n"), F.lit("second").alias("description")))
    return review.add_manual_rows(o, added, "place").select("place", "description")


# --- layouts ---------------------------------------------------------------


@query(f"""SELECT row_id, strftime(CAST(date AS DATE), '%d/%m/%Y') || ';fixed;' || currency || ';' || description || ';' || CASE WHEN currency = 'JPY' THEN CAST(amount AS STRING) ELSE printf('%.2f', amount / 100) END AS line FROM {T}""")
def lay_01_to_08_10_arr_11_12_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout built step by step, changed, reordered and switched, and applied to rows."""
    lay = export.Layout("mine").add("date", "Date").add("amount", "Amount").add("amount", "Again").add("const", "Kind", "old").add("description", "Text").add("currency", "Money").add("account", "Account")
    lay = lay.change(2, value="fixed").toggle(5).remove(5).move(1, 4).reorder([0, 1, 3]).change(0, name="Day").option("date_format", "DD/MM/YYYY")
    return export.delimited(txn(spark, sf_dir), lay, ("row_id",), ";")


#: Up to three saved layouts of each customer: fixed ones, and one with repeated fields; some without a name, some without an enabled column.
_PRESETS = ["date,description_raw,amount", "date,account_label,description_raw,amount,currency", "date,account_label,description_raw,amount,currency,balance", "date,description_raw,amount,category", "date,description_raw,money_out,money_in,balance", "date,date,blank,amount,blank,date"]
_SAVED = f"""
SELECT owner * 10 + k AS layout_id, owner, k AS place, CASE WHEN k = 2 AND owner % 7 = 0 THEN ' ' ELSE 'L' || k END AS name, owner % 3 = 0 AS swapped, (owner + k // 2) % 6 AS kind, k = 1 AND owner % 13 = 0 AS off,
  string_split({_PRESETS}[(owner + k // 2) % 6 + 1], ',') AS fields
FROM (SELECT c_custkey AS owner FROM customer), (SELECT unnest([0, 1, 2]) AS k) WHERE owner % 10 <> 9 OR k = 0
"""


def _saved_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.explode(F.array(*map(F.lit, range(3)))).alias("place")).filter("owner % 10 != 9 OR place = 0")
    kind = (F.col("owner") + F.floor(F.col("place") / 2)) % 6
    key = F.element_at(F.array(*map(F.lit, (*export.LAYOUTS, "own"))), (kind + 1).cast("int"))
    columns = F.coalesce(layouts.preset(key), layouts.columns_of(tuple((f, f.title()) for f in _PRESETS[5].split(","))))
    off = (F.col("place") == 1) & (F.col("owner") % 13 == 0)
    shown = F.transform(columns, lambda x: F.struct(x["field"], x["name"], (~off).alias("enabled"), x["value"])).cast(layouts.COLUMNS)
    return c.select(
        (F.col("owner") * 10 + F.col("place")).alias("layout_id"), "owner", "place", F.when((F.col("place") == 2) & (F.col("owner") % 7 == 0), " ").otherwise(F.concat(F.lit("L"), F.col("place").cast("string"))).alias("name"),
        F.when(F.col("owner") % 3 == 0, "DD/MM/YYYY").otherwise("YYYY-MM-DD").alias("date_format"), F.lit(None).cast("string").alias("sign_convention"), F.lit(True).alias("header_row"), shown.alias("columns"),
    )


@query(f"""
WITH s AS ({_SAVED})
SELECT layout_id, array_to_string([f FOR f, i IN fields IF f = 'blank' OR list_position(fields, f) = i], ',') AS fields, CASE kind WHEN 0 THEN 'simple' WHEN 1 THEN 'withAccount' WHEN 2 THEN 'withBalance' WHEN 3 THEN 'budgetApp' WHEN 4 THEN 'accounting' END AS matched,
  (name = ' ')::INT + off::INT AS problems, kind = 0 AS is_default, array_to_string(CASE WHEN off THEN [] ELSE [f FOR f IN fields IF f <> 'balance' OR owner % 2 = 0] END, ',') AS visible
FROM s
""".replace("[f FOR f, i IN fields IF f = 'blank' OR list_position(fields, f) = i]", "list_filter(fields, lambda f, i: f = 'blank' OR list_position(fields, f) = i)"))
def lay_11_12_14_18_set_03_grid_05_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' saved layouts: repeated fields taken out, fixed layouts recognised, problems told, and what is shown of them."""
    s = _saved_layouts(spark, sf_dir)
    shown = layouts.visible_columns("columns", F.col("owner") % 2 == 0)
    simple = F.array(*[F.lit(f) for f, _ in export.LAYOUTS["simple"]])
    return s.select("layout_id", F.array_join(layouts.fields(layouts.first_of_each("columns")), ",").alias("fields"), layouts.matching("columns").alias("matched"), F.size(layouts.problems(F.col("name"), F.col("columns"))).alias("problems"), (layouts.fields("columns") == simple).alias("is_default"), F.array_join(layouts.fields(shown), ",").alias("visible"))


@query(f"""
WITH s AS ({_SAVED}), o AS (SELECT *, owner % 4 = 0 AS stored FROM (SELECT DISTINCT owner FROM s)),
w AS (SELECT o.owner, CASE WHEN stored THEN 1 WHEN owner % 5 < (SELECT count(*) FROM s WHERE s.owner = o.owner) THEN owner % 5 ELSE 0 END AS place, stored AND owner % 8 = 0 AS changed FROM o),
x AS (SELECT w.owner, w.changed, s.kind, s.off FROM w JOIN s ON s.owner = w.owner AND s.place = CASE WHEN w.owner % 10 = 9 THEN 0 ELSE w.place END)
SELECT x.owner, coalesce((SELECT arg_min(s.name, s.place) FROM s WHERE s.owner = x.owner AND s.kind = x.kind AND s.off = x.off AND NOT x.changed), 'Last used') AS label FROM x
""")
def lay_15_16_17_working_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's layout to work with (stored, at a place, or the first), and the name of the saved one that it equals."""
    s = _saved_layouts(spark, sf_dir)
    kept = F.struct("name", "date_format", "sign_convention", (F.col("owner") % 8 != 0).alias("header_row"), "columns")
    stored = s.filter("owner % 4 = 0 AND (place = 1 OR owner % 10 = 9)").select("owner", kept.alias("stored"))
    owners = s.select("owner").distinct().join(stored, "owner", "left").withColumn("start", (F.col("owner") % 5).cast("int"))
    return layouts.picker_labels(layouts.working_layouts(owners, s), s)


@query("""
SELECT o_custkey AS account, 'date,account_label,description_raw,amount,currency' || CASE WHEN bool_or(o_orderkey % 50 = 0) THEN ',reference' ELSE '' END || CASE WHEN bool_or(o_orderstatus = 'P') THEN ',type' ELSE '' END || CASE WHEN bool_or(o_orderkey % 70 = 0) THEN ',orig_amount,orig_currency' ELSE '' END AS fields,
  NOT bool_or(o_orderkey % 50 = 0 OR o_orderkey % 70 = 0 OR o_orderstatus = 'P') AS is_plain
FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey
""")
def set_01_lay_19_union_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union layout of every account: optional columns where some of its active rows hold something."""
    i = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.when(i % 50 == 0, "r").otherwise("").alias("reference"), F.when(F.col("o_orderstatus") == "P", "p").alias("type"), F.when(i % 70 == 0, "EUR").otherwise("SGD").alias("orig_currency"), F.lit("SGD").alias("currency"), (i % 4 == 0).alias("skipped"))
    plain = F.array(*[F.lit(f) for f, _ in export.UNION])
    return layouts.union_layouts(rows, "account").select("account", F.array_join(layouts.fields("columns"), ",").alias("fields"), (layouts.fields("columns") == plain).alias("is_plain"))


@query("""
SELECT 'extra_' || lower(regexp_replace(n_name, '[^A-Za-z]', '_', 'g')) AS field, array_to_string([upper(substr(x, 1, 1)) || substr(x, 2) FOR x IN string_split(lower(regexp_replace(n_name, '[^A-Za-z]', ' ', 'g')), ' ')], ' ') AS name FROM nation UNION SELECT 'extra_branch', 'Branch'
""")
def set_04_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "nation").select(F.array(F.concat(F.lit("extra_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_"))), F.lit("extra_branch")).alias("extras"))
    return export.extra_fields(["date", "extra_branch"], v)


@query(f"""
SELECT row_id, CASE currency WHEN 'SGD' THEN amount WHEN 'USD' THEN CAST(floor(amount * 1.35::DOUBLE + 0.5) AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS amount, CASE WHEN currency IN ('SGD', 'USD') THEN 'SGD' END AS currency, amount AS orig_amount, currency AS orig_currency
FROM {T} WHERE date BETWEEN '1995-01-01' AND '1996-12-31' AND row_id % 7 <> 0
""")
def lay_20_21_22_uix_15_rows_for_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows in a range, converted."""
    rates = spark.createDataFrame([("USD", "SGD", None, 1.35)], "source string, target string, month string, rate double")
    rows = txn(spark, sf_dir).withColumn("excluded", F.col("row_id") % 7 == 0)
    return export.rows_for_export(rows, "1995-01-01", "1996-12-31", "SGD", rates).select("row_id", "amount", "currency", "orig_amount", "orig_currency")


@query(f"""
WITH m AS (SELECT account, '1996-06-30' AS marker FROM (SELECT DISTINCT account FROM {T}) WHERE right(account, 1) <> '3' UNION ALL SELECT 'gone', '1990-01-01'), n AS (SELECT account, max(date) AS d FROM {T} WHERE row_id % 3 = 0 GROUP BY account)
SELECT coalesce(m.account, n.account) AS account, CASE WHEN d IS NULL OR marker >= d THEN marker ELSE d END AS marker FROM m FULL JOIN n ON m.account = n.account
""")
def lay_23_mark_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir)
    markers = rows.select("account").distinct().filter("account NOT LIKE '%3'").withColumn("marker", F.lit("1996-06-30")).union(spark.createDataFrame([("gone", "1990-01-01")], "account string, marker string"))
    return export.mark_exported(markers, rows.filter("row_id % 3 = 0"))


@query(f"SELECT CASE WHEN min(date) = max(date) THEN 'statement-export_' || min(date) ELSE 'statement-export_' || min(date) || '_' || max(date) END || '.csv' AS name FROM {T}")
def snk_05_suggest_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = txn(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(export.filename_of("a", "b").alias("name"))


# --- duplicates ------------------------------------------------------------

_PAIRS = f"""
s AS (SELECT row_id, file, {_NK} AS nk, {_FP} AS fp FROM {S}), p AS (
  SELECT a.nk, a.file AS fa, b.file AS fb, min((a.row_id, b.row_id))[2] AS row_b FROM s a JOIN s b ON a.nk = b.nk AND a.file < b.file AND a.fp <> b.fp
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.nk = a.nk AND x.file = b.file AND x.fp = a.fp) AND NOT EXISTS (SELECT 1 FROM s x WHERE x.nk = a.nk AND x.file = a.file AND x.fp = b.fp) GROUP BY ALL)
"""


@query(f"WITH {_PAIRS} SELECT file, count(*) AS removed FROM (SELECT DISTINCT file, s.row_id FROM s JOIN p ON s.row_id = p.row_b WHERE hash_free % 2 = 0) GROUP BY file".replace("hash_free", "length(p.nk)"))
def strm_06_07_uix_13_resolve_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs that people merged or kept, by the length of their key; what that took out of each file. Undone, nothing is."""
    rows = seen(spark, sf_dir)
    pairs = ledger.near_pairs(rows)
    choices = pairs.select("nk", F.when(F.length("nk") % 2 == 0, "merge").otherwise("both").alias("choice")).distinct()
    done = ledger.resolve_pairs(rows.withColumn("kept", F.lit(True)), pairs, choices)
    nothing = ledger.dedupe_notice(ledger.undo_dedupe(done))
    return ledger.dedupe_notice(done).unionByName(nothing)


@query(f"SELECT account, count(*) AS n, count(DISTINCT file) AS files FROM {S} GROUP BY account")
def set_02_uix_17_18_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active rows of all files, per account."""
    return ledger.active(seen(spark, sf_dir)).groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


_ARRIVED = f"""
WITH s AS (SELECT *, {_FP} AS fp FROM {S} WHERE file <> 9), c AS (SELECT fp, file, count(*) AS n FROM s GROUP BY fp, file), w AS (SELECT fp, arg_max(file, n * 10 - file) AS winner FROM c GROUP BY fp)
SELECT row_id, file = winner AS kept FROM s JOIN w USING (fp)
"""


@query(_ARRIVED)
def strm_05_merge_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files that arrive one after another, merged each time; the table is as if all had come at once."""
    at = shared_folder(spark)
    rows = seen(spark, sf_dir)
    schema = "row_id long, account string, date string, amount long, currency string, description string, file int"
    typed = rows.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])
    for file in (2, 0, 1):
        typed.filter(F.col("file") == file).write.mode("append").parquet(f"{at}/in")
        ingest.merge_arrivals(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/table", f"{at}/state")
    return spark.read.parquet(f"{at}/table").select("row_id", "kept")


@query(f"""
WITH s AS (SELECT *, {_FP} AS fp FROM {S} WHERE file <> 0), c AS (SELECT fp, file, count(*) AS n FROM s GROUP BY fp, file), w AS (SELECT fp, arg_max(file, n * 10 - file) AS winner FROM c GROUP BY fp)
SELECT file, count(*) FILTER (file = winner) AS kept, count(*) FILTER (file <> winner) AS gone FROM s JOIN w USING (fp) GROUP BY file
""")
def uix_14_remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file taken out, and the others merged again without it."""
    left = ledger.merge_across_files(seen(spark, sf_dir).filter("file <> 0"))
    return left.groupBy("file").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("gone"))


@query("SELECT user_id AS file_id, max(event_id)::BIGINT AS pages_done, arg_max(event_id % 17, event_id)::BIGINT AS n_rows FROM events GROUP BY user_id")
def strm_03_partial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after each page of files still being read: the latest replaces the others."""
    return ingest.latest_pages(read(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("pages_done"), (F.col("event_id") % 17).alias("n_rows")))


@query("""
SELECT o_custkey AS file_id, count(*) FILTER (o_orderkey % 4 <> 0) AS n, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 AND o_orderstatus <> 'F' THEN o_orderkey ELSE 0 END) AS BIGINT) AS total_in, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 AND o_orderstatus = 'F' THEN o_orderkey ELSE 0 END) AS BIGINT) AS total_out,
  bool_and(o_orderkey % 4 = 0 OR o_orderstatus <> 'F' OR o_orderkey = 0) AS all_in, count(*) AS lines, CASE WHEN count(*) FILTER (o_orderkey % 4 <> 0) = count(*) THEN 'ok' WHEN count(*) FILTER (o_orderkey % 4 = 0) <= 0.05 * count(*) THEN 'neutral' ELSE 'fail' END AS check
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 4 <> 0) > 0
""")
def uix_25_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("amount"), (F.col("o_orderkey") % 4 == 0).alias("skipped"))
    return status.review_summary(o, o)


@query("SELECT o_custkey, bool_or(o_orderkey % 20 = 0) AS reference, bool_or(o_orderstatus = 'P') AS balance FROM orders GROUP BY o_custkey")
def uix_24_shown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 20 == 0, "r").otherwise("").alias("reference"), F.when(F.col("o_orderstatus") == "P", 5).alias("balance"))
    return status.shown_columns(o, ["reference", "balance"], "o_custkey")


# --- privacy ---------------------------------------------------------------


@query("""
SELECT event_id, 'paid #,###.## by ' || CASE WHEN length(CAST(user_id + 1000000 AS STRING)) >= 6 THEN repeat('#', length(CAST(user_id + 1000000 AS STRING))) END AS message, event_type || '=' || event_type AS stage, '<text ' || length(CAST(event_id AS STRING)) + 6 || ' chars>' AS detail FROM events
""")
def priv_06_arr_13_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events without amounts, long numbers and free text; values of safe keys stay."""
    e = read(spark, sf_dir, "events")
    message = F.concat(F.lit("paid 1,234.56 by "), (F.col("user_id") + 1000000).cast("string"))
    data = F.create_map(F.lit("stage"), F.concat_ws("=", "event_type", "event_type"), F.lit("detail"), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    clean = text.redact_entries(data, ("stage",))
    return e.select("event_id", text.mask_digit_runs(text.mask_amounts(message)).alias("message"), clean["stage"].alias("stage"), clean["detail"].alias("detail"))


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, event_type FROM events)
SELECT user_id, count(*) AS n, string_agg('read mine and <file> in ' || event_type, '|' ORDER BY event_id) FILTER (r <= 3) AS stages FROM e GROUP BY user_id
""")
def priv_09_10_snk_09_10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem report for each user as JSON, read back: the last three messages, without file names."""
    message = F.concat(F.lit("read known.csv and other.pdf in "), F.col("event_type"))
    clean = text.redact_stack(text.strip_filenames(message, {"known.csv": "mine"}))
    r = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("event_id", clean.alias("m")))).alias("all"))
    last = F.slice("all", F.greatest(F.size("all") - 2, F.lit(1)), 3)
    report = r.select("user_id", F.to_json(F.struct(F.lit("problem-report").alias("kind"), "n", F.transform(last, lambda e: e["m"]).alias("stages"))).alias("json"))
    back = F.from_json("json", "kind string, n long, stages array<string>")
    return report.select("user_id", back.alias("b")).select("user_id", "b.n", F.array_join("b.stages", "|").alias("stages"))
