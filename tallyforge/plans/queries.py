"""Queries over whole tables, one or more an operator of the inventory, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import amounts, dates, text
from tallyforge.operators import catalogue, export, grid, infer, ledger, match, ordered, pages, review, status
from tallyforge.operators.bounds import dealt
from tallyforge.plans.registry import T, query
from tallyforge.plans.registry import read as _read
from tallyforge.plans.views import DUCK_RUNNING, SEEN, duck, running, seen, txn
from tallyforge.sources import files
from tallyforge.streaming.folders import shared_folder

# --- amounts ---------------------------------------------------------------


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 IN (3, 5) THEN -v ELSE v END AS minor,
  CASE l_linenumber % 7 WHEN 6 THEN 'EUR' WHEN 2 THEN 'SGD' END AS currency_hint, CASE l_linenumber % 7 WHEN 4 THEN 'DR' END AS crdr FROM m
""")
def num_01_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices rendered in seven styles and read again."""
    v = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    us = F.format_number(v.cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    eu = F.translate(us, ",.", ".,")
    style = F.col("l_linenumber") % 7
    raw = (
        F.when(style == 0, F.replace(us, F.lit(","), F.lit(""))).when(style == 1, us).when(style == 2, F.concat(F.lit(" S$"), us)).when(style == 3, F.concat(F.lit("("), us, F.lit(")")))
        .when(style == 4, F.concat(us, F.lit(" dr "))).when(style == 5, F.concat(F.lit("usd "), us, F.lit("-"))).otherwise(F.concat(F.lit("€ "), eu))
    )
    shown = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return amounts.with_amounts(shown, a=(F.col("raw"), None, None)).select("l_orderkey", "l_linenumber", "a.minor", "a.currency_hint", "a.crdr")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS minor FROM lineitem")
def num_02_split_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European and English renderings read without a hint of the format."""
    v = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    us = F.format_number(v.cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.translate(us, ",.", ".,")).otherwise(us)
    plain = amounts.split_separators(shown)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(plain.cast("double") * 100 + 0.5).cast("long").alias("minor"))


_PLAIN = "CASE WHEN amount < 0 THEN '-' ELSE '' END || CASE WHEN currency = 'JPY' THEN CAST(abs(amount) AS STRING) ELSE CAST(abs(amount) // 100 AS STRING) || '.' || lpad(CAST(abs(amount) % 100 AS STRING), 2, '0') END"


@query(f"""SELECT row_id, {_PLAIN} AS plain,
  CASE WHEN amount < 0 THEN '-' ELSE '' END || CASE WHEN currency = 'JPY' THEN format('{{:,}}', abs(amount)) ELSE format('{{:,}}', abs(amount) // 100) || '.' || lpad(CAST(abs(amount) % 100 AS STRING), 2, '0') END AS grouped,
  CASE WHEN currency = 'JPY' THEN 0 ELSE 2 END AS decimals FROM {T}""")
def num_03_04_05_format_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select("row_id", amounts.format_minor("amount", "currency").alias("plain"), amounts.format_minor("amount", "currency", True).alias("grouped"), amounts.decimals_for("currency").alias("decimals"))


@query(f"SELECT row_id, CASE WHEN amount < 0 THEN '-' ELSE '' END || CASE WHEN currency = 'JPY' THEN format('{{:,}}', abs(amount)) ELSE format('{{:,}}', abs(amount) // 100) || '.' || lpad(CAST(abs(amount) % 100 AS STRING), 2, '0') END AS grouped FROM {T}")
def num_06_group_plain_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select("row_id", amounts.group_plain_number(amounts.format_minor("amount", "currency")).alias("grouped"))


@query(f"""SELECT row_id, {_PLAIN.replace("amount < 0", "amount > 0")} AS flipped, CASE WHEN amount < 0 THEN substr({_PLAIN}, 2) ELSE '' END AS money_out, CASE WHEN amount >= 0 THEN {_PLAIN} ELSE '' END AS money_in FROM {T}""")
def num_07_08_09_money_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select("row_id", amounts.format_amount_out("amount", "currency", "positiveIsOut").alias("flipped"), amounts.format_money_out("amount", "currency").alias("money_out"), amounts.format_money_in("amount", "currency").alias("money_in"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS unit_price FROM lineitem")
def num_10_round4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amounts.round4(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


@query("SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN '1.234,56' ELSE '1,234.56' END AS number_format FROM orders GROUP BY o_custkey")
def num_11_suggest_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.format_number("o_totalprice", 2)
    shown = F.when(F.col("o_custkey") % 2 == 0, F.translate(us, ",.", ".,")).otherwise(us)
    grouped = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(shown)).alias("v"))
    return grouped.select("o_custkey", amounts.number_format_of("v").alias("number_format"))


@query(f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN abs(amount) WHEN row_id % 3 = 1 THEN -abs(amount) ELSE 0 END AS pair, CASE WHEN row_id % 2 = 0 THEN abs(amount) ELSE -amount END AS single FROM {T}")
def norm_02_resolve_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("row_id") % 3
    credit, debit = F.when(third == 0, F.col("amount")).when(third == 2, 0), F.when(third == 1, F.col("amount"))
    return txn(spark, sf_dir).select("row_id", amounts.resolve_amount(credit, debit).alias("pair"), amounts.signed_amount(F.col("amount"), F.when(F.col("row_id") % 2 == 0, "CR"), "positiveIsOut").alias("single"))


# --- dates -----------------------------------------------------------------


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, CAST(CAST(o_orderdate AS DATE) AS STRING) AS from_name FROM orders")
def date_01_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates rendered in four formats and read again; and with a month's name and a two-digit year of this century."""
    kinds = [("yyyy-MM-dd", "YYYY-MM-DD"), ("d/M/yyyy", "DD/MM/YYYY"), ("MM.dd.yyyy", "MM/DD/YYYY"), ("d MMMM yyyy", "DD MMM YYYY")]
    iso = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, dates.parse_date(F.date_format("o_orderdate", a), b)) for i, (a, b) in enumerate(kinds)])
    named = dates.parse_date(F.date_format("o_orderdate", "d MMM"), "DD MMM", F.year("o_orderdate"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", iso.alias("iso"), named.alias("from_name"))


@query("SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(printf('%04d-%02d-%02d', 1990 + l_orderkey % 40, l_linenumber * 2, CAST(l_quantity AS INT)) AS DATE) AS STRING) AS iso FROM lineitem")
def date_02_to_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that exist and days that don't."""
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.to_iso(1990 + F.col("l_orderkey") % 40, F.col("l_linenumber") * 2, F.col("l_quantity")).alias("iso"))


@query("""
SELECT o_custkey, CASE WHEN bool_or(day(o_orderdate) > 12) THEN 'dayFirst' ELSE 'ambiguous' END AS day_order, NOT bool_or(day(o_orderdate) > 12) AS ambiguous, 'DD/MM/YYYY' AS suggested FROM orders GROUP BY o_custkey
""")
def date_03_08_09_infer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("v"))
    return v.select("o_custkey", dates.day_month_order("v").alias("day_order"), dates.is_day_month_ambiguous("v").alias("ambiguous"), dates.suggest_date_format("v").alias("suggested"))


@query("""
WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0) AS a, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN b > a THEN 'DD/MM/YYYY' WHEN o_custkey % 2 = 0 OR a = 0 THEN 'YYYY-MM-DD' ELSE 'DD MMM YYYY' END AS format, CAST(greatest(a, b) AS INT) AS hits, CAST(a + b AS INT) AS total FROM c
""")
def date_10_best_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in two formats, and blank ones: the format that reads more."""
    shown = F.when(F.col("o_orderkey") % 7 == 0, " ").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    v = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(shown).alias("v"))
    return v.select("o_custkey", dates.best_date_format("v").alias("b")).select("o_custkey", "b.format", "b.hits", "b.total")


@query("""
WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 300 AS INT) AS s FROM orders)
SELECT o_orderkey, CAST(year(d) AS INT) AS year FROM p
""")
def date_04_infer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day without its year, back from a period of under a year that ends with it."""
    o = _read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("s", F.date_sub("d", (F.col("o_orderkey") % 300).cast("int")))
    return o.select("o_orderkey", dates.infer_year(F.month("d"), F.dayofmonth("d"), F.col("s").cast("string"), F.col("d").cast("string")).alias("year"))


_OUT = {"DD/MM/YYYY": "%d/%m/%Y", "MM/DD/YYYY": "%m/%d/%Y", "DD-MM-YYYY": "%d-%m-%Y", "D/M/YYYY": "%-d/%-m/%Y", "DD MMM YYYY": "%d %b %Y", "MMM D, YYYY": "%b %-d, %Y", "YYYY/MM/DD": "%Y/%m/%d", "DD.MM.YYYY": "%d.%m.%Y", "YYYYMMDD": "%Y%m%d", "YYYY-MM-DD": "%Y-%m-%d", "isoWithTime": "%Y-%m-%d"}


@query("SELECT o_orderkey, " + ", ".join(f"strftime(o_orderdate, '{p}') AS f{i}" for i, p in enumerate(_OUT.values())) + ", CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS STRING) AS serial, strftime(o_orderdate, '%-d %b %Y') AS short FROM orders")
def date_05_07_format_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.to_date("o_orderdate").cast("string")
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[dates.format_date_out(iso, f).alias(f"f{i}") for i, f in enumerate(_OUT)], dates.format_date_out(iso, "sheetsSerial").alias("serial"), dates.format_short_date(iso).alias("short"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
SELECT o_orderkey, CAST(m AS STRING) AS this_start, CAST(last_day(d) AS STRING) AS this_end, CAST(CAST(m - INTERVAL 1 MONTH AS DATE) AS STRING) AS last_start, CAST(m - 1 AS STRING) AS last_end,
  CAST(CAST(m - INTERVAL 3 MONTH AS DATE) AS STRING) AS three_start, CAST(CAST(date_trunc('year', d) AS DATE) AS STRING) AS ytd_start FROM d
""")
def date_06_preset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {n: dates.preset_range(n, F.col("o_orderdate")) for n in ("thisMonth", "lastFullMonth", "last3Months", "ytd")}
    return _read(spark, sf_dir, "orders").select("o_orderkey", p["thisMonth"]["start"].alias("this_start"), p["thisMonth"]["end"].alias("this_end"), p["lastFullMonth"]["start"].alias("last_start"), p["lastFullMonth"]["end"].alias("last_end"), p["last3Months"]["start"].alias("three_start"), p["ytd"]["start"].alias("ytd_start"))


@query(f"SELECT account, min(date) AS first_date, max(date) AS last_date FROM {T} GROUP BY account")
def date_12_range_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).groupBy("account").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# --- strings and arrays ----------------------------------------------------


@query(r"""
WITH p AS (SELECT *, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM part)
SELECT p_partkey, phrase, CAST(len(regexp_extract_all(p_name, '[a-zA-Z0-9]+')) AS INT) AS n_tokens, substr(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 1, 12) AS description_key,
  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(levenshtein(p_name, p_type) AS INT) AS distance FROM p
""")
def str_03_04_05_08_26_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        "p_partkey", text.normalize_phrase(F.concat("p_name", F.lit(" / "), "p_type")).alias("phrase"), F.size(text.tokens("p_name")).alias("n_tokens"), text.description_key("p_name").alias("description_key"),
        text.slugify("p_name").alias("slug"), F.levenshtein("p_name", "p_type").alias("distance"),
    )


@query(r"""
WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) / greatest(len(a), len(b)) AS ratio, len(list_intersect(b, a)) / len(b) AS recall FROM p
""")
def str_06_arr_04_05_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat_ws(" ", "p_type", "p_name")
    return _read(spark, sf_dir, "part").select("p_partkey", text.token_overlap("p_name", both).alias("ratio"), match.overlap_score(F.array("p_type", "p_name"), F.array("p_name")).alias("recall"))


@query("SELECT p_partkey, p_partkey % 5 <= 2 AS found, p_partkey % 3 <> 1 AS here FROM part")
def str_07_fuzzy_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's type in a text around it, with up to four letters lost at places that differ from part to part; and a text that holds it or its letters the other way round."""
    k, n = F.col("p_partkey"), F.length("p_type")
    worn = F.col("p_type")
    for i in range(4):  # the letter at a place becomes a sign that no type holds
        at = ((F.floor(k / 5) + i) % n + 1).cast("int")
        worn = F.when(k % 5 > i, F.overlay(worn, F.lit(str(i)), at, F.lit(1))).otherwise(worn)
    around = F.concat(F.lit("zz "), worn, F.lit(" qq xx ww"))
    some = F.concat(F.lit("aa bb cc "), F.when(k % 3 == 1, F.reverse("p_type")).otherwise(F.lower("p_type")), F.lit(" dd ee"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.fuzzy_in_text("p_type", around).alias("found"), text.fuzzy_in_text("p_type", some).alias("here"))


@query(r"SELECT c_custkey, '****' || right(regexp_replace(regexp_extract(c_name, '\d[\d -]{5,20}\d'), '\D', '', 'g'), 4) AS masked, regexp_replace(c_name, '\d', '#', 'g') AS hidden FROM customer")
def str_09_priv_02_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", text.mask_account("c_name").alias("masked"), text.mask_digit_runs("c_name").alias("hidden"))


@query(r"""
SELECT o_orderkey, k IN (0, 1, 3) AS date_like, k IN (0, 1, 4) AS amount_like, k IN (0, 3) AS known, k IN (1, 3) AS code_like, k IN (0, 3) AS transaction FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)
""")
def str_12_13_14_16_28_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, amounts, codes and lines, and what is only like them."""
    k = (F.col("o_orderkey") % 5).cast("int")
    of = lambda *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), k)
    day, price = F.date_format("o_orderdate", "dd/MM/yyyy"), F.format_number("o_totalprice", 2)
    when = of(day, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MMM yyyy"), F.date_format("o_orderdate", "dd MMM yyyy"), "total")
    amount = of(price, F.concat(F.lit("("), price, F.lit(")")), "abc", " ", F.concat(price, F.lit(" CR")))
    code = of("sgd", "XQX", "US", "JPY", "")
    line = of(F.concat_ws(" ", day, F.lit("payment"), price), F.concat(F.lit("payment of "), price), day, F.concat(F.date_format("o_orderdate", "dd MMM"), F.lit(" coffee 4.50")), "no digits")
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.is_date_like(when).alias("date_like"), text.is_amount_like(amount).alias("amount_like"), text.is_known_currency(code).alias("known"), text.is_currency_code_like(code).alias("code_like"), text.looks_like_transaction(line).alias("transaction"))


@query(r"SELECT o_orderkey, printf('paid %s to %s', regexp_replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '\d', '#', 'g') || '.##', o_orderpriority) AS masked FROM orders")
def priv_01_mask_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_string("paid %d.25 to %s", F.floor("o_totalprice").cast("long"), F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.mask_amounts(shown).alias("masked"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '<text ' || length(props) || ' chars>' END AS shown FROM events")
def priv_03_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(F.col("props"))
    return _read(spark, sf_dir, "events").select("event_id", text.redact(F.col("event_type"), value, ("click", "view")).alias("shown"))


@query("""
WITH f AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1, count(*) AS n, max_by(event_type, event_id) FILTER (event_id = last_id) AS last_type FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last_id FROM events) GROUP BY user_id)
SELECT 'statement ' || dense_rank() OVER (ORDER BY t0, user_id) AS label, n, last_type, date_sub('second', t0, t1) AS seconds FROM f
""")
def priv_07_08_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events grouped by file under anonymous labels in the order first seen."""
    f = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("last_type"))
    # Numbers in the order of all files: counted piece by piece, so no task gets them all.
    placed = ordered.in_pieces(f.withColumn("all", F.lit(0)), ["all"], ["t0", "user_id"])
    f, rank = ordered.running(placed, ["all"], nth=("sum", F.lit(1), True)), F.col("nth")
    return f.select(F.concat(F.lit("statement "), rank.cast("string")).alias("label"), "n", "last_type", F.expr("timestampdiff(SECOND, t0, t1)").alias("seconds"))


# --- sources and grids -----------------------------------------------------


#: How files begin, whether that makes them a workbook or a page file, and their encoding; the last is the whole file.
_HEADS = (
    ("255044462D", "pdf", "utf-8"), ("504B0304FF", "xlsx", "windows-1252"), ("", "text", "utf-8"), ("20255044462D", "text", "utf-8"), ("2550444678", "text", "utf-8"), ("FFFE", "text", "utf-16le"),
    ("504B01FF", "text", "windows-1252"), ("EFBBBF255044462D", "text", "utf-8-bom"), ("504B03", "text", "utf-8"),
)


@query("SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t, _) in enumerate(_HEADS)) + " END AS type, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, _, e) in enumerate(_HEADS)) + " END AS encoding FROM documents")
def src_01_02_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the first bytes of several kinds of files, some of them all but right."""
    heads = F.array(*[F.to_binary(F.lit(h), F.lit("hex")) for h, _, _ in _HEADS])
    k = (F.col("doc_id") % 9).cast("int")
    content = F.concat(F.get(heads, k), F.when(k == 8, F.to_binary(F.lit(""), F.lit("hex"))).otherwise(F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))))
    return _read(spark, sf_dir, "documents").select("doc_id", files.file_type(content).alias("type"), files.encoding(content).alias("encoding"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as delimited text: a preamble, a header, the lines, a total."""
    o = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls"))
    d = F.element_at(F.array(*map(F.lit, files.CANDIDATES)), (F.col("file_id") % 4 + 1).cast("int"))
    o = o.withColumn("d", d)
    body = F.transform("ls", lambda x: F.call_function("concat_ws", F.col("d"), x["l_linenumber"].cast("string"), F.concat(F.lit('"part '), x["l_partkey"].cast("string"), F.lit('"')), x["l_suppkey"].cast("string")))
    lines = F.concat(F.array(F.lit("  Statement of parts  "), F.lit(""), F.call_function("concat_ws", F.col("d"), F.lit("Line"), F.lit(" Part "), F.lit("Supplier"))), body, F.array(F.call_function("concat_ws", F.col("d"), F.lit("Total"), F.lit("x"), F.lit("y"))))
    return o.select("file_id", F.array_join(lines, "\r\n").alias("text"))


@query("SELECT DISTINCT l_orderkey AS file_id, CASE l_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter FROM lineitem")
def src_05_06_07_detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four delimiters; some lines hold another candidate, more often than the delimiter."""
    s = _statements(spark, sf_dir)
    other = F.element_at(F.array(*map(F.lit, files.CANDIDATES)), ((F.col("file_id") + 1) % 4 + 1).cast("int"))
    noisy = F.transform(F.split("text", "\r\n"), lambda x, i: F.when(i % 4 == 3, F.concat(x, F.repeat(F.concat(other, F.lit("z")), F.lit(5)))).otherwise(x))
    return files.detect_delimiter(s.withColumn("text", F.array_join(noisy, "\r\n")))


@query("SELECT l_orderkey AS file_id, CAST(l_linenumber AS STRING) AS line, 'part ' || l_partkey AS part, CAST(l_suppkey AS STRING) AS supplier FROM lineitem WHERE l_linenumber <> 3")
def src_10_grid_01_02_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter, quoted cells, header, footer and an ignored row, from text to records."""
    s = _statements(spark, sf_dir)
    g = files.parse_grids(s)
    window = grid.Window(header_row=1, footers=(grid.Rule("startsWith", "total"),), ignored=(grid.Rule("regex", "^3 part"),))
    out = grid.apply_window(g, window)
    return out.select("file_id", F.col("record")["Line"].alias("line"), F.col("record")["Part"].alias("part"), F.col("record")["Supplier"].alias("supplier"))


@query("SELECT DISTINCT l_orderkey AS file_id, CAST(l_orderkey % 3 AS INT) AS header_row, CAST(l_orderkey // 3 % 4 AS INT) AS footer_rows FROM lineitem")
def win_12_13_header_and_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables behind none to two rows of preamble (a wide one among them) with none to three footers, some with a thin row in their midst."""
    i = F.col("file_id")
    row = lambda *c: F.array(*[F.lit(x) for x in c])
    body = F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(F.date_format("l_shipdate", "dd/MM/yyyy"), F.format_number("l_extendedprice", 2), F.col("l_suppkey").cast("string")).alias("cells"))))
    g = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.transform(body, lambda x: x["cells"]).alias("body"))
    thin = F.when(i % 5 == 0, F.array(row("", "", "see below"))).otherwise(F.array().cast("array<array<string>>"))
    top, end = F.array(row("Wide", "but", "lonely"), row("Statement")), F.array(row("Closing balance", "9.00", "x"), row("", "", "note"), row("Total", "1.00", "y"))
    grid_ = F.concat(F.slice(top, 3 - (i % 3).cast("int"), (i % 3).cast("int")), F.array(row("Date", "Amount", "Supplier")), thin, F.col("body"), F.slice(end, F.lit(1), (F.floor(i / 3) % 4).cast("int")))
    # A thin row right below the header is as wide as it, so the header stays.
    g = g.select("file_id", grid_.alias("grid")).withColumn("header_row", grid.suggest_header_row("grid"))
    return g.select("file_id", "header_row", grid.footer_rows("grid", F.col("header_row")).alias("footer_rows"))


@query(f"SELECT row_id, date FROM {T} WHERE date >= '1995-03-01' AND date <= '1996-02-29'")
def grid_04_filter_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).filter(ledger.in_range("date", "1995-03-01", "1996-02-29")).select("row_id", "date")


@query("SELECT o_orderkey, [x FOR x IN [o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END] IF x <> ''][1] AS first_value FROM orders")
def grid_03_source_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("b"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")))
    return _read(spark, sf_dir, "orders").withColumn("record", record).select("o_orderkey", F.try_element_at(grid.source_values("record", ["none", "a", "b"]), F.lit(1)).alias("first_value"))


# --- summaries -------------------------------------------------------------


@query(f"""SELECT account, currency, count(*) AS n, min(date) AS first_date, max(date) AS last_date, CAST(coalesce(sum(amount) FILTER (amount >= 0), 0) AS BIGINT) AS total_in,
  CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS total_out, CAST(sum(amount) AS BIGINT) AS net FROM {T} WHERE row_id % 13 <> 0 GROUP BY ALL""")
def agg_01_02_03_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.file_summary(txn(spark, sf_dir).withColumn("skipped", F.col("row_id") % 13 == 0), "account")


@query(f"""SELECT file, count(*) AS n, count(*) FILTER (row_id % 10 <> 0 AND row_id % 7 <> 0) AS valid, count(*) FILTER (row_id % 10 = 0) AS missing_amount, count(*) FILTER (row_id % 7 = 0) AS unparseable_date,
  avg(CASE WHEN row_id % 10 = 0 OR row_id % 7 = 0 THEN 1 ELSE 0 END) AS unreadable_rate FROM {T} GROUP BY file""")
def agg_04_05_12_extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir).withColumns({"amount": F.when(F.col("row_id") % 10 != 0, F.col("amount")), "date": F.when(F.col("row_id") % 7 != 0, F.col("date"))})
    return ledger.extraction_summary(rows, "file")


@query(f"SELECT account, max(date) AS last_date FROM {T} GROUP BY account HAVING max(date) < '2001-07-15'")
def agg_15_coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.coverage_warnings(txn(spark, sf_dir), "2001-07-15")


@query(f"""
WITH r AS (SELECT file, bool_or(CAST(amount AS STRING) <> '') AS amount, bool_or(file = 1 AND description <> '') AS reference, bool_or(CASE WHEN row_id % 1000 = 7 THEN 'x' ELSE '' END <> '') AS rare FROM {T} GROUP BY file),
l AS (UNPIVOT r ON amount, reference, rare INTO NAME field VALUE has)
SELECT field, count(*) FILTER (has) AS covered, count(*) AS total, CASE WHEN bool_and(has) THEN 'all' WHEN NOT bool_or(has) THEN 'none' ELSE 'some' END AS coverage FROM l GROUP BY field
""")
def agg_16_17_18_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir).withColumns({"reference": F.when(F.col("file") == 1, F.col("description")), "rare": F.when(F.col("row_id") % 1000 == 7, "x").otherwise("")})
    return ledger.field_coverage(rows, "file", ["amount", "reference", "rare"])


@query(f"SELECT account, NOT bool_or(amount < 0) AS no_outflow, bool_and(amount >= 0) OR bool_and(amount <= 0) AS one_signed FROM {T} GROUP BY account")
def agg_23_sign_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.sign_warnings(txn(spark, sf_dir), "account")


# --- balances and duplicates -----------------------------------------------


@query(f"""
WITH r AS ({DUCK_RUNNING}), o AS (SELECT account, arg_min(balance - amount, (date, row_id)) AS opening, arg_max(balance, (date, row_id)) AS closing, sum(amount) AS total FROM (SELECT * FROM r WHERE balance IS NOT NULL) GROUP BY account),
t AS (SELECT account, sum(amount) AS total FROM r GROUP BY account),
c AS (SELECT r.*, opening + sum(r.amount) OVER (PARTITION BY account ORDER BY date, row_id ROWS UNBOUNDED PRECEDING) AS computed FROM r JOIN o USING (account)),
b AS (SELECT account, arg_min({{'d': date, 'i': row_id, 's': balance, 'c': computed}}, (date, row_id)) AS x FROM c WHERE balance IS NOT NULL AND balance <> computed GROUP BY account)
SELECT account, opening, closing, CAST(t.total AS BIGINT) AS total, opening + t.total = closing AS reconciles, x.d AS failing_date, x.i AS failing_row_id, x.s AS stated, CAST(x.c AS BIGINT) AS computed
FROM o JOIN t USING (account) LEFT JOIN b USING (account)
""")
def win_01_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.balance_check(running(spark, sf_dir), ["account"], ["date", "row_id"])


@query(f"""
WITH r AS ({DUCK_RUNNING}), l AS (SELECT *, lag(balance) OVER w AS pb, lag(amount) OVER w AS pa, lead(balance) OVER w AS nb FROM r WHERE balance IS NOT NULL WINDOW w AS (PARTITION BY account ORDER BY date, row_id)),
f AS (SELECT *, pb + amount = balance AS down, balance + pa = pb AS up, nb + amount = balance AS own FROM l),
s AS (SELECT *, count(down) OVER p AS n, sum(down::INT) OVER p AS nd, sum(up::INT) OVER p AS nu FROM f WINDOW p AS (PARTITION BY account))
SELECT r.row_id, coalesce(greatest(nd, nu) * 2 >= n AND CASE WHEN nd >= nu THEN NOT down ELSE NOT own END, false) AS balance_mismatch FROM r LEFT JOIN s USING (row_id)
""")
def win_02_tag_balance_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tag_running_mismatches(running(spark, sf_dir), "account", ["date", "row_id"]).select("row_id", "balance_mismatch")


S = f"({duck(SEEN)}) seen"
_FP = "account || '|' || date || '|' || amount || '|' || currency || '|' || substr(regexp_replace(upper(description), '[^A-Z0-9]', '', 'g'), 1, 12)"
_NK = "account || '|' || date || '|' || amount || '|' || currency"


@query(f"SELECT row_id, row_number() OVER (PARTITION BY file, account, date, amount, currency, lower(description) ORDER BY row_id) > 1 AS possible_duplicate FROM {S}")
def win_03_possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.possible_duplicates(seen(spark, sf_dir), "file", "row_id").select("row_id", "possible_duplicate")


@query(f"""
WITH s AS (SELECT *, {_FP} AS fp FROM {S}), c AS (SELECT fp, file, count(*) AS n FROM s GROUP BY fp, file), w AS (SELECT fp, arg_max(file, n * 10 - file) AS winner FROM c GROUP BY fp)
SELECT row_id, fp AS fingerprint, file = winner AS kept FROM s JOIN w USING (fp)
""")
def join_01_02_merge_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ledger.merge_across_files(seen(spark, sf_dir))
    return merged.select("row_id", ledger.fingerprint().alias("fingerprint"), "kept")


@query(f"""
WITH s AS (SELECT row_id, file, {_NK} AS nk, {_FP} AS fp FROM {S}), p AS (
  SELECT a.nk, a.file AS file_a, b.file AS file_b, a.row_id AS row_a, b.row_id AS row_b FROM s a JOIN s b ON a.nk = b.nk AND a.file < b.file AND a.fp <> b.fp
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.nk = a.nk AND x.file = b.file AND x.fp = a.fp) AND NOT EXISTS (SELECT 1 FROM s x WHERE x.nk = a.nk AND x.file = a.file AND x.fp = b.fp))
SELECT nk, file_a, file_b, min((row_a, row_b))[1] AS row_a, min((row_a, row_b))[2] AS row_b FROM p GROUP BY ALL
""")
def join_01b_03_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.near_pairs(seen(spark, sf_dir))


@query("WITH f AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id AS file_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM f)")
def join_04_duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"))
    return ledger.duplicate_files(f, "file_id").select("file_id", "duplicate_of")


_RATES = [("USD", "SGD", None, 1.35), ("EUR", "SGD", None, 1.45), ("EUR", "SGD", "1996-03", 1.5), ("JPY", "SGD", "1996-03", 0.009)]


@query(f"""SELECT row_id, CASE currency WHEN 'SGD' THEN 1.0 WHEN 'USD' THEN 1.35 WHEN 'EUR' THEN (CASE WHEN date LIKE '1996-03%' THEN 1.5 ELSE 1.45 END) ELSE (CASE WHEN date LIKE '1996-03%' THEN 0.009 END) END::DOUBLE AS fx_rate,
  CAST(floor(amount * fx_rate * (CASE WHEN currency = 'JPY' THEN 100.0 ELSE 1.0 END)::DOUBLE + 0.5) AS BIGINT) AS converted_amount, CASE WHEN fx_rate IS NOT NULL THEN 'SGD' END AS converted_currency FROM {T}""")
def join_13_14_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame(_RATES, "source string, target string, month string, rate double")
    return ledger.convert(txn(spark, sf_dir), "SGD", rates).select("row_id", "fx_rate", "converted_amount", "converted_currency")


_TERMS = [("size", "large"), ("size", "small"), ("size", "edium"), ("price", "economy"), ("price", "promo"), ("kind", "o"), ("kind", "standard")]


@query(f"""
WITH terms(field, term) AS (VALUES {", ".join(map(str, _TERMS))}), h AS (SELECT DISTINCT p_type AS header, lower(trim(p_type)) AS h FROM part)
SELECT header, field, max(CASE WHEN h = term THEN 1.0 ELSE 0.7 END)::DOUBLE AS score FROM h JOIN terms ON contains(h, term) GROUP BY ALL
""")
def join_15_score_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.score_headers(_read(spark, sf_dir, "part").select(F.col("p_type").alias("header")), spark.createDataFrame(_TERMS, "field string, term string"))


@query("""
WITH s AS (SELECT c_custkey AS file_id, n_name, n_nationkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT file_id, CAST(n_nationkey AS STRING) AS profile_id, CASE WHEN file_id % 3 = 0 THEN 0.69 ELSE 1.0 END::DOUBLE AS confidence, file_id % 3 = 0 AS layout_changed, 1 AS rank FROM s
""")
def join_06_07_match_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's file against a profile for each nation; every third file lacks a required column."""
    named = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("profile_id"), F.lower(F.concat(F.lit("bank of "), F.replace("n_name", F.lit(" "), F.lit("")))).alias("bank"), "n_nationkey")
    own = F.concat(F.lit("tag"), F.col("n_nationkey").cast("string"))
    profiles = named.select("profile_id", F.lit("csv").alias("type"), "bank", F.array(F.lit("date")).alias("required"), F.array(own, F.concat(own, F.lit("x"))).alias("header"), F.array("bank").alias("keywords"), F.array().cast("array<string>").alias("anchors"), own.alias("filename"))
    c = _read(spark, sf_dir, "customer").join(named.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    tag = F.concat(F.lit("tag"), F.col("c_nationkey").cast("string"))
    date = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(" Date ")
    f = c.select(F.col("c_custkey").alias("file_id"), F.lit("csv").alias("type"), F.concat(F.lit("q-"), tag, F.lit("-z.csv")).alias("name"), F.array(date, tag, F.concat(tag, F.lit("x"))).alias("header"), F.concat(F.lit("Statement of "), F.col("bank"), F.lit(" for you")).alias("text"))
    found = match.match_profiles(f, profiles)
    return found.filter("confidence >= 0.69 AND rank = 1")


@query(f"""
WITH m AS (SELECT account, max(date) FILTER (row_id % 2 = 0) AS marker FROM {T} GROUP BY account HAVING max(date) FILTER (row_id % 2 = 0) IS NOT NULL), s AS (SELECT CAST(CAST(min(marker) AS DATE) + 1 AS STRING) AS start FROM m)
SELECT m.account, start, marker >= start AND EXISTS (SELECT 1 FROM {T} WHERE txn.account = m.account AND date BETWEEN start AND marker) AS overlap FROM m, s
""")
def join_19_since_last_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir)
    markers = rows.filter("row_id % 2 = 0").groupBy("account").agg(F.max("date").alias("marker"))
    return ledger.since_last_export(markers, rows)


@query(f"WITH t AS (SELECT date, amount FROM {T} WHERE row_id % 9 <> 0), g AS (SELECT date, amount FROM {T} WHERE row_id % 8 <> 0) SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT ALL SELECT * FROM g)) AS matches, (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM g)) AS misses, (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM t)) AS extras")
def set_07_multiset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir)
    return ledger.multiset_score(rows.filter("row_id % 9 <> 0"), rows.filter("row_id % 8 <> 0"), ["date", "amount"])


# --- export ----------------------------------------------------------------


@query(f"""SELECT row_id, strftime(CAST(date AS DATE), '%d/%m/%Y') || ',' || CASE WHEN row_id % 2 = 0 THEN '"say ""' || description || '"", now"' ELSE description END || ',' || CASE WHEN amount < 0 THEN substr({_PLAIN}, 2) ELSE '' END || ',' || CASE WHEN amount >= 0 THEN {_PLAIN} ELSE '' END AS line FROM {T}""")
def snk_01_03_04_lay_09_13_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = txn(spark, sf_dir).withColumn("description_raw", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit('say "'), "description", F.lit('", now'))).otherwise(F.col("description")))
    layout = export.Layout.of("simple").split_money()
    return export.delimited(rows, export.Layout(columns=layout.columns, date_format="DD/MM/YYYY"), ("row_id",))


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) OR contains(text, chr(13)) OR contains(text, chr(9)) OR contains(text, '\"') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM documents")
def snk_02_escape_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", export.escape_cell("text", "\t").alias("cell"))


# --- review ----------------------------------------------------------------

_EVENTS = "SELECT user_id AS row_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'exclude' WHEN 2 THEN 'restore' WHEN 3 THEN 'edit' ELSE 'undo' END AS action, 'amount' AS field, CAST(event_id AS STRING) AS value FROM {events}"


@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY seq) AS k FROM ({_EVENTS.replace("{events}", "events")})),
walk(row_id, k, stack) AS (
  SELECT row_id, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT row_id FROM e)
  UNION ALL SELECT w.row_id, e.k, CASE WHEN e.action <> 'undo' THEN list_append(stack, e.seq) WHEN len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END FROM walk w JOIN e ON e.row_id = w.row_id AND e.k = w.k + 1
), last AS (SELECT row_id, arg_max(stack, k) AS stack FROM walk GROUP BY row_id)
SELECT l.row_id, e.seq, e.action FROM (SELECT row_id, unnest(stack) AS seq FROM last) l JOIN e ON e.seq = l.seq AND e.row_id = l.row_id
""")
def edit_10_11_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, exclusions and undos of every row, folded."""
    return review.live_events(spark.sql(_EVENTS, events=_read(spark, sf_dir, "events"))).select("row_id", "seq", "action")


# --- pages -----------------------------------------------------------------


@query("""
WITH i AS (SELECT vec_id, unnest(range(1, len(embedding) // 2 + 1)) AS k, embedding FROM embeddings),
p AS (SELECT vec_id, k, floor(embedding[2 * k] * 40) * 5 AS y, embedding[2 * k - 1] AS x FROM i)
SELECT vec_id AS page, y::DOUBLE AS y, string_agg(CAST(k AS STRING), ' ' ORDER BY x, CAST(k AS STRING)) AS text FROM p GROUP BY vec_id, y
""")
def win_05_lines_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an embedding's numbers as items on a page, five points between lines."""
    e = _read(spark, sf_dir, "embeddings")
    item = lambda k: F.struct(k.cast("string").alias("str"), F.element_at("embedding", 2 * k - 1).cast("double").alias("x"), (F.floor(F.element_at("embedding", 2 * k) * 40) * 5).cast("double").alias("y"))
    pages_ = e.select(F.col("vec_id").alias("page"), F.transform(F.sequence(F.lit(1), F.floor(F.size("embedding") / 2).cast("int")), item).alias("items"))
    return pages.lines_of_items(pages_, ["page"]).select("page", "y", pages.line_text("items").alias("text"))


@query("""
WITH i AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding) AS x FROM embeddings)
SELECT vec_id AS page, coalesce(string_agg(CAST(k AS STRING), ' ' ORDER BY x, CAST(k AS STRING)) FILTER (x < 0), '') AS debit, coalesce(string_agg(CAST(k AS STRING), ' ' ORDER BY x, CAST(k AS STRING)) FILTER (x >= 0 AND x < 0.1), '') AS credit FROM i GROUP BY vec_id
""")
def join_09_assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("x"), (i + 1).cast("string").alias("str"))))
    lines = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), items.alias("items"))
    return pages.assign_columns(lines, [("debit", -1e9, 0.0), ("credit", -5.0, 0.1)]).select("page", "debit", "credit")


@query("""
WITH p AS (SELECT vec_id, x::DOUBLE * 1000 AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)), g AS (SELECT vec_id, x - lag(x) OVER w AS gap, lag(x) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY x))
SELECT vec_id AS page, count(*) AS n, max(gap) AS gap, arg_max(b, (gap, -b)) FILTER (gap IS NOT NULL) + max(gap) / 2 AS split FROM g GROUP BY vec_id HAVING count(*) >= 4 AND max(gap) >= 20
""")
def win_11_largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double") * 1000)
    return pages.largest_gap(points, ["page"])


@query("""
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
n AS (SELECT *, sum(CASE WHEN line LIKE 'The%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM l)
SELECT doc_id, r::BIGINT AS row, md5(string_agg(line, ' ' ORDER BY pos)) AS digest, count(*)::INT AS n_lines FROM n WHERE r > 0 GROUP BY doc_id, r
""")
def win_07_wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    out = pages.wrapped_rows(lines, ["doc_id"], ["pos"], F.col("text").startswith("The"))
    return out.select("doc_id", F.col("row").cast("long").alias("row"), F.md5("text").alias("digest"), "n_lines")


@query("""
WITH c AS (SELECT *, CASE WHEN role = 'user' THEN CAST(conv_id AS STRING) || '.' || turn END AS d, CASE WHEN role = 'assistant' THEN length(text) END AS a FROM conversations),
b AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS date, coalesce(sum(CASE WHEN a IS NOT NULL OR d IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
g AS (SELECT conv_id, k, min(date) AS date, max(a) AS amount, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM b WHERE date IS NOT NULL AND d IS NULL GROUP BY conv_id, k)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k))::INT AS row, date, amount::BIGINT AS amount, digest FROM g WHERE amount IS NOT NULL
""")
def win_08_grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines: a user's opens a group, an assistant's closes a row."""
    c = _read(spark, sf_dir, "conversations")
    date = F.when(F.col("role") == "user", F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))
    amount = F.when(F.col("role") == "assistant", F.length("text").cast("long"))
    out = pages.grouped_rows(c, ["conv_id"], ["turn"], date, amount)
    return out.select("conv_id", "row", "date", "amount", F.md5("description").alias("digest"))


# --- incremental -----------------------------------------------------------


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS total FROM events GROUP BY ALL")
def strm_01_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: daily windows, kept in a table that each batch replaces."""
    at = shared_folder(spark)
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    grouped = stream.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("total"))
    out = grouped.select("event_type", F.col("w.start").alias("day"), "n", "total")
    out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/table")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/table")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements seen by several files: merged, balanced and summed per account and currency."""
    kept = ledger.merge_across_files(seen(spark, sf_dir)).filter("kept").drop("kept")
    return ledger.file_summary(kept, "account")


@query(f"""
WITH s AS (SELECT *, {_FP} AS fp FROM {S}), c AS (SELECT fp, file, count(*) AS n FROM s GROUP BY fp, file), w AS (SELECT fp, arg_max(file, n * 10 - file) AS winner FROM c GROUP BY fp), k AS (SELECT s.* FROM s JOIN w USING (fp) WHERE file = winner)
SELECT account, currency, count(*) AS n, min(date) AS first_date, max(date) AS last_date, CAST(coalesce(sum(amount) FILTER (amount >= 0), 0) AS BIGINT) AS total_in, CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS total_out, CAST(sum(amount) AS BIGINT) AS net FROM k GROUP BY ALL
""")
def flagship_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# --- status, catalogue and sessions ----------------------------------------


@query(f"""
WITH f AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN 'bad' END AS error, row_id % 7 = 0 AS processing, CASE row_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' END AS ocr, (row_id % 4)::BIGINT AS n_rows, (row_id % 3)::BIGINT AS n_active, (row_id % 10) / 10.0 AS confidence FROM {T})
SELECT row_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN processing THEN 'processing' WHEN ocr = 'failed' THEN 'ocrFailed' WHEN ocr = 'queued' THEN 'ocrQueued' WHEN n_rows > 0 AND n_active = 0 THEN 'noTransactions' WHEN n_rows > 0 THEN 'healthy' WHEN confidence < 0.9 THEN 'lowConfidence' ELSE 'matched' END AS status FROM f
""")
def sta_01_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_id")
    f = txn(spark, sf_dir).select(
        "row_id", F.when(i % 11 == 0, "bad").alias("error"), (i % 7 == 0).alias("processing"), F.when(i % 5 == 0, "failed").when(i % 5 == 1, "queued").alias("ocr"),
        (i % 4).alias("n_rows"), (i % 3).alias("n_active"), ((i % 10) / 10).alias("confidence"),
    )
    return status.file_status(f).select("row_id", "status")


@query("SELECT flag, count(*) AS n FROM (SELECT unnest([x FOR x IN ['ocr', CASE WHEN o_orderstatus = 'F' THEN 'missing_amount' END, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' END] IF x IS NOT NULL]) AS flag FROM orders) GROUP BY flag")
def uix_10_flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.lit("ocr"), F.when(F.col("o_orderstatus") == "F", "missing_amount"), F.when(F.col("o_orderkey") % 3 == 0, "pending")))
    return status.flag_histogram(_read(spark, sf_dir, "orders").select(flags.alias("flags")))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS warnings FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY o_custkey")
def agg_11_grid_07_warning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.lit("ocr"), F.when(F.col("o_orderstatus") == "F", "missing_amount"), F.when(F.col("o_orderkey") % 3 == 0, "pending")))
    return status.warning_rows(_read(spark, sf_dir, "orders").select("o_custkey", flags.alias("flags"), (F.col("o_orderkey") % 9 == 0).alias("excluded")), "o_custkey")


@query("SELECT l_orderkey, CASE WHEN n = l THEN 'ok' WHEN abs(n - l) <= 0.5 * l THEN 'neutral' ELSE 'fail' END AS verdict FROM (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS l FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_orderkey)")
def agg_13_sta_06_07_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "lineitem").filter("l_linenumber <> 2").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("l"))
    return n.select("l_orderkey", status.count_check("n", "l", 0.5).alias("verdict"))


@query(f"SELECT account, count(*) AS total, count(*) FILTER (date BETWEEN '1996-01-01' AND '1997-06-30') AS included FROM {T} GROUP BY account")
def uix_19_account_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.account_table(txn(spark, sf_dir), ledger.in_range("date", "1996-01-01", "1997-06-30"))


@query(f"SELECT currency, array_to_string(list_sort(list_distinct(list(substr(date, 1, 7)))), ' ') AS months FROM {T} WHERE currency <> 'SGD' GROUP BY currency")
def uix_16_20_rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.rate_table(txn(spark, sf_dir), "SGD").select("currency", F.array_join("months", " ").alias("months"))


@query(f"""
WITH t AS (SELECT row_id, file, CASE WHEN row_id % 17 = 0 THEN amount // 100 * 100 ELSE amount END AS amount, (row_id * 7 % 101)::DOUBLE AS confidence FROM {T}),
k AS (SELECT *, count(*) OVER p AS n, avg(CASE WHEN amount % 100 <> 0 THEN 1 ELSE 0 END) OVER p AS c, row_number() OVER (PARTITION BY file ORDER BY abs(amount)) AS r FROM t WINDOW p AS (PARTITION BY file)),
m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN abs(amount) END) OVER (PARTITION BY file) AS med FROM k)
SELECT row_id, confidence < 60 AND (confidence < 40 OR (amount % 100 = 0 AND c > 0.5) OR abs(amount) > 100 * med) AS low_confidence,
  CASE WHEN confidence = 0 AND amount % 100 = 0 THEN CAST(floor(amount / 100 + 0.5) AS BIGINT) END AS amount_alt FROM m
""")
def win_04_norm_01_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, a = F.col("row_id"), F.col("amount")
    rows = txn(spark, sf_dir).withColumns({"amount": F.when(i % 17 == 0, F.expr("amount DIV 100 * 100")).otherwise(a), "confidence": (i * 7 % 101).cast("double")})
    return status.low_confidence(rows, "file").select("row_id", "low_confidence", "amount_alt")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN 'new ' || c_name ELSE c_name END AS name FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey + 1000000, c_name || ' (copy)' FROM customer WHERE c_custkey % 10 = 5")
def cat_01_02_03_04_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch, a deletion and copies of profiles."""
    base = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    of = lambda k: base.filter(F.col("id") % 10 == k)
    patched = catalogue.patch(base, of(1).select("id", F.concat(F.lit("new "), "name").alias("name")))
    return catalogue.duplicate(catalogue.delete(patched, of(3)), of(5), F.col("id") + 1000000)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'incoming' ELSE c_name END AS name FROM customer UNION ALL SELECT -n_nationkey - 1, 'incoming' FROM nation")
def snk_07_cat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    incoming = base.filter("id % 2 = 0").select("id").union(_read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long"))).withColumn("name", F.lit("incoming"))
    return catalogue.upsert(base, incoming)


@query("""
WITH s AS (SELECT event_id, date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 86400e6 AS age FROM events)
SELECT event_id, CASE WHEN age > 30 THEN 'delete' WHEN age >= 25 THEN 'warn' ELSE 'keep' END AS fate, CAST(greatest(ceil(30 - age), 0) AS INT) AS days_left FROM s
""")
def ses_02_03_sessions_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("last_opened"))
    now = e.agg(F.max("last_opened").alias("now"))
    return catalogue.sessions_due(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id", "fate", "days_left")


# --- amount lines and currencies -------------------------------------------


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS v, l_linenumber % 6 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k IN (2, 3) THEN -v WHEN k = 5 THEN NULL ELSE v END AS minor, CASE k WHEN 1 THEN 'SGD' WHEN 2 THEN 'EUR' END AS currency, CASE k WHEN 4 THEN -v WHEN 5 THEN NULL WHEN 2 THEN -v WHEN 3 THEN -v ELSE v END AS signed FROM m
""")
def pdf_02_03_06_amount_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end with an amount, in six shapes; the sixth is a page footer."""
    v = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    n = F.format_number(v.cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    k = F.col("l_linenumber") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("coffee "), n)).when(k == 1, F.concat(F.lit("shop SGD "), n)).when(k == 2, F.concat(F.lit("tram -"), n, F.lit(" EUR"))).when(k == 3, F.concat(F.lit("fees ("), n, F.lit(")")))
        .when(k == 4, F.concat(F.lit("rent "), n, F.lit(" DR"))).otherwise(F.concat(F.lit("Page 3 of "), n))
    )
    got = text.with_amount_lines(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), "line", "a")
    return got.select("l_orderkey", "l_linenumber", "a.minor", "a.currency", text.grouped_sign(F.col("a"), "signed").alias("signed"))


@query(f"""SELECT row_id, CASE row_id % 5 WHEN 0 THEN currency WHEN 1 THEN 'GBP' WHEN 2 THEN 'HKD' WHEN 3 THEN 'CHF' ELSE 'SGD' END AS code, CASE WHEN row_id % 5 = 4 THEN 'XQX' END AS unknown FROM {T}""")
def cur_01_detect_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_id") % 5
    value = F.when(k == 0, F.lower("currency")).when(k == 4, "XQX")
    got = text.detect_currency(value, F.when(k == 1, "GBP"), F.when(k == 2, "paid HK$20").when(k == 3, "fee CHF 5").otherwise("plain"), F.lit("SGD"))
    return txn(spark, sf_dir).select("row_id", got.alias("c")).select("row_id", "c.code", "c.unknown")


@query("""
WITH l AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id, count(*) FILTER (role = 'system') AS columns_score, CASE WHEN count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 THEN count(*) FILTER (role IN ('user', 'assistant')) ELSE 0 END AS grouped_score,
  CASE WHEN count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role IN ('user', 'assistant')) > count(*) FILTER (role = 'system') THEN 'grouped' ELSE 'columns' END AS model FROM l GROUP BY conv_id
""")
def pdf_08_row_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    return pages.row_model(_read(spark, sf_dir, "conversations"), ["conv_id"], role == "system", role == "user", role == "assistant")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders), l AS (SELECT o_custkey, o_orderkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(r.o_custkey, l.o_custkey) AS o_custkey, coalesce(r.rank, l.rank)::INT AS rank, r.o_orderkey AS row, line FROM r FULL JOIN l ON r.o_custkey = l.o_custkey AND r.rank = l.rank
""")
def join_11_12_zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return pages.zip_rows(o, o.filter("o_orderkey % 4 <> 0"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'again' ELSE l_returnflag END AS str, CASE WHEN l_suppkey % 3 = 0 THEN 90.0 ELSE 50.0 END::DOUBLE AS confidence FROM lineitem")
def ocr_04_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("str"), F.lit(50.0).alias("confidence"), "l_suppkey")
    word = F.when(F.col("l_suppkey") % 3 == 0, "again").when(F.col("l_suppkey") % 3 == 1, " ").otherwise("worse")
    sure = F.when(F.col("l_suppkey") % 3 == 2, 20.0).otherwise(90.0)
    key = ["l_orderkey", "l_linenumber", "l_suppkey"]
    return pages.second_pass(i, i.select(*key, word.alias("str"), sure.alias("confidence")), key).drop("l_suppkey")


@query("""
WITH l AS (SELECT conv_id, turn, role, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, (min((turn, b)) FILTER (role = 'assistant'))[2] AS before, (max((turn, a)) FILTER (role = 'assistant'))[2] AS after, count(*) AS n FROM l WHERE role = 'assistant' GROUP BY conv_id
""")
def uix_33_anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.anchor_lines(_read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant")


@query("SELECT page_id, 'seen <file> and mine for ' || page_id AS shown FROM pages")
def priv_04_05_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("seen "), F.regexp_replace("url", r"[^a-z0-9]", "_"), F.lit(".CSV and secret.pdf for "), F.col("page_id").cast("string"))
    return _read(spark, sf_dir, "pages").select("page_id", text.redact_stack(text.strip_filenames(s, {"secret.pdf": "mine"})).alias("shown"))


@query("""
WITH i AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id AS page, min(x) FILTER (k % 5 <> 0) AS least, min(x) FILTER (k % 5 <> 0 AND x >= 0 AND x < 0.2) AS least_in_band FROM i GROUP BY vec_id
""")
def agg_19_20_21_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("x"), F.when((i + 1) % 5 != 0, x.cast("double")).alias("confidence")))
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), items.alias("items"))
    return e.select("page", pages.confidence("items")["least"].alias("least"), pages.confidence("items", 0.0, 0.2)["least"].alias("least_in_band"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type || '|' || p_brand WHEN 2 THEN '' ELSE p_type || '|' || p_brand || '|' || p_name END AS touched FROM part")
def join_10_items_for_text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's type, brand and name as items of a line: ranges over one, over the seam of two, over a space alone, over all."""
    items = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.col(c).alias("str")) for k, c in enumerate(("p_type", "p_brand", "p_name"))])
    k, n = F.col("p_partkey") % 4, F.length("p_type")
    start = F.when(k == 0, n + 1).when(k == 1, n - 1).when(k == 2, n).otherwise(0)
    size = F.when(k == 0, F.length("p_brand")).when(k == 1, 3).when(k == 2, 1).otherwise(1000)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(pages.items_in_range(items, start, size), "|").alias("touched"))


_FIELDS = [("date", "date"), ("amount", "amount"), ("description", "comment"), ("balance", "balance")]


@query("SELECT l_orderkey AS file_id, field, col AS column, CASE WHEN field <> 'amount' THEN conf ELSE CASE l_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.36 ELSE 0.82 END END::DOUBLE AS confidence FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES ('date', 0, 0.82::DOUBLE), ('amount', 1, 1.0), ('description', 2, 0.92)) v(field, col, conf)")
def join_15_16_suggest_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a table of three columns; the amount's header names it, holds its name, or says nothing."""
    word = F.concat_ws(" ", F.lit("part"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    g = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("d"), F.collect_list(F.format_number("l_extendedprice", 2)).alias("a"), F.collect_list(word).alias("w"))
    money = F.when(F.col("l_orderkey") % 3 == 0, "Amount").when(F.col("l_orderkey") % 3 == 1, "Figure").otherwise("Gross Amount")
    columns = g.select(F.col("l_orderkey").alias("file_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("column"), h.alias("header"), F.col(c).alias("values")) for i, (h, c) in enumerate(((F.lit("Ship Date"), "d"), (money, "a"), (F.lit("Comment"), "w")))])))
    return infer.suggest_mapping(columns, spark.createDataFrame(_FIELDS, "field string, term string"))


@query("""
SELECT c_custkey, n_name AS bank, CASE WHEN c_custkey % 3 = 0 THEN 'credit_card' WHEN c_custkey % 3 = 1 THEN 'current_account' ELSE '' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'SGD' ELSE 'CHF' END AS currency
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def str_17_18_19_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nation as the bank's name, in the text or in the file's name."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = [r.n_name for r in nation.orderBy("c_nationkey").collect()]  # the vocabulary: a fixed list of 25
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "Credit Card statement").when(k % 3 == 1, "your current account").otherwise("statement")
    money = F.when(k % 2 == 0, "total S$12.00").otherwise("total CHF 12.00")
    c = _read(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").withColumn("t", F.concat_ws(" ", kind, money, F.when(k % 5 == 0, F.col("n_name"))))
    file = F.concat(F.lit("x_"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_2026.csv"))
    return c.select("c_custkey", text.first_name("t", file, names).alias("bank"), text.statement_type("t").alias("type"), text.currency_in_text("t", ("CHF", "NOK")).alias("currency"))


@query("SELECT l_orderkey AS file_id, field, CASE WHEN field = 'date' AND l_orderkey % 2 = 1 THEN 3 ELSE col END AS column FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES ('date', 0), ('description', 2), ('amount', 1)) v(field, col)")
def join_18_seed_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved mapping on tables that have all, or only some, of its headers; suggestions fill what is missing, but for columns that are taken."""
    dated = F.when(F.col("file_id") % 2 == 0, "Ship Date").otherwise("Sent")
    of = lambda *cs: F.inline(F.array(*[F.struct(F.lit(i).alias("column"), (h if isinstance(h, Column) else F.lit(h)).alias("header")) for i, h in cs]))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    orders_ = dealt(lines, "file_id", lines.count(), 100_000).distinct()
    columns = orders_.select("file_id", of((0, dated), (1, "Value"), (2, " comment "), (3, "Posted")))
    saved = spark.createDataFrame([("date", "ship date"), ("description", "Comment"), ("amount", "Amount")], "field string, header string")
    suggested = orders_.select("file_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("column")) for f, c in (("amount", 1), ("balance", 2), ("date", 3))])))
    return infer.seed_mapping(saved, columns, suggested)
