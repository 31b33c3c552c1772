"""Queries over statements as lines and items: columns, groups, checks, recognised words, and files to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import normalise, pages, recognised
from tallyforge.operators import statement_pages as sp
from tallyforge.plans.registry import query, read
from tallyforge.plans.views import ITEMS, LINES, duck, items, lines

L = f"({duck(LINES)}) lines"
I = f"({duck(ITEMS)}) items"  # noqa: E741

#: The grouped model in SQL, over the same lines.
_GROUPED = f"""
WITH l AS (
  SELECT *, regexp_matches(text, '^\\d{{2}} [A-Z][a-z]{{2}} \\d{{4}}$') AS is_day, regexp_matches(text, '(SGD|EUR) -?\\d+\\.\\d\\d$') AND NOT starts_with(text, 'Available') AS is_amt,
    starts_with(text, 'Available') OR starts_with(text, 'Page') AS noise FROM {L}
), s AS (
  SELECT *, last_value(CASE WHEN is_day THEN text END IGNORE NULLS) OVER w AS day, coalesce(sum((is_day OR is_amt)::INT) OVER b, 0)::BIGINT AS block,
    coalesce(last_value(CASE WHEN is_day THEN false WHEN is_amt THEN NOT regexp_matches(text, '^(SGD|EUR) ') END IGNORE NULLS) OVER b, false) AS claims
  FROM l WINDOW w AS (PARTITION BY file_id ORDER BY line ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT file_id, block, min(text) FILTER (r = 1) AS type FROM (SELECT *, row_number() OVER (PARTITION BY file_id, block ORDER BY line) AS r FROM s WHERE claims AND NOT is_day AND NOT is_amt) GROUP BY ALL
), parts AS (
  SELECT file_id, block, line, is_amt, day, text AS whole, CASE WHEN is_amt THEN trim(regexp_replace(text, '(SGD|EUR) -?\\d+\\.\\d\\d$', '')) ELSE text END AS part FROM s WHERE day IS NOT NULL AND NOT is_day AND (is_amt OR NOT claims AND NOT noise)
), rows AS (
  SELECT file_id, block, min(day) AS day, coalesce(string_agg(part, ' ' ORDER BY line) FILTER (part <> ''), '') AS description_raw, max(whole) FILTER (is_amt) AS whole, min(line) AS first_line, max(line) FILTER (is_amt) AS last_line FROM parts GROUP BY ALL HAVING bool_or(is_amt)
)
SELECT rows.file_id, (row_number() OVER (PARTITION BY rows.file_id ORDER BY rows.block))::INT AS row, day, description_raw, CAST(round(CAST(regexp_extract(whole, '(-?\\d+\\.\\d\\d)$', 1) AS DECIMAL(18, 2)) * 100) AS BIGINT) AS minor,
  regexp_extract(whole, '(SGD|EUR) -?\\d+\\.\\d\\d$', 1) AS currency, coalesce(type, '') AS type, first_line, last_line
FROM rows LEFT JOIN t ON t.file_id = rows.file_id AND t.block = rows.block + 1
"""


@query(_GROUPED)
def win_09_pdf_05_16_17_grouped_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all pages to rows of the grouped model, with where each row stands."""
    return sp.grouped_statement(lines(spark, sf_dir)).drop("mark")


@query(f"SELECT * FROM ({_GROUPED}) g WHERE row <= 3")
def pdf_21_22_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each statement: a preview's limit."""
    return sp.grouped_statement(lines(spark, sf_dir)).drop("mark").filter("row <= 3")


@query(f"""
WITH l AS (SELECT *, regexp_matches(text, '^\\d{{2}} [A-Z][a-z]{{2}} \\d{{4}}$') AS is_day, regexp_matches(text, '(SGD|EUR) -?\\d+\\.\\d\\d$') AND NOT starts_with(text, 'Available') AS is_amt FROM {L}),
o AS (SELECT *, bool_or(is_day) OVER (PARTITION BY file_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS opened FROM l)
SELECT file_id, line, CASE WHEN is_day THEN 'date' WHEN opened AND is_amt THEN 'amount' WHEN starts_with(text, 'Available') OR starts_with(text, 'Page') THEN 'noise' ELSE 'text' END AS kind FROM o WHERE opened
""")
def pdf_20_grid_08_classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the first date on, by kind."""
    return sp.classify_lines(lines(spark, sf_dir)).filter("opened").select("file_id", "line", "kind")


@query(f"""
WITH a AS (SELECT file_id, count(*) FILTER (regexp_matches(text, '(SGD|EUR) -?\\d+\\.\\d\\d$') AND NOT starts_with(text, 'Available')) AS n FROM {L} GROUP BY file_id), r AS (SELECT o_custkey AS file_id, count(*) FILTER (o_orderkey % 4 <> 0) AS m FROM orders GROUP BY o_custkey)
SELECT file_id, m AS extracted, n AS amount_lines, m - n AS diff, CASE WHEN m = n THEN 'count check' WHEN m < n THEN 'count check (' || n - m || ' amount line(s) not extracted)' ELSE 'count check (' || m - n || ' extra row(s) extracted)' END AS explanation FROM a JOIN r USING (file_id)
""")
def agg_14_count_check_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row"))
    return sp.count_check_grouped(lines(spark, sf_dir), rows)


@query(f"""
WITH a AS (SELECT file_id, line, row_number() OVER (PARTITION BY file_id ORDER BY line) AS rank FROM {L} WHERE regexp_matches(text, '(SGD|EUR) -?\\d+\\.\\d\\d$') AND NOT starts_with(text, 'Available')),
r AS (SELECT o_custkey AS file_id, o_orderkey AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.file_id, r.file_id) AS file_id, coalesce(a.rank, r.rank)::INT AS rank, row, line FROM a FULL JOIN r ON a.file_id = r.file_id AND a.rank = r.rank WHERE row IS NULL OR line IS NULL
""")
def sta_08_unmatched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row"))
    return sp.unmatched_lines(lines(spark, sf_dir), rows)


@query(f"""
WITH a AS (SELECT file_id, CASE WHEN file_id % 4 = 0 THEN position(' -' IN text) > 0 ELSE false END AS signed, CASE WHEN file_id % 4 = 1 THEN (CASE WHEN position(' -' IN text) > 0 THEN 'D' ELSE 'C' END) WHEN file_id % 4 = 2 AND o_orderkey % 5 = 0 THEN 'C' END AS mark, (CASE WHEN o_orderkey % 2 = 0 THEN 300 ELSE 420 END)::DOUBLE AS x FROM {L} WHERE k = 3),
g AS (SELECT *, x - lag(x) OVER w AS gap, row_number() OVER w - 1 AS l FROM a WINDOW w AS (PARTITION BY file_id ORDER BY x)),
n AS (SELECT file_id, count(*) AS n, count(*) FILTER (signed) AS s, count(mark) AS m, count(*) FILTER (mark = 'C') AS c, count(*) FILTER (mark = 'D') AS d, max(gap) AS gap, min(l) FILTER (gap >= 20) AS l FROM g GROUP BY file_id)
SELECT file_id, CASE WHEN s / n > 0.5 THEN 'signed' WHEN m / n > 0.5 THEN 'crdr' WHEN m > 0 AND s = 0 AND c >= d THEN 'positiveIsOut' WHEN n >= 4 AND gap >= 20 AND l >= 0.15 * n AND n - l >= 0.15 * n THEN 'columnBands' END AS convention,
  (CASE convention WHEN 'signed' THEN s / n WHEN 'crdr' THEN m / n WHEN 'positiveIsOut' THEN m / n WHEN 'columnBands' THEN 1.0 ELSE 0.0 END)::DOUBLE AS confidence, CASE WHEN convention = 'columnBands' THEN 360.0::DOUBLE END AS split FROM n
""")
def pdf_07_uix_35_sign_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount lines of four kinds of statements: signed, marked, marked in part, and in two columns."""
    minus, k = F.col("_amount.minor") < 0, F.col("file_id") % 4
    mark = F.when(k == 1, F.when(minus, "D").otherwise("C")).when((k == 2) & (F.col("o_orderkey") % 5 == 0), "C")
    x = F.when(F.col("o_orderkey") % 2 == 0, 300.0).otherwise(420.0)
    a = sp.classify_lines(lines(spark, sf_dir)).filter("kind = 'amount'").select("file_id", ((k == 0) & minus).alias("signed"), mark.alias("mark"), x.alias("x"))
    return sp.sign_convention(a)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("file_id", "line").agg(F.array_sort(F.collect_list(F.struct("x", "str"))).alias("items"))


_CLUSTERS = f"""
WITH RECURSIVE x AS (SELECT file_id, x, row_number() OVER (PARTITION BY file_id ORDER BY x) AS k FROM {I} WHERE c >= 2), n AS (SELECT file_id, max(line) AS n FROM {I} GROUP BY file_id),
f(file_id, k, total, m, g) AS (
  SELECT file_id, 1::BIGINT, x, 1::BIGINT, 1::BIGINT FROM x WHERE k = 1
  UNION ALL SELECT x.file_id, x.k, CASE WHEN x.x - total / m <= 30 THEN total + x.x ELSE x.x END, CASE WHEN x.x - total / m <= 30 THEN m + 1 ELSE 1 END, CASE WHEN x.x - total / m <= 30 THEN g ELSE g + 1 END FROM f JOIN x ON x.file_id = f.file_id AND x.k = f.k + 1
), ends AS (SELECT file_id, g, max((m, total)) AS e FROM f GROUP BY file_id, g), strong AS (SELECT file_id, g, e[2] / e[1] AS mean, row_number() OVER (PARTITION BY file_id ORDER BY g DESC) AS r FROM ends JOIN n USING (file_id) WHERE e[1] >= greatest(2, n * 0.15))
"""


@query(f"{_CLUSTERS} SELECT file_id, count(mean)::INT AS n, round(coalesce(sum(mean), 0), 6) AS total FROM n LEFT JOIN (SELECT * FROM strong WHERE r <= 3) s USING (file_id) GROUP BY file_id")
def win_10_pdf_15_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of numbers of each statement: how many, and the sum of their means."""
    got = sp.numeric_columns(_placed(spark, sf_dir))
    return got.select("file_id", F.size("xs").alias("n"), F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""
{_CLUSTERS}, three AS (SELECT * FROM strong WHERE r <= 3), ranked AS (SELECT file_id, mean, count(*) OVER (PARTITION BY file_id) AS n, row_number() OVER (PARTITION BY file_id ORDER BY g) AS i FROM three),
named AS (SELECT file_id, mean, i, n, CASE n WHEN 1 THEN ['amount'] WHEN 2 THEN ['debit', 'credit'] ELSE ['debit', 'credit', 'balance'] END[i] AS field, lag(mean) OVER w AS b, lead(mean) OVER w AS a FROM ranked WINDOW w AS (PARTITION BY file_id ORDER BY i)),
bands AS (SELECT file_id, field, CASE WHEN i = 1 THEN greatest(108.0, mean - 24) ELSE (b + mean) / 2 END AS x0, CASE WHEN a IS NULL THEN 600.0 ELSE (mean + a) / 2 END AS x1 FROM named)
SELECT i.file_id, i.line, max(str) FILTER (c = 0) AS date, max(str) FILTER (c = 1) AS description_raw,
  string_agg(str, ' ' ORDER BY x) FILTER (field = 'amount') AS amount, string_agg(str, ' ' ORDER BY x) FILTER (field = 'debit') AS debit, string_agg(str, ' ' ORDER BY x) FILTER (field = 'credit') AS credit, string_agg(str, ' ' ORDER BY x) FILTER (field = 'balance') AS balance
FROM {I.replace(") items", ") i")} LEFT JOIN bands ON bands.file_id = i.file_id AND i.x >= x0 AND i.x < x1 AND c >= 2 GROUP BY i.file_id, i.line HAVING i.file_id IN (SELECT file_id FROM bands)
UNION ALL SELECT file_id, line, max(str) FILTER (c = 0), max(str) FILTER (c = 1), string_agg(str, ' ' ORDER BY x) FILTER (c >= 2 AND x >= 390), NULL, NULL, NULL FROM {I.replace(") items", ") i")} WHERE file_id NOT IN (SELECT file_id FROM bands) GROUP BY file_id, line
""")
def pdf_09_10_column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by the places of numbers alone, and the cells of every line."""
    placed = _placed(spark, sf_dir)
    got = sp.cells(placed, sp.column_bands(placed, 600.0, F.lit(True)))
    cell = lambda f: F.try_element_at("cells", F.lit(f)).alias(f)
    # Where the fixed shares of the width apply, a number left of 390 falls into the description.
    description = F.get(F.filter("items", lambda i: ~sp.is_number(i["str"]) & (i["x"] > 108)), F.lit(0))["str"]
    return got.select("file_id", "line", cell("date"), description.alias("description_raw"), *[cell(f) for f in ("amount", "debit", "credit", "balance")])


@query("""
SELECT n_nationkey AS file_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 2 END::INT AS line, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'date,debit,credit,balance' ELSE 'date,description_raw,amount,-' END AS fields FROM nation
""")
def pdf_12_13_14_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose second line is a header, or isn't, with a header-like line below the first date."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), "n_name")
    words = F.when(F.col("file_id") % 3 == 0, F.array("n_name", F.lit("Dates"), F.lit("x"), F.lit("y"))).when(F.col("file_id") % 2 == 0, F.array(*map(F.lit, ("Date", "Withdrawals", "Deposits", "Balance")))).otherwise(F.array(F.lit("Dated"), F.lit("Particulars"), F.lit("Amount SGD"), F.col("n_name")))
    item = lambda a: F.transform(a, lambda s, i: F.struct((i * 100).cast("double").alias("x"), s.alias("str")))
    rows = [(1, F.array("n_name", F.lit("Statement"))), (2, words), (3, F.array(F.lit("2026-01-01"), F.lit("5.00"))), (4, F.array(F.lit("Date"), F.lit("Amount")))]
    ls = n.select("file_id", F.inline(F.array(*[F.struct(F.lit(i).alias("line"), item(w).alias("items")) for i, w in rows])))
    found = sp.header_lines(ls, F.col("line") == 3)
    return n.join(found, "file_id", "left").select("file_id", "line", F.array_join(F.transform("items", lambda i: F.coalesce(sp.header_field(i["str"]), F.lit("-"))), ",").alias("fields"))


@query(f"""
WITH RECURSIVE x AS (SELECT file_id, x, row_number() OVER (PARTITION BY file_id ORDER BY x) AS k FROM {I}), n AS (SELECT file_id, max(line) AS n FROM {I} GROUP BY file_id HAVING max(line) >= 2),
f(file_id, k, total, m, g) AS (
  SELECT file_id, 1::BIGINT, x, 1::BIGINT, 1::BIGINT FROM x WHERE k = 1
  UNION ALL SELECT x.file_id, x.k, CASE WHEN x.x - total / m <= 5 THEN total + x.x ELSE x.x END, CASE WHEN x.x - total / m <= 5 THEN m + 1 ELSE 1 END, CASE WHEN x.x - total / m <= 5 THEN g ELSE g + 1 END FROM f JOIN x ON x.file_id = f.file_id AND x.k = f.k + 1
), ends AS (SELECT file_id, g, max((m, total)) AS e FROM f GROUP BY file_id, g)
SELECT file_id, n::BIGINT AS rows, count(*) FILTER (e[1] / n >= 0.5)::INT AS columns, round(avg(e[1] / n), 9) AS confidence FROM ends JOIN n USING (file_id) GROUP BY file_id, n
""")
def pdf_11_generic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements without a layout as tables: rows, columns and confidence."""
    got = sp.generic_table(_placed(spark, sf_dir), F.lit(True))
    return got.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("row")).alias("columns"), F.round(F.max("confidence"), 9).alias("confidence"))


@query("SELECT vec_id AS page, coalesce(max(h) FILTER (h > 0), 10)::DOUBLE AS height FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS h FROM embeddings) GROUP BY vec_id")
def pdf_18_line_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.transform("embedding", lambda h: F.struct(h.cast("double").alias("height"))).alias("items"))
    return e.select("page", sp.line_height("items").alias("height"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN '01 Jan 2026' END AS period_start, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 28 + 1) || ' Mar 2026' END AS period_end FROM orders")
def str_35_udf_01_statement_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved pattern with two groups on texts that have a period, or none."""
    end = F.concat((F.col("o_orderkey") % 28 + 1).cast("string"), F.lit(" Mar 2026"))
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("to "), end)).otherwise(F.concat(F.lit("Period 01 Jan 2026 to "), end, F.lit(", ")))
    got = sp.statement_period(shown, r"Period (\d+ \w+ \d{4}) to (\d+ \w+ \d{4})")
    return read(spark, sf_dir, "orders").select("o_orderkey", got.alias("p")).select("o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query(f"SELECT file_id, count(*) FILTER (k = 3) AS amount_lines, min(line) FILTER (k = 3) AS first_line FROM {L} GROUP BY file_id")
def pdf_01_04_amount_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as items, joined to text again; those that end with an amount and a currency."""
    split = lines(spark, sf_dir).select("file_id", "line", F.transform(F.split("text", " "), lambda s, i: F.struct((i * 60).cast("double").alias("x"), s.alias("str"))).alias("items"))
    got = text.with_amount_lines(split, pages.line_text("items")).select("file_id", "line", F.col("_amount.currency").isNotNull().alias("ends"))
    return got.groupBy("file_id").agg(F.count_if("ends").alias("amount_lines"), F.min(F.when(F.col("ends"), F.col("line"))).alias("first_line"))


# --- recognised words ------------------------------------------------------


@query("""
SELECT p_partkey, regexp_matches(w, '^([+-]?[0-9,]+\\.[0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}([/.-][0-9]{2,4})?|[A-Z]{3}|[0-9]{1,2})$') AS shaped
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) WHEN 1 THEN upper(substr(p_name, 1, 3)) WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN p_size || '/' || p_size ELSE p_brand END AS w FROM part)
""")
def ocr_01_word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    w = F.when(k == 0, F.col("p_retailprice").cast("decimal(12,2)").cast("string")).when(k == 1, F.upper(F.substring("p_name", 1, 3))).when(k == 2, F.col("p_size").cast("string")).when(k == 3, F.concat_ws("/", F.col("p_size").cast("string"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", recognised.looks_like_amount_or_date(w).alias("shaped"))


@query("""
WITH w AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN l_partkey % 6 = 0 THEN ' ' ELSE l_returnflag END AS t, (l_suppkey % 300)::DOUBLE AS x0, (l_linenumber * 20)::DOUBLE AS y0, l_quantity AS h FROM lineitem)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY n, t, x0, h) - 1)::INT AS item, t AS str, x0 / 2 AS x, 800 - (y0 + 15) / 2 AS y, 30.0::DOUBLE AS width, (h / 2)::DOUBLE AS height FROM w WHERE trim(t) <> ''
""")
def ocr_02_03_words_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of pixels for each of an order's lines, blank words dropped, in points."""
    box = lambda x0, y0, x1, y1: F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    x0, y0 = F.col("l_suppkey") % 300, F.col("l_linenumber") * 20
    word = F.struct(F.when(F.col("l_partkey") % 6 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"), box(x0, y0, x0 + 60, y0 + F.col("l_quantity")).alias("box"), F.lit(90.0).alias("confidence"))
    line = F.struct("l_linenumber", box(F.lit(0), y0, F.lit(600), y0 + 15).alias("box"), F.array(word).alias("words"))
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumns({"scale": F.lit(2.0), "page_height": F.lit(800.0)})
    return recognised.words_of_lines(p, "page").select("page", "item", "word.str", "word.x", "word.y", "word.width", "word.height")


@query("""
SELECT l_orderkey AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS line, (1000 - 12 * l_linenumber)::DOUBLE AS y, l_linenumber || ' ' || min(l_linestatus) || ' ' || min(l_returnflag) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def win_06_lines_by_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words a line that are of different heights and start a little apart, in any order, grouped by their centres."""
    y = 1000 - 12 * F.col("l_linenumber")
    item = lambda x, up, h, s: F.struct(F.lit(x).alias("x"), (y + up).cast("double").alias("y"), F.lit(h).alias("height"), s.cast("string").alias("str"))
    words = F.array(item(300.0, 1.0, 8.0, F.col("l_returnflag")), item(10.0, 0.0, 10.0, F.col("l_linenumber")), item(90.0, 2.0, 7.0, F.col("l_linestatus")))
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("l_returnflag")).groupBy("page").agg(F.flatten(F.collect_list(words)).alias("items"))
    return recognised.lines_by_centre(p, "page").select("page", "line", "y", pages.line_text("items").alias("text"))


def _amount_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a page: a word, the currency, and the amount, of which a few have lost their cents."""
    amount = F.when(F.col("l_partkey") % 4 == 0, F.floor("l_extendedprice").cast("string")).otherwise(F.col("l_extendedprice").cast("decimal(15,2)").cast("string"))
    word = lambda x, s, w: F.struct(s.alias("str"), F.lit(x).alias("x"), (F.col("l_linenumber") * 10).cast("double").alias("y"), F.lit(w).alias("width"), F.lit(8.0).alias("height"), F.lit(80.0).alias("confidence")).cast(recognised.WORD)
    one = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_extendedprice").alias("l_extendedprice"))
    return one.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), "l_partkey", F.array(word(10.0, F.lit("shop"), 30.0), word(50.0, F.concat(F.lit("SGD"), amount), 90.0)).alias("items"))


@query("""
WITH a AS (SELECT l_orderkey AS page, l_linenumber AS line, 'SGD' || CASE WHEN l_partkey % 4 = 0 THEN CAST(floor(l_extendedprice)::BIGINT AS STRING) ELSE CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS STRING) END AS s, l_partkey % 4 <> 0 AS cents FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL))
SELECT page, line, 1 AS first, 1 AS last, s AS matched, 3 AS prefix_end, cents AS has_decimal, round(50 + 3 / length(s) * 90, 6) AS x0, 140.0::DOUBLE AS x1 FROM a
""")
def ocr_05_06_retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts glued to their currency: which word to read again, and where the number begins in it."""
    got = recognised.retry_candidates(_amount_words(spark, sf_dir), "page")
    return got.select("page", "line", "first", "last", "matched", "prefix_end", "has_decimal", F.round("box.x0", 6).alias("x0"), F.col("box.x1").alias("x1"))


@query("""
WITH a AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey, 'SGD' || CASE WHEN l_partkey % 4 = 0 THEN CAST(floor(l_extendedprice)::BIGINT AS STRING) ELSE CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS STRING) END AS s FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)),
b AS (SELECT *, l_partkey % 8 = 0 AS better, avg((l_partkey % 4 <> 0 OR l_partkey % 8 = 0)::INT) OVER (PARTITION BY page) AS share FROM a)
SELECT page, line, CASE WHEN better THEN 'SGD7.50' ELSE s END AS str, (CASE WHEN better THEN 95 WHEN l_partkey % 4 = 0 AND share > 0.5 THEN 0 ELSE 80 END)::DOUBLE AS confidence FROM b
""")
def ocr_07_apply_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _amount_words(spark, sf_dir)
    tried = recognised.retry_candidates(words, "page").join(words.select("page", "line", "l_partkey"), ["page", "line"]).withColumns({"retry_str": F.when(F.col("l_partkey") % 8 == 0, "7.50").otherwise("7"), "retry_confidence": F.lit(95.0)})
    flat = words.select("page", "line", F.posexplode("items").alias("item", "word"))
    return recognised.apply_retries(flat, tried, "page").filter("item = 1").select("page", "line", "word.str", "word.confidence")


# --- from records to rows --------------------------------------------------

_VERSION = normalise.Version(
    {"date": ["When"], "description_raw": ["Clerk", "Kind"], "amount": ["Amount"], "currency": ["Cur"], "balance": ["Balance"]}, date_format="DD/MM/YYYY", sign_convention="positiveIsOut", currency="SGD",
    transforms=(normalise.Transform("description_raw", "lower"), normalise.Transform("description_raw", "replace", "clerk#0+", "clerk ", True), normalise.Transform("amount", "upper"), normalise.Transform("description_raw", "replace", "urgent", "soon")),
)


@query("""
WITH r AS (
  SELECT o_custkey AS file_id, o_orderkey AS row, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date, replace(regexp_replace(lower('Clerk#0' || o_orderstatus || ' ' || o_orderpriority), 'clerk#0+', 'clerk ', 'g'), 'urgent', 'soon') AS description_raw,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) ELSE -CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS amount, CASE WHEN o_orderkey % 6 = 1 THEN 'EUR' ELSE 'SGD' END AS currency, o_orderkey % 6 = 2 AS unknown FROM orders
), b AS (SELECT *, 5000 + sum(coalesce(amount, 0)) OVER (PARTITION BY file_id ORDER BY row ROWS UNBOUNDED PRECEDING) + CASE WHEN row % 17 = 0 THEN 100 ELSE 0 END AS s FROM r), c AS (SELECT *, CASE WHEN row % 4 <> 0 THEN CAST(s AS BIGINT) END AS balance FROM b),
l AS (SELECT *, lag(balance) OVER w AS pb, lag(amount) OVER w AS pa, lead(balance) OVER w AS nb FROM c WHERE balance IS NOT NULL AND amount IS NOT NULL WINDOW w AS (PARTITION BY file_id ORDER BY row)),
f AS (SELECT *, pb + amount = balance AS down, balance + pa = pb AS up, nb + amount = balance AS own FROM l), m AS (SELECT *, count(down) OVER p AS n, sum(down::INT) OVER p AS nd, sum(up::INT) OVER p AS nu FROM f WINDOW p AS (PARTITION BY file_id)),
bad AS (SELECT row FROM m WHERE coalesce(greatest(nd, nu) * 2 >= n AND CASE WHEN nd >= nu THEN NOT down ELSE NOT own END, false)),
d AS (SELECT row, row_number() OVER (PARTITION BY file_id, date, amount, currency, lower(description_raw) ORDER BY row) > 1 AS dup FROM c)
SELECT file_id, c.row, date, description_raw, amount, currency, balance,
  array_to_string([x FOR x IN [CASE WHEN date IS NULL THEN 'unparseable_date' END, CASE WHEN amount IS NULL THEN 'missing_amount' END, CASE WHEN unknown THEN 'unknown_currency' END, CASE WHEN dup THEN 'possible_duplicate' END, CASE WHEN bad.row IS NOT NULL THEN 'balance_mismatch' END] IF x IS NOT NULL], ';') AS flags
FROM c JOIN d USING (row) LEFT JOIN bad USING (row)
""")
def norm_03_04_05_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From records of text to checked rows in one chain: sources, dates, amounts, currencies, transforms, flags."""
    i, price = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100 + 0.5)
    signed = F.when(i % 10 == 0, None).when(i % 3 == 0, price).otherwise(-price)
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    stated = 5000 + F.sum(F.coalesce(signed, F.lit(0))).over(w) + F.when(i % 17 == 0, 100).otherwise(0)
    shown = lambda c: F.format_number(c.cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    o = read(spark, sf_dir, "orders").withColumn("stated", F.when(i % 4 != 0, stated))
    cells = {
        "When": F.when(i % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), "Clerk": F.concat(F.lit("Clerk#0"), "o_orderstatus"), "Kind": F.col("o_orderpriority"),
        "Amount": F.when(i % 10 == 0, "-").when(i % 3 == 0, F.concat(F.lit("("), shown(price), F.lit(")"))).otherwise(shown(price)), "Cur": F.when(i % 6 == 1, "EUR").when(i % 6 == 2, "XQX").otherwise(""), "Balance": F.coalesce(shown(F.col("stated")), F.lit("")),
    }
    records = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row"), F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]).alias("record"))
    return normalise.file_rows(records, _VERSION).withColumn("flags", F.array_join("flags", ";"))


_PLACED = """
SELECT o_custkey AS file_id, o_orderkey AS line, CAST((nth - 1) DIV 40 AS INT) AS page, CAST(800 - ((nth - 1) % 40) * 14.5 AS DOUBLE) AS y, o_orderpriority AS text
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM {orders}) o
"""


@query(f"""
WITH l AS ({_PLACED.replace("{orders}", "orders").replace(" DIV ", " // ")}),
r AS (SELECT file_id, line AS row, page, y - CASE WHEN line % 5 = 0 THEN 29 ELSE 0 END - 6 AS top, y + 6 AS bottom FROM l WHERE line % 3 = 0 AND line % 7 <> 0)
SELECT r.file_id, r.row, count(*) AS n, min(l.line) AS first_line, max(l.line) AS last_line FROM r JOIN l ON l.file_id = r.file_id AND l.page = r.page AND l.y BETWEEN top AND bottom GROUP BY ALL
""")
def uix_23_join_12_lines_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows back to the lines of their bands on the page; some reach over three lines, some have no place."""
    l = spark.sql(_PLACED, orders=read(spark, sf_dir, "orders"))  # noqa: E741
    i = F.col("line")
    anchor = pages.page_anchor(F.when(i % 7 != 0, F.col("page")), F.col("y"), F.lit(12.0), F.when(i % 5 == 0, F.col("y") - 29))
    rows = l.filter("line % 3 = 0").select("file_id", F.col("line").alias("row"), anchor.alias("anchor"))
    found = pages.lines_of_rows(rows, l, ["file_id"])
    return found.groupBy("file_id", "row").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
