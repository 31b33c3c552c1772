"""Scalar functions on tables of cases, whole statements, and every query against DuckDB."""

import io
import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import amounts, dates, text
from tallyforge.operators import export, grid, ledger, pages, review
from tallyforge.plans.catalog import ORACLES, QUERIES
from tallyforge.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r.o for r in df.select("i", column.alias("o")).orderBy("i").collect()]


AMOUNTS = [
    ("1,234.56", (123456, None, None)), ("1.234,56", (123456, None, None)), ("(45.20)", (-4520, None, None)), ("45.20-", (-4520, None, None)), ("-(5)", (-500, None, None)), ("+7", (700, None, None)),
    ("S$12.00", (1200, "SGD", None)), ("us$ 3", (300, "USD", None)), ("$9.99", (999, None, None)), ("¥1,500", (1500, "JPY", None)), ("12.00 CR", (1200, None, "CR")), ("DR 8.10", (810, None, "DR")),
    ("ABC123", (12300, None, None)), ("1 234.50", (123450, None, None)), ("1 234,50", (123450, None, None)), ("0.005", (1, None, None)), ("1.005", (100, None, None)), ("12,34,567.00", (123456700, None, None)),
    ("", None), (None, None), ("abc", None), ("-", None), ("1-2", None),
]


def test_amounts(spark):
    got = values(spark, amounts.parse_amount("v"), [a for a, _ in AMOUNTS])
    assert [(a, None if g is None else tuple(g)) for (a, _), g in zip(AMOUNTS, got, strict=True)] == AMOUNTS


def test_separators_follow_the_format(spark):
    cases = ["1,234", "1.234", "1,23", "1.23", "1.2345"]
    assert values(spark, amounts.split_separators(F.col("v"), amounts.EU), cases) == ["1.234", "1234", "1.23", "1.23", "1.2345"]
    assert values(spark, amounts.split_separators(F.col("v")), cases) == ["1234", "1.234", "1.23", "1.23", "1.2345"]


def test_dates(spark):
    read = lambda f, items, y=None: values(spark, dates.parse_date("v", f, y), items)
    assert read("DD/MM/YYYY", ["5/9/2026", "31.12.99", "30/02/2026", "x", None, " 01-02-2026 "]) == ["2026-09-05", "2099-12-31", None, None, None, "2026-02-01"]
    assert read("MM/DD/YYYY", ["9/5/2026", "13/1/2026"]) == ["2026-09-05", None]
    assert read("DD MMM YYYY", ["05 Sep 2026", "5 september 26", "5 Xyz 2026"]) == ["2026-09-05", "2026-09-05", None]
    assert read("DD MMM", ["29 Feb", "1 Mar"], 2023) == [None, "2023-03-01"]
    assert read("DD/MM", ["1/2"]) == [None]
    assert values(spark, dates.format_date_out("v", "MMM D, YYYY"), ["2026-09-05", None]) == ["Sep 5, 2026", ""]
    assert values(spark, dates.format_date_out("v", "sheetsSerial"), ["1900-01-01"]) == ["2"]
    assert values(spark, dates.suggest_date_format("v"), [["13/01/2026", "02/03/2026"], ["01/13/2026"], ["2026-01-02"], ["3 Mar 2026"], ["nothing"]], "array<string>") == ["DD/MM/YYYY", "MM/DD/YYYY", "YYYY-MM-DD", "DD MMM YYYY", None]


def test_text(spark):
    assert values(spark, text.norm_header("v"), ["  Crédit  Größe ", "Año"]) == ["credit große", "ano"]
    assert values(spark, text.mask_account("v"), ["Account 123-456-789 x", "short 12345"]) == ["****6789", None]
    assert values(spark, text.mask_digit_runs("v"), ["12345 123456 1234567890"]) == ["12345 ###### ##########"]
    assert values(spark, text.mask_amounts("v"), ["paid 1,234.56 on 2026 for 7.00"]) == ["paid #,###.## on 2026 for #.##"]
    assert values(spark, text.fuzzy_in_text("v", F.lit("Monthly statment of account, page 1")), ["statement of account", "trial balance"]) == [True, False]
    assert values(spark, text.filename_signature("v", F.lit("Acme Bank")), ["Acme_Statement_2026-01.csv", "export_jan_2026.csv", "noext"]) == ["acme", "export", ""]
    assert values(spark, text.ocr_currency("v"), ["5GD", "U50", "12"]) == ["SGD", "USO", None]


SAVINGS = """Example test bank
Account 000-111-222

Transaction Date,Reference,Debit Amount,Credit Amount,Balance
15/09/2026,Coffee,45.20,,"4,954.80"
16/09/2026,Rent,120.00,,"4,834.80"
17/09/2026,Refund,,200.00,"5,034.80"
18/09/2026,Salary,,"5,000.00","10,034.80"
19/09/2026,Food,88.35,,"9,946.45"
Total,,253.55,"5,200.00",
"""


def test_whole_statement(spark):
    f = spark.createDataFrame([(1, SAVINGS)], "file_id int, text string")
    g = f.join(files.detect_delimiter(f), "file_id").select("file_id", files.parse_grid("text", "delimiter").alias("grid")).withColumn("h", grid.suggest_header_row("grid"))
    assert g.select("h", grid.footer_rows("grid", F.col("h"))).first()[:] == (2, 1)
    records = grid.apply_window(g, grid.Window(header_row=2, footers=(grid.Rule("startsWith", "total"),)))
    minor = lambda n: amounts.parse_amount(F.col("record")[n])["minor"]
    rows = records.select(
        "file_id", F.col("row").alias("row_id"), dates.parse_date(F.col("record")["Transaction Date"], "DD/MM/YYYY").alias("date"), F.col("record")["Reference"].alias("description"),
        amounts.resolve_amount(minor("Credit Amount"), minor("Debit Amount")).alias("amount"), minor("Balance").alias("balance"), F.lit("SGD").alias("currency"), F.lit("A").alias("account"),
    )
    assert [r.amount for r in rows.orderBy("row_id").collect()] == [-4520, -12000, 20000, 500000, -8835]
    s = ledger.file_summary(rows, "file_id").first()
    assert (s.n, s.total_in, s.total_out, s.first_date) == (5, 520000, 25355, "2026-09-15")
    assert ledger.balance_check(rows, ["file_id"], ["row_id"]).first().reconciles
    assert ledger.tag_balance_mismatches(rows, "file_id", ["row_id"]).filter("balance_mismatch").count() == 0
    layout = export.Layout.of("accounting")
    named = rows.withColumnRenamed("description", "description_raw")
    assert [r.line for r in export.delimited(named, layout, ("row_id",)).orderBy("row_id").collect()][:3] == ["2026-09-15,Coffee,45.20,,4954.80", "2026-09-16,Rent,120.00,,4834.80", "2026-09-17,Refund,,200.00,5034.80"]
    assert export.header_line(layout) == "Date,Description,Debit,Credit,Balance"


def test_mismatch_in_either_direction(spark):
    rows = [("up", i, a, b) for i, (a, b) in enumerate([(10, 100), (20, 90), (5, 70), (7, 65)])] + [("down", i, a, b) for i, (a, b) in enumerate([(10, 10), (20, 30), (5, 99), (7, 106)])]
    got = ledger.tag_balance_mismatches(spark.createDataFrame(rows, "file string, i int, amount long, balance long"), "file", ["i"])
    assert sorted((r.file, r.i) for r in got.filter("balance_mismatch").collect()) == [("down", 2)]


def test_layouts():
    x = export.Layout.of("simple").add("blank", "Notes").add("blank", "More").add("date", "Again").add("const", "Who", "me")
    assert [c.name for c in x.columns] == ["Date", "Description", "Amount", "Notes", "More", "Who"]
    assert [c.field for c in x.split_money().columns][2:4] == ["money_out", "money_in"]
    assert [c.name for c in x.move(0, 2).columns][:3] == ["Description", "Amount", "Date"]
    assert x.change(0, enabled=False).active()[0].field == "description_raw" and export.Layout.of("withBalance").matching() == "withBalance"
    assert export.Layout(" ").problems() == ["no name", "no column"]
    assert x.reorder([2, 0]).fields()[:3] == ("amount", "date", "description_raw") and not x.toggle(0).columns[0].enabled and x.toggle(0).toggle(0) == x
    assert x.same_settings(export.replace(x, name="other")) and not x.same_settings(x.option("header_row", False)) and not x.same_settings(None)
    assert [c.field for c in export.deduped((*x.columns, *x.columns))].count("blank") == 4 and export.picker_label(x, [export.replace(x, name="saved")]) == "saved"


def test_export_file_name(spark):
    assert values(spark, export.filename_of("v", F.lit("2026-01-31")), ["2026-01-01", "2026-01-31"]) == ["statement-export_2026-01-01_2026-01-31.csv", "statement-export_2026-01-31.csv"]


def test_saved_patterns(spark):
    from tallyforge.functions.patterns import checked, fault
    from tallyforge.operators.match import filename_score

    assert fault("x" * 301) and fault("(") and fault("(a+)+b") and fault("a", groups=1) and fault(r"(\d+) to (\d+)", groups=2) is None
    with pytest.raises(ValueError, match="refused"):
        checked("(a*)*")
    score = lambda p, names: values(spark, filename_score(F.lit(p), F.col("v")), names)
    assert score("acme.*q_1", ["2026 ACME x q_1.csv", "acmeq21.csv", "q_1 acme"]) == [1.0, 0.0, 0.0]
    assert score(r"^.*acme.*\.pdf$", ["my acme.pdf", "other.pdf"]) == [1.0, 0.0] and score("", ["x"]) == [0.0]
    with pytest.raises(Exception, match="not a file name pattern"):
        score("a(b", ["x"])


def test_many_profiles_are_dealt_out(spark, monkeypatch):
    from tallyforge.operators import bounds, match

    empty = "CAST(array() AS ARRAY<STRING>)"
    f = spark.range(20).selectExpr("id AS file_id", "'csv' AS type", "concat('tag', id, '.csv') AS name", "array('date', concat('h', id)) AS header", "'text' AS text")
    p = spark.range(50).selectExpr("concat('p', id) AS profile_id", "'csv' AS type", "'none' AS bank", "array('date') AS required", "array('date', concat('h', id)) AS header", f"{empty} AS keywords", f"{empty} AS anchors", "concat('tag', id) AS filename")
    plain = lambda: sorted(tuple(r) for r in match.match_profiles(f, p).collect())
    want = plain()
    monkeypatch.setattr(match, "BROADCAST", 7)
    assert plain() == want and len(want) >= 20
    with pytest.raises(ValueError, match="more than 3 rows"):
        bounds.bounded(f, 3, "rows")


def test_backups_are_checked(spark):
    from tallyforge.operators import learning

    docs = lambda *js: spark.createDataFrame([(j,) for j in js], "json string")
    assert [r.id for r in learning.read_backup(docs('{"profiles": [{"id": "a", "name": "b", "versions": []}]}')).collect()] == ["a"]
    for bad in ("no json", "{}", '{"profiles": [{"id": "a", "versions": []}]}'):
        with pytest.raises(Exception, match="backup"):
            learning.read_backup(docs(bad)).collect()


def test_no_transactions(spark):
    lines = ["Available balance 1,234.00", "Reward points 12.00", "Total 5.00", "Ref: 123.00", "Page 1 of 3", "16 Sep 2026 - 15 Oct 2026 5.00", "September 2026", "2026", "Monday, 15 Sep 2026", "Coffee 4.50", "Totally 4.50"]
    assert values(spark, text.amount_line("v")["minor"], lines) == [None] * 9 + [450, 450]
    assert values(spark, text.is_date_like("v"), ["1/2", "5 Sep", "1/2/2026", "5 Sep 2026"]) == [False, False, True, True]


def test_amounts_in_stages_and_in_one_expression(spark):
    said = ["1,234.56", "(12.5)", "-(3)", "S$ 7", "usd 1.234,56-", "€ 5", "CR 12", "12 DR", "JPY 500", "¥1,000", "", None, "none", "1 234,5", "+4", "5%", "((7))", "US$-9.99", "1.234", "1,23", "12.345,6 cr", "٣"]
    df = spark.createDataFrame([(v, c, f) for v in said for c in ("SGD", "JPY", None) for f in (None, amounts.US, amounts.EU)], "v string, c string, f string")
    got = amounts.with_amounts(df.select("*", amounts.parse_amount("v", F.col("c"), F.col("f")).alias("one")), staged=(F.col("v"), F.col("c"), F.col("f")), plain=(F.col("v"), None, None)).select("*", amounts.parse_amount("v").alias("bare")).collect()
    assert len(got) == len(said) * 9 and all(r.staged == r.one and r.plain == r.bare for r in got)
    assert sum(r.staged is not None for r in got) > 100


def test_review_log(spark):
    rows = spark.createDataFrame([(1, -500, 50, "2026-01-01", ["low_confidence", "ocr"]), (2, None, None, None, ["missing_amount", "ocr"]), (3, 7, None, "2026-01-02", [])], "row_id int, amount long, amount_alt long, date string, flags array<string>")
    log = [(1, 1, "use_alt", None, None), (2, 1, "edit", "amount", "900"), (2, 2, "edit", "amount", "901"), (2, 3, "undo", None, None), (2, 4, "confirm", None, None), (3, 1, "exclude", None, None), (3, 2, "undo", None, None), (3, 3, "undo", None, None)]
    got = {r.row_id: r for r in review.apply_events(rows, spark.createDataFrame(log, "row_id int, seq long, action string, field string, value string"), {"amount": "bigint"}).collect()}
    assert (got[1].amount, got[1].flags) == (50, ["ocr"])
    assert (got[2].amount, got[2].flags, got[2].edited, got[2].confirmed) == (900, ["ocr"], True, True)
    assert (got[3].excluded, got[3].edited) == (False, False)


def test_review_is_a_fold_of_row_states(spark):
    schema = "row_id int, amount long, amount_alt long, date string, flags array<string>, skipped boolean, low_confidence_hint string"
    rows = spark.createDataFrame(
        [
            (1, -500, 200, "2026-01-01", ["low_confidence_ocr"], False, "two?"),
            (2, -500, 200, "2026-01-01", ["low_confidence_ocr", "low_confidence_x"], False, "two?"),
            (3, None, None, "2026-01-01", ["missing_amount", "sign_unclear"], False, None),
            (4, None, None, None, ["possible_duplicate"], True, None),
            (5, 1, None, "2026-01-01", None, None, None),
            (6, 7, None, "2026-01-01", ["low_confidence_ocr"], False, None),
            (7, 7, None, "2026-01-01", ["sign_unclear"], False, None),
            (8, 1, None, "2026-01-01", [], False, None),
        ],
        schema,
    )
    log = [
        (1, 1, "use_alt", None, None, None), (1, 2, "edit", "amount", "300", None),
        (2, 1, "use_alt", None, None, None),
        (3, 1, "confirm", None, None, None),
        (4, 1, "treat", None, None, None), (4, 2, "edit", "amount", "5", None), (4, 3, "edit", None, None, {"date": "2026-02-02", "amount": "6"}),
        (5, 1, "edit_cell", "amount", "2", None), (5, 2, "exclude", None, None, None), (5, 3, "edit_cell", "amount", "3", None), (5, 4, "restore", None, None, None), (5, 5, "undo", None, None, None), (5, 6, "undo", None, None, None),
        (6, 1, "confirm_low", None, None, None), (7, 1, "confirm_low", None, None, None),
        (8, 1, "edit_cell", "nothing", "x", None), (8, 2, "edit_cell", "amount", None, None), (8, 3, None, None, None, None), (99, 1, "confirm", None, None, None),
    ]
    got = {r.row_id: r for r in review.apply_events(rows, spark.createDataFrame(log, "row_id int, seq long, action string, field string, value string, fields map<string,string>"), {"amount": "bigint", "date": "string"}).collect()}
    assert (got[1].amount, got[1].flags, got[1].confirmed, got[1].edited_fields, got[1].low_confidence_hint) == (300, [], True, {"amount": "-500"}, None)
    assert (got[2].amount, got[2].flags, got[2].edited, got[2].confirmed) == (200, ["low_confidence_x"], True, False)
    assert (got[3].flags, got[3].confirmed) == (["missing_amount"], False)
    assert (got[4].skipped, got[4].flags, got[4].amount, got[4].date, got[4].confirmed, got[4].edited_fields) == (False, [], 6, "2026-02-02", True, {"amount": None, "date": None})
    assert (got[5].amount, got[5].excluded, got[5].edited_fields, got[5].flags) == (2, False, {"amount": "1"}, [])
    assert (got[6].flags, got[6].confirmed) == ([], True) and (got[7].flags, got[7].confirmed) == (["sign_unclear"], False)
    assert (got[8].amount, got[8].edited, got[8].edited_fields) == (None, True, {"amount": "1"}) and len(got) == 8


def test_sniffing_and_decoding(spark):
    raw = [b"%PDF-1.7", b"PK\x03\x04", "é".encode(), "é".encode("cp1252"), b"\xff\xfe" + "é".encode("utf-16-le"), b"\xef\xbb\xbfx", b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, c binary").select("i", files.file_type("c").alias("t"), files.encoding("c").alias("e"), files.decode_text("c", files.encoding("c")).alias("s"))
    got = df.orderBy("i").collect()
    assert [r.t for r in got] == ["pdf", "xlsx", "text", "text", "text", "text", "text"]
    assert [r.s for r in got[2:]] == ["é", "é", "é", "x", ""]


def test_grids_of_large_and_missing_texts(spark, monkeypatch):
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 2000)
    monkeypatch.setattr(files, "SLICE_BYTES", 64)
    texts = ["a,b\n1,2", None, "x" * 2001, "", 'q;"r;s"\nt;u'] + [f"k,{i}" for i in range(60)]
    got = {r.file_id: r.grid for r in files.parse_grids(spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")).collect()}
    assert got[0] == [["a", "b"], ["1", "2"]] and got[1] is None and got[2] is None and got[3] == [] and got[4] == [["q", "r;s"], ["t", "u"]] and got[64] == [["k", "59"]] and len(got) == 65


def _workbook() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Date</t></si><si><t>Amo</t><t>unt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark):
    df = spark.createDataFrame([("a", bytearray(_workbook()), None), ("b", bytearray(_workbook()), "Two")], "path string, content binary, sheet string")
    got = {r.path: r.g for r in df.select("path", files.parse_workbook("content", "sheet").alias("g")).collect()}
    assert got == {"a": [["Date", "", "Amount"], ["x", "4.5"]], "b": [["7"]]}
    assert files.sheet_names(df).first().sheets == ["One", "Two"]


def test_grouped_lines(spark):
    lines = [(1, "header"), (2, "15 Sep 2026"), (3, "Coffee shop"), (4, "by the river 4.50"), (5, "Rent 120.00"), (6, "16 Sep 2026"), (7, "left over")]
    df = spark.createDataFrame([("f", *x) for x in lines], "file string, line int, text string")
    got = pages.grouped_rows(df, ["file"], ["line"], dates.parse_date("text", "DD MMM YYYY"), amounts.parse_amount(F.when(F.col("text").rlike(r"[.]\d\d$"), F.regexp_extract("text", r"(\S+)$", 1)))["minor"])
    assert [(r.row, r.date, r.amount, r.description) for r in got.orderBy("row").collect()] == [(1, "2026-09-15", 450, "Coffee shop by the river 4.50"), (2, "2026-09-15", 12000, "Rent 120.00")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v):.9g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda found, names: sorted(tuple(str(_plain(r[names.index(c)])) for c in cols) for r in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_mapping_is_suggested(spark):
    from tallyforge.operators import infer

    terms = spark.createDataFrame([("date", "date"), ("date", "datum"), ("description", "description"), ("description", "reference"), ("debit", "debit"), ("debit", "withdrawal"), ("credit", "credit"), ("balance", "balance"), ("amount", "amount"), ("currency", "currency")], "field string, term string")
    days, money, words = ["01/02/2026", "03/02/2026"], ["1,200.50", "7.00"], ["coffee", "rent of a room"]
    files_ = {
        "a": [("Transaction Date", days), ("Reference", words), ("Debit Amount", ["", "7.00"]), ("Credit Amount", ["5.00", ""]), ("Balance", money)],
        "b": [("When", days), ("What", words), ("Value", money)],
    }
    rows = [(f, i, h, v) for f, cs in files_.items() for i, (h, v) in enumerate(cs)]
    got = {(r.file_id, r.field): r.column for r in infer.suggest_mapping(spark.createDataFrame(rows, "file_id string, column int, header string, values array<string>"), terms).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"date": 0, "description": 1, "debit": 2, "credit": 3, "balance": 4}
    assert {k[1]: v for k, v in got.items() if k[0] == "b"} == {"date": 0, "amount": 2}
    c = spark.createDataFrame([("f", "p1", 0.95, 0.50, 1), ("f", "p2", 0.90, 0.80, 2), ("f", "p3", 0.89, 0.79, 3), ("f", "p4", 0.5, 1.0, 9)], "file_id string, profile_id string, confidence double, quality double, created int")
    assert infer.pick_candidate(c).collect()[0][:] == ("f", "p3")
    v = spark.createDataFrame([(["USD 5", "usd 7", "EUR 1", ""],)], "v array<string>")
    assert v.select(infer.column_fill("v").alias("c")).first().c[:] == (0.75, 1.0, "USD")


def test_grouped_statement_claims_types_and_drops_noise(spark):
    from tallyforge.operators import statement_pages as sp

    lines = [
        "Statement 1 Jan 2026 - 31 Jan 2026", "123 Main Road 55", "Monday, 15 Sep 2026", "Coffee shop SGD 4.50", "Point of sale", "more noise", "Rent of a room", "EUR -120.00", "Available balance SGD 10.00", "September 2026",
        "16 Sep 2026", "left over", "Amount: SGD 7.00", "Page 1 of 3", "Bus ticket 2.00 CR", "17 Sep 2026", "nothing follows",
    ]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_id string, line int, text string")
    got = [(r.day, r.description_raw, r.minor, r.currency, r.mark, r.type, r.first_line, r.last_line) for r in sp.grouped_statement(df).orderBy("row").collect()]
    assert got == [
        ("15 Sep 2026", "Coffee shop", 450, "SGD", None, "Point of sale", 3, 3), ("15 Sep 2026", "", -12000, "EUR", None, "", 7, 7),
        ("16 Sep 2026", "left over", 700, "SGD", None, "", 11, 12), ("16 Sep 2026", "Bus ticket", 200, None, "C", "", 14, 14),
    ]
    assert sp.grouped_statement(df.limit(0)).count() == 0


def test_columns_from_headers_places_and_shares(spark):
    from tallyforge.operators import statement_pages as sp

    item = lambda x, s: {"x": float(x), "str": s}
    files_ = {
        "header": [[item(40, "Date"), item(130, "Details"), item(400, "Withdrawal"), item(500, "Balance")], [item(40, "2026-01-01"), item(130, "x"), item(405, "5.00"), item(498, "10.00")]],
        "places": [[item(40, "2026-01-01"), item(400 + i, "5.00"), item(500 - i, "1,000.00 CR")] for i in range(4)],
        "none": [[item(40, "2026-01-01"), item(130, "text")]],
    }
    lines = spark.createDataFrame([(f, i, its) for f, ls in files_.items() for i, its in enumerate(ls)], "file_id string, line int, items array<struct<x: double, str: string>>")
    led = F.exists("items", lambda i: i["str"].startswith("2026"))
    bands = {r.file_id: [(b.field, b.x0, b.x1) for b in r.bands] for r in sp.column_bands(lines, 600.0, led).collect()}
    assert bands["header"] == [("date", 0.0, 108.0), ("description_raw", 108.0, 376.0), ("debit", 376.0, 450.0), ("balance", 450.0, 600.0)]
    assert bands["places"] == [("date", 0.0, 108.0), ("description_raw", 108.0, 377.5), ("debit", 377.5, 450.0), ("credit", 450.0, 600.0)]
    assert bands["none"] == [("date", 0.0, 108.0), ("description_raw", 108.0, 390.0), ("amount", 390.0, 600.0)]
    got = {r.line: r.cells for r in sp.cells(lines, sp.column_bands(lines, 600.0, led)).filter("file_id = 'header'").collect()}
    assert got[1] == {"date": "2026-01-01", "description_raw": "x", "debit": "5.00", "balance": "10.00"}
