"""Amount lines in stages, and what is computed once a row."""

from pyspark.sql import functions as F

from tallyforge.functions import amounts, text
from tallyforge.operators import infer, recognised

LINES = [
    "coffee 1,234.50", "shop SGD 12.00", "tram -3.40 EUR", "fees (5.00)", "rent 7.00 DR", "Page 3 of 4.00", "12", "1", "123456789", "x 12 MAR", "MAR 12.00", "a 1.2.3", "a 1 234,56 CR.", "US$5", "5 $",
    "2025 and 2026 5.00", "Available balance SGD 9.00", " a 1 000.00 ", "total 4.00", "ref: 1.00", "March 2026", "\u0001 5.00", "", None, "abc", "a (5.00", "$-(4.50)", "JPY 500", "é 4.5é", "12.345 D", "PAGE 1/2 3.00", "a\n4.00",
]


def test_amount_lines_in_stages_are_those_of_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "i int, v string")
    got = text.with_amount_lines(df.select("*", text.amount_line("v").alias("one")), "v", "staged").collect()
    assert len(got) == len(LINES) and [r.staged for r in got] == [r.one for r in got]
    assert sum(r.staged is not None for r in got) > 12


def _times(df, piece: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(piece)


def test_conditions_do_not_read_lines_twice(spark):
    word = "struct<str: string, x: double, y: double, width: double, height: double, confidence: double>"
    df = spark.createDataFrame([(1, 1, [("shop", 10.0, 1.0, 30.0, 8.0, 80.0), ("SGD4.00", 50.0, 1.0, 90.0, 8.0, 80.0)]), (1, 2, [("none", 1.0, 1.0, 1.0, 1.0, 1.0)])], f"page int, line int, items array<{word}>")
    got = recognised.retry_candidates(df, "page")
    assert [tuple(r)[1:7] for r in got.collect()] == [(1, 1, 1, "SGD4.00", 3, True)]
    assert _times(got, "HK|A)?") == 1


def test_amount_like_is_what_can_be_read(spark):
    texts = [t for t in LINES if t] + ["1,234.50", "1234.5", "1,23", "1,2345", "12.", ".5", "1e5", "5dCR", "USD 5", "USD5DR", "CR 5", "part 12 3", "01/02/1996", "12:30", "(5.00)", "-5", "5-", " 7 ", "1 000", "NaN", "1.2.3", "1,234,567.891", "A$5", "€ 5", "5d", "x"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, " "]], "v string").select("v", text.is_amount_like("v").alias("a"), (F.coalesce(F.trim("v") != "", F.lit(False)) & amounts.parse_amount("v").isNotNull()).alias("b"))
    assert [(r.v, r.a) for r in df.collect()] == [(r.v, r.b) for r in df.collect()]


def test_suggestions_score_each_value_once(spark):
    columns = spark.createDataFrame([(1, 0, "Date", ["01/02/2026", "", None]), (1, 1, "Money", ["1.00", "2,000.00", " "]), (1, 2, "Empty", ["", None, ""])], "file_id int, column int, header string, values array<string>")
    got = infer.suggest_mapping(columns, spark.createDataFrame([("date", "date"), ("amount", "amount")], "field string, term string"))
    assert {tuple(r) for r in got.collect()} == {(1, "date", 0, 1.0), (1, "amount", 1, 0.36)}
    assert _times(got, "[A-Za-z]{4}|[/:]") == 1


def test_a_name_is_looked_for_in_one_flat_text(spark):
    df = spark.createDataFrame([("We are Big Bank", "x_green-land.csv"), ("We are Big Bank", "x.csv"), ("Red Land", "green land"), (None, "red_land"), ("none", "x"), (None, None)], "t string, f string")
    got = df.select(text.first_name("t", "f", ["Green Land", "Red Land"]).alias("n"))
    assert [r.n for r in got.collect()] == ["Green Land", "Big Bank", "Green Land", "Red Land", None, None]
    assert _times(got, "[^a-z0-9]+") == 2
