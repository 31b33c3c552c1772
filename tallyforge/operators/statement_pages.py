"""Statements as positioned lines, from headers and columns to transaction rows.

Line positions are folded inside the file's own array, or are windows over its
lines in order; the grouped model folds over pieces of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import blank_as_null, trimmed
from tallyforge.functions.text import BANNER, DATE_GROUP, no_transaction, strip_field_label, with_amount_lines
from tallyforge.operators.ordered import SIZE, in_pieces, running

# How a header's word begins, and the field that it names.
HEADER_WORDS = (("withdrawal", "debit"), ("debit", "debit"), ("deposit", "credit"), ("credit", "credit"), ("balance", "balance"), ("amount", "amount"), ("date", "date"), ("description", "description_raw"), ("particulars", "description_raw"), ("details", "description_raw"))
#: Points from a cluster's mean to its next number; share of the lines that a column must have; shares of the page's width where the text columns begin and end.
NEAR, SUPPORT, DATE_END, TEXT_END = 30.0, 0.15, 0.18, 0.65
#: Points between a description and the first number's column.
MARGIN = 24.0
# Fixed value: a number as it stands in a column.
NUMBER = r"(?i)^[+-]?[$€£¥]?\(?[\d,]+(?:\.\d{1,3})?\)?\s*(?:CR|DR)?\.?$"
BANDS = "array<struct<field: string, x0: double, x1: double>>"


def header_field(word: Column | str) -> Column:
    """The field that a header's word names, or null. Debit and credit must be whole words."""
    low = F.lower(trimmed(F.col(word) if isinstance(word, str) else word))
    out = F.lit(None).cast("string")
    for start, field in reversed(HEADER_WORDS):
        out = F.when(low.rlike(rf"^{start}\b") if start in ("debit", "credit") else F.startswith(low, F.lit(start)), F.lit(field)).otherwise(out)
    return out


def is_number(s: Column | str) -> Column:
    """A number as it stands in a column: sign, symbol, parentheses and CR or DR may be about it."""
    return F.coalesce(trimmed(F.col(s) if isinstance(s, str) else s).rlike(NUMBER), F.lit(False))


def header_lines(lines: DataFrame, date_led: Column, file: str = "file_id", order: str = "line") -> DataFrame:
    """The first line with two header words or more above each file's first date-led line: file, order, items. Files without one don't appear."""
    words = F.size(F.filter("items", lambda i: header_field(i["str"]).isNotNull()))
    first = F.min(F.when(date_led, F.col(order))).over(Window.partitionBy(file))
    found = lines.withColumns({"_n": words, "_first": first}).filter(f"_n >= 2 AND (_first IS NULL OR {order} < _first)")
    return found.groupBy(file).agg(F.min_by(F.struct(order, "items"), order).alias("h")).select(file, f"h.{order}", "h.items")


def clusters(xs: Column, near: float) -> Column:
    """Sorted positions as array<struct<total, n>>: a position joins the last cluster if it lies within `near` of its mean."""
    kind = "array<struct<total: double, n: int>>"

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wide = F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        close = (F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1))["total"] / F.try_element_at(acc, F.lit(-1))["n"] <= near)
        return F.when(close, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wide))).otherwise(F.array_append(acc, F.struct(x.alias("total"), F.lit(1).alias("n")))).cast(kind)

    return F.aggregate(F.array_sort(xs), F.array().cast(kind), put)


def numeric_columns(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Per file, the means of the at most three rightmost clusters of numbers (`xs`, left to right) that enough lines have."""
    own = lines.groupBy(file).agg(F.flatten(F.collect_list(F.transform(F.filter("items", lambda i: is_number(i["str"])), lambda i: i["x"]))).alias("xs"), F.count(F.lit(1)).alias("n"))
    strong = F.filter(clusters(F.col("xs"), NEAR), lambda c: c["n"] >= F.greatest(F.lit(2.0), F.col("n") * SUPPORT))
    means = F.array_sort(F.transform(strong, lambda c: c["total"] / c["n"]))
    return own.select(file, F.slice(means, F.greatest(F.size(means) - 2, F.lit(1)), 3).alias("xs"))


def roles(xs: Column) -> Column:
    """Fields of one, two or three columns of numbers by their places: array<struct<x, field>>."""
    named = lambda *fields: F.array(*[F.struct(xs[i].alias("x"), F.lit(f).alias("field")) for i, f in enumerate(fields)])
    return F.when(F.size(xs) == 1, named("amount")).when(F.size(xs) == 2, named("debit", "credit")).when(F.size(xs) >= 3, named("debit", "credit", "balance")).otherwise(F.array().cast("array<struct<x: double, field: string>>"))


def column_bands(lines: DataFrame, width: float, date_led: Column, file: str = "file_id", order: str = "line") -> DataFrame:
    """Per file `bands`: field and the range of x that it takes, from the header's words, else from the numbers' places, else in fixed shares of the width."""
    headers = header_lines(lines, date_led, file, order)
    named = F.array_sort(F.transform(F.filter("items", lambda i: header_field(i["str"]).isNotNull() & ~header_field(i["str"]).isin("date", "description_raw")), lambda i: F.struct(i["x"].alias("x"), header_field(i["str"]).alias("field"))))
    led = lines.withColumn("_led", F.coalesce(date_led, F.lit(False))).withColumn("_any", F.max("_led").over(Window.partitionBy(file))).filter("_led OR NOT _any")
    placed = numeric_columns(led, file).join(headers.select(file, named.alias("named")), file, "left")
    got = placed.select(file, F.when(F.size("named") > 0, F.col("named")).otherwise(roles(F.col("xs"))).alias("f"))
    band = lambda field, a, b: F.struct(F.lit(field).alias("field") if isinstance(field, str) else field.alias("field"), a.alias("x0"), b.alias("x1"))
    text_from, end = F.lit(width * DATE_END), F.lit(float(width))
    text_to = F.greatest(text_from, F.col("f")[0]["x"] - MARGIN)
    middle = lambda i: (F.get("f", i - 1)["x"] + F.get("f", i)["x"]) / 2
    numbers = F.transform("f", lambda x, i: band(x["field"], F.when(i == 0, text_to).otherwise(middle(i)), F.when(i == F.size("f") - 1, end).otherwise(middle(i + 1))))
    fixed = F.array(band("date", F.lit(0.0), text_from), band("description_raw", text_from, F.lit(width * TEXT_END)), band("amount", F.lit(width * TEXT_END), end))
    return got.select(file, F.when(F.size("f") == 0, fixed).otherwise(F.concat(F.array(band("date", F.lit(0.0), text_from), band("description_raw", text_from, text_to)), numbers)).cast(BANDS).alias("bands"))


def cells(lines: DataFrame, bands: DataFrame, file: str = "file_id") -> DataFrame:
    """Lines with `cells`: a map of field to the text of the items inside its band, of bands that hold any."""
    inside = lambda b: F.array_join(F.transform(F.filter("items", lambda i: (i["x"] >= b["x0"]) & (i["x"] < b["x1"])), lambda i: i["str"]), " ")
    texts = F.filter(F.transform("bands", lambda b: F.struct(b["field"].alias("k"), inside(b).alias("v"))), lambda e: e["v"] != "")
    return lines.join(bands, file).withColumn("cells", F.map_from_entries(texts)).drop("bands")


def generic_table(lines: DataFrame, date_led: Column, near: float = 5.0, file: str = "file_id", order: str = "line") -> DataFrame:
    """Date-led lines as cells where no layout is known: file, order, `row` (array of texts) and `confidence`.

    Columns are the clusters of starts that half of these lines have, parted
    midway; the confidence is the mean support of all clusters. Files with a
    single such line don't appear.
    """
    led = lines.filter(date_led)
    own = led.groupBy(file).agg(F.flatten(F.collect_list(F.transform("items", lambda i: i["x"]))).alias("xs"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    found = own.withColumn("cs", clusters(F.col("xs"), near))
    support = F.aggregate("cs", F.lit(0.0), lambda a, c: a + c["n"] / F.col("n")) / F.size("cs")
    kept = found.select(file, support.alias("confidence"), F.transform(F.filter("cs", lambda c: c["n"] / F.col("n") >= 0.5), lambda c: c["total"] / c["n"]).alias("at"))
    edges = kept.select(file, "confidence", F.transform("at", lambda x, i: F.when(i == 0, F.lit(float("-inf"))).otherwise((F.get("at", i - 1) + x) / 2)).alias("edges"))
    lower = lambda i: F.get("edges", i)
    upper = lambda i: F.coalesce(F.get("edges", i + 1), F.lit(float("inf")))
    row = F.transform("edges", lambda e, i: F.array_join(F.transform(F.filter("items", lambda t: (t["x"] >= lower(i)) & (t["x"] < upper(i))), lambda t: t["str"]), " "))
    return led.join(edges, file).select(file, order, row.alias("row"), "confidence")


# --- the grouped model -----------------------------------------------------


def group_day(text: Column | str) -> Column:
    """The date of a line that is a date alone, a weekday before it or not; else null."""
    t = trimmed(F.col(text) if isinstance(text, str) else text)
    return F.when(t.rlike(DATE_GROUP), F.regexp_extract(t, DATE_GROUP, 1))


def classify_lines(lines: DataFrame, file: str = "file_id", order: str = "line", text: str = "text") -> DataFrame:
    """Lines with `kind`: date, amount (from the first date on), banner, noise or text; and `opened`, whether a date came before."""
    until = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = with_amount_lines(lines.withColumn("_day", group_day(text)), text).withColumn("opened", F.coalesce(F.max(F.col("_day").isNotNull()).over(until), F.lit(False)))
    kind = F.when(F.col("_day").isNotNull(), "date").when(trimmed(F.col(text)).rlike(BANNER), "banner").when(F.col("opened") & F.col("_amount").isNotNull(), "amount").when(no_transaction(text), "noise").otherwise("text")
    return marked.withColumn("kind", kind)


def grouped_statement(lines: DataFrame, file: str = "file_id", order: str = "line", text: str = "text", size: int = SIZE) -> DataFrame:
    """Rows of the grouped model: file, `row`, day, description_raw, minor, currency, mark, type, first_line, last_line.

    A block runs from one amount or date to the next amount, which closes it:
    its lines and what stands before the amount are the description. Where the
    amount line has such text, the first line behind it is the row's type and
    others up to the next amount are dropped; where it has none, they are the
    next description. Banners, page and balance lines are never part of a row.

    Lines are read once, then numbered and cut into pieces (`ordered`). What a
    line is depends on the lines before it only through the last date, how many
    dates and amounts there were and what the last one was; these fold from
    piece to piece, so a file of any length is many tasks' work.
    """
    t = F.coalesce(trimmed(F.col(text)), F.lit(""))
    plain = lines.select(file, order, t.alias("_text")).filter("_text != ''")
    plain = plain.withColumn("_day", group_day("_text")).filter(~F.col("_text").rlike(BANNER) | F.col("_day").isNotNull())
    read = with_amount_lines(plain, "_text")
    pieces = running(in_pieces(read, [file], [order], size), [file], day=("last", F.col("_day"), True))
    is_day = F.col("_day").isNotNull()
    is_amount = ~is_day & F.col("day").isNotNull() & F.col("_amount").isNotNull()
    inline = F.when(is_amount, strip_field_label(trimmed(F.expr("substring(_text, 1, _amount.start)"))))
    kinds = pieces.withColumns({"_is_amount": is_amount, "_inline": inline, "_closes": is_day | is_amount})
    seen = running(
        kinds, [file], _block=("sum", F.col("_closes").cast("int"), False), row=("sum", F.col("_is_amount").cast("int"), True),
        # What the line that opened the block was: an amount with text before it claims the lines behind it.
        _claims=("last", F.when(F.col("_closes"), F.coalesce(F.col("_inline") != "", F.lit(False))), False),
    )
    body = seen.filter("day IS NOT NULL AND _day IS NULL").withColumn("_noise", ~F.col("_is_amount") & no_transaction("_text"))
    claimed = ~F.col("_is_amount") & F.coalesce("_claims", F.lit(False))
    part = F.struct(order, F.when(F.col("_is_amount"), F.col("_inline")).otherwise(F.col("_text")).alias("t"))
    # Lines that an amount claims belong to its block, which ended with it.
    blocks = body.groupBy(file, (F.col("_block") - claimed.cast("int")).alias("_block")).agg(
        F.max(F.when(F.col("_is_amount"), F.struct("day", "row", "_amount", F.col(order).alias("o")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("_is_amount") | ~(claimed | F.col("_noise")), part))).alias("parts"),
        F.min_by(F.when(claimed, F.col("_text")), F.when(claimed, F.col(order))).alias("type"),
    ).filter("a IS NOT NULL")
    texts = F.filter(F.transform("parts", lambda p: p["t"]), lambda t: t != "")
    return blocks.select(
        file, F.col("a.row").cast("int").alias("row"), "a.day", F.array_join(texts, " ").alias("description_raw"), "a._amount.minor", "a._amount.currency", "a._amount.mark",
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce(F.col("parts")[0][order], F.col("a.o")).alias("first_line"), F.col("a.o").alias("last_line"),
    )


def sign_convention(amounts: DataFrame, file: str = "file_id") -> DataFrame:
    """How each file's amount lines (signed: boolean, mark, x) express their sign: file, convention, confidence, split.

    Most lines signed: signed. Most marked CR or DR: crdr. Some marked, none
    signed, credits at least as many as debits: positiveIsOut. Else, where
    the lines' x fall into two columns of 15 % each or more with a gap of 20
    points: columnBands, and the split. Else null.
    """
    w = Window.partitionBy(file).orderBy("x")
    placed = amounts.withColumns({"_gap": F.col("x") - F.lag("x").over(w), "_left": F.row_number().over(w) - 1})
    n = placed.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("nx"), F.count_if("signed").alias("s"), F.count("mark").alias("m"), F.count_if(F.col("mark") == "C").alias("c"), F.count_if(F.col("mark") == "D").alias("d"), F.max(F.struct("_gap", (-F.col("_left")).alias("o"), F.col("x").alias("right"))).alias("g"))
    left = -F.col("g.o")
    two = (F.col("nx") >= 4) & (F.col("g._gap") >= 20) & (left >= 0.15 * F.col("nx")) & (F.col("nx") - left >= 0.15 * F.col("nx"))
    share = lambda c: F.col(c) / F.col("n")
    convention = F.when(share("s") > 0.5, "signed").when(share("m") > 0.5, "crdr").when((F.col("m") > 0) & (F.col("s") == 0) & (F.col("c") >= F.col("d")), "positiveIsOut").when(two, "columnBands")
    out = n.withColumn("convention", convention)
    confidence = F.when(F.col("convention") == "signed", share("s")).when(F.col("convention").isin("crdr", "positiveIsOut"), share("m")).when(F.col("convention") == "columnBands", 1.0).otherwise(0.0)
    return out.select(file, "convention", confidence.alias("confidence"), F.when(F.col("convention") == "columnBands", F.col("g.right") - F.col("g._gap") / 2).alias("split"))


def unmatched_lines(lines: DataFrame, rows: DataFrame, file: str = "file_id", order: str = "line", text: str = "text") -> DataFrame:
    """Rows (file, row) against amount lines, both by their rank in the file: file, rank, row (null: a missed line) and line (null: an unmatched row)."""
    marked = classify_lines(lines, file, order, text).filter("kind = 'amount'")
    a = marked.select(file, F.col(order).alias("at"), F.row_number().over(Window.partitionBy(file).orderBy(order)).alias("rank"))
    r = rows.select(file, "row", F.row_number().over(Window.partitionBy(file).orderBy("row")).alias("rank"))
    return r.join(a, [file, "rank"], "full_outer").filter("row IS NULL OR at IS NULL").select(file, "rank", "row", F.col("at").alias("line"))


def count_check_grouped(lines: DataFrame, rows: DataFrame, file: str = "file_id", order: str = "line", text: str = "text") -> DataFrame:
    """Per file: rows extracted, amount lines from the first date on, their difference and the explanation."""
    n = classify_lines(lines, file, order, text).groupBy(file).agg(F.count_if(F.col("kind") == "amount").alias("amount_lines"))
    m = rows.groupBy(file).agg(F.count(F.lit(1)).alias("extracted"))
    out = n.join(m, file, "left").withColumn("extracted", F.coalesce("extracted", F.lit(0).cast("long"))).withColumn("diff", F.col("extracted") - F.col("amount_lines"))
    why = F.when(F.col("diff") == 0, "count check").otherwise(F.concat(F.lit("count check ("), F.abs("diff").cast("string"), F.when(F.col("diff") < 0, " amount line(s) not extracted)").otherwise(" extra row(s) extracted)")))
    return out.select(file, "extracted", "amount_lines", "diff", why.alias("explanation"))


def line_height(items: Column | str) -> Column:
    """The largest height above zero of a line's items; 10 without any."""
    return F.coalesce(F.array_max(F.filter(F.transform(items, lambda i: i["height"]), lambda h: h > 0)), F.lit(10.0))


def statement_period(full_text: Column | str, pattern: str) -> Column:
    """struct(start, end): the two groups of a saved pattern in a text; null where it doesn't match. A pattern's groups are checked once, when the plan is made."""
    from tallyforge.functions.patterns import checked

    c, p = F.col(full_text) if isinstance(full_text, str) else full_text, checked(pattern, groups=2)
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("start"), F.regexp_extract(c, p, 2).alias("end")))
