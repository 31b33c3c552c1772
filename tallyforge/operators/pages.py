"""Positioned text: items to lines, lines to rows by columns or by date groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import SIZE, in_pieces, running

LINE = "array<struct<y: double, items: array<struct<x: double, str: string>>>>"


def lines_of_items(pages: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """Lines of each page: the keys, `line` (from 0, top down), `y` and `items` (left to right).

    An item joins the open line if its y lies within the tolerance of that
    line's first item: a fold over the page's own array, sorted top down.
    """
    top_down = F.transform(F.array_sort(F.transform("items", lambda i: F.struct((-i["y"]).alias("d"), i["x"].alias("x"), i["str"].alias("str")))), lambda i: F.struct((-i["d"]).alias("y"), i["x"].alias("x"), i["str"].alias("str")))
    one = lambda i: F.struct(i["x"].alias("x"), i["str"].alias("str"))

    def put(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["y"].alias("y"), F.array_append(last["items"], one(i)).alias("items"))
        near = (F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1))["y"] - i["y"]) <= tolerance)
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, F.struct(i["y"].alias("y"), F.array(one(i)).alias("items")))).cast(LINE)

    folded = pages.select(*keys, F.posexplode(F.aggregate(top_down, F.array().cast(LINE), put)).alias("line", "l"))
    return folded.select(*keys, "line", "l.y", F.array_sort("l.items").alias("items"))


def line_text(items: Column | str) -> Column:
    i = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.transform(i, lambda x: x["str"]), " ")


def assign_columns(lines: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """Lines with one text column a band: the items whose x lies in [x0, x1), each in the first band that takes it."""
    def of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, x0, x1 in reversed(bands):
            out = F.when((x >= x0) & (x < x1), F.lit(name)).otherwise(out)
        return out

    text = lambda n: F.array_join(F.transform(F.filter("items", lambda i: F.coalesce(of(i["x"]) == n, F.lit(False))), lambda i: i["str"]), " ")
    return lines.select("*", *[text(n).alias(n) for n, _, _ in bands])


def wrapped_rows(lines: DataFrame, keys: list[str], order: list[str], is_start: Column, text: str = "text", size: int = SIZE) -> DataFrame:
    """Rows of the columns model: a start line opens a row, the lines behind it continue it. Lines before the first start are dropped.

    Starts are counted inside pieces of ordered lines and carried from piece to
    piece, so a file may be of any length.
    """
    marked = lines.select(*keys, *order, F.col(text).alias("_t"), F.coalesce(is_start, F.lit(False)).cast("int").alias("_start"))
    numbered = running(in_pieces(marked, keys, order, size), keys, row=("sum", F.col("_start"), True)).filter("row > 0")
    out = numbered.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("_t").alias("t")))).alias("parts"))
    return out.select(*keys, "row", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias(text), F.size("parts").alias("n_lines"))


def carried_dates(lines: DataFrame, keys: list[str], order: list[str], date: Column) -> DataFrame:
    """Lines of the grouped model with the date of the group they stand in; those before the first date have none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("group_date", F.last(date, ignorenulls=True).over(w))


def grouped_rows(lines: DataFrame, keys: list[str], order: list[str], date: Column, amount: Column, text: str = "text") -> DataFrame:
    """Rows of the grouped model: date, description (the lines since the last amount or date, then the amount line's own text) and amount.

    Date lines open a group and clear what was pending; an amount line closes a
    row; both need the lines' order alone.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"_date": date, "_amount": amount})
    marked = marked.withColumns({"date": F.last("_date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_block": F.coalesce(F.sum((F.col("_amount").isNotNull() | F.col("_date").isNotNull()).cast("int")).over(before), F.lit(0))})
    body = marked.filter("date IS NOT NULL AND _date IS NULL")
    blocks = body.groupBy(*keys, "_block").agg(F.min("date").alias("date"), F.max("_amount").alias("amount"), F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("parts"))
    rows = blocks.filter("amount IS NOT NULL").select(*keys, "_block", "date", "amount", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("description"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("_block"))).drop("_block")


def largest_gap(points: DataFrame, keys: list[str], x: str = "x", least: float = 20.0) -> DataFrame:
    """Where sorted positions split in two: the middle of the widest gap, for keys with four points or more and a gap of 20."""
    w = Window.partitionBy(*keys).orderBy(x)
    gaps = points.withColumn("_before", F.lag(x).over(w))
    out = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((F.col(x) - F.col("_before")).alias("gap"), (-F.col("_before")).alias("o"))).alias("g"))
    return out.filter((F.col("n") >= 4) & (F.col("g.gap") >= least)).select(*keys, "n", F.col("g.gap").alias("gap"), (-F.col("g.o") + F.col("g.gap") / 2).alias("split"))


def row_model(lines: DataFrame, keys: list[str], date_led: Column, date_group: Column, amount_line: Column) -> DataFrame:
    """Per key: grouped where groups and amount lines together outnumber the lines that begin with a date, else columns."""
    n = lines.groupBy(*keys).agg(F.count_if(date_led).alias("columns_score"), F.count_if(date_group).alias("groups"), F.count_if(amount_line).alias("amounts"))
    score = F.when((F.col("groups") > 0) & (F.col("amounts") > 0), F.col("groups") + F.col("amounts")).otherwise(0)
    return n.select(*keys, "columns_score", score.cast("long").alias("grouped_score"), F.when(score > F.col("columns_score"), "grouped").otherwise("columns").alias("model"))


def zip_rows(rows: DataFrame, lines: DataFrame, keys: list[str], row_order: str, line_order: str) -> DataFrame:
    """Rows and amount lines side by side by their rank within the key; either side may have some left over."""
    r = rows.select(*keys, F.col(row_order).alias("row"), F.row_number().over(Window.partitionBy(*keys).orderBy(row_order)).alias("rank"))
    t = lines.select(*keys, F.col(line_order).alias("line"), F.row_number().over(Window.partitionBy(*keys).orderBy(line_order)).alias("rank"))
    return r.join(t, [*keys, "rank"], "full_outer")


def second_pass(items: DataFrame, retries: DataFrame, key: list[str]) -> DataFrame:
    """Recognised words, each replaced by its second reading where that is surer and not blank."""
    again = retries.groupBy(*key).agg(F.max(F.struct("confidence", "str")).alias("again"))
    better = F.coalesce((F.col("again.confidence") > F.col("confidence")) & (F.trim("again.str") != ""), F.lit(False))
    joined = items.join(again, key, "left")
    return joined.withColumns({"str": F.when(better, F.col("again.str")).otherwise(F.col("str")), "confidence": F.when(better, F.col("again.confidence")).otherwise(F.col("confidence"))}).drop("again")


def anchor_lines(lines: DataFrame, keys: list[str], order: str, date_led: Column) -> DataFrame:
    """Per key, the order of the line before the first and after the last that begin with a date."""
    w = Window.partitionBy(*keys).orderBy(order)
    around = lines.withColumns({"_before": F.lag(order).over(w), "_after": F.lead(order).over(w)}).filter(date_led)
    return around.groupBy(*keys).agg(F.min_by("_before", order).alias("before"), F.max_by("_after", order).alias("after"), F.count(F.lit(1)).alias("n"))


def confidence(items: Column | str, x0: float | None = None, x1: float | None = None) -> Column:
    """struct(least, mean) of the items' confidences, of those with x in [x0, x1) if given. The least ignores missing ones; the mean counts them as 0."""
    i = F.col(items) if isinstance(items, str) else items
    if x0 is not None:
        i = F.filter(i, lambda t: (t["x"] >= x0) & (t["x"] < x1))
    total = F.aggregate(i, F.lit(0.0), lambda a, t: a + F.coalesce(t["confidence"], F.lit(0.0)))
    return F.struct(F.array_min(F.transform(i, lambda t: t["confidence"])).alias("least"), F.when(F.size(i) > 0, total / F.size(i)).alias("mean"))


def items_in_range(items: Column | str, start: Column, length: Column) -> Column:
    """The items of a line that a range of its space-joined text touches; offsets count from 0."""
    i = F.col(items) if isinstance(items, str) else items
    kind = "struct<at: int, out: array<struct<b: int, e: int, str: string>>>"
    step = lambda a, t: F.struct((a["at"] + F.length(t["str"]) + 1).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("b"), (a["at"] + F.length(t["str"])).alias("e"), t["str"].alias("str"))).alias("out")).cast(kind)
    placed = F.aggregate(i, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b: int, e: int, str: string>>").alias("out")).cast(kind), step)["out"]
    return F.transform(F.filter(placed, lambda t: (t["e"] > start) & (t["b"] < start + length)), lambda t: t["str"])


def page_anchor(page: Column, y: Column, height: Column, y2: Column) -> Column:
    """struct(page, top, bottom): where a row stands on its page, half a line's height about its first and last line; null without a page or a place."""
    last, half = F.coalesce(y2, y), F.coalesce(height, F.lit(0.0)) / 2
    return F.when(page.isNotNull() & y.isNotNull(), F.struct(page.alias("page"), (F.least(y, last) - half).alias("top"), (F.greatest(y, last) + half).alias("bottom")))


def lines_of_rows(rows: DataFrame, lines: DataFrame, keys: list[str], row: str = "row", bucket: float = 50.0) -> DataFrame:
    """Every row with the lines of its band of the page: the keys, row, page and the lines' other columns.

    `rows` has the keys, `row` and `anchor` (of `page_anchor`); `lines` has the
    keys, `page` and `y`. Pages are cut into bands of `bucket` points: a line is
    in one, a row in those that it reaches into, so the join is on equal keys,
    page and band, and no pair comes twice. Rows without an anchor have no
    lines.
    """
    band = lambda y: F.floor(y / bucket).cast("int")
    reach = rows.filter("anchor IS NOT NULL").select(*keys, row, "anchor", F.col("anchor.page").alias("page"), F.explode(F.sequence(band(F.col("anchor.top")), band(F.col("anchor.bottom")))).alias("_band"))
    placed = lines.withColumn("_band", band(F.col("y")))
    return reach.join(placed, [*keys, "page", "_band"]).filter(F.col("y").between(F.col("anchor.top"), F.col("anchor.bottom"))).drop("anchor", "_band")
