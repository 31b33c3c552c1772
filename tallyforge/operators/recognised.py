"""Recognised words of scanned pages: places, lines, and a second reading of amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import computed, trimmed
from tallyforge.functions.text import with_amount_lines

# Fixed value: words that are an amount with cents, a numeric date, a currency code, or one or two digits.
SHAPES = r"^([+-]?[\d,]+\.\d{2}|\d{1,2}[/.-]\d{1,2}([/.-]\d{2,4})?|[A-Z]{3}|\d{1,2})$"
WORD = "struct<str: string, x: double, y: double, width: double, height: double, confidence: double>"


def looks_like_amount_or_date(s: Column | str) -> Column:
    """Whether a word is an amount with cents, a numeric date, a currency code or one or two digits."""
    return F.coalesce(trimmed(F.col(s) if isinstance(s, str) else s).rlike(SHAPES), F.lit(False))


def to_points(box: Column, scale: Column, page_height: Column) -> Column:
    """A pixel box (x0, y0, x1, y1 from the top left) in points from the bottom left: struct(x, y, width, height)."""
    return F.struct((box["x0"] / scale).alias("x"), (page_height - box["y1"] / scale).alias("y"), ((box["x1"] - box["x0"]) / scale).alias("width"), ((box["y1"] - box["y0"]) / scale).alias("height"))


def words_of_lines(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages (keys, scale, page_height, lines of box and words) as one row a word that isn't blank: keys, `item` (from 0 in the page) and `word`. Words take their line's y."""
    words = F.flatten(F.transform("lines", lambda line: F.transform(line["words"], lambda w: F.struct(
        w["text"].alias("str"), to_points(w["box"], F.col("scale"), F.col("page_height"))["x"].alias("x"), to_points(line["box"], F.col("scale"), F.col("page_height"))["y"].alias("y"),
        to_points(w["box"], F.col("scale"), F.col("page_height"))["width"].alias("width"), to_points(w["box"], F.col("scale"), F.col("page_height"))["height"].alias("height"), w["confidence"].cast("double").alias("confidence"),
    ).cast(WORD))))
    return pages.select(*keys, F.posexplode(F.filter(words, lambda w: F.trim(w["str"]) != "")).alias("item", "word"))


def lines_by_centre(items: DataFrame, *keys: str) -> DataFrame:
    """Lines of words (keys, items): keys, `line` (from 0, top down), y (the lowest) and items, left to right.

    Words are taken from the top down; one joins the first line whose mean
    centre lies within half the page's median word height of its own.
    """
    heights = F.array_sort(F.filter(F.transform("items", lambda i: i["height"]), lambda h: h > 0))
    tolerance = F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(10.0)) / 2
    centre = lambda i: i["y"] + i["height"] / 2
    kind = "array<struct<c: double, n: int, items: array<struct<x: double, y: double, str: string>>>>"
    order = F.transform(F.array_sort(F.transform("items", lambda i: F.struct((-centre(i)).alias("d"), i["x"].alias("x"), i["y"].alias("y"), i["str"].alias("str")))), lambda i: F.struct((-i["d"]).alias("c"), i["x"].alias("x"), i["y"].alias("y"), i["str"].alias("str")))

    def put(acc: Column, i: Column) -> Column:
        near = F.array_position(F.transform(acc, lambda line: (F.abs(line["c"] - i["c"]) <= F.col("_tolerance")).cast("int")), 1)
        word = F.struct(i["x"].alias("x"), i["y"].alias("y"), i["str"].alias("str"))
        grown = F.transform(acc, lambda line, k: F.when(k + 1 == near, F.struct(((line["c"] * line["n"] + i["c"]) / (line["n"] + 1)).alias("c"), (line["n"] + 1).alias("n"), F.array_append(line["items"], word).alias("items"))).otherwise(line))
        return F.when(near > 0, grown).otherwise(F.array_append(acc, F.struct(i["c"].alias("c"), F.lit(1).alias("n"), F.array(word).alias("items")))).cast(kind)

    folded = items.withColumn("_tolerance", tolerance).select(*keys, F.aggregate(order, F.array().cast(kind), put).alias("ls"))
    down = F.array_sort(F.transform("ls", lambda x: F.struct((-x["c"]).alias("d"), F.array_sort(x["items"]).alias("items"))))
    return folded.select(*keys, F.posexplode(down).alias("line", "l")).select(*keys, "line", F.array_min(F.transform("l.items", lambda i: i["y"])).alias("y"), "l.items")


def retry_candidates(lines: DataFrame, *keys: str) -> DataFrame:
    """Amounts to read again: keys, line, first and last word, matched text, prefix_end (characters of the currency and the spaces behind it), has_decimal and the box to crop.

    `lines` has items in order, with str, x, y, width and height. The box starts
    behind the currency, a share into the word where it is glued to the number.
    """
    text = F.array_join(F.transform("items", lambda i: i["str"]), " ")
    marked = with_amount_lines(lines.withColumn("_text", text), "_text", "_a").filter("_a IS NOT NULL")
    # The words that end behind the amount's start, with their places in the text: each begins where the words and spaces before it end.
    ends = F.aggregate("items", F.array(F.lit(0)), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + F.length(i["str"]) + 1))
    placed = F.transform("items", lambda w, i: F.struct(F.get("_ends", i).alias("b"), (F.get("_ends", i + 1) - 1).alias("e"), i.alias("i"), w["x"].alias("x"), w["y"].alias("y"), w["width"].alias("width"), w["height"].alias("height")))
    start = F.col("_a.start")
    tail = F.expr("substring(_text, _a.start + 1)")
    marked = marked.select(*keys, "line", "items", "_a", tail.alias("_tail"), ends.alias("_ends"))
    prefix = F.length(F.regexp_extract("_tail", r"^(?:[A-Za-z]{3}(?![A-Za-z])|[A-Z]{0,2}[$€£¥])? *", 0))
    own = marked.select(*keys, "line", "_a", "_tail", prefix.alias("_prefix"), F.filter(placed, lambda w: w["e"] > start).alias("_own"))
    ahead = start + F.col("_prefix")
    own = computed(own.withColumn("_hit", F.get(F.filter("_own", lambda w: w["e"] > ahead), F.lit(0))), *keys, "line", "_a", "_tail", "_prefix", "_hit", _own=F.col("_own")).filter("size(_own) > 0")
    hit = F.col("_hit")
    share = F.greatest(F.lit(0), ahead - hit["b"]) / F.greatest(F.lit(1), hit["e"] - hit["b"])
    of = lambda f, fold: fold(F.transform("_own", f))
    box = F.struct((hit["x"] + share * hit["width"]).alias("x0"), of(lambda w: w["x"] + w["width"], F.array_max).alias("x1"), of(lambda w: w["y"], F.array_min).alias("y0"), of(lambda w: w["y"] + w["height"], F.array_max).alias("y1"))
    return own.select(*keys, "line", F.col("_own")[0]["i"].alias("first"), F.element_at("_own", -1)["i"].alias("last"), F.col("_tail").alias("matched"), F.col("_prefix").alias("prefix_end"), F.col("_a.decimals").alias("has_decimal"), box.alias("box"))


def apply_retries(words: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """Words (keys, line, item and word) after second readings.

    `candidates` has keys, line, first, last, matched, prefix_end, has_decimal,
    retry_str and retry_confidence. A reading with cents replaces the words of
    its amount by one; where more than half of a page's amounts then have
    cents, the first word of each of the others gets the confidence 0.
    """
    better = ~F.col("has_decimal") & F.coalesce(F.col("retry_str").rlike(r"\d[.,]\d{2}$"), F.lit(False))
    told = candidates.withColumn("_better", better).withColumn("_share", F.avg((F.col("has_decimal") | F.col("_better")).cast("int")).over(Window.partitionBy(*keys)))
    told = told.withColumn("_doubt", ~F.col("has_decimal") & ~F.col("_better") & (F.col("_share") > 0.5))
    joined = words.join(told, [*keys, "line"], "left")
    inside = F.coalesce(F.col("item").between(F.col("first"), F.col("last")), F.lit(False))
    w = Window.partitionBy(*keys, "line")
    right = F.max(F.when(inside, F.col("word.x") + F.col("word.width"))).over(w)
    tall = F.max(F.when(inside, F.col("word.height"))).over(w)
    joined = joined.withColumns({"_inside": inside, "_right": right, "_tall": tall}).filter("NOT coalesce(_better AND _inside AND item != first, false)")
    new = F.struct(F.trim(F.concat(F.expr("substring(matched, 1, prefix_end)"), "retry_str")).alias("str"), F.col("word.x").alias("x"), F.col("word.y").alias("y"), (F.col("_right") - F.col("word.x")).alias("width"), F.col("_tall").alias("height"), F.col("retry_confidence").cast("double").alias("confidence")).cast(WORD)
    doubted = F.struct(*[F.col(f"word.{f}").alias(f) for f in ("str", "x", "y", "width", "height")], F.lit(0.0).alias("confidence")).cast(WORD)
    at_first = F.col("_inside") & (F.col("item") == F.col("first"))
    word = F.when(F.coalesce(F.col("_better") & at_first, F.lit(False)), new).when(F.coalesce(F.col("_doubt") & at_first, F.lit(False)), doubted).otherwise(F.col("word"))
    return joined.select(*keys, "line", "item", word.alias("word"))
