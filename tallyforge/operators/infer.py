"""Inference from samples: what the columns of an unknown table hold, and which saved candidate to use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expr import computed
from tallyforge.functions.text import currency_code_of, is_amount_like, is_currency_code_like, is_date_like
from tallyforge.operators.bounds import bounded, dealt

AMOUNTS = ("amount", "debit", "credit", "balance")
# What shape alone is worth where the header says nothing.
SHAPE_ONLY = {"amount": 0.36, "debit": 0.35, "credit": 0.35, "balance": 0.35, "date": 0.34}
LEAST_SHAPE = 0.8
MARGIN, MOST, TIE = 0.1, 4, 0.02


def filled(values: Column | str) -> Column:
    v = F.col(values) if isinstance(values, str) else values
    return F.filter(v, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def share(values: Column, test: Callable) -> Column:
    """Share of the filled values that pass; null without any."""
    v = filled(values)
    return F.when(F.size(v) > 0, F.size(F.filter(v, test)) / F.size(v))


def column_fill(values: Column | str) -> Column:
    """struct(fill, coded, code): the filled share, the share of those led by a currency code, and the commonest code (the first of equals)."""
    v = F.col(values) if isinstance(values, str) else values
    codes = F.filter(F.transform(filled(v), currency_code_of), lambda x: x.isNotNull())
    ranked = F.transform(F.array_distinct(codes), lambda c: F.struct(F.size(F.filter(codes, lambda x: x == c)).alias("n"), (-F.array_position(codes, c)).alias("o"), c.alias("c")))
    fill = F.when(F.size(v) > 0, F.size(filled(v)) / F.size(v)).otherwise(0.0)
    coded = F.when(F.size(filled(v)) > 0, F.size(codes) / F.size(filled(v))).otherwise(0.0)
    return F.struct(fill.alias("fill"), coded.alias("coded"), F.array_max(ranked)["c"].alias("code"))


def is_category_column(values: Column | str) -> Column:
    v = filled(values)
    return (F.size(v) >= 4) & (F.size(F.array_distinct(v)) <= 3)


def is_sparse_coded(values: Column | str) -> Column:
    c = column_fill(values)
    return (c["fill"] > 0) & (c["fill"] < 0.5) & (c["coded"] >= 0.5)


def suggest_mapping(columns: DataFrame, terms: DataFrame) -> DataFrame:
    """Which column each field of a file is: file_id, field, column, confidence.

    `columns` has file_id, column (from 0), header and values (a sample as an
    array); `terms` is a fixed dictionary of field and term. A header counts 1
    where it is a term and 0.7 where it holds one; with it, confidence is 0.6 of
    that and 0.4 of the shape's share; without it, shape alone must reach 0.8
    and counts about a third. A column serves one field: candidates are taken
    from the surest down (on a tie earlier columns, then fields by name, amount
    last), in a fold over the file's own few candidates.
    """
    h = F.lower(F.trim("header"))
    known = columns.select("file_id", "column", "values", h.alias("h"), filled("values").alias("_filled"))
    fields = terms.groupBy("field").agg(F.collect_set("term").alias("terms"))
    each = known.crossJoin(bounded(fields, 1000, "fields"))
    header = F.when(F.array_contains("terms", F.col("h")), 1.0).when(F.exists("terms", lambda t: F.contains(F.col("h"), t)), 0.7).otherwise(0.0)
    v, some, n = F.col("values"), F.col("_filled"), F.size("_filled")
    passing = lambda test: F.size(F.filter(some, test)) / n
    shape = F.when(n > 0, (
        F.when(F.col("field") == "date", passing(is_date_like)).when(F.col("field").isin(*AMOUNTS), passing(is_amount_like)).when(F.col("field") == "currency", passing(is_currency_code_like))
        .when(F.col("field") == "description", F.when((n >= 4) & (F.size(F.array_distinct(some)) <= 3), 0.2).otherwise(0.8)).otherwise(0.8)
    ))
    alone = F.lit(None).cast("double")
    for f, w in SHAPE_ONLY.items():
        alone = F.when(F.col("field") == f, F.lit(w)).otherwise(alone)
    sparse = F.col("field").isin("debit", "credit") & is_sparse_coded(v)
    scored = computed(each, "file_id", "column", "field", header=header, shape=F.coalesce(shape, F.lit(0.5)), alone=alone, sparse=sparse)
    confidence = F.when(F.col("header") > 0, F.least(F.lit(1.0), 0.6 * F.col("header") + 0.4 * F.col("shape"))).when((F.col("shape") >= LEAST_SHAPE) & ~F.col("sparse"), F.col("shape") * F.col("alone"))
    some = scored.withColumn("confidence", F.round(confidence, 6)).filter("confidence IS NOT NULL")
    ranked = some.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "column", (F.col("field") == "amount").alias("general"), "field"))).alias("c"))
    kind = "array<struct<o: double, column: int, general: boolean, field: string>>"
    free = lambda acc, x: ~F.exists(acc, lambda t: (t["column"] == x["column"]) | (t["field"] == x["field"]))
    picked = F.aggregate(F.col("c").cast(kind), F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return ranked.select("file_id", F.explode(picked).alias("p")).select("file_id", "p.field", "p.column", (-F.col("p.o")).alias("confidence"))


def pick_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate to use for each file: file_id, profile_id.

    `candidates` has file_id, profile_id, confidence, quality and created, and
    may have `rank` (else the surest come first, then the lesser ids) and
    `built_in` (else all are people's own). Of the four first within 0.1 of the
    surest, one after the other: a better quality wins, however small the
    difference; at a quality within 0.02 of the best so far, a saved one of
    people's own wins over a built-in one and over an older one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file_id")
    first = w.orderBy("rank") if "rank" in candidates.columns else w.orderBy(F.desc("confidence"), "profile_id")
    own = ~F.coalesce("built_in", F.lit(False)) if "built_in" in candidates.columns else F.lit(True)
    near = candidates.withColumns({"_top": F.max("confidence").over(w), "_rank": F.row_number().over(first), "_own": own}).filter(f"_top - confidence <= {MARGIN} + 1e-9 AND _rank <= {MOST}")
    folded = near.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "profile_id", "quality", "created", (~F.col("_own")).alias("built_in")))).alias("c"))
    return folded.select("file_id", best_of(F.col("c")).alias("p")).select("file_id", "p.profile_id")


def best_of(tried: Column) -> Column:
    """The one to use of near-tied candidates in their order (an array of structs with quality, created, built_in), as `pick_candidate` says; null without any."""

    def better(acc: Column, x: Column) -> Column:
        own = lambda y: ~F.coalesce(y["built_in"], F.lit(False))
        newer = F.coalesce(x["created"] > acc["created"], x["created"].isNotNull() & acc["created"].isNull())
        tied = (F.round(acc["quality"] - x["quality"], 9) <= TIE) & own(x) & (~own(acc) | newer)
        return F.when((x["quality"] > acc["quality"]) | tied, x).otherwise(acc)

    return F.aggregate(F.slice(tried, 2, MOST), F.get(tried, 0), better)


def seed_mapping(saved: DataFrame, columns: DataFrame, suggested: DataFrame) -> DataFrame:
    """A saved mapping on a new table: file_id, field, column.

    `saved` has field and header; `columns` file_id, column and header. A field
    whose header is gone takes the suggested column, unless a saved one has it.
    """
    norm = lambda c: F.lower(F.trim(c))
    known = bounded(saved.select("field", norm(F.col("header")).alias("h")), 10_000, "saved fields")
    told = columns.join(known, norm(F.col("header")) == F.col("h")).select("file_id", "field", "column", F.lit(True).alias("told"))
    both = told.unionByName(suggested.select("file_id", "field", "column", F.lit(False).alias("told")))
    one = dealt(both, "file_id", suggested.count(), 100_000).groupBy("file_id").agg(F.collect_list(F.struct("told", "field", F.col("column").isNull().alias("none"), "column")).alias("rows"))
    one = one.withColumn("mine", F.array_sort(F.filter("rows", lambda x: x["told"])))
    one = one.select("file_id", "rows", F.filter("mine", lambda x, i: (i == 0) | ~x["field"].eqNullSafe(F.get("mine", i - 1)["field"])).alias("kept"))
    has = lambda name, value: F.coalesce(F.array_contains(F.transform("kept", lambda x: x[name]), value), F.lit(False))
    free = lambda x: ~x["told"] & (F.col("file_id").isNull() | ~has("field", x["field"]) & ~has("column", x["column"]))
    return one.select("file_id", F.explode(F.concat("kept", F.filter("rows", free))).alias("p")).select("file_id", "p.field", "p.column")
