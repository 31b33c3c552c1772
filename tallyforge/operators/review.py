"""Review edits as an append-only event log; rows are the log applied to the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import let

#: Flags that say where a row came from; those that stay while a value is missing; those of an unsure reading.
KEPT_ON_CONFIRM = ("ocr", "manually_added")
HARD = ("unparseable_date", "missing_amount")
UNSURE = ("low_confidence_ocr", "low_confidence")


def live_events(events: DataFrame) -> DataFrame:
    """Events that no undo takes back. An undo takes back the latest live event before it of its row.

    `events` has row_id, seq, action (edit, exclude, restore, confirm, use_alt,
    undo), field and value. A row's events are folded in order within one
    array; a row has as many as a person makes.
    """
    folded = events.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "field", "value"))).alias("log"))
    kind = "array<struct<seq: bigint, action: string, field: string, value: string>>"
    stack = F.aggregate(
        F.col("log").cast(kind), F.array().cast(kind),
        lambda acc, e: F.when(e["action"] != "undo", F.array_append(acc, e)).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
    )
    return folded.select("row_id", F.inline(stack))


def apply_events(rows: DataFrame, events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows as a log leaves them: every event acts on the whole state of its row, in the order of seq.

    `rows` has row_id, date, amount, flags and may have amount_alt,
    low_confidence_hint and skipped; `fields` names the columns that may be
    edited and their types. `events` has row_id, seq, action, field and value,
    and may have `fields`, a map of several fields to new values at once; values
    are text, one that its field can't hold is null, other fields are ignored.

    * edit_cell, restore, treat, confirm_low: a field's new value (its first
      original is kept in `edited_fields`); no longer excluded; a skipped line
      becomes a transaction, flagged for what it lacks; a row with the flag of
      an unsure reading is confirmed.
    * edit, exclude, confirm, use_alt: the same as resolutions, which undo takes
      back. An edit also confirms; use_alt is an edit of the amount to
      amount_alt, where there is one, and clears the unsure reading.
    * undo: the row as it was before its last resolution that isn't undone,
      whatever came after; without one nothing.

    Confirming clears all flags but where a row came from, and what is still
    missing: a row that still lacks its date or amount isn't `confirmed`. Adds
    excluded, edited, confirmed, skipped and edited_fields (map of texts).
    Rows without events have these unset; events of other rows do nothing.
    """
    names = list(fields)
    own = {**{f: fields[f] for f in names}, "flags": "array<string>", "excluded": "boolean", "edited": "boolean", "confirmed": "boolean", "skipped": "boolean", "edited_fields": "map<string,string>"}
    if "low_confidence_hint" in rows.columns:
        own["low_confidence_hint"] = rows.schema["low_confidence_hint"].dataType.simpleString()
    state = f"struct<{', '.join(f'`{n}`: {k}' for n, k in own.items())}>"
    kind = f"struct<now: {state}, stack: array<{state}>>"

    def put(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, s[n]).alias(n) for n in own]).cast(state)

    def of(told: Column, f: str) -> Column:
        return F.filter(told, lambda x: x["field"] == f)

    def edited(s: Column, told: Column) -> Column:
        """Each named field's new value, and its original unless one is kept."""
        new, kept = {}, s["edited_fields"]
        for f in names:
            found = of(told, f)
            named = F.size(found) > 0
            new[f] = F.when(named, F.get(found, F.lit(0))["value"].try_cast(fields[f])).otherwise(s[f])
            kept = F.when(named & ~F.map_contains_key(s["edited_fields"], f), F.map_concat(kept, F.create_map(F.lit(f), s[f].cast("string")))).otherwise(kept)
        return put(s, **new, edited_fields=kept, edited=s["edited"] | F.exists(told, lambda x: x["field"].isin(*names)))

    value = lambda s, f: s[f] if f in own else F.col(f)

    def confirm(s: Column) -> Column:
        lacks = {"missing_amount": value(s, "amount").isNull(), "unparseable_date": value(s, "date").isNull()}
        left = F.filter(s["flags"], lambda x: x.isin(*KEPT_ON_CONFIRM) | ((x == "missing_amount") & lacks["missing_amount"]) | ((x == "unparseable_date") & lacks["unparseable_date"]))
        return put(s, flags=left, confirmed=~F.exists(left, lambda x: x.isin(*HARD)))

    def treat(s: Column) -> Column:
        flags = s["flags"]
        for name, lacking in (("unparseable_date", F.coalesce(value(s, "date").cast("string"), F.lit("")) == ""), ("missing_amount", value(s, "amount").isNull())):
            flags = F.when(lacking & ~F.array_contains(flags, name), F.array_append(flags, name)).otherwise(flags)
        return put(s, flags=flags, skipped=F.lit(False))

    def use_alt(s: Column) -> Column:
        if "amount_alt" not in rows.columns or "amount" not in fields:
            return s
        there = F.col("amount_alt").isNotNull()
        done = {"flags": F.filter(s["flags"], lambda x: ~F.coalesce(x.isin(*UNSURE), F.lit(False)))} | ({"low_confidence_hint": F.lit(None)} if "low_confidence_hint" in own else {})
        return F.when(there, let(edited(s, F.array(F.struct(F.lit("amount").alias("field"), F.col("amount_alt").cast("string").alias("value")))), lambda e: put(e, **done))).otherwise(s)

    def act(acc: Column, e: Column) -> Column:
        s, action = acc["now"], e["action"]
        new = (
            F.when(action == "edit", let(edited(s, e["told"]), confirm)).when(action == "edit_cell", edited(s, e["told"]))
            .when(action == "confirm", confirm(s)).when(action == "use_alt", use_alt(s)).when(action == "treat", treat(s))
            .when(action.isin("exclude", "restore"), put(s, excluded=action == "exclude"))
            .when((action == "confirm_low") & F.exists(s["flags"], lambda x: x.isin(*UNSURE)), confirm(s))
            .when((action == "undo") & (F.size(acc["stack"]) > 0), F.try_element_at(acc["stack"], F.lit(-1))).otherwise(s)
        )
        stack = F.when(action.isin("edit", "exclude", "confirm", "use_alt"), F.array_append(acc["stack"], s)).when(action == "undo", F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"])
        return F.struct(new.alias("now"), stack.alias("stack")).cast(kind)

    told = F.when(F.col("field").isNotNull(), F.array(F.struct("field", "value")))
    if "fields" in events.columns:
        told = F.coalesce(F.transform(F.map_entries("fields"), lambda x: F.struct(x["key"].alias("field"), x["value"].alias("value"))), told)
    told = F.coalesce(told, F.array()).cast("array<struct<field: string, value: string>>").alias("told")
    log = events.groupBy(F.col("row_id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("seq", "action", told))).alias("_log"))
    begin = {"excluded": F.lit(False), "edited": F.lit(False), "confirmed": F.lit(False), "skipped": F.coalesce("skipped", F.lit(False)) if "skipped" in rows.columns else F.lit(False), "edited_fields": F.create_map().cast("map<string,string>"), "flags": F.coalesce("flags", F.array().cast("array<string>"))}
    first = F.struct(*[begin.get(n, F.col(n) if n in rows.columns else F.lit(None)).alias(n) for n in own]).cast(state)
    start = F.struct(first.alias("now"), F.array().cast(f"array<{state}>").alias("stack")).cast(kind)
    folded = F.aggregate(F.coalesce("_log", F.array().cast(log.schema["_log"].dataType)), start, act, lambda acc: acc["now"])
    out = rows.join(log, rows["row_id"] == log["_row"], "left").withColumn("_end", folded)
    return out.select(*[c for c in rows.columns if c not in own], *[F.col(f"_end.{n}").alias(n) for n in own])


def add_manual_rows(rows: DataFrame, added: DataFrame, order: str) -> DataFrame:
    """Rows with the added ones behind the rows they follow: `added` has `after` (a value of the order column) and a sequence `n`."""
    placed = added.withColumn(order, F.col("after") + F.col("n") / (F.max("n").over(Window.partitionBy("after")) + 1)).drop("after", "n")
    return rows.withColumn(order, F.col(order).cast("double")).unionByName(placed, allowMissingColumns=True)
