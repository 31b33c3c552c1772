"""From records to transaction rows by a saved version: sources, types, transforms, flags and checks in one chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.amounts import resolve_amount, signed_amount, with_amounts
from tallyforge.functions.dates import parse_date
from tallyforge.functions.expr import blank_as_null, trimmed
from tallyforge.functions.patterns import checked
from tallyforge.functions.text import detect_currency
from tallyforge.operators.grid import source_values
from tallyforge.operators.ledger import possible_duplicates, tag_balance_mismatches


@dataclass(frozen=True)
class Transform:
    """One step for a field: trim, upper, lower, replace (regex or not), flip_sign or fixed."""

    field: str
    op: str
    find: str = ""
    value: str = ""
    regex: bool = False


@dataclass(frozen=True)
class Version:
    """What a saved statement type knows: sources of the fields by header, formats and transforms."""

    sources: dict[str, list[str]]
    date_format: str = "YYYY-MM-DD"
    number_format: str | None = None
    sign_convention: str = "signed"
    currency: str | None = None
    transforms: tuple[Transform, ...] = field(default_factory=tuple)


def apply_transform(value: Column, t: Transform) -> Column:
    text = value.cast("string")
    if t.op == "trim":
        return trimmed(text)
    if t.op in ("upper", "lower"):
        return (F.upper if t.op == "upper" else F.lower)(text)
    if t.op == "replace":
        return F.regexp_replace(text, checked(t.find), t.value) if t.regex else F.replace(text, F.lit(t.find), F.lit(t.value))
    if t.op == "flip_sign":
        return -value.try_cast("double")
    return F.lit(t.value) if t.op == "fixed" else value


def apply_field_transforms(name: str, value: Column, transforms: tuple[Transform, ...]) -> Column:
    """The steps of one field in their order."""
    for t in transforms:
        if t.field == name:
            value = apply_transform(value, t)
    return value


def file_rows(records: DataFrame, version: Version, file: str = "file_id", order: str = "row") -> DataFrame:
    """Records (file, order and a map `record` of header to text) as rows: date, description_raw, amount, currency, balance, flags.

    Flags: unparseable_date, missing_amount, unknown_currency,
    possible_duplicate, balance_mismatch. Rows are never dropped.
    """
    of = lambda f: F.array_join(source_values("record", version.sources.get(f, [])), " ") if version.sources.get(f) else F.lit("")
    names = [f for f in ("debit", "credit", "amount", "balance") if f in version.sources]
    cells = records.select(file, order, *[of(f).alias(f"_{f}") for f in ("date", "description_raw", "currency", "amount", "balance", "debit", "credit")])
    # Each cell is parsed once; a file's version lacks some of them.
    read = with_amounts(cells, **{f"_of_{f}": (F.col(f"_{f}"), version.currency, version.number_format) for f in names})
    part = lambda f, k, kind: F.col(f"_of_{f}.{k}") if f in names else F.lit(None).cast(kind)
    if "debit" in version.sources or "credit" in version.sources:
        minor = resolve_amount(part("credit", "minor", "long"), part("debit", "minor", "long"))
    else:
        minor = signed_amount(part("amount", "minor", "long"), part("amount", "crdr", "string"), version.sign_convention)
    money = detect_currency(blank_as_null(F.col("_currency")), F.lit(None).cast("string"), F.col("_amount"), F.lit(version.currency))
    rows = read.select(
        file, order, parse_date(F.col("_date"), version.date_format).alias("date"), apply_field_transforms("description_raw", F.col("_description_raw"), version.transforms).alias("description_raw"),
        minor.alias("amount"), money.alias("_money"), part("balance", "minor", "long").alias("balance"),
    ).withColumns({"currency": F.col("_money.code"), "_unknown": F.col("_money.unknown").isNotNull()})
    rows = possible_duplicates(rows.withColumns({"account": F.col(file), "description": F.col("description_raw")}), file, order)
    rows = tag_balance_mismatches(rows, file, [order])
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(F.array(flag(F.col("date").isNull(), "unparseable_date"), flag(F.col("amount").isNull(), "missing_amount"), flag(F.col("_unknown"), "unknown_currency"), flag(F.col("possible_duplicate"), "possible_duplicate"), flag(F.col("balance_mismatch"), "balance_mismatch")))
    return rows.select(file, order, "date", "description_raw", "amount", "currency", "balance", flags.alias("flags"))
