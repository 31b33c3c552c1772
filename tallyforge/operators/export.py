"""Export layouts: an ordered list of columns becomes one projection, and rows become delimited text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.amounts import format_amount_out, format_money_in, format_money_out
from tallyforge.functions.dates import format_date_out
from tallyforge.functions.expr import blank_as_null, col
from tallyforge.functions.text import account_label

# The layouts, as field and name.
LAYOUTS = {
    "simple": (("date", "Date"), ("description_raw", "Description"), ("amount", "Amount")),
    "withAccount": (("date", "Date"), ("account_label", "Account"), ("description_raw", "Description"), ("amount", "Amount"), ("currency", "Currency")),
    "withBalance": (("date", "Date"), ("account_label", "Account"), ("description_raw", "Description"), ("amount", "Amount"), ("currency", "Currency"), ("balance", "Balance")),
    "budgetApp": (("date", "Date"), ("description_raw", "Payee"), ("amount", "Amount"), ("category", "Category")),
    "accounting": (("date", "Date"), ("description_raw", "Description"), ("money_out", "Debit"), ("money_in", "Credit"), ("balance", "Balance")),
}
VALUELESS = ("blank", "const")


@dataclass(frozen=True)
class Out:
    field: str
    name: str
    enabled: bool = True
    value: str = ""


@dataclass(frozen=True)
class Layout:
    """Columns and options of an export. Every change gives a new layout."""

    name: str = "New column layout"
    columns: tuple[Out, ...] = ()
    date_format: str = "YYYY-MM-DD"
    sign_convention: str | None = None
    header_row: bool = True

    @staticmethod
    def of(key: str) -> Layout:
        return Layout(key, tuple(Out(f, n) for f, n in LAYOUTS[key]))

    def add(self, field: str, name: str, value: str = "") -> Layout:
        """Append a column unless the field is there; valueless ones may repeat."""
        if field not in VALUELESS and any(c.field == field for c in self.columns):
            return self
        return replace(self, columns=(*self.columns, Out(field, name, value=value)))

    def remove(self, i: int) -> Layout:
        return replace(self, columns=self.columns[:i] + self.columns[i + 1 :])

    def move(self, a: int, b: int) -> Layout:
        rest = list(self.columns)
        rest.insert(b, rest.pop(a))
        return replace(self, columns=tuple(rest))

    def change(self, i: int, **new: object) -> Layout:
        return replace(self, columns=tuple(replace(c, **new) if k == i else c for k, c in enumerate(self.columns)))

    def active(self) -> tuple[Out, ...]:
        return tuple(c for c in self.columns if c.enabled)

    def split_money(self) -> Layout:
        """The amount column as money out and money in."""
        out: list[Out] = []
        for c in self.columns:
            out += [Out("money_out", "Money out"), Out("money_in", "Money in")] if c.field == "amount" else [c]
        return replace(self, columns=tuple(out))

    def reorder(self, picked: list[int]) -> Layout:
        """The picked columns in their order, then the others in theirs."""
        first = [self.columns[i] for i in picked if 0 <= i < len(self.columns)]
        return replace(self, columns=(*first, *(c for i, c in enumerate(self.columns) if i not in set(picked))))

    def toggle(self, i: int) -> Layout:
        return self.change(i, enabled=not self.columns[i].enabled)

    def option(self, key: str, value: object) -> Layout:
        return replace(self, **{key: value})

    def apply(self, key: str) -> Layout:
        """The columns of one of the fixed layouts; name and options stay."""
        return replace(self, columns=Layout.of(key).columns)

    def same_settings(self, other: Layout | None) -> bool:
        """Whether all but the name and fixed texts agree."""
        plain = lambda x: (x.date_format, x.sign_convention, x.header_row, [(c.field, c.name, c.enabled) for c in x.columns])
        return other is not None and plain(self) == plain(other)

    def fields(self) -> tuple[str, ...]:
        return tuple(c.field for c in self.columns)

    def problems(self) -> list[str]:
        return ["no name"] * (not self.name.strip()) + ["no column"] * (not self.active())

    def matching(self) -> str | None:
        fields = tuple(c.field for c in self.columns)
        return next((k for k, v in LAYOUTS.items() if tuple(f for f, _ in v) == fields), None)


def deduped(columns: tuple[Out, ...]) -> tuple[Out, ...]:
    """The first column of each field; blank and fixed ones may repeat."""
    seen: set[str] = set()
    return tuple(c for c in columns if c.field in VALUELESS or not (c.field in seen or seen.add(c.field)))


def picker_label(working: Layout, saved: list[Layout]) -> str:
    return next((x.name for x in saved if working.same_settings(x)), "Last used")


def working_layout(stored: Layout | None, saved: list[Layout], start: int | None = None) -> Layout:
    """The stored layout, else the saved one at a place, else the first."""
    return stored or saved[start if start is not None and 0 <= start < len(saved) else 0]


# The columns of an export over several files, and those that it gets where some row has a value in them.
UNION = (("date", "Date"), ("account_label", "Account"), ("description_raw", "Description"), ("amount", "Amount"), ("currency", "Currency"))
UNION_OPTIONAL = (("post_date", "Posting date"), ("reference", "Reference"), ("type", "Type"), ("orig_amount", "Original amount"), ("orig_currency", "Original currency"))


def union_layout(rows: DataFrame) -> Layout:
    """The layout for all files' rows together: one pass over the rows tells which optional columns hold anything."""
    from tallyforge.operators.ledger import active

    have = rows.columns
    filled = [F.max(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) if f in have else F.lit(False).alias(f) for f, _ in UNION_OPTIONAL if not f.startswith("orig_")]
    other = F.max(F.coalesce(F.col("orig_currency") != F.col("currency"), F.lit(False))).alias("orig") if "orig_currency" in have else F.lit(False).alias("orig")
    got = active(rows).agg(*filled, other).first()
    return Layout("union", tuple(Out(f, n) for f, n in (*UNION, *((f, n) for f, n in UNION_OPTIONAL if got["orig" if f.startswith("orig_") else f]))))


def extra_fields(columns: list[str], versions: DataFrame) -> DataFrame:
    """Extra fields of sample rows (column names) and of saved versions (extras: array of names): field and name, distinct."""
    from tallyforge.functions.text import humanize_extra

    own = versions.sparkSession.createDataFrame([(c,) for c in columns if c.startswith("extra_")], "field string")
    both = own.unionByName(versions.select(F.explode("extras").alias("field"))).distinct()
    return both.select("field", humanize_extra("field").alias("name"))


def rows_for_export(rows: DataFrame, start: str | None, end: str | None, target: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Active rows in the range; with a target currency the converted amounts take the amounts' place and those stay as original ones."""
    from tallyforge.operators.ledger import active, convert, in_range

    kept = active(rows).filter(in_range("date", start, end))
    if target is None:
        return kept
    done = convert(kept, target, rates).withColumns({"orig_amount": F.col("amount"), "orig_currency": F.col("currency"), "amount": F.col("converted_amount"), "currency": F.col("converted_currency")})
    return done.drop("converted_amount", "converted_currency", "fx_rate")


def mark_exported(markers: DataFrame, rows: DataFrame) -> DataFrame:
    """Markers (account, marker) after an export: the later of each account's marker and its last date."""
    new = rows.filter("date IS NOT NULL AND account IS NOT NULL").groupBy("account").agg(F.max("date").alias("new"))
    return markers.join(new, "account", "full_outer").select("account", F.greatest("marker", "new").alias("marker"))


def field_value(field: str, layout: Layout, have: list[str], value: str = "") -> Column:
    """The text of one column for each row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    given = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    if field in VALUELESS:
        return F.lit(value)
    if field in ("date", "post_date"):
        return format_date_out(given(field), layout.date_format)
    if field == "amount":
        return format_amount_out("amount", "currency", layout.sign_convention)
    if field == "money_out":
        return F.coalesce(format_money_out("amount", "currency"), F.lit(""))
    if field == "money_in":
        return F.coalesce(format_money_in("amount", "currency"), F.lit(""))
    if field in ("balance", "orig_amount", "converted_amount"):
        code = {"balance": "currency", "orig_amount": "orig_currency", "converted_amount": "converted_currency"}[field]
        return format_amount_out(field, code, layout.sign_convention if field == "orig_amount" else None) if field in have else F.lit("")
    if field == "flags":
        return F.array_join("flags", ";") if field in have else F.lit("")
    if field == "account_label":
        return F.coalesce(blank_as_null(given(field)), account_label(F.lit(""), F.coalesce(given("bank"), F.lit("")), F.coalesce(given("statement_type"), F.lit("")), F.coalesce(given("source_file"), F.lit("")), F.lit(None).cast("string")))
    return text(field)


def escape_cell(value: Column | str, delimiter: str = ",") -> Column:
    """Quoted where it holds the delimiter, a quote or a line end; quotes inside are doubled."""
    v = F.coalesce(col(value), F.lit(""))
    needs = v.contains(delimiter) | v.contains('"') | v.contains("\r") | v.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def project(rows: DataFrame, layout: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    """The visible columns under their names; a balance column only if some row has one."""
    visible = [c for c in layout.active() if c.field != "balance" or ("balance" in rows.columns and not rows.filter("balance IS NOT NULL").isEmpty())]
    return rows.select(*keep, *[field_value(c.field, layout, rows.columns, c.value).alias(c.name) for c in visible])


def delimited(rows: DataFrame, layout: Layout, keep: tuple[str, ...] = (), delimiter: str = ",") -> DataFrame:
    """Each row's line of text, skipped rows left out."""
    shown = project(rows.filter(~F.coalesce("skipped", F.lit(False))) if "skipped" in rows.columns else rows, layout, keep)
    names = shown.columns[len(keep) :]
    return shown.select(*keep, F.concat_ws(delimiter, *[escape_cell(F.col(f"`{n}`"), delimiter) for n in names]).alias("line"))


def header_line(layout: Layout, delimiter: str = ",") -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in (delimiter, '"', "\r", "\n")) else s
    return delimiter.join(quote(c.name) for c in layout.active())


def write_text(rows: DataFrame, layout: Layout, path: str, order: list[str], delimiter: str = ",") -> None:
    """A folder of text files whose lines, file after file, are in order; lines end in CR LF."""
    lines = delimited(rows, layout, tuple(order), delimiter).sort(*order).select("line")
    if layout.header_row:
        lines.write.mode("overwrite").option("lineSep", "\r\n").text(path + "/rows")
        rows.sparkSession.createDataFrame([(header_line(layout, delimiter),)], "line string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path + "/header")
    else:
        lines.write.mode("overwrite").option("lineSep", "\r\n").text(path + "/rows")


def filename_of(first: Column | str, last: Column | str, ext: str = "csv") -> Column:
    """The name of an export's file: its first and last date, one of them if they are equal, neither without rows."""
    return F.concat(F.concat_ws("_", F.lit("statement-export"), col(first), F.when(col(last) != col(first), col(last))), F.lit(f".{ext}"))
