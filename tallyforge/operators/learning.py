"""What a saved statement type learns from files: anchors, signatures, guesses by name, hints, and backups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expr import let, trimmed
from tallyforge.functions.text import fuzzy_in_text, norm_header, tokens
from tallyforge.operators.infer import column_fill, filled, share
from tallyforge.operators.bounds import bounded
from tallyforge.operators.match import BROADCAST, filename_score

# Words of a statement's own vocabulary, phrases that always serve as anchors, and signs of personal data.
VOCABULARY = ("bank", "ltd", "pte", "account", "statement", "transaction", "history", "savings", "current", "credit", "card", "multiplier", "deposit", "ibanking", "digibank", "branch", "swift", "iban")
ALWAYS = ("transaction history", "statement", "account", "savings", "credit card")
PERSONAL = ("address", "blk", "street", "avenue", "road", "jalan", "unit", "postal", "mr", "mrs", "ms", "dear", "attn")
# A person's name in capitals; a cell that is a plain number; a mark of rows not yet posted.
CAPITALS = r"^[A-Z][A-Z.'-]*(?:\s+[A-Z][A-Z.'-]*){1,3}$"
PLAIN_NUMBER = r"^-?\d+([.,]\d+)?$"
UNPOSTED = r"(?i)^\s*\[UNPOSTED\]"
LONGEST_ANCHOR, ANCHORS = 60, 3


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b") if words else F.lit(False)


def repeated_words(corpus: Column) -> Column:
    """The words, in small letters, that stand twice or more in a text: told once a text, by sorting."""
    return let(F.array_sort(F.transform(tokens(corpus), F.lower)), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))


def plausible_in(phrase: Column, twice: Column, banks: tuple[str, ...] = ()) -> Column:
    """Whether a phrase may identify a statement: it holds a known phrase or bank, or each of its words is among those that stand twice or more in the corpus."""
    words = F.transform(tokens(phrase), F.lower)
    known = F.forall(words, lambda w: F.array_contains(twice, w))
    return F.coalesce((trimmed(phrase) != "") & (_holds(phrase, ALWAYS) | _holds(phrase, banks) | ((F.size(words) > 0) & known)), F.lit(False))


def plausible_anchor(phrase: Column, corpus: Column, banks: tuple[str, ...] = ()) -> Column:
    """The same with the corpus itself."""
    return plausible_in(phrase, repeated_words(corpus), banks)


def distinctiveness(phrase: Column, banks: tuple[str, ...] = ()) -> Column:
    return _holds(phrase, VOCABULARY).cast("int") + _holds(phrase, banks).cast("int")


def anchor_candidates(lines: DataFrame, first_data: Column, corpus: DataFrame, banks: tuple[str, ...] = (), file: str = "file_id", order: str = "line", text: str = "text") -> DataFrame:
    """The three best anchors of each file: file, rank, anchor.

    Lines before `first_data` (null: all) of up to 60 characters, without two
    digits in a row, personal data or names in capitals, and plausible in the
    file's text (`corpus`: file and text). More distinctive ones go first, then
    earlier ones.
    """
    t = trimmed(F.col(text))
    name = t.rlike(CAPITALS) & ~_holds(t, VOCABULARY)
    some = lines.filter(F.coalesce(F.col(order) < first_data, F.lit(True))).select(file, order, t.alias("anchor"), name.alias("_name")).filter((F.col("anchor") != "") & (F.length("anchor") <= LONGEST_ANCHOR))
    some = some.filter(~F.col("anchor").rlike(r"\d{2,}|(?i)\bsingapore \d") & ~_holds(F.col("anchor"), PERSONAL) & ~F.col("_name"))
    mine = some.groupBy(file, "anchor").agg(F.min(order).alias(order)).groupBy(file).agg(F.collect_list(F.struct("anchor", order)).alias("_some"))
    # A file's words are counted where its text is; what meets its phrases is the list of repeated ones, once.
    one = corpus.select(file, repeated_words(F.col("text")).alias("_twice")).join(mine, file)
    one = one.select(file, "_twice", F.inline("_some")).filter(plausible_in(F.col("anchor"), F.coalesce("_twice", F.array().cast("array<string>")), banks))
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.desc(distinctiveness(F.col("anchor"), banks)), order))
    return one.select(file, rank.alias("rank"), "anchor").filter(f"rank <= {ANCHORS}")


def anchor_score(anchors: Column, text: Column) -> Column:
    """Share of the anchors that a text holds, roughly; 0 without any."""
    return F.when(F.size(anchors) > 0, F.size(F.filter(anchors, lambda a: fuzzy_in_text(a, text))) / F.size(anchors)).otherwise(0.0)


def learn_signatures(versions: DataFrame, signals: DataFrame, banks: tuple[str, ...] = ()) -> DataFrame:
    """Versions (profile_id, version_id, bank, alternatives) with what files taught: of each signal's keywords and anchors the first three plausible ones, and a name pattern."""
    from tallyforge.functions.text import filename_signature

    corpus = F.array_join(F.concat("s.keywords", "s.anchors"), "\n")
    good = lambda c: F.slice(F.filter(c, lambda a: plausible_anchor(a, corpus, banks)), 1, ANCHORS)
    new = F.struct(F.col("s.header").alias("header"), good(F.col("s.keywords")).alias("keywords"), good(F.col("s.anchors")).alias("anchors"), filename_signature(F.col("s.name"), F.col("bank")).alias("filename"))
    told = signals.groupBy("profile_id", "version_id").agg(F.array_sort(F.collect_list(F.struct("seq", "header", "keywords", "anchors", "name"))).alias("ss"))
    joined = versions.join(told, ["profile_id", "version_id"], "left")
    each = joined.select("profile_id", "version_id", "bank", "alternatives", F.posexplode_outer("ss").alias("i", "s")).withColumn("new", F.when(F.col("s").isNotNull(), new))
    grown = each.groupBy("profile_id", "version_id").agg(F.first("bank").alias("bank"), F.first("alternatives").alias("alternatives"), F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("i", "new")))).alias("ns"))
    return grown.select("profile_id", "version_id", "bank", F.concat("alternatives", F.transform("ns", lambda n: n["new"])).alias("alternatives"))


def guess_by_name(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile that a locked file's name suggests: file_id, profile_id.

    Of the PDF profiles with a password hint the first (by id) with a pattern
    (`patterns`, an array) that the name matches; where there is one such
    profile only, that one; else null.
    """
    hinted = profiles.filter("file_type = 'pdf' AND coalesce(password_hint, '') != ''").select("profile_id", "patterns")
    packed = bounded(hinted, BROADCAST, "profiles with a hint").agg(F.array_sort(F.collect_list(F.struct("profile_id", "patterns"))).alias("ps"))
    joined = files.crossJoin(F.broadcast(packed))
    fits = F.filter("ps", lambda p: F.exists(p["patterns"], lambda x: filename_score(x, F.col("name")) > 0))
    return joined.select("file_id", F.coalesce(F.get(fits, F.lit(0))["profile_id"], F.when(F.size("ps") == 1, F.get("ps", F.lit(0))["profile_id"])).alias("profile_id"))


def valid_profile(p: str) -> Column:
    """Whether a struct column has an id, a name and versions."""
    return F.col(f"{p}.id").isNotNull() & F.col(f"{p}.name").isNotNull() & F.col(f"{p}.versions").isNotNull()


PROFILE = "struct<id: string, name: string, bank: string, fileType: string, versions: array<string>>"


def write_backup(profiles: DataFrame, exported_at: str) -> DataFrame:
    """One JSON document with all profiles: a catalogue that people keep by hand."""
    packed = profiles.agg(F.array_sort(F.collect_list(F.struct(*profiles.columns))).alias("profiles"))
    return packed.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt"), "profiles")).alias("json"))


def read_backup(documents: DataFrame) -> DataFrame:
    """The profiles of backup documents (json). Text that isn't one, or holds a malformed profile, is an error."""
    parsed = documents.select(F.from_json("json", f"profiles array<{PROFILE}>").alias("d"))
    checked = parsed.select(F.explode(F.coalesce("d.profiles", F.raise_error(F.lit("not a backup: no profiles")))).alias("p"))
    return checked.filter(F.when(valid_profile("p"), True).otherwise(F.raise_error(F.concat(F.lit("malformed profile in a backup: "), F.coalesce("p.id", F.lit("without id")))).cast("boolean"))).select("p.*")


# --- hints -----------------------------------------------------------------


def country(bank: Column, currency: Column, of_bank: dict[str, str], of_currency: dict[str, str]) -> Column:
    """The bank's country, else the currency's, else empty."""
    out = F.lit("")
    for key, table in ((currency, of_currency), (bank, of_bank)):
        for k, v in table.items():
            out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def has_pending_prefix(values: Column) -> Column:
    return F.exists(values, lambda v: F.coalesce(v.rlike(UNPOSTED), F.lit(False)))


def has_crdr(values: Column) -> Column:
    from tallyforge.functions.amounts import parse_amount

    return F.exists(values, lambda v: parse_amount(v)["crdr"].isNotNull())


def is_foreign_header(header: Column) -> Column:
    return F.coalesce(norm_header(header).rlike(r"foreign ?(currency ?)?amount|fcy ?amount"), F.lit(False))


def header_confidence(row: Column, following: Column) -> Column:
    """How surely a row (array of cells) is the header: its share of cells that are no plain numbers, and whether the next row is as wide."""
    some = filled(row)
    textual = F.size(F.filter(some, lambda c: ~F.trim(c).rlike(PLAIN_NUMBER))) / F.size(some)
    return F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, 0.0).when(F.coalesce(F.size(following) == F.size(row), F.lit(False)), F.least(F.lit(1.0), 0.55 + 0.45 * textual)).otherwise(0.5 * textual)


def original_amount_column(columns: DataFrame) -> DataFrame:
    """The column of original amounts in another currency: file_id, column, confidence; files without one don't appear.

    Of the columns that are amounts for four fifths, the second by fill, if the
    first is filled for half and it isn't, it has currency codes, and its
    commonest code isn't the first's.
    """
    from tallyforge.functions.text import is_amount_like

    known = columns.filter(F.size(filled("values")) > 0).filter(share(F.col("values"), is_amount_like) >= 0.8).select("file_id", "column", "header", column_fill("values").alias("f"))
    two = known.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("f.fill")).alias("o"), "column", "header", F.col("f.coded").alias("coded"), F.col("f.code").alias("code")))).alias("c")).filter("size(c) >= 2")
    a, b = F.col("c")[0], F.col("c")[1]
    fits = (-a["o"] >= 0.5) & (-b["o"] < 0.5) & (b["coded"] > 0) & ~F.coalesce(b["code"] == a["code"], F.lit(False))
    return two.filter(fits).select("file_id", b["column"].alias("column"), F.when(is_foreign_header(b["header"]), 0.65).otherwise(0.5).alias("confidence"))


def convention_of(fields: Column, samples: Column, statement_type: Column) -> Column:
    """debitCredit where both are mapped; else crdr where a sample is marked; else positiveIsOut for cards; else signed."""
    both = F.array_contains(fields, "debit") & F.array_contains(fields, "credit")
    return F.when(both, "debitCredit").when(has_crdr(samples), "crdr").when(statement_type == "credit_card", "positiveIsOut").otherwise("signed")


def date_format_of_mapping(fields: Column, rows: Column) -> Column:
    """The format of the dates in the column mapped to date, else in the first column: fields by column, rows as arrays of cells."""
    from tallyforge.functions.dates import suggest_date_format

    at = F.greatest(F.array_position(fields, "date"), F.lit(1)).cast("int") - 1
    return suggest_date_format(F.transform(rows, lambda r: F.get(r, at)))


def fields_of_mapping(mapping: DataFrame) -> DataFrame:
    """A mapping (file_id, position, field, source) as `fields`: a map of field to its sources.

    Descriptions and references keep all their sources in order, others the
    first; with a debit or credit the amount column goes; extras keep their
    names.
    """
    ordered = mapping.filter("field IS NOT NULL").groupBy("file_id", "field").agg(F.array_sort(F.collect_list(F.struct("position", "source"))).alias("s"))
    kept = ordered.select("file_id", "field", F.transform(F.when(F.col("field").isin("description_raw", "reference"), F.col("s")).otherwise(F.slice("s", 1, 1)), lambda x: x["source"]).alias("sources"))
    pair = F.max(F.col("field").isin("debit", "credit")).over(Window.partitionBy("file_id"))
    return kept.withColumn("_pair", pair).filter("NOT (_pair AND field = 'amount')").groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "sources")))).alias("fields"))
