"""Files and rows by state: one ordered case expression a question, and counts behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.expr import col
from tallyforge.operators.ledger import INFORMATIONAL, active

# States in the order in which the first that holds is taken; what each needs in a file row.
STATES = (
    ("error", "error IS NOT NULL"), ("processing", "processing"), ("ocrFailed", "ocr = 'failed'"), ("ocrCancelled", "ocr = 'cancelled'"), ("ocrQueued", "ocr = 'queued'"), ("imageOnly", "image_only"),
    ("noTransactions", "empty"), ("matchFailed", "match_failed"), ("layoutChanged", "n_rows > 0 AND layout_changed"), ("noTransactions", "n_rows > 0 AND n_active = 0"),
    ("unreadableDates", "n_rows > 0 AND unreadable_rate > 0.5"), ("healthy", "n_rows > 0"), ("new", "confidence IS NULL"), ("layoutChanged", "layout_changed"), ("lowConfidence", "confidence < 0.9"), ("matched", "true"),
)
FIELDS = {"error": "string", "processing": "boolean", "ocr": "string", "image_only": "boolean", "empty": "boolean", "match_failed": "boolean", "layout_changed": "boolean", "n_rows": "bigint", "n_active": "bigint", "unreadable_rate": "double", "confidence": "double"}


def file_status(files: DataFrame) -> DataFrame:
    """Files with `status`. Columns that a file table lacks count as null; a null condition doesn't hold."""
    have = files.select("*", *[F.lit(None).cast(t).alias(c) for c, t in FIELDS.items() if c not in files.columns])
    state = F.lit(None).cast("string")
    for name, condition in reversed(STATES):
        state = F.when(F.expr(condition), F.lit(name)).otherwise(state)
    return have.withColumn("status", state).select(*files.columns, "status")


def readiness(files: DataFrame, rows_in_range: int, missing_rates: int) -> DataFrame:
    """One row: the reasons, if any, that block an export."""
    n = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("processing", "ocrQueued")).alias("busy"), F.count_if(F.col("status") == "healthy").alias("ready"))
    reasons = F.array_compact(F.array(F.when(F.col("busy") > 0, "still processing"), F.when(F.col("ready") == 0, "no statement is ready"), F.when(F.lit(rows_in_range) == 0, "no rows in the range"), F.when(F.lit(missing_rates) > 0, "rates are missing")))
    return n.select(reasons.alias("reasons"), (F.size(reasons) == 0).alias("ready"))


def flag_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def count_check(extracted: Column | str, lines: Column | str, tolerance: float = 0.0) -> Column:
    """ok where both counts agree, neutral within the tolerance (a share of the lines), else fail."""
    gap = F.abs(col(extracted) - col(lines))
    return F.when(gap == 0, "ok").when(gap <= tolerance * col(lines), "neutral").otherwise("fail")


def account_table(rows: DataFrame, in_range: Column) -> DataFrame:
    """Per account: active rows, and those in the range."""
    return active(rows).groupBy("account").agg(F.count(F.lit(1)).alias("total"), F.count_if(in_range).alias("included"))


def rate_table(rows: DataFrame, target: str) -> DataFrame:
    """Foreign currencies and the months in which they occur."""
    return active(rows).filter(F.col("currency") != target).groupBy("currency").agg(F.array_sort(F.collect_set(F.substring("date", 1, 7))).alias("months"))


def upper_medians(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """The key (null is one) and `median` (the value of rank n // 2 + 1 among n) of values that are whole, not negative and not null; exact for any share of all rows.

    Equal values are counted once; then the rank is narrowed down by four times
    16 bits. So no step holds more than 65,536 rows of a key in one place.
    """
    from pyspark.sql import Window

    counts = rows.select(F.col(key).alias("_key"), value.alias("_v")).groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_n"))
    at = counts.groupBy("_key").agg((F.floor(F.sum("_n") / 2) + 1).alias("_left")).withColumn("_high", F.lit(0).cast("long"))
    before = Window.partitionBy("_key").orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for bits in (48, 32, 16, 0):
        near = at.select(F.col("_key").alias("_k"), F.col("_high").alias("_h"), "_left")
        within = counts.join(near, F.col("_key").eqNullSafe(F.col("_k")) & (F.shiftright(F.shiftright("_v", bits), 16) == F.col("_h")))
        digits = within.groupBy("_key", F.shiftright("_v", bits).alias("_high")).agg(F.sum("_n").alias("_n"), F.first("_left").alias("_left")).withColumn("_sum", F.sum("_n").over(before))
        at = digits.filter("_sum >= _left AND _sum - _n < _left").select("_key", "_high", (F.col("_left") - F.col("_sum") + F.col("_n")).alias("_left"))
    return at.select(F.col("_key").alias(key), F.col("_high").alias("median"))


def low_confidence(rows: DataFrame, file_col: str) -> DataFrame:
    """Rows of recognised files with `low_confidence` and `amount_alt`.

    Looked at: rows with an amount whose confidence is below 60. Flagged: a
    confidence of 0 or below 40, no cents in a file that mostly has them, or a
    hundred times the file's upper median. At 0 without cents a hundredth is
    offered instead. The median is exact; a file may hold any share of all rows.
    """
    size = F.abs("amount")
    some = rows.filter("amount IS NOT NULL")
    cents = some.groupBy(F.col(file_col).alias("_file")).agg(F.avg((F.col("amount") % 100 != 0).cast("int")).alias("_cents"))
    medians = upper_medians(some, file_col, size.cast("long")).select(F.col(file_col).alias("_of"), F.col("median").alias("_median"))
    told = cents.join(medians, F.col("_file").eqNullSafe(F.col("_of"))).drop("_of")
    joined = rows.join(told, F.col(file_col).eqNullSafe(F.col("_file")), "left")
    bare = F.col("amount") % 100 == 0
    odd = (F.col("confidence") == 0) | (F.col("confidence") < 40) | (bare & (F.col("_cents") > 0.5)) | (size > 100 * F.col("_median"))
    flagged = F.coalesce((F.col("confidence") < 60) & F.col("amount").isNotNull() & odd, F.lit(False))
    alt = F.when(flagged & (F.col("confidence") == 0) & bare, F.floor(F.col("amount") / 100 + 0.5).cast("long"))
    return joined.withColumns({"low_confidence": flagged, "amount_alt": alt}).drop("_file", "_cents", "_median")


def warning_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Active rows with a flag that isn't informational, by key."""
    real = F.size(F.array_except("flags", F.array(*map(F.lit, INFORMATIONAL)))) > 0
    return active(rows).groupBy(*keys).agg(F.count_if(real).alias("warnings"))


# What a flag says.
FLAG_LABELS = {
    "pending": "Pending, not yet posted", "unmatched_line": "Could not match to a line on the page", "unknown_currency": "Currency not recognised, using the statement currency",
    "balance_mismatch": "Amount may be misread, the balance does not add up",
}
#: States that get a card as they stand; a healthy file gets one for warnings or for a missing currency.
CARDS = ("ocrFailed", "noTransactions", "unreadableDates", "matchFailed", "new", "layoutChanged", "lowConfidence")


def flag_label(flag: Column, hint: Column | None = None) -> Column:
    """A flag's text; an unknown flag is its own; a row's hint goes before that of low_confidence_ocr."""
    out = flag
    for k, v in FLAG_LABELS.items():
        out = F.when(flag == k, F.lit(v)).otherwise(out)
    return out if hint is None else F.when((flag == "low_confidence_ocr") & (F.coalesce(hint, F.lit("")) != ""), hint).otherwise(out)


def attention_cards(files: DataFrame) -> DataFrame:
    """Cards of files (file_id, status, warnings, dismissed, no_currency, currency_resolved): file_id, kind."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    healthy = F.col("status") == "healthy"
    kinds = F.array_compact(F.array(F.when(F.col("status").isin(*CARDS), F.col("status")), F.when(healthy & (F.col("warnings") > 0) & ~yes("dismissed"), "warnings"), F.when(healthy & yes("no_currency") & ~yes("currency_resolved"), "currencyUnknown")))
    return files.select("file_id", F.explode(kinds).alias("kind"))


def source_included(files: DataFrame) -> DataFrame:
    """Files whose rows go into an export: not left out by hand, and with readable dates."""
    return files.filter(F.coalesce("include", F.lit(True)) & (F.col("status") != "unreadableDates"))


def not_included(files: DataFrame) -> DataFrame:
    """Reasons why files are left out, and how many: reason, n, label."""
    reason = F.when(F.col("status") == "unreadableDates", "dates could not be read").when(F.col("status") == "matchFailed", "could not be read").otherwise("not mapped yet")
    n = files.filter("status NOT IN ('healthy', 'processing')").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("reason", "n", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " file").otherwise(" files"), F.lit(" not included ("), F.col("reason"), F.lit(")")).alias("label"))


def health_badge(warnings: Column, mismatch: Column, mismatch_fails: Column) -> Column:
    """struct(label, tone): a count mismatch's text first, then the warnings, else all passed."""
    told = F.concat(warnings.cast("string"), F.when(warnings == 1, " warning").otherwise(" warnings"))
    return F.struct(
        F.when(mismatch.isNotNull(), mismatch).when(warnings > 0, told).otherwise("All checks pass").alias("label"),
        F.when(mismatch.isNotNull(), F.when(mismatch_fails, "danger").otherwise("warn")).when(warnings > 0, "warn").otherwise("ok").alias("tone"),
    )


def last_used_label(rows: Column, valid: Column, missing: Column, unparseable: Column) -> Column:
    """How a saved type's last use went; null without rows."""
    of = lambda n, what: F.concat(F.lit(f"Last used: {what} on "), n.cast("string"), F.lit(" of "), rows.cast("string"), F.lit(" rows"))
    whole = F.concat(F.lit("Last used: "), rows.cast("string"), F.lit(" of "), rows.cast("string"), F.lit(" rows read"))
    return F.when(rows > 0, F.when(valid >= rows, whole).when(missing >= unparseable, of(missing, "amounts missing")).otherwise(of(unparseable, "dates unreadable")))


def extraction_failed(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: whether all its rows are skipped, and whether its extraction failed (no rows, or dates unreadable for more than half)."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("s"), F.count_if(F.col("date").isNull()).alias("u"))
    out = files.select(key).join(n, key, "left")
    return out.select(key, F.coalesce((F.col("n") > 0) & (F.col("s") == F.col("n")), F.lit(False)).alias("all_skipped"), F.coalesce((F.col("n") == 0) | (F.col("u") / F.col("n") > 0.5), F.lit(True)).alias("failed"))


def neighbours_of(n: Column, index: Column) -> Column:
    """struct(next, previous) in a list of n around its ends; -1 where it is empty."""
    return F.struct(F.when(n > 0, F.pmod(index + 1, n)).otherwise(-1).alias("next"), F.when(n > 0, F.pmod(index - 1, n)).otherwise(-1).alias("previous"))


def removed_at(files: Column | str, index: Column) -> Column:
    """struct(files, removed): an array without one of its elements (from 0), and that one; a place outside leaves all."""
    f = col(files)
    inside = (index >= 0) & (index < F.size(f))
    return F.struct(F.when(inside, F.concat(F.slice(f, F.lit(1), index), F.slice(f, index + 2, F.size(f)))).otherwise(f).alias("files"), F.when(inside, F.get(f, index)).alias("removed"))


def restored_at(files: Column | str, index: Column, entry: Column) -> Column:
    """The array with an element put in at a place, at the nearest end if it is outside."""
    f = col(files)
    at = F.least(F.greatest(index, F.lit(0)), F.size(f))
    return F.concat(F.slice(f, F.lit(1), at), F.array(entry), F.slice(f, at + 1, F.size(f)))


def review_summary(rows: DataFrame, lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: active rows, totals, rows against lines, and whether all amounts have one sign: what a review shows on top."""
    a = F.col("amount")
    n = active(rows).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(a >= 0, a).otherwise(0)).alias("total_in"), F.sum(F.when(a < 0, -a).otherwise(0)).alias("total_out"), F.coalesce(F.bool_and(a >= 0), F.lit(False)).alias("all_in"))
    m = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"))
    return n.join(m, key, "left").select("*", count_check("n", F.coalesce("lines", F.lit(0)), 0.05).alias("check"))


def shown_columns(rows: DataFrame, optional: list[str], *keys: str) -> DataFrame:
    """Per file, which optional columns hold anything."""
    return rows.groupBy(*keys).agg(*[F.max(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in optional])


# --- choosing and applying a match -----------------------------------------


def compatible(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Saved profiles of each file's type: file_id and `profile_ids`, in order."""
    by_type = profiles.groupBy("type").agg(F.array_sort(F.collect_list("profile_id")).alias("profile_ids"))
    return files.join(by_type, "type", "left").select("file_id", F.coalesce("profile_ids", F.array().cast("array<string>")).alias("profile_ids"))


def next_untried(matches: DataFrame, tried: DataFrame) -> DataFrame:
    """The first match of each file (file_id, profile_id, rank) that hasn't been tried."""
    return matches.join(tried, ["file_id", "profile_id"], "left_anti").groupBy("file_id").agg(F.min_by("profile_id", "rank").alias("profile_id"))


def quality_losers(scored: DataFrame, picked: DataFrame) -> DataFrame:
    """The best of the saved profiles whose quality is below the picked one's: file_id, profile_id."""
    p = picked.select("file_id", F.col("profile_id").alias("picked"))
    with_p = scored.join(p, "file_id")
    quality = F.max(F.when(F.col("profile_id") == F.col("picked"), F.col("quality"))).over(_by_file())
    lost = with_p.withColumn("_q", F.coalesce(quality, F.lit(0.0))).filter("profile_id != picked AND NOT built_in AND quality < _q")
    return lost.groupBy("file_id").agg(F.max_by("profile_id", F.struct("quality", (-F.col("rank")).alias("o"))).alias("profile_id"))


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file_id")


def apply_best(candidates: DataFrame, failed: DataFrame) -> DataFrame:
    """The match to apply for each file after fallbacks: the best candidate (by quality, confidence and rank) whose extraction didn't fail, else the first one: file_id, profile_id, fell_back."""
    c = candidates.join(failed.withColumn("_bad", F.lit(True)), ["file_id", "profile_id"], "left")
    good = F.coalesce("_bad", F.lit(False))
    best = F.max_by("profile_id", F.struct((~good).alias("ok"), "quality", "confidence", (-F.col("rank")).alias("o")))
    first = F.max_by("profile_id", F.struct("quality", "confidence", (-F.col("rank")).alias("o")))
    return c.groupBy("file_id").agg(best.alias("profile_id"), first.alias("_first")).select("file_id", "profile_id", (F.col("profile_id") != F.col("_first")).alias("fell_back"))
