"""Transaction rows: summaries, balance checks, duplicates, currency conversion and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.amounts import decimals_for
from tallyforge.functions.expr import col
from tallyforge.functions.text import description_key
from tallyforge.operators.ordered import PIECE, POS, SIZE, beside, earlier, in_pieces, inside, neighbours, spans

INFORMATIONAL = ("ocr", "pending")
HARD = ("unparseable_date", "missing_amount")


# --- ranges and summaries --------------------------------------------------


def in_range(date: Column | str, start: str | None, end: str | None) -> Column:
    """Inclusive, on ISO text; a null date is outside any bounded side and inside an open range."""
    d, out = col(date), F.lit(True)
    if start is not None:
        out = out & (d >= start)
    if end is not None:
        out = out & (d <= end)
    return F.coalesce(out, F.lit(False))


def active(df: DataFrame) -> DataFrame:
    """Rows neither excluded nor skipped; a missing flag column counts as false."""
    for c in ("excluded", "skipped"):
        if c in df.columns:
            df = df.filter(~F.coalesce(c, F.lit(False)))
    return df


def file_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key and currency: active rows, date range, totals in (zero counts as in) and out, and net. Null currencies are UNKNOWN."""
    a = F.col("amount")
    grouped = active(rows).groupBy(*keys, F.coalesce("currency", F.lit("UNKNOWN")).alias("currency"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.coalesce(F.sum(F.when(a >= 0, a)), F.lit(0)).alias("total_in"), F.coalesce(F.sum(F.when(a < 0, -a)), F.lit(0)).alias("total_out"), F.sum("amount").alias("net"),
    )


def extraction_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, those without an amount or a date, the valid ones, and the unreadable share."""
    no_amount, no_date = F.col("amount").isNull(), F.col("date").isNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~no_amount & ~no_date).alias("valid"), F.count_if(no_amount).alias("missing_amount"), F.count_if(no_date).alias("unparseable_date"),
        F.avg((no_amount | no_date).cast("int")).alias("unreadable_rate"),
    )


def extraction_quality(valid: Column, date_led: Column, missing_rate: Column, unparseable_rate: Column) -> Column:
    return F.when(date_led > 0, valid / date_led - 0.5 * missing_rate - 0.5 * unparseable_rate).otherwise(0.0)


def coverage_warnings(rows: DataFrame, end: str, key: str = "account") -> DataFrame:
    """Accounts whose last date lies before the end of the range."""
    return rows.groupBy(key).agg(F.max("date").alias("last_date")).filter(F.col("last_date") < end)


def field_coverage(rows: DataFrame, file_col: str, fields: list[str]) -> DataFrame:
    """Per field: files that have a value in it, all files, and all, some or none."""
    has = [F.bool_or(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in fields]
    per_file = active(rows).groupBy(file_col).agg(*has)
    long = per_file.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("has")) for f in fields])))
    out = long.groupBy("field").agg(F.count_if("has").alias("covered"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("coverage", F.when(F.col("covered") == F.col("total"), "all").when(F.col("covered") == 0, "none").otherwise("some"))


def decision_rows(rows: DataFrame) -> DataFrame:
    """Rows with a flag that isn't informational."""
    return active(rows).filter(F.size(F.array_except("flags", F.array(*map(F.lit, INFORMATIONAL)))) > 0)


def sign_warnings(rows: DataFrame, *keys: str) -> DataFrame:
    a = F.col("amount")
    return active(rows).groupBy(*keys).agg((~F.coalesce(F.bool_or(a < 0), F.lit(False))).alias("no_outflow"), (F.coalesce(F.bool_and(a >= 0), F.lit(False)) | F.coalesce(F.bool_and(a <= 0), F.lit(False))).alias("one_signed"))


# --- balances --------------------------------------------------------------


def balance_check(rows: DataFrame, keys: list[str], order: list[str], size: int = SIZE) -> DataFrame:
    """Per key: opening and closing balance, total, whether they reconcile, and the first row whose stated balance differs.

    The opening balance is the first stated one less its amount. Sums run
    inside pieces of rows and are carried from piece to piece, so a key may hold
    any share of all rows.
    """
    pieces = in_pieces(rows.select(*keys, *[c for c in order if c not in keys], "balance", "amount"), keys, order, size)
    both = F.col("balance").isNotNull() & F.col("amount").isNotNull()
    stated = F.when(both, F.col("balance") - F.col("amount"))
    at = F.when(both, F.col(POS))
    told = spans(pieces, keys, _part=F.sum("amount"), _stated=F.min_by(stated, at))
    told = told.withColumns({"_before": F.sum("_part").over(earlier(keys)), "_opening": F.first("_stated", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_carried": F.lit(True)})
    seen = beside(pieces, told, keys, "_before", "_opening", "_carried")
    w = Window.partitionBy(*keys, PIECE)
    opening = F.when(F.col("_carried").isNull(), F.min_by(stated, at).over(w)).otherwise(F.col("_opening"))
    running = F.coalesce("_before", F.lit(0)) + F.sum("amount").over(inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumns({"_open": opening, "_sum": running}).withColumn("_running", F.col("_open") + F.col("_sum"))
    bad = both & (F.col("_running") != F.col("balance"))
    out = seen.groupBy(*keys).agg(
        F.first("_open").alias("opening"), F.max_by(F.when(both, F.col("balance")), at).alias("closing"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"),
        F.min_by(F.when(bad, F.struct(*order, "balance", "_running")), F.when(bad, F.col(POS))).alias("_bad"),
    )
    return out.select(*keys, "opening", "closing", "total", (F.col("opening") + F.col("total") == F.col("closing")).alias("reconciles"), *[F.col(f"_bad.{c}").alias(f"failing_{c}") for c in order], F.col("_bad.balance").alias("stated"), F.col("_bad._running").alias("computed"))


def tag_running_mismatches(rows: DataFrame, key: str, order: list[str], size: int = SIZE) -> DataFrame:
    """The same as `tag_balance_mismatches` for keys (accounts, merged files) that may hold any share of all rows.

    Neighbours are told inside pieces of rows and from the ends of the pieces
    beside; fits are counted before rows are exchanged.
    """
    pieces = in_pieces(rows, [key], order, size)
    live = F.col("balance").isNotNull() & F.col("amount").isNotNull()
    # Neighbours are those among rows with both values; the others are passed over.
    near = neighbours(pieces.filter(live), [key], ["balance", "amount"])
    b, a, pb, pa, nb = F.col("balance"), F.col("amount"), F.col("_prev.balance"), F.col("_prev.amount"), F.col("_next.balance")
    fits = near.withColumns({"_down": pb + a == b, "_up": b + pa == pb, "_own": nb + a == b})
    sums = fits.groupBy(F.col(key).alias("_f")).agg(F.count("_down").alias("_pairs"), F.sum(F.col("_down").cast("int")).alias("_nd"), F.sum(F.col("_up").cast("int")).alias("_nu")).filter("greatest(_nd, _nu) * 2 >= _pairs")
    wrong = F.when(F.col("_nd") >= F.col("_nu"), ~F.col("_down")).otherwise(~F.col("_own"))
    tagged = fits.filter("NOT _down OR NOT _own").join(sums, F.col(key).eqNullSafe(F.col("_f"))).filter(wrong).select(F.col(POS).alias("_at"), F.lit(True).alias("balance_mismatch"))
    out = pieces.join(tagged, F.col(POS) == F.col("_at"), "left").drop("_at", POS, PIECE)
    return out.withColumn("balance_mismatch", F.coalesce("balance_mismatch", F.lit(False)))


def tag_balance_mismatches(rows: DataFrame, file_col: str, order: list[str]) -> DataFrame:
    """Rows with `balance_mismatch`: the stated balance isn't the one before plus the amount.

    Each file is read in the direction that fits more neighbours (downwards on
    a tie); where fewer than half fit, none is tagged. A file is a window, which
    its limit of size bounds; `tag_running_mismatches` has no such bound.
    """
    live = F.col("balance").isNotNull() & F.col("amount").isNotNull()
    w = Window.partitionBy(file_col, live).orderBy(*order)
    prev_b, prev_a, next_b = F.lag("balance").over(w), F.lag("amount").over(w), F.lead("balance").over(w)
    down = F.when(live & prev_b.isNotNull(), prev_b + F.col("amount") == F.col("balance"))
    up = F.when(live & prev_b.isNotNull(), F.col("balance") + prev_a == prev_b)
    up_own = F.when(live & next_b.isNotNull(), next_b + F.col("amount") == F.col("balance"))
    f = Window.partitionBy(file_col)
    marked = rows.withColumns({"_down": down, "_up": up, "_up_own": up_own})
    marked = marked.withColumns({"_pairs": F.count("_down").over(f), "_nd": F.sum(F.col("_down").cast("int")).over(f), "_nu": F.sum(F.col("_up").cast("int")).over(f)})
    fit = F.greatest("_nd", "_nu") * 2 >= F.col("_pairs")
    wrong = F.when(F.col("_nd") >= F.col("_nu"), ~F.col("_down")).otherwise(~F.col("_up_own"))
    return marked.withColumn("balance_mismatch", F.coalesce(fit & wrong, F.lit(False))).drop("_down", "_up", "_up_own", "_pairs", "_nd", "_nu")


# --- duplicates ------------------------------------------------------------


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def fingerprint(account: str = "account", description: str = "description") -> Column:
    """Account, date, amount, currency and description key; null without a date."""
    return F.when(F.col("date").isNotNull(), _key(F.col(account), F.col("date"), F.col("amount"), F.col("currency"), description_key(description)))


def near_key(account: str = "account") -> Column:
    """The same without the description."""
    return F.when(F.col("date").isNotNull(), _key(F.col(account), F.col("date"), F.col("amount"), F.col("currency")))


def possible_duplicates(rows: DataFrame, file_col: str, order: str) -> DataFrame:
    """Rows with `possible_duplicate`: a second or later occurrence within a file."""
    fp = _key(F.col("account"), F.col("date"), F.col("amount"), F.col("currency"), F.lower("description"))
    return rows.withColumn("possible_duplicate", F.row_number().over(Window.partitionBy(file_col, fp).orderBy(order)) > 1)


def merge_across_files(rows: DataFrame, file_col: str = "file", recognised: Column | None = None) -> DataFrame:
    """Rows with `kept`: of each fingerprint only the file that has it most often keeps its rows.

    Ties go to text over recognised files, then to the first file. Counts are
    combined before they are exchanged; rows without a date stay.
    """
    seen = rows.withColumns({"_fp": fingerprint(), "_ocr": F.lit(False) if recognised is None else recognised})
    counts = seen.filter("_fp IS NOT NULL").groupBy("_fp", file_col).agg(F.count(F.lit(1)).alias("n"), F.max("_ocr").alias("ocr"))
    winner = counts.groupBy("_fp").agg(F.max(F.struct("n", (~F.col("ocr")).alias("text"), (-F.col(file_col)).alias("o"))).alias("w")).select("_fp", (-F.col("w.o")).alias("_winner"))
    return seen.join(winner, "_fp", "left").withColumn("kept", F.col("_winner").isNull() | (F.col("_winner") == F.col(file_col))).drop("_fp", "_ocr", "_winner")


def near_pairs(rows: DataFrame, file_col: str = "file", id_col: str = "row_id") -> DataFrame:
    """One pair per near key and pair of files: equal but for the description, each row's fingerprint missing from the other file."""
    seen = rows.select(F.col(file_col).alias("file"), F.col(id_col).alias("row_id"), near_key().alias("nk"), fingerprint().alias("fp")).filter("nk IS NOT NULL")
    # Of equal rows of a file the least stands for all.
    seen = seen.groupBy("nk", "file", "fp").agg(F.min("row_id").alias("row_id"))
    have = seen.select("nk", "file", "fp")
    a, b = seen.alias("a"), seen.alias("b")
    pairs = a.join(b, (F.col("a.nk") == F.col("b.nk")) & (F.col("a.file") < F.col("b.file")) & (F.col("a.fp") != F.col("b.fp")))
    pairs = pairs.select(F.col("a.nk").alias("nk"), F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b"), F.col("a.row_id").alias("row_a"), F.col("b.row_id").alias("row_b"), F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))
    for mine, other in (("fp_a", "file_b"), ("fp_b", "file_a")):
        pairs = pairs.join(have.select("nk", F.col("file").alias(other), F.col("fp").alias(mine)), ["nk", other, mine], "left_anti")
    return pairs.groupBy("nk", "file_a", "file_b").agg(F.min(F.struct("row_a", "row_b")).alias("p")).select("nk", "file_a", "file_b", "p.row_a", "p.row_b")


def duplicate_files(files: DataFrame, order: str) -> DataFrame:
    """Files with `duplicate_of`: the first file with the same bytes, null for that one."""
    first = F.min_by("file_id", order).over(Window.partitionBy("sha256"))
    return files.withColumn("duplicate_of", F.when(first != F.col("file_id"), first))


def exact_duplicate_file(count: Column, total: Column, same_bytes: Column, other_total: Column) -> Column:
    """Whether all rows of a file are in another one, and that has the same bytes or as many rows."""
    return (count == total) & (F.coalesce(same_bytes, F.lit(False)) | (other_total == total))


def resolve_pairs(rows: DataFrame, pairs: DataFrame, choices: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows with `dropped`: the second row of each near pair that people chose to merge (choices: nk, choice; `both` keeps both)."""
    gone = pairs.join(choices.filter("choice = 'merge'"), "nk").select(F.col("row_b").alias(id_col)).distinct().withColumn("dropped", F.lit(True))
    return rows.join(gone, id_col, "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def undo_dedupe(rows: DataFrame) -> DataFrame:
    """Rows as they were before any merge: nothing is kept out and no file counts as merged."""
    return rows.withColumns({c: F.lit(v) for c, v in (("kept", True), ("dropped", False)) if c in rows.columns})


def dedupe_notice(rows: DataFrame, file_col: str = "file") -> DataFrame:
    """What merging and choices took out of each file: file, removed."""
    return rows.groupBy(file_col).agg(F.count_if(~F.col("kept") | F.col("dropped")).alias("removed")).filter("removed > 0")


# --- currencies ------------------------------------------------------------


def convert(rows: DataFrame, target: str, rates: DataFrame) -> DataFrame:
    """Rows with converted_amount, converted_currency and fx_rate.

    `rates` has source, target, month (null: any) and rate, one row a currency
    pair and month: a table of at most some thousand rows. A month's rate goes
    before the pair's. A missing rate gives nulls; the same currency has rate 1.
    """
    own = rates.filter(F.col("target") == target)
    monthly = own.filter("month IS NOT NULL").select(F.col("source").alias("_s"), F.col("month").alias("_m"), F.col("rate").alias("_monthly"))
    flat = own.filter("month IS NULL").select(F.col("source").alias("_f"), F.col("rate").alias("_flat"))
    joined = rows.join(monthly, (F.col("currency") == F.col("_s")) & (F.substring("date", 1, 7) == F.col("_m")), "left").join(flat, F.col("currency") == F.col("_f"), "left")
    rate = F.when(F.col("currency") == target, F.lit(1.0)).otherwise(F.coalesce("_monthly", "_flat"))
    scale = F.pow(F.lit(10.0), decimals_for(F.lit(target)) - decimals_for("currency"))
    return joined.withColumn("fx_rate", rate).withColumns({"converted_amount": F.floor(F.col("amount") * F.col("fx_rate") * scale + 0.5).cast("long"), "converted_currency": F.when(F.col("fx_rate").isNotNull(), F.lit(target))}).drop("_s", "_m", "_monthly", "_f", "_flat")


def missing_rates(converted: DataFrame) -> DataFrame:
    return converted.filter("fx_rate IS NULL AND amount IS NOT NULL").select("currency").distinct()


# --- incremental export ----------------------------------------------------


def since_last_export(markers: DataFrame, rows: DataFrame) -> DataFrame:
    """Per account: the start of the next export (the day after the earliest marker) and whether its own marker overlaps it."""
    start = markers.agg(F.date_add(F.min(F.col("marker").cast("date")), 1).cast("string").alias("start"))
    held = rows.join(markers, "account").crossJoin(F.broadcast(start)).filter("date BETWEEN start AND marker").select("account").distinct().withColumn("overlap", F.lit(True))
    return markers.crossJoin(F.broadcast(start)).join(held, "account", "left").select("account", "start", (F.coalesce("overlap", F.lit(False)) & (F.col("marker") >= F.col("start"))).alias("overlap"))


def multiset_score(truth: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """matches, misses and extras of two multisets on the keys."""
    t = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("t"))
    g = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    both = t.join(g, keys, "full_outer").select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("g", F.lit(0)).alias("g"))
    return both.agg(F.sum(F.least("t", "g")).alias("matches"), F.sum(F.greatest(F.col("t") - F.col("g"), F.lit(0))).alias("misses"), F.sum(F.greatest(F.col("g") - F.col("t"), F.lit(0))).alias("extras"))
