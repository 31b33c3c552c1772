"""Saved versions as a column: one plan reads files of any number of statement types, and tries several on one file.

A version is a struct (CONFIG) in a column beside a file's grid. Windows, rules,
sources, formats, signs and transforms are looked up in it row by row, so files
with different versions go through the same stages, and a candidate is tried by
putting its version beside the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.amounts import is_amount, resolve_amount, with_amounts
from tallyforge.functions.dates import INPUT_FORMATS, is_date, parse_date
from tallyforge.functions.expr import blank_as_null, computed, let, trimmed
from tallyforge.functions.patterns import fault
from tallyforge.functions.text import detect_currency, looks_like_transaction
from tallyforge.operators.grid import FOOTER_WORDS
from tallyforge.operators.grid import Window as GridWindow
from tallyforge.operators.infer import best_of
from tallyforge.operators.ledger import extraction_quality, possible_duplicates, tag_balance_mismatches
from tallyforge.operators.normalise import Version

_RULES = "array<struct<type: string, value: string>>"
#: What a version knows. `broken`: a pattern of it can't be used, so it reads nothing.
CONFIG = (
    f"struct<header_row: int, first_row: int, last_row: int, skip_before: int, excluded: array<int>, footers: {_RULES}, ignored: {_RULES}, sources: map<string, array<string>>, "
    "date_format: string, number_format: string, sign_convention: string, currency: string, transforms: array<struct<field: string, op: string, find: string, value: string, regex: boolean>>, broken: boolean>"
)
FIELDS = ("date", "description_raw", "amount", "debit", "credit", "currency", "balance")
#: Near-tied candidates: within this of the surest, and so many at most, are tried before one is chosen.
MARGIN, MOST = 0.1, 4


def config_of(window: GridWindow, version: Version) -> dict:
    """A window and a version as a row of CONFIG."""
    rules = lambda some: [{"type": r.type, "value": r.value} for r in some]
    patterns = [r.value for r in (*window.footers, *window.ignored) if r.type == "regex"] + [t.find for t in version.transforms if t.op == "replace" and t.regex]
    return {
        "header_row": window.header_row, "first_row": window.first_row, "last_row": window.last_row, "skip_before": window.skip_before, "excluded": list(window.excluded), "footers": rules(window.footers), "ignored": rules(window.ignored),
        "sources": version.sources, "date_format": version.date_format, "number_format": version.number_format, "sign_convention": version.sign_convention, "currency": version.currency,
        "transforms": [vars(t) for t in version.transforms], "broken": any(fault(p) for p in patterns),
    }


def saved_versions(spark: SparkSession, versions: list[dict]) -> DataFrame:
    """A table of saved versions: profile_id, version_id, built_in, created, config. Each dict has these (config: from `config_of`)."""
    schema = T._parse_datatype_string(f"profile_id string, version_id int, built_in boolean, created string, config {CONFIG}")
    return spark.createDataFrame([{"built_in": False, "created": None, "version_id": 1, **v} for v in versions], schema)


# --- grids to records -------------------------------------------------------


def _by_type(rules: Column) -> Column:
    """Rules as struct(starts, holds, patterns), told apart once for all rows; other types match nothing."""
    of = lambda kind, value: F.transform(F.filter(F.coalesce(rules, F.array().cast(_RULES)), lambda r: r["type"] == kind), lambda r: value(r["value"]))
    return F.struct(of("startsWith", F.lower).alias("starts"), of("contains", F.lower).alias("holds"), of("regex", lambda v: F.concat(F.lit("(?i)"), v)).alias("patterns"))


def row_matches(cells: Column, rules: Column) -> Column:
    """Whether a row meets any of the rules (`_by_type`), as `grid.row_matches` tells for one. Each text is made once, if a rule asks for it."""
    joined = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " ")
    first = F.lower(F.trim(F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit(""))))

    def some(values: Column, text: Column, hit) -> Column:
        return F.coalesce(F.when(F.size(values) > 0, let(text, lambda t: F.exists(values, lambda v: hit(t, v)))), F.lit(False))

    return some(rules["starts"], first, lambda t, v: t.startswith(v)) | some(rules["holds"], F.lower(joined), F.contains) | some(rules["patterns"], joined, F.rlike)


def windowed(grid: Column, c: Column) -> Column:
    """What a version (or a struct with its window) leaves of a grid: struct(columns: array of h and i, rows: array of row and cells), resolved inside the file's array."""
    empty = F.array().cast("array<string>")
    head = F.coalesce(c["header_row"], F.lit(0))
    start = F.when(c["first_row"].isNotNull(), F.greatest(c["first_row"], head + 1)).otherwise(F.greatest(head + 1, F.coalesce(c["skip_before"], F.lit(0))))
    last = F.least(F.coalesce(c["last_row"], F.size(grid) - 1), F.size(grid) - 1)
    names = F.transform(F.coalesce(F.get(grid, head), empty), lambda h: F.trim(F.coalesce(h, F.lit(""))))
    kept = F.filter(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: ~F.array_contains(F.coalesce(c["excluded"], F.array().cast("array<int>")), x["i"]))
    columns = let(kept, lambda k: F.filter(k, lambda x: ~F.exists(k, lambda y: (y["h"] == x["h"]) & (y["i"] > x["i"]))))
    placed = F.transform(grid, lambda x, i: F.struct(i.alias("row"), x.alias("cells")))
    body = let(F.struct(start.alias("start"), last.alias("last")), lambda at: F.filter(placed, lambda r: (r["row"] >= at["start"]) & (r["row"] <= at["last"]) & F.exists(r["cells"], lambda x: F.trim(x) != "")))

    def alive(rows: Column) -> Column:
        end = let(_by_type(c["footers"]), lambda rules: F.try_element_at(F.filter(rows, lambda r: row_matches(r["cells"], rules)), F.lit(1))["row"])
        return let(F.struct(end.alias("end"), _by_type(c["ignored"]).alias("rules")), lambda at: F.filter(rows, lambda r: (at["end"].isNull() | (r["row"] < at["end"])) & ~row_matches(r["cells"], at["rules"])))

    return F.struct(columns.alias("columns"), let(body, alive).alias("rows"))


def records_by_version(files: DataFrame, *keys: str) -> DataFrame:
    """Records of files that carry their own version: the keys, row, record, config.

    `files` has the keys, `grid` and `config`. Header, window, footers, rules
    and excluded columns are the version's, with the meaning of
    `grid.apply_window`; a file without a grid, or with a broken version, gives
    none. Everything is resolved inside a file's array: no rows are exchanged.
    """
    staged = computed(files.filter(~F.coalesce(F.col("config.broken"), F.lit(False)) & F.col("grid").isNotNull()), *keys, "config", _w=windowed(F.col("grid"), F.col("config")))
    each = staged.select(*keys, "config", F.col("_w.columns").alias("_columns"), F.explode("_w.rows").alias("r"))
    record = F.map_from_entries(F.transform("_columns", lambda x: F.struct(x["h"], F.coalesce(F.get(F.col("r.cells"), x["i"]), F.lit("")))))
    return each.select(*keys, F.col("r.row").alias("row"), record.alias("record"), "config", F.col("r.cells").alias("cells"))


# --- records to rows --------------------------------------------------------


def transformed(field: str, value: Column, transforms: Column) -> Column:
    """The version's steps for one field, in their order; meanings are those of `normalise.apply_transform`."""

    def step(s: Column, t: Column) -> Column:
        op, to = t["op"], F.coalesce(t["value"], F.lit(""))
        replaced = F.when(F.coalesce(t["regex"], F.lit(False)), F.regexp_replace(s, t["find"], to)).otherwise(F.replace(s, t["find"], to))
        return F.when(op == "trim", trimmed(s)).when(op == "upper", F.upper(s)).when(op == "lower", F.lower(s)).when(op == "replace", replaced).when(op == "flip_sign", (-s.try_cast("double")).cast("string")).when(op == "fixed", to).otherwise(s)

    return F.aggregate(F.filter(F.coalesce(transforms, F.array().cast("array<struct<field: string, op: string, find: string, value: string, regex: boolean>>")), lambda t: t["field"] == field), value, step)


def date_by(raw: Column, date_format: Column) -> Column:
    """Text in the format that a column names; null for a format that isn't known."""
    out = F.lit(None).cast("string")
    for f in INPUT_FORMATS:
        out = F.when(date_format == f, parse_date(raw, f)).otherwise(out)
    return out


def cells_by_version(records: DataFrame, *keys: str) -> DataFrame:
    """Records (of `records_by_version`) as what each row says by itself: the keys, row, date, description_raw, amount, currency, balance, skipped, _unknown (a currency that isn't known).

    Each cell is parsed once, in a stage of its own, and only where it holds
    text. A line whose date and amount both can't be read, or that begins like a
    footer and has no date, is `skipped`. No rows are exchanged.
    """
    c = F.col("config")
    sources = lambda f: F.coalesce(c["sources"][f], F.array().cast("array<string>"))
    raw = {f"_{f}": F.array_join(F.filter(F.transform(sources(f), lambda n: F.coalesce(F.col("record")[n], F.lit(""))), lambda x: x != ""), " ") for f in FIELDS}
    read = records.select(*keys, "row", "config", F.try_element_at(F.filter(F.transform("cells", lambda x: trimmed(x)), lambda x: x != ""), F.lit(1)).alias("_first"), *[v.alias(k) for k, v in raw.items()])
    pair = (F.size(sources("debit")) > 0) | (F.size(sources("credit")) > 0)
    shown = F.when(pair, F.concat_ws(" ", "_credit", "_debit")).otherwise(F.col("_amount"))
    none = F.lit(None).cast("string")
    read = read.withColumns({"_pair": pair, "_money": detect_currency(blank_as_null(F.col("_currency")), none, shown, c["currency"]), "_when": date_by(F.col("_date"), c["date_format"])})
    read = read.withColumns({"_code": F.col("_money.code"), "_unknown": F.col("_money.unknown").isNotNull()})
    cell = lambda when, f: (F.when(when & (F.col(f) != ""), F.col(f)), F.col("_code"), c["number_format"])
    read = with_amounts(read, _one=cell(~F.col("_pair"), "_amount"), _in=cell(F.col("_pair"), "_credit"), _out=cell(F.col("_pair"), "_debit"), _left=cell(F.lit(True), "_balance"))
    one, mark = F.col("_one.minor"), F.col("_one.crdr")
    signed = F.when(mark == "CR", F.abs(one)).when(mark == "DR", -F.abs(one)).when(c["sign_convention"] == "positiveIsOut", -one).otherwise(one)
    rows = read.select(
        *keys, "row", F.col("_when").alias("date"), transformed("description_raw", F.col("_description_raw"), c["transforms"]).alias("description_raw"),
        F.when(F.col("_pair"), resolve_amount(F.col("_in.minor"), F.col("_out.minor"))).otherwise(signed).alias("amount"), F.col("_code").alias("currency"), F.col("_left.minor").alias("balance"), "_unknown", "_first",
    )
    footer = F.col("date").isNull() & F.coalesce(F.col("_first").rlike(FOOTER_WORDS), F.lit(False))
    return rows.withColumn("skipped", (F.col("date").isNull() & F.col("amount").isNull()) | footer).drop("_first")


def rows_by_version(records: DataFrame, *keys: str) -> DataFrame:
    """Records (of `records_by_version`) as rows: the keys, row, date, description_raw, amount, currency, balance, skipped, flags.

    Rows are read by `cells_by_version`; skipped ones are not flagged. Where
    `keys` name a `type`, balances are checked for its `pdf` files; other files
    are what a bank itself exports.
    """
    rows, file = cells_by_version(records, *keys), F.struct(*keys)
    rows = possible_duplicates(rows.withColumns({"_file": file, "account": F.lit(None).cast("string"), "description": F.col("description_raw")}), "_file", "row")
    if "type" in keys:
        pages = F.col("type") == "pdf"
        checked = tag_balance_mismatches(rows.filter(pages), "_file", ["row"])
        rows = checked.unionByName(rows.filter(~F.coalesce(pages, F.lit(False))).withColumn("balance_mismatch", F.lit(False)))
    flag = lambda when, name: F.when(when & ~F.col("skipped"), F.lit(name))
    flags = [flag(F.col("date").isNull(), "unparseable_date"), flag(F.col("amount").isNull(), "missing_amount"), flag(F.col("_unknown"), "unknown_currency"), flag(F.col("possible_duplicate"), "possible_duplicate")]
    flags += [flag(F.col("balance_mismatch"), "balance_mismatch")] if "type" in keys else []
    return rows.select(*keys, "row", "date", "description_raw", "amount", "currency", "balance", "skipped", F.array_compact(F.array(*flags)).alias("flags"))


def file_rows(files: DataFrame, *keys: str) -> DataFrame:
    """From grids with their versions to rows."""
    return rows_by_version(records_by_version(files, *keys), *keys)


# --- trying candidates ------------------------------------------------------


def extraction(rows: DataFrame, *keys: str) -> DataFrame:
    """Per keys: n, kept (not skipped), valid, missing, unparseable, unusable (skipped, or without a date or an amount), of rows that are read anyway; `counted` tells the same of a file alone."""
    date, amount, skipped = F.col("date").isNull(), F.col("amount").isNull(), F.col("skipped")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~skipped).alias("kept"), F.count_if(~skipped & ~date & ~amount).alias("valid"),
        F.count_if(~skipped & amount).alias("missing"), F.count_if(~skipped & date).alias("unparseable"), F.count_if(skipped | date | amount).alias("unusable"),
    )


_WINDOW = ("broken", "header_row", "first_row", "last_row", "skip_before", "excluded", "footers", "ignored")


def _window_of(c: Column) -> Column:
    return F.struct(*[c[k].alias(k) for k in _WINDOW])


def _way_of(c: Column) -> Column:
    """All of a version that decides whether a line has a date and an amount: currency, sign, texts and balances don't."""
    return F.struct(_window_of(c).alias("window"), c["date_format"].alias("date_format"), c["number_format"].alias("number_format"), *[F.coalesce(c["sources"][f], F.array().cast("array<string>")).alias(f) for f in ("date", "amount", "debit", "credit")])


def _laid(w: Column) -> Column:
    """A window on the file's grid; nothing of it where there is none, or the version is broken."""
    nothing = F.struct(F.array().cast("array<struct<h: string, i: int>>").alias("columns"), F.array().cast("array<struct<row: int, cells: array<string>>>").alias("rows"))
    return let(w, lambda w: F.when(F.coalesce(w["broken"], F.lit(False)) | F.col("grid").isNull(), nothing).otherwise(windowed(F.col("grid"), w)))


def _places(way: Column, f: str, laid: Column) -> Column:
    """Where the columns of a field's sources stand; sources that the file lacks are left out."""
    return F.array_compact(F.transform(way[f], lambda name: F.array_max(F.transform(F.filter(laid["columns"], lambda x: x["h"] == name), lambda x: x["i"])))).alias(f)


def _text(cells: Column, places: Column) -> Column:
    return F.array_join(F.filter(F.transform(places, lambda i: F.coalesce(F.get(cells, i), F.lit(""))), lambda x: x != ""), " ")


def _line(way: Column, x: Column) -> Column:
    """What a line is to `extraction`, as a letter: v (valid), m (missing amount), u (unparseable date), or s (skipped)."""
    dated, paid = F.coalesce(*[F.when(way["date_format"] == f, is_date(x["date"], f)) for f in INPUT_FORMATS], F.lit(False)), is_amount(x["one"], way["number_format"]) | is_amount(x["other"], way["number_format"])
    first = trimmed(F.try_element_at(F.filter(x["cells"], lambda c: c.rlike(r"(?U)\S")), F.lit(1)))
    footer = F.coalesce(first.rlike(FOOTER_WORDS), F.lit(False))
    return F.when(dated, F.when(paid, "v").otherwise("m")).when(paid & ~footer, "u").otherwise("s")


def _judged(lines: Column) -> Column:
    """struct(quality, failed, n_rows, kept) of a file's lines as one way reads them: a letter each."""
    of = lambda k: F.length(lines) - F.length(F.replace(lines, F.lit(k), F.lit("")))

    def told(t: Column) -> Column:
        rate = lambda x: F.when(t["kept"] > 0, t[x] / t["kept"]).otherwise(0.0)
        quality = F.round(extraction_quality(t["v"], F.col("_date_led"), rate("m"), rate("u")), 9)
        return F.struct(quality.alias("quality"), ((t["n"] == 0) | ((t["n"] - t["v"]) * 2 > t["n"])).alias("failed"), t["n"].cast("long").alias("n_rows"), t["kept"].cast("long").alias("kept"))

    return let(F.struct(*[of(k).alias(k) for k in ("v", "m", "u")], F.length(lines).alias("n"), (F.length(lines) - of("s")).alias("kept")), told)


def _with_tried(beside: DataFrame, candidates: str, name: str) -> DataFrame:
    """Files (of `_beside`) with a further column `name`: for each of the candidates in a column, in their order, what `_judged` says of it.

    A window is laid on the grid once for all candidates that have it, and each
    way of reading is followed once: versions that differ in other things read
    the same lines. Equal ones are told by their JSON, which compares faster
    than structs. Every step is a stage of its own, so that none is nested deep.
    """
    at = lambda some, keys, key: F.get(some, F.array_position(keys, key).cast("int") - 1)
    put = lambda df, **made: computed(df, *df.columns, **made)
    out = put(beside, _each=F.transform(candidates, lambda x: _way_of(x["config"])))
    out = put(out, _of=F.transform("_each", lambda r: F.to_json(r)))
    out = put(out, _keys=F.array_distinct("_of"))
    out = put(out, _ways=F.transform("_keys", lambda k: at(F.col("_each"), F.col("_of"), k))).drop("_each")
    out = put(out, _window_of=F.transform("_ways", lambda r: F.to_json(r["window"])))
    out = put(out, _windows=F.array_distinct("_window_of"))
    out = put(out, _laid=F.transform("_windows", lambda k: _laid(at(F.col("_ways"), F.col("_window_of"), k)["window"])))
    out = put(out, _own=F.transform("_window_of", lambda k: at(F.col("_laid"), F.col("_windows"), k))).drop("_laid", "_windows", "_window_of")
    pair = lambda r: (F.size(r["debit"]) > 0) | (F.size(r["credit"]) > 0)
    out = put(out, _places=F.zip_with("_ways", "_own", lambda r, g: F.struct(pair(r).alias("pair"), *[_places(r, f, g) for f in ("date", "amount", "debit", "credit")])))
    money = lambda r, p: (_text(r["cells"], F.when(p["pair"], p["credit"]).otherwise(p["amount"])).alias("one"), F.when(p["pair"], _text(r["cells"], p["debit"])).otherwise("").alias("other"))
    out = put(out, _texts=F.zip_with("_own", "_places", lambda g, p: F.transform(g["rows"], lambda r: F.struct(_text(r["cells"], p["date"]).alias("date"), *money(r, p), r["cells"].alias("cells"))))).drop("_own", "_places")
    out = put(out, _lines=F.zip_with("_ways", "_texts", lambda r, t: F.array_join(F.transform(t, lambda x: _line(r, x)), ""))).drop("_ways", "_texts")
    out = put(out, _told=F.transform("_lines", _judged))
    return computed(out, *beside.columns, **{name: F.transform("_of", lambda k: at(F.col("_told"), F.col("_keys"), k))})


def _beside(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files that have candidates, each a row: the file's columns, _date_led (its lines that look like transactions, whatever the candidates), _c (its candidates without file_id)."""
    own = candidates.groupBy("file_id").agg(F.collect_list(F.struct(*[c for c in candidates.columns if c != "file_id"])).alias("_c"))
    lines = F.filter("grid", lambda r: looks_like_transaction(F.array_join(r, " ")))
    return computed(files.join(own, "file_id"), *files.columns, "_c", _date_led=F.coalesce(F.size(lines), F.lit(0)))


def try_candidates(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate (file_id, profile_id, version_id, config and more) with what it reads of its file: `quality` and `failed` beside its columns.

    `files` has file_id and grid. A file's candidates are tried beside its grid,
    and only counts leave it. A version that reads nothing, or no date or amount
    in more than half of its rows, fails.
    """
    tried = _with_tried(_beside(files.select("file_id", "grid"), candidates), "_c", "_t")
    told = tried.select("file_id", F.inline(F.zip_with("_c", "_t", lambda c, t: F.struct(c.alias("c"), t.alias("t")))))
    return told.select(*["file_id" if c == "file_id" else f"c.{c}" for c in candidates.columns], "t.quality", "t.failed", "t.n_rows", "t.kept")


def apply_matches(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """The version to use for each file that has candidates: file_id, profile_id, version_id, config, quality, fell_back, state.

    `candidates` has file_id, profile_id, version_id, confidence, rank,
    built_in, created and config; `files` has file_id, type, grid and may have
    `ocr`. The near-tied ones (among the first MOST within MARGIN of the file's
    surest) are tried and the best is picked (`infer.best_of`). If it fails, the
    others follow in the order of their ranks, but for those that failed
    already; the first that doesn't fail is used. Only files that come so far
    have their further candidates read. `state` is applied, matchFailed, or
    ocrFailed (a recognised file of which the last one tried reads no row at
    all); the version of a failed file is the last one tried. All of it happens
    beside the file's grid, so a file is read once.
    """
    fields = ("rank", "profile_id", "version_id", "confidence", "built_in", "created", "config")
    recognised = F.coalesce("ocr", F.lit(False)) if "ocr" in files.columns else F.lit(False)
    beside = _beside(files.select("file_id", "grid", recognised.alias("_ocr")), candidates.select("file_id", *fields))
    keep = ("file_id", "_ocr", "grid", "_date_led")
    by_rank = lambda some: F.array_sort(some, lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0))
    ranked = computed(beside, *keep, _c=by_rank("_c"), _surest=F.array_max(F.transform("_c", lambda x: x["confidence"])))
    near = lambda x, i: (F.col("_surest") - x["confidence"] <= MARGIN + 1e-9) & (i < MOST)
    split = computed(ranked, *keep, _near=F.filter("_c", near), _rest=F.filter("_c", lambda x, i: ~near(x, i))).filter(F.size("_near") > 0)
    told = lambda some, tried: F.zip_with(some, tried, lambda x, t: F.struct(*[x[f].alias(f) for f in fields], *[t[f].alias(f) for f in ("quality", "failed", "n_rows")]))
    first = computed(_with_tried(split, "_near", "_t"), *keep, "_rest", _first=told("_near", "_t"))
    picked = computed(first, *keep, "_rest", "_first", _picked=best_of(F.col("_first")))
    lost = computed(picked, *keep, "_first", "_picked", _rest=F.when(F.col("_picked.failed"), F.col("_rest")).otherwise(F.filter("_rest", lambda x: F.lit(False))))
    both = computed(_with_tried(lost, "_rest", "_t"), "file_id", "_ocr", "_first", "_picked", _more=told("_rest", "_t"))
    # Tried in order: the picked one, then by rank; a near-tied one that failed is passed over.
    good = F.when(F.col("_picked.failed"), F.try_element_at(by_rank(F.filter(F.concat("_first", "_more"), lambda x: ~x["failed"])), F.lit(1)))
    then = computed(both, "file_id", "_ocr", "_picked", _good=good, _last=F.try_element_at("_more", F.lit(-1)))
    used = computed(then, "file_id", "_ocr", _v=F.coalesce("_good", "_last", "_picked"), _back=F.coalesce("_good", "_last").isNotNull())
    state = F.when(~F.col("_v.failed"), "applied").when(F.col("_ocr") & (F.col("_v.n_rows") == 0), "ocrFailed").otherwise("matchFailed")
    return used.select("file_id", "_v.profile_id", "_v.version_id", "_v.config", "_v.quality", F.col("_back").alias("fell_back"), state.alias("state"))


def use_chosen(files: DataFrame, choices: DataFrame, versions: DataFrame) -> DataFrame:
    """A profile that people chose for a file (choices: file_id, profile_id), in its last version, without any fallback.

    Returns file_id, profile_id, version_id, config, confidence (1), and
    `outcome`: learn (offer to learn the file's signals), layoutChanged (the
    choice didn't fit: no rows, only skipped ones, or dates and amounts missing
    in more than half).
    """
    latest = versions.groupBy("profile_id").agg(F.max_by(F.struct("version_id", "config", "built_in", "created"), "version_id").alias("v")).select("profile_id", "v.*")
    told = try_candidates(files, choices.select("file_id", "profile_id").join(latest, "profile_id"))
    outcome = F.when(F.col("failed") | (F.col("kept") == 0), "layoutChanged").otherwise("learn")
    return told.select("file_id", "profile_id", "version_id", "config", F.lit(1.0).alias("confidence"), outcome.alias("outcome"))
