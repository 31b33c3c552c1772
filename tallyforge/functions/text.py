"""Strings: headers, phrases, fuzzy matching, labels and masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.amounts import minor_of_digits, parse_amount, plain_digits, plain_minor
from tallyforge.functions.expr import blank_as_null, col, computed, found, let, trimmed

# Active ISO 4217 codes.
ISO_CURRENCIES = tuple(
    """
    AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD
    CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL
    GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD
    KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO
    NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD
    SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYI UYU UYW UZS VED VES VND VUV WST
    XAF XCD XCG XDR XOF XPF YER ZAR ZMW ZWG
    """.split()
)

_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiNnNnNnOoOoRrRrSsSsSsTtTtUuUuUuUuZzZzZz"


def strip_accents(s: Column | str) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.translate(F.regexp_replace(col(s), "[̀-ͯ]", ""), _ACCENTED, _PLAIN)


def norm_header(s: Column | str) -> Column:
    return F.regexp_replace(strip_accents(F.lower(trimmed(col(s)))), r"(?U)\s+", " ")


def normalize_phrase(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", " "))


def tokens(s: Column | str) -> Column:
    return F.regexp_extract_all(col(s), F.lit("[a-zA-Z0-9]+"), F.lit(0))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Common distinct tokens over the larger set; 0 where either is empty."""
    x, y = (F.array_distinct(tokens(normalize_phrase(c))) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def fuzzy_in_text(phrase: Column | str, text: Column | str, distance: int = 2, ratio: float = 0.85, slack: int = 4) -> Column:
    """Whether a phrase stands in a text: as it is, by tokens, or as a window of as many words within an edit distance.

    `distance` edits leave one of `distance` + 1 pieces of the phrase whole, so
    only windows that hold one of them, no further from its place than that,
    are compared; a text without any of the pieces has no such window.
    """

    def look(x: Column) -> Column:
        p, h = x["p"], x["h"]
        size = F.greatest(F.floor(F.length(p) / (distance + 1)).cast("int"), F.lit(1))
        pieces = [F.substr(p, size * k + 1, size if k < distance else F.length(p)) for k in range(distance + 1)]
        filled = F.filter(F.transform(F.array(*pieces), lambda s, k: F.struct(s.alias("s"), (k * size + 1).alias("at"))), lambda q: q["s"] != "")
        # A phrase that short may lose all its letters: nothing can be left out.
        filled = F.when(F.length(p) <= distance, F.array(F.struct(F.lit("").alias("s"), F.lit(1).alias("at")))).otherwise(filled)
        return (p != "") & (F.contains(h, p) | (token_overlap(p, h) >= ratio) | let(F.struct(p.alias("p"), h.alias("h"), F.filter(filled, lambda q: F.contains(h, q["s"])).alias("q")), near))

    def near(x: Column) -> Column:
        p, n = x["p"], F.size(F.split(x["p"], " "))
        words = F.split(x["h"], " ")

        def close(w: Column) -> Column:
            around = lambda q: F.contains(F.substr(w, F.greatest(q["at"] - distance, F.lit(1)), F.length(q["s"]) + 2 * distance), q["s"])
            return (F.abs(F.length(w) - F.length(p)) <= F.least(F.lit(slack), F.lit(distance))) & F.exists(x["q"], around) & (F.levenshtein(w, p, distance) >= 0)

        windows = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return (F.size(x["q"]) > 0) & F.exists(windows, lambda i: let(F.array_join(F.slice(words, i, n), " "), close))

    return let(F.struct(normalize_phrase(phrase).alias("p"), normalize_phrase(text).alias("h")), look)


def description_key(s: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.upper(F.coalesce(col(s), F.lit(""))), "[^A-Z0-9]", ""), 1, 12)


def mask_account(s: Column | str) -> Column:
    """The last four digits of the first run of 7 to 22 digits, spaces and hyphens, behind four stars."""
    run = found(col(s), r"\d[\d -]{5,20}\d")
    return F.concat(F.lit("****"), F.right(F.regexp_replace(run, r"\D", ""), F.lit(4)))


def is_date_like(s: Column | str) -> Column:
    """Three numbers, or a day, a month's name and a year."""
    return F.coalesce(trimmed(col(s)).rlike(r"^(\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d{1,2}[ -][A-Za-z]{3,9}[ ,-]+\d{2,4})$"), F.lit(False))


def is_amount_like(s: Column | str) -> Column:
    """Text that parse_amount can read. Four letters in a row, a slash or a colon are in none that it can, plain digits with groups or a point in every one; the rest is read."""
    c = col(s)
    return F.when(~c.rlike(r"\d") | c.rlike("[A-Za-z]{4}|[/:]"), False).when(c.rlike(r"^(?:\d{1,3}(?:,\d{3}){0,3}|\d{1,12})(?:\.\d{1,3})?$"), True).otherwise(F.coalesce(trimmed(c) != "", F.lit(False)) & parse_amount(c).isNotNull())


def is_currency_code_like(s: Column | str) -> Column:
    return F.coalesce(trimmed(col(s)).rlike("^[A-Z]{3}$"), F.lit(False))


def currency_code_of(s: Column | str) -> Column:
    return F.upper(found(trimmed(col(s)), r"^([A-Za-z]{3})(?![A-Za-z])", 1))


def is_known_currency(s: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(col(s), F.lit("")))).isin(*ISO_CURRENCIES)


def looks_like_transaction(line: Column | str) -> Column:
    """A date-shaped token, and another digit elsewhere."""
    date = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d{1,2}[/-]\d{1,2}|\d{1,2} (?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    at = F.regexp_extract(col(line), date, 0)
    return F.coalesce((at != "") & F.regexp_replace(col(line), f"^(.*?)(?:{date})", "$1").rlike(r"\d"), F.lit(False))


def slugify(s: Column | str) -> Column:
    return F.coalesce(blank_as_null(F.regexp_replace(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", "_"), "^_+|_+$", "")), F.lit("field"))


def humanize_extra(s: Column | str) -> Column:
    return F.initcap(F.replace(F.regexp_replace(col(s), "^extra_", ""), F.lit("_"), F.lit(" ")))


def statement_type_label(s: Column | str) -> Column:
    return F.initcap(F.replace(col(s), F.lit("_"), F.lit(" ")))


def account_label(given: Column, bank: Column, kind: Column, name: Column, masked: Column) -> Column:
    """The label given, else bank and type, else the name; behind it the masked number."""
    base = F.coalesce(blank_as_null(given), blank_as_null(F.concat_ws(" ", blank_as_null(bank), blank_as_null(statement_type_label(kind)))), name)
    return F.concat_ws(" ", base, masked)


def filename_signature(name: Column | str, bank: Column | str) -> Column:
    """A pattern from a file name: its tokens that name the bank, else those without digits that are no months; empty without an extension."""
    stem = F.regexp_extract(F.lower(col(name)), r"^(.*)\.[a-z0-9]+$", 1)
    own = F.filter(tokens(stem), lambda x: ~x.rlike(r"\d|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*$"))
    of_bank = F.array_intersect(own, tokens(F.lower(col(bank))))
    return F.when(stem == "", "").otherwise(F.array_join(F.when(F.size(of_bank) > 0, of_bank).otherwise(own), ".*"))


def ocr_currency(s: Column | str) -> Column:
    """Three letters read as digits made letters again; null unless three letters result."""
    return let(F.translate(F.upper(trimmed(col(s))), "01568", "OISGB"), lambda x: F.when(x.rlike("^[A-Z]{3}$"), x))


# Fixed value: a field's label at a line's end, a letter and up to 23 letters, digits, points and hyphens before a colon.
FIELD_LABEL = r"(?:^|\s)\p{L}[\p{L}\p{N}.\-]{0,23}:$"


def strip_field_label(s: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(s), FIELD_LABEL, ""))


def mask_amounts(s: Column | str) -> Column:
    """Digits of numbers with two decimals as #."""
    number = r"(?<![\d.,])\d[\d.,]*[.,]\d{2}(?![\d])"
    return let(col(s), lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(number), F.lit(0))), x, lambda acc, m: F.replace(acc, m, F.regexp_replace(m, r"\d", "#"))))


def mask_digit_runs(s: Column | str, least: int = 6) -> Column:
    """Each digit in a run of six or more as #."""
    inside = "|".join(rf"(?<=\d{{{i}}})\d(?=\d{{{least - 1 - i}}})" for i in range(least))
    return F.regexp_replace(col(s), inside, "#")


def redact(key: Column, value: Column, allowed: tuple[str, ...]) -> Column:
    """Values of allowed keys masked, others replaced by their length."""
    return F.when(key.isin(*allowed), mask_digit_runs(mask_amounts(value))).otherwise(F.format_string("<text %d chars>", F.length(value)))


# --- amount lines and currencies -------------------------------------------

# What ends an amount line: a currency, sign and parenthesis before the number; a parenthesis, sign, code and mark behind it.
_BEFORE = r"(?:(?<![A-Za-z0-9])(?:[A-Za-z]{3}|(?:S|US|HK|A)?\$|[€£¥])\s*)?[+-]?\s*\(?\s*[+-]?"
_BEHIND = r"\s*\)?\s*[+-]?\s*(?:[A-Za-z]{3})?\s*(?:\b(?i:CR|DR|C|D)\.?)?\s*"
_ENDING = rf"(?s)^.*?({_BEFORE})(\d[\d.,\u00a0 ]*\d|\d)({_BEHIND})$"
# What makes a line no transaction. Page footers; summary phrases; two years; a month's or a year's banner; a date alone.
PAGE_FOOTER = r"(?i)\bpage\s*[\dIlO]+\s*(?:of|/|0f)\s*[\dIlO.,]+"
SUMMARY_PHRASES = ("transactions as of", "available balance", "ledger balance", "current balance", "available credit limit", "reward points")
SUMMARY_STARTS = r"^(?:(?:sub)?total\b|ref(?:erence)?[:\s])"
TWO_YEARS = r"\b(?:19|20)\d\d\b.*\b(?:19|20)\d\d\b"
BANNER = r"^(?:[A-Za-z]{3,}\s+)?(?:19|20)\d\d$"
DATE_GROUP = r"(?i)^(?:(?:[a-z]+day|yesterday|today),?\s*)?(\d{1,2}\s*[a-z]{3,}\s+\d{4})$"
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_CUT = "\u0001"


def no_transaction(line: Column | str) -> Column:
    """Whether a line's wording or shape rules out an amount line, whatever number ends it."""
    t = trimmed(col(line))
    return _ruled_out(t, F.lower(t))


def _ruled_out(t: Column, low: Column) -> Column:
    """The same of a trimmed line and its small letters."""
    out = (F.contains(low, F.lit("page")) & t.rlike(PAGE_FOOTER)) | t.rlike(TWO_YEARS) | t.rlike(BANNER) | t.rlike(DATE_GROUP) | low.rlike(SUMMARY_STARTS)
    for phrase in SUMMARY_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


# What is read of an amount line, step by step; each step uses the one before several times.


def _cut(s: Column) -> Column:
    """What stands before, in and behind the last number of a line that can end in one."""
    ends = s.rlike(r"\d[\s)+\-A-Za-z.]*$") & ~s.contains(_CUT)
    return F.when(ends, F.split(F.regexp_replace(s, _ENDING, f"$1{_CUT}$2{_CUT}$3"), _CUT))


def _own_code(before: Column) -> Column:
    return F.upper(F.regexp_extract(before, r"^[A-Za-z]{3}", 0))


def _code_behind(behind: Column) -> Column:
    return F.upper(F.regexp_extract(behind, r"^\s*\)?\s*[+-]?\s*([A-Za-z]{3})", 1))


def _crdr(behind: Column) -> Column:
    return F.upper(F.regexp_extract(behind, r"(?i)\b(C|D)R?\.?\s*$", 1))


def _has_cents(number: Column) -> Column:
    return number.rlike(r"[.,]\d{2}$")


def _may_be_amount(before: Column, number: Column, behind: Column, own: Column, after: Column, cents: Column) -> Column:
    decorated = cents | before.rlike(r"(?U)\S") | behind.rlike(r"[^\s)]")
    return (decorated | F.length(F.translate(number, "., \u00a0", "")).between(2, 8)) & ~own.isin(*_MONTHS) & ~after.isin(*_MONTHS)


def _amount_told(s: Column, before: Column, number: Column, behind: Column, own: Column, after: Column, cents: Column, size: Column) -> Column:
    negative = before.contains("-") | behind.contains("-") | (before.contains("(") & behind.contains(")"))
    start = F.length(s) - F.length(before) - F.length(number) - F.length(behind)
    code = F.coalesce(blank_as_null(own), blank_as_null(after))
    return F.struct(F.when(negative, -size).otherwise(size).alias("minor"), code.alias("currency"), cents.alias("decimals"), blank_as_null(_crdr(behind)).alias("mark"), start.alias("start"))


def amount_line(line: Column | str) -> Column:
    """struct(minor, currency, decimals, mark, start) of the amount that ends a line, null without one.

    Rejected: what `no_transaction` holds; a month's name as currency; more
    than eight digits, or a single one, without any decoration. A line is split
    once into what stands before, in and behind its last number, and only if it
    can end in one. One expression, for use anywhere; over many rows
    `with_amount_lines` does the same faster.
    """

    def read(s: Column) -> Column:
        return let(F.struct(s.alias("s"), _cut(s).alias("p")), lambda x: F.when(F.size(x["p"]) == 3, parts(x["s"], x["p"])))

    def parts(s: Column, p: Column) -> Column:
        before, number, behind = p[0], p[1], p[2]
        own, after, cents = _own_code(before), _code_behind(behind), _has_cents(number)
        ok = _may_be_amount(before, number, behind, own, after, cents) & ~_ruled_out(s, F.lower(s))
        return F.when(ok, let(plain_minor(number), lambda v: F.when(v.isNotNull(), _amount_told(s, before, number, behind, own, after, cents, v))))

    return let(trimmed(col(line)), read)


def with_amount_lines(df: DataFrame, line: Column | str, name: str = "_amount") -> DataFrame:
    """The rows with a further column `name` = amount_line(line), in stages of plain columns, which Spark compiles as a whole.

    The column is `computed`, so conditions on it don't read every line again.
    """
    at = lambda k: F.col(f"_line_{k}")
    put = lambda d, **made: d.withColumns({f"_line_{k}": c for k, c in made.items()})
    some = at("number").isNotNull()
    out = put(put(df, s=trimmed(col(line))), p=_cut(at("s")))
    out = put(out, **{k: F.when(F.size(at("p")) == 3, at("p")[i]) for i, k in enumerate(("before", "number", "behind"))})
    out = put(out, low=F.when(some, F.lower(at("s"))), own=_own_code(at("before")), after=_code_behind(at("behind")), cents=_has_cents(at("number")), digits=plain_digits(at("number")))
    rest = [at(k) for k in ("before", "number", "behind", "own", "after", "cents")]
    out = put(out, size=F.when(some & _may_be_amount(*rest) & ~_ruled_out(at("s"), at("low")), minor_of_digits(at("digits"))))
    told = F.when(at("size").isNotNull(), _amount_told(at("s"), *rest, at("size")))
    return computed(out, *df.columns, **{name: told})


def grouped_sign(amount: Column, convention: str) -> Column:
    """The signed amount of an amount line: the mark decides, else the sign (turned under positiveIsOut)."""
    minor, mark = amount["minor"], amount["mark"]
    kept = -minor if convention == "positiveIsOut" else minor
    return F.when(mark == "C", F.abs(minor)).when(mark == "D", -F.abs(minor)).otherwise(kept)


def detect_currency(value: Column, header: Column, row_text: Column, default: Column) -> Column:
    """struct(code, unknown): the column's value, the header's hint, a symbol or first capital word of the row, the default.

    Three letters that are no ISO code are never the currency; the column's are
    reported as unknown.
    """
    code = lambda c: F.when(F.upper(F.trim(c)).rlike("^[A-Z]{3}$") & is_known_currency(c), F.upper(F.trim(c)))
    symbol = F.lit(None).cast("string")
    for s, c in (("¥", "JPY"), ("£", "GBP"), ("€", "EUR"), ("A$", "AUD"), ("S$", "SGD"), ("US$", "USD"), ("HK$", "HKD")):
        symbol = F.when(row_text.contains(s), F.lit(c)).otherwise(symbol)
    word = code(F.regexp_extract(row_text, r"\b([A-Z]{3})\b", 1))
    unknown = F.when(F.upper(F.trim(value)).rlike("^[A-Z]{3}$") & ~is_known_currency(value), F.upper(F.trim(value)))
    return F.struct(F.coalesce(code(value), code(header), symbol, word, code(default)).alias("code"), unknown.alias("unknown"))


def strip_filenames(s: Column | str, names: dict[str, str]) -> Column:
    """Known names as their labels; any other token with a file's extension as <file>."""
    out = col(s)
    for name in sorted(names, key=len, reverse=True):
        out = F.replace(out, F.lit(name), F.lit(names[name]))
    return F.regexp_replace(out, r"(?i)[^\s/\\\"']+\.(csv|tsv|txt|pdf|xlsx?|json)\b", "<file>")


def redact_stack(s: Column | str) -> Column:
    """Stack lines without addresses and positions in code."""
    return F.array_join(F.transform(F.split(col(s), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\w+://[^\s)]+", "<code>"), r":\d+(:\d+)?", "")), "\n")


# --- hints from a statement's text -----------------------------------------


def first_name(s: Column | str, filename: Column | str, names: list[str]) -> Column:
    """The first of the known names that stands as words in the text, or in the file name without its punctuation; else a phrase that ends in Bank."""
    body = F.concat_ws(" ", F.lower(col(s)), F.regexp_replace(F.lower(col(filename)), "[^a-z0-9]+", " "))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    flat = pad(F.regexp_replace(body, "[^a-z0-9]+", " "))
    plain = lambda name: re.sub("[^a-z0-9]+", " ", name.lower()).strip()
    # The flat text is made once and looked through for each name.
    named = let(flat, lambda f: F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(f, F.lit(f" {plain(name)} ")), F.lit(name)) for name in names]))
    return F.coalesce(named, found(col(s), r"\b((?:[A-Z][A-Za-z]+ ){1,3}Bank)\b", 1))


def statement_type(s: Column | str) -> Column:
    """credit_card by its marks, then current_account, else empty."""
    low = F.lower(col(s))
    return F.when(low.rlike(r"credit card|card number|minimum payment|credit limit"), "credit_card").when(low.rlike(r"current account|chequing|checking account"), "current_account").otherwise("")


def currency_in_text(s: Column | str, codes: tuple[str, ...]) -> Column:
    """A symbol's currency, else the first of the codes that stands in the text."""
    out = F.lit(None).cast("string")
    for c in reversed(codes):
        out = F.when(col(s).rlike(rf"\b{c}\b"), F.lit(c)).otherwise(out)
    for sign, c in (("¥", "JPY"), ("£", "GBP"), ("€", "EUR"), (r"A\$", "AUD"), (r"S\$", "SGD"), (r"US\$", "USD"), (r"HK\$", "HKD")):
        out = F.when(col(s).rlike(sign if "$" not in sign else rf"(?<![A-Z]){sign}"), F.lit(c)).otherwise(out)
    return out


def both_directions(source: Column, target: Column, rate: Column) -> Column:
    """A rate and its inverse, to four places, as text; the inverse of 0 is 0."""
    from tallyforge.functions.amounts import round4

    plain = lambda x: F.regexp_replace(F.format_number(x, 4), r",|\.?0+$", "")
    inverse = round4(F.when(rate != 0, 1 / rate).otherwise(0.0))
    return F.concat(F.lit("1 "), source, F.lit(" = "), plain(rate), F.lit(" "), target, F.lit(" (1 "), target, F.lit(" = "), plain(inverse), F.lit(" "), source, F.lit(")"))


# A number whose comma is decimal, and one whose point may be.
COMMA_DECIMAL, POINT_DECIMAL = r"^([\d.\s]*\d),(\d{1,2})$", r"^([\d,]+)(?:\.(\d{1,3}))?$"


def grouped_number(raw: Column | str) -> Column:
    """A run of digits and separators as plain text, or null: a comma before one or two final digits is decimal, else a point before one to three is."""
    c = F.regexp_replace(col(raw), "\u00a0", " ")
    euro, us = COMMA_DECIMAL, POINT_DECIMAL
    whole = F.concat(F.regexp_replace(F.regexp_extract(c, euro, 1), r"[.\s]", ""), F.lit("."), F.regexp_extract(c, euro, 2))
    cents = F.regexp_extract(c, us, 2)
    return F.when(c.rlike(euro), whole).when(c.rlike(us), F.concat(F.replace(F.regexp_extract(c, us, 1), F.lit(","), F.lit("")), F.when(cents != "", F.concat(F.lit("."), cents)).otherwise("")))


def with_cents(digits: Column | str) -> Column:
    return F.when(F.contains(col(digits), F.lit(".")), col(digits)).otherwise(F.concat(col(digits), F.lit(".00")))


def bank_hint(s: Column | str, banks: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first of the marks (mark, name) that a text holds, or null."""
    out = F.lit(None).cast("string")
    for mark, name in reversed(banks):
        out = F.when(F.contains(F.lower(col(s)), F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def bank_of_filename(name: Column | str) -> Column:
    """The first run of letters of a file's name without its extension, with a capital; else My bank."""
    word = F.regexp_extract(F.regexp_replace(col(name), r"\.[^.]+$", ""), "[A-Za-z]+", 0)
    return F.when(word == "", "My bank").otherwise(F.initcap(word))


def year_hint(s: Column | str) -> Column:
    """The first year from 1900 to 2099 in a text, or null."""
    return F.regexp_extract(col(s), r"\b(20\d{2}|19\d{2})\b", 1).try_cast("int")


def humanize_pattern(pattern: Column | str) -> Column:
    """A saved name pattern as people write it: * for anything."""
    return F.replace(F.replace(F.regexp_replace(col(pattern), r"^\^|\$$", ""), F.lit("\\."), F.lit(".")), F.lit(".*"), F.lit("*"))


def redact_entries(values: Column, allowed: tuple[str, ...]) -> Column:
    """A map of key to text, each value redacted by its key."""
    return F.transform_values(values, lambda k, v: redact(k, v, allowed))
