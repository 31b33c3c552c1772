"""Dates: seven input formats, twelve output formats, and inference from samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.expr import col, let, trimmed

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
# The formats that are read, and those that are written.
INPUT_FORMATS = ("YYYY-MM-DD", "DD MMM YYYY", "DD/MM/YYYY", "MM/DD/YYYY", "DD MMM", "DD/MM", "MM/DD")
OUTPUT_FORMATS = ("YYYY-MM-DD", "DD/MM/YYYY", "MM/DD/YYYY", "DD-MM-YYYY", "D/M/YYYY", "DD MMM YYYY", "MMM D, YYYY", "YYYY/MM/DD", "DD.MM.YYYY", "YYYYMMDD", "sheetsSerial", "isoWithTime")
# For each input format: its pattern, and the groups of year, month and day (0: none).
_READ = {
    "YYYY-MM-DD": (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 1, 2, 3),
    "DD MMM YYYY": (r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ ,-]+(\d{2}|\d{4})$", 3, 2, 1),
    "DD/MM/YYYY": (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$", 3, 2, 1),
    "MM/DD/YYYY": (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$", 3, 1, 2),
    "DD MMM": (r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*$", 0, 2, 1),
    "DD/MM": (r"^(\d{1,2})[/-](\d{1,2})$", 0, 2, 1),
    "MM/DD": (r"^(\d{1,2})[/-](\d{1,2})$", 0, 1, 2),
}


def to_iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a day that exists, else null."""
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd")


def parse_date(raw: Column | str, date_format: str, year: Column | int | None = None) -> Column:
    """Text in one format as ISO text; null on any failure. Two-digit years are of this century; formats without a year need one."""
    pattern, y, m, d = _READ[date_format]
    given = F.lit(year) if year is None or isinstance(year, int) else year

    def read(s: Column) -> Column:
        part = lambda g: F.regexp_extract(s, pattern, g)
        full = F.when(F.length(part(y)) == 2, F.concat(F.lit("20"), part(y))).otherwise(part(y)) if y else given.cast("string")
        name = F.initcap(F.lower(part(m)))
        month = F.when(F.position(name, F.lit(MONTHS)) % 3 == 1, (F.position(name, F.lit(MONTHS)) + 2) / 3) if "MMM" in date_format else part(m)
        return F.when(s.rlike(pattern), to_iso(full.try_cast("int"), month.try_cast("int"), part(d).try_cast("int")))

    return let(trimmed(col(raw)), read)


def is_date(raw: Column | str, date_format: str) -> Column:
    """Whether parse_date reads a day in the text, told from its parts; formats without a year never do."""
    pattern, y, m, d = _READ[date_format]
    if not y:
        return F.lit(False)

    def exists(x: Column) -> Column:
        leap = (x["y"] % 4 == 0) & ((x["y"] % 100 != 0) | (x["y"] % 400 == 0))
        longest = F.when(x["m"] == 2, F.when(leap, 29).otherwise(28)).when(x["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return F.coalesce(x["m"].between(1, 12) & (x["d"] > 0) & (x["d"] <= longest), F.lit(False))

    def read(s: Column) -> Column:
        part = lambda g: F.regexp_extract(s, pattern, g)
        year = F.when(F.length(part(y)) == 2, F.concat(F.lit("20"), part(y))).otherwise(part(y)).try_cast("int")
        month = F.array_position(F.array(*[F.lit(MONTHS[i : i + 3].lower()) for i in range(0, 36, 3)]), F.lower(part(m))).cast("int") if "MMM" in date_format else part(m).try_cast("int")
        return F.when(s.rlike(pattern), let(F.struct(year.alias("y"), month.alias("m"), part(d).try_cast("int").alias("d")), exists)).otherwise(False)

    return F.coalesce(let(trimmed(col(raw)), read), F.lit(False))


def day_month_order(values: Column | str) -> Column:
    """dayFirst, monthFirst or ambiguous, from numeric dates of which a part exceeds 12."""
    pattern = r"^(\d{1,2})[/.-](\d{1,2})[/.-]"
    over = lambda g: F.exists(col(values), lambda x: F.coalesce(F.regexp_extract(x, pattern, g).try_cast("int") > 12, F.lit(False)))
    return F.when(over(1) & ~over(2), "dayFirst").when(over(2) & ~over(1), "monthFirst").otherwise("ambiguous")


def is_day_month_ambiguous(values: Column | str) -> Column:
    """Whether there are numeric dates and none of them has a part above 12."""
    numeric = F.filter(col(values), lambda x: x.rlike(r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s*$"))
    part = lambda x, g: F.regexp_extract(x, r"^\s*(\d{1,2})[/.-](\d{1,2})", g).cast("int")
    return (F.size(numeric) > 0) & F.forall(numeric, lambda x: (part(x, 1) <= 12) & (part(x, 2) <= 12))


def suggest_date_format(values: Column | str) -> Column:
    """The first rule that some sample meets: ISO, day and month name with a year, without, then numeric by the parts above 12; null without any."""
    v = F.filter(col(values), lambda x: x.isNotNull())
    some = lambda p: F.exists(v, lambda x: x.rlike(p))
    numeric = r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s*$"
    return (
        F.when(some(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), "YYYY-MM-DD")
        .when(some(r"^\s*\d{1,2}[ -][A-Za-z]{3,}[ ,-]+\d{2,4}\s*$"), "DD MMM YYYY")
        .when(some(r"^\s*\d{1,2}[ -][A-Za-z]{3,}\s*$"), "DD MMM")
        .when(some(numeric), F.when(day_month_order(v) == "monthFirst", "MM/DD/YYYY").otherwise("DD/MM/YYYY"))
    )


def best_date_format(values: Column | str) -> Column:
    """struct(format, hits, total): the format that reads the most samples, the earliest of equals."""
    v = F.filter(col(values), lambda x: trimmed(F.coalesce(x, F.lit(""))) != "")
    hits = lambda f: F.size(F.filter(v, lambda x: parse_date(x, f, 2000).isNotNull()))
    scored = [F.struct(hits(f).alias("hits"), F.lit(-i).alias("o"), F.lit(f).alias("format")) for i, f in enumerate(INPUT_FORMATS[:5])]
    return let(F.array_max(F.array(*scored)), lambda x: F.struct(x["format"].alias("format"), x["hits"].alias("hits"), F.size(v).alias("total")))


def infer_year(month: Column, day: Column, start: Column | str, end: Column | str) -> Column:
    """The year of a day without one inside a period of ISO dates: the period's if it has one, else the one that falls inside, else by the start's month."""
    s, e = col(start), col(end)
    y0, y1 = F.substring(s, 1, 4), F.substring(e, 1, 4)
    iso = lambda y: F.concat(y, F.format_string("-%02d-%02d", month.cast("int"), day.cast("int")))
    within = lambda y: (iso(y) >= s) & (iso(y) <= e)
    by_month = F.when(month >= F.substring(s, 6, 2).cast("int"), y0).otherwise(y1)
    return F.when(y0 == y1, y0).when(within(y0), y0).when(within(y1), y1).otherwise(by_month).cast("int")


def format_date_out(iso: Column | str, fmt: str = "YYYY-MM-DD") -> Column:
    """ISO text in one of the output formats; an unknown one gives ISO, null the empty text."""
    s = col(iso)
    d = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    patterns = {"DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy", "DD-MM-YYYY": "dd-MM-yyyy", "D/M/YYYY": "d/M/yyyy", "DD MMM YYYY": "dd MMM yyyy", "MMM D, YYYY": "MMM d, yyyy", "YYYY/MM/DD": "yyyy/MM/dd", "DD.MM.YYYY": "dd.MM.yyyy", "YYYYMMDD": "yyyyMMdd"}
    if fmt == "sheetsSerial":
        out = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    elif fmt == "isoWithTime":
        out = F.when(s.contains("T"), s).otherwise(F.substring(s, 1, 10))
    else:
        out = F.date_format(d, patterns.get(fmt, "yyyy-MM-dd"))
    return F.coalesce(out, F.lit(""))


def format_short_date(iso: Column | str, year: bool = True) -> Column:
    return F.date_format(F.try_to_date(col(iso), "yyyy-MM-dd"), "d MMM yyyy" if year else "d MMM")


def preset_range(preset: str, today: Column | str) -> Column:
    """struct(start, end) in ISO text of a named range; both null for all."""
    now = col(today).cast("date") if not isinstance(today, str) else F.lit(today).cast("date")
    first = F.trunc(now, "MM")
    ranges = {
        "thisMonth": (first, F.last_day(now)),
        "lastFullMonth": (F.add_months(first, -1), F.date_sub(first, 1)),
        "last3Months": (F.add_months(first, -3), F.date_sub(first, 1)),
        "ytd": (F.trunc(now, "YYYY"), now),
        "all": (F.lit(None), F.lit(None)),
    }
    if preset not in ranges:
        raise ValueError(f"no such range: {preset}")
    return F.struct(*(x.cast("string").alias(n) for x, n in zip(ranges[preset], ("start", "end"), strict=True)))
