"""Small helpers for building Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times in an expression but compute it once."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """Columns of the rows (`keep`, else all) with further ones that are computed once a row.

    They come out of a generator of one row, so conditions on them stay behind
    it: moved before it, as Spark does with plain columns, they would compute
    everything a second time.
    """
    return df.select(*(keep or ("*",)), F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def trimmed(c: Column) -> Column:
    """Without white space of any Unicode kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
