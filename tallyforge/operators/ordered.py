"""Rows in a total order, cut into pieces of a bounded size.

A window over a key puts all rows of the key into one task, however many they
are. Here rows are range-partitioned by key and order, written once, and
numbered on the way; a piece is at most SIZE rows that follow one another.
Work inside a piece is grouped by key and piece, so no key is too large for a
task. Between pieces only summaries pass: a row for each key and piece, kept
just for keys that reach over several pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.streaming.folders import shared_folder

#: Place of a row in the order of all rows (unique, with gaps), and the piece it is in (rising with it).
POS, PIECE = "_pos", "_piece"
SIZE = 4096
#: Characters of a text column by which rows are dealt to ranges; inside a range whole texts are compared.
DEALT = 32


def in_pieces(df: DataFrame, keys: list[str], order: list[str], size: int = SIZE) -> DataFrame:
    """The rows with their place and piece, ordered by keys, then order (nulls first), written to the shared folder.

    Rows that agree in all of these follow one another in any order, and in
    the first DEALT characters of texts are in one range.
    """
    kinds = dict(df.dtypes)
    dealt = [F.substring(c, 1, DEALT) if kinds[c] == "string" else F.col(c) for c in [*keys, *order]]
    placed = df.repartitionByRange(*dealt).sortWithinPartitions(*keys, *order).withColumn(POS, F.monotonically_increasing_id())
    placed = placed.withColumn(PIECE, F.expr(f"{POS} DIV {size}"))
    path = f"{shared_folder(df.sparkSession)}/pieces"
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def spans(pieces: DataFrame, keys: list[str], **summaries: Column) -> DataFrame:
    """The summaries by key and piece, for keys that reach over several pieces: about two rows a piece at most."""
    each = pieces.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_rows"), *[s.alias(n) for n, s in summaries.items()])
    return each.withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_pieces > 1")


def beside(pieces: DataFrame, summaries: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The rows with columns of their key's and piece's summary; null for keys that are in one piece."""
    told = summaries.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PIECE).alias("_at"), *columns)
    on = F.col(PIECE) == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return pieces.join(told, on, "left").drop("_at", *[f"_k{i}" for i in range(len(keys))])


def inside(keys: list[str]) -> Window:
    """The window over the rows of a key in a piece, in order."""
    return Window.partitionBy(*keys, PIECE).orderBy(POS)


def earlier(keys: list[str]) -> Window:
    """Over summaries: those of the key's earlier pieces."""
    return Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: list[str]) -> Window:
    """Over summaries: those of the key's later pieces."""
    return Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(1, Window.unboundedFollowing)


def running_sum(pieces: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of a column's values up to each row of its key; null until the first value, as a window sum is."""
    told = spans(pieces, keys, _part=F.sum(value)).withColumn("_before", F.sum("_part").over(earlier(keys)))
    own = F.sum(value).over(inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.when(F.col("_before").isNull(), own).otherwise(F.col("_before") + F.coalesce(own, F.lit(0)))
    return beside(pieces, told, keys, "_before").withColumn(name, whole).drop("_before")


def neighbours(pieces: DataFrame, keys: list[str], columns: list[str], before: str = "_prev", after: str = "_next") -> DataFrame:
    """The rows with structs of the named columns of the row before and the row after in their key; null at its ends."""
    row = F.struct(*columns)
    told = spans(pieces, keys, _first=F.min_by(row, POS), _last=F.max_by(row, POS))
    w = Window.partitionBy(*keys).orderBy(PIECE)
    told = told.withColumns({"_before": F.lag("_last").over(w), "_after": F.lead("_first").over(w)})
    out = beside(pieces, told, keys, "_before", "_after").withColumn("_row", row)
    w = inside(keys)
    return out.withColumns({before: F.coalesce(F.lag("_row").over(w), "_before"), after: F.coalesce(F.lead("_row").over(w), "_after")}).drop("_row", "_before", "_after")


def running(pieces: DataFrame, keys: list[str], **told: tuple[str, Column, bool]) -> DataFrame:
    """The rows with further columns, folded along each key: name = (kind, value, whether the row itself counts).

    Kinds are what merges from piece to piece: `sum` (0 before the first value)
    and `last` (the last value that isn't null). A state machine over lines is
    a set of these: how many lines of a kind came so far, and what the last one
    of a kind was.
    """
    part = {n: F.sum(v) if kind == "sum" else F.max_by(v, F.when(v.isNotNull(), F.col(POS))) for n, (kind, v, _) in told.items()}
    over = earlier(keys)
    carried = spans(pieces, keys, **{f"_part_{n}": p for n, p in part.items()}).withColumns({f"_so_far_{n}": F.sum(f"_part_{n}").over(over) if kind == "sum" else F.last(f"_part_{n}", ignorenulls=True).over(over) for n, (kind, _, _) in told.items()})
    out = beside(pieces, carried, keys, *[f"_so_far_{n}" for n in told])
    new = {}
    for n, (kind, v, itself) in told.items():
        w = inside(keys).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        before = F.col(f"_so_far_{n}")
        new[n] = F.coalesce(before, F.lit(0)) + F.coalesce(F.sum(v).over(w), F.lit(0)) if kind == "sum" else F.coalesce(F.last(v, ignorenulls=True).over(w), before)
    return out.withColumns(new).drop(*[f"_so_far_{n}" for n in told])
