"""One delimited file over many tasks: which line feeds end a record is folded over the file's lines.

Spark's text reader splits a file anywhere. Whether a line begins inside a
quoted cell depends on everything before it, but only through one bit. Each
line maps that bit to the bit behind it: it keeps it, sets it, or turns it. So
the bit at a line is that of the last line that set it, turned by the lines
since; both fold piece by piece (`operators.ordered`), without moving the lines.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ordered import PIECE, POS, running

#: Lines in a piece: as many as follow one another in a split and are handled together.
PIECE_LINES = 4096
_CLOSES = re.compile(r'(?:[^"]|"")*"(?!")')


def file_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The lines of the files at a path, in place: file, line, and their order. A carriage return ends a line too; padding and blank lines go later."""
    read = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    split = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value").withColumn("_n", F.monotonically_increasing_id())
    each = split.select("file", "_block", "_n", F.posexplode(F.split("value", "\r")).alias("_sub", "line"))
    return each.select("file", "line", F.struct("_block", "_n", "_sub").alias(POS), F.struct("_block", F.expr(f"_n DIV {PIECE_LINES}").alias("_n")).alias(PIECE))


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind a line. A quote opens a cell at its beginning alone; behind the closing one anything is text up to the delimiter."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSES.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(delimiter, at) + len(delimiter)
        if at < len(delimiter):
            return False


def _steps(delimiter: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(False, True) if '"' not in x else (ends_inside(x, delimiter, False), ends_inside(x, delimiter, True)) for x in batch.column(1).to_pylist()]
            out, into = (pa.array([t[i] for t in told], pa.bool_()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, out, into], names=[*batch.schema.names, "_from_out", "_from_in"])

    return run


def _records(delimiter: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            cells = [next(csv.reader(io.StringIO(x), delimiter=delimiter), []) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], names=["file", "row", "cells"])

    return run


def parse_large(lines: DataFrame, delimiter: str) -> DataFrame:
    """Records of delimited files (of `file_lines`): file, row (from 0) and cells, as `files.parse_grid` gives them for a whole text.

    A cell may hold line feeds, delimiters and doubled quotes; lines lose their
    padding and blank ones go, also inside cells. A quote that is never closed
    makes the rest of its file one cell. An empty file has no records.
    """
    pad = " " if delimiter == "\t" else " \t"
    trimmed = F.rtrim(F.ltrim(F.regexp_replace("line", "^\ufeff", ""), F.lit(" \t")), F.lit(pad))
    plain = lines.select("file", trimmed.alias("line"), POS, PIECE).filter("line != ''")
    position, piece = plain.schema[POS].dataType.simpleString(), plain.schema[PIECE].dataType.simpleString()
    stepped = plain.mapInArrow(_steps(delimiter), f"file string, line string, {POS} {position}, {PIECE} {piece}, _from_out boolean, _from_in boolean")
    turns = (F.col("_from_out") & ~F.col("_from_in")).cast("int")
    told = running(stepped, ["file"], _turned=("sum", turns, True))
    sets = F.when(F.col("_from_out") == F.col("_from_in"), F.struct(F.col("_from_out").alias("to"), "_turned"))
    told = running(told.withColumn("_turns", turns), ["file"], _set=("last", sets, False))
    # Open before this line: what was last set, turned since.
    since = F.col("_turned") - F.col("_turns") - F.coalesce("_set._turned", F.lit(0))
    told = told.withColumn("_open", F.coalesce("_set.to", F.lit(False)) != (since % 2 == 1))
    numbered = running(told, ["file"], _record=("sum", (~F.col("_open")).cast("int"), True))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(POS, "line"))), lambda x: x["line"]), "\n")
    records = numbered.groupBy("file", (F.col("_record") - 1).alias("row")).agg(text.alias("text"))
    return records.select("file", "row", "text").mapInArrow(_records(delimiter), "file string, row long, cells array<string>")
