"""Files as rows: type and encoding sniffing, delimiters, text grids, workbooks and positioned items."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.expr import col, let

MAX_FILE_BYTES = 25 * 1024 * 1024
WARN_FILES, WARN_ROWS = 50, 100_000
CANDIDATES = (",", "\t", ";", "|")
GRID = T.ArrayType(T.ArrayType(T.StringType()))
ITEM = "array<struct<str: string, x: double, y: double, width: double, height: double, confidence: double>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files: path, length, content, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def file_type(content: Column | str) -> Column:
    """pdf, xlsx or text, by the first bytes alone."""
    head = F.hex(F.substring(col(content), 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.rlike("^504B0[357].."), "xlsx").otherwise("text")


def encoding(content: Column | str) -> Column:
    """By byte order mark, else UTF-8 where the bytes are valid, else windows-1252."""
    head = F.hex(F.substring(col(content), 1, 3))
    return F.when(head == "EFBBBF", "utf-8-bom").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(col(content).cast("string")), "utf-8").otherwise("windows-1252")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes as text in the encoding found, without a byte order mark."""
    codecs = {"utf-8-bom": "utf-8-sig", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "windows-1252": "cp1252"}
    return pd.Series([None if c is None else c.decode(codecs.get(n, "utf-8"), "replace").lstrip("﻿") for c, n in zip(content, name, strict=True)])


def admit(files: DataFrame) -> DataFrame:
    """Each file with `rejected`: the reason, or null where it may be read."""
    return files.withColumn("rejected", F.when(F.col("length") > MAX_FILE_BYTES, "too large"))


def too_many(n_files: Column | str, n_rows: Column | str) -> Column:
    """struct(files, rows): a warning for each number that is too large for one batch, else null."""
    return F.struct(F.when(col(n_files) > WARN_FILES, f"more than {WARN_FILES} files").alias("files"), F.when(col(n_rows) > WARN_ROWS, f"more than {WARN_ROWS} rows").alias("rows"))


def lines_of(text: Column | str) -> Column:
    return F.split(col(text), r"\r\n|\r|\n")


def delimiter_hits(line: Column, candidate: str) -> Column:
    """Occurrences; a comma between digits is part of a number."""
    if candidate == ",":
        return F.regexp_count(line, F.lit(",")) - F.regexp_count(line, F.lit(r"(?<=\d),(?=\d)"))
    return F.length(line) - F.length(F.replace(line, F.lit(candidate), F.lit("")))


def delimiter_of(text: Column | str, sample: int = 20) -> Column:
    """The delimiter of a text, told on its own row.

    Over the first 20 lines that aren't blank, each candidate scores by how
    many lines agree on its commonest count above zero, then by lines that have
    it, then by that count; the earlier candidate wins ties; a comma without any.
    """
    lines = F.slice(F.filter(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != ""), 1, sample)

    def score(some: Column) -> Column:
        counted = lambda c: F.filter(F.transform(some, lambda x: delimiter_hits(x, c)), lambda n: n > 0)
        each = [F.struct(counted(c).alias("hits"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(CANDIDATES)]
        mode = lambda h: F.array_max(F.transform(F.array_distinct(h), lambda v: F.struct(F.size(F.filter(h, lambda x: x == v)).alias("n"), v.alias("v"))))
        told = lambda e: let(mode(e["hits"]), lambda m: F.struct((m["n"] / F.size(some) * 1000 + F.size(e["hits"]) * 10 + m["v"]).alias("s"), e["o"].alias("o"), e["c"].alias("c")))
        return F.array_max(F.transform(F.filter(F.array(*each), lambda e: F.size(e["hits"]) > 0), told))["c"]

    return F.coalesce(let(lines, score), F.lit(","))


def detect_delimiter(files: DataFrame, id_col: str = "file_id", text_col: str = "text", sample: int = 20) -> DataFrame:
    """The id column and `delimiter` of each file."""
    return files.select(id_col, delimiter_of(text_col, sample).alias("delimiter"))


def trim_lines(text: str, delimiter: str) -> str:
    """Lines without padding and without blank ones; a tab that parts cells stays at the end of its line."""
    end = " " if delimiter == "\t" else " \t"
    kept = (x.lstrip(" \t").rstrip(end) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return "\n".join(x for x in kept if x)


@F.pandas_udf(GRID)
def parse_grid(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    """Delimited text as rows of cells; quotes are honoured, rows may differ in width."""
    return pd.Series([None if t is None else list(csv.reader(io.StringIO(trim_lines(t, d)), delimiter=d)) for t, d in zip(text, delimiter, strict=True)])



#: Bytes of text that are parsed before their grids are handed on, and what a workbook may grow to.
SLICE_BYTES = 4 << 20
MAX_INFLATED = 8 * MAX_FILE_BYTES


def parse_grids(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """The id column and `grid` of each file, its delimiter told on the way: one pass, nothing exchanged.

    Texts are parsed a few at a time, by their bytes. Files that `admit`
    refuses, and null texts, have a null grid; `large.parse_large` reads files
    of any size.
    """
    kind = files.schema[id_col].dataType.simpleString()

    def grids(texts: pa.Array, delimiters: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(csv.reader(io.StringIO(trim_lines(t, d)), delimiter=d)) for t, d in zip(texts.to_pylist(), delimiters.to_pylist(), strict=True)], pa.list_(pa.list_(pa.string())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(1).nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(0), grids(part.column(1), part.column(2))], names=[id_col, "grid"])

    small = F.when(F.octet_length(text_col) <= MAX_FILE_BYTES, F.col(text_col))
    return files.select(id_col, small.alias("text")).select(id_col, "text", delimiter_of("text").alias("delimiter")).mapInArrow(run, f"`{id_col}` {kind}, grid array<array<string>>")


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """The cells of a workbook's first sheet, or of the one named, as text; none where it is too large, packed or unpacked."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if len(content) > MAX_FILE_BYTES or sum(x.file_size for x in z.infolist()) > MAX_INFLATED:
            return []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(link)]) for s in book.iter(f"{main}sheet")]
        at = next((t for n, t in sheets if n == sheet), sheets[0][1]).lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(at if at.startswith("xl/") else f"xl/{at}")).iter(f"{main}row"):
            cells: list[str] = []
            for c in row.iter(f"{main}c"):
                place = 0
                for ch in c.get("r", ""):
                    if ch.isalpha():
                        place = place * 26 + ord(ch) - 64
                cells += [""] * max(0, place - 1 - len(cells))
                v = c.findtext(f"{main}v") or ""
                cells.append(shared[int(v)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v)
            rows.append(cells)
    return rows


@F.pandas_udf(GRID)
def parse_workbook(content: pd.Series, sheet: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else sheet_rows(c, s) for c, s in zip(content, sheet, strict=True)])


@F.pandas_udf(T.BinaryType())
def write_workbook(rows: pd.Series) -> pd.Series:
    """Rows of texts as the first sheet of a workbook, with an empty second one."""
    from xml.sax.saxutils import escape

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in ((1, "First"), (2, "Second")))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
    out = []
    for grid in rows:
        body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(x or "")}</t></is></c>' for x in row) + "</row>" for row in grid)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
            z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData/></worksheet>")
        out.append(buffer.getvalue())
    return pd.Series(out)


def sheet_names(files: DataFrame) -> DataFrame:
    """path and `sheets`, in workbook order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = []
            for c in pdf.content:
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    names.append([s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}sheet")])
            yield pd.DataFrame({"path": pdf.path, "sheets": names})

    return files.select("path", "content").mapInPandas(run, "path string, sheets array<string>")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned text: JSON lines of file_id, page and items."""
    return spark.read.schema(f"file_id string, page int, items {ITEM}").json(path)


def image_only(items: DataFrame, least: int = 40) -> DataFrame:
    """file_id and whether its text layer is missing: fewer than 40 characters a page."""
    chars = F.aggregate(F.coalesce("items", F.array().cast(ITEM)), F.lit(0), lambda a, x: a + F.length(x["str"]))
    return items.select("file_id", "page", chars.alias("chars")).groupBy("file_id").agg((F.sum("chars") < least * F.countDistinct("page")).alias("image_only"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Saved statement profiles, one JSON document each; built-in ones are left out."""
    df = spark.read.option("multiLine", True).schema("id string, name string, bank string, statementType string, fileType string, builtIn boolean, versions string").json(path)
    return own_profiles(df)


def own_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that people saved themselves."""
    return profiles.filter(~F.coalesce("builtIn", F.lit(False)) & ~F.col("id").startswith("builtin-"))
