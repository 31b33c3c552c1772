"""Large delimited files against csv.reader, cut at every place."""

import csv
import io
import random

import pytest

from tallyforge.sources import files
from tallyforge.sources.large import ends_inside, file_lines, parse_large


def by_library(text, delimiter):
    return list(csv.reader(io.StringIO(files.trim_lines(text, delimiter)), delimiter=delimiter))


def noise(rng, n, delimiter):
    """Quoted cells with line feeds, delimiters and doubled quotes, stray quotes in plain cells, text behind a closing quote, blank lines, padding."""
    cell = lambda: rng.choice(["plain", "", "4.50", '5" disk', '"quoted"', '"two\nlines"', f'"with {delimiter} inside"', '"say ""hi"" now"', '"open\n\n  padded  \n""\n"', '"closed" late', "é 𝄞", '""', '"a\r\nb"', "'"])
    lines = [delimiter.join(cell() for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return "".join(line + rng.choice(["\n", "\n", "\r\n", "\n\n", "  \n", "\r"]) for line in lines)


@pytest.mark.parametrize("seed,delimiter,split", [(1, ",", 700), (2, ";", 300), (3, "\t", 4000), (4, ",", 64)])
def test_equal_to_the_library(spark, tmp_path, monkeypatch, seed, delimiter, split):
    rng = random.Random(seed)
    texts = {f"f{i}.csv": noise(rng, n, delimiter) for i, n in enumerate((0, 1, 40, 150))}
    texts["unclosed.csv"] = f'a{delimiter}b\n1{delimiter}"never\nclosed{delimiter} x\n' * 3
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    monkeypatch.setattr("tallyforge.sources.large.PIECE_LINES", 8)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {}
        for r in parse_large(file_lines(spark, str(tmp_path)), delimiter).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.row] = r.cells
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in texts.items():
        assert [c for _, c in sorted(got.get(name, {}).items())] == by_library(text, delimiter), name
        assert sorted(got.get(name, {})) == list(range(len(got.get(name, {}))))


def test_a_line_maps_one_bit():
    for line, out, into in (("a,b", False, True), ('a,"b', True, False), ('"a""b"', False, False), ('b",c', False, False), ('5" x,y', False, False), ('x","y', True, True), ('"a" b"', False, False), ('"', True, False), ("", False, True)):
        assert (ends_inside(line, ",", False), ends_inside(line, ",", True)) == (out, into), line
