"""Many known names in whole texts: one pass over each text, through a tree of the names' words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.bounds import dealt, fits

#: Names that are sent to all tasks at most; more are an error.
MOST = 200_000
#: Bytes of text that are looked through before places are handed on.
_SLICE = 4 << 20
_WORD = re.compile(r"\w+")
_END = ""


def tree_of(names: list[str]) -> dict:
    """Words to what may follow them; at _END the names, as they are to be told, that end there, with what stands between their words."""
    root: dict = {}
    for name in sorted(set(names)):
        low = name.lower()
        words = _WORD.findall(low)
        if not words:
            continue
        at = root
        for word in words:
            at = at.setdefault(word, {})
        at.setdefault(_END, []).append((name, low))
    return root


def places(text: str, root: dict) -> list[tuple[str, int, int]]:
    """Name, first and behind-last character of every occurrence, overlapping ones too. Names stand at word boundaries, with their own signs between the words, apart from case."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer: compare letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
    found = []
    for i, (word, start, _) in enumerate(words):
        at, j = root.get(word), i
        while at is not None:
            for name, spelt in at.get(_END, ()):
                begin = start - (len(spelt) - len(spelt.lstrip(_signs(spelt))))
                if low.startswith(spelt, begin) and begin >= 0:
                    found.append((name, begin, begin + len(spelt)))
            j += 1
            at = at.get(words[j][0]) if j < len(words) else None
    return found


def _signs(spelt: str) -> str:
    """The signs before a name's first word."""
    return spelt[: _WORD.search(spelt).start()]


def _looked_through(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, told_of: Callable[[str, dict], list[tuple]], columns: tuple[tuple[str, pa.DataType], ...]) -> DataFrame:
    """The id and the columns of what `told_of` says of each text that isn't null or empty and the tree of names."""
    known = names.select(F.col(name_col).alias("name")).filter("name IS NOT NULL").distinct()
    if not fits(known, MOST):
        raise ValueError(f"more than {MOST} names")
    shared = texts.sparkSession.sparkContext.broadcast([r.name for r in known.collect()])
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = tree_of(shared.value)
        for batch in batches:
            step = max(1, batch.num_rows * _SLICE // max(1, batch.column(1).nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [(i, *p) for i, t in enumerate(part.column(1).to_pylist()) if t for p in told_of(t, root)]
                which, *told = zip(*rows, strict=True) if rows else ((), *[()] * len(columns))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, k) for c, (_, k) in zip(told, columns, strict=True)]], names=["id", *(n for n, _ in columns)])

    return texts.select(id_col, text_col).mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} {_SQL[k]}" for n, k in columns)])).withColumnRenamed("id", id_col)


_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}


def find_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """Every place of every known name in every whole text: the id, name, start, stop (characters from 0).

    Null texts and names, and names without a word, are found nowhere. Names
    that agree but for case are told apart and each is found. The tree of names
    is built once a task; up to MOST names are sent to the tasks.
    """
    return _looked_through(texts, names, id_col, text_col, name_col, places, (("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32())))


def count_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """How many places each known name has in each whole text: the id, name, n; as `find_names`, but a text's places are counted where it is read."""
    counted = lambda t, root: list(Counter(p[0] for p in places(t, root)).items())
    return _looked_through(texts, names, id_col, text_col, name_col, counted, (("name", pa.string()), ("n", pa.int64())))


def sum_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """For each id with a known name in its texts: the id, n_places, n_names (different ones) and least (the first by the alphabet)."""
    found = dealt(count_names(texts, names, id_col, text_col, name_col), id_col, texts.count(), 2_000)
    return found.groupBy(id_col).agg(F.sum("n").alias("n_places"), F.countDistinct("name").alias("n_names"), F.min("name").alias("least"))


def first_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", order_col: str = "ord") -> DataFrame:
    """For each text the known name with the least order that stands in it, null without any: the id, name. `names` has name and its order."""
    found = find_names(texts, names, id_col, text_col).select(id_col, "name").distinct()
    best = found.join(names.select("name", F.col(order_col).alias("_o")), "name").groupBy(id_col).agg(F.min_by("name", F.struct("_o", "name")).alias("name"))
    return texts.select(id_col).join(best, id_col, "left")
