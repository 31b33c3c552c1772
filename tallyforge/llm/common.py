"""Helpers shared by the corpus operators.

Conventions that hold for every operator in this package:

* It selects the columns it names and works on private copies of them, so
  extra columns, whatever their names, never reach its joins.
* A null text counts as the text that the operator's docstring states (the
  empty text unless it says otherwise); a null id is an ordinary value and its
  row is kept.
* Rows that agree in id and text are the same document: each gets the same
  answer. Rows that agree in the id alone are told apart by their text.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the query contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes at a time out of an Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the tables in a folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallyforge-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tallyforge-{uuid.uuid4().hex}/{name}"


def row_key(id_col: str | Column, text: Column) -> Column:
    """A long for joining a document's parts back to it: repeated ids with other texts get other keys."""
    return F.xxhash64(F.col(id_col) if isinstance(id_col, str) else id_col, text)


@lru_cache(1)
def _trim():
    """The C library's call that gives freed memory back to the system; nothing where it has none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidy() -> None:
    """Give back what a finished task has freed: workers live on, and what they keep is the next stage's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends here, and lost executors cost no recomputation. Gives back what the driver has freed so far."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    tidy()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece holds about `limit` bytes in the given string or binary column, or a single row; memory is tidied up behind the last."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))
    tidy()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
