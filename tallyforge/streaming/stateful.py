"""Duplicates across arrivals as keyed state: what a fingerprint's files hold is kept by key, and expires by itself.

Two queries, each restartable. The first, keyed by row, remembers which
fingerprint a row had last and tells when it moves. The second, keyed by
fingerprint, remembers the rows of each file and decides which file keeps them;
only rows whose decision is new or changes are told again. Nothing is rewritten
and no other key is read, so an arrival costs what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.ledger import fingerprint

DAYS = 30
_MOVES = "fp string, row_id long, file int, ocr boolean, gone boolean"
_DECISIONS = "row_id long, file int, kept boolean, at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LastFingerprint(StatefulProcessor):
    """By row: the fingerprint it had last. A row that changes it is told as gone from the old one."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fp string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        new = pd.concat(list(rows)).sort_values(["fp", "file"]).iloc[-1]
        out = [(new.fp, key[0], new.file, new.ocr, False)]
        if self.last.exists():
            old = self.last.get()[0]
            if old != new.fp:
                out.insert(0, (old, key[0], new.file, new.ocr, True))
        self.last.update((new.fp,))
        yield pd.DataFrame(out, columns=["fp", "row_id", "file", "ocr", "gone"])

    def close(self) -> None:
        pass


class Keeper(StatefulProcessor):
    """By fingerprint: the rows of each file. The file with the most rows keeps them; ties go to text over recognised files, then to the first file."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "row_id long", "file int, ocr boolean, kept boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        held = {k[0]: (v[0], v[1], v[2]) for k, v in self.rows.iterator()}
        came = {}
        for part in rows:
            for row_id, file, ocr, gone in zip(part.row_id, part.file, part.ocr, part.gone, strict=True):
                # A row that left and came back in one arrival is here.
                if not gone or row_id not in came:
                    came[int(row_id)] = None if gone else (int(file), bool(ocr))
        now = {i: v[:2] for i, v in held.items()} | came
        now = {i: v for i, v in now.items() if v is not None}
        count: dict = {}
        for file, ocr in now.values():
            n, any_ocr = count.get(file, (0, False))
            count[file] = n + 1, any_ocr or ocr
        winner = min(count, key=lambda f: (-count[f][0], count[f][1], f), default=None)
        for i in held.keys() - now.keys():
            self.rows.removeKey((i,))
        out = []
        for i, (file, ocr) in now.items():
            kept = key[0].startswith("row ") or file == winner
            if held.get(i) != (file, ocr, kept) or i in came:
                self.rows.updateValue((i,), (file, ocr, kept))
                out.append((i, file, kept, timerValues.getCurrentProcessingTimeInMs()))
        yield pd.DataFrame(out, columns=["row_id", "file", "kept", "at"])

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession):
    """Keyed state lives in RocksDB, whatever the session's other queries use."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def _append(stream: DataFrame, path: str, state: str) -> None:
    """One batch of all that is new; state with timers would go on with empty batches otherwise."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(once=True).start().awaitTermination()


def decide_arrivals(rows: DataFrame, folder: str, days: float = DAYS) -> DataFrame:
    """Take in what is new in a stream of rows (row_id, file, and what a fingerprint needs; `ocr` where there is one); gives each row's decision as it stands: row_id, file, kept.

    As if all rows of the last `days` had come at once: a late file displaces
    earlier rows, a row that is sent again replaces what it was. What was kept
    for a key expires that long after its last change. Rows without a date have
    no fingerprint and stay. A restart goes on behind the last arrival that was
    taken in whole; one that is run again changes nothing.
    """
    spark, ttl = rows.sparkSession, int(days * 86_400_000)
    ocr = F.col("ocr") if "ocr" in rows.columns else F.lit(False)
    told = rows.select(F.col("row_id").cast("long").alias("row_id"), F.coalesce(fingerprint(), F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("fp"), F.col("file").cast("int").alias("file"), ocr.alias("ocr"))
    with _keyed_state(spark):
        moves = told.groupBy("row_id").transformWithStateInPandas(LastFingerprint(ttl), _MOVES, "Append", "ProcessingTime")
        _append(moves, f"{folder}/moves", f"{folder}/moves-state")
        seen = spark.readStream.schema(_MOVES).parquet(f"{folder}/moves")
        decisions = seen.groupBy("fp").transformWithStateInPandas(Keeper(ttl), _DECISIONS, "Append", "ProcessingTime")
        _append(decisions, f"{folder}/decisions", f"{folder}/decisions-state")
    return latest_decisions(spark.read.schema(_DECISIONS).parquet(f"{folder}/decisions"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("row_id").agg(F.max_by(F.struct("file", "kept"), "at").alias("d")).select("row_id", "d.file", "d.kept")
