"""Substring dedup by difference-cover anchors.

Any two matching runs of `window` words share an anchor: a hash of
`window - period + 1` words that starts at a cover position in both. Cover
positions are those whose remainder modulo the period lies in a difference
cover, so that for any two starts some offset below the period leads to cover
positions in both. Only about a fifth of all positions are hashed and
exchanged.

An anchor that other documents share names an owner: the document with the
least id that has it. Where anchors that overlap follow one another with one
owner and one distance, the run of words between them equals the owner's, and
its windows are settled. The other windows that hold a shared anchor are
hashed whole and compared by hash, which settles the rest exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1


def difference_cover(period: int) -> list[int]:
    """Residues, found greedily from the densest first, whose differences reach every value modulo the period."""
    perfect = {3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}
    if period in perfect:
        return perfect[period]
    cover, need = [0], set(range(1, period))
    while need:
        best = max(range(period), key=lambda x: (len(need & {(x - c) % period for c in cover} | need & {(c - x) % period for c in cover}), -x))
        need -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) & (1 << 64) - 1)


def rolled(h: np.ndarray, size: int, p: np.uint64) -> np.ndarray:
    """Hashes of all runs of `size` words, by doubling."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, have, power, width, block, factor = None, 0, np.uint64(1), 1, h, p
    while width <= size:
        if size & width:  # put this block before what is there
            n = len(h) - have - width + 1
            out = block[:n].copy() if out is None else block[:n] * power + out[width : width + n]
            have += width
            power = _times(power, factor)
        if width * 2 <= size:
            n = len(block) - width
            block = block[:n] * factor + block[width : width + n]
            factor = _times(factor, factor)
        width *= 2
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class Cover:
    """Where anchors stand in a text of n words."""

    def __init__(self, window: int, period: int):
        if not 1 < period < window:
            raise ValueError("the period must be shorter than the window")
        self.window, self.period, self.size = window, period, window - period + 1
        self.residues = np.zeros(period, bool)
        self.residues[difference_cover(period)] = True

    def positions(self, n: int) -> np.ndarray:
        """Cover positions with room for an anchor, and the last position that has room: it closes a run that ends with the text."""
        room = n - self.size + 1
        if n < self.window:
            return np.empty(0, np.int64)
        at = np.flatnonzero(np.resize(self.residues, room))
        return at if at[-1] == room - 1 else np.append(at, room - 1)


def _anchors(texts: DataFrame, cover: Cover) -> DataFrame:
    """Of id, row and text: a row for each anchor: its hash, the id, the row and the position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            ids, rows = part.column(0).to_numpy(), part.column(1).to_numpy()
            hashes, places, counts = [], [], []
            for text in part.column(2).to_pylist():
                words = (text or "").encode().split()
                at = cover.positions(len(words))
                if len(at):
                    hashes.append(rolled(word_hashes(words), cover.size, _P1)[at])
                    places.append(at)
                counts.append(len(at))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(rows, counts)), pa.array(np.concatenate(places).astype(np.int32))], names=["anchor", "id", "row", "at"])

    return texts.mapInArrow(run, "anchor long, id long, row long, at int")


def _packed(texts: DataFrame) -> DataFrame:
    """Id, row and the compressed text: it travels at half its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([packer.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["id", "row", "packed"])

    return texts.mapInArrow(run, "id long, row long, packed binary")


def _words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


_SETTLED = "id long, row long, n_words long, packed binary, settled array<int>, open array<int>, n_removed long, kept_sha256 string"


def _settle(joined: DataFrame, cover: Cover) -> DataFrame:
    """Of id, row, packed text and its shared anchors: what the owners' runs settle, and the windows they leave open.

    `settled` has begins and ends of word runs that are removed, `open` those
    of runs of windows. A document without open windows is finished here; the
    others carry their text on.
    """

    def one(i: int, packed: bytes, places: list) -> tuple:
        words = _words(packed)
        n, size, window = len(words), cover.size, cover.window
        if not places:
            return n, None, [], [], *_finish(words, np.zeros(n, bool))
        at = np.array([p["at"] for p in places], np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        owner = np.array([p["owner"]["id"] for p in places], np.int64)[order]
        owner_row = np.array([p["owner"]["row"] for p in places], np.int64)[order]
        apart = at - np.array([p["owner"]["at"] for p in places], np.int64)[order]
        # Runs of anchors that overlap, with one owner and one distance.
        same = (owner[1:] == owner[:-1]) & (owner_row[1:] == owner_row[:-1]) & (apart[1:] == apart[:-1]) & (at[1:] - at[:-1] <= size)
        edge = np.flatnonzero(np.concatenate([[True], ~same]))
        begins, ends = at[edge], at[np.append(edge[1:] - 1, len(at) - 1)] + size
        own = (owner[edge] < i) & (ends - begins >= window)
        begins, ends = begins[own], ends[own]
        m = n - window + 1
        # A window may have a copy if an anchor it can share stands in its first `period` words.
        open_ = np.zeros(m + 1, np.int64)
        np.add.at(open_, np.maximum(0, at - cover.period + 1).clip(max=m), 1)
        np.add.at(open_, np.minimum(m, at + 1), -1)
        open_ = np.cumsum(open_[:m]) > 0
        for b, e in zip(begins, ends, strict=True):
            open_[b : e - window + 1] = False
        settled = np.stack([begins, ends], axis=1).ravel().astype(np.int32)
        if not open_.any():
            return n, None, settled, [], *_finish(words, _marked(n, settled, [], window))
        return n, packed, settled, np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]))).astype(np.int32), None, None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for part in slices(batches, 2, 1 << 20):
            rows = [one(i, t, p or []) for i, t, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.binary(), ints, ints, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in _SETTLED.split(", ")])

    return joined.mapInArrow(run, _SETTLED)


def _windows(open_docs: DataFrame, window: int) -> DataFrame:
    """A row for each open window: id, row, start, and 96 bits of hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 256 << 10):
            ids, rows, starts, w1, w2 = [], [], [], [], []
            for i, row, packed, runs in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                h = word_hashes(_words(packed))
                at = np.concatenate([np.arange(b, e) for b, e in zip(runs[::2], runs[1::2], strict=True)])
                ids.append(np.full(len(at), i, np.int64))
                rows.append(np.full(len(at), row, np.int64))
                starts.append(at.astype(np.int32))
                w1.append(rolled(h, window, _P1)[at].view(np.int64))
                w2.append((rolled(h ^ (h >> np.uint64(7)), window, _P2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, rows, starts, w1, w2)], names=["id", "row", "start", "w1", "w2"])

    return open_docs.select("id", "row", "packed", "open").mapInArrow(run, "id long, row long, start int, w1 long, w2 int")


def _marked(n: int, settled: list, starts: list, window: int) -> np.ndarray:
    """Which of n words go: those in settled runs and in windows that have a copy."""
    edge = np.zeros(n + 1, np.int64)
    runs = np.asarray(settled, np.int64).reshape(-1, 2)
    starts = np.asarray(starts, np.int64)
    np.add.at(edge, np.concatenate([runs[:, 0], starts]), 1)
    np.add.at(edge, np.concatenate([runs[:, 1], starts + window]), -1)
    return np.cumsum(edge[:n]) > 0


def _finish(words: list[bytes], gone: np.ndarray) -> tuple[int, str]:
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
    return int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _close(open_docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            done = []
            for packed, settled, starts in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                words = _words(packed)
                done.append((len(words), *_finish(words, _marked(len(words), settled, starts or [], window))))
            n, removed, sha = map(list, zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "row", "n_words", "n_removed", "kept_sha256"])

    return open_docs.mapInArrow(run, "id long, row long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = 50, period: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word inside a run of `window` words that also starts in a document with a smaller id.

    Words are parted by ASCII white space and compared unchanged; runs are
    judged on the input. Returns the id column, `n_words`, `n_removed` and
    `kept_sha256` (of the kept words joined by spaces), a row for each row
    given. Ids are whole numbers; a null id counts as larger than any other. A
    null text has no words. Rows with equal ids never remove one another's
    words, so repeated rows get equal answers. Texts below `window` words lose
    none. An empty table gives an empty table.

    Anchors are grouped by their hash, which few documents share even in a
    large group of copies, since each has its own; what is sent again is only
    shared anchors and open windows.
    """
    cover = Cover(window, period)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    by_anchor = Window.partitionBy("anchor")
    owned = _anchors(texts, cover).select("*", F.min(F.struct("id", "row", "at")).over(by_anchor).alias("owner"), F.max("id").over(by_anchor).alias("most"))
    shared = owned.filter("most > owner.id").groupBy("id", "row").agg(F.collect_set(F.struct("at", "owner")).alias("places"))
    settled = stored(_settle(_packed(texts).join(shared, ["id", "row"], "left").select("id", "row", "packed", "places"), cover), "settled")
    open_docs = settled.filter("packed IS NOT NULL")
    # The least id of each window, combined before it is sent; the join, unlike a window over the hash, can be split where a passage is very common.
    windows = _windows(open_docs, window)
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("w1", "w2", "least")
    seen = windows.join(stored(least, "repeated"), ["w1", "w2"]).filter("least < id")
    copied = seen.groupBy("id", "row").agg(F.collect_set("start").alias("copies"))
    closed = _close(open_docs.join(copied, ["id", "row"], "left").select("id", "row", "packed", "settled", "copies"), window)
    done = settled.filter("packed IS NULL").select("id", "row", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(closed).select(F.when(F.col("id") != _LAST, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256")
