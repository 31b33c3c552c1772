"""MinHash near-dedup with tensored banding.

Two collections of m half keys, each of `width` minhashes, are computed for a
text: 2 m `width` minhashes in all. The key of table (i, j) combines the i-th
half of the first collection with the j-th of the second, so m * m tables come
from 2 m halves. A pair of similarity s misses all tables with probability of
at most 2 (1 - s^width)^m; m is chosen so that this is 4e-5 at most for a pair
at the threshold: 12 halves of width 3 at 0.85, 16 at 0.8.

Texts that agree word for word are one node. Halves that no other node has are
dropped before tables are formed. Candidates are confirmed on the full shingle
sets in two passes. The first compares each node with the heads of its buckets
in all m * m tables: of each bucket the node whose halves are the most common.
The second looks at the other pairs of a bucket that are still in different
components; see `gatherings` for how it finds those that can be linked. So a
large group of near copies costs a few comparisons a member, linked or not,
and no candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored
from tallyforge.llm.gatherings import open_pairs
from tallyforge.llm.graph import components

SHINGLE = 5
#: Bytes of shingle sets and pairs that are compared in one group, about; each set counts as 4 kB at least.
CELL_BYTES = 8 << 20
CELL_PAIRS = 4096
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if it has fewer words; none without words."""
    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    roll = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        roll = roll * _P + h[k : k + len(roll)]
    return np.unique(_mixed(roll))


class Hashes:
    """The minhash functions of a seed, and the half keys of a set."""

    def __init__(self, halves: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        n = 2 * halves * width
        self.shape = 2 * halves, width
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)
        self.slot = np.arange(1, 2 * halves + 1, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half keys; and for each minhash a number of its place and its lowest byte."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 4096):
            low = np.minimum(low, (self.a[:, None] * shingles[None, at : at + 4096] + self.b[:, None]).min(axis=1))
        low = _mixed(low)
        sketch = np.arange(len(low), dtype=np.int32) << 8 | (low & np.uint64(0xFF)).astype(np.int32)
        low = low.reshape(self.shape)
        key = self.slot.copy()
        for k in range(self.shape[1]):
            key = key * _P + low[:, k]
        return _mixed(key).view(np.int64), sketch


def _signatures(texts: DataFrame, halves: int, width: int, seed: int) -> DataFrame:
    """Of id, row key and text: the same without the text, with c1 and c2 (a digest of the word sequence, null without words), n_shingles, the half keys and the sketch."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(halves, width, seed)
        for part in slices(batches, 2):
            c1, c2, n, keys, sketches = [], [], [], [], []
            for text in part.column(2).to_pylist():
                shingles = shingle_set(text or "")
                n.append(len(shingles))
                if len(shingles):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split())), np.int64)
                    c1.append(int(digest[0]))
                    c2.append(int(digest[1]))
                    both = hashes(shingles)
                    keys.append(both[0])
                    sketches.append(both[1])
                else:
                    c1.append(None)
                    c2.append(None)
                    keys.append([])
                    sketches.append([])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int32()))], names=["id", "row_key", "c1", "c2", "n_shingles", "halves", "sketch"])

    return texts.mapInArrow(run, f"id {kind}, row_key long, c1 long, c2 long, n_shingles long, halves array<long>, sketch array<int>")


def _sets(texts: DataFrame) -> DataFrame:
    """Of node and text: the node and its set as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t or "").tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold.

    Pairs are gathered by the least neighbour of either node, so that a set is
    sent once for most of its pairs: small gatherings together up to
    CELL_BYTES and CELL_PAIRS, a larger one in cells of two blocks each.
    """
    pairs = stored(pairs, "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = pairs.join(least, "a").join(least.select(F.col("a").alias("b"), F.col("m").alias("n")), "b").select("a", "b", F.least("m", "n").alias("label"))
    near = stored(near, "labelled_pairs")
    weight = F.greatest(F.length("shingles"), F.lit(4096)).cast("long")
    sized = near.select("label", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", weight.alias("weight")), "node")
    asked = near.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"))
    share = F.greatest(F.col("weight") / CELL_BYTES, F.col("pairs") / CELL_PAIRS)
    blocks = stored(sized.groupBy("label").agg(F.sum("weight").alias("weight")).join(asked, "label").select("label", share.alias("share")), "weights")
    cells = math.ceil(blocks.agg(F.sum("share")).first()[0] or 1)
    ends = near.join(blocks.select("label", F.ceil("share").alias("blocks")), "label")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    small = F.pmod(F.xxhash64(F.lit(5), "label"), F.lit(cells))
    large = F.xxhash64("label", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    celled = stored(ends.select(F.when(F.col("blocks") > 1, large).otherwise(small).alias("cell"), "a", "b"), "cells")
    members = celled.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select((F.col("cell") + F.lit(0)).alias("cell"), "node", "shingles")

    def check(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = {n: np.frombuffer(s, np.uint64) for n, s in zip(own.node, own.shingles, strict=True)}
        out = []
        for a, b in zip(asked.a.tolist(), asked.b.tolist(), strict=True):
            x, y = known[a], known[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return stored(members.groupBy("cell").cogroup(celled.groupBy("cell")).applyInPandas(check, "a long, b long"), "links")


def halves_for(similarity: float, width: int, miss: float = 4e-5) -> int:
    """How many half keys leave a pair of that similarity without a shared table at most that often."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**width))


def least_matches(similarity: float, halves: int, width: int) -> int:
    """How many of its minhashes a pair of that similarity shares, but for the chance with which it shares no table either."""
    n, below, miss = 2 * halves * width, 0.0, 2 * (1 - similarity**width) ** halves
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > miss:
            return k
    return n


def _pruned(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs that share `least` minhashes or more."""
    a = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").filter(F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, halves: int | None = None, width: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a similarity of `percent` or more.

    Returns the id column, `row_key` (a hash of id and text), `n_shingles`,
    `component_id` (the least id in the component, null if all its ids are) and
    `kept` (the row with that id and, among rows with it, the least hash), a
    row for each row given. A null text is the empty text; a document without
    words is linked with nothing and kept. Repeated rows are copies of one
    another; equal rows are told apart nowhere, so all of them have the same
    `kept`. `halves` follows from the threshold (see `halves_for`) unless given.
    Pairs that share too few minhashes to be that similar (see
    `least_matches`) are not candidates. An empty table gives an empty table.
    """
    halves = halves or halves_for(percent / 100, width)
    least = least_matches(percent / 100, halves, width)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    marked = stored(_signatures(texts, halves, width, seed), "signatures")
    lead = marked.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("row_key").alias("row_key"))
    one = marked.join(lead, ["c1", "c2", "row_key"]).dropDuplicates(["c1", "c2"])
    classes = stored(one.select("c1", "c2", "row_key", "halves", "sketch", F.monotonically_increasing_id().alias("node")), "classes")

    # Halves that two nodes or more have, and the tables that they form.
    each = classes.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = each.groupBy("slot", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = each.join(shared, ["slot", "half"]).groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("hits"), F.sum("n").alias("centre"))
    side = lambda first: F.filter("hits", lambda x: (x["slot"] < halves) if first else (x["slot"] >= halves))
    sides = hits.select("node", "centre", side(True).alias("left"), side(False).alias("right")).filter("size(left) > 0 AND size(right) > 0")
    tables = sides.select("node", "centre", F.explode("left").alias("x"), "right").select("node", "centre", "x", F.explode("right").alias("y"))
    bucket = F.xxhash64("x.slot", "x.half", "y.slot", "y.half")
    keyed = stored(tables.select("node", "centre", bucket.alias("bucket")), "tables")
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    keyed = stored(keyed.join(crowded, "bucket"), "buckets")

    nodes = keyed.select("node").distinct().join(classes.select("node", "row_key"), "node")
    owner = texts.join(nodes.hint("shuffle_hash"), "row_key").groupBy("node").agg(F.min("text").alias("text"))  # equal rows have one set
    sets = stored(_sets(owner), "sets")

    # First pass: each node with the heads of its buckets, the nodes whose halves most nodes have.
    heads = keyed.groupBy("bucket").agg(F.max_by("node", F.struct("centre", "node")).alias("head"))
    gatherings = stored(keyed.join(heads, "bucket").select("head", "node").distinct(), "gatherings")
    stars = gatherings.filter("node != head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    links = _confirm(_pruned(stars, classes, least), sets, percent)
    part = components(links)

    # Second pass: what may still join the components of a gathering.
    more = _confirm(open_pairs(gatherings, part, classes, sets, percent, least), sets, percent)
    final = components(stored(links.unionByName(more), "all_links"))

    labelled = marked.join(classes.select("c1", "c2", "node"), ["c1", "c2"], "left").join(final, "node", "left")
    labelled = labelled.select("id", "row_key", "n_shingles", F.coalesce("label", "node").alias("label"))
    smallest = labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
    lowest = labelled.filter("label IS NOT NULL").join(smallest, "label").filter("id <=> component_id").groupBy("label").agg(F.min("row_key").alias("keeper"))
    told = labelled.join(smallest, "label", "left").join(lowest, "label", "left")
    alone: Column = F.col("label").isNull()
    return told.select(
        F.col("id").alias(id_col), "row_key", "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"),
        (alone | F.col("id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("keeper"))).alias("kept"),
    )
