"""Candidate pairs inside gatherings: the nodes that share a bucket with one head.

Every node of a gathering has been compared with its head. What is left are
pairs of other nodes in different components. In a gathering of a few nodes
all of them are candidates. In a larger one they are found by an exact join on
differences: with c = (100 - percent) / (100 + percent), sets A and B are as
similar as asked for if and only if |A xor B| <= c (|A| + |B|). Relative to
the head H a set is its difference A xor H, and A xor B is the xor of two
differences; so a linked pair shares at least
(|A xor H| + |B xor H| - c (|A| + |B|)) / 2 elements of its differences: half
the sum of the weights |X xor H| - c |X|. So it shares at least the lighter
one's weight, and one of the lighter one's c |A| + 1 rarest elements: mostly
edits that a text has to itself. The heavier one asks by its rarest half: A
that isn't linked with H weighs more than c |H|, which bounds what either
shares (a prefix filter with two sides). A node linked with X weighs at least
|X xor H| - c |X| - 2 c |X| / t, with t the threshold, for X is no farther
from the head than both are from that node; where the head is far from all,
this keeps the prefixes as short as under a near one. How many differences
have an element is put beside it by a join for rare elements alone; common
ones stand in order beside their head, as one row.
Texts that all lie near the head, but not near one another, share none of
these and cost nothing; no candidate is left out. The head may be any set: a
gathering is handed over to the largest one that a node of it belongs to, so
that most nodes are compared under one head.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored

#: Gatherings of so many nodes at most are compared pair by pair; that bounds the pairs by as many a node.
FEW = 64
#: Elements that more than one in so many differences from a head has are common: at most as many times the mean difference, since all add up.
COMMON = 8


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of head, node and label: with n_node, n_head (sizes of the sets) and difference (what stands in one of them)."""
    both = pairs.join(sets.select("node", F.col("shingles").alias("own")), "node").join(sets.select(F.col("node").alias("head"), F.col("shingles").alias("other")), "head")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            own, other = ([np.frombuffer(x, np.int64) for x in part.column(k).to_pylist()] for k in (3, 4))
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(own, other, strict=True)]
            sizes = [pa.array([len(x) for x in xs], pa.int64()) for xs in (own, other)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *sizes, pa.array(apart, pa.list_(pa.int64()))], names=["head", "node", "label", "n_node", "n_head", "difference"])

    return both.select("head", "node", "label", "own", "other").mapInArrow(run, "head long, node long, label long, n_node long, n_head long, difference array<long>")


def _many(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates in large gatherings (head, head_label, node, label): nodes linked with the head, and pairs by the rarest elements of their differences from it."""
    far = stored(_differences(rows.select("head", "node", "label"), sets), "differences")
    d, whole = F.size("difference").cast("long"), 100 + percent
    weight, edge = d * whole - F.col("n_node") * (100 - percent), F.col("n_head") * (100 - percent)
    linked = weight <= edge
    # What a node it is linked with weighs at least: no more lies between it and the head than between both of them and that node.
    least = weight - F.ceil(F.col("n_node") * (200 * (100 - percent) / percent) + F.lit(1e-6))
    # How many of the first places a pair must share one in, if its other node weighs at least so much; it shares half of both weights.
    first = lambda other: d - F.greatest(F.lit(1), F.ceil((weight + other) / (2 * whole) - F.lit(1e-6))) + 1
    places = {"held": first(F.when(linked, edge).otherwise(weight)), "asked": first(F.greatest(edge, least)), "asked_near": F.when(least <= edge, first(F.greatest(-edge, least))).otherwise(0)}
    # Elements that no other difference has come first in the order; they take up places, but need no row. Those of more than one
    # node in COMMON come last: they stand once beside their head, and a node picks its own out of them, in their order.
    each = far.select("head", "node", F.explode("difference").alias("element"))
    members = rows.groupBy("head").agg(F.count(F.lit(1)).alias("members"))
    often = each.groupBy("head", "element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(members, "head")
    often = stored(often.select("head", "element", "n", (F.col("n") * COMMON > F.col("members")).alias("common")), "often")
    in_order = lambda name: F.sort_array(F.collect_list(F.struct("n", "element")))["element"].alias(name)
    common = often.filter("common").groupBy("head").agg(in_order("common"))
    rare = each.join(often.filter("NOT common"), ["head", "element"]).groupBy("head", "node").agg(in_order("rare"))
    none = F.expr("CAST(array() AS array<bigint>)")
    sized = far.join(common, "head", "left").select("head", "node", "label", linked.alias("linked"), weight.alias("weight"), d.alias("d"), *(x.alias(name) for name, x in places.items()), F.array_intersect(F.coalesce("common", none), "difference").alias("common"))
    ranked = F.concat(F.coalesce("rare", none), "common")
    longest = F.when(F.col("linked"), F.col("held")).otherwise(F.greatest("asked", "asked_near"))
    prefix = sized.join(rare, ["head", "node"], "left").select("*", ranked.alias("ranked")).withColumn("alone", F.col("d") - F.size("ranked"))
    prefix = prefix.select("*", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(longest - F.col("alone"), F.lit(0)).cast("int"))).alias("place", "element")).withColumn("at", F.col("alone") + F.col("place"))
    prefix = stored(prefix.select("head", "node", "label", "linked", "weight", "d", "at", "element", *((F.col("at") < F.col(x)).alias(x) for x in places)), "prefixes")
    # The lighter node of a pair is held by its few first places, the heavier one asks by more; linked ones are lighter than all others.
    side = lambda s: [F.col(x).alias(f"{x}_{s}") for x in ("node", "label", "weight", "d", "at")]
    a = prefix.filter("held").select("head", "element", F.col("linked").alias("near"), *side("a"))
    b = prefix.filter("NOT linked").select("head", "element", F.explode(F.array_compact(F.array(F.when(F.col("asked"), False), F.when(F.col("asked_near"), True)))).alias("near"), *side("b"))
    needed = (F.col("weight_a") + F.col("weight_b")) / (2 * whole) - 1e-6
    room = F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b"))
    lighter = F.struct("weight_a", "node_a") < F.struct("weight_b", "node_b")
    mine = far.filter(linked).join(rows.select("head", "head_label").distinct(), "head").filter("label != head_label").select(F.greatest("head", "node").alias("a"), F.least("head", "node").alias("b"))
    found = a.join(b, ["head", "element", "near"]).filter((F.col("label_a") != F.col("label_b")) & lighter & (room >= needed))
    return found.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).unionByName(mine)


def _few(rows: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Candidates in small gatherings (head, node, label): all pairs of different components that share `least` minhashes or more."""
    known = rows.join(classes.select("node", "sketch"), "node")
    a, b = (known.select("head", *(F.col(x).alias(f"{x}_{s}") for x in ("node", "label", "sketch"))) for s in "ab")
    found = a.join(b, "head").filter((F.col("node_a") > F.col("node_b")) & (F.col("label_a") != F.col("label_b"))).filter(F.size(F.array_intersect("sketch_a", "sketch_b")) >= least)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def open_pairs(gatherings: DataFrame, part: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """The candidate pairs (a > b) of the gatherings (head, node; the head is one of its nodes) that may still join components.

    `part` are the components of the pairs confirmed so far (node, label).
    Empty gatherings give an empty table.
    """
    labelled = stored(gatherings.join(part, "node", "left").select("head", "node", F.coalesce("label", "node").alias("label")), "labelled")
    sizes = labelled.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("n > 2 AND lo != hi").select("head", "n")
    mixed = stored(labelled.join(sizes, "head").filter("node != head"), "mixed")
    # Each gathering goes to the largest one that any of its nodes is in.
    tops = mixed.groupBy("node").agg(F.max(F.struct("n", "head")).alias("top"))
    taken = mixed.join(tops, "node").groupBy("head").agg(F.max("top").alias("top")).select("head", F.col("top.head").alias("into"))
    merged = stored(mixed.join(taken, "head").select(F.col("into").alias("head"), "node", "label").filter("node != head").distinct(), "merged")
    sizes = merged.groupBy("head").agg(F.count(F.lit(1)).alias("n")).join(part.select(F.col("node").alias("head"), F.col("label").alias("head_label")), "head", "left").withColumn("head_label", F.coalesce("head_label", "head"))
    mixed = stored(merged.join(sizes, "head"), "mixed")
    return _few(mixed.filter(F.col("n") <= FEW), classes, least).unionByName(_many(mixed.filter(F.col("n") > FEW), sets, percent)).distinct()
