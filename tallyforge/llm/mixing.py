"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). A small flow network routes the patterns' words to the sources' quotas:
each use of a pattern's words after the first costs more than the one before,
so repetition is spread as evenly as the quotas allow. Documents are then
chosen in a seeded order until a pattern's share is reached.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD, stored


def capped_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight; what would exceed `most` times a source's size stops there, and the excess is shared again by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        rest = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * weights[i] / weight > most * sizes[i]]
        for i in over or open_:
            targets[i] = most * float(sizes[i]) if over else rest * weights[i] / weight
        if not over:
            break
        open_ -= set(over)
    return targets


class Flow:
    """Min-cost flow by cheapest augmenting paths."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, room: int, cost: float = 0.0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            best, via, queue = {source: 0.0}, {}, deque([source])
            while queue:
                x = queue.popleft()
                for e in self.out.get(x, ()):
                    if self.room[e] and best[x] + self.cost[e] < best.get(self.to[e], float("inf")) - 1e-12:
                        best[self.to[e]] = best[x] + self.cost[e]
                        via[self.to[e]] = e
                        queue.append(self.to[e])
            if sink not in via:
                return
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            by = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= by
                self.room[e ^ 1] += by


@dataclass(frozen=True)
class Plan:
    """What the flow decides: words taken of each pattern, and each source's size, target and words."""

    taken: dict[tuple, int]
    size: dict[str | None, int]
    target: dict[str | None, float]
    routed: dict[str | None, int]


def by_code_point(sources: set) -> list:
    """Sources in code point order, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def plan(patterns: dict[tuple, int], weights: tuple[float, ...] = (1, 2, 3), repeats: int = 3) -> Plan:
    """Route the patterns' words to the sources. The k-th use of a word costs k (k - 1) / 2: convex, and nothing for the first."""
    sources = by_code_point({s for p in patterns for s in p})
    size = {s: sum(n for p, n in patterns.items() if s in p) for s in sources}
    shares = [weights[i % len(weights)] for i in range(len(sources))]
    total = sum(patterns.values())
    # Overlapping sources hold some words twice; their quotas share the words there are.
    scale = total / max(1, sum(size.values()))
    quotas = capped_targets([size[s] for s in sources], shares, repeats)
    quotas = [q * scale for q in quotas] if scale < 1 else quotas
    net, keys = Flow(), sorted(patterns, key=str)
    first_use, end = {}, 1 + len(keys) + len(sources)
    for i, p in enumerate(keys):
        first_use[p] = [net.arc(0, 1 + i, patterns[p], k * (k - 1) / 2) for k in range(1, repeats + 1)]
        for s in p:
            net.arc(1 + i, 1 + len(keys) + sources.index(s), repeats * patterns[p])
    quota_arcs = [net.arc(1 + len(keys) + j, end, round(q)) for j, q in enumerate(quotas)]
    net.run(0, end)
    taken = {p: sum(net.room[e ^ 1] for e in first_use[p]) for p in keys}
    return Plan(taken, size, dict(zip(sources, quotas, strict=True)), {s: net.room[e ^ 1] for s, e in zip(sources, quota_arcs, strict=True)})


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7, buckets: int = 4096, most_patterns: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Decide how often the mix takes every document.

    `source_col` is a string or an array of strings (overlapping sources; order
    and repetition in it mean nothing). Sources in code point order, null last,
    have the weights in turn; each gets that share of all words, at most
    `repeats` times its own. Returns the id column, `row_key` (a hash of id and
    text), `size` (words), `source_size` and `target` (of its source, summed
    over several) and `taken` (words, repetitions counted; a multiple of the
    size), a row for each row given. Null texts and texts without words have
    size 0 and are never taken. Repeated rows are taken each; order among equal
    hashes is by id, and of equal rows as many are taken as fit. Reruns agree.

    The driver sees one row a pattern; a corpus with more than `most_patterns`
    of them is refused, which also bounds what is broadcast. A pattern with a
    third of all rows is cut by seeded hash into `buckets`, summed before the
    exchange; only the bucket where its share ends is put in order.
    """
    many = docs.schema[source_col].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(source_col)
    members = F.when(F.col(source_col).isNull() | (F.size(members) == 0), F.array(F.lit(None).cast("string"))).otherwise(members)
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), members.alias("members"), word_count(F.col(text_col)).alias("size"), hashed.alias("hash"))
    # `nth` tells equal rows apart, so that one of them can be taken without the others.
    rows = stored(rows.withColumns({"bucket": F.pmod("hash", F.lit(buckets)), "nth": F.monotonically_increasing_id()}), "sizes")
    totals = rows.groupBy("members").agg(F.sum("size").alias("size"))
    found = totals.limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    got = plan({tuple(r.members): r.size for r in found}, weights, repeats)
    share = [(list(p), n, got.taken[p] // max(1, n), got.taken[p] % max(1, n), sum(got.size[s] for s in p), sum(got.target[s] for s in p)) for p, n in ((tuple(r.members), r.size) for r in found)]
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "members array<string>, total long, rounds long, rest long, source_size long, target double"))
    known = rows.select("members", "bucket", "size").groupBy("members", "bucket").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = known.withColumn("before", F.coalesce(running, F.lit(0))).join(shares, "members").filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    cut = cut.select("members", F.col("bucket").alias("cut"), "before").groupBy("members").agg(F.min("cut").alias("cut"), F.min_by("before", "cut").alias("before"))
    whole = shares.join(cut, "members", "left")
    placed = rows.join(F.broadcast(whole), "members")
    order = Window.partitionBy("members").orderBy("hash", "id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.filter("bucket = cut").withColumn("more", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before") + F.col("size") <= F.col("rest"))
    other = placed.filter("bucket != cut OR cut IS NULL").withColumn("more", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)))
    both = within.unionByName(other)
    # What is still owed is made up by the document whose size comes nearest to it, and by one more.
    for _ in range(2):
        owed = both.groupBy("members").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("owed")).filter("owed > 0")
        off = F.abs(F.col("size") - F.col("owed"))
        last = both.filter("NOT more AND size > 0").join(F.broadcast(owed), "members").filter(off < F.col("owed")).groupBy("members").agg(F.min(F.struct(off.alias("off"), "hash", "id", "row_key", "nth")).alias("last"))
        chosen = F.col("nth") == F.col("last.nth")
        both = stored(both.join(F.broadcast(last), "members", "left").withColumn("more", F.col("more") | F.coalesce(chosen, F.lit(False))).drop("last"), "chosen")
    uses = F.least(F.col("rounds") + F.col("more").cast("long"), F.lit(repeats))
    return both.select(F.col("id").alias(id_col), "row_key", "size", "source_size", "target", (F.col("size") * uses).alias("taken"))
