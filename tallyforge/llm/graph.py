"""Connected components of an edge table, in rounds of grouping and joining. No links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Label each node of the edges (a, b: longs) with the least node it can reach: columns node, label.

    Alternates two steps until nothing changes (both of the kind known as
    large-star and small-star): each node hands its larger neighbours to its
    least one, then its smaller ones. Each round writes the edges that are
    left to the shared folder; a round shortens every path to about half, so
    the rounds grow as the logarithm of the longest path. Nodes without an
    edge to another node don't appear; an empty table gives an empty table.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = stored(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = stored(small.select("e.a", "e.b").filter("a != b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
