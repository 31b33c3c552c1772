"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. HyperLogLog sketches of the
sites of each line hash merge by aggregation; lines whose estimate lies near
the threshold get an exact distinct count; every occurrence of a spread line
but the first goes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

#: What is trimmed off a line before it is compared.
TRIMMED = " \t\r"


def _pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12, near: float = 0.1) -> DataFrame:
    """The line hashes (h1, h2) that stand on `min_sites` distinct sites or more.

    `lines` has h1, h2 (two hashes of a line) and site (a long). Estimates
    within `near` of the threshold are settled by exact distinct counts; a
    sketch of 2^12 registers errs by 1.6 % (one standard deviation), so 10 %
    is six of them.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    sure = sketched.filter(F.col("sites") > high).select("h1", "h2")
    close = sketched.filter(F.col("sites").between(low, high)).select("h1", "h2")
    exact = lines.join(close, ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h1", "h2"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, lg_k: int = 12, near: float = 0.1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Take the boilerplate lines out of every text.

    Returns all columns of `docs`, the text without the lines removed, and
    `lines_total` (lines with a character other than space, tab or return) and
    `lines_removed`, which take the place of columns of these names. Fewer sites than
    `min_sites` in the whole table mean that nothing goes. Of a line on `min_sites` sites or more only the first
    occurrence stays, in the document with the least id (null before all
    others), then the least row hash, then the first in the text. A null text
    has no lines and stays null; a null site counts as one site; repeated rows
    lose the same lines; an empty table gives an empty table.

    A count of occurrences, combined before the exchange, leaves only lines
    that can reach the threshold; those alone are sketched. The joins by line
    hash are plain equi-joins that Spark can split where a line is very common.
    """
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(site_col).alias("site"))
    base = base.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", "id")})
    one = base.select("id", "site", "k1", "k2", F.posexplode(_pieces(F.col("text"))).alias("pos", "line"))
    one = one.withColumn("line", F.btrim("line", F.lit(TRIMMED))).filter("line != ''")
    one = one.select("id", "site", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    often = one.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = often.filter((F.col("n") >= min_sites) & (F.col("a") != F.col("b")) | F.lit(min_sites <= 1)).select("h1", "h2")
    found = stored(one.join(often, ["h1", "h2"]), "common_lines")
    wide = stored(spread_lines(found, min_sites, lg_k, near), "spread_lines")
    hits = found.join(wide, ["h1", "h2"])
    first = hits.groupBy("h1", "h2").agg(F.min(F.struct("id", "k1", "k2", "pos")).alias("first"))
    gone = hits.join(first, ["h1", "h2"]).filter("NOT (k1 = first.k1 AND k2 = first.k2 AND pos = first.pos)")
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    pieces = F.col("pieces")
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("gone"))
    joined = base.join(gone, ["k1", "k2"], "left").withColumn("pieces", _pieces(F.col("text")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "\n"))
    total = F.size(F.filter(pieces, lambda x: F.btrim(x, F.lit(TRIMMED)) != "")).cast("long")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    kept = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lines_total", "lines_removed")]
    return joined.select(*kept, total.alias("lines_total"), removed.alias("lines_removed"))
