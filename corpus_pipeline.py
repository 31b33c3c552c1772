"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import row_key, stored, table
from tallyforge.llm.lines import dedup_lines
from tallyforge.llm.minhash import near_duplicates
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.pieces import encode_pieces, piece_digests
from tallyforge.llm.queries import MIN_SITES
from tallyforge.llm.toxicity import learnable, score_toxicity


def _chosen(docs: DataFrame, told: DataFrame, *columns: str) -> DataFrame:
    """Documents, whole in `row`, beside the named columns of verdicts joined by id and row key; the verdict of repeated rows is one.

    A document's own columns stay inside `row`, so none of their names can clash.
    """
    verdicts = told.dropDuplicates(["doc_id", "row_key"]).alias("v")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key("doc_id", F.col("text")).alias("key")).alias("d")
    joined = keyed.join(verdicts.hint("shuffle_hash"), (F.col("d.key") == F.col("v.row_key")) & F.col("d.id").eqNullSafe(F.col("v.doc_id")))
    return joined.select("d.row", "d.key", *[F.col(f"v.{c}").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the labelled examples call toxic.

    Null and empty texts are scored as such; repeated rows share a verdict; an
    empty table stays empty; other columns stay as they are.
    """
    scored = score_toxicity(docs, learnable(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return _chosen(docs, scored, "predicted").filter("predicted = 0").select("row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts; a document that consisted of them alone goes.

    Null texts and those without lines stay; `n_chars`, where there is one,
    follows the text; repeated rows lose the same lines.
    """
    plain = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    out = dedup_lines(plain, MIN_SITES).filter("lines_removed = 0 OR lines_removed < lines_total")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies; of equal rows, one. Documents without words are copies of nothing."""
    found = stored(near_duplicates(docs).filter("kept").select("doc_id", "row_key"), "kept")
    return _chosen(docs, found).groupBy("row.doc_id", "key").agg(F.first("row").alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; those it doesn't take, the ones without words included, go."""
    taken = mix_sources(docs).filter("taken > 0").select("doc_id", "row_key", F.expr("CAST(taken DIV size AS INT)").alias("times"))
    return _chosen(docs, taken, "times").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode the mix's documents."""
    return piece_digests(encode_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL expresses neither the cosine search of the first stage nor the tokeniser of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
