"""Token counts through a digest cache.

The cache is an append-only Parquet table (tokenizer string, content string,
n_tokens long): the digest of the tokenizer's file and library version, the
digest of the normalised content, and the count. Documents are joined to it by
digest; the distinct contents it lacks are encoded once each and appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored, tokenizer_path

SCHEMA = "tokenizer string, content string, n_tokens long"
#: Words whose counts a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and of the library's version: another of either means other counts."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + version.encode()).hexdigest()


class Counter:
    """Counts of one tokenizer in one worker.

    A .json tokenizer whose normaliser turns runs of white space into one
    space, and whose splitter drops it, counts a text as the sum over its
    words: those are counted once each. Any other counts whole texts.
    """

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
            self.by_word = False
        else:
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.count = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                self.by_word = drops_space(json.load(f))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.count(texts)
        words = [re.split(r"[\t-\r ]+", t) for t in texts]
        self._learn(words)
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in words]

    def _learn(self, words: list[list[str]]) -> None:
        unseen = set().union(*words).difference(self.known)
        if len(self.known) + len(unseen) > CACHE_WORDS:
            self.known.clear()
            unseen = set().union(*words)
        if unseen:
            unseen = list(unseen)
            self.known.update(zip(unseen, self.count(unseen), strict=True))


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer's description says that white space only parts words: it becomes one space, then is dropped by an inverted split."""
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": r"\s+"}
        and normalizers[1]["content"] == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    )


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


@lru_cache(8)
def _collapses(path: str) -> bool:
    import json

    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        return drops_space(json.load(f))


def content(text: Column, path: str) -> Column:
    """The normalised content: null is empty; where the tokenizer treats all white space alike, a run of the ASCII kind is one space."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[\t-\r ]+", " ") if _collapses(path) else text


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where no table has been written yet. A digest stored twice by jobs that ran at once counts once."""
    j = spark.sparkContext._jvm
    at = j.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text, through the cache at the path `cache`.

    Returns the id column, `content` (the digest), `n_bytes` (of the original
    UTF-8 text) and `n_tokens`, a row for each row given. A null text is the
    empty text, which has 0 tokens. Repeated rows share one cache entry, and so
    do texts that the tokenizer can't tell apart. Distinct misses are found by
    pre-aggregated digests, so a content that a third of all rows share still
    is encoded once, and its text isn't gathered in one task. Writes the misses
    to the cache before it returns.
    """
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    mark = tokenizer_digest(path)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumn("content", F.sha2(content(F.col("text"), path), 256))
    stored_counts = read_cache(spark, cache).filter(F.col("tokenizer") == mark).select("content", "n_tokens")
    # One row of each content stands for it: the least row key, found without its text.
    key = F.xxhash64("id", "text")
    lead = keyed.select("content", key.alias("key")).groupBy("content").agg(F.min("key").alias("key"))
    misses = lead.join(stored_counts, "content", "left_anti")
    todo = keyed.withColumn("key", key).join(misses.hint("shuffle_hash"), ["content", "key"], "left_semi").select("content", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(count(part.column(1).to_pylist()), np.int64))], names=["content", "n_tokens"])

    fresh = todo.mapInArrow(run, "content string, n_tokens long").groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(mark).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == mark).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    counts = stored(counts, "counts")  # so that the join's two sides are plain exchanges, which Spark splits at a content that very many documents share
    small = keyed.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return small.join(counts, "content").select(F.col("id").alias(id_col), "content", "n_bytes", "n_tokens")
