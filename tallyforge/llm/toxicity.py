"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words and word beginnings of a bounded sample of labelled texts,
weighted by their document frequencies over all documents and by how surely the
sample ties them to the label; none is left out. Words that no example holds
can't meet anything; they count together as one background term in a text's
length.

The index cuts the examples into blocks. A search adds up the postings of its
rare terms; for the common ones it knows the largest weight in each block. A
block is added up in full only if these bounds let it reach the nearest
examples: exactly those are found.

Similarity-weighted votes of the neighbours, mapped through a monotone fit to
leave-one-out votes of the examples themselves, are the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored

#: What stands between words: words are letters, and numerals other than digits.
_BETWEEN = r"[^\p{L}\p{Nl}\p{No}]+"
#: Letters of a word's beginning that is a term of its own.
PREFIX = 5
#: A term held by more than one in so many examples is common: it has bounds by block instead of postings.
_COMMON = 16
#: Postings that are added up at a time.
_POSTINGS = 1 << 20


def terms_of(word: str) -> list[str]:
    """A word and its beginning, marked by a final hyphen."""
    return [word, f"{word[:PREFIX]}-"] if len(word) > PREFIX else [word]


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of texts in small letters, null as none; empty ones stand at the ends."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _BETWEEN)


@dataclass(frozen=True)
class Settings:
    #: Labelled texts that are learnt from, at most; chosen by hash.
    examples: int = 4000
    neighbours: int = 15
    #: Examples in a block of the index, and blocks that a search adds up before it looks at bounds.
    block: int = 64
    first_blocks: int = 4
    #: Weight of the background term: the larger, the more of such words a text must hold to be near a text that is full of them.
    background: float = 0.7
    #: A term's share of its idf if nothing ties it to label 1, and the standard errors of its log odds at which it gets half of the rest.
    least_weight: float = 0.2
    half: float = 3.0
    #: The fit of votes to labels: the share of the examples that a pool has at least, and its further examples at the prior.
    least_share: float = 0.02
    pseudo: float = 4.0
    seed: int = 3


class Reader:
    """Texts as the numbers of their terms; a word without a term is the background's number.

    Texts are read together, as arrays: each different word of a batch is
    looked up once, and its numbers are put in its places and counted by text.
    """

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.string())

    def numbers(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers each word has, and all of them: its own term's and its beginning's, else the background's; the empty word has none."""
        beginning = pc.if_else(pc.greater(pc.utf8_length(words), PREFIX), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, PREFIX), "-", ""), None)
        found = np.stack([pc.fill_null(pc.index_in(x, value_set=self.terms), -1).to_numpy() for x in (words, beginning)], axis=1)
        plain = (found < 0).all(axis=1) & (pc.utf8_length(words).to_numpy() > 0)
        found[plain, 0] = len(self.terms)
        return (found >= 0).sum(axis=1), found[found >= 0]

    def read(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Each text's terms in order, and how often each stands there."""
        words = split_words(texts)
        owner = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        size, terms = self.numbers(coded.dictionary)
        first, code = np.cumsum(size) - size, coded.indices.to_numpy()
        n = size[code]
        at = np.repeat(first[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
        width = len(self.terms) + 1
        both, counts = np.unique(np.repeat(owner, n) * width + terms[at], return_counts=True)
        starts = pa.array(np.searchsorted(both, np.arange(len(words) + 1) * width), pa.int32())
        return pa.ListArray.from_arrays(starts, pa.array(both % width, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(counts, pa.int32()))


def count_terms(examples: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All terms of the examples (text, label), sorted, and the examples of label 0 and of label 1 that hold each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            held = [sorted({t for w in set(words) if w for t in terms_of(w)}) for words in split_words(part.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string())), part.column(1)], names=["terms", "label"])

    each = examples.select("text", "label").mapInArrow(run, "terms array<string>, label int").select(F.explode("terms").alias("term"), "label")
    found = each.groupBy("term").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).toArrow().sort_by("term")  # bounded, as the examples are
    return found["term"].to_pylist(), found["n0"].to_numpy(), found["n1"].to_numpy()


def ties(n0: np.ndarray, n1: np.ndarray, clean: int, toxic: int, settings: Settings) -> np.ndarray:
    """Each term's share of its idf: from `least_weight` to 1 with the standard errors by which its log odds of label 1 exceed 0."""
    odds = np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))
    sure = np.maximum(0.0, odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))) ** 4
    return settings.least_weight + (1 - settings.least_weight) * sure / (sure + settings.half**4)


def read_terms(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Of id, row key and text: the same without the text, with the terms (numbers in the broadcast list) and their counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *reader.read(part.column(2))], names=["id", "row_key", "terms", "counts"])

    return docs.mapInArrow(run, f"id {kind}, row_key long, terms array<int>, counts array<int>")


def _starts(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))])


def document_frequencies(read: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and how many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)  # the last counts documents, the one before is the background
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms + 2)
            total[-1] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    found = read.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms + 2, np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df[:n_terms], int(df[-1])


class Index:
    """The examples' unit vectors: postings of the rare terms, rows and bounds by block of the common ones."""

    def __init__(self, ids: list, labels: list[int], texts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, settings: Settings):
        """texts: terms and counts of each example. idf: weight of each term, the background's last."""
        self.idf, self.k, self.size, self.ahead = idf, settings.neighbours, settings.block, settings.first_blocks
        order = self._neighbourhoods(texts, len(idf))
        self.ids = [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.blocks = -(-len(ids) // self.size)
        self.width = self.blocks * self.size
        self.starts = _starts(len(texts[i][0]) for i in order)
        self.terms = np.concatenate([np.empty(0, np.int32), *(texts[i][0] for i in order)])
        self.weights = self.unit(self.terms, np.concatenate([np.empty(0, np.int32), *(texts[i][1] for i in order)]), self.starts)
        held = np.bincount(self.terms, minlength=len(idf))
        common = np.flatnonzero(held * _COMMON > len(ids))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        by_term = np.argsort(self.terms, kind="stable")
        by_term = by_term[self.row[self.terms[by_term]] < 0]
        example = np.repeat(np.arange(len(order)), np.diff(self.starts))
        self.doc, self.weight = example[by_term].astype(np.int32), self.weights[by_term]
        self.first = _starts(np.where(self.row < 0, held, 0))
        self.full = np.zeros((len(common), self.width))
        inside = self.row[self.terms] >= 0
        self.full[self.row[self.terms[inside]], example[inside]] = self.weights[inside]
        self.most = self.full.reshape(len(common), self.blocks, self.size).max(axis=2, initial=0)
        plain = np.array([all(t == len(idf) - 1 for t in texts[i][0]) for i in order], bool)
        self.prior = float((self.labels.sum() + 0.5) / (len(ids) + 1)) if len(ids) else 0.0
        self.plain = float((self.labels[plain].sum() + self.prior) / (plain.sum() + 1))
        self.fit: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _neighbourhoods(texts: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
        """An order that puts examples with the same common words side by side, so that the bounds of blocks are close."""
        held = np.bincount(np.concatenate([np.empty(0, np.int32), *(t for t, _ in texts)]), minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:24]
        return np.lexsort(np.array([np.isin(common, t) for t, _ in texts], bool).reshape(len(texts), len(common)).T[::-1])

    def unit(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Weights of the texts' terms; each text's vector has the length 1. Text i has the terms from starts[i] to starts[i + 1]."""
        weights = (1 + np.log(np.maximum(counts, 1))) * self.idf[terms]
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        length = np.sqrt(np.bincount(owner, weights * weights, len(starts) - 1))
        return weights / np.where(length > 0, length, 1.0)[owner]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text the k examples of the highest cosine (ties: earlier ones) and their cosines; 0 where there are no more. leave: for each text an example that doesn't count."""
        if not len(self.ids):
            return np.zeros((len(starts) - 1, self.k), np.int64), np.zeros((len(starts) - 1, self.k))
        per_text = np.add.reduceat(np.append((self.first[terms + 1] - self.first[terms]), 0), starts[:-1]) * (np.diff(starts) > 0)
        found, at, total = [], 0, 0
        for i, n in enumerate(per_text.tolist()):
            if i > at and (total + n > _POSTINGS or i - at >= 128):
                found.append(self._search(terms, weights, starts[at : i + 1], None if leave is None else leave[at:i]))
                at, total = i, 0
            total += n
        found.append(self._search(terms, weights, starts[at:], None if leave is None else leave[at:]))
        docs, cosines = zip(*found, strict=True)
        return np.concatenate(docs), np.concatenate(cosines)

    def _search(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        q, span = len(starts) - 1, slice(starts[0], starts[-1])
        ts, ws, owner = terms[span], weights[span], np.repeat(np.arange(q), np.diff(starts))
        row = self.row[ts]
        common = row >= 0
        asked = np.zeros((q, len(self.full)))
        asked[owner[common], row[common]] = ws[common]
        ts, ws, owner = ts[~common], ws[~common], owner[~common]
        n = self.first[ts + 1] - self.first[ts]
        posting = np.repeat(self.first[ts] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(np.repeat(owner, n) * self.width + self.doc[posting], np.repeat(ws, n) * self.weight[posting], q * self.width)
        score = score.astype(np.float64).reshape(q, self.blocks, self.size)
        if leave is not None:
            score.reshape(q, -1)[np.arange(q), leave] = -np.inf
        bound = asked @ self.most + score.max(axis=2)
        ahead = min(self.ahead, self.blocks)
        want = np.zeros(bound.shape, bool)
        np.put_along_axis(want, np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead], True, axis=1)
        self._complete(score, asked, want)
        k = min(self.k, self.width)
        seen = np.where(want[:, :, None], score, -np.inf).reshape(q, -1)
        least = np.maximum(np.partition(seen, -k, axis=1)[:, -k], 0)
        more = ~want & (bound > 0) & (bound >= least[:, None] - 1e-9)
        self._complete(score, asked, more)
        seen = np.round(np.where((want | more)[:, :, None], score, -np.inf).reshape(q, -1), 9)
        docs, cosines = np.zeros((q, self.k), np.int64), np.zeros((q, self.k))
        least = np.maximum(np.partition(seen, -k, axis=1)[:, -k], 1e-9)
        for i in range(q):
            top = np.flatnonzero(seen[i] >= least[i])
            top = top[np.argsort(-seen[i, top], kind="stable")[:k]]
            docs[i, : len(top)], cosines[i, : len(top)] = top, seen[i, top]
        return docs, cosines

    def _complete(self, score: np.ndarray, asked: np.ndarray, want: np.ndarray) -> None:
        """Add the common terms' share to the blocks that are wanted, block by block for all texts that want it."""
        for b in np.flatnonzero(want.any(axis=0)).tolist():
            who = np.flatnonzero(want[:, b])
            score[who, b] += asked[who] @ self.full[:, b * self.size : (b + 1) * self.size]

    def votes(self, docs: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Labels weighted by closeness, and one vote at the prior."""
        w = np.where(cosines > 0, 1.0 / (1.05 - np.minimum(cosines, 1.0)), 0.0)
        return ((w * self.labels[docs]).sum(axis=1) + self.prior) / (w.sum(axis=1) + 1.0)

    def calibrate(self, least_share: float, pseudo: float) -> None:
        """Fit votes to labels: leave each example out, then `fit_votes`."""
        n = len(self.ids)
        told = n and [(v, y) for v, y, a, b in zip(self.votes(*self.nearest(self.terms, self.weights, self.starts, np.arange(n))).tolist(), self.labels.tolist(), self.starts, self.starts[1:], strict=False) if b > a and self.terms[a] != len(self.idf) - 1]
        self.terms = self.weights = self.starts = None  # not needed any more, and not to be broadcast
        if told:
            self.fit = fit_votes(told, self.prior, max(2.0, least_share * len(told)), pseudo)

    def score(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
        """The scores of texts and their nearest examples: id, cosine, label. Texts without terms are as likely as the examples without."""
        if not len(self.ids):
            return np.full(len(starts) - 1, self.plain), [[] for _ in starts[1:]]
        docs, cosines = self.nearest(terms, self.unit(terms, counts, starts), starts)
        raw = self.votes(docs, cosines)
        held = np.add.reduceat(np.append(terms != len(self.idf) - 1, False), starts[:-1], dtype=np.int64) * (np.diff(starts) > 0) > 0
        score = np.where(held, raw if self.fit is None else np.interp(raw, *self.fit), self.plain)
        near = [[(self.ids[d], c, int(self.labels[d])) for d, c in zip(ds, cs, strict=True) if h and c > 0] for ds, cs, h in zip(docs[:, :3].tolist(), cosines[:, :3].tolist(), held, strict=True)]
        return score, near


def fit_votes(told: list[tuple[float, float]], prior: float, least: float, pseudo: float) -> tuple[np.ndarray, np.ndarray]:
    """A rising line through pairs of vote and label: pools of votes and their scores.

    Pools begin as runs of equal or neighbouring votes with `least` examples at
    least, so that one odd label moves little; then neighbours that don't rise
    are joined. A pool's score is its mean label with `pseudo` further examples
    at the prior; votes between two pools' means are interpolated.
    """
    runs: list[list[float]] = []  # examples, sum of votes, sum of labels, last vote
    for v, y in sorted(told):
        if runs and (runs[-1][0] < least or runs[-1][3] == v):
            runs[-1] = [runs[-1][0] + 1, runs[-1][1] + v, runs[-1][2] + y, v]
        else:
            runs.append([1.0, v, y, v])
    if len(runs) > 1 and runs[-1][0] < least:
        last = runs.pop()
        runs[-1] = [*(a + b for a, b in zip(runs[-1][:3], last[:3], strict=True)), last[3]]
    pools: list[list[float]] = []
    for run in runs:
        pools.append(run)
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [*(a + b for a, b in zip(pools[-1][:3], last[:3], strict=True)), last[3]]
    xs = np.array([p[1] / p[0] for p in pools])
    ys = np.array([(p[2] + prior * pseudo) / (p[0] + pseudo) for p in pools])
    return xs, np.maximum.accumulate(ys)


def learn(read: DataFrame, examples: DataFrame, shared: Broadcast, n0: np.ndarray, n1: np.ndarray, settings: Settings) -> Index:
    """The index of the examples (id, text, label), in the order of their ids' hashes; document frequencies are those of the documents read.

    The driver gets term numbers and counts of the examples, not their texts.
    """
    df, n = document_frequencies(read, len(n0))
    numbered = read_terms(examples.select("id", F.col("label").cast("long").alias("row_key"), "text"), shared)
    rows = numbered.orderBy(F.xxhash64(F.lit(settings.seed), "id"), "id").toArrow()
    labels = rows["row_key"].to_pylist()
    toxic = sum(labels)
    idf = np.log(1 + n / np.maximum(1, df)) * ties(n0, n1, len(labels) - toxic, toxic, settings)
    texts = [(np.asarray(t.values, np.int32), np.asarray(c.values, np.int32)) for t, c in zip(rows["terms"], rows["counts"], strict=True)]
    index = Index(rows["id"].to_pylist(), labels, texts, np.append(idf, settings.background), settings)
    index.calibrate(settings.least_share, settings.pseudo)
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None, settings: Settings | None = None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text of `docs`.

    `labels` has an id of the documents' type and a 0/1 label; rows with a null
    id or label don't count, ids labelled twice count as 1 if either is, and
    `settings.examples` of them are learnt from: those with the least hashes,
    as many as there are otherwise. That number bounds what the driver holds
    and what is broadcast. Their texts are looked up in `texts`, or in `docs`,
    without moving others; of several texts of an id the least counts.

    Returns the id column, `row_key` (a hash of id and text), `score` (0 to 1),
    `predicted` (1 from the threshold on) and `evidence` (the three nearest
    examples: id, cosine, label), a row for each row given. Null and empty
    texts, and texts without any word of an example, score as the examples without terms do.
    Repeated rows get equal scores. Without examples every score is 0.
    """
    settings = settings or Settings()
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(settings.seed), "id"), "id").limit(settings.examples)
    chosen = stored(chosen, "chosen")  # `settings.examples` rows at most: safe to broadcast
    held = (docs if texts is None else texts).select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))
    examples = stored(held.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "examples")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("row_key"), F.col(text_col).alias("text"))
    terms, n0, n1 = count_terms(examples)
    context = docs.sparkSession.sparkContext
    numbers = context.broadcast(terms)
    read = stored(read_terms(docs, numbers), "terms")
    shared = context.broadcast(learn(read, examples, numbers, n0, n1, settings))
    told = pa.list_(pa.struct([("id", examples.limit(0).toArrow().schema.field("id").type), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            lists = part.column(2)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            scores, near = shared.value.score(lists.flatten().to_numpy(), part.column(3).flatten().to_numpy(), starts)
            evidence = pa.array([[{"id": i, "cosine": c, "label": y} for i, c, y in e] for e in near], told)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), evidence], names=["id", "row_key", "score", "predicted", "evidence"])

    out = read.mapInArrow(run, f"id {kind}, row_key long, score double, predicted int, evidence array<struct<id: {kind}, cosine: double, label: int>>")
    return out.withColumnRenamed("id", id_col)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: doc_id, toxic. Held out are ids whose CRC-32 as text has the remainder 2 by 4."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "toxic")
