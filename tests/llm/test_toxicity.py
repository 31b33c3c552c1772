"""The index against dense cosines, and held-out accuracy."""

import math
import random

import numpy as np

from tallyforge.llm.toxicity import Index, Settings, fit_votes, learnable, score_toxicity


def test_index_is_exact():
    rng = random.Random(1)
    texts = []
    for _ in range(700):
        t = sorted(rng.sample(range(31), rng.randrange(6)))
        texts.append((np.array(t, np.int32), np.array([rng.randrange(1, 50 if x == 30 else 9) for x in t], np.int32)))
    idf = np.array([rng.uniform(0.5, 5) for _ in range(30)] + [0.3])

    def unit(t, tf):
        v = np.zeros(31)
        for a, n in zip(t, tf, strict=True):
            v[a] = (1 + math.log(n)) * idf[a]
        return v / (np.linalg.norm(v) or 1)

    for ahead, block in ((1, 16), (4, 64), (2, 1000)):
        index = Index(list(range(700)), [rng.randrange(2) for _ in texts], texts, idf, Settings(neighbours=12, block=block, first_blocks=ahead))
        dense = np.stack([unit(*texts[i]) for i in index.ids])
        asked = [texts[rng.randrange(700)] for _ in range(200)] + [(np.empty(0, np.int32), np.empty(0, np.int32))] * 2
        starts = np.cumsum([0, *(len(t) for t, _ in asked)])
        terms, counts = (np.concatenate(x) for x in zip(*asked, strict=True))
        weights = index.unit(terms, counts, starts)
        leave = np.array([rng.randrange(700) for _ in asked])
        for out in (None, leave):
            docs, cosines = index.nearest(terms, weights, starts, out)
            for i, x in enumerate(asked):
                want = np.round(dense @ unit(*x), 9)
                if out is not None:
                    want[out[i]] = 0
                best = np.lexsort((np.arange(700), -want))[:12]
                best = best[want[best] > 0]
                assert docs[i, : len(best)].tolist() == best.tolist() and np.allclose(cosines[i, : len(best)], want[best]) and (cosines[i, len(best) :] == 0).all()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id")
    scored = score_toxicity(docs, learnable(labels)).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in scored)
    assert hit >= 0.9 * sum(r.toxic for r in scored) and hit >= 0.9 * sum(r.predicted for r in scored)
    assert all(0 <= r.score <= 1 for r in scored)


def test_odd_rows(spark):
    bad = "you worthless clown of a person are here "
    train = [(i, bad * (1 + i % 3) + f"word{i}", 1) for i in range(40)] + [(100 + i, f"the quiet river number {i} went by the town", 0) for i in range(90)] + [(None, bad, 1), (500, None, 0), (501, "x", None)]
    labelled = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(1, bad, "p"), (2, None, "p"), (3, "", "p"), (None, "quiet river", "p"), (1, bad, "p"), (4, "river " * 20000, "p"), (5, f"the river {bad}", "p")], "doc_id long, text string, score string")
    got = score_toxicity(docs, labelled, labelled).collect()
    assert len(got) == 7 and {(r.doc_id, r.predicted) for r in got} == {(1, 1), (2, 0), (3, 0), (None, 0), (4, 0), (5, 1)}
    assert all(len(r.evidence) == 3 and r.evidence[0].label == 1 for r in got if r.predicted)
    assert score_toxicity(docs.limit(0), labelled, labelled).count() == 0
    assert {r.score for r in score_toxicity(docs, labelled.limit(0), labelled).collect()} == {0.0}
    # Ids of any type; of several texts of a labelled id the least counts.
    words = spark.createDataFrame([(f"k{i}", t, y) for i, t, y in train if y is not None] + [("k1", "the aaa river", 1), ("k1", None, 1)], "doc_id string, text string, toxic int")
    got = score_toxicity(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), words, words).collect()
    assert {(r.doc_id, r.predicted) for r in got} == {("d1", 1), ("d2", 0), ("d3", 0), (None, 0), ("d4", 0), ("d5", 1)} and all(e.id.startswith("k") for r in got for e in r.evidence)


def test_every_word_of_the_examples_is_searched(spark):
    bad = "you worthless clown of a person are here"
    train = [(i, f"{bad} word{chr(97 + i % 26)}{chr(97 + i // 26)}", 1) for i in range(200)] + [(1000 + i, f"the quiet river number {chr(97 + i % 26)}{chr(97 + i // 26)}x went by the town", 0) for i in range(400)]
    train += [(500, "zorgblat fits nobody", 1), (501, "what zorgblat ever", 1), (1500, "lanterns along the quay", 0)]
    labelled = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(1, "zorgblat"), (2, "lanterns by the quay"), (3, "zzz"), (1, "zorgblat")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(docs, labelled, labelled).collect()}
    assert {e.id for e in got[1].evidence} == {500, 501} and all(e.label == 1 for e in got[1].evidence)
    assert got[2].evidence[0].id == 1500 and got[2].evidence[0].label == 0
    assert got[3].evidence == [] and got[1].score > got[2].score


def test_fit_against_brute_force():
    """The best rising fit by squares over the first pools, found by trying every way to join neighbours."""
    rng = random.Random(2)
    for _ in range(60):
        told = [(round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(rng.randrange(1, 40))]
        xs, ys = fit_votes(told, 0.2, 4, 0.0)
        runs = []
        for v, y in sorted(told):
            if runs and (len(runs[-1]) < 4 or runs[-1][-1][0] == v):
                runs[-1].append((v, y))
            else:
                runs.append([(v, y)])
        if len(runs) > 1 and len(runs[-1]) < 4:
            runs[-2:] = [runs[-2] + runs[-1]]
        best = None
        for cut in range(2 ** (len(runs) - 1)):
            pools = [list(runs[0])]
            for i, run in enumerate(runs[1:]):
                if cut >> i & 1:
                    pools.append(list(run))
                else:
                    pools[-1] = pools[-1] + run
            means = [sum(y for _, y in p) / len(p) for p in pools]
            if all(a < b for a, b in zip(means, means[1:], strict=False)):
                loss = sum((y - m) ** 2 for p, m in zip(pools, means, strict=True) for _, y in p)
                if best is None or loss < best[0] - 1e-12:
                    best = loss, [sum(v for v, _ in p) / len(p) for p in pools], means
        assert np.allclose(xs, best[1]) and np.allclose(ys, best[2])


def test_one_odd_label_moves_no_clean_text_over_the_threshold():
    clean, toxic = [(0.01 + i / 10000, 0.0) for i in range(900)], [(0.8 + i / 10000, 1.0) for i in range(100)]
    for at in (0, 450, 899):
        odd = [(v, 1.0 if i == at else y) for i, (v, y) in enumerate(clean)]
        xs, ys = fit_votes(odd + toxic, 0.1, 20, 4.0)
        assert max(np.interp([v for v, _ in clean[:880]], xs, ys)) < 0.3 and min(np.interp([v for v, _ in toxic], xs, ys)) > 0.5


def test_scores_are_the_fit_of_votes(spark):
    """Every score by hand: dense cosines in the weights of the index, closeness-weighted votes, the fit between its pools."""
    rng = random.Random(5)
    names = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gorse"]
    train = [(i, " ".join(rng.choice(names) for _ in range(6)) + (" vile rotten" if i % 3 == 0 else " calm"), int(i % 3 == 0)) for i in range(150)]
    labelled = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(1000 + i, " ".join(rng.choice([*names, "vile", "calm", "rotten"]) for _ in range(5))) for i in range(60)], "doc_id long, text string")
    settings = Settings(neighbours=7)
    import tallyforge.llm.toxicity as toxicity

    seen, real = [], toxicity.learn
    toxicity.learn = lambda *a: seen.append(real(*a)) or seen[0]
    try:
        got = {r.doc_id: r for r in score_toxicity(docs, labelled, labelled, settings).collect()}
    finally:
        toxicity.learn = real
    index, terms = seen[0], sorted({t for _, x, _ in train for w in x.split() for t in toxicity.terms_of(w)})
    texts = {i: x for i, x, _ in train}

    def unit(text):
        v = np.zeros(len(terms))
        for w in text.split():
            for t in toxicity.terms_of(w):
                v[terms.index(t)] += 1
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * index.idf[:-1]
        return v / np.linalg.norm(v)

    dense = np.stack([unit(texts[i]) for i in index.ids])
    for r in docs.collect():
        cosines = np.round(dense @ unit(r.text), 9)
        near = [i for i in np.lexsort((np.arange(len(cosines)), -cosines))[:7] if cosines[i] > 0]
        w = np.array([1 / (1.05 - min(cosines[i], 1.0)) for i in near])
        vote = (sum(w * np.array([texts and train[index.ids[i]][2] for i in near])) + index.prior) / (w.sum() + 1)
        assert abs(got[r.doc_id].score - np.interp(vote, *index.fit)) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
