"""Whitening against numpy over all rows, and odd rows."""

import math

import numpy as np
import pytest

from tallyforge.llm.queries import op12_whitening
from tallyforge.llm.whitening import fit_whitening, fixed_point, pair_sums, whiten_embeddings


def by_hand(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return deviation, centred, values[::-1], axes.T[::-1], np.trace(cov)


def check(rows, vectors, ids, d):
    deviation, centred, values, axes, trace = by_hand(vectors)
    k = min(8, d)
    assert len(rows) == len(ids) * k
    at = {v: i for i, v in enumerate(ids)}
    white = np.zeros((len(ids), k))
    for r in rows:
        i, c = at[r.vec_id], r.component - 1
        assert r.n == len(ids) and r.deviation == deviation[i]
        assert abs(r.explained - values[c] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9
        white[i, c] = r.whitened
    for c in range(k):
        want = centred @ axes[c] / math.sqrt(values[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-7  # one sign for all rows
    assert np.abs(white.T @ white / len(ids) - np.eye(k)).max() < 1e-8


def test_query_against_numpy(spark):
    rows = op12_whitening(spark, "/root/testdata/sf0.001").collect()
    src = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check(rows, [r.embedding for r in src], [r.vec_id for r in src], len(src[0].embedding))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(size=3) * [3, 2, 1]]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, []), (105, [1.0])]
    df = spark.createDataFrame([(i, v, 9.0, "x") for i, v in good + odd], "vec_id long, embedding array<double>, whitened double, id string")
    check(whiten_embeddings(df).collect(), [v for _, v in good], [i for i, _ in good], 3)
    twice = whiten_embeddings(df.filter("vec_id < 20").union(df.filter("vec_id < 20")).union(spark.createDataFrame([(None, [0.5, 0.5, 0.5], 0.0, "")], df.schema)), components=2)
    assert twice.count() == 82 and twice.filter("vec_id IS NULL").count() == 2 and {r.n for r in twice.select("n").collect()} == {41}
    assert whiten_embeddings(df.limit(0)).count() == 0 and whiten_embeddings(df.limit(0)).columns == twice.columns
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whiten_embeddings(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten_embeddings(line).collect()} == {1}
    words = spark.createDataFrame([(f"k{i}", [float(i), float(i * i)]) for i in range(6)], "vec_id string, embedding array<double>")
    assert whiten_embeddings(words).count() == 12


def test_large_sums_are_exact_or_refused(spark):
    far = spark.createDataFrame([(i, [float(i * 1000), float(-i * i)]) for i in range(60)], "vec_id long, embedding array<double>")
    check(whiten_embeddings(far).collect(), [r.embedding for r in far.collect()], list(range(60)), 2)
    farther = spark.createDataFrame([(i, [float(i * 10**10), float(-i)]) for i in range(60)], "vec_id long, embedding array<double>")
    fit = fit_whitening(*fixed_point(farther))
    assert abs(fit.eigenvalues[0] / (1024e10**2 * np.var(np.arange(60))) - 1) < 1e-9
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        whiten_embeddings(farther).collect()


def test_pair_sums(spark):
    points, d = fixed_point(spark.createDataFrame([(i, [i + 0.5, i * i / 2, -i / 4]) for i in range(9)], "vec_id long, embedding array<double>"))
    x = np.array([[r[f"x{i}"] for i in range(d)] for r in points.collect()])
    assert (pair_sums(points, ["x0", "x1", "x2"]).astype(np.int64) == x.T @ x).all()
