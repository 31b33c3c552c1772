"""Embedding whitening: moments of all vectors by generated SQL aggregates, LAPACK for the small rest.

The upper triangle of the covariance is one aggregation of generated SQL
expressions: sums of the products of centred entries for every pair of
dimensions. Entries
are whole numbers, centred on the nearest whole number to their mean, so the
sums are exact, whatever the order of rows or tasks (doubles take over only
where 64 bits might not hold them); what the whole centre leaves of the mean
(at most a half) is taken off afterwards. The driver holds
one d x d matrix, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

@dataclass(frozen=True)
class Whitening:
    """What was fitted: count, sums by dimension, and the components kept, by falling eigenvalue."""

    n: int
    sums: list[int]
    #: No entry is further from its mean than this.
    reach: int
    #: Unit eigenvectors as rows, and their eigenvalues.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """Vectors as whole numbers floor(scale * c) + shift in columns x0 to x(d-1) beside `id`, stored, and d.

    Rows whose vector is null, or holds null, NaN or infinite entries, go. d is
    the most common length among the others (of equally common ones the
    longest); vectors of another length go too. Null and repeated ids stay.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND abs(CAST(c AS DOUBLE)) < double('Infinity'))")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    d = lengths["d"] if lengths else 0
    whole = rows.filter(F.size("v") == d).selectExpr("id", *[f"CAST(floor(CAST({scale} AS DOUBLE) * v[{i}]) AS BIGINT) + {shift}L AS x{i}" for i in range(d)])
    return stored(whole, "fixed_point"), d


def upper_triangle(columns: list[str]) -> list[str]:
    """SQL sums, for rows (i, a) of a dimension's number and entry beside all entries: of the products with each dimension from i on."""
    return [f"sum(CASE WHEN i <= {j} THEN a * {c} END) AS p{j}" for j, c in enumerate(columns)]


def pair_sums(centred: DataFrame, columns: list[str]) -> np.ndarray:
    """The symmetric matrix of sums of products, by one aggregation.

    Each vector gives a row for each dimension; sums of d columns in d groups
    stay inside compiled code, where d (d + 1) / 2 sums in a single group leave
    it. A task sends d rows.
    """
    d = len(columns)
    each = centred.selectExpr(*columns, f"posexplode(array({', '.join(columns)})) AS (i, a)")
    out = np.zeros((d, d), object)
    for i, *sums in each.groupBy("i").agg(*map(F.expr, upper_triangle(columns))).collect():  # d rows
        out[i, i:] = out[i:, i] = sums[i:]
    return out


def fit_whitening(points: DataFrame, d: int, components: int = 8, least: float = 1e-12) -> Whitening | None:
    """Fit to all rows of `fixed_point`; None without rows or dimensions.

    Components whose eigenvalue isn't above `least` of the trace have no
    direction to speak of (equal vectors, fewer vectors than dimensions) and
    are left out.
    """
    if not d:
        return None
    n, *told = points.selectExpr("count(*)", *[f"{f}(x{i})" for f in ("sum", "max", "min") for i in range(d)]).head()
    if not n:
        return None
    sums, most, least_x = told[:d], told[d : 2 * d], told[2 * d :]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - c * n) / n for s, c in zip(sums, centre, strict=True)])
    reach = max(a - b for a, b in zip(most, least_x, strict=True))
    kind = "BIGINT" if n * reach**2 < 1 << 63 else "DOUBLE"  # sums that may pass 64 bits are rounded
    moved = points.selectExpr(*[f"CAST(x{i} - {c}L AS {kind}) AS y{i}" for i, c in enumerate(centre)])
    cov = pair_sums(moved, [f"y{i}" for i in range(d)]).astype(np.float64) / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    kept = [i for i in range(d - 1, max(-1, d - 1 - components), -1) if values[i] > least * max(trace, 0.0) and values[i] > 0]
    return Whitening(n, sums, reach, vectors[:, kept].T, values[kept], trace)


def whiten(points: DataFrame, d: int, fit: Whitening) -> DataFrame:
    """`id`, `deviation` (the sum over dimensions of (n * x - S)^2, exact) and w1 to wk, the whitened coordinates of each row.

    A deviation beyond 64 bits is an error, not a wrong number.
    """
    means = [s / fit.n for s in fit.sums]
    off = points.selectExpr("id", *[f"x{i}" for i in range(d)], *[f"x{i} - {m!r}D AS c{i}" for i, m in enumerate(means)])
    square = " + ".join(f"({fit.n}L * x{i} - {s}L) * ({fit.n}L * x{i} - {s}L)" for i, s in enumerate(fit.sums))
    if d * (fit.n * fit.reach) ** 2 >= 1 << 63:  # may pass 64 bits: the cast tells whether it does
        square = " + ".join(f"CAST({fit.n}L * x{i} - {s}L AS DECIMAL(19, 0)) * CAST({fit.n}L * x{i} - {s}L AS DECIMAL(19, 0))" for i, s in enumerate(fit.sums))
    axes = [" + ".join(f"c{i} * {float(v) / math.sqrt(e)!r}D" for i, v in enumerate(axis)) for axis, e in zip(fit.components, fit.eigenvalues, strict=True)]
    return off.selectExpr("id", f"CAST({square} AS BIGINT) AS deviation", *[f"{axis} AS w{k + 1}" for k, axis in enumerate(axes)])


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of w1 to wk, less the identity; centred on their own means."""
    names = [f"w{i + 1}" for i in range(k)]
    means = white.selectExpr(*[f"avg({w})" for w in names]).head()
    centred = white.selectExpr(*[f"{w} - {m!r}D AS {w}" for w, m in zip(names, means, strict=True)])
    return float(np.abs(pair_sums(centred, names).astype(np.float64) / n - np.eye(k)).max())


def whiten_embeddings(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector, a row for each vector and component.

    Columns: the id, `component` (from 1, by falling eigenvalue), `n`,
    `deviation`, `whitened`, `explained` (the component's share of the trace)
    and `identity_error`. Which vectors are usable, and their fixed point, is
    told by `fixed_point`; repeated rows count and come out as often as they
    stand there. An empty table, and vectors that are all equal, have no rows.
    Other columns never reach the result.
    """
    points, d = fixed_point(vectors, id_col, vector_col)
    fit = fit_whitening(points, d, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    k = len(fit.components) if fit else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = stored(whiten(points, d, fit), "whitened")
    error = identity_error(white, k, fit.n)
    each = ", ".join(f"named_struct('component', {i + 1}, 'whitened', w{i + 1}, 'explained', {float(e) / fit.trace!r}D)" for i, e in enumerate(fit.eigenvalues))
    out = white.selectExpr("id", "deviation", f"inline(array({each}))")
    return out.selectExpr(f"id AS `{id_col}`", "component", f"{fit.n}L AS n", "deviation", "whitened", "explained", f"{error!r}D AS identity_error")
