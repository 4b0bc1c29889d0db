"""Imputers with dense linear algebra: iterated multivariate least squares, and two gradient descents.

Least squares: the Gram matrix of the filled matrix is one grouped aggregate (metrics squared rows, the lower triangle only); it
is inverted once on the driver, after a check of its size, and that one inverse gives every metric's regression on all others: what is
broadcast has metrics squared numbers. Entities are estimated in batches where they are. So entities may
be many, and metrics up to MOST_METRICS.

Gradient descents are one optimisation over all cells with one step size, so a matrix is one task's state; `by` gives many
independent matrices, which run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .impute import impute_bivariate, pair_regression

MULTIVARIATE, MULTIVARIATE_GD, CONSOLIDATED_GD = "Multivariate regression", "Multivariate gradient descent", "Consolidated bivariate gradient descent"
MOST_METRICS = 4096


def gram_matrix(filled: DataFrame) -> DataFrame:
    """(i, j, g) for metrics i >= j, and for the constant (name ''): sums of products over entities."""
    one = filled.select("entity").distinct().select("entity", F.lit("").alias("metric"), F.lit(1.0).alias("score"))
    x = filled.select("entity", "metric", "score").unionByName(one)
    left, right = x.select("entity", F.col("metric").alias("i"), F.col("score").alias("a")), x.select("entity", F.col("metric").alias("j"), F.col("score").alias("b"))
    return left.join(right, "entity").where("i >= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def independent(gram: np.ndarray, least: float = 1e-12) -> list[int]:
    """Rows of a Gram matrix with unit diagonal that don't depend on each other, as many as there are (Cholesky with pivots)."""
    n = len(gram)
    left, factor, chosen = np.diag(gram).copy(), np.zeros((n, n)), []
    for r in range(n):
        j = int(np.argmax(left))
        if left[j] <= least:
            break
        factor[:, r] = (gram[:, j] - factor[:, :r] @ factor[j, :r]) / np.sqrt(left[j])
        left -= factor[:, r] ** 2
        chosen.append(j)
        left[chosen] = 0.0
    return sorted(chosen)


class Regressions:
    """Least squares of each metric on all others, from the Gram matrix of metrics and a last constant column.

    One inverse P, of the columns that don't depend on others, serves all: regressing column k on the rest has coefficients -P[j, k] / P[k, k] and
    squared error 1 / P[k, k]. A column that depends on others, or that others depend on, is their exact sum, with no error."""

    def __init__(self, g: np.ndarray, n_entities: int) -> None:
        size = g.shape[0]
        n = size - 1
        self.scale = scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        normal = g * scale[:, None] * scale[None, :]
        self.basis = basis = np.array(independent(normal), int)
        rest = np.setdiff1d(np.arange(size), basis)
        self.inverse = inverse = np.linalg.inv(normal[np.ix_(basis, basis)]) if len(basis) else np.zeros((0, 0))
        inverse += inverse.T
        inverse /= 2
        told = inverse @ normal[np.ix_(basis, rest)]  # what the others are of the basis
        self.beta, self.sigma2, self.place = np.zeros((n, size)), np.zeros(n), np.full(n, -1)
        free = n_entities - size + 1  # entities less a metric's features and bias
        for at, k in enumerate(rest.tolist()):
            if k < n:
                self.beta[k, basis] = told[:, at]
        for at, k in enumerate(basis.tolist()):
            if k == n:
                continue
            by = int(np.argmax(np.abs(told[at]))) if len(rest) else -1
            if by >= 0 and abs(told[at, by]) > 1e-6:
                self.beta[k, basis] = -told[:, by] / told[at, by]
                self.beta[k, rest[by]] = 1 / told[at, by]
            else:
                self.beta[k, basis] = -inverse[at] / inverse[at, at]
                if free > 0:
                    self.sigma2[k], self.place[k] = 1 / inverse[at, at] / scale[k] ** 2 / free, at
            self.beta[k, k] = 0.0
        self.beta *= scale[None, :] / scale[:n, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and deviations of all metrics for rows x (metrics and the constant). A row's variance is sigma2 (1 + r' Q r), where r is the row
        without the metric and Q the inverse without it: P less the product of its column over its diagonal."""
        z = (x * self.scale)[:, self.basis]
        y = z @ self.inverse
        whole = (y * z).sum(1, keepdims=True)
        some = self.place >= 0
        at = self.place[some]
        own, diagonal = z[:, at], np.diag(self.inverse)[at]
        near = y[:, at] - own * diagonal
        variance = np.zeros((len(x), len(self.beta)))
        variance[:, some] = self.sigma2[some] * (1 + np.maximum(0.0, whole - 2 * own * y[:, at] + own * own * diagonal - near * near / diagonal))
        return x @ self.beta.T, np.sqrt(variance)


def _regressions(filled: DataFrame, metrics: list[str]) -> Regressions:
    rows = gram_matrix(filled).toPandas()  # at most MOST_METRICS squared / 2
    place = {m: i for i, m in enumerate([*metrics, ""])}
    g = np.zeros((len(place), len(place)))
    i, j = rows["i"].map(place).to_numpy(), rows["j"].map(place).to_numpy()
    g[i, j] = g[j, i] = rows["g"].to_numpy()
    return Regressions(g, int(round(g[-1, -1])))


def impute_multivariate(cells: DataFrame, iterations: int = 1) -> DataFrame:
    """Fill by weighed bivariate regression, its deviation set to the score; then, `iterations` times, estimate every missing cell by
    least squares on all other metrics of the fill before."""
    fill = impute_bivariate(cells)
    fill = settle(fill.withColumn("std_dev", F.when(F.col("is_known"), F.col("std_dev")).otherwise(F.col("score"))), "fill")
    metrics = sorted(r.metric for r in fill.select("metric").distinct().limit(MOST_METRICS + 1).collect())
    if len(metrics) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics")
    for _ in range(iterations):
        held = fill.sparkSession.sparkContext.broadcast((metrics, _regressions(fill, metrics)))

        def estimate(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, model = held.value
            for pdf in frames:
                rows = [{c["metric"]: c for c in r} for r in pdf["row"]]
                score, sd, known = (np.array([[r[m][c] for m in names] for r in rows]) for c in ("score", "std_dev", "is_known"))
                guess, guess_sd = model.predict(np.hstack([score.astype(float), np.ones((len(rows), 1))]))
                yield pd.DataFrame({
                    "entity": np.repeat(pdf["entity"].to_numpy(), len(names)), "metric": np.tile(names, len(rows)),
                    "score": np.where(known, score, guess).ravel().astype(float), "std_dev": np.where(known, sd, guess_sd).ravel().astype(float), "is_known": known.ravel().astype(bool),
                })

        rows = fill.groupBy("entity").agg(F.collect_list(F.struct("metric", "score", "std_dev", "is_known")).alias("row"))
        fill = settle(rows.mapInPandas(estimate, "entity string, metric string, score double, std_dev double, is_known boolean"), "fill")
    return fill.select("entity", "metric", "score", "std_dev", F.when(~F.col("is_known"), MULTIVARIATE).alias("source"), "is_known")


# Gradient descents


def multivariate_slopes(s: np.ndarray, known: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squared residuals of known cells, s[:, k] - alpha[k] - sum over j <> k of beta[k, j] s[:, j], and its gradients by
    alpha, beta and missing scores. The diagonal of beta is 0."""
    r = np.where(known, s - alpha - s @ beta.T, 0.0)
    by_beta = -2 * r.T @ s
    np.fill_diagonal(by_beta, 0.0)
    return float((r * r).sum()), -2 * r.sum(0), by_beta, np.where(known, 0.0, -2 * r @ beta)


def descend_multivariate(s: np.ndarray, known: np.ndarray, alpha: np.ndarray, beta: np.ndarray, iterations: int) -> np.ndarray:
    """Steps along the normalised gradient; a step that doesn't lower the loss is halved, for good."""
    step = 1.0
    for _ in range(iterations):
        loss, *slopes = multivariate_slopes(s, known, alpha, beta)
        norm = np.sqrt(sum((g * g).sum() for g in slopes))
        if norm < 1e-10:
            break
        for _ in range(100):
            a, b, t = (x - step / norm * g for x, g in zip((alpha, beta, s), slopes, strict=True))
            if multivariate_slopes(t, known, a, b)[0] < loss:
                break
            step /= 2
        else:
            break
        alpha, beta, s = a, b, t
    return s


def consolidated_slopes(s: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of known cells against the weighed mean of all lines to them (a[k, j], b[k, j] and w[k, j] predict j from k), and its
    gradients by missing scores, a, b and w. The diagonal of w is 0."""
    total = w.sum(0)
    safe = np.where(total == 0, 1.0, total)
    use = known & (total != 0)
    mean = (s @ (w * a) + (w * b).sum(0)) / safe
    e = np.where(use, mean - s, 0.0)
    q = 2 * e / safe
    by_a, by_b = w * (s.T @ q), w * q.sum(0)
    by_w = a * (s.T @ q) + b * q.sum(0) - (q * mean).sum(0)
    np.fill_diagonal(by_w, 0.0)
    return float((e * e).sum()), np.where(known, 0.0, q @ (w * a).T), by_a, by_b, by_w


def descend_consolidated(s: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, iterations: int) -> np.ndarray:
    """Steps along the normalised gradient, from 0.1 down to 1e-6."""
    w = 1.0 - np.eye(len(a))
    for turn in range(iterations):
        step = 0.1 + (1e-6 - 0.1) * turn / max(1, iterations - 1)
        _, *slopes = consolidated_slopes(s, known, a, b, w)
        norm = np.sqrt(sum((g * g).sum() for g in slopes))
        if norm < 1e-300:
            break
        s, a, b, w = (x - step / norm * g for x, g in zip((s, a, b, w), slopes, strict=True))
    return s


def _matrix(pdf: pd.DataFrame, value: str) -> pd.DataFrame:
    return pdf.pivot(index="entity", columns="metric", values=value).sort_index().sort_index(axis=1)


def _dense(filled: DataFrame, by: Sequence[str], solve, source: str) -> DataFrame:
    """Run solve(scores, known) on each matrix; cells come back with its scores where they were missing."""
    by = list(by)
    keyed = filled if by else filled.withColumn("matrix", F.lit(0))
    keys = by or ["matrix"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, known = _matrix(pdf, "score"), _matrix(pdf, "is_known").to_numpy(bool)
        found = pd.DataFrame(solve(scores.to_numpy(float), known), index=scores.index, columns=scores.columns).stack().rename("found").reset_index()
        out = pdf.merge(found, on=["entity", "metric"])
        out["score"] = np.where(out["is_known"], out["score"], out["found"])
        return out[[*keys, "entity", "metric", "score", "std_dev", "is_known"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.select(*keys, "entity", "metric", "score", "std_dev", "is_known").schema.fields)
    out = keyed.groupBy(*keys).applyInPandas(run, kinds)
    return out.select(*by, "entity", "metric", "score", "std_dev", F.when(~F.col("is_known"), source).alias("source"), "is_known")


def impute_multivariate_gd(cells: DataFrame, iterations: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """From the weighed bivariate fill and its least squares coefficients; coefficients and missing scores move together. The
    deviation is that of the fill."""

    def solve(s: np.ndarray, known: np.ndarray) -> np.ndarray:
        x = np.hstack([s, np.ones((len(s), 1))])
        model = Regressions(x.T @ x, len(s))
        return descend_multivariate(s, known, model.beta[:, -1].copy(), model.beta[:, :-1].copy(), iterations)

    return _dense(impute_bivariate(cells, 1, by), by, solve, MULTIVARIATE_GD)


def impute_consolidated_gd(cells: DataFrame, iterations: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """From the consolidated fill and the lines of all pairs; lines, weights and missing scores move together. The deviation is 0."""
    from .impute import impute_consolidated

    by = list(by)
    cells = settle(cells.select(*by, "entity", "metric", "score", "std_dev", "is_known"), "cells")
    lines = pair_regression(cells, by).groupBy(*by, F.col("bk").alias("metric")).agg(F.map_from_entries(F.collect_list(F.struct("bj", F.struct("a", "b")))).alias("lines"))
    filled = impute_consolidated(cells, by)
    # A metric's lines go with one of its cells.
    first = filled.groupBy(*by, "metric").agg(F.min("entity").alias("entity")).join(lines, [*by, "metric"], "left")
    keyed = filled.join(first, [*by, "metric", "entity"], "left") if by else filled.join(first, ["metric", "entity"], "left").withColumn("matrix", F.lit(0))
    keys = by or ["matrix"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, known = _matrix(pdf, "score"), _matrix(pdf, "is_known").to_numpy(bool)
        names = list(scores.columns)
        a, b = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
        for m, told in zip(pdf["metric"], pdf["lines"], strict=True):
            for j, line in dict(told).items() if told is not None and not isinstance(told, float) else ():
                a[names.index(j), names.index(m)], b[names.index(j), names.index(m)] = line["a"], line["b"]
        found = pd.DataFrame(descend_consolidated(scores.to_numpy(float), known, a, b, iterations), index=scores.index, columns=scores.columns).stack().rename("found").reset_index()
        out = pdf.merge(found, on=["entity", "metric"])
        out["score"] = np.where(out["is_known"], out["score"], out["found"])
        return out[[*keys, "entity", "metric", "score", "std_dev", "is_known"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.select(*keys, "entity", "metric", "score", "std_dev", "is_known").schema.fields)
    out = keyed.select(*keys, "entity", "metric", "score", "std_dev", "is_known", "lines").groupBy(*keys).applyInPandas(run, kinds)
    return out.select(*by, "entity", "metric", "score", "std_dev", F.when(~F.col("is_known"), CONSOLIDATED_GD).alias("source"), "is_known")
