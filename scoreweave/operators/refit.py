"""Hold-outs by refitting all of the matrix for each, with dense algebra: what evaluate does with impute_bivariate, without a copy of the observations
for each hold-out.

Entities lie as rows of metrics, once, and two passes read them: the first fits every pair of metrics for each hold-out, over all entities, the
second fills predictors that aren't known by those lines and takes the errors of all lines of the held metric. A hold-out's own cell is taken out where
its entity is met; batches of entities without it have the same sums of pairs for all hold-outs. Only sums of pairs (hold-outs times metrics squared)
leave a task, and only they meet on the driver, MOST_PAIRS of them at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .cells import merge_scores
from .evaluate import _errors, evaluate
from .impute import TINY, impute_bivariate

#: Hold-outs times metrics squared in one turn: 40 MB of a task's memory, and of the driver's. With more metrics than one hold-out's share, evaluate does it.
MOST_PAIRS = 2**20


def _centred(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of columns where w, and deviations from them (0 elsewhere); exactly 0 where a column is constant."""
    n = w.sum(0)
    low = np.where(n > 0, np.where(w, v, np.inf).min(0, initial=np.inf), 0.0)
    off = np.where(w, v - low, 0.0)
    mean = off.sum(0) / np.maximum(n, 1)
    return low + mean, np.where(w, off - mean, 0.0)


def _pair_sums(score: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(5, k, j): number of rows that know metrics k and j, means of k and of j, sums of products and of squares of j about them."""
    out = np.zeros((5, score.shape[1], score.shape[1]))
    for k in range(score.shape[1]):
        rows = known[:, k]
        w = known[rows]
        (mk, dk), (mj, dj) = _centred(w, score[rows, k][:, None]), _centred(w, score[rows])
        out[:, k] = w.sum(0), mk, mj, (dk * dj).sum(0), (dj * dj).sum(0)
    return out


def _error_sums(score: np.ndarray, known: np.ndarray, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(5, j), by metric m's lines from j over rows that know m: number, 0, mean of j, squared errors, squares of j about its mean. A j that a row doesn't
    know is the mean of its predictions. a, b: lines (predicted, predictor); 0 where there is none."""
    line, real, number = a != 0, np.isfinite(a) & np.isfinite(b), np.isfinite(score)
    count = known.astype(float) @ line.T.astype(float)
    guess = (np.where(known & number, score, 0.0) @ np.where(real, a, 0.0).T + known @ np.where(real, b, 0.0).T) / np.maximum(count, 1)
    if not (real.all() and number.all()):  # lines and scores that are no numbers spoil what rests on them, and no more
        guess[known @ (line & ~real).T | (known & ~number) @ line.T] = np.nan
    rows = known[:, m]
    w = (known | (count > 0))[rows] & line[m]
    x = np.where(known, score, guess)[rows]
    mean, off = _centred(w, x)
    error = np.where(w, score[rows, m][:, None] - a[m] * x - b[m], 0.0)
    return np.stack([w.sum(0), np.zeros(len(b)), mean, (error * error).sum(0), (off * off).sum(0)])


def _merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Such sums of two sets of rows as those of both; constants stay exact."""
    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1)
    k, j, w = two[1] - one[1], two[2] - one[2], one[0] * share
    return np.stack([n, one[1] + k * share, one[2] + j * share, one[3] + two[3] + k * j * w, one[4] + two[4] + j * j * w])


class _Turn:
    """Some hold-outs: (entity, place of the metric) of each; metrics: the names by place."""

    def __init__(self, metrics: list[str], held: list[tuple[str, int]]) -> None:
        self.metrics, self.held, self.at = metrics, held, defaultdict(list)
        for h, (entity, _) in enumerate(held):
            self.at[entity].append(h)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
        """(scores, whether known) of entities × metrics, and the same by hold-out where its cell goes."""
        for batch in batches:
            row, entities = batch.column("row"), batch.column("entity")
            cell, i = row.flatten(), pc.list_parent_indices(row).to_numpy()
            j = pc.index_in(cell.field("metric"), value_set=pa.array(self.metrics, cell.field("metric").type)).to_numpy(zero_copy_only=False)
            told = cell.field("score").is_valid().to_numpy(zero_copy_only=False)
            score, known = np.zeros((len(row), len(self.metrics))), np.zeros((len(row), len(self.metrics)), bool)
            known[i, j], score[i[told], j[told]] = told, cell.field("score").to_numpy(zero_copy_only=False)[told]
            changed = {}
            for r in np.flatnonzero(pc.is_in(entities, value_set=pa.array(list(self.at), entities.type)).to_numpy(zero_copy_only=False)):
                for h in self.at[entities[r].as_py()]:
                    changed[h] = score, known.copy()
                    changed[h][1][r, self.held[h][1]] = False
            yield score, known, changed

    def summed(self, rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]) -> np.ndarray:
        """sums of blocks, (5, hold-outs, ..., metrics), over all rows."""
        wide, n = len(self.metrics), len(self.held)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in self.blocks(batches):
                part = sums(*block)
                total = part if total is None else _merged(total, part)
            for h in range(n if total is not None else 0):
                lines = total[:, h].reshape(5, -1, wide)
                flat = pa.array(lines.transpose(1, 0, 2).ravel())
                column = pa.ListArray.from_arrays(pa.array(np.arange(lines.shape[1] + 1, dtype=np.int32) * 5 * wide), flat)
                k = np.arange(lines.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full_like(k, h)), pa.array(k), pa.array(np.full_like(k, TaskContext.get().partitionId())), column], ["h", "k", "part", "sums"])

        def group(table: pa.Table) -> pa.Table:
            table = table.sort_by("part").combine_chunks()
            each = table["sums"].combine_chunks().flatten().to_numpy().reshape(len(table), 5, wide)
            total = each[0]
            for x in each[1:]:
                total = _merged(total, x)
            return pa.table([table["h"][:1], table["k"][:1], pa.array([total.ravel()], pa.list_(pa.float64()))], ["h", "k", "sums"])

        parts = rows.mapInArrow(task, "h int, k int, part int, sums array<double>")
        found = parts.groupBy("h", "k").applyInArrow(group, "h int, k int, sums array<double>").toArrow().sort_by([("h", "ascending"), ("k", "ascending")]).combine_chunks()
        return found["sums"].combine_chunks().flatten().to_numpy().reshape(n, -1, 5, wide).transpose(2, 0, 1, 3)

    def fitted(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hold-out, predicted, predictor): slopes and intercepts, 0 without a line; (hold-out, metric): means; (5, hold-out, predictor): error sums."""
        context = rows.sparkSession.sparkContext

        def pairs(score: np.ndarray, known: np.ndarray, changed: dict) -> np.ndarray:
            out = np.repeat(_pair_sums(score, known)[:, None], len(self.held), 1)
            for h, own in changed.items():
                out[:, h] = _pair_sums(*own)
            return out

        _, mk, mj, cov, var = self.summed(rows, pairs)
        a = np.divide(cov, var, out=np.zeros_like(cov), where=var != 0)
        a[:, range(len(self.metrics)), range(len(self.metrics))] = 0.0
        b = np.where(a != 0, mk - a * mj, 0.0)
        lines = context.broadcast((a, b))

        def errors(score: np.ndarray, known: np.ndarray, changed: dict) -> np.ndarray:
            return np.stack([_error_sums(*changed.get(h, (score, known)), m, lines.value[0][h], lines.value[1][h]) for h, (_, m) in enumerate(self.held)], 1)

        sums = self.summed(rows, errors)[:, :, 0]
        lines.unpersist()
        return a, b, np.diagonal(mk, axis1=1, axis2=2), sums


def _estimate(x: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray, mean: float, sums: np.ndarray) -> float:
    """An entity's cell by its known metrics' lines, weighed by the inverse of their variance; the metric's mean without any."""
    use = known & (a != 0) & (sums[0] > 2)
    x, a, b, (n, _, mean_x, sse, ss) = x[use], a[use], b[use], sums[:, use]
    mse, far = sse / np.maximum(n - 2, 1), x - mean_x
    w = 1 / (np.where(ss == 0, mse, mse * (1 + 1 / n + far * far / np.where(ss == 0, 1.0, ss))) + TINY)
    return mean if w.sum() <= 0 else float((w * (a * x + b)).sum() / w.sum())


def refit_bivariate(obs: DataFrame, sample: DataFrame, whole_cell: bool = False) -> DataFrame:
    """evaluate with one pass of impute_bivariate: all lines are fitted and all predictors filled for each hold-out, from all entities."""
    cells = settle(merge_scores(obs).where("entity is not null and metric is not null").select("entity", "metric", "score"), "cells")
    sizes = {r.metric: r["count"] for r in cells.groupBy("metric").count().limit(isqrt(MOST_PAIRS) + 1).collect()}
    metrics = sorted(sizes)
    if len(metrics) ** 2 > MOST_PAIRS:
        return evaluate(obs, sample, impute_bivariate, whole_cell)
    rows = settle(cells.groupBy("entity").agg(F.collect_list(F.struct("metric", "score")).alias("row")), "rows")
    held = sample.select("holdout", "entity", "metric", F.col("ord").alias("gone")).distinct()
    stays = obs.join(held, ["entity", "metric"]).where(F.lit(not whole_cell) & ~F.coalesce(F.col("ord") == F.col("gone"), F.lit(False)))
    left = {r.holdout: r.score for r in merge_scores(stays.drop("gone"), ["holdout"]).collect()}
    entity = {r.entity: {c.metric: c.score for c in r.row} for r in rows.join(held.select("entity").distinct(), "entity").collect()}
    # An entity or a metric without any other cell goes with the one held out.
    held = [r for r in held.orderBy("holdout").collect() if r.holdout in left or (len(entity[r.entity]) > 1 and sizes[r.metric] > 1)]
    # A cell that has other observations is their mean, which is known.
    predicted = [(r.holdout, r.entity, r.metric, left[r.holdout]) for r in held if left.get(r.holdout) is not None]
    held = [r for r in held if left.get(r.holdout) is None]
    most = max(1, MOST_PAIRS // max(1, len(metrics) ** 2))
    for some in (held[i : i + most] for i in range(0, len(held), most)):
        turn = _Turn(metrics, [(r.entity, metrics.index(r.metric)) for r in some])
        a, b, means, sums = turn.fitted(rows)
        for h, r in enumerate(some):
            m, row = turn.held[h][1], entity[r.entity] | {r.metric: None}
            known = np.array([row.get(x) is not None for x in metrics])
            x = np.array([row[x] if k else 0.0 for x, k in zip(metrics, known)])
            predicted.append((r.holdout, r.entity, r.metric, _estimate(x, known, a[h, m], b[h, m], float(means[h, m]), sums[:, h])))
    schema = T.StructType([*sample.select("holdout", "entity", "metric").schema.fields, T.StructField("predicted", T.DoubleType())])
    return _errors(obs, sample, obs.sparkSession.createDataFrame(predicted, schema))
