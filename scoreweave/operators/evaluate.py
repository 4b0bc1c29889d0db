"""Accuracy of imputers by holding observations out: all hold-outs are filled in one job, by a hold-out key.

evaluate refits everything for each hold-out, with any imputer. Since a hold-out changes one cell, evaluate_mean and evaluate_bivariate fit all
of the matrix once and refit only what that cell's metric takes part in: entities times metrics rows a hold-out, not times metrics squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import z_score
from ..session import settle
from .cells import densify, merge_scores, raw_stats
from .impute import TINY, impute_bivariate, pair_regression


def holdout_sample(obs: DataFrame, n: int = 100, seed: int = 12345) -> DataFrame:
    """n known observations (entity, metric, source, ord, truth, holdout): the first by a seeded hash, which any engine can make."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "entity", "metric", F.col("ord").cast("string")).cast("binary"))
    known = obs.where("score is not null and not isnan(score)").withColumn("key", key)
    return known.orderBy("key").limit(n).select("entity", "metric", "source", "ord", F.col("score").alias("truth"), F.col("key").alias("holdout"))


def held_out(obs: DataFrame, sample: DataFrame, whole_cell: bool = False) -> DataFrame:
    """obs for each hold-out, without the observation held out (or without its whole cell)."""
    keys = ["entity", "metric"] if whole_cell else ["entity", "metric", "ord"]
    each = obs.crossJoin(sample.select("holdout"))  # the sample is bounded by its parameter
    return each.join(sample.select(*keys, "holdout"), [*keys, "holdout"], "left_anti")


def evaluate(obs: DataFrame, sample: DataFrame, impute: Callable[..., DataFrame] = impute_bivariate, whole_cell: bool = False) -> DataFrame:
    """(holdout, entity, metric, truth, predicted, error): z-scores' difference for each hold-out."""
    cells = densify(merge_scores(held_out(obs, sample, whole_cell), ["holdout"]), ["holdout"])
    filled = impute(cells, by=["holdout"])
    return _errors(obs, sample, filled.select("holdout", "entity", "metric", F.col("score").alias("predicted")))


def _errors(obs: DataFrame, sample: DataFrame, predicted: DataFrame) -> DataFrame:
    found = sample.join(predicted, ["holdout", "entity", "metric"]).join(raw_stats(obs).select("metric", "mean", "std_dev"), "metric")
    z = lambda c: z_score(F.col(c), F.col("mean"), F.col("std_dev"))
    return found.select("holdout", "entity", "metric", "truth", "predicted", (z("predicted") - z("truth")).alias("error"))


class _Holdouts:
    """known: (entity, metric, score) of all known cells; left: the held cells (holdout, entity, metric) that other observations still tell, with
    their score; open: the others, of entities and metrics that are still there; others: (holdout, entity, metric, s), the known cells of an open
    one's metric."""

    def __init__(self, obs: DataFrame, sample: DataFrame, whole_cell: bool) -> None:
        self.known = settle(merge_scores(obs).where("score is not null").select("entity", "metric", "score"), "known")
        held = sample.select("holdout", "entity", "metric", F.col("ord").alias("gone"))
        mine = obs.join(held, ["entity", "metric"]).where(F.lit(False) if whole_cell else F.col("ord") != F.col("gone"))
        self.left = merge_scores(mine.drop("gone"), ["holdout"]).where("score is not null").select("holdout", "entity", "metric", F.col("score").alias("predicted"))
        held = held.select("holdout", F.col("entity").alias("target"), "metric")
        there = self.known.select(F.col("entity").alias("target"), F.col("metric").alias("other"))
        held = held.join(self.left.select("holdout"), "holdout", "left_anti")
        self.open = settle(held.join(there, "target").where("other <> metric").select(held.columns).distinct(), "holdouts")
        self.others = self.known.join(self.open, "metric").where("entity <> target").select("holdout", "entity", "metric", F.col("score").alias("s"))

    def predicted(self, guesses: DataFrame) -> DataFrame:
        return self.left.unionByName(self.open.join(guesses, "holdout").select("holdout", F.col("target").alias("entity"), "metric", "predicted"))


def evaluate_mean(obs: DataFrame, sample: DataFrame, whole_cell: bool = False) -> DataFrame:
    """evaluate with impute_mean."""
    h = _Holdouts(obs, sample, whole_cell)
    return _errors(obs, sample, h.predicted(h.others.groupBy("holdout").agg(F.avg("s").alias("predicted"))))


def evaluate_bivariate(obs: DataFrame, sample: DataFrame, whole_cell: bool = False) -> DataFrame:
    """evaluate with one pass of impute_bivariate.

    m is a hold-out's metric, j any other. The lines of m and j are fitted anew without the cell; a predictor j that an entity doesn't know is the
    mean of its predictions from all metrics it knows, of which only the one from m has changed."""
    h = _Holdouts(obs, sample, whole_cell)
    known = h.known
    pairs = settle(pair_regression(known).where("a <> 0").select("bk", "bj", "a", "b"), "pairs")
    metrics = known.select(F.col("metric").alias("j")).distinct()
    unknown = known.select("entity").distinct().crossJoin(metrics).join(known.select("entity", F.col("metric").alias("j")), ["entity", "j"], "left_anti")
    # Sums of the predictions of all cells that aren't known: the grid itself.
    sums = unknown.join(known.select("entity", F.col("metric").alias("bj"), "score"), "entity").join(pairs.withColumnRenamed("bk", "j"), ["j", "bj"])
    sums = settle(sums.groupBy("entity", "j").agg(F.sum(F.col("a") * F.col("score") + F.col("b")).alias("sum"), F.count(F.lit(1)).alias("n")), "sums")
    others = settle(h.others, "others")
    # Lines of m by j (a, b) and of j by m (back, shift).
    both = others.join(known.select("entity", F.col("metric").alias("j"), F.col("score").alias("x")), "entity").where("j <> metric")
    lines = both.groupBy("holdout", "metric", "j").agg(F.covar_pop("s", "x").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("s").alias("vs"), F.avg("s").alias("ms"), F.avg("x").alias("mx"))
    slope = lambda v: F.when(F.col(v) == 0, 0.0).otherwise(F.try_divide("cov", v))
    lines = lines.withColumns({"a": slope("vx"), "back": slope("vs")}).withColumns({"b": F.col("ms") - F.col("a") * F.col("mx"), "shift": F.col("mx") - F.col("back") * F.col("ms")})
    lines = settle(lines.select("holdout", "metric", "j", "a", "b", "back", "shift"), "lines")
    # A predictor that isn't known: the old mean, less the old prediction from m, plus the new one.
    old = pairs.select(F.col("bk").alias("j"), F.col("bj").alias("metric"), F.col("a").alias("old_a"), F.col("b").alias("old_b"))
    guess = others.join(unknown, "entity").where("j <> metric").join(sums, ["entity", "j"], "left").join(old, ["j", "metric"], "left").join(lines.select("holdout", "j", "back", "shift"), ["holdout", "j"], "left")
    was, now = F.col("old_a").isNotNull(), F.coalesce(F.col("back") != 0, F.lit(False))
    total = F.coalesce("sum", F.lit(0.0)) - F.when(was, F.col("old_a") * F.col("s") + F.col("old_b")).otherwise(0.0) + F.when(now, F.col("back") * F.col("s") + F.col("shift")).otherwise(0.0)
    count = F.coalesce("n", F.lit(0)) - was.cast("int") + now.cast("int")
    guess = guess.where(count > 0).select("holdout", "entity", "j", "s", (total / count).alias("x"))
    rows = both.select("holdout", "entity", "j", "s", "x").unionByName(guess).join(lines.where("a <> 0").select("holdout", "j", "a", "b"), ["holdout", "j"])
    off = F.col("s") - F.col("a") * F.col("x") - F.col("b")
    errors = rows.groupBy("holdout", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.var_pop("x").alias("var_x"), F.sum(off * off).alias("sse"), F.first("a").alias("a"), F.first("b").alias("b")).where("n > 2")
    mine = h.open.join(known.select(F.col("entity").alias("target"), F.col("metric").alias("j"), F.col("score").alias("x")), "target").where("j <> metric").join(errors, ["holdout", "j"])
    far, mse, ss = F.col("x") - F.col("mean_x"), F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1)), F.col("var_x") * F.col("n")
    w = 1 / (F.when(ss == 0, mse).otherwise(mse * (1 + 1 / F.col("n") + F.try_divide(far * far, ss))) + TINY)
    told = mine.withColumn("w", w).groupBy("holdout").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * (F.col("a") * F.col("x") + F.col("b"))).alias("swp")).where("sw > 0")
    means = others.groupBy("holdout").agg(F.avg("s").alias("mean"))
    return _errors(obs, sample, h.predicted(means.join(told, "holdout", "left").select("holdout", F.coalesce(F.col("swp") / F.col("sw"), F.col("mean")).alias("predicted"))))


def mean_squared_error(errors: DataFrame) -> DataFrame:
    """(tests, mse, rmse)."""
    mse = F.avg(F.col("error") * F.col("error"))
    return errors.where("error is not null").agg(F.count(F.lit(1)).alias("tests"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def moving_average(seconds: list[float], alpha: float = 1 / 32) -> float | None:
    """Exponential moving average of step times, the latest weighing alpha; what a progress report shows."""
    average = None
    for s in seconds:
        average = s if average is None else average + alpha * (s - average)
    return average
