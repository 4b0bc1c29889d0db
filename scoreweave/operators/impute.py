"""Imputers that are relational throughout: mean, weighed bivariate, consolidated bivariate.

cells: (entity, metric, score, std_dev, is_known) of the whole grid, as densify gives it; `by` names further key columns, so that
many matrices (such as hold-outs) are filled in one job. Pair statistics have metrics squared rows; Spark broadcasts them as
long as that is small and joins by sorting beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .cells import metric_means

BIVARIATE, CONSOLIDATED, MEAN = "Weighed bivariate regression", "Bivariate regression", "Mean prediction"
#: Added to a variance before it is inverted (fixed value).
TINY = 1e-15


def _known(cells: DataFrame, by: Sequence[str], metric: str, score: str) -> DataFrame:
    return cells.where("score is not null").select(*by, "entity", F.col("metric").alias(metric), F.col("score").alias(score))


def impute_mean(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = cells.join(metric_means(cells, by), [*by, "metric"])
    missing = F.col("score").isNull()
    return out.select(
        *by, "entity", "metric", F.coalesce("score", "mean").alias("score"), F.when(missing, F.abs("mean")).otherwise(F.col("std_dev")).alias("std_dev"),
        F.when(missing, MEAN).alias("source"), "is_known",
    )


def pair_regression(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each pair of metrics (bk predicted, bj predictor) with co-known entities: n, slope a and intercept b of the least
    squares line. One pass: Spark's covariance is updated stably, and is exactly 0 where a side is constant."""
    both = _known(cells, by, "bk", "sk").join(_known(cells, by, "bj", "sj"), [*by, "entity"]).where("bk <> bj")
    out = both.groupBy(*by, "bk", "bj").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("sk", "sj").alias("cov"), F.var_pop("sj").alias("var"), F.avg("sk").alias("mk"), F.avg("sj").alias("mj"))
    out = out.withColumn("a", F.when(F.col("var") == 0, 0.0).otherwise(F.try_divide("cov", "var")))
    return out.select(*by, "bk", "bj", "n", "a", (F.col("mk") - F.col("a") * F.col("mj")).alias("b"))


def _predictions(cells: DataFrame, open_cells: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(entity, bk, bj, x, p) for the open cells, from each other known metric of the entity."""
    out = open_cells.select(*by, "entity", F.col("metric").alias("bk")).join(_known(cells, by, "bj", "x"), [*by, "entity"]).join(pairs.select(*by, "bk", "bj", "a", "b"), [*by, "bk", "bj"])
    return out.select(*by, "entity", "bk", "bj", "x", (F.col("a") * F.col("x") + F.col("b")).alias("p"))


def pair_errors(cells: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each pair with a slope: n, mean and squared deviations of the predictor, and the error of the line, over all entities
    that know bk. A predictor that an entity doesn't know is the mean of its predictions."""
    unknown = cells.where("score is null")
    guess = _predictions(cells, unknown, pairs, by).groupBy(*by, "entity", F.col("bk").alias("bj")).agg(F.avg("p").alias("x"))
    x = _known(cells, by, "bj", "x").unionByName(guess)
    rows = _known(cells, by, "bk", "s").join(x, [*by, "entity"]).join(pairs.select(*by, "bk", "bj", "a", "b"), [*by, "bk", "bj"])
    off = F.col("s") - F.col("a") * F.col("x") - F.col("b")
    out = rows.groupBy(*by, "bk", "bj").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.var_pop("x").alias("var_x"), F.sum(off * off).alias("sse"))
    return out.select(*by, "bk", "bj", "n", "mean_x", (F.col("var_x") * F.col("n")).alias("ss_x"), (F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1))).alias("mse"))


def _bivariate_pass(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """cells with a flag `open`; estimates for the open ones."""
    pairs = settle(pair_regression(cells, by).where("a <> 0"), "pairs")
    errors = pair_errors(cells, pairs, by)
    guesses = _predictions(cells, cells.where("open"), pairs, by).join(errors, [*by, "bk", "bj"])
    far = F.col("x") - F.col("mean_x")
    spread = F.when(F.col("ss_x") == 0, F.col("mse")).otherwise(F.col("mse") * (1 + 1 / F.col("n") + F.try_divide(far * far, F.col("ss_x"))))
    # An infinite variance has no weight.
    guesses = guesses.where("n > 2").withColumn("v", spread).withColumn("w", 1 / (F.col("v") + TINY))
    sums = guesses.groupBy(*by, "entity", F.col("bk").alias("metric")).agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("p")).alias("swp"), F.sum(F.col("w") * F.col("w") * F.col("v")).alias("swwv")
    )
    # Predictors are taken to have covariance 1: the sum over pairs of weights is the squared sum less the sum of squares.
    variance = (F.col("swwv") + F.col("sw") * F.col("sw") - F.col("sww")) / (F.col("sw") * F.col("sw"))
    sums = sums.where("sw > 0").select(*by, "entity", "metric", (F.col("swp") / F.col("sw")).alias("guess"), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("guess_sd"))
    out = cells.join(sums, [*by, "entity", "metric"], "left").join(metric_means(cells, by), [*by, "metric"], "left")
    return out.select(
        *by, "entity", "metric",
        F.when(F.col("open"), F.coalesce("guess", "mean")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("open"), F.coalesce("guess_sd", F.abs("mean"))).otherwise(F.col("std_dev")).alias("std_dev"),
        F.when(F.col("open"), BIVARIATE).alias("source"), "is_known", "open",
    )


def impute_bivariate(cells: DataFrame, iterations: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Weighed bivariate regression: every known metric of an entity predicts a missing one by its line; predictions are weighed by the
    inverse of their variance, and the mean stands in where there is none. Further iterations estimate the same cells from the
    filled matrix."""
    out = settle(cells.select(*by, "entity", "metric", "score", "std_dev", "is_known").withColumn("open", F.col("score").isNull()), "cells")
    for turn in range(iterations):
        out = _bivariate_pass(out, by)
        if turn + 1 < iterations:
            out = settle(out, "cells")
    return out.drop("open")


def impute_consolidated(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean + sum of both slopes times the deviation, over the sum of 1 + the reverse slope squared, for all known metrics."""
    cells = settle(cells.select(*by, "entity", "metric", "score", "std_dev", "is_known"), "cells")
    pairs = settle(pair_regression(cells, by).select(*by, "bk", "bj", "a"), "pairs")
    means = metric_means(cells, by)
    back = pairs.select(*by, F.col("bj").alias("bk"), F.col("bk").alias("bj"), F.col("a").alias("back"))
    each = cells.where("score is null").select(*by, "entity", F.col("metric").alias("bk")).join(_known(cells, by, "bj", "s"), [*by, "entity"])
    each = each.join(means.withColumnRenamed("metric", "bj"), [*by, "bj"]).join(pairs, [*by, "bk", "bj"], "left").join(back, [*by, "bk", "bj"], "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("back", F.lit(0.0))
    sums = each.groupBy(*by, "entity", F.col("bk").alias("metric")).agg((F.sum((a + b) * (F.col("s") - F.col("mean"))) / F.sum(1 + b * b)).alias("shift"))
    out = cells.join(means, [*by, "metric"], "left").join(sums, [*by, "entity", "metric"], "left")
    missing = F.col("score").isNull()
    return out.select(
        *by, "entity", "metric", F.coalesce("score", F.col("mean") + F.coalesce("shift", F.lit(0.0))).alias("score"),
        F.when(missing, 0.0).otherwise(F.col("std_dev")).alias("std_dev"), F.when(missing, CONSOLIDATED).alias("source"), "is_known",
    )
