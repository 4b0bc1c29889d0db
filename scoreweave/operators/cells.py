"""Observations to cells: merge, densify, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import shortest


def merge_cells(obs: DataFrame, by: Sequence[str] = (), null_as_zero: bool = True) -> DataFrame:
    """One row for each (entity, metric): the mean of its scores, their sample deviation, and where they come from, in order. A
    single observation stands as it is. Among several a null score counts as 0, unless null_as_zero is off."""
    score = F.coalesce("score", F.lit(0.0)) if null_as_zero else F.col("score")
    entry = F.struct("ord", F.concat(F.lit("Score "), shortest(score), F.lit(" at "), F.coalesce("source", F.lit(""))).alias("text"))
    out = obs.groupBy(*by, "entity", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("spread"),
        F.first("score").alias("one"), F.first("std_dev").alias("one_sd"), F.first("source").alias("one_source"),
        F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])).alias("told"),
    )
    many = F.col("n") > 1
    return out.select(
        *by, "entity", "metric", "n",
        F.when(many, F.col("mean")).otherwise(F.col("one")).alias("score"),
        F.when(many, F.coalesce("spread", F.lit(0.0))).otherwise(F.coalesce("one_sd", F.lit(0.0))).alias("std_dev"),
        F.when(many, F.concat(F.lit("Multiple: "), F.col("told"))).otherwise(F.coalesce(F.nullif("one_source", F.lit("")), F.lit("Original"))).alias("source"),
    )


def merge_scores(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """merge_cells without provenance, which the imputers don't need: sums only, combined before they are shuffled."""
    score = F.coalesce("score", F.lit(0.0))
    out = obs.groupBy(*by, "entity", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("spread"), F.max("score").alias("one"), F.max("std_dev").alias("one_sd"))
    many = F.col("n") > 1
    return out.select(
        *by, "entity", "metric",
        F.when(many, F.col("mean")).otherwise(F.col("one")).alias("score"),
        F.when(many, F.coalesce("spread", F.lit(0.0))).otherwise(F.coalesce("one_sd", F.lit(0.0))).alias("std_dev"),
    )


def densify(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every entity with every metric; a missing cell has a null score and deviation 0. The grid is the result itself, so it is as
    large as it has to be."""
    by = list(by)
    if by:
        grid = cells.select(*by, "entity").distinct().join(cells.select(*by, "metric").distinct(), by)
    else:
        grid = cells.select("entity").distinct().crossJoin(cells.select("metric").distinct())
    out = grid.join(cells, [*by, "entity", "metric"], "left")
    return out.withColumn("is_known", F.col("score").isNotNull()).withColumn("std_dev", F.coalesce("std_dev", F.lit(0.0)))


def metric_means(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the known cells of each metric; 0 without any."""
    return cells.groupBy(*by, "metric").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))


def raw_stats(obs: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over raw observations; a deviation of 0 counts as 1."""
    sd = F.stddev_pop("score")
    return obs.where("score is not null and not isnan(score)").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("std_dev"))


def cell_stats(cells: DataFrame) -> DataFrame:
    """The same over cells; a deviation of 0 stays, and a metric without scores has mean 0 and deviation 1."""
    out = cells.groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std_dev"))
    return out.select("metric", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std_dev", F.lit(1.0)).alias("std_dev"))


def metric_counts(obs: DataFrame) -> DataFrame:
    """Observations by metric name."""
    return obs.where("metric is not null and metric <> ''").groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def metric_names(obs: DataFrame) -> DataFrame:
    return obs.where("metric is not null").select("metric").distinct()


def last_by_name(obs: DataFrame) -> DataFrame:
    """One observation for each (entity, metric): the last, as a dashboard loads them."""
    rest = [c for c in obs.columns if c not in ("entity", "metric")]
    return obs.groupBy("entity", "metric").agg(F.max_by(F.struct(*rest), "ord").alias("last")).select("entity", "metric", *[F.col(f"last.{c}").alias(c) for c in rest])
