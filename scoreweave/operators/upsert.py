"""Upserts of feed rows into observations, without a table format that merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FED


def _merged(existing: DataFrame, updates: DataFrame, keys: list[str], order: int) -> DataFrame:
    """The first existing observation of a key takes the update's score and source; a key without one gets a new observation."""
    new = updates.groupBy(*keys).agg(F.max_by(F.struct("score", "source") if "source" not in keys else F.struct("score"), "ord").alias("new"))
    first = existing.groupBy(*keys).agg(F.min("ord").alias("ord")).withColumn("is_first", F.lit(True))
    old = existing.join(first, [*keys, "ord"], "left").join(new, keys, "left")
    hit = F.coalesce(F.col("is_first"), F.lit(False)) & F.col("new").isNotNull() & ~F.col("score").eqNullSafe(F.col("new.score"))
    source = F.col("source") if "source" in keys else F.when(hit, F.col("new.source")).otherwise(F.col("source"))
    kept = old.select("entity", "metric", F.when(hit, F.col("new.score")).otherwise(F.col("score")).alias("score"), F.when(hit, F.lit(None).cast("double")).otherwise(F.col("std_dev")).alias("std_dev"), source.alias("source"), "ord", F.when(hit, "replaced").otherwise("kept").alias("action"))
    added = new.join(first.select(*keys), keys, "left_anti")
    added = added.select("entity", "metric", F.col("new.score").alias("score"), F.lit(None).cast("double").alias("std_dev"), (F.col("source") if "source" in keys else F.col("new.source")).alias("source"), F.lit(order).cast("long").alias("ord"), F.lit("appended").alias("action"))
    return kept.unionByName(added)


def upsert_by_source(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Observations after an upsert keyed by entity, metric and source, with the action taken."""
    return _merged(existing, updates, ["entity", "metric", "source"], FED)


def upsert_by_metric(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """The same keyed by entity and metric: the first observation of a metric is replaced, whatever its source."""
    return _merged(existing, updates, ["entity", "metric"], FED)
