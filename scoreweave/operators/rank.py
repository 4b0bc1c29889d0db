"""Analytics on cells: composite metrics, filters, rankings, bests and history."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import score_text
from ..session import settle
from .cells import cell_stats


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df plus a number from 1 along an order. Rows are dealt into ranges of the order, numbered in each, and shifted by the
    rows of the ranges before, so no task sees them all."""
    ranges = settle(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))  # a row a task
    before = F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("range_").orderBy(*order))
    return ranges.join(sizes.select("range_", before.alias("before_")), "range_").withColumn(name, F.col("before_") + own).drop("range_", "before_")


@dataclass
class CompositeMetric:
    """A weighted list of metrics."""

    name: str
    criteria: dict[str, float] = field(default_factory=dict)

    def put(self, bench: str, weight: float) -> CompositeMetric:
        """Add a criterion or replace its weight; a user's criterion has a name and a weight above 0."""
        if not bench or not weight > 0:
            raise ValueError("a criterion needs a metric and a weight above 0")
        return CompositeMetric(self.name, {**self.criteria, bench: float(weight)})

    def drop(self, bench: str) -> CompositeMetric:
        return CompositeMetric(self.name, {k: v for k, v in self.criteria.items() if k != bench})

    def columns(self) -> list[str]:
        """Metrics by weight, the heaviest first."""
        return [b for b, _ in sorted(self.criteria.items(), key=lambda x: -x[1])]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, b, float(w)) for b, w in self.criteria.items()], "metric_name string, bench string, weight double")


def composite_scores(cells: DataFrame, criteria: DataFrame) -> DataFrame:
    """(metric_name, entity, composite): the weighted mean of z-scores; a metric without spread gives its raw score, and an entity
    without any of the metrics 0. criteria: (metric_name, bench, weight), a small table."""
    wanted = cells.join(criteria.select(F.col("bench").alias("metric")).distinct(), "metric", "left_semi")
    stats = cell_stats(wanted)
    z = F.when(F.col("sd") == 0, F.col("score")).otherwise((F.col("score") - F.col("mean")) / F.col("sd"))
    each = wanted.where("score is not null").join(stats.select("metric", "mean", F.col("std_dev").alias("sd")), "metric").withColumn("z", z)
    sums = each.join(criteria.withColumnRenamed("bench", "metric"), "metric").groupBy("metric_name", "entity").agg(F.sum(F.col("weight") * F.col("z")).alias("top"), F.sum("weight").alias("below"))
    sums = sums.select("metric_name", "entity", F.when(F.col("below") == 0, 0.0).otherwise(F.try_divide("top", "below")).alias("composite"))
    everyone = cells.select("entity").distinct().crossJoin(criteria.select("metric_name").distinct())
    return everyone.join(sums, ["metric_name", "entity"], "left").withColumn("composite", F.coalesce("composite", F.lit(0.0)))


def passing(cells: DataFrame, metric: str | None, value: float | None, below: bool = True) -> DataFrame:
    """Entities whose score of a metric is below (or above) a value; all of them without a metric or value."""
    if not metric or value is None:
        return cells.select("entity").distinct()
    test = F.col("score") < value if below else F.col("score") > value
    return cells.where((F.col("metric") == metric) & test).select("entity").distinct()


def ranking(scores: DataFrame) -> DataFrame:
    """scores (entity, composite) with rank, the best first, names deciding between equals."""
    return numbered(scores, "rank", F.desc("composite"), F.asc("entity"))


def by_name(entities: DataFrame) -> DataFrame:
    return entities.orderBy(F.collate("entity", "UNICODE"), "entity")


def name_places(entities: DataFrame) -> DataFrame:
    """entities plus place, from 1, in the order of by_name."""
    return numbered(entities, "place", F.collate("entity", "UNICODE"), F.asc("entity"))


def chart_points(cells: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """(entity, x, y): a metric's score and the composite, where both are numbers."""
    x = cells.where((F.col("metric") == metric) & F.col("score").isNotNull()).select("entity", F.col("score").alias("x"))
    return x.join(scores.select("entity", F.col("composite").alias("y")), "entity")


def company_best(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """(company, best, index): each company's best composite, from 0."""
    best = scores.join(entities.select("entity", "company"), "entity").groupBy("company").agg(F.max("composite").alias("best"))
    return numbered(best, "index", F.desc("best"), F.asc("company")).withColumn("index", F.col("index") - 1)


def plottable_companies(points: DataFrame, entities: DataFrame) -> DataFrame:
    return points.join(entities.select("entity", "company"), "entity").select("company").distinct()


def visible(points: DataFrame, hidden: list[str] | None = None, isolated: str | None = None) -> DataFrame:
    """Points of the isolated company, or of all that aren't hidden."""
    if isolated is not None:
        return points.where(F.col("company") == isolated)
    return points.where(~F.col("company").isin(hidden)) if hidden else points


def running_best(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that beat all earlier ones of their company, by release date."""
    rows = scores.join(entities.select("entity", "company", "release_date", "ord"), "entity").where("release_date is not null and composite is not null and not isnan(composite)")
    before = F.max("composite").over(W.partitionBy("company").orderBy("release_date", "ord").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before", before).where("before is null or composite > before").select("company", "entity", "release_date", "composite")


def by_metric(cells: DataFrame, metric: str) -> DataFrame:
    """(entity, score) of a metric, the best first; a missing one counts as 0."""
    one = cells.where(F.col("metric") == metric).select("entity", "score")
    return cells.select("entity").distinct().join(one, "entity", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "entity")


def table_texts(cells: DataFrame) -> DataFrame:
    """(entity, metric, text): scores with their interval."""
    return cells.select("entity", "metric", score_text(F.col("score"), F.col("std_dev")).alias("text"))


def text_table(cells: DataFrame, metrics: list[str], width: int = 12) -> DataFrame:
    """One line an entity: truncated scores of the metrics, padded, with twice the deviation if there is one."""
    some = F.when(F.col("std_dev") != 0, F.concat(F.lit("±"), F.round(2 * F.col("std_dev")).cast("long").cast("string"))).otherwise("")
    text = F.when(F.col("score").isNotNull(), F.concat(F.col("score").cast("long").cast("string"), some))
    wide = cells.where(F.col("metric").isin(metrics)).withColumn("text", text).groupBy("entity").pivot("metric", metrics).agg(F.first("text"))
    return wide.select(F.concat_ws(" ", F.rpad("entity", width, " "), *[F.rpad(F.coalesce(F.col(f"`{m}`"), F.lit("")), width, " ") for m in metrics]).alias("line"))
