"""Writers: nested documents, reports and tab-separated lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import slug
from ..functions.numbers import finite


def nested(cells: DataFrame, entities: DataFrame) -> DataFrame:
    """One row an entity, with its information and its cells in the order of metrics; numbers that JSON hasn't become null."""
    entry = F.struct(F.col("metric").alias("name"), finite(F.col("score")).alias("score"), "source", finite(F.col("std_dev")).alias("stdDev"))
    lists = cells.groupBy("entity").agg(F.array_sort(F.collect_list(entry)).alias("benchmarks"))
    return entities.join(lists, "entity", "left").select(F.col("entity").alias("name"), "company", "url", "release_date", "capabilities", F.coalesce("benchmarks", F.array().cast(lists.schema["benchmarks"].dataType)).alias("benchmarks"))


def write_document(models: DataFrame, path: str) -> None:
    """One JSON object a line and entity."""
    models.write.mode("overwrite").json(path)


def write_by_company(models: DataFrame, path: str) -> None:
    """The same in a folder for each company."""
    models.withColumn("company_slug", slug(F.col("company"))).write.mode("overwrite").partitionBy("company_slug").json(path)


def owners(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, company_slug): the company that owns an entity's document."""
    return names.join(entities.groupBy("entity").agg(F.min_by("company", "ord").alias("company")), "entity").select("entity", slug(F.col("company")).alias("company_slug"))


def tab_lines(df: DataFrame, *columns: str) -> DataFrame:
    """One text column: the columns' values between tabs."""
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def write_counts(counts: DataFrame, path: str) -> None:
    """Names with their counts, sorted by name."""
    tab_lines(counts.orderBy("metric"), "metric", "n").write.mode("overwrite").text(path)


def write_suggestions(found: DataFrame, path: str) -> None:
    """Unknown names with the closest known one, in the order given."""
    tab_lines(found, "name", "closest").write.mode("overwrite").text(path)


def write_report(matches: DataFrame, path: str) -> None:
    """Ambiguous matches; an entity's fields are null where none was found."""
    matches.write.mode("overwrite").json(path)


def write_composites(criteria: DataFrame, path: str, defaults: list[str] = ()) -> None:
    """Stored composite metrics (metric_name, bench, weight), without those of default names."""
    own = criteria.where(~F.col("metric_name").isin(list(defaults))) if defaults else criteria
    out = own.groupBy("metric_name").agg(F.collect_list(F.struct("bench", "weight")).alias("criteria")).select(F.col("metric_name").alias("name"), "criteria")
    out.write.mode("overwrite").json(path)


def _folder(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def clear_composites(spark: SparkSession, path: str) -> bool:
    """Remove stored composite metrics; whether there were any."""
    system, held = _folder(spark, path)
    return bool(system.delete(held, True))


def composites_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether there are stored composite metrics, their size in bytes, and how many there are."""
    system, held = _folder(spark, path)
    kind = "is_there boolean, size long, metrics long"
    if not system.exists(held):
        return spark.createDataFrame([(False, 0, 0)], kind)
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"))
    count = spark.read.schema("name string").json(path).agg(F.count(F.lit(1)).alias("metrics"))
    return size.crossJoin(count).select((F.col("size") > 0).alias("is_there"), "size", "metrics")  # a row each
