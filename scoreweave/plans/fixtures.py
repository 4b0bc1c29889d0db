"""The driver's tables as canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators.derive import ACTIVE, INPUT, OUTPUT, SIZE, SPEED, TOKENS

#: Brands that stand for metrics that take part in derivations.
BRANDS = {"Brand#1": TOKENS, "Brand#2": SPEED, "Brand#3": ACTIVE, "Brand#4": INPUT, "Brand#5": OUTPUT, "Brand#6": SIZE}
CRITERIA = [("balanced", "Brand#1", 2.0), ("balanced", "Brand#2", 1.0), ("balanced", "Brand#3", -0.5), ("balanced", "Brand#99", 1.0), ("narrow", "Brand#4", 1.0)]
REQUIREMENTS = [("Brand#1", 25.0, ["ECONOMY", "PROMO"], ["A"]), ("Brand#2", 20.0, ["LARGE", "STANDARD"], []), ("Brand#30", 0.0, ["MEDIUM"], ["R", "N"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by supplier, brand and return flag, for three fifths of the (supplier, brand) grid."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    kept = ((F.col("l_suppkey") * 7 + F.substring("p_brand", 7, 10).cast("int") * 13) % 5).isin(0, 1)
    rows = items.join(parts, items.l_partkey == parts.p_partkey).where(~kept)
    out = rows.groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.col("p_brand").alias("metric"), F.col("l_returnflag").alias("source")).agg(F.avg("l_quantity").alias("score"))
    return out.select("entity", "metric", "score", F.lit(None).cast("double").alias("std_dev"), "source", F.ascii("source").cast("long").alias("ord"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation as company, the date of their first order, and part types and flags as capabilities."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    dates = items.join(orders, items.l_orderkey == orders.o_orderkey).groupBy("l_suppkey").agg(F.min("o_orderdate").cast("date").alias("release_date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    some = items.where("l_quantity >= 49 and l_linenumber <= 2").join(parts, items.l_partkey == parts.p_partkey)
    able = some.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p_type")).alias("input"), F.sort_array(F.collect_set("l_returnflag")).alias("output"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = suppliers.join(dates, suppliers.s_suppkey == dates.l_suppkey, "left").drop("l_suppkey").join(able, suppliers.s_suppkey == able.l_suppkey, "left")
    return out.select(
        F.col("s_suppkey").cast("string").alias("entity"), F.col("n_name").alias("company"), F.col("s_name").alias("url"), "release_date",
        F.when(F.col("input").isNotNull(), F.struct("input", "output")).alias("capabilities"), F.col("s_suppkey").cast("long").alias("ord"),
    )


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, s, (i, o)) for m, s, i, o in REQUIREMENTS], "metric string, random_score double, capabilities struct<input: array<string>, output: array<string>>")


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "metric_name string, bench string, weight double")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_scores(observations(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.densify(cells(spark, sf_dir))


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the names of metrics that take part in derivations."""
    names = F.create_map(*[F.lit(x) for pair in BRANDS.items() for x in pair])
    return observations(spark, sf_dir).withColumn("metric", F.coalesce(F.element_at(names, F.col("metric")), F.col("metric")))
