"""Derived metrics: each operator returns new observations, to be appended (unionByName) in the order of `derive_all`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import year_fraction

#: Names of metrics that take part in derivations (fixed values).
TOKENS, SPEED, ACTIVE = "ArtificialAnalysis Consumed Tokens (Millions)", "Output speed", "Active parameters"
INPUT, OUTPUT, LATENCY, COST = "Input cost", "Output cost", "Completion Latency", "Cost of 1K responses"
RELEASE, SIZE, RELEASE_SIZE = "Release date", "Size", "Release date × log(Size)"
#: Tokens of the baseline's benchmarks (millions), of a question and of its answer; memory bandwidth in bytes a second (fixed values).
BASE_TOKENS, QUESTION, ANSWER, BANDWIDTH = 7.3, 11, 119, 3.35e12
#: Price by active parameters and by their ratio to speed: (constant, active, ratio) with speed, (constant, active) without
#: (fixed values).
INPUT_FIT, OUTPUT_FIT = ((0.370, -0.00471, 0.738), (0.399, 0.00549)), ((1.323, -0.03356, 3.662), (1.468, 0.01708))
#: Derived observations come after all that were read or fed (schema.FED), in the order of steps.
APPENDED = 1 << 62


def _rows(df: DataFrame, metric: str | Column, score: Column, source: str | Column, step: int) -> DataFrame:
    named = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("entity", named(metric).alias("metric"), score.cast("double").alias("score"), F.lit(0.0).alias("std_dev"), named(source).alias("source"), F.lit(APPENDED + step).cast("long").alias("ord"))


def first_scores(obs: DataFrame, **metrics: str) -> DataFrame:
    """One row an entity: the first observation's score of each metric, null if there is none. One aggregate for all."""
    names = list(metrics.values())
    firsts = [F.min_by("score", F.when(F.col("metric") == m, F.col("ord"))).alias(k) for k, m in metrics.items()]
    return obs.where(F.col("metric").isin(names)).groupBy("entity").agg(*firsts)


def release_dates(entities: DataFrame) -> DataFrame:
    """Release date as a year with its share; a date that can't be read gives a null score."""
    day = F.try_to_date(F.col("release_date").cast("string"), "yyyy-MM-dd")
    return _rows(entities, RELEASE, year_fraction(day), F.col("url"), 1)


def release_by_size(obs: DataFrame) -> DataFrame:
    """Release date times ln(size), where both are known."""
    both = first_scores(obs, day=RELEASE, size=SIZE).where("day is not null and size is not null")
    return _rows(both, RELEASE_SIZE, F.col("day") * F.when(F.col("size") > 0, F.log("size")), "Calculated from Release date and Size", 2)


def missing_capabilities(have: Column, need: Column) -> Column:
    """Those needed that aren't there, in order; none if either side is null."""
    return F.when(have.isNull() | need.isNull(), F.array().cast("array<string>")).otherwise(F.array_except(need, have))


def capability_gaps(entities: DataFrame, requirements: DataFrame) -> DataFrame:
    """(entity, metric, random_score, missing) for each metric that an entity lacks a capability for. Requirements are a small table
    of rules (metric, random_score, capabilities); every entity meets every rule."""
    rules = requirements.select("metric", "random_score", F.col("capabilities").alias("need"))
    both = entities.select("entity", F.col("capabilities").alias("have")).crossJoin(rules)
    told = lambda k: F.transform(missing_capabilities(F.col(f"have.{k}"), F.col(f"need.{k}")), lambda c: F.concat(F.lit(f"{k}:"), c))
    return both.withColumn("missing", F.concat(told("input"), told("output"))).where(F.size("missing") > 0).select("entity", "metric", "random_score", "missing")


def capability_floor(entities: DataFrame, requirements: DataFrame) -> DataFrame:
    """The random score for each metric that an entity lacks a capability for. It is an observation among others."""
    gaps = capability_gaps(entities, requirements)
    return _rows(gaps, F.col("metric"), F.col("random_score"), F.concat(F.lit("Missing capability: "), F.concat_ws(", ", "missing")), 3)


def with_capability_floor(obs: DataFrame, entities: DataFrame, requirements: DataFrame, replace: bool = False) -> DataFrame:
    """obs and the random scores; replace: the random score stands instead of what the entity's observations of that metric say."""
    floor = capability_floor(entities, requirements)
    kept = obs.join(floor.select("entity", "metric").distinct(), ["entity", "metric"], "left_anti").select(obs.columns) if replace else obs
    return kept.unionByName(floor)


def latency(obs: DataFrame) -> DataFrame:
    """Completion latency from consumed tokens and speed; a speed that isn't known is estimated from active parameters, and is an
    observation too."""
    got = first_scores(obs, tokens=TOKENS, speed=SPEED, active=ACTIVE).where("tokens is not null")
    guess = F.try_divide(F.lit(BANDWIDTH), F.col("active") * 1e9 * 2)
    got = got.withColumn("used", F.coalesce("speed", guess))
    speeds = _rows(got.where("speed is null and active is not null"), SPEED, F.col("used"), "Estimated from Active Parameters and H100 SXM Memory Bandwidth", 4)
    took = F.col("tokens") / BASE_TOKENS * ANSWER / F.col("used")
    return speeds.unionByName(_rows(got.where("used > 0"), LATENCY, took, "Calculated from ArtificialAnalysis Consumed Tokens and Active Parameters", 5))


def prices(obs: DataFrame) -> DataFrame:
    """Input and output cost where they aren't known and active parameters are."""
    got = first_scores(obs, active=ACTIVE, speed=SPEED, input=INPUT, output=OUTPUT).where("active is not null")
    fast = F.coalesce(F.col("speed") > 0, F.lit(False))
    ratio = F.when(fast, F.col("active") / F.col("speed"))
    source = F.when(fast, "Estimated from Active parameters + Output speed ratio").otherwise("Estimated from Active parameters")
    fit = lambda f: F.when(fast, f[0][0] + f[0][1] * F.col("active") + f[0][2] * ratio).otherwise(f[1][0] + f[1][1] * F.col("active"))
    return _rows(got.where("input is null"), INPUT, fit(INPUT_FIT), source, 6).unionByName(_rows(got.where("output is null"), OUTPUT, fit(OUTPUT_FIT), source, 7))


def cost_of_1k(obs: DataFrame) -> DataFrame:
    """Cost of 1000 responses, after imputation; null where a price is unknown."""
    got = first_scores(obs, tokens=TOKENS, input=INPUT, output=OUTPUT).where("tokens is not null")
    each = F.col("input") / 1e6 * QUESTION + F.col("output") / 1e6 * (F.col("tokens") / BASE_TOKENS * ANSWER)
    return _rows(got, COST, each * 1e3, "Calculated from ArtificialAnalysis Consumed Tokens", 8)


def derive_all(obs: DataFrame, entities: DataFrame, requirements: DataFrame, replace: bool = False) -> DataFrame:
    """obs with all metrics derived before imputation, each step seeing those before. replace: see with_capability_floor."""
    obs = obs.unionByName(release_dates(entities))
    obs = obs.unionByName(release_by_size(obs))
    obs = with_capability_floor(obs, entities, requirements, replace)
    obs = obs.unionByName(latency(obs))
    return obs.unionByName(prices(obs))


def with_capabilities(entities: DataFrame, known: DataFrame) -> DataFrame:
    """entities with the capabilities of the last row of known of the same name that has any."""
    last = known.where("capabilities is not null").groupBy("entity").agg(F.max_by("capabilities", "ord").alias("capabilities"))
    return entities.drop("capabilities").join(last, "entity", "left")


def entity_info(models: DataFrame) -> DataFrame:
    """One row a name: the last one's company, url and date, empty ones null."""
    last = models.groupBy("entity").agg(F.max_by(F.struct("company", "url", "release_date"), "ord").alias("info"), F.min("ord").alias("ord"))
    return last.select("entity", *[F.nullif(f"info.{c}", F.lit("")).alias(c) for c in ("company", "url", "release_date")], "ord")
