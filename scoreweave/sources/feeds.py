"""Flattening of external feeds to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import capitalize
from ..functions.numbers import half_up

#: Our metric for each key of feed A: evaluations, then pricing, then speed (fixed values).
FEED_A_METRICS = {
    "artificial_analysis_intelligence_index": "ArtificialAnalysis Intelligence Index",
    "artificial_analysis_coding_index": "ArtificialAnalysis Coding Index",
    "artificial_analysis_math_index": "ArtificialAnalysis Math Index",
    "mmlu_pro": "MMLU-Pro",
    "gpqa": "GPQA Diamond",
    "hle": "Humanity's Last Exam",
    "livecodebench": "LiveCodeBench",
    "scicode": "SciCode",
    "math_500": "MATH",
    "aime": "AIME 2024",
    "aime_25": "AIME 2025",
    "ifbench": "IFBench",
    "lcr": "LCR",
    "terminalbench_hard": "Terminal-Bench-Hard",
    "terminalbench_v2_1": "Terminal-Bench 2.1",
    "tau2": "τ²-Bench",
    "tau_banking": "τ³ Banking",
    "price_1m_input_tokens": "Input cost",
    "price_1m_output_tokens": "Output cost",
    "median_output_tokens_per_second": "Output speed",
}
#: Keys whose scores are indexes or amounts already, not shares (fixed values).
INDEX_KEYS = (
    "artificial_analysis_intelligence_index",
    "artificial_analysis_coding_index",
    "artificial_analysis_math_index",
    "price_1m_input_tokens",
    "price_1m_output_tokens",
    "median_output_tokens_per_second",
)
#: Metrics that a feed doesn't set by itself (fixed values).
EXCLUDED = ("Input cost", "Output cost")


def rescaled(key: Column, score: Column, index_keys=INDEX_KEYS) -> Column:
    """Shares become percentages."""
    return F.when(key.isin(*index_keys), score).otherwise(score * 100)


def flatten_feed_a(feed: DataFrame, metrics: dict[str, str] | None = None, index_keys=INDEX_KEYS, excluded=EXCLUDED, source: str = "https://artificialanalysis.ai") -> DataFrame:
    """(name, metric, score, source, ord) from rows (name, evaluations, pricing, speed, ord): keys that we have a metric for, numbers
    that aren't 0, shares as percentages, two decimals. A later map's key overrides an earlier one's."""
    metrics = metrics or FEED_A_METRICS
    parts = [F.explode_outer(F.map_entries(c)).alias("e") for c in ("evaluations", "pricing")]
    rows = [feed.select("name", "ord", F.lit(i).alias("part"), p) for i, p in enumerate(parts)]
    rows = [r.select("name", "ord", "part", F.col("e.key").alias("key"), F.col("e.value").cast("double").alias("value")) for r in rows]
    rows.append(feed.select("name", "ord", F.lit(2).alias("part"), F.lit("median_output_tokens_per_second").alias("key"), F.col("speed").cast("double").alias("value")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("key is not null")
    one = every.groupBy("name", "ord", "key").agg(F.max_by(F.struct("value"), "part").alias("last"))
    table = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    out = one.select("name", "ord", "key", F.element_at(table, F.col("key")).alias("metric"), F.col("last.value").alias("value"))
    out = out.where(F.col("metric").isNotNull() & ~F.col("metric").isin(*excluded) & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))
    return out.select("name", "metric", half_up(rescaled(F.col("key"), F.col("value"), index_keys), 2).alias("score"), F.lit(source).alias("source"), "ord")


def flatten_feed_b(feed: DataFrame, source: str = "https://lmarena.ai") -> DataFrame:
    """(name, metric, score, source) from rows (arena, name, rating)."""
    return feed.select("name", F.concat(F.lit("LMArena "), capitalize(F.col("arena"))).alias("metric"), half_up(F.col("rating")).alias("score"), F.lit(source).alias("source"))
