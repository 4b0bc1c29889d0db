"""Composite metrics that come with the engine, and their union with stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories with the weight of each of their metrics (fixed values).
CATEGORIES: dict[str, dict[str, int]] = {
    "Knowledge": {
        "ArtificialAnalysis Intelligence Index": 10,
        "Humanity's Last Exam": 10,
        "SimpleQA": 10,
        "MMLU-Pro": 10,
        "MMLU-Redux": 10,
        "MMLU": 10,
        "MMMLU": 1,
        "MMMU": 1,
        "MMMU-Pro": 1,
        "AGIEval": 1,
        "Vibe-Eval": 1,
    },
    "Reasoning": {
        "ARC-AGI-2": 10,
        "BIG-Bench Hard": 10,
        "IFBench": 10,
        "IFEval": 10,
        "DROP": 10,
        "LCR": 10,
        "CommonSenseQA": 1,
        "OpenBookQA": 1,
        "PIQA": 1,
        "SIQA": 1,
        "HellaSwag": 1,
        "ERQA": 1,
        "CharXiv Reasoning (with tools)": 1,
        "CharXiv [PQ]": 1,
        "CharXiv [RQ]": 1,
        "Graphwalks bfs <128k": 1,
        "Graphwalks parents <128k": 1,
        "COLLIE": 1,
        "FinSearchComp-T3": 1,
        "FinSearchComp-global": 1,
        "LOFT (128k)": 1,
    },
    "Search": {
        "SimpleQA (with tools)": 10,
        "Reka Research Eval (with tools)": 10,
        "xbench-DeepSearch": 10,
        "Seal-0": 10,
        "Humanity's Last Exam (with tools)": 10,
        "FRAMES": 10,
        "FACTS Grounding": 10,
        "FActScore hallucination rate": -1,
        "BrowseComp Long Context 128k": 1,
        "BrowseComp Long Context 256k": 1,
        "MRCR: 2 needle 128k": 1,
        "MRCR: 2 needle 256k": 1,
        "LongFact-Concepts hallucination rate": -1,
        "LongFact-Objects hallucination rate": -1,
        "FinSearchComp-T3": 1,
        "FinSearchComp-global": 1,
    },
    "Math": {
        "FrontierMath (Tier 4)": 5,
        "FrontierMath (Tier 1–3)": 5,
        "FrontierMath (with tools)": 5,
        "IMO-AnswerBench": 10,
        "HiddenMath": 3,
        "Beyond AIME": 2,
        "USAMO 2025": 3,
        "CNMO 2024": 3,
        "AIME 2026": 8,
        "AIME 2025": 10,
        "AIME 2025 (with tools)": 6,
        "AIME 2024": 10,
        "ArtificialAnalysis Math Index": 10,
        "HMMT Feb 2025": 9,
        "HMMT Feb 2026": 9,
        "HMMT Nov 2025": 8,
        "GPQA Diamond": 10,
        "MathArena Apex": 4,
        "MATH": 10,
        "PolyMATH": 6,
        "SuperGPQA": 7,
        "GPQA": 9,
        "GSM8K": 8,
        "MGSM": 6,
    },
    "Coding": {
        "LiveCodeBench": 10,
        "Codeforces": 10,
        "SWE-bench Verified": 10,
        "SWE-bench Pro": 10,
        "SWE-Lancer": 10,
        "ArtifactsBench": 1,
        "BIRD-SQL": 1,
        "HumanEval": 1,
        "OJBench": 1,
        "SciCode": 5,
    },
    "Agentic Coding": {
        "Terminal-Bench 2.1": 10,
        "Terminal-Bench 2.0": 10,
        "Terminal-Bench-Hard": 10,
        "Terminal-Bench": 9,
        "NL2Repo": 7,
        "SWE-fficiency": 4,
        "SWE-bench Pro (with tools)": 3,
        "SWE-bench Pro": 9,
        "SWE-Lancer IC Diamond": 3,
        "SWE-Lancer": 3,
        "Multi-SWE-bench (with tools)": 4,
        "Multi-SWE-bench": 8,
        "SWE-bench Multilingual (with tools)": 5,
        "SWE-bench Multilingual": 9,
        "SWE-bench Verified (with tools)": 6,
        "SWE-bench Verified": 10,
        "SWE-bench": 2,
        "Aider": 2,
    },
    "Agentic": {
        "τ³ Banking": 5,
        "τ²-Bench": 10,
        "τ²-Bench Airline": 1,
        "τ²-Bench Retail": 1,
        "τ²-Bench Telecom": 3,
        "τ-Bench Airline": 1,
        "τ-Bench Retail": 1,
        "MCP-Atlas": 5,
        "BrowseComp": 5,
        "OSWorld-Verified": 3,
        "Toolathlon": 2,
        "Tool Decathlon": 2,
        "AutomationBench": 2,
        "Agents' Last Exam": 1,
        "APEX-Agents": 1,
        "GAIA (text)": 1,
        "AgentCompany": 1,
        "Finance Agent v1.1": 1,
        "BFCL v3": 1,
        "ZeroBench (with tools)": 1,
    },
    "Multimodal": {
        "MMMU": 1,
        "MMMU-Pro": 1,
        "ArtifactsBench": 1,
        "VideoMMMU": 1,
        "Video-MME": 1,
        "EgoSchema": 1,
        "OSWorld": 1,
        "Vibe-Eval": 1,
        "ZeroBench": 1,
        "MathVista": 1,
        "MathVision": 1,
    },
}


def default_criteria(spark: SparkSession) -> DataFrame:
    """(metric_name, bench, weight, ord) of all categories, in their order."""
    rows = [(name, bench, float(weight), i) for i, (name, benches) in enumerate(CATEGORIES.items()) for bench, weight in benches.items()]
    return spark.createDataFrame(rows, "metric_name string, bench string, weight double, ord long")


def with_stored(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Default metrics, then stored ones."""
    return defaults.unionByName(stored.withColumn("ord", F.col("ord") + len(CATEGORIES)))
