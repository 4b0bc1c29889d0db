"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; a stage's
result is written as Parquet in the shared folder and read again as the next one's docs. Near-duplicates take five words and a
similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm.decontam import decontaminate
from scoreweave.llm.mixing import mix_documents
from scoreweave.llm.neardup import keep_one
from scoreweave.llm.quality import fit_from, judge
from scoreweave.llm.shared import settle, small_batches, table
from scoreweave.llm.substrings import drop_repeats

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    model = fit_from(docs, table(spark, sf_dir, "labels"))
    return judge(own, model).where("kept").select("whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return keep_one(docs, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has too."""
    small_batches(spark)
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    small_batches(spark)
    return mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Stages that SQL can't express are part of it; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
