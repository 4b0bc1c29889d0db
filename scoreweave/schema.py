"""Schemas of documents and of the canonical tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType


def _struct(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


S, D, L, B = StringType(), DoubleType(), LongType(), BooleanType()
CAPABILITIES = _struct(input=ArrayType(S), output=ArrayType(S))
ENTRY = _struct(name=S, score=D, source=S, stdDev=D)
MODEL = _struct(name=S, company=S, url=S, release_date=S, capabilities=CAPABILITIES, benchmarks=ArrayType(ENTRY))
#: One file of a company.
DOCUMENT = _struct(models=ArrayType(MODEL))
#: Metrics with the capabilities that they need.
REQUIREMENTS = _struct(benchmarks=ArrayType(_struct(name=S, url=S, capabilities=CAPABILITIES, random_score=D)))
FEED_A = _struct(
    data=ArrayType(
        _struct(
            id=S, name=S, slug=S, release_date=S, model_creator=_struct(id=S, name=S, slug=S), evaluations=MapType(S, D), pricing=MapType(S, D),
            median_output_tokens_per_second=D, median_time_to_first_token_seconds=D, median_time_to_first_answer_token=D,
        )
    )
)
FEED_B_ENTRY = _struct(rating=D, modelOrganization=S, ratingUpper=D, ratingLower=D, license=S, modelUrl=S, modelName=S, modelId=S, arenaId=S, leaderboardId=S)
FEED_B = MapType(S, MapType(S, FEED_B_ENTRY))
FEED_B_RAW = ArrayType(StructType([StructField("modelDisplayName", S), *FEED_B_ENTRY.fields]))
PAGE_PARTS = _struct(arena=S, listed=S)
COMPOSITES = ArrayType(_struct(name=S, criteria=ArrayType(_struct(bench=S, weight=D))))

#: Bits of an entry's place in its entity, and of an entity's place in its file, in ord; observations that a feed adds come after them.
ENTRY_BITS, PLACE_BITS, FED = 18, 22, 1 << 61

OBSERVATIONS = _struct(entity=S, metric=S, score=D, std_dev=D, source=S, ord=L)
ENTITIES = _struct(entity=S, company=S, url=S, release_date=S, capabilities=CAPABILITIES, ord=L)
CELLS = _struct(entity=S, metric=S, score=D, std_dev=D, source=S, is_known=B)
