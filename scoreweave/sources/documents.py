"""Readers: nested JSON documents, feeds, lists and stored composite metrics, to the canonical tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def _documents(spark: SparkSession, path: str, mode: str) -> DataFrame:
    kind = schema.DOCUMENT
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", mode)
    if mode == "PERMISSIVE":
        kind = type(kind)([*kind.fields]).add("_corrupt_record", "string")
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(kind).json(path).withColumn("file", F.col("_metadata.file_name"))


def _exploded(documents: DataFrame) -> DataFrame:
    """One row an entity, its place by file name and by place in the file."""
    return documents.where("models is not null").select("file", F.posexplode("models").alias("place", "model"))


def read_models(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities, observations) of a folder of company documents. A file that isn't JSON stops a strict read; otherwise it is left
    out. Files without a list of models are left out. ord: file name, then place."""
    documents = _documents(spark, path, "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        documents = documents.where("_corrupt_record is null")
    models = _exploded(documents)
    # Places are numbered by file name; files are as many as companies.
    files = models.select("file").distinct()
    numbers = files.select("file", F.row_number().over(_by("file")).cast("long").alias("file_ord"))
    models = models.join(numbers, "file").withColumn("ord", _packed(_packed(F.lit(0), "file_ord", 20), "place", schema.PLACE_BITS))
    entities = models.select(F.col("model.name").alias("entity"), "model.company", "model.url", "model.release_date", "model.capabilities", "ord")
    entries = models.select(F.col("model.name").alias("entity"), "ord", F.posexplode("model.benchmarks").alias("i", "b"))
    obs = entries.select("entity", F.col("b.name").alias("metric"), "b.score", F.col("b.stdDev").alias("std_dev"), "b.source", _packed(F.col("ord"), "i", schema.ENTRY_BITS).alias("ord"))
    return entities, obs


def _packed(high: Column, low: str, bits: int) -> Column:
    """high and a number of so many bits as one number; a larger one stops the read, since orders would collide."""
    fits = F.when(F.col(low) < (1 << bits), F.col(low).cast("long")).otherwise(F.raise_error(F.lit(f"more than 2**{bits} places: {low}")).cast("long"))
    return high.cast("long") * F.lit(1 << bits) + fits


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """(metric, url, capabilities, random_score)."""
    rows = spark.read.option("multiLine", True).schema(schema.REQUIREMENTS).json(path).select(F.explode("benchmarks").alias("b"))
    return rows.select(F.col("b.name").alias("metric"), "b.url", "b.capabilities", "b.random_score")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord) from a text file, one a line; blank lines are left out, names stay as they are."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n")).alias("ord", "name"))
    return lines.where(F.trim("name") != "").select("name", F.col("ord").cast("long").alias("ord"))


def read_candidate_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord) from a document {benchmarks: [{name}]}."""
    kind = "benchmarks array<struct<name: string>>"
    return spark.read.option("multiLine", True).schema(kind).json(path).select(F.posexplode("benchmarks").alias("ord", "b")).select(F.col("b.name").alias("name"), F.col("ord").cast("long").alias("ord"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, entity), as `resolve.match` takes a dictionary: from a JSON object of external names and ours, or a Parquet table."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select(F.col("name").cast("string"), F.col("entity").cast("string"))
    told = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "entity"))
    return told.where("entity is not null")


def read_ignored(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """One column of names (or prefixes), as `resolve.not_ignored` takes them: from a JSON list of strings, or a text file of one a line."""
    if path.endswith(".json"):
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(column)).where(f"`{column}` is not null")
    return read_names(spark, path).select(F.col("name").alias(column))


def read_feed_a(spark: SparkSession, path: str) -> DataFrame:
    """One row a model of feed A, as `flatten_feed_a` takes it."""
    rows = spark.read.option("multiLine", True).schema(schema.FEED_A).json(path).select(F.posexplode("data").alias("ord", "d"))
    return rows.select(F.col("d.name").alias("name"), "d.evaluations", "d.pricing", F.col("d.median_output_tokens_per_second").alias("speed"), F.col("ord").cast("long").alias("ord"))


def read_feed_b(spark: SparkSession, path: str) -> DataFrame:
    """(arena, name, rating, ...) of a cached feed B."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.FEED_B).alias("m"))
    arenas = raw.select(F.explode("m").alias("arena", "models"))
    return arenas.select("arena", F.explode("models").alias("name", "m")).select("arena", "name", "m.*")


#: A string, a bracket, a comma, or what stands between them.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|,|[^"\[\]{},]+', re.S)


def _balanced(text: str, start: int) -> list[str]:
    """Pieces of the object or list that opens at text[start], to its end; commas before a closing bracket are left out."""
    out: list[str] = []
    depth = 0
    for m in _PIECES.finditer(text, start):
        piece = m.group()
        if piece in "]}":
            depth -= 1
            while out and (out[-1] == "," or not out[-1].strip()):
                out.pop()
        depth += piece in "[{"
        out.append(piece)
        if not depth:
            return out
    return []


def _member(text: str, holder: str, name: str, opens: str) -> str | None:
    """JSON of the first member `name` within the first object called holder: a list if opens is [, a string if it is \"."""
    for found in re.finditer(rf'"{holder}"\s*:\s*(?={{)', text):
        pieces = _balanced(text, found.end())
        for i, piece in enumerate(pieces[:-2]):
            if piece == f'"{name}"' and pieces[i + 1].strip() == ":" and pieces[i + 2].startswith(opens):
                return "".join(_balanced("".join(pieces[i + 2 :]), 0)) if opens == "[" else pieces[i + 2][1:-1]
    return None


@F.arrow_udf(schema.PAGE_PARTS)
def _page_parts(pages: pa.Array) -> pa.Array:
    told = [(_member(t or "", "arena", "slug", '"'), _member(t or "", "leaderboard", "entries", "[")) for t in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.string())], ["arena", "listed"])


def parse_feed_b_page(page: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """The same from the page that carries feed B (column value): the arena's slug (`text` without one) and its list of entries, found by
    balanced brackets. Entries need a display name and a rating; ratings are rounded half up. saved: a page to read where this one has no entries."""
    from ..functions.numbers import half_up

    parts = lambda df: df.select(_page_parts(F.col("value")).alias("p")).select("p.arena", F.from_json("p.listed", schema.FEED_B_RAW).alias("listed")).where(F.size("listed") > 0)
    told = parts(page)
    if saved is not None:
        there = told.select(F.lit(1).alias("one")).limit(1)
        told = told.unionByName(parts(saved).withColumn("one", F.lit(1)).join(there, "one", "left_anti").drop("one"))
    rows = told.select(F.coalesce(F.nullif("arena", F.lit("")), F.lit("text")).alias("arena"), F.explode("listed").alias("e"))
    rows = rows.where("e.modelDisplayName is not null and e.modelDisplayName <> '' and e.rating is not null")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "arena", F.col("e.modelDisplayName").alias("name"), half_up(F.col("e.rating")).alias("rating"), empty("e.modelOrganization").alias("modelOrganization"),
        half_up(F.col("e.ratingUpper")).alias("ratingUpper"), half_up(F.col("e.ratingLower")).alias("ratingLower"), empty("e.license").alias("license"), empty("e.modelUrl").alias("modelUrl"),
        *[F.nullif(f"e.{c}", F.lit("")).alias(c) for c in ("modelName", "modelId", "arenaId", "leaderboardId")],
    )


def read_composites(spark: SparkSession, path: str) -> DataFrame:
    """(metric_name, bench, weight, ord) of stored composite metrics; malformed ones are left out, and so is all of a file that isn't
    a list."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.COMPOSITES).alias("m"))
    rows = raw.select(F.posexplode("m").alias("ord", "m"))
    good: Column = F.forall("m.criteria", lambda c: F.coalesce(c["bench"].isNotNull() & c["weight"].isNotNull(), F.lit(False)))
    rows = rows.where(F.col("m.name").isNotNull() & F.col("m.criteria").isNotNull() & good)
    return rows.select(F.col("m.name").alias("metric_name"), F.explode("m.criteria").alias("c"), F.col("ord").cast("long").alias("ord")).select("metric_name", "c.bench", "c.weight", "ord")
