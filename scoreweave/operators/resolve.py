"""Entity resolution: dictionary, equal normalised names, nearest names; and the report on it.

external: (name, ord); entities: (entity, ord). ord is the load order, which breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import normalize_name
from ..session import settle

#: Edit distances within which nearest names are sought by shared pieces, one after the other.
BOUNDS = (2, 6)


def not_ignored(external: DataFrame, names: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """external without names on a list (name) and names with a prefix on a list (prefix)."""
    if names is not None:
        external = external.join(names.select("name").distinct(), "name", "left_anti")
    if prefixes is not None:
        external = external.join(prefixes.select("prefix").distinct(), F.expr("startswith(name, prefix)"), "left_anti")
    return external


def by_dictionary(external: DataFrame, entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, entity): the dictionary (name, entity) names an entity that is there."""
    return external.join(dictionary, "name").join(entities.select("entity").distinct(), "entity").select("name", "entity")


def by_equal_name(external: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity): the first entity of equal normalised name. Entities may serve more than once."""
    first = entities.groupBy(normalize_name(F.col("entity")).alias("norm")).agg(F.min_by("entity", "ord").alias("entity"))
    return external.withColumn("norm", normalize_name(F.col("name"))).join(first, "norm").select("name", "entity")


def by_equal_name_once(external: DataFrame, entities: DataFrame) -> DataFrame:
    """The same, each entity once: the i-th external takes the i-th entity of its normalised name."""
    turn = lambda: F.row_number().over(W.partitionBy("norm").orderBy("ord"))
    left = external.withColumn("norm", normalize_name(F.col("name"))).withColumn("turn", turn())
    right = entities.withColumn("norm", normalize_name(F.col("entity"))).withColumn("turn", turn())
    return left.join(right.select("norm", "turn", "entity"), ["norm", "turn"]).select("name", "entity")


def _pieces(size: Column, i: Column, bound: int) -> tuple[Column, Column]:
    """Start (from 0) and length of piece i of bound + 1 of a string of so many characters; the last ones are longer by one."""
    each, longer = F.floor(size / (bound + 1)), size % (bound + 1)
    first = bound + 1 - longer
    return (i * each + F.greatest(F.lit(0), i - first)).cast("int"), (each + (i >= first).cast("int")).cast("int")


def within(names: DataFrame, theirs: DataFrame, bound: int) -> DataFrame:
    """(name, first, distance) for names (name, norm) and others (other, first) at most `bound` edits apart. A string cut into bound + 1
    pieces keeps one of them whole, so pairs come from joins by pieces: (size, number, piece), which the other side looks for where edits
    can have moved it. Pairs may be there twice."""
    i, size, at = F.col("i"), F.col("size"), F.col("at")
    short = size <= bound  # pieces would be empty: such a string is one piece
    turns = F.explode(F.when(short, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(bound)))).alias("i")
    start, length = _pieces(size, i, bound)
    cut = lambda text, start: F.when(i < 0, "").otherwise(F.substr(text, start + 1, length))
    right = theirs.select("*", F.length("other").alias("size")).select("*", turns).select("other", "first", "size", "i", cut(F.col("other"), start).alias("piece"))
    n = F.length("norm")
    left = names.select("*", F.explode(F.sequence(F.greatest(F.lit(0), n - bound), n + bound)).alias("size")).select("*", turns)
    # A longer string's first piece is moved by insertions before it, and its last by those after it.
    low = F.greatest(F.lit(0), start - F.floor((bound - (n - size)) / 2)).cast("int")
    high = F.least(n - length, start + F.floor((bound + (n - size)) / 2)).cast("int")
    places = F.when(i < 0, F.array(F.lit(0))).when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    left = left.select("*", F.explode(places).alias("at")).select("name", "norm", "size", "i", cut(F.col("norm"), at).alias("piece")).distinct()
    both = left.join(right, ["size", "i", "piece"])
    return both.select("name", "first", F.levenshtein("norm", "other", bound).alias("distance")).where("distance >= 0")


def nearest(external: DataFrame, entities: DataFrame, normalized: bool = True, most: float | None = None) -> DataFrame:
    """(name, entity, distance) of the smallest edit distance, the first entity among equals. Names are joined by shared pieces within the
    first of BOUNDS, those without a match within the next; a distance found within a bound is the smallest. Only names farther than
    that from every entity meet all distinct entity names, of which the smallest is kept as pairs are made. most: a distance over this share of
    the name's length is no match."""
    form = normalize_name if normalized else (lambda c: c)
    left = settle(external.select("name").distinct().withColumn("norm", form(F.col("name"))), "names")
    theirs = settle(entities.groupBy(form(F.col("entity")).alias("other")).agg(F.min(F.struct("ord", "entity")).alias("first")), "names")
    best = lambda pairs: pairs.groupBy("name").agg(F.min(F.struct("distance", "first")).alias("best"))
    out = []
    for bound in BOUNDS:
        out.append(settle(best(within(left, theirs, bound)), "nearest"))
        left = settle(left.join(out[-1].select("name"), "name", "left_anti"), "names")
        if left.isEmpty():
            break
    else:
        out.append(best(left.crossJoin(theirs).withColumn("distance", F.levenshtein("norm", "other"))))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    found = found.select("name", F.col("best.first.entity").alias("entity"), F.col("best.distance").cast("long").alias("distance"))
    return found if most is None else found.where(F.col("distance") <= most * F.length("name"))


def match(external: DataFrame, entities: DataFrame, dictionary: DataFrame, once: bool = False) -> DataFrame:
    """(name, entity, kind, distance) for every external name; kind: dictionary, exact, nearest or none. once: an entity taken by one
    external by dictionary or name serves no other, and the nearest is sought among the rest."""
    told = by_dictionary(external, entities, dictionary).dropDuplicates(["name"])
    rest = external.join(told.select("name"), "name", "left_anti")
    free = entities.join(told.select("entity").distinct(), "entity", "left_anti") if once else entities
    equal = (by_equal_name_once if once else by_equal_name)(rest, free)
    rest = rest.join(equal.select("name"), "name", "left_anti")
    free = free.join(equal.select("entity").distinct(), "entity", "left_anti") if once else entities
    near = nearest(rest, free)
    found = told.withColumns({"kind": F.lit("dictionary"), "distance": F.lit(None).cast("long")}).unionByName(equal.withColumns({"kind": F.lit("exact"), "distance": F.lit(0).cast("long")})).unionByName(near.withColumn("kind", F.lit("nearest")))
    return external.select("name").join(found, "name", "left").withColumn("kind", F.coalesce("kind", F.lit("none")))


def is_unambiguous(name: Column, entity: Column, told: Column) -> Column:
    """Whether a match may be stored: an entity, by dictionary or by equal normalised name."""
    return entity.isNotNull() & (F.coalesce(told, F.lit(False)) | (normalize_name(name) == normalize_name(entity)))


def split_matches(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches to store, and matches to report."""
    sure = F.coalesce(is_unambiguous(F.col("name"), F.col("entity"), F.col("kind") == "dictionary"), F.lit(False))
    return matches.where(sure), matches.where(~sure)


def summary(matches: DataFrame) -> DataFrame:
    """Counts: total, unambiguous, ambiguous and without an entity."""
    sure = F.coalesce(is_unambiguous(F.col("name"), F.col("entity"), F.col("kind") == "dictionary"), F.lit(False))
    return matches.agg(F.count(F.lit(1)).alias("total"), F.count_if(sure).alias("unambiguous"), F.count_if(~sure).alias("ambiguous"), F.count_if(F.col("entity").isNull()).alias("unmatched"))


def ambiguous_report(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Ambiguous matches with the tentative entity's fields, sorted as people sort names."""
    out = split_matches(matches)[1].join(entities.select("entity", "company", "url", "release_date").dropDuplicates(["entity"]), "entity", "left")
    return out.orderBy(F.collate("name", "UNICODE"), "name")


def unknown_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names (name, ord) that aren't among known (name); repeated ones stay."""
    return names.join(known.select("name").distinct(), "name", "left_anti")


def suggestions(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, closest, distance, ord) for each unknown name, nearest first."""
    unknown = unknown_names(names, known)
    found = nearest(unknown, known.select(F.col("name").alias("entity"), "ord"), normalized=False).withColumnRenamed("entity", "closest")
    return unknown.join(found, "name", "left").withColumn("closest", F.coalesce("closest", F.lit(""))).orderBy(F.col("distance").asc_nulls_last(), "ord")
