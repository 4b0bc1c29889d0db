"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected `target / source size` times. Documents of a source stand in a fixed order, the
expected copies are summed along it, one offset per source is added, and a document is emitted once for each integer
boundary that its stretch crosses. The order is by size class first, so the words taken stay near the target.

A source may hold a third of all rows, so ranks are made in two steps: rows fall into cells of about `cell_rows` rows
(source, size class, range of a hash of doc_id and text), counts of cells are summed along the order, and only the rank inside a cell needs its
rows together. Sources themselves, of which there may be many, are summed along their order by ranges.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a document of size 0 is
never taken; rows that repeat are documents of their own, and so are those without a doc_id; an empty table gives an empty table. Other columns are kept,
whatever their names. A source of few documents can miss its target by the size of one of them, since the offset is drawn once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, need, settle

#: Sources by code point weigh these, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Not null, and in the order of sources: by code point, null last."""
    return F.struct(source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"))


def _along(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """df plus place (from 1) and before_<c> for each c of sums: the sum of c over the rows before, along an order. Rows are summed range by
    range, and only the ranges' totals, as many as partitions, come together."""
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settle(df.repartitionByRange(ways, *order).withColumn("range", F.spark_partition_id()), name)
    totals = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    past = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"past_{c}") for c in ["n", *(f"all_{c}" for c in sums)]])
    inside = W.partitionBy("range").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(totals, "range").withColumn("place", F.col("past_n") + F.row_number().over(inside))
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"past_all_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("range", *[c for c in out.columns if c.startswith("past_")])


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: k (key), source_size, target.

    The reshared targets are min(max_repeat * size, level * weight) for the one level at which they sum to the total:
    sources ordered by size per weight reach their limit one after the other, and prefix sums give the level after each.
    All sums are of whole numbers, so every run agrees to the last bit."""
    per = _along(sized.groupBy("k").agg(F.sum("size").alias("source_size")), [F.col("k")], [], "mix-sources")
    share = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = per.select("k", "source_size", share.cast("long").alias("weight"), (F.col("source_size") * max_repeat).alias("limit"))
    per = settle(_along(per, [F.col("limit") / F.col("weight"), F.col("k")], ["limit", "weight"], "mix-order"), "mix-levels")
    whole = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    total, all_weight = int(whole.total or 0), int(whole.weight or 0)
    open_weight = F.lit(all_weight) - F.col("before_weight")
    left = F.lit(total) - F.col("before_limit")
    fits = F.col("limit") * open_weight >= left * F.col("weight")
    level = per.where(fits).agg(F.min(F.struct("place", left.alias("left"), open_weight.alias("open")))).first()[0]
    limit = F.col("limit").cast("double")
    if level is None:
        return per.select("k", "source_size", limit.alias("target"))
    shared = F.lit(int(level.left)).cast("double") * F.col("weight") / F.lit(int(level.open))
    return per.select("k", "source_size", F.when(F.col("place") < int(level.place), limit).otherwise(shared).alias("target"))


def _offset(key: Column, seed: int) -> Column:
    """A number in (0, 1) for each source, from the first four hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.when(key["absent"], F.lit("null")).otherwise(F.concat(F.lit("="), key["name"]))).cast("binary"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substr(digest, F.lit(i), F.lit(1))) - 1
    return (digit(1) * 4096 + digit(2) * 256 + digit(3) * 16 + digit(4) + 0.5) / 65536.0


def _placed(df: DataFrame) -> DataFrame:
    """df plus bin: length and first two digits of the size."""
    digits = F.col("size").cast("string")
    return df.withColumn("bin", F.length(digits) * 100 + F.substr(digits, F.lit(1), F.lit(2)).cast("int"))


def _cell() -> Column:
    return F.shiftright(F.col("spot") * F.col("n_cells"), 32)


def _starts(sized: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Cells of each (source, bin), and the number of a source's rows before each cell."""
    bins = _placed(sized).groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n_bin"))
    before = lambda keys, order, n: F.coalesce(F.sum(n).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = settle(bins.select("k", "bin", F.ceil(F.col("n_bin") / cell_rows).cast("long").alias("n_cells"), before(["k"], "bin", "n_bin").alias("bin_start")), "mix-bins")
    cells = _placed(sized).join(bins, ["k", "bin"]).groupBy("k", "bin", "bin_start", _cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("k", "bin", "cell", (F.col("bin_start") + before(["k", "bin"], "cell", "n")).alias("start"))
    return bins.drop("bin_start"), cells


def _ranked(rows: DataFrame, starts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """rows plus place, the number of the source's rows before each."""
    bins, cells = starts
    out = _placed(rows).join(bins, ["k", "bin"]).withColumn("cell", _cell()).join(cells, ["k", "bin", "cell"])
    order = W.partitionBy("k", "bin", "cell").orderBy("spot", F.col("doc_id").asc_nulls_first(), "size", "mark")
    return out.withColumn("place", F.col("start") + F.row_number().over(order) - 1).drop("bin", "spot", "mark", "cell", "n_cells", "start")


def _crossed(offset: Column, max_repeat: int) -> Column:
    """Whole numbers that a row's stretch of the source's prefix sum crosses."""
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda n: F.floor(offset + each * n)
    n = F.least(at(F.col("place") + 1) - at(F.col("place")), F.lit(max_repeat))
    return F.when(F.col("size") > 0, n).otherwise(F.lit(0)).cast("long")


def _key_and_size() -> list[Column]:
    """k, doc_id, size; spot: a scrambled doc_id and text, the order in a bin; mark: the text's hash, for ties."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    spot = F.conv(F.substr(told, F.lit(1), F.lit(8)), 16, 10).cast("long")
    return [_key(F.col("source").cast("string")).alias("k"), F.col("doc_id"), word_count(F.col("text").cast("string")).alias("size"), spot.alias("spot"), F.xxhash64(text).alias("mark")]


def _plan(docs: DataFrame, weights, max_repeat: int, seed: int, cell_rows: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Sizes, targets with one random offset a source, and where cells start."""
    need(docs, "doc_id", "text", "source")
    sized = settle(docs.select(*_key_and_size()), "mix-sizes")
    targets = source_targets(sized, weights, max_repeat)
    return sized, settle(targets.withColumn("offset", _offset(F.col("k"), seed)), "mix-targets"), _starts(sized, cell_rows)


def mix_sizes(docs: DataFrame, *, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 1, cell_rows: int = 256) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and n_copies."""
    sized, targets, starts = _plan(docs, weights, max_repeat, seed, cell_rows)
    out = _ranked(sized, starts).join(targets, "k").withColumn("n_copies", _crossed(F.col("offset"), max_repeat))
    return out.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def mix_documents(docs: DataFrame, *, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 1, cell_rows: int = 256) -> DataFrame:
    """The mixed corpus: every document's row as many times as it is taken, with its columns."""
    _, targets, starts = _plan(docs, weights, max_repeat, seed, cell_rows)
    whole = docs.select(F.struct("*").alias("whole"), *_key_and_size())
    out = _ranked(whole, starts).join(targets, "k").withColumn("n_copies", _crossed(F.col("offset"), max_repeat))
    out = out.where(F.col("n_copies") > 0).select("whole", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("n"))
    return out.select("whole.*")
