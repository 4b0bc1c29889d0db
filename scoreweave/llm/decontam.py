"""Benchmark decontamination by templates.

Words are stripped of punctuation and case. Numbers, names (capitalised inside a sentence) and units (after a number) become typed
placeholders, so a question with other numbers and names has the same template. Windows of `window` template words, and the same
windows of the words as they are, are hash-joined with the benchmark's; windows that follow each other in both texts are a run. A run counts if its slots are
consistent throughout: an item's number, name or unit stands for one and the same value of the document, and a value of the document for one of the
item. A consistent run of `least` words (or all but two words of a shorter item) is contamination. So are `verbatim` words of an item as
they are, whatever stands beside them: a run with inconsistent slots may hold a quotation.

A fixed-size bitmap of the benchmark's window hashes (2**22 bits, whatever the benchmark's size) lets windows that can't match
stay where they are; the join that follows is exact, and Spark chooses its kind by the tables' sizes.

Defined results: a null text has no windows; an item with fewer than `shortest` words matches nothing, one shorter than a window
is a window of its own length; a window of placeholders must hold at least half literal words; rows that repeat or share a doc_id are judged by
their own text; an empty table of documents or benchmark items gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Rolling, Words, hash_bytes, need, part_by, settle, steps

WIDTH, LEAST, VERBATIM, SHORTEST = 8, 13, 20, 5
BITS = 22
#: Units, after a number (fixed values).
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons tonnes ml cl dl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms us ns hz khz mhz ghz w kw mw v kv a ma j kj cal kcal "
    "n pa kpa bar k c f percent % € $ £ dollar dollars euro euros cent cents pound pounds kmh mph kph meter meters metre metres gram grams kilogram kilograms".split()
)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA076_1D64_78BD_642F, 0xE703_7ED1_A0B4_28DB, 0x8EBC_6AF0_9C88_C6E3))
OUT = "h long, id long, key long, at int, n_words int, slots array<string>"


def template(texts: pa.Array) -> tuple:
    """Template words of the texts: offsets, hashes, whether each is a slot, index into values, values (bare words), hashes of the
    words as they are, and whether each is a name."""
    words = Words(texts)
    vocab = words.vocab.cast(pa.large_string())
    bare = pc.replace_substring_regex(vocab, r"^[^\pL\pN%€$£]+|[^\pL\pN%€$£]+$", "")
    lower = pc.utf8_lower(bare)
    flag = lambda x: x.to_numpy(zero_copy_only=False)[words.ids]
    real = flag(pc.not_equal(pc.utf8_length(pc.replace_substring_regex(bare, r"[^\pL\pN]+", "")), 0))
    number = flag(pc.match_substring_regex(bare, r"^[$€£]?[+-]?[0-9][0-9.,:/]*%?$"))
    title = flag(pc.match_substring_regex(bare, r"^\p{Lu}\p{Ll}+$"))
    stop = flag(pc.match_substring_regex(vocab, r"[.!?:;][\"')\]]*[^\pL\pN]*$"))
    unit = flag(pc.is_in(lower, value_set=pa.array(sorted(UNITS), pa.large_string())))
    plain = hash_bytes(lower.cast(pa.large_binary()))[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    rows = words.rows()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = rows[1:] != rows[:-1]
    after = lambda x: np.concatenate([[False], x[:-1]]) & ~fresh
    name = title & ~fresh & ~after(stop)
    unit &= after(number)
    hashes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, plain)))
    kept = np.concatenate([[0], np.cumsum(real)])
    return kept[words.offsets], hashes[real], (number | unit | name)[real], words.ids[real], lower, plain[real], name[real]


def windows(rows: DataFrame, sizes: list[int], bitmap=None) -> DataFrame:
    """Template and literal windows of rows (id, key, text): OUT. With no sizes, those of items: windows of WIDTH, or of the whole item."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.frombuffer(bitmap.value, bool) if bitmap is not None else None
        for part in steps(batches):
            offsets, hashes, slot, ids, values, plain, as_name = template(part.column("text"))
            counts = np.diff(offsets)
            of = np.repeat(np.arange(len(counts)), counts)
            rolling, exact, slots = Rolling(hashes), Rolling(plain), np.concatenate([[0], np.cumsum(slot)])
            for size in sizes or range(SHORTEST, WIDTH + 1):
                at = np.arange(max(0, len(hashes) - size + 1))
                good = of[at] == of[at + size - 1]
                if not sizes and size < WIDTH:
                    good &= counts[of[at]] == size
                at = at[good]
                n_slots = slots[at + size] - slots[at]
                some = at[n_slots > 0]  # without slots the words are the template
                at = at[2 * n_slots <= size]
                keys = rolling.at(at, size)
                bare = np.zeros(len(at), bool)
                if mine is not None:
                    # A text may quote an item from its first word on, which then looks like a name: try it as a word, too.
                    named = np.nonzero(as_name[at])[0]
                    first = plain[at[named]] - hashes[at[named]]
                    keys = np.concatenate([keys, rolling.at(at[named], size, first)])
                    bare = np.concatenate([bare, np.ones(len(named), bool)])
                    at = np.concatenate([at, at[named]])
                keys, at = np.concatenate([keys, exact.at(some, size)]), np.concatenate([at, some])
                bare = np.concatenate([bare, np.zeros(len(some), bool)])
                literal = np.arange(len(at)) >= len(at) - len(some)
                if mine is not None:
                    hit = mine[keys >> np.uint64(64 - BITS)]
                    at, keys, bare, literal = at[hit], keys[hit], bare[hit], literal[hit]
                if not len(at):
                    continue
                # A text's literal window has no slots of its own: each of the item's stands for itself.
                bound = [range(0) if x and mine is not None else range(b, size) for b, x in zip(bare.tolist(), literal.tolist(), strict=True)]
                told = [[f"{size}:{i}:{values[ids[a + i]].as_py()}" for i in r if slot[a + i]] for a, r in zip(at.tolist(), bound, strict=True)]
                rows_at = pa.array(of[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), part.column("id").take(rows_at), part.column("key").take(rows_at), pa.array((at - offsets[of[at]]).astype(np.int32)), pa.array(counts[of[at]].astype(np.int32)), pa.array(told, pa.list_(pa.string()))],
                    ["h", "id", "key", "at", "n_words", "slots"],
                )

    return rows.mapInArrow(spell, OUT)


def _rows(df: DataFrame, name: str) -> DataFrame:
    out = df.select(F.col(name).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return out.withColumn("key", F.xxhash64("id", "text"))


def matches(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, verbatim: int = VERBATIM) -> DataFrame:
    """One row for each contaminated text and item: doc_id, key (a hash of doc_id and text), item_id, run_words (longest
    run), item_words, share."""
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    spark = docs.sparkSession
    items = settle(windows(_rows(benchmark, "item_id"), []), "decontam-items")
    sizes = sorted({r[0] for r in items.select(F.least("n_words", F.lit(WIDTH))).distinct().collect()})
    bits = np.zeros(1 << BITS, bool)
    spots = items.select(F.shiftrightunsigned("h", 64 - BITS).alias("spot")).distinct().toArrow().column("spot").to_numpy()  # 2**22 at most
    bits[spots.astype(np.int64)] = True
    hits = windows(_rows(docs, "doc_id"), sizes or [WIDTH], spark.sparkContext.broadcast(bits.tobytes()))
    items = items.select("h", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots")).distinct()
    # Slots of a window are in the order of their places, which are the same in both; in a literal match an item's stand for themselves.
    values = F.when(F.size("slots") == 0, F.col("item_slots")).otherwise(F.col("slots"))
    both = hits.join(items, "h").withColumn("slots", values).withColumn("pairs", F.zip_with("item_slots", "slots", lambda a, b: F.struct(F.split(a, ":", 3)[2].alias("a"), F.split(b, ":", 3)[2].alias("b"))))
    same = F.forall("pairs", lambda p: p["a"] == p["b"])  # the item's words as they are
    both = both.select("id", "key", "item_id", "item_words", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "pairs", F.coalesce(same, F.lit(False)).alias("same")).distinct()
    whole = ["id", "key", "item_id", "item_words", "shift"]
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))

    def runs(rows: DataFrame) -> DataFrame:
        """Windows at places that follow each other are a run; a window may be there twice, as a template and as its words."""
        rows = rows.withColumn("run", F.col("item_at") - F.dense_rank().over(Window.partitionBy(*whole).orderBy("item_at")))
        rows = rows.groupBy(*whole, "run").agg((F.max("item_at") - F.min("item_at")).alias("steps"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
        return rows.withColumn("run_words", F.col("steps") + F.least("item_words", F.lit(WIDTH)))

    needed = F.when(F.col("item_words") <= WIDTH, F.col("item_words")).otherwise(F.least(F.lit(least), F.greatest(F.lit(WIDTH), F.col("item_words") - 2)))
    steady = runs(both).where((values("a") == F.size("pairs")) & (values("b") == F.size("pairs")) & (F.col("run_words") >= needed))
    lines = steady.unionByName(runs(both.where("same")).where(F.col("run_words") >= verbatim))
    out = lines.groupBy("id", "key", "item_id", "item_words").agg(F.max("run_words").alias("run_words"))
    return out.select(F.col("id").alias("doc_id"), "key", "item_id", "run_words", "item_words", (F.col("run_words") / F.col("item_words")).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, verbatim: int = VERBATIM) -> DataFrame:
    """docs without contaminated rows."""
    found = settle(matches(docs, benchmark, least=least, verbatim=verbatim).select("doc_id", "key").distinct(), "decontam-found")
    own = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    maybe, clear = part_by(own, found, "key")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    left = maybe.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    return clear.select("whole.*").unionByName(left.select("whole.*"))
