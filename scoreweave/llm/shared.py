"""What the operators share: Arrow word splitting, hashing, sliding windows, and tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, settle  # noqa: F401  (the operators take them from here)

#: A word is a run of characters other than these six (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled by one vectorised step; a longer single text is a step of its own, and whole.
STEP_BYTES = 1 << 20


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't use."""
    used, name = {c.lower() for c in df.columns}, stem
    while name.lower() in used:
        name += "_"
    return name


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")


def keep_memory(room: int = 0) -> None:
    """How a worker treats freed memory from now on: it keeps `room` bytes for its next blocks, and gives back the rest. Workers live on
    between stages, and an executor's memory is the sum of all, so only operators whose time goes into many small arrays keep some."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20 if room else 4 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped, and go when they are freed
        libc.mallopt(-1, max(room, 128 << 10))  # M_TRIM_THRESHOLD
        if not room:
            libc.malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on: rows hold texts, and a batch is in memory several times, in the JVM and
    in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES, room: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text; every row is in one slice. room: see keep_memory; what is kept is given
    back with the last slice."""
    keep_memory(room)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    keep_memory()


class Words:
    """Words of a slice of texts. offsets: n + 1 positions into ids; ids: index into vocab; vocab: distinct words, as UTF-8.
    lower: A-Z become a-z."""

    __slots__ = ("ids", "offsets", "vocab")

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        told = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        inside = (told != 32) & ((told < 9) | (told > 13))
        fresh = np.ones(len(told) + 1, bool)  # whether a word could start at a byte
        np.logical_not(inside, out=fresh[1:])
        fresh[ends] = True
        starts = np.nonzero(inside & fresh[:-1])[0]
        letters = told[inside]
        if lower:
            letters = letters + (((letters >= 65) & (letters <= 90)).view(np.uint8) << 5)
        cuts = np.empty(len(starts) + 1, np.int64)
        cuts[:-1] = np.cumsum(inside, dtype=np.int32)[starts] - 1 if len(told) < 1 << 31 else np.cumsum(inside)[starts] - 1
        cuts[-1] = len(letters)
        self.offsets = np.searchsorted(starts, ends)
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
        coded = flat.dictionary_encode()
        self.ids, self.vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def listed(self) -> list[bytes]:
        """The distinct words."""
        return self.vocab.to_numpy(zero_copy_only=False).tolist()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word; the same in every process."""
        return hash_bytes(self.vocab)


#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_bytes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string: a polynomial of its bytes' values, and its length; the same in every process."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    return Rolling(BYTE_VALUES[data], 0xD1342543DE82EF95).at(ends[:-1], np.diff(ends))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> None:
        n = len(values)
        powers = np.full(n + 1, np.uint64(base))
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])

    def at(self, starts: np.ndarray, lengths: np.ndarray | int, first: np.ndarray | None = None) -> np.ndarray:
        """Hash of values[start : start + length] for each start; the length counts too. first: added to the first value."""
        found = (self.sums[starts + lengths] - self.sums[starts]) * self.back[starts]
        if first is not None:
            found = found + first
        return mix64(found + np.asarray(lengths).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


#: Bits of a map of wanted keys: a fixed size, so that it can be broadcast whatever their number.
MAP_BITS = 1 << 23


def _spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MAP_BITS))


def bitmap(keys: DataFrame, name: str) -> Broadcast:
    """A map of the hashes of a column. It may pass keys that aren't there, the more the more keys there are, and misses none."""
    spot = _spot(F.col(name))
    words = keys.select((spot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # MAP_BITS / 64 rows at most
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits)


def held_by(bits: Broadcast, spots: np.ndarray) -> np.ndarray:
    """Whether the map may hold the keys of these spots."""
    return ((bits.value[spots >> 6] >> (spots & 63)) & 1).astype(bool)


def with_spot(df: DataFrame, name: str, spot: str = "spot") -> DataFrame:
    """df plus the place of a column's values in bitmaps."""
    return df.withColumn(spot, _spot(F.col(name)))


def maybe_in(df: DataFrame, bits: Broadcast, name: str) -> Column:
    """Whether the map may hold a column's value. Only its hash goes to Python, and the rest of the row stays."""

    @F.arrow_udf("boolean")
    def held(spots: pa.Array) -> pa.Array:
        return pa.array(held_by(bits, spots.to_numpy(zero_copy_only=False)))

    return held(_spot(F.col(name)))


def part_by(df: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose column `name` may be among that of keys, and rows whose is not for sure. The second needs no
    join, so wide rows stay where they are."""
    flag = free_name(df, "wanted")
    marked = df.withColumn(flag, maybe_in(df, bitmap(keys, name), name))
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5
