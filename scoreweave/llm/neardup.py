"""Near-duplicates by MinHash: minima of many universal hashes, banding, verification of signatures and full sets, and
connected components.

A document's set is its distinct word shingles. Documents with equal sets are one class, found by a 128-bit hash of the
set; only one document of a class goes on, so copies cost nothing further. Signatures of `bands` x `rows` minima put classes
into buckets, one a band. A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**rows)**bands, 1e-7 at 5 x 40.

Pairs are taken in two turns, and never all pairs of a group. First every bucket's smallest class is paired with the others;
verified links are joined into components. A bucket whose classes now are one component is done. In the others, components whose
signatures may be similar are gathered into families (one row a component, not one a pair), and a family's full sets are joined
exactly: two sets of similarity t share a shingle among the rarest (1 - t) + 1 of each, so only such pairs are compared, and
only between components not yet linked. Buckets and families larger than a block are dealt into blocks: those of the largest component, which
meet all others but not each other, and the rest, of which each two meet. So a large group and its stragglers take work by its size, and no
candidate is dropped, whatever the size of a bucket. A link counts once the full sets confirm it.

Groupings are written as tables before they are joined back: Spark splits a skewed join between tables, but not one with a grouping.

Defined results: a null text, and one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; a document with a null doc_id is left alone (component null, kept); rows that share a doc_id
are one document; repeated rows each get a row; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components_of_table
from .shared import Rolling, Words, bitmap, held_by, mix64, need, part_by, settle, steps, with_spot

BANDS, ROWS = 40, 5
#: Signatures below this estimate can't be of similar sets: 0.8 less 7 standard deviations of 200 minima.
MAYBE = 0.6
BLOCK = 1024
#: Shingles that are held against a set at once.
AT_ONCE = 1 << 18


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes."""
    words = Words(texts, lower=True)
    if not len(words.ids):
        return [np.zeros(0, np.uint64) for _ in range(len(texts))]
    rolling = Rolling(words.hashes()[words.ids])
    n = len(words.ids)
    every = rolling.at(np.arange(max(0, n - size + 1)), size)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(rolling.at(np.array([a]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and additions of n hashes x -> a * x + b modulo 2**64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n x bands, 64 bits) and the minima's low bytes (n x bands * rows) of sets that aren't empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    flat = np.concatenate(sets)
    a, b = universal(bands * rows)
    minima = np.empty((bands * rows, len(sets)), np.uint64)
    held = np.empty_like(flat)
    for i in range(bands * rows):
        np.multiply(flat, a[i], out=held)
        np.add(held, b[i], out=held)
        np.minimum.reduceat(held, starts, out=minima[i])
    keys = np.empty((len(sets), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(sets), k + 1, np.uint64)
        for i in range(k * rows, (k + 1) * rows):
            key = mix64(key * np.uint64(31) + minima[i])
        keys[:, k] = key
    return keys, (mix64(minima) & np.uint64(0xFF)).astype(np.uint8).T.copy()


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            sets = shingle_sets(part.column("text"), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            band: list[bytes | None] = [None] * len(sets)
            low: list[bytes | None] = [None] * len(sets)
            if full:
                keys, lows = signatures([sets[i] for i in full], bands, rows)
                for j, i in enumerate(full):
                    k1[i], k2[i] = mix64(sets[i], 1).sum(), mix64(sets[i], 2).sum()
                    band[i], low[i] = keys[j].astype(">u8").tobytes(), lows[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(band, pa.binary()), pa.array(low, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "band", "low"],
            )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, band binary, low binary")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, held): the full sets of documents with these ids, and of a few others that a bitmap passes; no text is shuffled."""
    bits = bitmap(ids, "id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(held_by(bits, batch.column("spot").to_numpy())))
            for part in steps(iter([wanted])):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"), size)], pa.binary())], ["id", "held"])

    rows = docs.where("doc_id is not null and text is not null").withColumnRenamed("doc_id", "id")
    return with_spot(rows, "id").mapInArrow(make, "id long, held binary")


def _maybe(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose signatures (low_u, low_v) may be of similar sets."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low_u", "low_v"))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(1) >= least))

    return pairs.mapInArrow(screen, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, a = [], None, None
            for u, x, y in zip(batch.column("u").to_pylist(), batch.column("held_u"), batch.column("held_v"), strict=True):
                if u != last:
                    a, last = np.frombuffer(x.as_buffer(), np.uint64), u
                b = np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    good.append(False)
                    continue
                both = len(a) + len(b)
                union = len(np.unique(np.concatenate([a, b])))
                good.append(100 * (both - union) >= percent * union)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("u"), F.col("held").alias("held_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("held").alias("held_v")), "v")
    return joined.select("u", "v", "held_u", "held_v").mapInArrow(confirm, "u long, v long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _families(members: DataFrame, block: int, least: float) -> DataFrame:
    """(u, v) components of which some classes share an unresolved bucket (bucket, id, component, low) and may be similar. A
    component is reached once a block, so there are fewer rows than members; a pair may come from several buckets."""

    def reach(rows: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        names, group = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        left = np.ones(len(names), bool)
        out = []
        while left.any():
            first = int(np.argmax(left))
            left[first], turn = False, [first]
            while turn:
                now = turn.pop()
                for k in np.nonzero(group == now)[0]:
                    there = np.nonzero(left[group])[0]
                    if not len(there):
                        break
                    near = there[(low[there] == low[k]).mean(1) >= least]
                    for g in np.unique(group[near]).tolist():
                        left[g] = False
                        turn.append(g)
                        out.append((names[now], names[g]))
        return _pairs(out)

    return _dealt(members, "bucket", block).groupBy("bucket", "i", "j").applyInArrow(reach, "u long, v long")


def _dealt(members: DataFrame, key: str, block: int) -> DataFrame:
    """members with own, i and j: a large group is dealt into blocks, and two blocks meet in a task of their own. Members of the group's largest
    component (hub) have blocks of their own, which don't meet each other, since they are linked already."""
    sizes = members.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max(F.struct("n", "component")).alias("hub"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = settle(sizes.select(key, F.col("hub.component").alias("hub"), blocks(F.col("hub.n")).alias("hubs"), blocks(F.col("n") - F.col("hub.n")).alias("rests")).where("rests > 0"), "near-sizes")
    within, dealt = F.col("component") == F.col("hub"), members.join(sizes, key)
    turn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt = dealt.withColumn("own", F.when(within, turn("hubs")).otherwise(F.col("hubs") + turn("rests")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(within, F.col("hubs")).otherwise(0), F.col("hubs") + F.col("rests") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "hub", "hubs", "rests")
    # Else Spark would be content with the join's partitions, which hold all blocks of a group in one task.
    return dealt.repartition(key, "i", "j")


def similar(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets of different groups that join all groups that such pairs join. side: only pairs of different
    sides, if given."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    tokens, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(tokens))
    rank = rank[token]
    starts = np.concatenate([[0], np.cumsum(n)])
    prefix = [np.sort(rank[a:b])[: b - a - -(-percent * (b - a) // 100) + 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    of = np.repeat(np.arange(len(sets)), [len(x) for x in prefix])
    keys = np.concatenate(prefix)
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    label = np.unique(group, return_inverse=True)[1]  # of groups that pairs found so far join
    mine = np.zeros(len(tokens), bool)  # the shingles of the set that others are held against
    out = []
    for i in range(len(sets)):
        lo, hi = np.searchsorted(keys, prefix[i], "left"), np.searchsorted(keys, prefix[i], "right")
        if not (hi - lo).sum() > len(prefix[i]):
            continue
        near = np.unique(np.concatenate([of[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a > 1]))
        near = near[(near > i) & (label[near] != label[i]) & (100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i]))]
        if side is not None:
            near = near[side[near] != side[i]]
        own = token[starts[i] : starts[i + 1]]
        mine[own] = True
        while len(near):
            now = near[: max(1, int(np.searchsorted(np.cumsum(n[near]), AT_ONCE, "right")))]
            ends = np.cumsum(n[now])
            held = token[np.repeat(starts[now] - (ends - n[now]), n[now]) + np.arange(ends[-1])]
            both = np.add.reduceat(mine[held], ends - n[now], dtype=np.int64)
            for j in now[100 * both >= percent * (n[i] + n[now] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
            near = near[len(now) :]
            near = near[label[near] != label[i]]
        mine[own] = False
    return out


def _within(members: DataFrame, block: int, percent: int) -> DataFrame:
    """Links (u, v) between components of each family (family, id, component, held)."""
    def meet(rows: pa.Table) -> pa.Table:
        component = rows.column("component").to_numpy()
        if (component == component[0]).all():
            return _pairs([])
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("held").to_pylist()]
        side = rows.column("own").to_numpy() if rows.column("i")[0] != rows.column("j")[0] else None
        ids = rows.column("id").to_pylist()
        return _pairs([(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in similar(sets, component, side, percent)])

    return _dealt(members, "family", block).groupBy("family", "i", "j").applyInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    need(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(_signed(docs, size, bands, rows), "near-signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = settle(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "near-classes")
    led = real.join(classes.select("k1", "k2", F.col("id").alias("doc_id")), ["k1", "k2", "doc_id"]).dropDuplicates(["k1", "k2", "doc_id"])
    led = settle(led.select(F.col("doc_id").alias("id"), "band", "low"), "near-led")
    in_bands = led.select("id", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("k"), "band").select("id", F.xxhash64("k", F.substring("band", F.col("k") * 8 + 1, F.lit(8))).alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("bucket", "first")
    members = settle(in_bands.join(settle(shared, "near-shared"), "bucket"), "near-buckets")
    low = lambda c: led.select(F.col("id").alias(c), F.col("low").alias(f"low_{c}"))
    stars = members.where("id > first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    stars = settle(_maybe(stars.join(low("u"), "u").join(low("v"), "v").select("u", "v", "low_u", "low_v"), MAYBE), "near-stars")

    ids = stars.select(F.col("u").alias("id")).unionByName(stars.select(F.col("v").alias("id")))
    sets = settle(_sets(docs, ids, size), "near-sets")
    links = settle(_confirmed(stars, sets, percent), "near-links")
    groups = components_of_table(links)
    placed = members.select("bucket", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = settle(placed.select("bucket", "id", "component"), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b and n > 2").select("bucket")
    left = settle(placed.join(settle(mixed, "near-mixed"), "bucket", "left_semi").join(led.select("id", "low"), "id").select("bucket", "id", "component", "low"), "near-left")
    if not left.isEmpty():
        families = components_of_table(settle(_families(left, 2 * block, MAYBE), "near-maybe")).select(F.col("node").alias("component"), F.col("component").alias("family"))
        inside = left.select("id", "component").distinct().join(families, "component")
        inside = settle(inside, "near-families")
        if not inside.isEmpty():
            sets = settle(_sets(docs, inside.select("id"), size).join(inside, "id"), "near-family-sets")
            more = settle(_within(sets.dropDuplicates(["family", "id"]), block, percent), "near-more")
            if not more.isEmpty():
                groups = components_of_table(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    # Two classes can lead with the same doc_id only if rows share it; they are one document then.
    known = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null")
    known = settle(known.select("k1", "k2", F.coalesce("component", "id").alias("found")), "near-known")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2"], "left")
    found = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of smallest doc_id. Of rows that share a doc_id one stays."""
    found = settle(near_duplicates(docs, **how), "near-found").where("doc_id is not null")
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept")
    twice = settle(twice, "near-dropped")
    maybe, clear = part_by(docs, twice, "doc_id")
    gone = maybe.join(twice.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if twice.where("n > 1 and kept").isEmpty():
        return clear.unionByName(gone)
    shared = twice.where("n > 1 and kept").select("doc_id")
    first = gone.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), "text").alias("whole"))
    return clear.unionByName(gone.join(shared, "doc_id", "left_anti").select(*docs.columns)).unionByName(first.select("whole.*"))
