"""Substring dedup by De Bruijn compaction.

The graph. Nodes are word k-mers, thinned out: the k-mer of smallest hash among every `reach` consecutive ones is an anchor, so any
window of `window` words holds two anchors at least that depend on its own words alone. An edge runs from one anchor to the next: the words they cover,
told by 128 bits of hash, with source coordinates (document, first word, words). So equal windows share an edge.

Compaction. Edges that stand in more documents than one are the repeated part of the graph. A node with one repeated edge in and one
out doesn't branch; a join of edges over such nodes links each edge to the one before it, and joins of pointers (each round doubles
their reach) give every edge the head of its nonbranching path and its place there. Rounds end when no edge comes nearer to a head; what is
left then are circles (text that repeats itself).

Verification. Occurrences of repeated edges get their path by a join; edges that follow each other in a document and on the path
are a run. A run over a whole path is the same words in every document that has one, so all of its windows but those of the
smallest doc_id go. All other windows that hold a repeated edge (paths cut short, first copies of such, the ends of passages) are
joined one by one by 128 bits. The first document of a window is among these, unless the window stands in whole runs alone: if its
run were one that goes, a smaller doc_id would have the window. So the joins miss none.

Disk. A table goes as soon as the one made of it is there, and shuffle files go with the write that made them, so edges and windows
are never on disk together.

The smallest doc_id of a hash is found by a grouped minimum, which Spark combines before it shuffles; a passage shared by a third of
all documents is one row of that table. Spark splits the join back where it is skewed.

Defined results: a null text, and one without words, has no words; a text shorter than a window loses nothing; a document with a
null doc_id is neither cut nor a reason to cut; rows that share a doc_id don't cut each other, and each is cut by smaller
ones; repeated rows each get a row; an empty table gives an empty one; other columns are kept by drop_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Words, bitmap, forget, held_by, maybe_in, mix64, need, part_by, settle, sliding, steps, with_spot

WINDOW, KMER = 50, 12
SECOND = 0xC2B2AE3D27D4EB4F | 1


def _settle(df: DataFrame, name: str, made: list | None = None) -> DataFrame:
    """df as a table, which made, if given, gets too. Most of this operator's disk are shuffles of edges and windows: they go with the write."""
    out = settle(df, name, tidy=True)
    if made is not None:
        made.append(out)
    return out


class Graph:
    """Anchors and edges of a slice of texts. Of each edge: row, first word (in all of the slice's words), words, node it leaves, node it enters."""

    def __init__(self, texts: pa.Array, window: int, kmer: int) -> None:
        self.words = words = Words(texts)
        n = len(words.ids)
        hashes = words.hashes()[words.ids] if n else np.zeros(0, np.uint64)
        self.one, self.two = Rolling(hashes), Rolling(mix64(hashes, 5), SECOND)
        none = np.zeros(0, np.int64)
        self.row, self.first, self.size, self.out, self.into = none, none, none, none.view(np.uint64), none.view(np.uint64)
        if n < window:
            return
        reach = (window - kmer + 1) // 2
        span = reach + kmer - 1
        rows = words.rows()
        grams = self.one.at(np.arange(n - kmer + 1), kmer) | np.uint64(1)  # never 0
        starts = np.arange(n - span + 1)
        least = np.where(rows[starts] == rows[starts + span - 1], sliding(grams, reach, np.minimum), np.uint64(0))
        # An anchor's hash is the least of some stretch around it.
        pad = np.zeros(reach - 1, np.uint64)
        anchors = np.nonzero(sliding(np.concatenate([pad, least, pad]), reach, np.maximum) == grams)[0]
        of = rows[anchors]
        head = np.nonzero(of[1:] == of[:-1])[0]
        a, b = anchors[head], anchors[head + 1]
        self.row, self.first, self.size, self.out, self.into = of[head], a, b + kmer - a, grams[a], grams[b]


def _edges(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    """A row for each edge of each text: 128 bits of its words (h, v), its nodes (out, into), and where it stands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda x: pa.array(x.view(np.int64))
        for part in steps(batches):
            g = Graph(part.column("text"), window, kmer)
            rows = pa.array(g.row)
            first = g.first - (g.words.offsets[g.row] if len(g.row) else g.row)
            yield pa.RecordBatch.from_arrays(
                [told(g.one.at(g.first, g.size)), told(g.two.at(g.first, g.size)), told(g.out), told(g.into), part.column("doc_id").take(rows), part.column("key").take(rows), pa.array(first, pa.int32()), pa.array(g.size, pa.int32())],
                ["h", "v", "out", "into", "doc_id", "key", "first", "size"],
            )

    return docs.mapInArrow(cut, "h long, v long, out long, into long, doc_id long, key long, first int, size int")


def compacted(edges: DataFrame, made: list | None = None) -> DataFrame:
    """(edge, head, place, length) of edges (edge, out, into), each once: the first edge of its nonbranching path, the edges before it there, and
    the path's edges. On a circle an edge is its own head, and place and length are 0. made gets the tables that these rows are read from."""
    # A node without branches is one row on either side of the join.
    leaving = edges.groupBy(F.col("out").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("edge")).where("n = 1").drop("n")
    entering = edges.groupBy(F.col("into").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("before")).where("n = 1").drop("n")
    links = leaving.join(entering, "node").select("edge", "before")
    first = F.col("before").isNull()
    now = edges.select("edge").join(links, "edge", "left").select("edge", F.coalesce("before", "edge").alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("place"), first.alias("done"))
    now = _settle(now, "substring-pointers", made)
    # Each round writes only the edges that weren't at their heads before it.
    there, now = now.where("done"), now.where("not done")
    left = now.count()
    while left:
        ahead = there.unionByName(now).select(F.col("edge").alias("to"), F.col("to").alias("beyond"), F.col("place").alias("more"), F.col("done").alias("there"))
        moved = now.join(ahead, "to").select("edge", F.col("beyond").alias("to"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done"))
        moved = _settle(moved, "substring-pointers", made)
        there, now = there.unionByName(moved.where("done")), moved.where("not done")
        before, left = left, now.count()
        if left == before:  # edges of a path come to its head at least one a round
            break
    now = there.unionByName(now).select("edge", F.when(F.col("done"), F.col("to")).otherwise(F.col("edge")).alias("head"), F.when(F.col("done"), F.col("place")).otherwise(0).alias("place"), F.col("done").cast("long").alias("line"))
    lengths = now.groupBy("head").agg((F.max("place") + F.max("line")).alias("length"))
    return now.drop("line").join(lengths, "head")


def _paths(edges: DataFrame) -> DataFrame:
    """(h, v, head, place, length) of each repeated edge; head is two columns."""
    shared = edges.groupBy("h", "v").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("out").alias("out"), F.min("into").alias("into"))
    made = []
    shared = _settle(shared.where("least < most").select(F.struct("h", "v").alias("edge"), "out", "into"), "substring-repeated", made)
    paths = _settle(compacted(shared, made).select("edge.h", "edge.v", F.col("head.h").alias("head_h"), F.col("head.v").alias("head_v"), "place", "length"), "substring-paths")
    forget(*made)
    return paths


def _runs(edges: DataFrame, paths: DataFrame, window: int, kmer: int, made: list | None = None) -> DataFrame:
    """(doc_id, key, head_h, head_v, whole, start, stop, low, high): stretches of a text whose edges follow each other on a path; its words
    [start, stop), and the windows [low, high] that hold an edge of it. whole: the path from its head to its end. made: as in compacted."""
    at = edges.join(paths, ["h", "v"]).select("doc_id", "key", F.struct("first", "size", "head_h", "head_v", "place", "length").alias("at"))
    at = _settle(at.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("at")), "substring-places", made)  # a text's own edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("at")
            row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            flat = held.flatten()
            first, size, h, v, place, length = (flat.field(i).to_numpy() for i in range(6))
            follows = np.zeros(len(row), bool)
            follows[1:] = (row[1:] == row[:-1]) & (first[1:] == first[:-1] + size[:-1] - kmer) & (place[1:] == place[:-1] + 1) & (h[1:] == h[:-1]) & (v[1:] == v[:-1])
            head = np.nonzero(~follows)[0]
            tail = np.append(head[1:], len(row)) - 1
            whole = (place[head] == 0) & (tail - head + 1 == length[head])
            rows = pa.array(row[head])
            columns = [pa.array(h[head]), pa.array(v[head]), pa.array(whole), *(pa.array(x.astype(np.int32)) for x in (first[head], first[tail] + size[tail], first[head] + size[head] - window, first[tail]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), *columns], ["doc_id", "key", "head_h", "head_v", "whole", "start", "stop", "low", "high"])

    return at.mapInArrow(run, "doc_id long, key long, head_h long, head_v long, whole boolean, start int, stop int, low int, high int")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(h, v, doc_id, key, first) for each single window in the ranges `open` of rows (doc_id, key, text, open)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            words = Words(part.column("text"))
            hashes = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
            one, two = Rolling(hashes), Rolling(mix64(hashes, 5), SECOND)
            at, of = [], []
            for i, ranges in enumerate(part.column("open").to_pylist()):
                wanted = np.zeros(max(0, int(words.counts[i]) - window + 1), bool)
                for r in ranges or ():
                    wanted[max(0, r["first"]) : max(0, r["first"] + r["number"])] = True
                found = np.nonzero(wanted)[0]
                at.append(found + words.offsets[i])
                of.append(np.full(len(found), i))
            at, of = np.concatenate(at), np.concatenate(of)
            for a in range(0, len(at), 1 << 16):  # small batches for the JVM
                k, rows_at = at[a : a + (1 << 16)], of[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.at(k, window).view(np.int64)), pa.array(two.at(k, window).view(np.int64)), part.column("doc_id").take(pa.array(rows_at)), part.column("key").take(pa.array(rows_at)), pa.array((k - words.offsets[rows_at]).astype(np.int32))],
                    ["h", "v", "doc_id", "key", "first"],
                )

    return rows.mapInArrow(spell, "h long, v long, doc_id long, key long, first int")


def _found(rows: DataFrame, made: list | None = None) -> DataFrame:
    """rows plus least: the smallest doc_id with the same hashes, of hashes that more doc_ids than one have. These are a table of
    their own, since Spark splits a skewed join between tables but not one with a grouping. made: as in compacted."""
    shared = rows.groupBy("h", "v").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "v", "least")
    return rows.join(_settle(shared, "substring-shared", made), ["h", "v"])


def covered_words(ranges: list, n: int, window: int) -> np.ndarray:
    """Which of n words stand in the windows of (first, number) ranges."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges:
        edge[r["first"]] += 1
        edge[min(n, r["first"] + r["number"] - 1 + window)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: the text's own number besides doc_id, in case rows share that."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, *, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, key, gone): the window ranges of each text that a document of smaller doc_id has too, texts without left out.
    A text is told by its doc_id and key, a hash of both."""
    need(docs, "doc_id", "text")
    if kmer >= window:
        raise ValueError("a window must be longer than an anchor")
    texts = _numbered(docs)
    known = texts.where("doc_id is not null")
    made = []  # tables that the next one is read from; they go when it is there
    edges = _settle(_edges(known, window, kmer), "substring-edges", made)
    made.append(paths := _paths(edges))
    runs = _settle(_runs(edges, paths, window, kmer, made), "substring-runs")
    forget(*made)
    made = [runs]
    by = F.when(F.col("whole"), F.col("doc_id"))
    whole = runs.groupBy("head_h", "head_v").agg(F.min(by).alias("least"), F.max(by).alias("most"), F.bool_and("whole").alias("closed")).where("least < most").drop("most")
    marked = runs.join(_settle(whole, "substring-whole", made), ["head_h", "head_v"], "left")
    full = F.col("whole") & (F.col("stop") - F.col("start") >= window) & F.col("least").isNotNull()
    cut = full & (F.col("doc_id") > F.col("least"))
    # Where all runs of a path are whole, others with a window inside the first copy's run are cut by their own runs.
    inside = full & (F.col("closed") | (F.col("doc_id") > F.col("least")))
    ranged = lambda first, last: F.struct(first.alias("first"), (last - first + 1).alias("number"))
    around = F.array(ranged(F.col("low"), F.col("start") - 1), ranged(F.col("stop") - (window - 1), F.col("high")))
    marked = marked.select("doc_id", "key", F.when(cut, F.array(ranged(F.col("start"), F.col("stop") - window))).alias("gone"), F.when(inside, around).otherwise(F.array(ranged(F.col("low"), F.col("high")))).alias("open"))
    # One row a text, and its ranges are no more than its words.
    ranges = marked.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.filter(F.flatten(F.collect_list("open")), lambda r: r["number"] > 0).alias("open"))
    ranges = _settle(ranges, "substring-ranges")
    forget(*made)
    made = [ranges]
    opened = ranges.where(F.size("open") > 0).select("doc_id", "key", "open")
    singles = _settle(_windows(part_by(known, opened, "key")[0].join(opened, ["doc_id", "key"]), window), "substring-windows", made)
    single = _found(singles, made).where("doc_id > least").groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", F.lit(1).alias("number"))).alias("gone"))
    both = ranges.where(F.size("gone") > 0).select("doc_id", "key", "gone").unionByName(single)
    gone = _settle(both.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone")), "substring-gone")
    forget(*made)
    return gone


def _kept(texts: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """texts (doc_id, text, key and others) less what gone tells: plus n_words, n_removed and kept (words joined by a space,
    or the text itself where nothing goes)."""
    bits = bitmap(gone, "key")
    rows = texts.where(maybe_in(texts, bits, "key")).join(gone, ["doc_id", "key"], "left").withColumn("spot", F.lit(-1).cast("long"))
    clear = with_spot(texts, "key").withColumn("gone", F.lit(None).cast(rows.schema["gone"].dataType))
    rows = rows.unionByName(clear)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column("spot").to_numpy()
            # Rows that the map may hold came from the join already.
            mine = (spots < 0) | ~held_by(bits, np.maximum(spots, 0))
            for part in steps(iter([batch.filter(pa.array(mine))])):
                yield stripped(part)

    def stripped(part: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept, digests = [], [], [], []
        for text, ranges in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("gone").to_pylist(), strict=True):
            words = text.split()
            left = words
            if ranges:
                off = covered_words(ranges, len(words), window)
                left = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(text if len(left) == len(words) else joined)
            digests.append(hashlib.sha256(joined).hexdigest())
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.string()), pa.array(digests, pa.string())]
        held = [c for c in part.schema.names if c not in ("gone", "key", "text", "spot")]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in held), *made], [*held, "n_words", "n_removed", "kept", "digest"])

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("gone", "key", "text", "spot"))
    return rows.mapInArrow(strip, f"{held}, n_words long, n_removed long, kept string, digest string")


def repeat_counts(docs: DataFrame, *, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    gone = repeats(docs, window=window, kmer=kmer)
    return _kept(_numbered(docs), gone, window).select("doc_id", "n_words", "n_removed", F.col("digest").alias("kept_sha256"))


def drop_repeats(docs: DataFrame, *, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """docs with repeated words taken out of text: the words left, joined by a space. A text that loses nothing stays as it is;
    a document that loses all of its words goes. Columns are those of docs; n_chars, if there, is counted anew."""
    gone = repeats(docs, window=window, kmer=kmer)
    whole = docs.select(F.struct("*").alias("whole"), *[c for c in ("doc_id", "text")])
    texts = whole.select("whole", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("whole", F.col("whole").dropFields("text"))
    out = _kept(texts, gone, window).where("n_removed = 0 or n_removed < n_words")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("whole.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("whole").getField(c).alias(c))
    return out.select(*columns)
