"""Language identification with bit-sliced Bloom filters of n-grams.

One table of bit masks is the filter of all languages: a position holds a bit for each. The positions of an n-gram are
ANDed, and the bits left are the languages that contain it. Bits are counted for each language over a text's n-grams; a
filter answers falsely with the known probability fill**hashes, by which the counts are corrected; the largest count decides.

Counts of n-grams are made over all labelled texts. A language's filter takes n-grams that are at least `rare` of its own
n-grams, so no more than 1 / rare of them whatever the corpus, and not much rarer than in the language where they are most
frequent.

Defined results: a null text, and one without letters, is `und` with score 0, and so is every text if nothing was learned;
of languages with the same count the first by code point; texts are read whole; repeated rows each get a row; an empty
table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Words, crc_mod5, mix64, need, settle, steps

SIZES = (3, 4)
RARE, RELATIVE = 1e-5, 0.1
POSITIONS, HASHES = 1 << 20, 4
HELD_ROWS = 1 << 20


def grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of each word's letters between two boundaries: (offsets by word, hashes). A word without letters has none."""
    letters = pc.utf8_lower(pc.replace_substring_regex(vocab.cast(pa.large_string()), r"\PL+", ""))
    sizes = pc.utf8_length(letters).to_numpy().astype(np.int64)
    points = np.frombuffer(("\n" + "\n".join(letters.to_pylist()) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolling = Rolling(mix64(points + np.uint64(1)))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # of each word's first boundary
    counts, parts = [], []
    for size in SIZES:
        n = np.where(sizes > 0, np.maximum(0, sizes + 3 - size), 0)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        counts.append(n)
        parts.append((np.repeat(np.arange(len(sizes)), n), rolling.at(at, size)))
    of, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(of, kind="stable")
    return np.concatenate([[0], np.cumsum(sum(counts))]), keys[order]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""

    def merged(held: list[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang in sorted({x[0] for x in held}):
            keys = np.concatenate([k for x, k, _ in held if x == lang])
            found, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for x, _, c in held if x == lang])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in steps(batches):
            words = Words(part.column("text"))
            if not len(words.ids):
                continue
            offsets, keys = grams(words.vocab)
            langs = np.array(part.column("lang").to_pylist(), object)[words.rows()]
            lengths = np.diff(offsets)
            found, inverse = np.unique(keys, return_inverse=True)
            for lang in sorted(set(langs.tolist())):
                times = np.bincount(words.ids[langs == lang], minlength=len(words.vocab))
                n = np.bincount(inverse, weights=np.repeat(times, lengths))
                held.append((lang, found[n > 0], n[n > 0]))
                size += int((n > 0).sum())
            if size > HELD_ROWS:
                yield from merged(held)
                held, size = [], 0
        yield from merged(held)

    return labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced filters of all languages: table[position, slice] has 64 languages a slice."""

    def __init__(self, langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]], positions: int = POSITIONS, hashes: int = HASHES) -> None:
        self.langs, self.hashes, self.positions = langs, hashes, positions
        self.table = np.zeros((positions, max(1, -(-len(langs) // 64))), np.uint64)
        for i, keys in enumerate(rows):
            for k in range(hashes):
                np.bitwise_or.at(self.table[:, i // 64], self._at(keys, k), np.uint64(1) << np.uint64(i % 64))
        fill = np.array([((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = fill**hashes

    def _at(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (mix64(keys, 1000 + k) % np.uint64(self.positions)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Languages that contain each key, as slices of bits."""
        out = self.table[self._at(keys, 0)]
        for k in range(1, self.hashes):
            out &= self.table[self._at(keys, k)]
        return out

    def decide(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        words = Words(texts)
        n_rows = len(texts)
        if not len(words.ids) or not self.langs:
            return ["und"] * n_rows, [0.0] * n_rows
        offsets, keys = grams(words.vocab)
        masks, lengths = self.masks(keys), np.diff(offsets)
        of, rows = np.repeat(np.arange(len(lengths)), lengths), words.rows()
        total = np.bincount(rows, weights=lengths[words.ids], minlength=n_rows)
        share = np.zeros((n_rows, len(self.langs)))
        for i in range(len(self.langs)):
            bits = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float)
            hits = np.bincount(rows, weights=np.bincount(of, weights=bits, minlength=len(lengths))[words.ids], minlength=n_rows)
            share[:, i] = (hits - total * self.false[i]) / np.maximum(1, total) / max(1e-9, 1 - self.false[i])
        best = share.argmax(1)
        score = np.clip(share[np.arange(n_rows), best], 0, 1)
        named = [self.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return named, np.where(total > 0, score, 0.0).tolist()


def learn(labelled: DataFrame, *, rare: float = RARE, relative: float = RELATIVE) -> Filters:
    """Filters from rows (lang, text) with a lang."""
    counts = settle(gram_counts(labelled), "langid-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    most = kept.groupBy("gram").agg(F.max("share").alias("most"))
    kept = kept.where(F.col("share") >= rare).join(most, "gram").where(F.col("share") >= relative * F.col("most"))
    found = kept.select("lang", "gram").toArrow()  # at most 1 / rare rows a language
    langs = sorted(set(found.column("lang").to_pylist()))
    if not langs:
        return Filters([], [])
    codes = found.column("lang").combine_chunks().to_numpy(zero_copy_only=False)
    keys = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    # Filters of about 1 / 8 fill at most.
    most_keys = max(int((codes == x).sum()) for x in langs)
    positions = max(1 << 16, 1 << int(np.ceil(np.log2(max(2, most_keys * HASHES * 8)))))
    return Filters(langs, [keys[codes == x] for x in langs], positions)


def identify(docs: DataFrame, *, filters: Filters | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Without filters, they are learned from the documents that aren't held out."""
    need(docs, "doc_id", "text", "lang")
    if filters is None:
        labelled = docs.where((crc_mod5() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        filters = learn(labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            named, score = held.value.decide(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_mod5() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
