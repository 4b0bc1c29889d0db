"""Quality rules: each line of a text is content or boilerplate, decided for all lines at once by the Viterbi path of a
linear-chain conditional random field; the content's share of the text decides whether the document stays.

The field has one weight for each line feature and state and one for each pair of adjacent states. It is trained by
maximum likelihood on a bounded sample of labelled documents (`sample` documents, in the order of a hash of doc_id, each with all
of its lines); their lines take the document's label. A long document is several sequences of CHAIN lines in training. Without labels
of both kinds PRIOR holds. A doc_id with several labels counts as the lowest, one with several texts has the least of them.

Defined results: a null or empty text has no words and fails the base rules; a text is read whole; repeated rows each get
a row; an empty table gives an empty one; a null doc_id is carried along; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Words, free_name, need, steps

#: Symbols that the base rules count (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "repeats", "again", "short", "sentence", "long_words", "legal")
#: Weights of boilerplate over content, used where nothing can be learned: one for each feature, then staying over switching.
PRIOR = (-3.0, 12.0, 6.0, 5.0, 8.0, 6.0, 1.5, 0.3, -0.5, 2.0, 1.0), 1.0
LEGAL = re.compile(r"copyright|all rights reserved|licen[cs]ed|cookie|privacy policy|terms of|subscribe|click here|javascript|©", re.I)
#: L2 draws the weights to PRIOR, so that features that few lines show keep their meaning.
SAMPLE, CHAIN, STEPS, L2 = 2000, 200, 150, 0.1
#: Most that staying may weigh: whole documents share a label in training, lines of mixed documents do not, so this is not learned upward.
MOST_STICKY = 1.0


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and size in characters of each line with a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        kept = "".join(words)
        size = len(kept)
        symbols = size - len(kept.translate(_NO_SYMBOLS))
        letters = len(kept.translate(_NO_MARKS))
        capitals = letters - len(kept.translate(_NO_CAPITALS)) if letters else 0
        digits = sum(map(kept.count, "0123456789"))
        distinct = len(set(words))
        rows.append((
            1.0, symbols / size, min(1.0, capitals / max(1, letters)), digits / size, (size - letters - digits - symbols) / size if symbols else kept.count("!") / size,
            1.0 - distinct / len(words), float(line in seen), float(len(words) < 4), float(kept[-1] in ".!?:;\"')"), min(1.0, size / len(words) / 40.0), float(bool(LEGAL.search(line))),
        ))
        seen.add(line)
        sizes.append(size)
    return np.array(rows, np.float32).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


_NO_SYMBOLS = {ord(c): None for c in SYMBOLS + "{}[]~^=+\\/_@"}
_NO_MARKS = {c: None for c in range(128) if not chr(c).isalpha()}
_NO_CAPITALS = {c: None for c in [*range(128), *range(0xC0, 0xDF)] if chr(c).isupper() or not chr(c).isalpha()}


def viterbi(scores: np.ndarray, stay: float) -> np.ndarray:
    """States (1: boilerplate) of the best path. scores: of boilerplate over content, a line each."""
    n = len(scores)
    back = np.zeros((n, 2), np.int8)
    a, b = 0.0, float(scores[0]) if n else 0.0
    for i in range(1, n):
        to_a, to_b = b > a + stay, b + stay > a
        back[i] = to_a, to_b
        a, b = (b if to_a else a + stay), (b + stay if to_b else a) + float(scores[i])
    states = np.zeros(n, np.int8)
    if n:
        states[-1] = b > a
        for i in range(n - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
    return states


class Chains:
    """Training documents as sequences of CHAIN lines at most; each document counts the same, and so do both kinds."""

    def __init__(self, documents: list[tuple[np.ndarray, int]]) -> None:
        labels = np.array([1 - y for _, y in documents])
        share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        parts = [(x[at : at + CHAIN], label, w / len(x)) for (x, _), label, w in zip(documents, labels.tolist(), share.tolist(), strict=True) for at in range(0, len(x), CHAIN)]
        self.held = np.zeros((len(parts), max(len(x) for x, _, _ in parts), len(FEATURES)))
        self.real = np.zeros(self.held.shape[:2], bool)
        for i, (x, _, _) in enumerate(parts):
            self.held[i, : len(x)], self.real[i, : len(x)] = x, True
        self.state, self.each = np.array([s for _, s, _ in parts]), np.array([w for _, _, w in parts])

    def likelihood(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighed log likelihood of the labels, and its slopes, by the forward and backward sums."""
        held, real, state, each = self.held, self.real, self.state, self.each
        longest = real.shape[1]
        emit, stay = held @ weights[:-1], weights[-1]
        ahead, behind = np.zeros((*real.shape, 2)), np.zeros((*real.shape, 2))
        ahead[:, 0, 1] = emit[:, 0]
        for t in range(1, longest):
            a, b = ahead[:, t - 1, 0], ahead[:, t - 1, 1]
            ahead[:, t, 0] = np.where(real[:, t], np.logaddexp(a + stay, b), a)
            ahead[:, t, 1] = np.where(real[:, t], np.logaddexp(b + stay, a) + emit[:, t], b)
        for t in range(longest - 2, -1, -1):
            a, b = behind[:, t + 1, 0], behind[:, t + 1, 1] + emit[:, t + 1]
            go = real[:, t + 1]
            behind[:, t, 0] = np.where(go, np.logaddexp(a + stay, b), 0)
            behind[:, t, 1] = np.where(go, np.logaddexp(b + stay, a), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        boiler = np.exp((ahead + behind)[..., 1] - total) * real
        same = np.zeros(real.shape)
        for t in range(1, longest):
            for s in (0, 1):
                same[:, t] += np.exp(np.minimum(0, ahead[:, t - 1, s] + stay + s * emit[:, t] + behind[:, t, s] - total[:, 0])) * real[:, t]
        wanted = state[:, None] * real
        told = (wanted * emit).sum(1) + stay * real[:, 1:].sum(1) - total[:, 0]
        slope = np.append(np.einsum("dt,dtf,d->f", wanted - boiler, held, each), ((real[:, 1:] - same[:, 1:]).sum(1) * each).sum())
        return float((told * each).sum()), slope


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = STEPS) -> tuple[tuple[float, ...], float]:
    """Weights and the stay weight by maximum likelihood (Adam). documents: line features and label (1: good)."""
    documents = [(x, y) for x, y in documents if len(x)]
    if len({y for _, y in documents}) < 2:
        return PRIOR
    chains = Chains(documents)
    start = np.append(np.array(PRIOR[0]), PRIOR[1])
    weights = start.copy()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        slope = chains.likelihood(weights)[1] - L2 * (weights - start)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights[-1] = min(weights[-1], MOST_STICKY)
    return tuple(map(float, weights[:-1])), float(weights[-1])


def fit_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[float, ...], float]:
    """Weights from the documents of `sample` labels at most, whole."""
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most `sample` rows
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "quality").agg(F.min("text").alias("text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t)[0].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(lines, "doc_id long, quality int, x binary").collect()
    return fit([(np.frombuffer(bytes(r.x), np.float32).reshape(-1, len(FEATURES)), r.quality) for r in sorted(got, key=lambda r: r.doc_id)])


def content_share(text: str, model: tuple[tuple[float, ...], float]) -> float:
    x, sizes = line_features(text)
    if not len(x):
        return 0.0
    states = viterbi(x @ np.array(model[0], np.float32), model[1])
    return float(sizes[states == 0].sum() / sizes.sum())


def repeated_words(words: Words, window: int = 8) -> np.ndarray:
    """Per text: how many words stand in a window of words that the text has twice or more."""
    n, counts = len(words.ids), words.counts
    out = np.zeros(len(counts), np.int64)
    if n < window:
        return out
    rows = words.rows()
    starts = np.arange(n - window + 1)
    starts = starts[rows[starts] == rows[starts + window - 1]]
    if not len(starts):
        return out
    rolling = Rolling(words.hashes()[words.ids])
    keys = rolling.at(starts, window) ^ (rows[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(rows[covered], minlength=len(counts)).astype(np.int64)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, model: tuple[tuple[float, ...], float] = PRIOR, *, least_content: float = 0.5, least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content, base_failed and kept (which replace
    columns of these names)."""
    need(docs, "text")
    made = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "content": "double"}
    own = [c for c in docs.columns if c.lower() not in {*made, "base_failed", "kept"}]
    figures = free_name(docs, "figures")

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in made.items()))
    def measure(texts: pa.Array) -> pa.Array:
        out = []
        for part in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            column = part.column("text").cast(pa.string())
            words = Words(column)
            whole = [t or "" for t in column.to_pylist()]
            columns = [
                pa.array(words.counts, pa.int64()),
                pa.array([len(t) - sum(map(t.count, WHITE)) for t in whole], pa.int64()),
                pa.array([sum(map(t.count, SYMBOLS)) for t in whole], pa.int64()),
                pa.array([duplicate_lines(t) for t in whole], pa.int64()),
                pa.array(repeated_words(words), pa.int64()),
                pa.array([content_share(t, model) for t in whole], pa.float64()),
            ]
            out.append(pa.StructArray.from_arrays(columns, list(made)))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([pa.field(k, pa.float64() if v == "double" else pa.int64()) for k, v in made.items()]))

    # Only the text goes to Python; other columns stay where they are.
    out = docs.select(*own, measure(F.col("text").cast("string")).alias(figures)).select(*own, *[F.col(f"{figures}.{k}").alias(k) for k in made])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content") >= least_content))
