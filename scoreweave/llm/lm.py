"""Language-model scoring: causal self-attention over subword ids, trained and run in numpy.

The model. Words (A-Z lowered) are spelled in subword ids of a public vocabulary; a word's last id is a symbol of its own, so
no word's spelling starts another's. One attention layer looks back over `WINDOW` symbols with a learned bias for each
distance; it predicts the class of the next symbol in two steps (one of SUPERS kinds, then one of the LEAVES classes of that kind), and
the symbol in its class follows counts over all training texts. That gives a word's probability by its spelling. A second source is
the word's own count over all training texts (the base). The score mixes both:
p(word) = SHARE * base(word) + (1 - SHARE) * spelling(word | symbols before).

Texts are spelled once, to a table of symbols that all steps read, with the counts of words and symbols; spellings tell words apart.
Counts and windows travel many in a row, by part of the hashes or by group, and are added up or put in order where they arrive.

Scoring. A text's symbols are cut into windows that overlap by half; each symbol is scored once, in the window where it has at least
half a window of context, and windows of many texts are scored in one batch under one mask.

Training. Counts of words and symbols cover all training texts, and so do the windows that the attention weights learn from: each
symbol is predicted once. Windows are dealt by a hash of their document and place into as many slices as there are `RATES`, and a slice
into groups of about GROUP windows (MOST_GROUPS groups at most; then groups are larger). A round takes one slice: each group trains from the
same start in the order of the hashes, and the results are averaged by symbols seen, in a fixed order. So the weights depend on the rows alone, not
on how they are partitioned. After the first round symbols are grouped into classes anew, by the vectors learned.

Joins. Counts of the `KNOWN` most frequent words (a fixed number) are broadcast; other words are joined by a 64-bit hash.

Defined results: a null or empty text has one token, its end; a null doc_id counts as the empty text in held_out; rows that
repeat each get a row; with nothing to train on the base is uniform over the end alone; an empty table gives an empty one;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, crc_mod5, keep_memory, mix64, need, settle, steps

WINDOW, WIDTH = 32, 16
HALF = WINDOW // 2
#: Symbols with an input vector of their own, and vectors that the others share.
OWN, SHARED = 2047, 256
#: Classes of one symbol, and classes of many; classes of one kind, and kinds.
ALONE, MANY = 128, 64
LEAVES = 16
SUPERS = (ALONE + MANY) // LEAVES
SHARE = 0.5
LN10 = float(np.log(10))
#: Rate of each round; windows a step; windows of a group, and most groups of a round.
RATES, BATCH, GROUP, MOST_GROUPS = (0.02, 0.01, 0.005), 128, 19_200, 4096
KNOWN = 1 << 20
SPELL_BYTES, SCORE_BYTES = 8 << 20, 4 << 20
#: Freed memory that a worker keeps while it scores or trains.
ROOM = 64 << 20
#: Parts that words are counted in, by hash; symbols of a part.
COUNT_PARTS, COUNT_SYMBOLS = 1024, 1024


class Speller:
    """Subword symbols of words: id * 2, plus 1 for a word's last."""

    def __init__(self, path: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pieces = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
        self.coder = tiktoken.Encoding("subwords", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by word, symbols)."""
        if not words:
            return np.zeros(1, np.int64), np.zeros(0, np.int64)
        ids = self._ids((b" " + b" ".join(words)).decode())
        starts = np.nonzero(self.spaced[ids])[0]
        if len(starts) != len(words):  # odd white space in a word
            if len(words) > 1:
                (a, first), (b, second) = self.spell(words[: len(words) // 2]), self.spell(words[len(words) // 2 :])
                return np.append(a[:-1], b + len(first)), np.append(first, second)
            starts = np.zeros(1, np.int64)
        offsets = np.append(starts, len(ids))
        symbols = ids * 2
        symbols[offsets[1:] - 1] += 1
        return offsets, symbols

    def _ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    @property
    def starts(self) -> np.ndarray:
        """Whether each symbol starts a word."""
        return np.append(np.repeat(self.spaced, 2), True)

    @property
    def end(self) -> int:
        return self.size * 2

    @property
    def n_symbols(self) -> int:
        return self.size * 2 + 1


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


# Symbols


def spelled_out(words: Words, coder: Speller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts, each text's followed by the end: (offsets by text, symbols); and of their distinct words: (offsets, symbols)."""
    cuts, each_word = coder.spell(words.listed())
    offsets, spelled = np.append(cuts, len(each_word) + 1), np.append(each_word, coder.end)
    ids = np.insert(words.ids, words.offsets[1:], len(words.vocab))
    each = np.diff(offsets)[ids]
    ends = np.cumsum(each)
    at = np.repeat(offsets[ids] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words.counts + 1)])], spelled[at], cuts, each_word


#: Rows of a symbol table: counts of words by hash, of symbols; and texts.
WORD_COUNT, SYMBOL_COUNT, TEXT = range(3)


def symbol_table(docs: DataFrame, path: str) -> DataFrame:
    """(kind, doc_id, held_out, key, n, s, counts) of rows (doc_id, held_out, key, text). A TEXT is a row of docs with its number of symbols
    and the symbols, as int32. Others count training texts: counts has n hashes of words, or symbols, and then how often each occurs, as
    int64; all that count the same have the same key."""
    kind = docs.schema["doc_id"].dataType

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = speller(path)
        symbols_seen, id_type = np.zeros(mine.n_symbols, np.int64), None
        names = ["kind", "doc_id", "held_out", "key", "n", "s", "counts"]

        def counted(kind: int, parts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(parts, kind="stable")
            parts, told = parts[order], np.stack([keys.view(np.int64)[order], n[order]])
            heads = np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0]
            s = [told[:, a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(parts)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), kind, np.int8)), pa.nulls(len(s), id_type), pa.nulls(len(s), pa.bool_()), pa.array(parts[heads].astype(np.int64)), pa.array(np.diff(np.append(heads, len(parts)))), pa.nulls(len(s), pa.binary()), pa.array(s, pa.binary())], names)

        for part in steps(batches, limit=SPELL_BYTES, room=ROOM):
            words = Words(part.column("text"), lower=True)
            offsets, symbols, cuts, each_word = spelled_out(words, mine)
            learned = ~part.column("held_out").to_numpy(zero_copy_only=False)
            symbols_seen[mine.end] += int(learned.sum())
            id_type = part.column("doc_id").type
            n = np.bincount(words.ids[learned[words.rows()]], minlength=len(words.vocab))
            symbols_seen += np.bincount(each_word, weights=np.repeat(n, np.diff(cuts)), minlength=mine.n_symbols).astype(np.int64)
            seen = n > 0
            if seen.any():
                hashes = spelling_hashes(each_word, cuts[:-1], np.diff(cuts), mine.end)[seen]
                yield counted(WORD_COUNT, (hashes % np.uint64(COUNT_PARTS)).astype(np.uint16), hashes, n[seen])
            held = symbols.astype(np.int32)
            for at in range(0, part.num_rows, 1000):  # small batches for the JVM
                ends = offsets[at : at + 1001]
                s = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(held)])
                own = part.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, TEXT, np.int8)), own.column("doc_id"), own.column("held_out"), own.column("key"), pa.array(np.diff(ends), pa.int64()), s.cast(pa.binary()), pa.nulls(own.num_rows, pa.binary())], names)
        seen = np.nonzero(symbols_seen)[0]
        if len(seen):
            yield counted(SYMBOL_COUNT, seen // COUNT_SYMBOLS, seen, symbols_seen[seen])

    return docs.select("doc_id", "held_out", "key", "text").mapInArrow(spell, f"kind byte, doc_id {kind.simpleString()}, held_out boolean, key long, n long, s binary, counts binary")


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, c), each hash or symbol once, of a symbol table's (kind, key, counts) that come key by key."""

    def merged(told: list[np.ndarray]) -> np.ndarray:
        told = np.concatenate(told, 1)
        told = told[:, np.argsort(told[0], kind="stable")]
        heads = np.nonzero(np.append(True, told[0, 1:] != told[0, :-1]))[0]
        return np.stack([told[0, heads], np.add.reduceat(told[1], heads)])

    now, held, size, limit = None, [], 0, KNOWN
    for batch in batches:
        for kind, key, told in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), batch.column("counts"), strict=True):
            if held and now != (kind, key):
                yield _counts(now[0], merged(held))
                held, size, limit = [], 0, KNOWN
            now = (kind, key)
            held.append(np.frombuffer(told.as_buffer(), np.int64).reshape(2, -1))
            size += held[-1].shape[1]
            if size > limit:  # what occurs again and again isn't kept again and again
                held = [merged(held)]
                size = held[0].shape[1]
                limit = max(KNOWN, 2 * size)
    if held:
        yield _counts(now[0], merged(held))


def _counts(kind: int, told: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(told.shape[1], kind, np.int8)), pa.array(told[0]), pa.array(told[1])], ["kind", "h", "c"])


def spelling_hashes(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """64 bits of each word's spelling (stretches that follow each other): a polynomial of its symbols' values, and its length."""
    global _values
    if len(_values) <= end:
        _values = mix64(np.arange(1, end + 2, dtype=np.uint64))
    if not len(symbols):
        return np.zeros(len(starts), np.uint64)
    powers = np.full(int(sizes.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    told = _values[symbols] * powers[np.arange(len(symbols)) - np.repeat(starts, sizes)]
    return mix64(np.add.reduceat(told, starts) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_values = np.zeros(0, np.uint64)


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, symbols) of a column s."""
    column = column.cast(pa.large_binary())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.int32)
    return (ends - ends[0]) // 4, held.astype(np.int64)


class Tokens:
    """Tokens of texts by their symbols. ends: where each stops; hashes: those of their spelling; is_end: the texts' ends; rows: the text
    of each."""

    def __init__(self, offsets: np.ndarray, symbols: np.ndarray, end: int) -> None:
        self.ends = np.nonzero((symbols & 1 == 1) | (symbols == end))[0] + 1
        self.starts = np.concatenate([np.zeros(min(1, len(self.ends)), np.int64), self.ends[:-1]])
        self.is_end = symbols[self.ends - 1] == end
        self.hashes = spelling_hashes(symbols, self.starts, self.ends - self.starts, end)
        self.counts = np.diff(np.searchsorted(self.ends, offsets, "right"))
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)


# The model


class Layout:
    """How symbols map to input vectors, classes and their counts in them.

    Frequent symbols are classes of their own, and so is the end. The others are grouped by whether they start and end a word,
    and then by likeness: of their input vectors, if there are any yet (leaves of a tree of cuts along the widest direction, of
    about the same mass), else of their counts."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, vectors: np.ndarray | None = None) -> None:
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.vector = (np.arange(n) % SHARED) + OWN + 1
        self.vector[order[:OWN]] = np.arange(OWN)
        self.start = OWN  # the vector before a text
        first = np.append(n - 1, order[order != n - 1])
        self.group = np.empty(n, np.int64)
        self.group[first[:ALONE]] = np.arange(ALONE)
        rest = first[ALONE:]
        smooth = counts + 0.5
        kinds = starts[rest] * 2 + rest % 2
        leaves = MANY // 4
        for kind in range(4):
            mine = rest[kinds == kind]
            if vectors is None:
                mass = np.cumsum(smooth[mine])
                self.group[mine] = ALONE + kind * leaves + np.minimum(leaves - 1, mass / max(mass[-1:].sum(), 1e-9) * leaves).astype(np.int64)
                continue
            known = self.vector[mine] < OWN
            self.group[mine[~known]] = ALONE + kind * leaves
            self._cut(mine[known], vectors, smooth, ALONE + kind * leaves + 1, leaves - 1)
        total = np.bincount(self.group, weights=smooth, minlength=ALONE + MANY)
        self.inside = np.log(smooth / total[self.group]).astype(np.float32)
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)
        kinds = total.reshape(SUPERS, LEAVES).sum(1)
        self.kind_prior = np.log(np.maximum(kinds, 1e-9) / kinds.sum()).astype(np.float32)

    def _cut(self, symbols: np.ndarray, vectors: np.ndarray, mass: np.ndarray, first: int, leaves: int) -> None:
        if leaves == 1 or len(symbols) < 2:
            self.group[symbols] = first
            return
        held = vectors[self.vector[symbols]].astype(float)
        weight = mass[symbols] / mass[symbols].sum()
        held = held - weight @ held
        _, axes = np.linalg.eigh((held * weight[:, None]).T @ held)
        along = np.argsort(held @ axes[:, -1], kind="stable")
        left = leaves // 2
        cut = int(np.clip(np.searchsorted(np.cumsum(weight[along]), left / leaves), 1, len(symbols) - 1))
        self._cut(symbols[along[:cut]], vectors, mass, first, left)
        self._cut(symbols[along[cut:]], vectors, mass, first + left, leaves - left)


SHAPES = {
    "e": (OWN + 1 + SHARED, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "far": (WINDOW,),
    "w": (WIDTH, ALONE + MANY), "b": (ALONE + MANY,), "kw": (WIDTH, SUPERS), "kb": (SUPERS,),
}


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(layout: Layout, seed: int = 3) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    start = {n: rng.normal(0, 0.1 if n == "e" else 0.25, s) for n, s in SHAPES.items()}
    start["far"] = -0.1 * np.arange(WINDOW)
    start["w"] = rng.normal(0, 0.1, SHAPES["w"])
    start["kw"] = rng.normal(0, 0.1, SHAPES["kw"])
    start["b"], start["kb"] = layout.prior, layout.kind_prior
    return np.concatenate([start[n].ravel() for n in SHAPES]).astype(np.float32)


#: Distance of each key (column) from each query (row) in a training window; later keys are masked.
_GAP = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def sound(total: np.ndarray) -> bool:
    """Whether sums of exp are neither too large nor too small to divide by, and so the logits can be taken as they stand."""
    return total.min(initial=1) > 1e-20 and total.max(initial=1) < 1e20


def chances(z: np.ndarray, share: np.floating) -> np.ndarray:
    """Softmax of each column of z, times share. Places stand in columns, so sums and quotients go along rows of memory."""
    with np.errstate(over="ignore"):
        out = np.exp(z)
        total = out.sum(0)
    if not sound(total):
        np.exp(z - z.max(0), out=out)
        total = out.sum(0)
    out *= share / total
    return out


def by_kind(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of classes by kind, and each kind there is with its start and stop in it."""
    kinds = (classes // LEAVES).astype(np.uint8)
    cuts = np.cumsum(np.bincount(kinds, minlength=SUPERS)).tolist()
    return np.argsort(kinds, kind="stable"), [(i, a, b) for i, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)) if b > a]


def leaf_weights(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights of each kind's classes, the bias last: SUPERS x (WIDTH + 1) x LEAVES."""
    return np.ascontiguousarray(np.concatenate([w, b[None]]).reshape(WIDTH + 1, SUPERS, LEAVES).transpose(1, 0, 2))


def with_one(h: np.ndarray) -> np.ndarray:
    """Rows with a last 1, which takes the bias."""
    out = np.ones((len(h), WIDTH + 1), h.dtype)
    out[:, :WIDTH] = h
    return out


def leaf_logits(h: np.ndarray, spans: list[tuple[int, int, int]], leaves: np.ndarray) -> np.ndarray:
    """Logits of the classes of each row's kind, LEAVES x rows; rows (with_one) are in the order of by_kind."""
    z = np.empty((LEAVES, len(h)), h.dtype)
    for kind, start, stop in spans:
        np.matmul(leaves[kind].T, h[start:stop].T, out=z[:, start:stop])
    return z


#: Where the weights of each input vector stand in e.
_SPOTS = np.arange((OWN + 1 + SHARED) * WIDTH).reshape(-1, WIDTH)
_PAST = (_GAP >= 0)
_DISTANCE = np.maximum(_GAP, 0)


def loss_and_slopes(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of classes y after vectors x (batch x WINDOW), where real, and its gradients."""
    kind = p["e"].dtype.type
    scale = kind(1 / np.sqrt(WIDTH))
    by_window = lambda t: t.reshape(len(x), WINDOW, t.shape[-1])
    rows = p["e"].take(x.ravel(), 0)
    three = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
    made = np.empty((len(rows), 3 * WIDTH + 1), kind)
    np.matmul(rows, three, out=made[:, :-1])
    made[:, -1] = 1  # what stands beside a value gives the sum of the weights
    q, k, v = np.split(by_window(made), [WIDTH, 2 * WIDTH], 2)
    z = q @ k.transpose(0, 2, 1)
    z += np.where(_PAST, p["far"][_DISTANCE], kind(-1e9))
    with np.errstate(over="ignore", invalid="ignore"):
        a = np.exp(z)
        seen = a @ v
    if not sound(seen[..., WIDTH]):
        np.exp(z - z.max(2, keepdims=True), out=a)
        seen = a @ v
    less = 1 / seen[..., WIDTH:]
    got = seen[..., :WIDTH] * less
    h = rows + got.reshape(-1, WIDTH)
    # Only real places have a class; they are taken kind by kind.
    here = np.nonzero(real.ravel())[0]
    n = max(1, len(here))
    of = y.ravel().take(here)
    order, spans = by_kind(of)
    here, leaf, at = here.take(order), of.take(order) % LEAVES, np.arange(len(here))
    held, leaves, share = with_one(h.take(here, 0)), leaf_weights(p["w"], p["b"]), kind(1 / n)
    one = chances(np.concatenate([p["kw"], p["kb"][None]]).T @ held.T, share)
    two = chances(leaf_logits(held, spans, leaves), share)
    spots, told = leaf.astype(np.int64) * len(here) + at, two.ravel()
    hit = told.take(spots)
    told[spots] = hit - share
    for i, start, stop in spans:
        hit[start:stop] *= one[i, start:stop]
        one[i, start:stop] -= share
    loss = -float(np.log(np.maximum(1e-30, hit * (kind(n) * kind(n)))).sum()) / n
    dheld = np.zeros((len(here) + 1, WIDTH), kind)  # the last is for places that aren't real
    np.matmul(one.T, p["kw"].T, out=dheld[:-1])
    dw, dk = np.zeros_like(leaves), held.T @ one.T
    for i, start, stop in spans:
        part = two[:, start:stop].T
        dheld[start:stop] += part @ leaves[i, :WIDTH].T
        np.matmul(held[start:stop].T, part, out=dw[i])
    dw = dw.transpose(1, 0, 2).reshape(WIDTH + 1, -1)
    back = np.full(len(rows), len(here))
    back[here] = at
    dh = dheld.take(back, 0)
    # The softmax's slope: a / sum * (da - what attention gave times dh), where a / sum are the weights; v's ones take the second.
    d = np.empty(seen.shape, kind)
    np.multiply(by_window(dh), less, out=d[..., :WIDTH])
    np.negative(np.einsum("bij,bij->bi", d[..., :WIDTH], got), out=d[..., WIDTH])
    made_slopes = np.empty((len(rows), 3 * WIDTH), kind)
    dq, dk_, dv = np.split(by_window(made_slopes), 3, 2)
    np.matmul(a.transpose(0, 2, 1), d[..., :WIDTH], out=dv)
    da = d @ v.transpose(0, 2, 1)
    da *= a
    dfar = np.bincount(_DISTANCE.ravel(), weights=(da.sum(0) * _PAST).ravel(), minlength=WINDOW)
    np.matmul(da, k, out=dq)
    np.matmul(da.transpose(0, 2, 1), q, out=dk_)
    dh += made_slopes @ three.T
    parts = int(np.gcd(len(x), 16))  # sums of fewer rows stay near
    dthree = (rows.reshape(parts, -1, WIDTH).transpose(0, 2, 1) @ made_slopes.reshape(parts, -1, 3 * WIDTH)).sum(0)
    de = np.zeros(p["e"].size, kind)
    np.add.at(de, _SPOTS.take(x.ravel(), 0).ravel(), dh.ravel())
    return loss, {
        "q": dthree[:, :WIDTH] * scale, "k": dthree[:, WIDTH : 2 * WIDTH], "v": dthree[:, 2 * WIDTH :], "far": dfar,
        "w": dw[:WIDTH], "b": dw[WIDTH], "kw": dk[:WIDTH], "kb": dk[WIDTH], "e": de.reshape(p["e"].shape),
    }


class Trainer:
    """Adam from a start, step by step."""

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.flat, self.rate, self.turn = flat.astype(np.float32).copy(), rate, 0
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.slopes = np.empty_like(self.flat)
        self.p, self.into = unpacked(self.flat), unpacked(self.slopes)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> float:
        loss, found = loss_and_slopes(self.p, x, y, real)
        for n, g in found.items():
            self.into[n][...] = g
        self.turn += 1
        g, f32 = self.slopes, np.float32
        self.first *= f32(0.9)
        self.first += f32(0.1) * g
        g *= g
        g *= f32(0.01)
        self.second *= f32(0.99)
        self.second += g
        np.multiply(self.second, f32(1 / (1 - 0.99**self.turn)), out=g)
        np.sqrt(g, out=g)
        g += f32(1e-6)
        np.divide(self.first, g, out=g)
        g *= f32(self.rate / (1 - 0.9**self.turn))
        self.flat -= g
        return loss


def cut(offsets: np.ndarray, symbols: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows of texts, the one of each place (from 0) in its row: WINDOW + 1 symbols (int32, -2 the start, -1 none). A window's first is the
    symbol before its others, so each symbol is once to be predicted."""
    at = (offsets[rows] + places * WINDOW)[:, None] + np.arange(-1, WINDOW)
    out = np.where(at < offsets[rows + 1][:, None], symbols[np.clip(at, 0, max(0, len(symbols) - 1))], -1).astype(np.int32)
    out[places == 0, 0] = -2
    return out


#: Bytes of a window as vectors (16 bits) and classes (8 bits); this class is none.
PACKED, NONE = 3 * WINDOW, 255


def packed(windows: np.ndarray, layout: Layout) -> np.ndarray:
    """Windows of symbols as rows of PACKED bytes: the vectors of what stands before each symbol, and the symbols' classes."""
    vector = np.append(layout.vector, [layout.start, layout.start]).astype("<u2")  # -2: the start; -1: none
    classes = np.where(windows[:, 1:] >= 0, layout.group[np.maximum(0, windows[:, 1:])], NONE).astype(np.uint8)
    return np.concatenate([np.ascontiguousarray(vector[windows[:, :-1]]).view(np.uint8), classes], 1)


def unpacked_windows(held: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, classes, whether there is one) of rows of packed."""
    rows = np.frombuffer(held, np.uint8).reshape(-1, PACKED)
    classes = rows[:, 2 * WINDOW :]
    real = classes != NONE
    return np.ascontiguousarray(rows[:, : 2 * WINDOW]).view("<u2").astype(np.int64), np.where(real, classes, 0), real


def _windows(table: DataFrame, groups: int, wanted: int, slices: int = len(RATES), layout: Layout | None = None, spans: int = 1) -> DataFrame:
    """(g, span, w): the training windows of slice `wanted`, dealt to groups by a hash (deal) of the document and the window's place; a span is
    one of `spans` stretches of deals. w: symbols as int32, a window a row; where a layout is given, the windows of a group and span in
    a step, each its deal (int64) and then packed."""
    held = table.sparkSession.sparkContext.broadcast(layout)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "s", limit=2 * SCORE_BYTES, room=ROOM):
            offsets, symbols = symbols_of(part.column("s"))
            each = -(-np.diff(offsets) // WINDOW)
            rows = np.repeat(np.arange(len(each)), each)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
            deal = mix64(part.column("key").to_numpy().view(np.uint64)[rows] ^ mix64(places.astype(np.uint64), 77))
            mine = np.nonzero(deal % np.uint64(slices) == wanted)[0]
            for at in range(0, len(mine), 1 << 15):
                k = mine[at : at + (1 << 15)]
                g = (deal[k] // np.uint64(slices) % np.uint64(groups)).astype(np.int32)
                # Deals are in the order of int64.
                span = (((deal[k] ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int32)
                heads = np.arange(len(k))
                if held.value is not None:
                    order = np.lexsort([span, g])
                    k, g, span = k[order], g[order], span[order]
                    heads = np.nonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (span[1:] != span[:-1])]))[0]
                some = cut(offsets, symbols, rows[k], places[k])
                some = np.ascontiguousarray(some if held.value is None else np.concatenate([deal[k, None].view(np.uint8), packed(some, held.value)], 1))
                ends = (np.append(heads, len(k)) * (some.shape[1] * some.itemsize)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g[heads]), pa.array(span[heads]), pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(some)])], ["g", "span", "w"])

    return table.where(f"kind = {TEXT} and not held_out").select("key", "s").mapInArrow(pick, "g int, span int, w binary")


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its packed windows of a span in the order of deals); rows come by group and span."""
    now, held = None, []

    def ordered() -> np.ndarray:
        rows = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8 + PACKED)
        return rows[np.argsort(np.ascontiguousarray(rows[:, :8]).view(np.int64).ravel(), kind="stable"), 8:]

    for batch in batches:
        for g, span, w in zip(batch.column("g").to_pylist(), batch.column("span").to_pylist(), batch.column("w"), strict=True):
            if held and now != (g, span):
                yield now[0], ordered()
                held = []
            now = (g, span)
            held.append(w.as_buffer())
    if held:
        yield now[0], ordered()


def _steps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(group, windows of a step): rows come by group and span; a group's last step may be smaller."""
    now, held = None, None
    for g, rows in _spans_of(batches):
        if g != now:
            if now is not None and len(held):
                yield now, held
            now, held = g, rows[:0]
        held = np.concatenate([held, rows])
        for at in range(0, len(held) - BATCH + 1, BATCH):
            yield now, held[at : at + BATCH]
        held = held[len(held) // BATCH * BATCH :]
    if now is not None and len(held):
        yield now, held


def _round(windows: DataFrame, groups: int, flat: np.ndarray, rate: float) -> np.ndarray:
    """Each group trains from flat; the mean of what they come to, by symbols seen, in the order of groups."""
    held = windows.sparkSession.sparkContext.broadcast(flat)
    parts = max(1, int(np.sqrt(groups)))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = held.value
        keep_memory(ROOM)
        now, trainer, seen = None, None, 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seen], pa.int64()), pa.array([trainer.flat.tobytes()], pa.binary())], ["g", "seen", "p"])
        for g, rows in _steps_of(batches):
            if g != now:
                if seen:
                    yield emit()
                now, trainer, seen = g, Trainer(flat, rate), 0
            x, y, real = unpacked_windows(rows)
            trainer.step(x, y, real)
            seen += int(real.sum())
        if seen:
            yield emit()
        keep_memory()

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("g")
        seen = rows.column("seen").to_pylist()
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for p, n in zip(rows.column("p").to_pylist(), seen, strict=True))
        return pa.table({"g": pa.array([rows.column("g")[0].as_py() % parts], pa.int32()), "seen": pa.array([sum(seen)], pa.int64()), "p": pa.array([total.tobytes()], pa.binary())})

    dealt = windows.repartition(groups, "g").sortWithinPartitions("g", "span")
    rows = dealt.mapInArrow(one, "g int, seen long, p binary").groupBy((F.col("g") % parts).alias("part")).applyInArrow(added, "g int, seen long, p binary").collect()
    if not rows:
        return flat
    rows = sorted(rows, key=lambda r: r.g)
    return (sum(np.frombuffer(bytes(r.p), np.float64) for r in rows) / sum(r.seen for r in rows)).astype(np.float32)


def fit(table: DataFrame, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, Layout]:
    """Weights and layout from a symbol table's training texts: a round on classes by count; then classes by likeness of the vectors
    learned, and a round for each rate left. Every window is in one round."""
    n = table.where(f"kind = {TEXT} and not held_out").agg(F.coalesce(F.sum(F.ceil(F.col("n") / WINDOW)), F.lit(0))).first()[0]
    groups = int(min(MOST_GROUPS, max(1, -(-n // (len(RATES) * GROUP)))))
    spans = int(max(1, -(-n // (len(RATES) * GROUP * groups))))  # so a task holds some GROUP windows at once, however large a group is
    layout = Layout(counts, starts)
    flat = initial(layout)
    for turn, rate in enumerate(RATES):
        if turn == 1:
            old = unpacked(flat)
            layout = Layout(counts, starts, old["e"])
            new = unpacked(initial(layout))
            flat = np.concatenate([(new if n in ("w", "b", "kw", "kb") else old)[n].ravel() for n in SHAPES])
        flat = _round(_windows(table, groups, turn, layout=layout, spans=spans), groups, flat, rate)
    return flat, layout


class Scorer:
    """log10 probabilities of symbols in context."""

    def __init__(self, flat: np.ndarray, layout: Layout) -> None:
        p = unpacked(flat.astype(np.float32))
        e, scale = p["e"], np.float32(1 / np.sqrt(WIDTH))
        self.leaves, self.kinds, self.layout = leaf_weights(p["w"], p["b"]), np.concatenate([p["kw"], p["kb"][None]]).T, layout
        self.group = layout.group.astype(np.uint8)
        # Input vectors are of symbols alone, so queries, keys and values are made once for each; a value's last place counts, and
        # that of a symbol's own vector is empty. What is looked up together stands together.
        self.own = np.concatenate([e @ p["q"] * scale, e, np.zeros((len(e), 1), np.float32)], 1)
        self.past = np.concatenate([e @ p["k"], e @ p["v"], np.ones((len(e), 1), np.float32)], 1)
        gap = np.arange(HALF)[:, None] + HALF - np.arange(WINDOW)[None, :]
        self.bias = np.where(gap < 0, np.float32(-1e9), p["far"][np.clip(gap, 0, WINDOW - 1)]).astype(np.float32)

    def score(self, symbols: np.ndarray, offsets: np.ndarray, batch: int = 256) -> np.ndarray:
        """log10 p of each symbol of texts (offsets; each ends with the end)."""
        n = np.diff(offsets)
        blocks = -(-n // HALF)
        first = np.concatenate([[0], np.cumsum(blocks + 1)])  # a text has a masked half window before it
        place = np.arange(len(symbols)) + np.repeat((first[:-1] + 1) * HALF - offsets[:-1], n)
        x = np.full(first[-1] * HALF + 1, self.layout.start, np.int64)
        x[place + 1] = self.layout.vector.take(symbols)  # a symbol is scored from those before it
        x[place[offsets[1:] - 1] + 1] = self.layout.start  # nothing comes after an end
        x = x[:-1]
        target = np.zeros(len(x), np.uint8)
        target[place] = self.group.take(symbols)
        fresh = np.zeros(first[-1], bool)  # blocks that see nothing of the block before: a text's first, and its masked ones
        fresh[first[:-1]] = fresh[first[:-1] + 1] = True
        x, target, out = x.reshape(-1, HALF), target.reshape(-1, HALF), np.zeros(x.shape, np.float32).reshape(-1, HALF)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for at in range(1, len(x), batch):
                block = slice(at, min(len(x), at + batch))
                found = self._batch(x[at - 1 : block.stop], target[block], fresh[block], False)
                if not np.isfinite(found).all():  # too large for exp as it stands
                    found = self._batch(x[at - 1 : block.stop], target[block], fresh[block], True)
                out[block] = found
        return (out.ravel().take(place) + self.layout.inside.take(symbols)) / np.float32(np.log(10))

    def _batch(self, x: np.ndarray, target: np.ndarray, fresh: np.ndarray, careful: bool) -> np.ndarray:
        """Scores of all blocks of x but the first, each of which sees the one before."""
        own, past = self.own.take(x[1:], 0), self.past.take(x, 0)

        def pairs(t: np.ndarray) -> np.ndarray:  # each block with the one before, without a copy
            return np.lib.stride_tricks.as_strided(t, (len(own), WINDOW, t.shape[2]), (HALF * t.strides[1], t.strides[1], t.strides[2]))

        a = own[..., :WIDTH] @ pairs(past[..., :WIDTH]).transpose(0, 2, 1)
        a += self.bias
        if careful:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a[fresh, :, :HALF] = 0
        seen = a @ pairs(past[..., WIDTH:])
        seen /= seen[..., WIDTH:].copy()  # the last becomes 1, which takes the bias
        seen += own[..., WIDTH:]
        order, spans = by_kind(target.ravel())
        h, leaf, at = seen.reshape(-1, WIDTH + 1).take(order, 0), target.ravel().take(order) % LEAVES, np.arange(target.size)
        one, two = self.kinds @ h.T, leaf_logits(h, spans, self.leaves)
        if careful:
            one -= one.max(0)
            two -= two.max(0)
        hit = two.ravel().take(leaf * np.int64(target.size) + at)
        for i, start, stop in spans:
            hit[start:stop] += one[i, start:stop]
        np.exp(one, out=one)
        np.exp(two, out=two)
        out = np.empty_like(hit)
        out[order] = hit - np.log(one.sum(0) * two.sum(0))
        return out.reshape(target.shape)


#: Bits of the places for the most frequent known words.
NEAR = 16


class Known:
    """Counts of known words, found by their hashes: those of one bucket (their leading bits) stand together. Frequent words are looked for
    first, each in one place (its last bits), in a small table that stays in the cache."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        top = np.argsort(counts, kind="stable")[-(1 << NEAR) :]
        self.near = ~np.arange(1 << NEAR, dtype=np.uint64)  # a place without a word has a hash of another place
        self.near_counts = np.zeros(1 << NEAR, np.int64)
        at = (hashes[top] & np.uint64((1 << NEAR) - 1)).astype(np.int64)
        self.near[at], self.near_counts[at] = hashes[top], counts[top]
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.bits = max(1, int(len(hashes)).bit_length())
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each, -1 of those that aren't known."""
        at = (hashes & np.uint64((1 << NEAR) - 1)).astype(np.int64)
        out = self.near_counts.take(at)
        left = np.nonzero(self.near.take(at) != hashes)[0]
        out[left] = self._far(hashes.take(left))
        return out

    def _far(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop, left = self.starts[bucket], self.starts[bucket + 1], np.arange(len(hashes))
        while True:
            go = at < stop
            at, stop, left = at[go], stop[go], left[go]
            if not len(left):
                return out
            hit = self.hashes[at] == hashes[left]
            out[left[hit]] = self.counts[at[hit]]
            at, stop, left = at[~hit] + 1, stop[~hit], left[~hit]


def _frequent(words: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all words that are at least so frequent that no more than `most` are. How many words have each count is
    a small table; only the words chosen leave their tasks."""
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c") + 1e-9)).cast("long"))
    steps_of = sorted((r.least, r["n"]) for r in words.groupBy(step.alias("least")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, held = None, 0
    for c, n in reversed(steps_of):
        if held + n > most:
            break
        least, held = c, held + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = words.where(F.col("c") >= int(least)).toArrow()
    return top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()


class Model:
    """What all training texts tell: counts (n tokens, v distinct, texts; words as a table), and the attention's weights."""

    def __init__(self, table: DataFrame, path: str) -> None:
        """table: symbol_table of all documents."""
        mine = speller(path)
        parts = table.where(f"kind <> {TEXT}").select("kind", "key", "counts").repartition("kind", "key").sortWithinPartitions("kind", "key")
        counts = settle(parts.mapInArrow(added_up, "kind byte, h long, c long"), "lm-counts")
        self.words = counts.where(f"kind = {WORD_COUNT}").select("h", "c")
        told = self.words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
        seen = counts.where(f"kind = {SYMBOL_COUNT}").select("h", "c").toArrow()  # symbols of the vocabulary at most
        of = np.zeros(mine.n_symbols, np.int64)
        of[seen.column("h").to_numpy()] = seen.column("c").to_numpy()
        self.texts = int(of[mine.end])
        self.v, self.n = told.v + (self.texts > 0), told.n + self.texts
        self.flat, self.layout = fit(table, of, mine.starts)

    @property
    def below(self) -> float:
        return float(self.n + 0.5 * (self.v + 1))


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out and key: with doc_id it tells a text."""
    need(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_mod5() == 1).alias("held_out"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def score(docs: DataFrame, path: str, *, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. path: the subword vocabulary's file
    of ranks, on every machine."""
    rows = numbered(docs)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = settle(symbol_table(rows, path), "lm-symbols", "zstd", 1)
    model = Model(table, path)
    end, words = speller(path).end, model.words
    held = spark.sparkContext.broadcast((model.flat, model.layout, Known(*_frequent(words)), model.below, model.texts))
    columns = f"key long, doc_id {kind}, held_out boolean, h long, spelled float, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, layout, known, below, texts = held.value
        scorer = Scorer(flat, layout)
        for part in steps(batches, "s", limit=SCORE_BYTES, room=ROOM):
            n_rows = part.num_rows
            offsets, symbols = symbols_of(part.column("s"))
            tokens = Tokens(offsets, symbols, end)
            word_logs = np.add.reduceat(scorer.score(symbols, offsets).astype(np.float64), tokens.starts)
            c = known.get(tokens.hashes)
            c[tokens.is_end] = texts  # the end is a token, too
            here, of = c >= 0, tokens.rows
            base = (np.maximum(c, 0) + 0.5) / below
            both = np.log(share * base + (1 - share) * np.exp(np.maximum(word_logs, -300) * LN10)) / LN10
            add = lambda x: np.bincount(of[here], weights=x[here], minlength=n_rows)
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("doc_id"), part.column("held_out"), part.column("key"), none(n_rows, pa.float32()), pa.array(tokens.counts, pa.int64()), pa.array(add((c > 0).astype(float)).astype(np.int64)), pa.array(add(np.log(base) / LN10)), pa.array(add(both))],
                names=columns_of,
            )
            rare = np.nonzero(~here)[0]
            if len(rare):
                n, rows_of = len(rare), pa.array(of[rare])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(rows_of), part.column("doc_id").take(rows_of), none(n, pa.bool_()), pa.array(tokens.hashes[rare].view(np.int64)), pa.array(word_logs[rare].astype(np.float32)), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.float64())],
                    names=columns_of,
                )

    columns_of = [c.strip().split(" ")[0] for c in columns.split(",")]
    out = table.where(f"kind = {TEXT}").select("doc_id", "held_out", "key", "s").mapInArrow(run, columns).withColumn("rare", F.col("spelled").isNotNull())
    out = out.join(words.withColumn("rare", F.lit(True)), ["h", "rare"], "left")
    base = (F.coalesce("c", F.lit(0)) + 0.5) / F.lit(model.below)
    both = F.log10(F.lit(share) * base + F.lit(1 - share) * F.pow(F.lit(10.0), F.greatest(F.col("spelled"), F.lit(-300.0)).cast("double")))
    out = out.groupBy("doc_id", "key").agg(
        F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("times"),
        F.sum(F.when(F.col("rare"), (F.coalesce("c", F.lit(0)) > 0).cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(F.col("rare"), F.log10(base)).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(F.col("rare"), both).otherwise(F.col("score"))).alias("score"),
    )
    # Rows that repeat in doc_id and text came together; each gets its own again.
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        "doc_id", "held_out", "n_tokens", F.expr("n_known div times").alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("times")).alias("base_score"), (F.col("score") / F.col("times")).alias("score"),
    )
