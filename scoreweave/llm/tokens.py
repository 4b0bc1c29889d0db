"""Token counts by byte-pair merging on a heap and a linked list.

A piece starts as one symbol per byte. The adjacent pair of lowest rank is popped and merged, again and again; every merge
takes one symbol away, so the count is bytes minus merges and no identifiers are emitted. Pieces repeat, so their counts
are remembered; the memory is emptied when it is full, which changes no result.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts are counted whole; repeated rows each get a row; an
empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need, steps

#: How the vocabulary's library cuts a text into pieces (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000
#: Longer pieces are rare and are counted without being remembered.
LONGEST = 64


def load_rules(path: str) -> dict:
    """What counting needs of a byte-level BPE file of the tokenizers library: merges by rank and special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE files can be counted")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"]], "name": path}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such files: printable bytes for themselves, the rest from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return letters


class Counter:
    def __init__(self, rules: dict) -> None:
        numbers: dict[str, int] = {x: i for i, x in enumerate(byte_letters())}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(rules["merges"]):
            made = numbers.setdefault(a + b, len(numbers))
            self.pairs.setdefault(numbers[a] << 20 | numbers[b], (rank, made))
        self.special = regex.compile("|".join(map(regex.escape, sorted(rules["special"], key=len, reverse=True)))) if rules["special"] else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Number of symbols left when no pair can be merged."""
        n = len(symbols)
        if n < 2:
            return n
        pairs, held = self.pairs, list(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (hit := pairs.get(held[i] << 20 | held[i + 1])) is not None:
                heap.append((hit[0], i, hit[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if held[i] < 0 or j < 0:
                continue
            hit = pairs.get(held[i] << 20 | held[j])
            if hit is None or hit[1] != made:  # one of the two has been merged meanwhile
                continue
            held[i], held[j] = made, -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (hit := pairs.get(made << 20 | held[k])) is not None:
                    heapq.heappush(heap, (hit[0], i, hit[1]))
            if (h := before[i]) >= 0 and (hit := pairs.get(held[h] << 20 | made)) is not None:
                heapq.heappush(heap, (hit[0], h, hit[1]))
        return n - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        get = known.get
        for piece in self.pieces.findall(text):
            n = get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for hit in self.special.finditer(text):
            total += self.plain(text[at : hit.start()]) + 1
            at = hit.end()
        return total + self.plain(text[at:] if at else text)


_counters: dict[str, Counter] = {}


def _counter(rules: Broadcast) -> Counter:
    """One a process, so that what it remembers outlives a task."""
    name = rules.value["name"]
    if name not in _counters:
        _counters[name] = Counter(rules.value)
    return _counters[name]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). path: the vocabulary's file, read on the
    driver; its merges (a file's worth, no part of the data) are broadcast."""
    need(docs, "doc_id", "text")
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(rules)
        for part in steps(batches):
            texts = part.column("text").to_pylist()
            tokens = [counter.count(t) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
