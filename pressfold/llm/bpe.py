"""Encoding of texts with a public byte-level BPE vocabulary.

A partition's distinct pieces (words with their leading space, as the
vocabulary's pattern cuts them) are laid out as one chain of symbols. An index
maps each pair of neighbours to all its places in the chain. Ranks that have
places are taken in ascending order; a rank is applied to all its places at
once, and only the lists of the pairs next to them change.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; all other columns but the id are left
out; repeated rows stay repeated.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies are; an argument of ``encode``.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pattern that cuts text into pieces before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps; beyond, all are forgotten.
KEPT = 1 << 19
#: Bytes of new pieces that are merged together.
CHAIN = 4 << 20


def _printable() -> dict[str, int]:
    """The byte behind each character in which the vocabulary file writes bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


class Merges:
    """Ids of single bytes, and the rank and result of every pair that may merge."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocabulary = model["vocab"]
        self.bytes = np.zeros(256, dtype=np.int64)
        for shown, byte in _printable().items():
            self.bytes[byte] = vocabulary[shown]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.results = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.lefts, self.rights = key >> 32, key & 0xFFFFFFFF

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def _index(places: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each rank with its places in ascending order."""
    kept = ranks >= 0
    places, ranks = places[kept], ranks[kept]
    order = np.lexsort((places, ranks))
    places, ranks = places[order], ranks[order]
    if len(ranks):
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(ranks)), strict=True):
            yield int(ranks[a]), places[a:b]


def _not_overlapping(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, those that merge from left to right."""
    kept, last = np.ones(len(at), dtype=bool), -1
    for k, (place, following) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
        if place == last:
            kept[k] = False
            last = -1
        else:
            last = following
    return at[kept]


def merge_pieces(pieces: list[bytes], table: Merges) -> list[np.ndarray]:
    """The ids of each piece."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    symbol = table.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    size = len(symbol)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    ends = np.cumsum(lengths) - 1
    after[ends] = -1
    before[(ends + 1)[:-1]] = -1
    alive = np.ones(size, dtype=bool)
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        for rank, own in _index(places, table.rank(symbol[places], symbol[after[places]])):
            if rank in lists:
                lists[rank].append(own)
            else:
                lists[rank] = [own]
                heapq.heappush(active, rank)

    enter(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        parts = lists.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        left, right = table.lefts[rank], table.rights[rank]
        at = at[alive[at] & (symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if not len(at):
            continue
        if left == right:
            at = _not_overlapping(at, after[at])
        gone = after[at]
        alive[gone] = False
        symbol[at] = table.results[rank]
        follows = after[gone]
        after[at] = follows
        inner = follows >= 0
        before[follows[inner]] = at[inner]
        ahead = before[at]
        enter(np.unique(np.concatenate((at[inner], ahead[ahead >= 0]))))
    kept = np.flatnonzero(alive)
    bounds = np.searchsorted(owner[kept], np.arange(len(pieces) + 1))
    ids = symbol[kept].astype(np.int32)
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Encoder:
    """Encodes batches; keeps the ids of the pieces it has met."""

    def __init__(self, path: str) -> None:
        self.table = merges(path)
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def learn(self, pieces: set[str]) -> None:
        fresh: list[str] = []
        held = 0
        for piece in pieces:
            fresh.append(piece)
            held += len(piece)
            if held >= CHAIN:
                self._merge(fresh)
                fresh, held = [], 0
        if fresh:
            self._merge(fresh)

    def _merge(self, fresh: list[str]) -> None:
        found = merge_pieces([p.encode("utf-8", "surrogatepass") for p in fresh], self.table)
        self.known.update(zip(fresh, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self.known = {}
        cut = [self.cut.findall(t) if t else [] for t in texts]
        self.learn({p for pieces in cut for p in pieces}.difference(self.known))
        none = np.zeros(0, dtype=np.int32)
        return [np.concatenate([self.known[p] for p in pieces]) if pieces else none for pieces in cut]


#: Characters of text that are encoded together.
GROUP = 8 << 20


def encode(documents: DataFrame, *, text: str = "text", path: str = "") -> DataFrame:
    """(doc_id, ids) of every row; ``path`` is the vocabulary file, which every executor must have."""
    path = path or os.path.join(FOLDER, VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        ids: list[int] = []
        texts: list[str | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            found = encoder.encode(texts)
            bounds = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], schema=schema)
            ids.clear()
            texts.clear()
            return out

        for batch in batches:
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(t)
                held += len(t or "")
                if held >= GROUP:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return own.mapInArrow(run, "doc_id bigint, ids array<int>")
