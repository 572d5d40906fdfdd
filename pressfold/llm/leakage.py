"""Documents that hold a passage of a held-out test item.

Texts are compared by their letters and digits in lower case. The terms of the
index are the items' runs of ``GRAM`` characters, so that white space and
punctuation may differ; each has a BM25 weight per item. A document is queried
passage by passage; passages overlap by the longest run that any item needs, so
a run lies whole in one of them. A passage that holds half of an item as one run
holds all terms inside that run, so the smallest sum of weights over any run of
half the length is a threshold that misses nothing. Postings lie in blocks of
items with the largest weight of each term in each block: a block is skipped if
the sum of the passage's bounds stays below the smallest threshold of the block,
as in block-max WAND; the bounds of a passage's terms are added up at once
instead of moving a cursor for each term. What remains above its threshold is
verified by the longest common run of characters, and the document is searched
for the item's answer.

Defined results: a null or empty text on either side matches nothing; items
too short for a term in each half are sought by plain search; repeated rows
give one row; an item that occurs in every document is found in every one; an
item without an answer has null for whether the answer is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 8
BLOCK = 16
#: Fixed values of BM25: saturation and length normalisation.
K1, B = 1.2, 0.75
#: Bytes of items' text in one index, which every worker holds; more items are divided among several.
MOST_ITEM_BYTES = 8 << 20
#: Least length of a passage in letters and digits.
PASSAGE = 512
_NOT_COUNTED = re.compile(r"[\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bare(text: str) -> str:
    """The letters and digits of a text in lower case."""
    return _NOT_COUNTED.sub("", text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` characters."""
    if len(codes) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + len(out)]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """Terms in sorted order, postings by term, bounds by block."""

    ids: np.ndarray
    codes: list[np.ndarray]
    needed: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    bounds: np.ndarray
    thresholds: np.ndarray
    places: np.ndarray
    place_starts: np.ndarray
    least: np.ndarray


def build(ids: list[int], texts: list[str], gram: int = GRAM) -> Index | None:
    """The index of items whose text has at least ``gram`` letters and digits."""
    kept = [(i, _codes(b)) for i, t in zip(ids, texts, strict=True) if t and len(b := bare(t)) >= gram]
    if not kept:
        return None
    codes = [c for _, c in kept]
    needed = np.array([(len(c) + 1) // 2 for c in codes])
    grams = [_grams(c, gram) for c in codes]
    lengths = np.array([len(g) for g in grams])
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(codes)), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    order = np.lexsort((owner, flat))
    flat, owner, place = flat[order], owner[order], place[order]
    new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
    at = np.flatnonzero(new)
    term_of, items, counts = flat[at], owner[at], np.diff(np.append(at, len(flat)))
    terms, starts = np.unique(term_of, return_index=True)
    starts = np.append(starts, len(term_of))
    holders = np.diff(starts)
    idf = np.log1p((len(codes) - holders + 0.5) / (holders + 0.5))
    norm = K1 * (1 - B + B * lengths / lengths.mean())
    weights = np.repeat(idf, holders) * counts * (K1 + 1) / (counts + norm[items])
    term = np.repeat(np.arange(len(terms)), holders)
    block = items // BLOCK
    head = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    bounds = np.maximum.reduceat(weights, head)
    block_starts = np.searchsorted(term[head], np.arange(len(terms) + 1))
    thresholds = np.zeros(len(codes))
    for k, own in enumerate(grams):
        span = max(1, needed[k] - gram + 1)
        rank = np.searchsorted(terms, own)
        weight = np.array([weights[starts[r] + np.searchsorted(items[starts[r] : starts[r + 1]], k)] for r in rank])
        thresholds[k] = _least_window(rank, weight, span)
    place_starts = np.append(at, len(flat))
    return Index(np.array([i for i, _ in kept]), codes, needed, terms, starts, items, weights, block_starts, block[head], bounds, thresholds, place, place_starts, np.minimum.reduceat(thresholds, np.arange(0, len(codes), BLOCK)))


def _least_window(rank: np.ndarray, weight: np.ndarray, span: int) -> float:
    """The smallest sum of the weights of the distinct terms in a window of ``span`` terms."""
    held: dict[int, int] = {}
    total, least = 0.0, np.inf
    for k, (r, w) in enumerate(zip(rank.tolist(), weight.tolist(), strict=True)):
        held[r] = held.get(r, 0) + 1
        total += w if held[r] == 1 else 0.0
        if k >= span:
            gone = int(rank[k - span])
            held[gone] -= 1
            total -= weight[k - span] if not held[gone] else 0.0
        if k >= span - 1:
            least = min(least, total)
    return least * (1 - 1e-6)


def _slices(starts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of all entries of these terms."""
    sizes = starts[ranks + 1] - starts[ranks]
    return np.repeat(starts[ranks] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def candidates(index: Index, ranks: np.ndarray) -> list[int]:
    """Items whose score for a passage of these distinct terms reaches their threshold."""
    at = _slices(index.block_starts, ranks)
    touched, own = np.unique(index.blocks[at], return_inverse=True)
    open_blocks = touched[np.bincount(own, index.bounds[at]) >= index.least[touched] * (1 - 1e-9)]
    if not len(open_blocks):
        return []
    at = _slices(index.starts, ranks)
    block = index.items[at] // BLOCK
    place = np.minimum(np.searchsorted(open_blocks, block), len(open_blocks) - 1)
    at = at[open_blocks[place] == block]
    found, own = np.unique(index.items[at], return_inverse=True)
    return found[np.bincount(own, index.weights[at]) >= index.thresholds[found]].tolist()


def passages(index: Index, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of the found terms, by their places, of each passage that holds any."""
    overlap = int(index.needed.max())
    size = max(PASSAGE, 2 * overlap)
    step = size - overlap
    k = 0
    while k < len(places):
        begin = max(0, (int(places[k]) - size) // step + 1) * step  # the first passage that reaches the term
        while begin <= places[k]:
            a, b = np.searchsorted(places, (begin, begin + size))
            yield int(a), int(b)
            begin += step
        k = int(np.searchsorted(places, begin))
        k = max(k, b)


def longest_run(index: Index, item: int, doc: np.ndarray, places: np.ndarray, ranks: np.ndarray, gram: int = GRAM) -> int:
    """Length of the longest run of characters that the item and the document share, from the places of shared terms."""
    best, here = 0, []
    for place, rank in zip(places.tolist(), ranks.tolist(), strict=True):
        k = index.starts[rank] + np.searchsorted(index.items[index.starts[rank] : index.starts[rank + 1]], item)
        if k < index.starts[rank + 1] and index.items[k] == item:
            here += [(place - int(p), place) for p in index.places[index.place_starts[k] : index.place_starts[k + 1]]]
    here.sort()
    own = index.codes[item]
    k = 0
    while k < len(here):
        shift, start = here[k]
        end = k
        while end + 1 < len(here) and here[end + 1] == (shift, here[end][1] + 1):
            end += 1
        length = here[end][1] - start + gram
        if length > best and np.array_equal(doc[start : start + length], own[start - shift : start - shift + length]):
            best = length
        k = end + 1
    return best


def matches(index: Index, texts: list[str | None], gram: int = GRAM) -> Iterator[tuple[int, int]]:
    """(row, item) of the texts that hold half of an item."""
    for row, text in enumerate(texts):
        if not text:
            continue
        doc = _codes(bare(text))
        grams = _grams(doc, gram)
        if not len(grams):
            continue
        at = np.searchsorted(index.terms, grams)
        at[at == len(index.terms)] = 0
        places = np.flatnonzero(index.terms[at] == grams)
        if not len(places):
            continue
        ranks = at[places]
        found: set[int] = set()
        for a, b in passages(index, places):
            for item in candidates(index, np.unique(ranks[a:b])):
                if item not in found and longest_run(index, item, doc, places[a:b], ranks[a:b], gram) >= index.needed[item]:
                    found.add(item)
                    yield row, item


def leaked(documents: DataFrame, items: DataFrame, *, text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id) of the documents that hold at least half of an item as one run."""
    return hits(documents, items, text=text, most=most).select("doc_id", "item_id")


def hits(documents: DataFrame, items: DataFrame, *, text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, with_answer) of the documents that hold at least half of an item as one run.

    ``items`` has item_id, text and, if there are any, answer. An index holds at most about
    ``most`` bytes of text, gathered at the driver and broadcast; more items
    are divided among several indexes, each with a pass over the documents.
    """
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string").alias("answer")
    own = items.select("item_id", F.col(text).alias("t"), answer).where("item_id is not null and t is not null").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("answer"), F.lit(0))), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    docs = documents.select("doc_id", F.col(text).alias("t")).where("doc_id is not null and t is not null")
    found = None
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        held = documents.sparkSession.sparkContext.broadcast(_Held([tuple(r) for r in rows]))
        hits = docs.mapInPandas(_searcher(held), "doc_id bigint, item_id bigint, with_answer boolean")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.max("with_answer").alias("with_answer"))


class _Held:
    """The items of one index, those too short for it, and their answers."""

    def __init__(self, rows: list[tuple[int, str, str | None]]) -> None:
        bared = [(i, t, bare(t)) for i, t, _ in rows]
        self.short = [(i, b) for i, _, b in bared if 0 < len(b) < 2 * GRAM]
        long = [(i, t) for i, t, b in bared if len(b) >= 2 * GRAM]
        self.index = build([i for i, _ in long], [t for _, t in long]) if long else None
        self.answers = {i: b for i, _, a in rows if a and (b := bare(a))}


def _searcher(held):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: _Held = held.value
        for b in batches:
            docs = [t if isinstance(t, str) else None for t in b["t"]]
            found = [(row, int(own.index.ids[item])) for row, item in matches(own.index, docs)] if own.index else []
            for row, t in enumerate(docs):
                if t and own.short:
                    all_of = bare(t)
                    found += [(row, i) for i, s in own.short if any(s[k : k + (len(s) + 1) // 2] in all_of for k in range(len(s) // 2 + 1))]
            answered = [(a in bare(docs[row])) if (a := own.answers.get(i)) else None for row, i in found]
            at = [row for row, _ in found]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[at], "item_id": np.array([i for _, i in found], dtype=np.int64), "with_answer": pd.array(answered, dtype="boolean")})

    return search
