"""Texts that were cut off, and how often each source cuts.

First copies: a record whose headline and summary are the beginning of a longer
record is a cut copy, found exactly by the hashes of all beginnings. Near-copies
with other differences are banded by min-hash of their five-word shingles, the
words of each field aligned, and the copy whose alignment ends early is cut. All
other texts are judged by their end. Broken characters, entities, tags, addresses and open brackets show
a cut; a mark (``...``, ``Read more``) shows one if no finished sentence stands
before it. A text that just stops is judged by its closing word: how often the
corpus ends a sentence or a headline with it, alone and in sentences that begin
alike, against how often it goes on. A length at which several texts of a
source break off is a limit of that source, and what stops there was cut.

Defined results: null, empty and blank fields are no cases; rows without an id
are left out; a null source is a source of its own; repeated rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.llm import residue
from pressfold.session import stored

SHINGLE = 5
#: Similarity that a band finds with probability 0.985; bands of rows of hashes.
SIMILARITY, BANDS, ROWS = 0.8, 8, 4
#: Broken ends of one source at one length that make the length its limit.
LIMIT_ROWS = 3
#: The catalogue's own cuts: a summary of so many characters with three dots, a title of so many characters.
CATALOGUE_LIMIT, TITLE_LIMIT = 203, 200

# Marks of a cut.
_MORE = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|(?:\.\.\.|…)\s*(?:read more|continue reading|more|더\s?보기|계속 읽기|자세히 보기|続きを読む)\s*[»>→]?)\s*$", re.IGNORECASE)
#: How the marks above end.
_MORE_ENDS = "])…기egむ»>→"
_DOTS = re.compile(r"(?<=[^\s~])(?:\.\.\.|…)$")
_BROKEN = re.compile(r"�+$|&(?:#\d{0,6}|[a-zA-Z]{1,8})?$|<[/!]?[a-zA-Z]*(?:\s[^<>]*)?$|https?:?/{0,2}$|https?://(?:[\w-]+\.)*[\w-]*$|https?://(?:[\w-]+\.)+$")
_COMPLETE_HOST = re.compile(r"https?://(?:[\w-]+\.)+[a-z]{2,}$", re.IGNORECASE)
_END = re.compile(r"[.!?。！？।؟…][\"'”’」』）)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_TRIM = " \t\r\n 　~!|•·※\"'“”‘’「」『』<>[]"
_OPEN = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）"}
_LOOSE = re.compile(r"(?:\s+[.…~!?]+)+$")
_AFTER = ".!?。！？…\"'”’」』）),;:"
_HIDDEN = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"\w+")
_NUMBERED = re.compile(r"[(\[]?v?9+\D?")


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Keys(dict):
    """The hashes of the keys that a worker has met."""

    def __missing__(self, parts: tuple[str, str]) -> int:
        if len(self) > 1 << 19:
            self.clear()
        found = self[parts] = _hash(*parts)
        return found


_KEYS = _Keys()


def _tidy(text: str) -> str:
    """A headline or a core without the decoration around it."""
    text = text.strip(_TRIM)
    if text.isascii() and text[-1:].isalnum():
        return text
    return _LOOSE.sub("", _HIDDEN.sub(" ", text).strip(_TRIM)).strip(_TRIM)


def open_bracket(text: str) -> bool:
    """Whether a bracket opened near the end is not closed."""
    tail = text[-60:]
    if tail.isascii() and "(" not in tail and "[" not in tail and "{" not in tail:
        return False
    for o, c in _OPEN.items():
        at = text.rfind(o)
        if at >= 0 and at >= len(text) - 60 and c not in text[at:] and text[max(0, at - 1)] not in ":;":
            return True
    return False


def opener(sentence: list[str]) -> str:
    """The first two words of a sentence in Latin letters, a name among them left open; "" for others."""
    if len(sentence) < 3 or not sentence[0][:1].isascii():
        return ""
    second = sentence[1]
    return f"{sentence[0].lower()} {'*' if second[:1].isupper() else second.lower()}"


def _plain(word: str) -> str:
    """A word of ``_low`` without the marks around its end."""
    word = word.rstrip(_AFTER)
    return word if word.islower() else _low(word)


def _kind(word: str, first: bool) -> str:
    """A word as it is counted: names within a sentence are alike."""
    return "*" if not first and word[:1].isupper() and word[:1].isascii() and len(word) > 3 else _plain(word)


def _low(text: str) -> str:
    """The text in lower case with every number as 9."""
    low = text.lower()
    return _DIGITS.sub("9", low) if not low.isalpha() else low


class Counts:
    """Counts of words as they are written; what they mean is settled once for each distinct word when they are given out."""

    def __init__(self) -> None:
        self.headline, self.final, self.body, self.rest, self.alike = Counter(), Counter(), Counter(), Counter(), Counter()

    def __len__(self) -> int:
        return sum(map(len, (self.headline, self.final, self.body, self.rest, self.alike)))

    def title(self, text: str) -> None:
        words = _tidy(text).lower().split()
        if not words:
            return
        last = words.pop()
        self.headline.update(words)
        if not text.rstrip().endswith(("...", "…")) or not _DOTS.search(text.rstrip()):
            self.final[last] += 1

    def summary(self, text: str, words: list[str]) -> None:
        """``words``: those of the text in lower case."""
        if not words:
            return
        text, end = text.strip(), words[-1]
        finished = not end[-1].isalnum() and bool(_END.search(end)) and not end.endswith(("...", "…"))
        self.body.update(words if finished else words[:-1])
        if not finished:
            last = _plain(_low(end))
            self.rest["s", last] += 1
            if len(words) > 1:
                self.rest["p", f"{_plain(_low(words[-2]))}|{last}"] += 1
        if not text[0].isascii() and not text[-2:-1].isascii():
            return
        for sentence in _SENTENCE.split(text):
            if sentence[:1].isascii():
                begin = opener(sentence.split(None, 2))
                if begin:
                    last = sentence.rsplit(None, 1)[-1]
                    self.alike[begin, last] += 1

    def table(self) -> dict[int, list[int]]:
        """Numbers of each key: finished ends, places within, unfinished ends, sentences."""
        table: dict[int, list[int]] = {}

        def add(kind: str, key: str, place: str, n: int) -> None:
            table.setdefault(_hash(kind, key), [0, 0, 0, 0])[PLACES.index(place)] += n

        for words, place in ((self.headline, "m"), (self.final, "f")):
            for word, n in words.items():
                plain = _plain(_low(word))
                if plain:
                    add("t", plain, place, n)
                    if "가" <= plain[-1] <= "힣":
                        add("x", plain[-2:], place, n)
        for word, n in self.body.items():
            add("s", _plain(_low(word)), "e" if _END.search(word) and not word.endswith(("...", "…")) else "m", n)
        for (kind, key), n in self.rest.items():
            add(kind, key, "f", n)
        for (begin, last), n in self.alike.items():
            add("o", begin, "n", n)
            add("o", f"{begin}|{_kind(last.rstrip('.!?'), False)}", "e" if last[-1] in ".!?" and not last.endswith("...") else "f", n)
        return table


PLACES = "emfn"


def _given_out(counts: Counts) -> pa.RecordBatch:
    table = counts.table()
    values = np.array(list(table.values()), dtype=np.int64).reshape(-1, 4)
    rest = _nothing(len(table))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(table), COUNTS, dtype=np.int32)), *rest(pa.int64(), 2), *rest(pa.string(), 1), *rest(pa.int32(), 3), *rest(pa.list_(pa.int64()), 1), pa.array(np.fromiter(table, dtype=np.int64, count=len(table))), *(pa.array(values[:, k]) for k in range(4)), *rest(pa.int64(), 1)],
        schema=_SCAN,
    )


def judge(field: str, text: str, *others: str) -> tuple[int, list[int], int]:
    """(verdict, keys, length) of a field's end; ``others`` are the other texts of its record.

    Verdict 2 is a certain cut, 0 a certain end, 1 asks the counts of the keys:
    closing word; sentence beginning with closing word, sentence beginning;
    word before with closing word, word before. The last number is 1 if the
    record itself knows the closing word, -1 if only a longer one. 3 is as 1 with dots behind.
    """
    text = text.rstrip()
    size = len(text)
    end = text[-1:]
    dotted = end == "…" or text.endswith("...")
    if field == "s" and end in ".!?。！？" and not dotted:
        return 0, [], size
    if end in _MORE_ENDS and _MORE.search(text, max(0, size - 60)):
        return 2, [], size
    tail = text[-80:]
    if (end in "�&<;:/" or "&" in tail[-10:] or "<" in tail or "://" in tail or "http" in tail) and _BROKEN.search(text) and not _COMPLETE_HOST.search(text):
        return 2, [], size
    dots = _DOTS.search(text) if dotted else None
    core = text[: dots.start()].rstrip(".…") if dots else text
    if dots and size == CATALOGUE_LIMIT and field == "s":
        return 2, [], size
    if dots and _END.search(text[: dots.start()].rstrip()) and not text[: dots.start()].endswith("."):
        return 0, [], size
    if field == "s" and not dots and _END.search(text):
        return 0, [], size
    if field == "t" and (core[-1:] in "!?~" or (end == "." and not dots)):
        return 0, [], size
    if open_bracket(core):
        return 2, [], size
    core = _tidy(core)
    words = core.split()
    if not words:
        return 0, [], size
    last = words[-1].rstrip(",;:")
    plain = _plain(_low(last))
    name = last[:1].isupper() and last[:1].isascii() and len(words) > 1
    known = 1 if _NUMBERED.fullmatch(plain) else _known(plain, _low(core[: len(core) - len(words[-1])]), name, *others)
    if known == 0:
        known = int(name and not dots) if field == "t" else 0
    verdict = 3 if dots else 1
    if field == "t":
        ending = _KEYS["x", plain[-2:]] if plain and "가" <= plain[-1] <= "힣" and len(plain) > 2 else 0
        return verdict, [_KEYS["t", plain], ending, _KEYS["s", plain] if ending else 0, 0, 0, known], size
    sentence = _SENTENCE.split(core)[-1].split()
    begin = opener(sentence)
    closing = "*" if name and known > 0 else plain
    before = _plain(_low(sentence[-2])) if len(sentence) > 1 else ""
    keys = [_KEYS["s", plain], 0, 0, 0, 0, known]
    if begin:
        keys[1:3] = [_KEYS["o", f"{begin}|{closing}"], _KEYS["o", begin]]
    if before:
        keys[3:5] = [_KEYS["p", f"{before}|{plain}"], _KEYS["s", before]]
    return verdict, keys, size


def _known(plain: str, around: str, name: bool, *others: str) -> int:
    """1 if the record has the word elsewhere, -1 if only a longer word that begins with it, else 0."""
    longer = False
    for text in (around, *(_low(x) if "9" in plain else x.lower() for x in others)):  # numbers elsewhere make no difference to other words
        at = text.find(plain) if plain else -1
        while at >= 0:
            stop = at + len(plain)
            if not text[at - 1 : at].isalnum():
                if not text[stop : stop + 1].isalnum():
                    return 1
                longer = True
            at = text.find(plain, at + 1)
    return -1 if longer and (name or len(plain) >= 4 or (len(plain) >= 2 and not plain.isascii())) else 0


_SCAN = pa.schema(
    [("kind", pa.int32()), ("id", pa.int64()), ("source", pa.int64()), ("field", pa.string()), ("size", pa.int32()), ("verdict", pa.int32()), ("known", pa.int32()), ("keys", pa.list_(pa.int64())), ("key", pa.int64())]
    + [(p, pa.int64()) for p in (*PLACES, "o")]
)
_NO_KEYS = [0] * 5
ENDS, KEYS, COUNTS, LINES, RESIDUE = 0, 1, 2, 3, 4


def _scan(batches: Iterator[pa.RecordBatch], with_lines: bool = False) -> Iterator[pa.RecordBatch]:
    """One pass over the texts for all that is asked of them.

    ENDS: a field that has not certainly ended, the keys that judge it (as e to n, and o) and their
    hash. KEYS: the bands of a record and, marked as such, the hash of its first words, its sketch
    (as e) and the hash of its words. COUNTS: counts of words, given out whenever a million are held.
    On request also LINES, the lines that ``residue.settled`` counts, in one row for each batch, and RESIDUE,
    a line of a field that may be residue: its kind (as verdict), hash, host (as e) and wording (as m).
    """
    counts, words, lines = Counts(), _Words(), residue.Lines()
    for b in batches:
        columns = ids, sources, fields, sizes, verdicts, knowns, asked, hashes = [], [], [], [], [], [], [], []
        texts, firsts, owners, heads = [], [], [], []
        for key, source, title, summary, link, site in zip(*(b.column(c).to_pylist() for c in ("id", "source", "title", "summary", "link", "site")), strict=True):
            if with_lines:
                lines.add(key, title, summary, link, site)
            slug = _slug(link) if link else ""
            parts = near_words(title, summary)
            if title:
                counts.title(title)
            if summary:
                counts.summary(summary, parts["s"] if summary[-1].isalnum() and summary[-1] not in _MORE_ENDS else summary.lower().split())
            for code, text, other in (("t", title, summary), ("s", summary, title)):
                if not text or text.isspace():
                    continue
                verdict, keys, size = judge(code, text, other or "", slug)
                if verdict:
                    ids.append(key)
                    sources.append(source)
                    fields.append(code)
                    sizes.append(size)
                    verdicts.append(verdict)
                    knowns.append(keys[5] if keys else 0)
                    asked.append(keys[:5] or _NO_KEYS)
                    hashes.append(hash(tuple(keys[:5])))
            if len(parts["t"]) >= SHINGLE or len(parts["s"]) >= SHINGLE:
                texts.append(parts["t"] + parts["s"])
                firsts.append(len(parts["t"]))
                owners.append(key)
                heads.append(_head(title, parts["s"]))
        rest = _nothing(len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), ENDS, dtype=np.int32)), *(pa.array(c, f.type) for c, f in zip(columns[:6], list(_SCAN)[1:7], strict=True)), *rest(pa.list_(pa.int64()), 1), pa.array(hashes, pa.int64()), *(pa.array(c) for c in np.array(asked, dtype=np.int64).reshape(-1, 5).T)], schema=_SCAN
        )
        if texts:
            own, sketch, digests = _minima(texts, words, firsts)
            bands = _with_heads(own, heads)
            rest = _nothing(len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), KEYS, dtype=np.int32)), pa.array(owners, pa.int64()), *rest(pa.int64(), 1), *rest(pa.string(), 1), *rest(pa.int32(), 3), bands, pa.array(digests), pa.array(sketch), *rest(pa.int64(), 4)],
                schema=_SCAN,
            )
        if lines.counted or lines.rows:
            yield _of_lines(lines)
            lines.start()
        if len(words) > 1 << 20:
            words.clear()
        if len(counts) > 1_000_000:
            yield _given_out(counts)
            counts = Counts()
    if len(counts):
        yield _given_out(counts)


def _of_lines(lines: residue.Lines) -> pa.RecordBatch:
    ids, fields, hosts, found, kinds, wordings = zip(*lines.rows, strict=True) if lines.rows else ((),) * 6
    rest = _nothing(len(ids) + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([LINES, *[RESIDUE] * len(ids)], pa.int32()), pa.array([None, *ids], pa.int64()), *rest(pa.int64(), 1), pa.array([None, *fields], pa.string()), *rest(pa.int32(), 1), pa.array([None, *kinds], pa.int32()), *rest(pa.int32(), 1),
            pa.array([lines.counted, *[None] * len(ids)], pa.list_(pa.int64())), pa.array([None, *found], pa.int64()), pa.array([None, *hosts], pa.int64()), pa.array([None, *wordings], pa.int64()), *rest(pa.int64(), 3),
        ],
        schema=_SCAN,
    )


def _slug(link: str) -> str:
    """The words of a link's path but the last; a longer one is the headline itself, cut where that was cut."""
    path = link.partition("://")[2].partition("/")[2]
    return path.translate(_SLUG).rpartition(" ")[0] if sum(map(path.count, "-/_?&=+ ")) <= 3 else ""


def _nothing(rows: int):  # noqa: ANN202
    return lambda kind, columns: [pa.nulls(rows, kind)] * columns


def _with_heads(own: np.ndarray, heads: list[int | None]) -> pa.ListArray:
    """The bands of each text, which are even, and behind them its head, which is odd, if it has one."""
    has = np.array([h is not None for h in heads])
    rows = np.empty((len(heads), BANDS + 1), dtype=np.int64)
    rows[:, :BANDS] = own & ~np.int64(1)
    rows[:, BANDS] = [0 if h is None else h | 1 for h in heads]
    there = np.ones(rows.shape, dtype=bool)
    there[:, BANDS] = has
    offsets = np.concatenate(([0], np.cumsum(BANDS + has))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[there]))


def _head(title: str | None, summary: list[str]) -> int | None:
    """The words that a record shares with every cut copy of it; None for records too short to have one."""
    if not summary:
        return None
    first = [letters] if title and (letters := _letters(title)) else []
    return _hash(" ".join((first + summary[: SHINGLE - 1])[: SHINGLE - 1])) if summary and len(first) + len(summary) >= SHINGLE else None


def _letters(title: str) -> str:
    """The letters and digits of a headline."""
    low = title.lower()
    return low.encode().translate(None, _ASCII_OTHER).decode() if low.isascii() else _OTHER.sub("", low)


_OTHER = re.compile(r"[\W_]+")
_ASCII_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_SLUG = str.maketrans("-/_?&=+", "       ")
_SCAN_SQL = "kind int, id bigint, source bigint, field string, size int, verdict int, known int, keys array<bigint>, key bigint, " + ", ".join(f"{p} bigint" for p in (*PLACES, "o"))
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """The hash of each word a worker has met."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def signatures(texts: list[list[str]], words: _Words, heads: list[int] | None = None) -> np.ndarray:
    """The hashes of the bands of each text, which must have a shingle; none spans the first ``heads`` words and the rest."""
    return _minima(texts, words, heads)[0]


def _minima(texts: list[list[str]], words: _Words, heads: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signatures``, a sketch of two bits of each minimum, and the hash of all words with their places."""
    counts = np.array([len(t) for t in texts])
    codes = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=int(counts.sum()))
    rolled = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        rolled = (rolled ^ codes[k : k + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(31)
    ends = np.cumsum(counts)
    place = np.arange(len(rolled))
    inside = place <= np.repeat(ends - SHINGLE, counts)[: len(rolled)]
    sizes = counts - SHINGLE + 1
    if heads is not None:
        first = np.array(heads)
        own = np.maximum(first - SHINGLE + 1, 0)
        begins = ends - counts
        inside = ((place >= np.repeat(begins + first, counts)[: len(rolled)]) & inside) | (place < np.repeat(begins + own, counts)[: len(rolled)])
        sizes = own + np.maximum(counts - first - SHINGLE + 1, 0)
    shingles = rolled[inside]
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bands, sketch = np.zeros((len(texts), BANDS), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((shingles ^ _SEEDS[0, k]) * _SEEDS[1, k] >> np.uint64(1), at)
        sketch = (sketch << np.uint64(2)) | (least & np.uint64(3))
        band = bands[:, k // ROWS]
        band = (band ^ least) * np.uint64(0xD6E8FEB86659FD93)
        bands[:, k // ROWS] = band ^ (band >> np.uint64(32))
    begins = ends - counts
    at = np.arange(len(codes)) - np.repeat(begins, counts)
    factors = np.multiply.accumulate(np.full(int(counts.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
    digests = np.add.reduceat((codes ^ (codes >> np.uint64(31))) * factors[at], begins) + (counts if heads is None else np.array(heads)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (bands ^ np.arange(1, BANDS + 1, dtype=np.uint64)).astype(np.int64), sketch.astype(np.int64), digests.astype(np.int64)


def without_mark(text: str) -> str:
    """A text without the mark of a cut or a broken character at its end."""
    text = text.rstrip()
    if text[-1:] in _MORE_ENDS:
        found = _MORE.search(text, max(0, len(text) - 60))
        text = text[: found.start()].rstrip() if found else text
    return text if text[-1:].isalnum() or not text.endswith(("...", "…", "�")) else _MARK_TAIL.sub("", text).rstrip()


_MARK_TAIL = re.compile(r"(?:\.\.\.|…|�)+$")


def core_of(title: str | None, summary: str) -> str:
    """What is compared of a record: the letters of its headline, then its summary without a mark."""
    return f"{_letters(title) if title else ''}\n{without_mark(summary)}"


def finished(text: str) -> bool:
    """Whether a text ends in a finished sentence."""
    return not text[-1:].isalnum() and bool(_END.search(text[-12:]))


def _least(count: int) -> int:
    """Words before the last of the shortest beginning that is similar to a core of so many words."""
    return max(SHINGLE, math.ceil(SIMILARITY * (count - SHINGLE + 1)) + SHINGLE - 1) - 1


def _key(begin: bytes, end: str, source: int) -> int:
    return xxhash.xxh3_64_intdigest(begin, seed=source + 2 if finished(end) else 0) - (1 << 63)


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id, size): whole words that begin a core, at each place where a similar copy may have been cut."""
    for b in batches:
        keys, ids, sizes = [], [], []
        for key, title, summary in zip(b["id"], b["title"], b["summary"], strict=True):
            words = core_of(title, summary).lower().split()
            if len(words) < SHINGLE:
                continue
            size = sum(map(len, words)) + len(words) - 1
            least = _least(len(words))
            begin = " ".join(words[:least])
            for word in words[least:]:
                keys.append(_hash(begin))
                ids.append(key)
                sizes.append(size)
                begin = f"{begin} {word}"
        yield pd.DataFrame({"key": np.array(keys, dtype=np.int64), "id": np.array(ids, dtype=np.int64), "size": np.array(sizes, dtype=np.int32)})


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id): the whole core of each record; without an id, every beginning of it that would be a cut copy."""
    for b in batches:
        keys, ids, places = [], [], set()
        for key, source, title, summary in zip(b["id"], b["source"], b["title"], b["summary"], strict=True):
            words = core_of(title, summary).lower().split()
            if len(words) < SHINGLE:
                continue
            text = " ".join(words)
            keys.append(_key(text.encode("utf-8", "surrogatepass"), text, source))
            ids.append(key)
            for at in range(len(" ".join(words[: _least(len(words))])) + 2, len(text)):
                if text[at - 1] != " " and _WORD.search(text, at):
                    places.add(_key(text[:at].encode("utf-8", "surrogatepass"), text[:at], source))
        yield pd.DataFrame({"key": np.array([*keys, *places], dtype=np.int64), "id": pd.array([*ids, *[None] * len(places)], dtype="Int64")})


def scanned(records: DataFrame, with_lines: bool = False) -> DataFrame:
    """The rows of ``_scan`` over records (id, source, title, summary, link, site), written once; without lines the last two may be missing."""
    for name in {"link", "site"} - {*records.columns}:
        records = records.withColumn(name, F.lit(None).cast("string"))
    return stored(records.select("id", "source", "title", "summary", "link", "site").mapInArrow(lambda batches: _scan(batches, with_lines), _SCAN_SQL))


@dataclass
class Shared:
    """Records that share a band or their first words with another text.

    ``texts``: (id, source, title, summary, begun) of all these records, begun
    if it is the first words; ``groups``: (band, id) of bands of up to ``BLOCK``
    records, one band for each set of records; ``crowded``: (band, id) of the
    other bands; ``sketches``: (id, text, sketch).
    """

    texts: DataFrame
    groups: DataFrame
    crowded: DataFrame
    sketches: DataFrame


#: What ``_shared`` says of a row: in a group, begun alike, in a crowded band, the band has several texts.
GROUP, BEGUN, CROWD, SEVERAL = 0, 1, 2, 3
#: Rows of a band that are held; those of a band with more are given out before its end.
HELD = 1 << 16


def _shared(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(kind, band, id) over rows (band, id, text) sorted by band: what is shared by several texts.

    Bands with the same ids get the same name. The rows of crowded bands are
    given out as they pass, and at the end a row without an id if there were several texts.
    """
    held = [np.zeros(0, dtype=np.int64)] * 3
    passed: tuple[int, int] | None = None  # least and greatest text of the held band, if rows of it were given out
    for b in _and_end(batches):
        band, key, text = (np.concatenate((h, b.column(k).to_numpy())) for k, h in enumerate(held)) if b is not None else held
        if not len(band):
            continue
        begins = np.concatenate(([0], np.flatnonzero(band[1:] != band[:-1]) + 1))
        sizes = np.diff(np.concatenate((begins, [len(band)])))
        least, most = np.minimum.reduceat(text, begins), np.maximum.reduceat(text, begins)
        crowd = sizes > block
        if passed:
            least[0], most[0], crowd[0] = min(least[0], passed[0]), max(most[0], passed[1]), True
        whole, given = np.ones(len(begins), dtype=bool), False
        if b is not None:  # the last band may go on
            whole[-1], given = False, sizes[-1] > HELD
            passed = (least[-1], most[-1]) if given or (passed and len(begins) == 1) else None
            at = len(band) - 1 if given else begins[-1]
            held = [c[at:].copy() for c in (band, key, text)]
        several, head = whole & (least < most), (band[begins] & 1).astype(bool)
        kinds = np.where(head, BEGUN, np.where(crowd, CROWD, GROUP))
        taken = several.copy()
        taken[-1] |= given
        mixed = (key.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        names = np.where(crowd, band[begins], np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), begins).astype(np.int64))
        rows = np.repeat(taken, sizes)
        ends = np.flatnonzero(several & crowd & ~head)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((np.repeat(kinds, sizes)[rows], np.full(len(ends), SEVERAL))).astype(np.int32)),
                pa.array(np.concatenate((np.repeat(names, sizes)[rows], band[begins][ends]))),
                pa.array(np.concatenate((key[rows], np.zeros(len(ends), dtype=np.int64))), mask=np.concatenate((np.zeros(rows.sum(), dtype=bool), np.ones(len(ends), dtype=bool)))),
            ],
            names=["kind", "band", "id"],
        )


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def shared_texts(records: DataFrame, keys: DataFrame | None = None) -> Shared:
    """The records (id, source, title, summary) that share a band or their first words with another text; the bands are shuffled once, and the texts."""
    if keys is None:
        keys = scanned(records.select("id", "source", "title", "summary")).where(F.col("kind") == KEYS)
    bands = keys.where("id is not null").select(F.explode("keys").alias("band"), "id", F.col("key").alias("text"))
    block = BLOCK
    found = stored(bands.repartition("band").sortWithinPartitions("band").mapInArrow(lambda batches: _shared(batches, block), "kind int, band bigint, id bigint"))
    own = records.select("id", "source", "title", "summary")
    wanted = found.where(F.col("kind") != SEVERAL).groupBy("id").agg(F.max(F.col("kind") == BEGUN).alias("begun"))
    several = found.where(F.col("kind") == SEVERAL).select("band")
    rows = lambda kind: found.where(F.col("kind") == kind).select("band", "id")
    return Shared(stored(own.join(wanted, "id")), rows(GROUP).distinct(), rows(CROWD).join(several, "band", "left_semi").distinct(), keys.select("id", F.col("key").alias("text"), F.col("e").alias("sketch")))


def cut_copies(records: DataFrame, shared: Shared | None = None) -> DataFrame:
    """(id): records that are the beginning of a longer similar record, of any source.

    Exact: the hash of a record's whole core is looked up among the hashes of
    all beginnings of the others, so no partner is chosen and no group is
    compared pair by pair. First the records that share their first words with
    another text are found, then those that share whole words with a text of
    another length; only these are looked at by characters. A finished sentence
    is a cut only beside a longer copy of its own source.
    """
    shared = shared_texts(records) if shared is None else shared
    own = shared.texts.where("begun and summary is not null and trim(summary) <> ''")
    heads = stored(own.select("id", "title", "summary").mapInPandas(_heads, "key bigint, id bigint, size int"))
    alike = heads.groupBy("key").agg(F.min("size").alias("least"), F.max("size").alias("most")).where("least < most").select("key")
    wanted = heads.join(alike, "key", "left_semi").select("id").distinct()
    cuts = stored(own.select("id", "source", "title", "summary").join(wanted, "id", "left_semi").mapInPandas(_cuts, "key bigint, id bigint"))
    return cuts.where("id is not null").join(cuts.where("id is null").select("key"), "key", "left_semi").select("id").distinct()


def near_words(title: str | None, summary: str | None) -> dict[str, list[str]]:
    """The words of both fields as near-copies are compared, by field."""
    return {"t": without_mark(title or "").lower().split(), "s": without_mark(summary or "").lower().split()}


def _lost(parts: dict[str, list[str]]) -> int:
    return math.ceil((1 - SIMILARITY) * max(sum(map(len, parts.values())) - SHINGLE + 1, 1)) + 1


def _place_keys(parts: dict[str, list[str]]) -> Iterator[tuple[int, str | None, int]]:
    """(key, field, words) of the ends of both fields; without a field, of all places where a similar copy may have been cut.

    A place is known by the three words before it and the first letter of its
    word; at the last word of a text, by the whole beginning of that word that is left.
    """
    lost = _lost(parts)
    for field, words in parts.items():
        size = len(words)
        if size < 2:
            continue
        last, before = words[-1], "\x01".join((field, *words[-4:-1]))
        yield _hash(before, last[0]), field, size
        yield _hash("=", before, last), field, size
        for at in range(max(1, size - 1 - lost), size - 1):
            yield _hash("\x01".join((field, *words[max(0, at - 3) : at])), words[at][0]), None, at + 1
        for stop in range(1, len(last)):
            yield _hash("=", before, last[:stop]), None, size


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, id, field, words): the keys of each record's ends and places."""
    for b in batches:
        found = [(place, key, field, words) for key, title, summary in zip(b["id"], b["title"], b["summary"], strict=True) for place, field, words in _place_keys(near_words(title, summary))]
        yield pd.DataFrame(found, columns=["place", "id", "field", "words"]).astype({"place": "int64", "id": "int64", "words": "int32", "field": object})


@dataclass
class _Text:
    """A text of a group, the (id, source) of the records that have it, and the words that a similar copy may have lost."""

    parts: dict[str, list[str]]
    records: list[tuple[int, int]]
    lost: int

    @cached_property
    def shingles(self) -> set[tuple[str, ...]]:
        return _shingles(self.parts)


def _within(rows: list[tuple]) -> Iterator[tuple[int, str]]:
    """(id, field) of the fields that end early beside another text of the group."""
    texts: dict[tuple, _Text] = {}
    for key, source, title, summary in rows:
        parts = near_words(title, summary)
        text = tuple(map(tuple, parts.values()))
        if text not in texts:
            texts[text] = _Text(parts, [], _lost(parts))
        texts[text].records.append((key, source))
    if len(texts) < 2:
        return
    ends = defaultdict(list)
    for own in texts.values():
        for field, words in own.parts.items():
            if len(words) > 1:
                ends[field, *words[-4:-1]].append((words[-1], len(words), own))
    done = set()
    for other in texts.values():
        for field, words in other.parts.items():
            size = len(words)
            for at in range(max(1, size - 1 - other.lost), size):
                for last, n, one in ends.get((field, *words[max(0, at - 3) : at]), ()):
                    met = words[at]
                    if (met[0] != last[0] if at < size - 1 else len(met) == len(last) or not met.startswith(last)) or one is other or abs(n - at - 1) > (1 - SIMILARITY) * n + 1:
                        continue
                    pair = (id(one), field, id(other))
                    if pair in done:
                        continue
                    done.add(pair)
                    a, z = one.shingles, other.shingles
                    if len(a & z) >= SIMILARITY * len(a | z) and ends_early(one.parts[field], words, field == "t"):
                        complete, sources = finished(" ".join(one.parts[field])), {source for _, source in other.records}
                        yield from ((key, field) for key, source in one.records if not complete or source in sources)


def _cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field) over rows sorted by group, none of which has more than ``BLOCK``."""
    held: list[tuple] = []
    band = None
    for b in batches:
        found: list[tuple[int, str]] = []
        for own, *row in zip(*(b.column(c).to_pylist() for c in ("band", "id", "source", "title", "summary")), strict=True):
            if own != band:
                found += _within(held)
                band, held = own, []
            held.append(tuple(row))
        yield _fields(found)
    yield _fields(list(_within(held)))


def _fields(found: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([f for _, f in found], pa.string())], names=["id", "field"])


def _shingles(parts: dict[str, list[str]]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + SHINGLE]) for words in parts.values() for k in range(len(words) - SHINGLE + 1)}


def ends_early(words: list[str], whole: list[str], title: bool) -> bool:
    """Whether the best alignment of ``words`` ends within ``whole``, at a cut.

    Words are edited at cost 1; the last word must be the word it meets or its
    beginning, after the same word. Between words a headline is cut only if a
    word follows at once: behind a divider stands a label.
    """
    if len(words) < 2:
        return False
    last, row = words[-1], list(range(len(whole) + 1))
    for k, word in enumerate(words[:-1], 1):
        ahead, row[0] = row[0], k
        for at, other in enumerate(whole, 1):
            ahead, row[at] = row[at], min(ahead + (word != other), row[at] + 1, row[at - 1] + 1)
    least = min(row)
    for at in range(1, len(whole)):
        rest = whole[at][len(last) :]
        if row[at] != least or whole[at - 1] != words[-2] or not whole[at].startswith(last):
            continue
        if rest[:1].isalnum() and last[-1:].isalnum() or (not title and _WORD.search(" ".join([rest, *whole[at + 1 :]]))):
            return least <= (1 - SIMILARITY) * len(words)
        if title and not rest and at + 1 < len(whole) and whole[at + 1][0].isalnum():
            return least <= (1 - SIMILARITY) * len(words)
    return False


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, field) of the pairs that are similar and whose first text ends early."""
    for b in batches:
        kept = []
        for field, title, summary, top_title, top_summary, own_source in zip(*(b[c] for c in ("field", "title", "summary", "top_title", "top_summary", "own_source")), strict=True):
            one, other = near_words(title, summary), near_words(top_title, top_summary)
            early = (own_source or not finished(" ".join(one[field]))) and ends_early(one[field], other[field], field == "t")
            if early:
                a, z = _shingles(one), _shingles(other)
                early = len(a & z) >= SIMILARITY * len(a | z)
            kept.append(bool(early))
        yield b.loc[kept, ["id", "field"]]


#: Partners that an end is compared with at once; if none shows it to be cut, others follow.
PARTNERS = 64
#: Minima whose two bits may differ in a pair that is aligned: at similarity 0.8 more differ in 1 of 10,000 pairs.
DIFFERENT = 13


#: Records of a band that are looked at together; a band with more is divided by places.
BLOCK = 256


def near_copies(records: DataFrame, known: DataFrame | None = None, shared: Shared | None = None) -> DataFrame:
    """(id, field): fields whose alignment with a near-copy of the record ends early; ``known`` (id, field) need not be found again.

    Only records that share a band with another text take part. The records of
    a band are looked at together, and once if several bands have the same; an
    end meets only the texts that have its words within: similarity is verified,
    then the words are aligned.
    """
    shared = shared_texts(records) if shared is None else shared
    rows = shared.groups.join(shared.texts, "id").select("band", "id", "source", "title", "summary")
    found = rows.repartition("band").sortWithinPartitions("band").mapInArrow(_cold, "id bigint, field string")
    crowded = stored(shared.crowded)
    if not crowded.isEmpty():
        found = found.unionByName(_crowded(shared.texts.drop("begun"), crowded, shared.sketches))
    found = found.distinct()
    return found if known is None else found.join(known, ["id", "field"], "left_anti")


def _crowded(own: DataFrame, bands: DataFrame, sketches: DataFrame) -> DataFrame:
    """The same for bands (band, id) with more than ``BLOCK`` records.

    The words before the end of a field are looked up among the places of the
    others in the same band. The partners of a band and place lie in buckets of
    about ``PARTNERS``; an end is compared with one bucket, then with four times
    as many, until it is shown to be cut or all are compared, so a group of
    copies is not compared pair by pair, and no partner is left out.
    """
    members = stored(own.join(bands.select("id").distinct(), "id", "left_semi"))
    found = stored(members.select("id", "title", "summary").mapInPandas(_places, "place bigint, id bigint, field string, words int"))
    ends = found.where("field is not null")
    within = found.where("field is null").select("place", F.col("id").alias("top"), F.col("words").alias("top_words"))
    asked = stored(ends.join(within.select("place"), "place", "left_semi").distinct())
    tops = stored(within.join(asked.select("place").distinct(), "place", "left_semi").distinct())
    sketches = stored(sketches.join(asked.select("id").union(tops.select("top")).distinct(), "id", "left_semi").dropDuplicates(["id"]))
    asked = stored(asked.join(bands, "id").join(sketches, "id"))
    tops = tops.join(bands.withColumnRenamed("id", "top"), "top").join(sketches.select(*(F.col(c).alias(f"top_{c}" if c != "id" else "top") for c in ("id", "text", "sketch"))), "top")
    tops = stored(tops.join(asked.select("place", "band").distinct(), ["place", "band"], "left_semi"))
    sizes = tops.groupBy("place", "band").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("buckets"))
    tops = tops.join(sizes, ["place", "band"]).withColumn("bucket", F.pmod(F.xxhash64("top"), F.col("buckets")).cast("int")).drop("buckets")
    waiting = stored(asked.join(sizes, ["place", "band"]))
    texts = members.select(F.col("id").alias("top"), F.col("source").alias("top_source"), F.col("title").alias("top_title"), F.col("summary").alias("top_summary"))
    # what the alignment and the similarity demand of numbers alone
    differ = F.col("sketch").bitwiseXOR(F.col("top_sketch"))
    differ = F.bit_count((differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    near = F.abs(F.col("words") - F.col("top_words")) <= (1 - SIMILARITY) * F.col("words") + 1
    most, begin, step, cases = waiting.agg(F.max("buckets")).first()[0] or 0, 0, 1, None
    while begin < most:
        turns = F.explode(F.sequence(F.lit(begin), F.least(F.lit(begin + step), F.col("buckets")) - 1)).alias("turn")
        looks = waiting.where(F.col("buckets") > begin).select("*", turns).withColumn("bucket", F.pmod(F.xxhash64("id") + F.col("turn"), F.col("buckets")).cast("int"))
        pairs = looks.join(tops, ["place", "band", "bucket"]).where((F.col("text") != F.col("top_text")) & near & (differ <= DIFFERENT)).select("id", "field", "top").distinct()
        both = pairs.join(members, "id").join(texts, "top").withColumn("own_source", F.col("source") == F.col("top_source"))
        early = stored(both.select("id", "field", "title", "summary", "top_title", "top_summary", "own_source").mapInPandas(_aligned, "id bigint, field string").distinct())
        cases = early if cases is None else cases.unionByName(early)
        begin, step = begin + step, 4 * step
        if begin < most:
            waiting = stored(waiting.where(F.col("buckets") > begin).join(early, ["id", "field"], "left_anti"))
            most = waiting.agg(F.max("buckets")).first()[0] or 0
    return found.where("field is not null").select("id", "field").limit(0) if cases is None else cases


#: A closing word must have ended so many unfinished texts, and half of what begins alike, to be an end without a full stop.
UNFINISHED = 5
#: Share of all headlines that a word must end to be an end if it is never seen within one.
FINAL_SHARE = 5e-4
#: A word that is often seen within headlines ends one if it ends so many of its headlines, but for chance.
FINAL_RATE = 0.02


def truncated(records: DataFrame, left_out: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """(id, field_name, source) of the fields that were cut; ``left_out`` has ids that are no cases.

    ``records`` needs id, corporation_id, title, summary and link. With
    ``sites`` (id, name) the ids of ``residue.residue(records, sites)`` are left
    out too; their lines are found in the same pass over the texts.
    """
    own = records if sites is None else records.join(residue.site_names(sites), "corporation_id", "left")
    own = own.select("id", F.coalesce(F.col("corporation_id"), F.lit(-1)).cast("bigint").alias("source"), "title", "summary", "link", *(["site"] if sites is not None else [])).where("id is not null")
    scan = scanned(own, with_lines=sites is not None)
    counts = scan.where(F.col("kind") == COUNTS).groupBy("key").agg(*(F.sum(p).alias(p) for p in PLACES))
    ends = scan.where(F.col("kind") == ENDS).withColumnRenamed("key", "ask")
    open_ends = ends.where("verdict <> 2")
    # fields that ask for the same counts ask once
    asks = open_ends.groupBy("ask").agg(*(F.first(k).alias(k) for k in (*PLACES, "o")))
    asked = asks.select("ask", F.posexplode(F.array(*PLACES, "o")).alias("at", "key")).where("key <> 0").join(counts, "key", "left")
    at = lambda k, p: F.coalesce(F.max(F.when(F.col("at") == k, F.col(p))), F.lit(0)).alias(f"{p}{k}")
    seen = asked.groupBy("ask").agg(*(at(k, p) for k, p in ((0, "e"), (0, "m"), (0, "f"), (1, "e"), (1, "m"), (1, "f"), (2, "n"), (2, "m"), (3, "f"), (4, "m"))))
    total = records.count()
    judged = open_ends.select("id", "source", "field", "size", "verdict", "known", "ask").dropDuplicates(["id", "field"]).join(stored(seen), "ask", "left")
    rare = F.col("f0") < max(2, FINAL_SHARE * total)
    ends_rate = F.col("f0") / F.greatest(F.col("m0") + F.col("f0"), F.lit(1))
    suffix = (F.col("f1") >= FINAL_SHARE * total) & (F.col("f1") >= 2) & (F.col("f1") >= 0.1 * (F.col("m1") + F.col("f1")))
    title_ends = (
        F.when(F.col("known") == -1, (~rare & (ends_rate >= FINAL_RATE)) | suffix)
        .when(F.col("m0") == 0, ~rare | suffix | (F.col("known") == 1) | (F.col("m2") >= 3))
        .otherwise(FINAL_RATE * F.col("m0") - F.col("f0") <= 2 * F.sqrt(FINAL_RATE * F.col("m0")) + 1)
    )
    strict = (F.col("size") == TITLE_LIMIT) | (F.col("verdict") == 3)
    title_ends = title_ends & (~strict | ((ends_rate >= 0.5) & (F.col("f0") >= 3)))
    often = (F.col("e0") >= 3) & (F.col("e0") >= F.col("m0"))
    alike = (F.col("e1") >= F.greatest(F.lit(1), 5e-4 * F.col("n2"))) | ((F.col("f1") >= UNFINISHED) & (F.col("f1") >= 0.5 * F.col("n2")))
    paired = (F.col("f3") >= UNFINISHED) & (F.col("f3") >= 0.5 * F.col("m4"))
    summary_ends = often | alike | paired
    ended = F.when(F.col("field") == "t", title_ends).otherwise(summary_ends)
    judged = stored(judged.select("id", "source", "field", "size", (~ended).alias("cut"), (F.col("field") == "t").alias("title"), ends_rate.alias("rate")))
    sums = judged.groupBy("source", "field", "size").agg(F.sum(F.col("cut").cast("int")).alias("cuts"), F.count("*").alias("all"))
    limits = sums.where((F.col("cuts") >= LIMIT_ROWS) & (F.col("cuts") >= 0.6 * F.col("all"))).select("source", "field", "size").withColumn("limit", F.lit(True))
    by_end = judged.join(limits, ["source", "field", "size"], "left").where("cut or (limit and (not title or rate < 0.05))").select("id", "source", "field")
    shared = shared_texts(own, scan.where(F.col("kind") == KEYS))
    copies = cut_copies(own, shared).select("id", F.lit("s").alias("field")).unionByName(near_copies(own, shared=shared))
    copies = shared.texts.select("id", "source").join(copies, "id").select("id", "source", "field")
    cases = ends.where("verdict = 2").select("id", "source", "field").unionByName(by_end).unionByName(copies).distinct()
    if sites is not None:
        lines = scan.where(F.col("kind") == RESIDUE).select("id", "field", F.col("e").alias("host"), F.col("key").alias("line"), F.col("verdict").alias("kind"), F.col("m").alias("wording"))
        residues = residue.settled(stored(lines), scan.where(F.col("kind") == LINES).select(F.explode("keys").alias("line")))
        left_out = residues if left_out is None else left_out.select("id").unionByName(residues)
    if left_out is not None:
        cases = cases.join(left_out.select("id"), "id", "left_anti")
    return cases.select("id", F.when(F.col("field") == "s", "summary").otherwise("title").alias("field_name"), "source")


def shares(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(corporation_id, texts, cut_texts, cut_share): how often each source's texts are cut."""
    filled = sum((F.length(F.trim(F.coalesce(c, F.lit("")))) > 0).cast("int") for c in (F.col("title"), F.col("summary")))
    texts = records.where("id is not null").dropDuplicates(["id"]).groupBy(F.coalesce(F.col("corporation_id"), F.lit(-1)).cast("bigint").alias("source")).agg(F.sum(filled).alias("texts"))
    cuts = cases.groupBy("source").agg(F.count("*").alias("cut_texts"))
    out = texts.join(cuts, "source", "left").select("source", "texts", F.coalesce("cut_texts", F.lit(0)).alias("cut_texts"))
    return out.select(F.when(F.col("source") != -1, F.col("source")).alias("corporation_id"), "texts", "cut_texts", (F.col("cut_texts") / F.greatest("texts", F.lit(1))).alias("cut_share"))
