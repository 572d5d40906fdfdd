"""Sentences of documents in many languages and scripts, as positions in code points.

A text is divided by blank lines into paragraphs, these into headings, list
items and running text. In running text every mark that may end a sentence is
a candidate, unless it lies inside a quotation or bracket that goes on. A
maximum-entropy model decides on each candidate from the tokens around it,
their case, length, digits and script, and the gap between them. Spaces in Thai
are boundaries by definition, and so are full-width marks before plain text.

The model is fitted on boundaries that are certain from layout: the last mark
of a paragraph, before the first word of the next one, is a boundary; a mark
before a small letter, inside a number, after a word that never ends a
paragraph or before one that never starts one is none. The fit uses the
documents of a bounded sample: the ``TRAIN_DOCUMENTS`` that come first by a
hash of their id, but for texts over ``TRAIN_BYTES``; every text is then
divided by the same model. Wide marks before plain text, spaces in Thai and
marks inside numbers, names and addresses are decided by rule; the model decides
on all other candidates.

Defined results: null, empty and blank texts have no rows; white space around a
unit is left out; of rows that repeat a document's id one counts; one
paragraph may be as long as its document; unmatched quotes and brackets are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.session import once

#: Documents that the model is fitted on, at most, and the bytes of the longest.
TRAIN_DOCUMENTS, TRAIN_BYTES = 8000, 1 << 14
#: A word counts as never ending or starting a paragraph if it had this many chances.
CHANCES = 20

# Marks of the scripts.
ENDS = ".!?…。！？．｡।॥؟۔‼⁇⁈⁉"
WIDE_ENDS = set("。！？．｡")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "„": "“", "‘": "’", "«": "»", "‹": "›"}
CLOSERS = set(PAIRS.values()) - {"“"} | {"'", '"'}
NO_START = set(",;:，、；：､،؛)]}）］」』》〉】”’»›%-–—~")

_PARAGRAPH = re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|$))+")
_ITEM = re.compile(r"[^\S\n]*(?:[-*+•·‣▪–](?=[^\S\n])|\d{1,3}[.)](?=[^\S\n]))[^\S\n]+\S")
_BULLET = re.compile(r"[^\S\n]*[-*+•·‣▪–](?=[^\S\n])")
_HEADING = re.compile(r"[^\S\n]{0,3}#{1,6}[^\S\n]")
_MARKS = re.compile(rf"[{re.escape(ENDS)}]+")
_BRACKETS = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]")
_THAI_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_DIGITS = re.compile(r"\d")
_UNSPACED = re.compile(r"(?<=[^\W_A-Z])[.!?](?=[^\W\d_])(?![a-z])")


@lru_cache(maxsize=65536)
def _script(char: str) -> str:
    """A letter for the kind of a character."""
    code = ord(char)
    if char.isdigit():
        return "9"
    if code < 0x250:
        return "a" if char.islower() else "A" if char.isupper() else "_" if char.isspace() else "p"
    for low, high, kind in (
        (0xAC00, 0xD7A3, "k"), (0x3040, 0x30FF, "j"), (0x3400, 0x9FFF, "h"), (0x0E00, 0x0E7F, "t"),
        (0x0900, 0x097F, "d"), (0x0600, 0x06FF, "r"), (0x1F000, 0x1FAFF, "e"),
    ):
        if low <= code <= high:
            return kind
    return "a" if char.islower() else "A" if char.isupper() else "l" if char.isalpha() else "p"


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a paragraph."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _BRACKETS.finditer(text, start, end):
        c, at = m.group(), m.start()
        closing = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
        if closing is not None:
            found.append((stack[closing][1], at))
            del stack[closing:]
        elif c == '"':
            stack.append(('"', at))
        elif c in PAIRS:
            stack.append((PAIRS[c], at))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _token_before(text: str, start: int, at: int) -> tuple[str, bool]:
    """The token that ends at ``at``, digits as 9, and whether the token before it also ends in a full stop."""
    own = text[max(start, at - 24) : at]
    own = own.rsplit(None, 1)[-1] if own and not own[-1].isspace() else ""
    k = at - len(own)
    own = own.lstrip("([{\"'“‘„«「『（《")
    if not own and k > start:  # an emoji or a mark stands alone
        own = text[max(start, k - 8) : k].strip()
    own = _UNSPACED.split(own)[-1]
    dotted = k - 2 >= start and text[k - 1].isspace() and text[k - 2] == "."
    own = _DIGITS.sub("9", own[-14:])
    if own and _script(own[-1]) in "hjt":
        own = own[-2:]
    return own, dotted


def _token_after(text: str, at: int, end: int) -> str:
    own = text[at : min(end, at + 14)]
    own = _DIGITS.sub("9", own.split(None, 1)[0]) if own and not own[0].isspace() else ""
    bare = own.lstrip("([{\"'“‘„«「『（《")
    if bare and _script(bare[0]) in "hj":
        return own[: len(own) - len(bare) + 2]
    return own.rstrip(",.;:!?\"'”’)")


def _features(mark: str, closer: str, gap: str, before: str, dotted: bool, after: str) -> tuple[str, ...]:
    bare = after.lstrip("([{\"'“‘„«「『（《")
    p = _script(before[-1]) if before else "_"
    first = _script(bare[0]) if bare else "_"
    n = ("q" if bare != after else "") + first
    length = min(len(before), 4) if p in "aA" else 0
    case = "T" if before[:1].isupper() and before[1:].islower() else "U" if before.isupper() else "."
    inner = "." in before
    m = mark if len(mark) == 1 else mark[0] + "+"
    return (
        f"m{m}{gap}", f"c{closer}{gap}{n}", f"P{before}", f"N{bare}", f"p{p}{gap}", f"n{n}{gap}{m}", f"pn{p}{gap}{n}",
        f"l{p}{length}{case}{gap}{n}", f"i{inner}{p}{n}", f"d{dotted}{p}{n}", f"C{bool(closer)}N{bare}", f"S{n}{gap}{bare[-3:]}",
    )


Candidate = tuple[int, tuple[str, str, str, str, bool, str]]


def _candidates(text: str, start: int, end: int, thai: bool) -> Iterator[Candidate]:
    """(position after the mark and its closers, context) of the marks in running text; context None is a certain boundary."""
    spans = _spans(text, start, end)
    s = 0
    for m in _MARKS.finditer(text, start, end):
        at, stop = m.start(), m.end()
        while s < len(spans) and spans[s][1] < at:
            s += 1
        inside = s < len(spans) and spans[s][0] < at < spans[s][1]
        k = stop
        while k < end and text[k] in CLOSERS and (text[k] not in "\"'" or any(b == k for _, b in spans[s : s + 2])):
            k += 1
        if inside and k <= spans[s][1]:
            continue  # the quotation goes on
        after = k
        while after < end and text[after].isspace():
            after += 1
        if after >= end:
            continue  # the end of the paragraph is one anyway
        if text[after] in NO_START or text[after] in ENDS:
            continue
        gap = "" if after == k else " "
        before, dotted = _token_before(text, start, at)
        yield k, (m.group(), text[stop:k][:2], gap, before, dotted, _token_after(text, after, end))
    if thai:
        for m in _THAI_GAP.finditer(text, start, end):
            run, at = m.start(), m.end()
            kinds = {_script(c) for c in text[max(start, run - 30) : run].split()[-1]}
            plain = not any(_script(c) in "tkhjdraA9l" for c in text[at : at + 12].split()[0])
            if "t" in kinds and not plain:
                yield run, None
            elif not kinds & set("tkhjdraA9l") and "t" in {_script(c) for c in "".join(text[max(start, run - 40) : run].split()[-2:-1])}:
                yield run, None


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is running text) of the parts of a text that no sentence crosses."""
    for p in _PARAGRAPH.finditer(text):
        lines, at = [], p.start()
        for line in p.group().splitlines(keepends=True) if "\r" not in p.group() else re.findall(r"[^\n]*\n|[^\n]+$", p.group()):
            lines.append((at, at + len(line)))
            at += len(line)
        start, kind, closed = p.start(), "text", True
        for a, b in lines:
            line = text[a:b]
            ended = text[start:a].rstrip()[-1:] in ENDS + ":：" or a == start
            item = _ITEM.match(line) and (a == p.start() or kind == "item" or (_BULLET.match(line) and ended))
            heading = _HEADING.match(line)
            if (item or heading or closed) and a > start:
                yield start, a, kind == "text"
                start = a
            closed = False
            if item or heading:
                kind = "item" if item else "heading"
                closed = bool(heading)
            elif start == a:
                kind = "text"
        yield start, p.end(), kind == "text"


class Model:
    """Weights of the features; a candidate is a boundary if their sum is positive. Decisions are kept for contexts that come again."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.decided: dict[tuple, bool] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "decided": {}}

    def score(self, context: tuple) -> float:
        get = self.weights.get
        return get("bias", 0.0) + sum(get(f, 0.0) for f in _features(*context))

    def boundary(self, context: tuple | None) -> bool:
        if context is None:
            return True
        known = self.decided.get(context)
        if known is None:
            if len(self.decided) >= 1 << 18:
                self.decided.clear()
            known = self.decided[context] = self._decide(context)
        return known

    def _decide(self, context: tuple) -> bool:
        mark, closer, gap, before, _, after = context
        if mark[-1] in WIDE_ENDS and not closer:
            return True
        if not gap and (before[-1:].isascii() and after[:1].isascii() and (after[:1].islower() or after[:1].isdigit())):
            return False  # inside a number, a name or an address
        return self.score(context) > 0


_THAI = re.compile("[฀-๿]")


def divide(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    thai = bool(_THAI.search(text))
    for start, end, running in _blocks(text):
        cuts = sorted({k for k, context in _candidates(text, start, end, thai) if model.boundary(context)}) if running else []
        for a, b in zip([start, *cuts], [*cuts, end], strict=True):
            own = text[a:b]
            left = a + len(own) - len(own.lstrip())
            right = b - len(own) + len(own.rstrip())
            if left < right:
                out.append((left, right))
    return out


#: Weights before any text is seen: after a mark and a space a small letter or digit goes on, other letters begin.
PRIOR = {f"n{quote}{first} {mark}": (-1.5 if first in "a9" else 1.5) for quote in ("", "q") for first in "aA9khjdrl" for mark in ENDS}


def _labelled(texts: list[str]) -> tuple[list[tuple], list[bool]]:
    """Contexts whose label is certain, from layout and from how words are placed in the sample."""
    seen: list[tuple] = []
    last, any_last, first, any_first = Counter(), Counter(), Counter(), Counter()
    first_tail, any_tail = Counter(), Counter()
    finals: list[tuple] = []
    for text in texts:
        open_end: tuple | None = None
        for start, end, running in _blocks(text):
            if not running:
                open_end = None
                continue
            own = text[start:end].rstrip()
            stop = start + len(own)
            head = start + len(own) - len(own.lstrip())
            token = _token_after(text, head, stop)
            first[token] += 1
            any_first[token] += 1
            first_tail[token[-3:]] += 1
            if open_end:
                finals.append((*open_end, token))
            for _, context in _candidates(text, start, stop, False):
                seen.append(context)
                if context[2]:
                    any_last[context[0][0], context[3]] += 1
                any_first[context[5]] += 1
                any_tail[context[5][-3:]] += 1
            k = stop
            while k > head and text[k - 1] in CLOSERS:
                k -= 1
            m = k
            while m > head and text[m - 1] in ENDS:
                m -= 1
            open_end = None
            if m < k:
                before, dotted = _token_before(text, start, m)
                last[text[m], before] += 1
                any_last[text[m], before] += 1
                open_end = (text[m:k], text[k:stop][:2], " ", before, dotted)
    contexts, labels = list(finals), [True] * len(finals)
    for context in seen:
        mark, _, gap, before, _, after = context
        bare = after.lstrip("([{\"'“‘„«「『（《")
        never_last = any_last[mark[0], before] >= CHANCES and not last[mark[0], before]
        never_first = any_first[after] >= CHANCES and not first[after]
        inner = not gap and before[-1:].isalnum() and bare[:1].isascii() and (bare[:1].islower() or bare[:1].isdigit())
        small = gap and after[:1].islower() and first_tail[after[-3:]] <= 0.05 * any_tail[after[-3:]]
        if inner or never_last or never_first or small:
            contexts.append(context)
            labels.append(False)
        elif last[mark[0], before] >= 3 and first[after] >= 3:
            contexts.append(context)
            labels.append(True)
    return contexts, labels


def fit(texts: list[str], rounds: int = 8, least: int = 3) -> Model:
    """Fit the weights by gradient ascent on the likelihood of the certain boundaries."""
    contexts, labels = _labelled(texts)
    rows = [_features(*c) for c in contexts]
    counts = Counter(f for row in rows for f in row)
    names = {f: k for k, f in enumerate(f for f, n in sorted(counts.items()) if n >= least)}
    bias = len(names)
    width = 1 + max((len(r) for r in rows), default=0)
    matrix = np.full((len(rows), width), bias + 1, dtype=np.int64)  # the last place is a feature without weight
    for k, row in enumerate(rows):
        own = [names[f] for f in row if f in names]
        matrix[k, : len(own)] = own
        matrix[k, width - 1] = bias
    target = np.array(labels, dtype=np.float64)
    weights, squares = np.zeros(bias + 2), np.full(bias + 2, 1e-6)
    for f, k in names.items():
        weights[k] = PRIOR.get(f, 0.0)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 1024)):
            if not len(batch):
                continue
            at = matrix[batch]
            error = target[batch] - 1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1), -30, 30)))
            slope = np.bincount(at.ravel(), np.repeat(error, width), minlength=bias + 2) - 1e-3 * weights
            slope[bias + 1] = 0
            squares += slope**2
            weights += 0.3 * slope / np.sqrt(squares)
            weights[bias + 1] = 0
    return Model(PRIOR | {f: float(weights[k]) for f, k in names.items()} | {"bias": float(weights[bias])})


def sample(documents: DataFrame, bound: int = TRAIN_DOCUMENTS, *, text: str = "text", most: int = TRAIN_BYTES) -> list[str]:
    """The distinct texts of at most ``bound`` documents, the first by a hash of their id, none of more than ``most`` bytes."""
    own = documents.select("doc_id", F.col(text).alias("t")).where("doc_id is not null and t is not null").where(F.octet_length("t") <= most)
    first = own.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(bound)
    return sorted({r.t for r in first.collect()})


def _divider(held):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t")), strict=True):
                found = divide(t, model)
                ids += [doc] * len(found)
                starts += [a for a, _ in found]
                ends += [e for _, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, ends)], names=["doc_id", "start_char", "end_char"])

    return run


def sentences(documents: DataFrame, *, text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence; of rows that repeat a doc_id one counts."""
    model = model or fit(sample(documents, text=text))
    held = documents.sparkSession.sparkContext.broadcast(model)
    own = documents.select("doc_id", F.col(text).alias("t")).where("doc_id is not null and t is not null and t <> ''")
    return once(own, "doc_id").mapInArrow(_divider(held), "doc_id bigint, start_char bigint, end_char bigint")
