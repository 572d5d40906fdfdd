"""Subject areas of articles from a factorised document-term matrix.

The matrix of articles and terms (words and pairs of neighbouring words of
title and summary) is factored into non-negative mixtures and components by
alternating multiplicative updates, until the mixtures fit the labelled articles
no better or the components change no more. A component is anchored to each subject: it
starts from the terms that labelled articles of the subject have in excess, and
a term that they show for other subjects only keeps the weight zero; one more
component takes what all texts share. An article's mixture then directly gives
its subjects; how large a share counts is set on the labelled articles.

Sentences of comparison do not count. If title and summary say nothing of any
subject, the live tags decide: a tag speaks for the subject that most articles
with it are about, and two tags must agree.

Seeds come from articles with one label. The labelled rows used for the seeds and the threshold are bounded by
``LABELLED``; term counts, updates and mixtures cover all articles. The
components are held by every worker: a term must occur in ``TERM_SHARE`` of the
articles, so there are at most (terms of an article) / ``TERM_SHARE`` terms.

Defined results: a null title or summary counts as empty; articles without an
id are left out; labelled articles have their labels; without labels there is
no component, so no article has a subject; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.session import once, stored

LABELLED = 20_000
TERM_SHARE, TERM_ROWS = 1e-4, 4
#: A term is a seed of a subject if so much of its rate is there, and so many deviations more than by chance;
#: a term with at most ``UNKNOWN`` labelled articles may join any component.
PURITY, CHANCE, UNKNOWN = 0.9, 3.0, 2
#: A text says nothing of a subject if it says less than this part of what labelled articles usually do.
QUIET = 0.003
#: Most passes over the articles that update the components, the change below which they have converged, and updates of a mixture in a pass.
PASSES, CONVERGED, UPDATES = 8, 0.02, 12
#: Share of a tag's articles that must be about a subject for the tag to speak for it.
TAG_SHARE, TAGS_NEEDED = 0.55, 2

# Constructions of comparison, English and Korean.
_COMPARISON = re.compile(
    r"\b(?:feels?|felt|looks?|looked|sounds?|sounded|seems?|seemed|behaves?|behaved|is|was|are|were|be|being|much|rather|just|almost|bit|little|lot) like (?:an?|the|when|how)?\b|\b(?:felt|feels?) (?:an? (?:bit|little|lot) )?like\b"
    r"|\b(?:think|thought|thinking) of (?:it|this|that|them|these|those) as\b|\bas (?:if|though)\b|\bremind(?:s|ed|ing)? (?:me|us|you|one|everyone) of\b|\b(?:not unlike|akin to|analogous to|reminiscent of|comparable to)\b"
    r"|\b(?:by|an?|the) (?:analogy|metaphor)\b|\bin the same way (?:as|that)\b"
    r"|(?:^|\s)(?:마치|흡사|비유하자면|비유하면|비하자면|이를테면)(?:\s|$)|준비하듯|하듯이? |듯이 차근차근|에 빗대|에 비유",
    re.IGNORECASE,
)
#: One of these stands in every comparison.
_HINTS = ("like", "think of", "thought of", "thinking of", "as if", "as though", "remind", "akin", "analog", "reminisc", "compar", "metaphor", "same way", "마치", "흡사", "비유", "비하자", "이를테면", "듯", "빗대")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+")
_LEFT, _RIGHT = np.int64(-7046029254386353131), np.int64(-2967338243228374957)
# Particles that may follow a Korean noun.
_PARTICLE = re.compile(r"(?<=[가-힣])(?:에서|부터|까지|으로|처럼|보다|에게|만큼은|은|는|이|가|을|를|의|와|과|도|로|에)$")


class _Stems(dict):
    """The hash of each word a worker has met, a Korean noun without its particle."""

    def __missing__(self, word: str) -> int:
        stem = _PARTICLE.sub("", word) if word[0] >= "가" else word
        found = self[word] = (xxhash.xxh3_64_intdigest(stem.encode("utf-8", "surrogatepass")) - (1 << 63)) or 1
        return found


def _parts(title: str | None, summary: str | None) -> list[str]:
    """The sentences of an article without its comparisons."""
    parts = [title] if title else []
    if summary:
        parts += _SENTENCE.split(summary)
    low = f"{title}\n{summary}".lower()
    for hint in _HINTS:
        if hint in low:
            return [p for p in parts if not _COMPARISON.search(p)]
    return parts


def terms_of(titles: list[str | None], summaries: list[str | None], stems: _Stems) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and pairs of neighbouring words of each article, in one array, and where each article's begin."""
    flat: list[int] = []
    sizes = []
    for title, summary in zip(titles, summaries, strict=True):
        before = len(flat)
        for part in _parts(title, summary):
            flat += [stems[w] for w in _WORD.findall(part.lower())]
            flat.append(0)
        sizes.append(len(flat) - before)
    words, owner = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
    joined = (words[:-1] != 0) & (words[1:] != 0) & (owner[:-1] == owner[1:])
    pairs = (words[:-1] * _LEFT ^ words[1:] * _RIGHT)[joined]
    terms = np.concatenate((words[words != 0], pairs))
    owner = np.concatenate((owner[words != 0], owner[:-1][joined]))
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    return terms[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1)).astype(np.int32)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stems = _Stems()
    for batch in batches:
        if len(stems) > 1 << 20:
            stems.clear()
        terms, offsets = terms_of(batch.column("title").to_pylist(), batch.column("summary").to_pylist(), stems)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "terms"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a batch in one array, and where each article's begin."""
    column = batch.column("terms")
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


_COUNTS = pa.schema([("term", pa.int64()), ("subject", pa.int32()), ("n", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, subject, n): partial counts; subject -1 counts all articles."""
    for batch in batches:
        flat, offsets = _flat(batch)
        subjects = batch.column("subject").to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(subjects, np.diff(offsets))
        for subject in np.unique(owner) if len(owner) else ():
            terms, n = np.unique(flat[owner == subject], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), subject, dtype=np.int32)), pa.array(n)], schema=_COUNTS)


class Model:
    """Terms in sorted order, their weights, and the components: subjects first, the shared one last."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, components: np.ndarray) -> None:
        self.terms, self.weights, self.components = terms, weights, components

    def place(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the known terms, and the article of each."""
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        known = self.terms[at] == flat
        return at[known], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[known]

    def mixtures(self, columns: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """Non-negative mixtures of the articles with the components held fixed."""
        h = self.components
        gram = h @ h.T
        target = np.zeros((rows, len(h)))
        if len(columns):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            target[owner[starts]] = np.add.reduceat((h[:, columns] * self.weights[columns]).T, starts, axis=0)
        mix = np.maximum(target, 1e-9) / np.maximum(np.diag(gram), 1e-9)
        for _ in range(UPDATES):
            mix *= target / np.maximum(mix @ gram, 1e-12)
        return mix

    def shares(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each subject in what an article says of subjects, and how much that is."""
        mass = mix[:, :-1] * np.sqrt((self.components[:-1] ** 2).sum(axis=1))
        total = mass.sum(axis=1)
        return mass / np.maximum(total, 1e-12)[:, None], total


def _seed(counts: pd.DataFrame, subjects: list[int], total: int) -> Model:
    """Components from the labelled articles' excess of terms."""
    every = counts[counts["subject"] == -1]
    terms = np.sort(every["term"].to_numpy())
    n = np.zeros(len(terms))
    n[np.searchsorted(terms, every["term"].to_numpy())] = every["n"]
    usual = n / max(total, 1)
    found, sizes = np.zeros((len(subjects), len(terms))), np.ones(len(subjects))
    for k, subject in enumerate(subjects):
        own = counts[counts["subject"] == subject]
        at = np.searchsorted(terms, own["term"].to_numpy())
        found[k, at] = own["n"]
        sizes[k] = max(own["articles"].max(), 1) if len(own) else 1
    rate = found / sizes[:, None]
    purity = rate / np.maximum(rate.sum(axis=0), 1e-12)
    expected = sizes[:, None] * usual
    unlikely = found - expected > CHANCE * np.sqrt(expected) + 1
    components = np.zeros((len(subjects) + 1, len(terms)))
    components[:-1] = np.where((purity >= PURITY) & unlikely, (rate - usual) * purity, 0.0)
    components[:-1, found.sum(axis=0) <= UNKNOWN] += 1e-4
    components[-1] = np.maximum(usual, 1e-6)
    weights = np.log1p(total / np.maximum(n, 1))
    components *= weights
    components /= np.maximum(np.sqrt((components**2).sum(axis=1, keepdims=True)), 1e-12)
    return Model(terms, weights, components)


def _updater(held, size: int):  # noqa: ANN001, ANN202
    """A task's share of the sums that update the components: a row for each term it has seen, place -1 - k for the mixtures' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        products = np.zeros((len(model.components), len(model.terms)))
        gram = np.zeros((size, size))
        for batch in batches:
            flat, offsets = _flat(batch)
            columns, owner = model.place(flat, offsets)
            mix = model.mixtures(columns, owner, len(offsets) - 1)
            gram += mix.T @ mix
            for k in range(size):
                products[k] += np.bincount(columns, mix[owner, k] * model.weights[columns], minlength=len(model.terms))
        seen = np.flatnonzero(products.any(axis=0))
        place = np.concatenate((np.arange(size) - size, seen))
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(np.concatenate((gram[k], products[k, seen]))) for k in range(size))], names=["place", *(f"c{k}" for k in range(size))])

    return run


def factor(articles: DataFrame, model: Model, fitness: Callable[[Model], float] | None = None) -> Model:
    """Update the components over all articles; every pass is one job whose sums have a row for each term.

    Passes end when ``fitness`` falls, and the model before is kept, or when the
    components change by less than ``CONVERGED`` of their length.
    """
    size = len(model.components)
    schema = "place bigint, " + ", ".join(f"c{k} double" for k in range(size))
    best = fitness(model) if fitness else 0.0
    for step in range(PASSES):
        held = articles.sparkSession.sparkContext.broadcast(model)
        sums = articles.select("terms").mapInArrow(_updater(held, size), schema).groupBy("place").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(size)))
        table = sums.toPandas()  # at most a row for each term of the model
        held.destroy()
        at, values = table["place"].to_numpy(), table[[f"c{k}" for k in range(size)]].to_numpy()
        gram, products = np.zeros((size, size)), np.zeros((size, len(model.terms)))
        gram[at[at < 0] + size] = values[at < 0]
        products[:, at[at >= 0]] = values[at >= 0].T
        h = model.components * products / np.maximum(gram @ model.components, 1e-12)
        h /= np.maximum(np.sqrt((h**2).sum(axis=1, keepdims=True)), 1e-12)
        change = np.linalg.norm(h - model.components) / max(np.linalg.norm(model.components), 1e-12)
        after = Model(model.terms, model.weights, h)
        fits = fitness(after) if fitness else 1.0
        if fits < best and step > 0:
            break
        model, best = after, fits
        if change < CONVERGED:
            break
    return model


def _best_threshold(shares: np.ndarray, mass: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """The share that fits the labelled articles best, the least that a text must say, and how well they fit."""
    floor = float(QUIET * np.median(mass)) if len(mass) else 0.0
    best = (-1.0, 0.2)
    for share in np.arange(0.01, 0.4, 0.005):
        said = (shares >= share) & (mass >= floor)[:, None]
        f = 2 * (said & truth).sum() / max(said.sum() + truth.sum(), 1)
        if f > best[0] + 1e-9:
            best = (f, float(share))
    return best[1], floor, best[0]


def _judged(held, subjects: list[int]):  # noqa: ANN001, ANN202
    ids = np.array(subjects, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            flat, offsets = _flat(batch)
            columns, owner = model.place(flat, offsets)
            shares, mass = model.shares(model.mixtures(columns, owner, len(offsets) - 1))
            row, k = np.nonzero(shares >= 0.01)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("id").to_numpy(zero_copy_only=False)[row]), pa.array(ids[k]), pa.array(shares[row, k]), pa.array(mass[row])], names=["id", "subject", "share", "mass"]
            )

    return run


def subjects_of(articles: DataFrame, labels: DataFrame, article_tags: DataFrame, tags: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """(article_id, subject_id) of the subjects of each article; ``left_out`` has ids that have none."""
    own = articles.select("id", "title", "summary").where("id is not null")
    terms = stored(once(own, "id").mapInArrow(_terms, "id bigint, terms array<bigint>"))
    known = labels.select(F.col("article_id").alias("id"), F.col("subject_id").cast("int").alias("subject")).dropna().distinct()
    names = sorted(r[0] for r in known.select("subject").distinct().collect())  # subjects, a dozen or so
    out_schema = "article_id bigint, subject_id int"
    if not names:
        return terms.sparkSession.createDataFrame([], out_schema)
    total, labelled = terms.count(), known.count()
    share = max(1, -(-labelled // LABELLED))
    used = known.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    with_labels = stored(terms.join(used, "id"))
    schema = "term bigint, subject int, n bigint"
    everything = terms.select("terms", F.lit(-1).alias("subject")).mapInArrow(_count_terms, schema)
    often = everything.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(TERM_ROWS, total * TERM_SHARE))
    often = stored(often.withColumn("subject", F.lit(-1)))
    single = with_labels.join(with_labels.groupBy("id").count().where("count = 1").select("id"), "id", "left_semi")
    by_subject = single.select("terms", "subject").mapInArrow(_count_terms, schema).groupBy("term", "subject").agg(F.sum("n").alias("n")).join(often.select("term"), "term", "left_semi")
    counts = often.select("term", "subject", "n").unionByName(by_subject.select("term", "subject", "n")).toPandas()
    sizes = single.groupBy("subject").count().toPandas().set_index("subject")["count"]
    counts["articles"] = counts["subject"].map(sizes).fillna(total)
    scored = "id bigint, subject int, share double, mass double"
    trial = with_labels.groupBy("id").agg(F.first("terms").alias("terms"), F.collect_set("subject").alias("truth")).toPandas()
    model = factor(terms, _seed(counts, names, total), lambda m: _best_threshold(*_score(m, trial, names))[2])
    least_share, least_mass, _ = _best_threshold(*_score(model, trial, names))
    held = terms.sparkSession.sparkContext.broadcast(model)
    spoken = stored(terms.mapInArrow(_judged(held, names), scored))
    said = spoken.where((F.col("share") >= least_share) & (F.col("mass") >= least_mass)).select("id", "subject")
    by_tags = _tag_subjects(said, terms.select("id"), article_tags, tags)
    found = said.unionByName(by_tags).join(known.select("id").distinct(), "id", "left_anti").unionByName(known.join(terms.select("id"), "id", "left_semi").select("id", "subject"))
    if left_out is not None:
        found = found.join(left_out.select("id"), "id", "left_anti")
    return found.distinct().select(F.col("id").alias("article_id"), F.col("subject").alias("subject_id"))


def _score(model: Model, trial: pd.DataFrame, names: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in trial["terms"]]))).astype(np.int64)
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in trial["terms"]]) if len(trial) else np.zeros(0, dtype=np.int64)
    columns, owner = model.place(flat, offsets)
    shares, mass = model.shares(model.mixtures(columns, owner, len(trial)))
    truth = np.array([[s in set(t) for s in names] for t in trial["truth"]], dtype=bool).reshape(len(trial), len(names))
    return shares, mass, truth


def _tag_subjects(said: DataFrame, ids: DataFrame, article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, subject) by the live tags of the articles whose text says nothing."""
    live_tags = tags.where("deleted_at is null").select(F.col("id").alias("tag")).dropna().distinct()
    live = article_tags.where("deleted_at is null").select(F.col("article_id").alias("id"), F.col("tag_id").alias("tag")).dropna().distinct().join(live_tags, "tag")
    about = live.join(said.groupBy("id").agg(F.collect_set("subject").alias("subjects")), "id", "left")
    about = stored(about.join(ids, "id", "left_semi").select("id", "tag", "subjects"))
    told = about.where("subjects is not null")
    sizes = told.groupBy("tag").agg(F.count("*").alias("articles"))
    votes = told.select("tag", F.explode("subjects").alias("subject")).groupBy("tag", "subject").agg(F.count("*").alias("n")).join(sizes, "tag")
    speaks = votes.where((F.col("n") >= TAG_SHARE * F.col("articles")) & (F.col("n") >= 3)).select("tag", "subject")
    silent = about.where("subjects is null").select("id", "tag").join(speaks, "tag")
    return silent.groupBy("id", "subject").agg(F.count_distinct("tag").alias("n")).where(F.col("n") >= TAGS_NEEDED).select("id", "subject")
