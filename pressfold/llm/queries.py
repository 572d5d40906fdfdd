"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm import bpe, cooccur, copies, history, leakage, residue, sentences, subjects, truncation
from pressfold.session import new_folder, stored
from pressfold.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "corporation")
    accepted = history.prepare(table(spark, folder, "article").where("deleted_at is null"), sources)
    incoming = history.prepare(table(spark, folder, "crawled_article"), sources)
    return history.check_batch(incoming, history.History.of(stored(accepted)))


def p1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same, batch after batch against a stored history."""
    sources = table(spark, folder, "corporation")
    accepted = history.prepare(table(spark, folder, "article").where("deleted_at is null"), sources)
    rows = table(spark, folder, "crawled_article")
    numbers = sorted(r[0] for r in rows.select("batch_no").distinct().collect() if r[0] is not None)  # runs of the crawler
    batches = (history.prepare(rows.where(F.col("batch_no") == n), sources) for n in numbers)
    return history.check_batches(batches, history.History.of(stored(accepted)), new_folder(spark))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(table(spark, folder, "article"))


def p2_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapse(table(spark, folder, "article"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = (table(spark, folder, name) for name in ("article", "article_label", "article_tag", "tag"))
    return subjects.subjects_of(*tables, left_out=p4_found(spark, folder))


def p3_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The number of articles about each subject, and their share of all articles."""
    articles = table(spark, folder, "article").count()
    return p3_found(spark, folder).groupBy("subject_id").agg(F.count("*").alias("articles"), (F.count("*") / F.lit(max(articles, 1))).alias("share"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "article"), table(spark, folder, "corporation"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccur.associations(table(spark, folder, "article_tag"), "article_id", "tag_id")
    return cooccur.beyond_chance(pairs).select(F.col("a").alias("tag_id_a"), F.col("b").alias("tag_id_b"))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccur.associations(table(spark, folder, "article_tag"), "article_id", "tag_id")
    return pairs.select(F.col("a").alias("tag_id_a"), F.col("b").alias("tag_id_b"), "n_a", "n_b", "n_ab", "n_records", F.round("odds_ratio", 3).alias("odds_ratio"))


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "article"), sites=table(spark, folder, "corporation"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).select("id", "field_name")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.shares(_cut(spark, folder), table(spark, folder, "article"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents it leaked into, and of those that hold its answer too."""
    items = table(spark, folder, "eval_item")
    hits = leakage.hits(table(spark, folder, "documents"), items).groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("with_answer").alias("m"))
    zero = F.lit(0)
    return items.select("item_id", "suite").distinct().join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n", zero).alias("documents"), F.coalesce("m", zero).alias("with_answer"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_batches, p2_found, p2_copy_counts, p3_found, p3_composition, p4_found, p6_found, p6_pairs, p7_found, p7_shares, p8_ids, p9_found, p9_items, p10_found)
}

_KEYED = r"""
WITH cut AS (
  SELECT id, title, regexp_replace(link, '#.*$', '', 's') AS bare, regexp_extract(link, '#(.*)$', 1, 's') AS anchor
  FROM article WHERE id IS NOT NULL
), keyed AS (
  SELECT id, CASE WHEN title IS NULL OR bare IS NULL THEN 'id ' || id ELSE
    lower(regexp_replace(title, '[^\p{L}\p{N}]+', '', 'g')) || chr(2) ||
    lower(regexp_replace(split_part(bare, '?', 1) || anchor, '[^\p{L}\p{N}]+', '', 'g')) || chr(1) ||
    array_to_string(list_sort([y FOR y IN [lower(regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g'))
      FOR x IN string_split(regexp_extract(bare, '\?(.*)$', 1, 's'), '&')] IF y <> '']), chr(1)) END AS key
  FROM cut
)
"""
_PAIRS = """
WITH live AS (
  SELECT DISTINCT article_id, tag_id FROM article_tag
  WHERE deleted_at IS NULL AND article_id IS NOT NULL AND tag_id IS NOT NULL
), single AS (SELECT tag_id, count(*) AS n FROM live GROUP BY tag_id
), pair AS (
  SELECT x.tag_id AS a, y.tag_id AS b, count(*) AS n_ab
  FROM live x JOIN live y ON x.article_id = y.article_id AND x.tag_id < y.tag_id GROUP BY 1, 2
), stats AS (
  SELECT a AS tag_id_a, b AS tag_id_b, p.n AS n_a, q.n AS n_b, n_ab, (SELECT count(DISTINCT article_id) FROM live) AS n_records
  FROM pair JOIN single p ON p.tag_id = a JOIN single q ON q.tag_id = b
)
"""
_LEAKED = r"""
WITH docs AS (
  SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS d FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), items AS (
  SELECT item_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t, lower(regexp_replace(answer, '[^\p{L}\p{N}]+', '', 'g')) AS a FROM eval_item WHERE item_id IS NOT NULL
), halves AS (
  SELECT item_id, a, substr(t, k, (length(t) + 1) // 2) AS half FROM (SELECT *, unnest(range(1, length(t) // 2 + 2)) AS k FROM items WHERE length(t) > 0)
), hits AS (
  SELECT doc_id, item_id, bool_or(a <> '' AND contains(d, a)) AS with_answer FROM docs JOIN halves ON contains(d, half) GROUP BY ALL
)
"""
SQL: dict[str, str] = {
    "p2_found": _KEYED + "SELECT first_id, id AS dup_id FROM (SELECT id, min(id) OVER (PARTITION BY key) AS first_id FROM keyed) WHERE id <> first_id",
    "p2_copy_counts": _KEYED + "SELECT min(id) AS first_id, count(*) AS copies FROM keyed GROUP BY key",
    "p9_found": _LEAKED + "SELECT doc_id, item_id FROM hits",
    "p9_items": _LEAKED
    + """SELECT i.item_id, i.suite, count(h.doc_id) AS documents, count(*) FILTER (h.with_answer) AS with_answer
    FROM (SELECT DISTINCT item_id, suite FROM eval_item) i LEFT JOIN hits h ON h.item_id = i.item_id GROUP BY ALL""",
    "p6_found": _PAIRS + "SELECT tag_id_a, tag_id_b FROM stats WHERE n_ab >= 5 AND n_ab::HUGEINT * n_records >= 3 * n_a::HUGEINT * n_b",
    "p6_pairs": _PAIRS
    + """SELECT tag_id_a, tag_id_b, n_a, n_b, n_ab, n_records,
    round((n_ab + 0.5::DOUBLE) * (n_records - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 3) AS odds_ratio FROM stats""",
}
