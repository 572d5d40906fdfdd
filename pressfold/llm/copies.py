"""Records that differ only in formatting, collapsed into one record each.

The canonical key keeps letters and digits only, in lower case, and the fields
of a link's query in sorted order. Keys that hold a large share of all rows are
found exactly from partial counts made before any shuffle; their rows are
salted and aggregated in two levels, all other keys in one.

Defined results: a null title or link agrees with nothing, so such a row is a
record of its own; texts without a letter or digit agree with each other; rows
that repeat an id count as copies but are never reported as their own copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressfold.session import cut

#: A key is hot if it holds this share of the rows: at most 10,000 keys can.
HOT_SHARE = 1e-4
#: ... and at least so many rows.
HOT_ROWS = 2000
SALTS = 64


def letters_digits(text: Column) -> Column:
    """The letters and digits of a text, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def canonical_link(link: Column) -> Column:
    """The link without its query, then the query's fields in sorted order; of each only letters and digits."""
    bare = F.regexp_replace(link, "(?s)#.*$", "")
    anchor = F.regexp_extract(link, "(?s)#(.*)$", 1)
    rest = F.substring_index(bare, "?", 1)
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.transform(F.split(query, "&"), letters_digits), lambda x: x != ""))
    return F.concat_ws("\x01", letters_digits(F.concat(rest, anchor)), fields)


def keyed(records: DataFrame) -> DataFrame:
    """(id, key): key is a 128-bit digest of the canonical title and link, null where either is null."""
    own = records.select("id", F.col("title").alias("title_"), F.col("link").alias("link_"))
    both = F.concat(letters_digits(F.col("title_")), F.lit("\x02"), canonical_link(F.col("link_")))
    key = F.when(F.col("title_").isNotNull() & F.col("link_").isNotNull(), F.unhex(F.md5(both)))
    return own.select("id", key.alias("key")).where("id is not null")


def hot_keys(rows: DataFrame, total: int) -> DataFrame:
    """Keys with at least ``HOT_SHARE`` of ``total`` rows: partial counts are made before the shuffle, so no key is skewed here."""
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")


def _split(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a key, and of these the hot and the other ones. The hot keys are at most 10,000, so they may be broadcast."""
    rows = cut(keyed(records))
    with_key = rows.where("key is not null")
    hot = F.broadcast(cut(hot_keys(with_key, rows.count())))
    return rows, with_key.join(hot, "key", "left_semi"), with_key.join(hot, "key", "left_anti")


def _two_levels(hot: DataFrame) -> DataFrame:
    """(key, first_id, copies) of the hot keys."""
    salted = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    parts = salted.agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return parts.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def collapse(records: DataFrame) -> DataFrame:
    """(first_id, copies): one row for each distinct record, with the number of rows it stands for."""
    rows, hot, rest = _split(records)
    ones = rows.where("key is null").select(F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    one_level = rest.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return _two_levels(hot).unionByName(one_level).drop("key").unionByName(ones)


def copies(records: DataFrame) -> DataFrame:
    """(first_id, dup_id): one row for each copy besides the one with the smallest id."""
    _, hot, rest = _split(records)
    first = F.broadcast(_two_levels(hot).select("key", "first_id"))
    of_hot = hot.join(first, "key").select("first_id", F.col("id").alias("dup_id"))
    of_rest = rest.select(F.min("id").over(Window.partitionBy("key")).alias("first_id"), F.col("id").alias("dup_id"))
    return of_hot.unionByName(of_rest).where("first_id <> dup_id").distinct()
