"""Pairs of items that occur together more often than by chance.

Every record's distinct items are turned into pairs, a pair into one 64-bit
code. Each task sorts its codes in runs of bounded size, counts equal codes
next to each other and spills (code, count). The runs are distributed by code,
merged by Spark's external sort, and equal codes of the merged run are counted
as they pass. An item paired with itself counts the records that hold the item,
so one pass gives all numbers.

A record with more than ``BLOCK`` items is divided into blocks of items, and
each pair of blocks is work of its own, so no task holds one record's pairs.

Defined results: rows with a null record or item, or with deleted_at set, do
not count; a repeated (record, item) counts once; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressfold.session import cut

#: Items in a block of a large record; records with more rows are divided.
BLOCK = 1024
#: Codes in a run that is sorted at once: 16 MB.
RUN = 1 << 21
_RUN_SCHEMA = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _run(parts: list[np.ndarray]) -> pa.RecordBatch:
    """A sorted run, equal codes counted."""
    codes = np.sort(np.concatenate(parts))
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(codes[starts]), pa.array(np.diff(np.append(starts, len(codes))))], schema=_RUN_SCHEMA)


def _same_size(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Codes of all pairs a <= b in records of one size."""
    items = np.sort(values[starts[:, None] + np.arange(size)], axis=1)
    a, b = np.triu_indices(size)
    return ((items[:, a] << 32) | items[:, b]).ravel()


def _block_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of the pairs of two different blocks of one record."""
    a, b = left[:, None], right[None, :]
    return ((np.minimum(a, b) << 32) | np.maximum(a, b)).ravel()


def _pair_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the codes of ``items`` or, where ``others`` is not empty, of two blocks; code -1 counts records."""
    parts: list[np.ndarray] = []
    held = records = 0

    def spill() -> pa.RecordBatch:
        nonlocal held
        run = _run(parts)
        parts.clear()
        held = 0
        return run

    for batch in batches:
        items, others = batch.column("items"), batch.column("others")
        values, bounds = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
        other, other_bounds = others.values.to_numpy(zero_copy_only=False), others.offsets.to_numpy()
        sizes, other_sizes = np.diff(bounds), np.diff(other_bounds)
        records += batch.column("records").to_numpy(zero_copy_only=False).sum()
        for size in np.unique(sizes[other_sizes == 0]):
            rows = np.flatnonzero((sizes == size) & (other_sizes == 0))
            step = max(1, RUN // max(1, size * (size + 1) // 2))
            for k in range(0, len(rows) if size else 0, step):
                parts.append(_same_size(values, bounds[rows[k : k + step]], int(size)))
                held += len(parts[-1])
                if held >= RUN:
                    yield spill()
        for k in np.flatnonzero(other_sizes):
            parts.append(_block_pairs(values[bounds[k] : bounds[k + 1]], other[other_bounds[k] : other_bounds[k + 1]]))
            held += len(parts[-1])
            if held >= RUN:
                yield spill()
    if held:
        yield spill()
    if records:
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([int(records)])], schema=_RUN_SCHEMA)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal codes added up along a merged run; a code may go on in the next batch."""
    last, held = -2, 0
    for batch in batches:
        codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        if not len(codes):
            continue
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        sums = np.add.reduceat(n, starts)
        own = codes[starts]
        if own[0] == last:
            sums[0] += held
        elif last != -2:
            own, sums = np.concatenate(([last], own)), np.concatenate(([held], sums))
        last, held = own[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(sums[:-1])], schema=_RUN_SCHEMA)
    if last != -2:
        yield pa.RecordBatch.from_arrays([pa.array([int(last)]), pa.array([int(held)])], schema=_RUN_SCHEMA)


def _live(rows: DataFrame, record: str, item: str) -> DataFrame:
    own = rows.where(F.col("deleted_at").isNull()) if "deleted_at" in rows.columns else rows
    return own.select(F.col(record).alias("record"), F.col(item).cast("bigint").alias("item")).dropna()


def _dictionary(items: DataFrame) -> DataFrame:
    """(item, code): codes count up from 0 in the order of the items."""
    placed = cut(items.select("item").distinct().repartitionByRange("item").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("item")) - 1)
    return ranked.join(starts, "part").select("item", (F.col("start") + F.col("rank")).alias("code"))


def _blocks(large: DataFrame) -> DataFrame:
    """The pairs of blocks of large records, each a row to be placed by itself."""
    pairs = large.distinct()
    sizes = pairs.groupBy("record").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = pairs.join(sizes, "record").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    blocks = cut(placed.groupBy("record", "blocks", "block").agg(F.collect_list("item").alias("items")))
    ahead = blocks.select("record", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "items")
    behind = blocks.select("record", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("items").alias("others"))
    first = ahead.groupBy("record").agg(F.min(F.struct("i", "j")).alias("first"))
    joined = ahead.join(behind, ["record", "i", "j"]).join(first, "record")
    same = F.col("i") == F.col("j")
    records = F.when(F.struct("i", "j") == F.col("first"), 1).otherwise(0)
    return joined.select("items", F.when(same, F.array().cast("array<bigint>")).otherwise(F.col("others")).alias("others"), records.cast("bigint").alias("records"))


def code_counts(rows: DataFrame, record: str, item: str) -> tuple[DataFrame, DataFrame | None]:
    """(code, n) of all pairs, written once, and the dictionary of the items if they had to be renumbered.

    Items are packed as they are if they lie in 0 .. 2^31 - 1, which a look at
    the smallest and the largest tells; other items are renumbered first.
    """
    own, dictionary = _live(rows, record, item), None
    low, high = own.agg(F.min("item"), F.max("item")).first()
    if low is not None and (low < 0 or high >= 1 << 31):
        dictionary = cut(_dictionary(own))
        own = own.join(dictionary, "item").select("record", F.col("code").alias("item"))
    none = F.array().cast("array<bigint>")
    large = cut(own.groupBy("record").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("record"))
    if large.isEmpty():
        work = own.groupBy("record").agg(F.collect_set("item").alias("items")).select("items", none.alias("others"), F.lit(1).cast("bigint").alias("records"))
    else:
        few = own.join(large, "record", "left_anti").groupBy("record").agg(F.collect_set("item").alias("items"))
        work = few.select("items", none.alias("others"), F.lit(1).cast("bigint").alias("records"))
        work = work.unionByName(_blocks(own.join(large, "record", "left_semi")))
    runs = work.mapInArrow(_pair_codes, "code bigint, n bigint")
    return cut(runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged, "code bigint, n bigint")), dictionary


def associations(rows: DataFrame, record: str, item: str) -> DataFrame:
    """(a, b, n_a, n_b, n_ab, n_records, odds_ratio) of each pair a < b that occurs.

    odds_ratio has 0.5 added to each of its four counts.
    """
    counts, dictionary = code_counts(rows, record, item)
    low = F.lit((1 << 32) - 1)
    total = counts.where("code = -1").agg(F.sum("n")).first()[0] or 0
    split = counts.where("code >= 0").select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(low).alias("b"), "n")
    single = split.where("a = b")
    out = split.where("a < b").withColumnRenamed("n", "n_ab")
    out = out.join(single.select("a", F.col("n").alias("n_a")), "a").join(single.select("b", F.col("n").alias("n_b")), "b")
    out = out.withColumn("n_records", F.lit(total).cast("bigint"))
    both, only_a, only_b = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    ratio = (both + 0.5) * (neither + 0.5) / ((only_a + 0.5) * (only_b + 0.5))
    out = out.select("a", "b", "n_a", "n_b", "n_ab", "n_records", ratio.alias("odds_ratio"))
    if dictionary is None:
        return out
    names = [dictionary.select(F.col("code").alias(c), F.col("item").alias(f"{c}_item")) for c in ("a", "b")]
    return out.join(names[0], "a").join(names[1], "b").drop("a", "b").withColumnsRenamed({"a_item": "a", "b_item": "b"})


def beyond_chance(pairs: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """Pairs in at least ``least`` records and ``times`` as many as by chance; the test is exact."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(F.col("n_ab") >= least).where(wide("n_ab") * wide("n_records") >= F.lit(times) * (wide("n_a") * wide("n_b")))
