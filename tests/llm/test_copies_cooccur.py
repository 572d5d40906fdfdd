"""Formatting copies and pairs of items against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

from pressfold.llm import cooccur, copies

ARTICLES = "id bigint, title string, link string, key string"


def brute(rows):
    bare = lambda t: re.sub(r"[\W_]+", "", t.lower())
    groups = defaultdict(list)
    for i, title, link, _ in rows:
        if i is None:
            continue
        if title is None or link is None:
            groups[("none", i)].append(i)
            continue
        rest, _, query = link.partition("?")
        groups[(bare(title), bare(rest), tuple(sorted(filter(None, map(bare, query.split("&"))))))].append(i)
    return groups


def test_copies(spark):
    rows = [
        (5, "A Title!", "https://x.com/a?b=1&c=2", "clash"), (2, "a title", "HTTPS://x.com/a?c=2&b=1", None), (9, "a_title", "https://x.com//a/?b=1&C=2", None),
        (3, "a title", "https://x.com/a?b=12", None), (4, None, "https://x.com/a", None), (6, None, "https://x.com/a", None), (7, "t", None, None), (None, "a title", "x", None),
        (8, "!!", "?", None), (10, "", "", None), (11, "a" * 200_000, "l", None), (12, "A" * 200_000, "L", None), (2, "a title", "HTTPS://x.com/a?c=2&b=1", None),
    ]
    table = spark.createDataFrame(rows, ARTICLES)
    assert sorted(map(tuple, copies.copies(table).collect())) == [(2, 5), (2, 9), (8, 10), (11, 12)]
    assert sorted(map(tuple, copies.collapse(table).collect())) == sorted((min(g), len(g)) for g in brute(rows).values())
    empty = spark.createDataFrame([], ARTICLES)
    assert copies.copies(empty).count() == 0 and copies.collapse(empty).count() == 0


def test_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT_ROWS", 20)
    pick = random.Random(1)
    rows = [(i, "Hot" if pick.random() < 0.4 else f"t{pick.randrange(300)}", f"l?{pick.choice(['a=1&b=2', 'b=2&a=1'])}", None) for i in range(900)]
    table = spark.createDataFrame(rows, ARTICLES)
    groups = brute(rows)
    assert sorted(map(tuple, copies.copies(table).collect())) == sorted((min(g), i) for g in groups.values() for i in set(g) - {min(g)})
    assert sorted(map(tuple, copies.collapse(table).collect())) == sorted((min(g), len(g)) for g in groups.values())


TAGS = "article_id bigint, tag_id bigint, deleted_at timestamp_ntz, items string"


def pairs_of(rows):
    held = defaultdict(set)
    for a, t, gone, _ in rows:
        if a is not None and t is not None and gone is None:
            held[a].add(t)
    single, both = Counter(), Counter()
    for items in held.values():
        single.update(items)
        both.update(itertools.combinations(sorted(items), 2))
    return {(a, b, single[a], single[b], n, len(held)) for (a, b), n in both.items()}


def check(spark, rows):
    found = cooccur.associations(spark.createDataFrame(rows, TAGS), "article_id", "tag_id").drop("odds_ratio")
    got = [tuple(r) for r in found.select("a", "b", "n_a", "n_b", "n_ab", "n_records").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(rows)


def test_pairs(spark):
    from datetime import datetime

    pick = random.Random(2)
    rows = [(pick.randrange(60), pick.randrange(12), datetime(2024, 1, 1) if pick.random() < 0.1 else None, "x") for _ in range(600)]
    check(spark, rows + [(None, 1, None, None), (1, None, None, None)] + rows[:50])
    check(spark, [])
    check(spark, [(1, 1, None, None)])


def test_items_outside_the_packed_range(spark):
    pick = random.Random(3)
    items = [-5, 0, 7, 1 << 31, 1 << 62]
    check(spark, [(pick.randrange(30), pick.choice(items), None, None) for _ in range(200)])


def test_large_records(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK", 16)
    monkeypatch.setattr(cooccur, "RUN", 500)
    pick = random.Random(4)
    rows = [(0, pick.randrange(150), None, None) for _ in range(400)] + [(pick.randrange(1, 20), pick.randrange(150), None, None) for _ in range(300)]
    check(spark, rows)


def test_beyond_chance_is_exact(spark):
    rows = [(1, 2, 10, 10, 5, 60), (1, 3, 10, 10, 5, 59), (1, 4, 10, 10, 4, 900), (1, 5, 3 * 10**9, 10**9, 3 * 10**8, 3 * 10**10)]
    table = spark.createDataFrame(rows, "a bigint, b bigint, n_a bigint, n_b bigint, n_ab bigint, n_records bigint")
    assert sorted(r.b for r in cooccur.beyond_chance(table).collect()) == [2, 5]


def test_runs_are_merged_across_batches():
    import pyarrow as pa

    from pressfold.llm import cooccur

    batches = [pa.RecordBatch.from_pydict({"code": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64())}) for c, n in (([-1, 3, 3], [2, 1, 4]), ([], []), ([3], [5]), ([3, 7], [1, 1]), ([8], [9]))]
    merged = [(c, n) for b in cooccur._merged(iter(batches)) for c, n in zip(*(b.column(k).to_pylist() for k in ("code", "n")), strict=True)]
    assert merged == [(-1, 2), (3, 11), (7, 1), (8, 9)]
    assert list(cooccur._merged(iter([]))) == []
