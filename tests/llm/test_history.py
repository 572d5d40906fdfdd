"""Batches against history: the index against brute force, and batch by batch against all at once."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressfold.llm import history as H

ROWS = "id bigint, corporation_id bigint, title string, link string, head string"


@pytest.mark.parametrize(
    "other",
    ["http://WWW.a.com/p/1?b=2&c=3", "https://a.com:443/p/1/?c=3&b=2", "https://a.com/p//1?utm_source=x&b=2&c=3&fbclid=1", " https://a.com/%70/1?b=2&c=3#top", "https://a.com/p/1?b=2&c=3&ref=newsletter"],
)
def test_same_page(other):
    assert H.page_of(other) == H.page_of("https://a.com/p/1?b=2&c=3")


def test_other_pages():
    links = ["https://a.com/p/1?b=2", "https://a.com/p/1?b=3", "https://a.com/p/2?b=2", "https://b.com/p/1?b=2", "https://a.com/p/1"]
    assert len({H.page_of(x) for x in links}) == len(links)
    assert H.page_of(None) is None and H.page_of("  ") is None


def test_labels():
    for title in ("[NEW] Big news, part 2", "Big news: part 2 (updated)", "big  news part 2 | Acme Labs", "Big news part 2 - Acme Labs 기술 블로그", "Acme Labs » Big news part 2 (재게시)"):
        assert H.headline_of(title, "Acme Labs") == "bignewspart2"
    assert H.headline_of("[Acme] review", "Acme Labs") == "acmereview"
    assert H.headline_of(None, None) == "" and H.headline_of("...", "x") == ""


letters = st.text(alphabet="abc1", min_size=6, max_size=14)


@settings(max_examples=300, deadline=None)
@given(letters, st.integers(0, 13), st.sampled_from("abx"), st.sampled_from("dirs"))
def test_one_slip_is_always_found(text, at, letter, kind):
    at %= len(text)
    other = {"d": text[:at] + text[at + 1 :], "i": text[:at] + letter + text[at:], "r": text[:at] + letter + text[at + 1 :], "s": text[:at] + text[at : at + 2][::-1] + text[at + 2 :]}[kind]
    if other != text and len(other) >= 6 and H.one_slip(text, other):
        assert set(H.probes("s", text)) & set(H.segments("s", other))
        assert (H.parity(text) ^ H.parity(other)).bit_count() <= 2


def test_one_slip():
    assert H.one_slip("servcie", "service") and H.one_slip("meets", "meeets") and H.one_slip("abc", "abd")
    for a, b in (("part1", "part2"), ("part1", "part"), ("abcd", "abdc1"), ("abcd", "dcba"), ("item12", "item21")):
        assert not H.one_slip(a, b)


def brute(accepted, batch):
    """Every record against all accepted ones before it."""
    known = [(i, c, H.headline_of(t, None), H.page_of(p)) for i, c, t, p, _ in accepted]

    def same(x, y):
        near = x[2] == y[2] or (min(len(x[2]), len(y[2])) >= H.SHORTEST and H.one_slip(x[2], y[2]))
        return (x[3] and x[3] == y[3]) or (x[1] is not None and x[1] == y[1] and x[2] and y[2] and near)

    found = set()
    for i, c, t, p, _ in sorted(batch):
        own = (i, c, H.headline_of(t, None), H.page_of(p))
        matches = [k for k in known if same(own, k)]
        if not matches:
            known.append(own)
            continue
        first = min(matches)
        wider = [k[0] for k in known if (first[3] and k[3] == first[3]) or (first[2] and first[1] is not None and k[1:3] == first[1:3])]
        found.add((min([first[0], *wider]), i))
    return found


def sample(seed, first, count):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(first, first + count):
        title = " ".join(pick.choice(words) for _ in range(3)) + pick.choice(["", " 1", " 2"])
        if pick.random() < 0.3:
            at = pick.randrange(len(title))
            title = title[:at] + pick.choice(["", "x", title[at] * 2]) + title[at + 1 :]
        rows.append((i, pick.choice([1, 1, 1, 2, None]), pick.choice([title, title, title, None]), pick.choice([None, f"https://a.com/{pick.randrange(60)}", f"http://www.a.com/{i}"]), "clash"))
    return rows


def prepared(spark, rows):
    return H.prepare(spark.createDataFrame(rows, ROWS))


def test_against_brute_force(spark):
    for seed in range(2):
        old, new = sample(seed, 1, 60), sample(seed + 50, 1000, 150)
        got = H.check_batch(prepared(spark, new + new[:5] + [(None, 1, "t", "l", "")]), H.History.of(prepared(spark, old)))
        assert sorted(map(tuple, got.collect())) == sorted(brute(old, new))


def test_batch_by_batch(spark, tmp_path):
    path = str(tmp_path / "history")
    H.History.of(prepared(spark, sample(1, 1, 40))).append(path)
    found, batches = set(), [sample(k + 70, 1000 * k, 60) for k in (1, 2)]
    for rows in batches:
        batch = prepared(spark, rows)
        got = {tuple(r) for r in H.check_batch(batch, H.History.read(spark, path)).collect()}
        cases = spark.createDataFrame([(d,) for _, d in got] or [(-1,)], "id bigint")
        H.History.of(batch.join(cases, "id", "left_anti")).append(path)
        found |= got
    assert found == brute(sample(1, 1, 40), batches[0] + batches[1])


def test_empty(spark):
    none, some = prepared(spark, []), prepared(spark, sample(3, 1, 10))
    assert H.check_batch(none, H.History.of(some)).count() == 0
    assert {d for _, d in map(tuple, H.check_batch(some, H.History.of(none)).collect())} == {d for _, d in brute([], sample(3, 1, 10))}


def test_headlines_of_one_pattern_make_no_quadratic_pairs(spark):
    words = [a + b + c for a in "abcdefghjk" for b in "lmnopqrst" for c in "uvwxyzaei"][:800]
    old = [(i, 1, f"Weekly notes on {w}{w[::-1]} and the rest of it", None, None) for i, w in enumerate(words)]
    new = [(5000, 1, f"Weekly notes on {words[3]}{words[3][::-1]} and the erst of it", None, None), (5001, 1, "Weekly notes on something else and the rest", None, None)]
    history, batch = H.History.of(prepared(spark, old)), prepared(spark, new)
    assert {(a, b) for a, b in map(tuple, H.check_batch(batch, history).collect())} == brute(old, new) == {(3, 5000)}
    every = prepared(spark, [(10000 + r[0], *r[1:]) for r in old])
    near = H.slips(H.headlines(every), history)
    assert near.count() <= 20 * len(old)


def test_variants_meet_if_one_slip_apart():
    for a, b in (("servcie", "service"), ("meets", "meeets"), ("abc", "abd"), ("ab", "ba")):
        assert set(H.variants("s", a)) & set(H.variants("s", b))


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    rows = [(i, i % 7, f"headline {'abcdefghij'[i % 10]} of {'klmnopqrst'[i // 10 % 10]}", f"https://a.com/{i}", None) for i in range(400)]
    for size, buckets in ((40, 8), (400, 80)):
        path = str(tmp_path / f"h{size}")
        H.History.of(prepared(spark, rows[:size])).append(path, buckets)
        history = H.History.read(spark, path)
        batch = prepared(spark, [(9000, 1, None, "https://a.com/3", None)])
        assert [tuple(r) for r in H.check_batch(batch, history).collect()] == [(3, 9000)]
        read = history.near("keys", "key", H._keys(batch, "id").select("key"))
        assert [r.id for r in read.collect()] == [3]
        buckets_read = re.search(r"bucket#\d+ (?:IN \(([\d, ]+)\)|= (\d+))", read._jdf.queryExecution().optimizedPlan().toString())
        assert len((buckets_read[1] or buckets_read[2]).split(",")) == 1 < history.keys.select("bucket").distinct().count()


def test_batches_in_order(spark, tmp_path):
    old, batches = sample(1, 1, 40), [sample(k + 70, 1000 * k, 60) for k in (1, 2)]
    got = H.check_batches([prepared(spark, b) for b in batches], H.History.of(prepared(spark, old)), str(tmp_path / "h"))
    assert {tuple(r) for r in got.collect()} == brute(old, batches[0] + batches[1])
