"""Token ids, leaked passages, sentences and subjects."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressfold.llm import bpe, leakage, sentences, subjects

VOCABULARY = os.path.join(bpe.FOLDER, bpe.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
DOCS = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(VOCABULARY)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="aab bcé한국 \n<|endoftext|>'sé😀", max_size=400))
def test_ids_agree_with_the_public_library(text):
    tokenizers = pytest.importorskip("tokenizers")
    t = _public(tokenizers)
    assert _encoder().encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


_kept: dict = {}


def _public(tokenizers):
    if "t" not in _kept:
        _kept["t"] = tokenizers.Tokenizer.from_file(VOCABULARY)
        _kept["t"].encode_special_tokens = True
    return _kept["t"]


def _encoder():
    return _kept.setdefault("e", bpe.Encoder(VOCABULARY))


@needs_vocabulary
def test_long_words_and_round_trip(encoder, public):
    pick = random.Random(1)
    texts = ["a" * 50_000, "한국어" * 5000, "".join(pick.choice("abcdefgh") for _ in range(30_000)), "ไม่มีใครคิดว่าระบบค้นหา" * 300]
    for ids, text in zip(encoder.encode(texts), texts, strict=True):
        assert ids.tolist() == public(text)


@needs_vocabulary
def test_encode_table(spark, data, public):
    rows = [(1, "hello <|endoftext|>", "x"), (2, None, None), (3, "", None), (3, "", None), (None, "a", None)]
    found = sorted((tuple([r.doc_id, r.ids]) for r in bpe.encode(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert found == sorted([(1, public("hello <|endoftext|>")), (2, []), (3, []), (3, []), (None, public("a"))], key=str)
    assert bpe.encode(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == public(texts[r.doc_id] or "") for r in bpe.encode(docs).collect())


def has_half(doc, item):
    d, i = leakage.bare(doc or ""), leakage.bare(item or "")
    need = (len(i) + 1) // 2
    return bool(i) and any(i[k : k + need] in d for k in range(len(i) - need + 1))


def leak_rows(seed):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "한국어", "42", "e"]
    items = [(k, " ".join(pick.choice(words) for _ in range(pick.choice([1, 2, 6, 12])))) for k in range(25)] + [(90, None), (91, ""), (92, "?!"), (None, "alpha beta"), (0, "other text of the same id entirely")]
    docs = [(900, None), (901, ""), (902, "...")]
    for k in range(120):
        _, item = items[pick.randrange(25)]
        bare = leakage.bare(item)
        a = pick.randrange(max(1, len(bare)))
        part = bare[a : a + pick.randrange(1, len(bare) + 1)]
        spaced = "".join(c.upper() + pick.choice(["", " ", ", "]) for c in part)
        docs.append((k, " ".join(pick.choice(words) for _ in range(pick.randrange(5))) + spaced + pick.choice(words)))
    return items, docs


def test_leaks_against_brute_force(spark):
    items, docs = leak_rows(5)
    found = leakage.leaked(spark.createDataFrame([(d, t, "x") for d, t in docs + docs[:5]], DOCS), spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string"))
    expected = {(d, i) for d, t in docs for i, x in items if i is not None and has_half(t, x)}
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaked(spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS), none).count() == 0


def test_threshold_misses_nothing():
    items, docs = leak_rows(6)
    long = [(i, t) for i, t in items if t and len(leakage.bare(t)) >= 2 * leakage.GRAM]
    index = leakage.build([i for i, _ in long], [t for _, t in long])
    got = {(row, k) for row, k in leakage.matches(index, [t for _, t in docs])}
    assert got == {(row, k) for row, (_, t) in enumerate(docs) for k, (_, x) in enumerate(long) if has_half(t, x)}


TEXT = "Dr. Novak asked why 3.5 queues moved. “Is it {a}?” asked one. It took 0.5 s. At 3 p.m. we stopped! Did it help?\n\n# A heading\n \n- one item 1.5\n- two items\n\nThe {a} list covers tests, etc. We\nwaited... and left.\n\n"
PIECES = ["Dr. {n} asked why 3.5 queues moved.", "“Is it {a}?” asked one.", "It took 0.5 s.", "At 3 p.m. we stopped!", "We stopped at 4 p.m.", "Did it help?", "The {a} list covers tests, etc.", "We waited... and left.", "Dr. {n} left.", "They saw Dr. {n} twice."]


@pytest.fixture(scope="module")
def model():
    pick = random.Random(9)
    name = lambda: "".join(pick.choice("BDFGK") + pick.choice("aeiou") for _ in range(1)) + "".join(pick.choice("bdfgk") + pick.choice("aeiou") for _ in range(3))
    paragraph = lambda: " ".join(pick.choice(PIECES) for _ in range(pick.randrange(1, 5)))
    texts = ["\n\n".join(paragraph() for _ in range(4)) for _ in range(300)]
    return sentences.fit([t.replace("{n}", name()).replace("{a}", pick.choice(["red", "blue", "green"])) for t in texts])


def test_sentences(model):
    text = TEXT.replace("{a}", "red")
    got = [text[a:b] for a, b in sentences.divide(text, model)]
    assert got == ["Dr. Novak asked why 3.5 queues moved.", "“Is it red?” asked one.", "It took 0.5 s.", "At 3 p.m. we stopped!", "Did it help?", "# A heading", "- one item 1.5", "- two items", "The red list covers tests, etc.", "We\nwaited... and left."]


def test_without_training():
    plain = sentences.fit([])
    assert sentences.divide("One is here. Two is there, e.g. this. 끝났습니다. 다음", plain) == [(0, 12), (13, 37), (38, 44), (45, 47)]


def test_other_scripts(model):
    cut = lambda t: [t[a:b] for a, b in sentences.divide(t, model)]
    assert cut("第一句。第二句！“引用。再引用。”，大家都记得。") == ["第一句。", "第二句！", "“引用。再引用。”，大家都记得。"]
    assert cut("ทำไมจึงช้า หลังจากนั้น") == ["ทำไมจึงช้า", "หลังจากนั้น"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1.!? \n\t\"“”(-*#。ไ가 ﻿", max_size=120))
def test_sentences_tile_the_text(text):
    found = sentences.divide(text, sentences.fit([]))
    at = 0
    for a, b in found:
        assert at <= a < b <= len(text) and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_sentence_table(spark):
    rows = [(1, "One is here. Two is there.", "x"), (2, None, None), (3, "", None), (4, " \n ", None), (None, "A.", None), (5, "word " * 60_000 + "end.", None)]
    found = sorted(tuple(r) for r in sentences.sentences(spark.createDataFrame(rows, DOCS)).collect())
    assert found == [(1, 0, 12), (1, 13, 26), (5, 0, 300_004)]
    assert sentences.sentences(spark.createDataFrame(rows[1:4], DOCS)).count() == 0
    assert sentences.sentences(spark.createDataFrame([], DOCS)).count() == 0


def topic_rows(n=600):
    pick = random.Random(8)
    words = {1: ["thread pools", "message queues", "unit tests"], 2: ["soup broths", "oven heat", "spice blends"], 3: ["match rules", "swim laps", "stadium seats"]}
    rows, labels = [], []
    for i in range(n):
        own = [pick.choice((1, 2, 3))] + ([pick.choice((1, 2, 3))] if pick.random() < 0.15 else [])
        parts = [f"We looked at {pick.choice(words[pick.choice(own)])} again." for _ in range(2)] + [f"Here is what went wrong with {pick.choice(words[s])}." for s in own]
        if pick.random() < 0.2:
            parts.append(f"It felt a bit like {pick.choice(words[pick.choice((1, 2, 3))])}, only slower.")
        rows.append((i, f"Lessons from {pick.choice(words[own[0]])}", " ".join(parts), "clash"))
        labels += [(i, s) for s in set(own)]
    return rows, labels


def test_subjects(spark):
    rows, labels = topic_rows()
    rows += [(9001, "News from Acme", None, None), (9002, None, "A short update.", None), (9003, "Hello", "Update", None), (None, "x", None, None), (rows[0])]
    articles = spark.createDataFrame(rows, "id bigint, title string, summary string, subject string")
    given_labels = spark.createDataFrame([x for x in labels if x[0] % 4 == 0] + [(None, 1), (1, None)], "article_id bigint, subject_id int")
    links = [(i, 10 + (i % 2), None) for i in range(0)] + [(a, 20 + s, None) for a, s in labels] + [(a, 30 + s, None) for a, s in labels] + [(9001, 22, None), (9001, 32, None), (9002, 21, None), (9003, 23, None), (9003, 33, None)]
    tags = spark.createDataFrame([(t, None) for t in (21, 22, 23, 31, 32, 33)], "id bigint, deleted_at timestamp_ntz")
    article_tags = spark.createDataFrame(links, "article_id bigint, tag_id bigint, deleted_at timestamp_ntz")
    left_out = spark.createDataFrame([(9003,)], "id bigint")
    got = {tuple(r) for r in subjects.subjects_of(articles, given_labels, article_tags, tags, left_out).collect()}
    held = {x for x in labels if x[0] % 4}
    said = {x for x in got if x[0] < 9000 and x[0] % 4}
    assert len(held & said) >= 0.95 * len(held) and len(held & said) >= 0.95 * len(said)
    assert {x for x in got if x[0] >= 9000} == {(9001, 2)}
    assert subjects.subjects_of(articles, given_labels.limit(0), article_tags, tags).count() == 0
    assert subjects.subjects_of(articles.limit(0), given_labels, article_tags.limit(0), tags).count() == 0


def test_mixtures_do_not_rise_in_error():
    rng = np.random.default_rng(3)
    h = rng.random((3, 40))
    model = subjects.Model(np.arange(40), np.ones(40), h)
    columns = np.sort(rng.choice(40, 12, replace=False))
    v = np.zeros(40)
    v[columns] = 1
    mix = model.mixtures(columns, np.zeros(12, dtype=np.int64), 1)
    assert (mix >= 0).all() and np.linalg.norm(v - mix @ h) <= np.linalg.norm(v)


def test_leaks_with_several_indexes_answers_and_long_documents(spark):
    items, docs = leak_rows(7)
    pick = random.Random(4)
    filler = "".join(pick.choice("qzxwvj ") for _ in range(50_000))
    items += [(200, "zebra quilt " * 3 + "lantern orbit marmalade " * 40)]
    docs += [(2000, filler + ("zebra quilt " * 3 + "lantern orbit marmalade " * 40)[200:760] + filler + "Answer: FORTY-two" + filler), (2001, filler)]
    table = spark.createDataFrame([(i, t, "forty two" if i == 200 else None) for i, t in items], "item_id bigint, text string, answer string")
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    expected = {(d, i) for d, t in docs for i, x in items if i is not None and has_half(t, x)}
    for most in (leakage.MOST_ITEM_BYTES, 600):
        found = leakage.hits(frame, table, most=most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
        assert {r.doc_id: r.with_answer for r in found if r.item_id == 200} == {2000: True}
        assert all(r.with_answer is None for r in found if r.item_id != 200)


def test_passages_hold_every_run():
    items = [(1, "abcdefgh" * 60), (2, "the quick brown fox jumps over the lazy dog")]
    index = leakage.build([i for i, _ in items], [t for _, t in items])
    places, need = np.unique(np.random.default_rng(1).integers(0, 20_000, 900)), int(index.needed.max())
    spans = list(leakage.passages(index, places))
    for at in range(len(places)):
        run = np.searchsorted(places, places[at] + need - leakage.GRAM + 1)
        assert any(a <= at and run <= b for a, b in spans)


def test_sample_and_repeated_documents(spark):
    rows = [(i, "One text. The same for all." if i % 3 else f"Text {i}. It is short.", None) for i in range(300)] + [(1000, "x" * 100_000, None), (7, "One text. The same for all.", "again"), (None, "A.", None)]
    table = spark.createDataFrame(rows, DOCS)
    assert len(sentences.sample(table, 50)) <= 50 and max(map(len, sentences.sample(table))) <= sentences.TRAIN_BYTES
    assert sentences.sample(table.where("doc_id % 3 = 1")) == ["One text. The same for all."]
    found = [tuple(r) for r in sentences.sentences(table, model=sentences.fit([])).collect()]
    assert len(found) == len(set(found)) and [f for f in sorted(found) if f[0] == 7] == [(7, 0, 9), (7, 10, 27)]


@pytest.mark.parametrize("text", ["It felt a bit like soup, only slower.", "Think of it as a swim lap.", "They ran as if late.", "That reminds us of stadium seats.", "It is much like a kitchen.", "It was akin to oven heat.", "마치 요리를 하듯이 준비했다.", "비유하자면 경기 같다."])
def test_comparisons_do_not_count(text):
    assert subjects._parts(None, f"We tuned queues. {text} We stopped.") == ["We tuned queues.", "We stopped."]


def test_no_comparison():
    for text in ("Users like the new queue.", "호카떼마치 편을 씁니다.", "We liked the result."):
        assert subjects._parts("A title", text) == ["A title", text]
