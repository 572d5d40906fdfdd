"""Residue and cut texts, by example and in tables."""

import numpy as np
import pyarrow as pa
import pytest

from pressfold.llm import residue as R
from pressfold.llm import truncation as T

ROWS = "id bigint, corporation_id bigint, title string, summary string, link string, kind string"


@pytest.mark.parametrize(
    "text",
    ["404 Not Found", "4 0 4", "Service Unavailable (503)", "※ 서비스 점검 중입니다. 이용에 불편을 드려 죄송합니다.", "<p>Access denied. You do not have permission to view this resource. (ref 33aea6)</p>",
     "{{ title }}", "${post.title} | Acme Labs", "&#123;&#123;title&#125;&#125;", "％ＴＩＴＬＥ％", "{ {title} }", "Acme @@TITLE@@ is out, see __DESCRIPTION__", "Hi {0}, a new post by {1} was published.",
     "The work is done. ${summary}", "lorem ipsum dolor sit amet elit", "test test test test", "This is dummy copy. This is dummy copy.", "Please enable JavaScript to view this page.", "noscript:  this page does not work without scripts",
     "[insert summary here]", "undefined", "One moment, verifying that you are human - blog.acme.example", "com.acme.web.PageException: cannot render view at line 3", "Acme Labs - upstream timed out",
     "404\nLoading… if nothing happens, allow scripts and cookies", "Error establishing a connection to the database :("],
)
def test_residue(text):
    case, lines = R.lines_of(text, {"acme labs"})
    assert case or (lines and all(kind for _, kind in lines) and any(kind == 2 for _, kind in lines))


@pytest.mark.parametrize(
    "text",
    ["How we turned Not Found from a dead end into a useful redirect, with numbers.", "Why Acme escapes ${variables} by default", "{{변수}} 표기가 왜 실수를 부르는지, 대안은 무엇인지 설명합니다.", "A lorem ipsum generator for Acme fixtures",
     "서비스 점검 중입니다 안내를 배포 절차에 맞춰 자동으로 띄운 과정입니다.", "게이트웨이가 502를 돌려주던 원인을 프록시 설정에서 찾은 과정입니다.", "Acme 404 responses better in Bcme", "Costs fell by 62% and 30% of users", "A short update from the team.", "", "   ", None, "…", "x" * 300_000],
)
def test_content(text):
    case, lines = R.lines_of(text, {"acme labs"})
    assert not case and not (lines and all(kind for _, kind in lines))


def test_residue_table(spark):
    rows = [(1, 1, "Fine title", "404", "https://a.com/1", "x"), (1, 1, "Fine title", "404", "https://a.com/1", "x"), (2, 1, "Fine title", None, None, None), (None, 1, "404", "404", None, None), (3, None, "null | Acme", "ok text", "https://a.com/2", None)]
    rows += [(i, 1, f"Real headline number {i} - Site of Acme", "real text", "https://a.com/3", None) for i in range(10, 30)] + [(4, 1, "upstream timed out - Site of Acme", None, "https://a.com/4", None), (5, 1, "upstream timed out - something else", None, "https://a.com/4", None)]
    table = spark.createDataFrame(rows, ROWS)
    names = spark.createDataFrame([(1, "Acme"), (None, "x")], "id bigint, name string")
    assert sorted(r.id for r in R.residue(table, names).collect()) == [1, 4]
    assert sorted(r.id for r in R.residue(table.limit(0), names).collect()) == []
    assert sorted(r.id for r in R.residue(table.where("id = 3"), spark.createDataFrame([], "id bigint, name string")).collect()) == []


@pytest.mark.parametrize(
    ("text", "cut"),
    [("Done in time. We spent 40 weeks red… Read more", True), ("끝났습니다. 운영하면서 만난 [...]", True), ("This ends well.", False), ("This ends well?", False), ("broken char �", True), ("an entity &am", True), ("a tag <stro", True),
     ("see https://exam", True), ("with an open (bracket", True), ("", False), ("a" * 199 + " x...", True), ("closed (bracket).", False), (":( sad :)", False)],
)
def test_certain_ends(text, cut):
    if len(text) > 190:
        text = "b" * (T.CATALOGUE_LIMIT - 3) + "..."
    verdict = T.judge("s", text, "")[0] if text else 0
    assert (verdict == 2) == cut


def test_known_words():
    assert T._known("gejoro", "the gejoropohu team", True) == -1
    assert T._known("gejoropohu", "the gejoropohu team", True) == 1
    assert T._known("xyz", "the gejoropohu team", True) == 0


def corpus(n=400):
    terms = ["thread pools", "message queues", "type checking", "unit tests", "data lineage"]
    rows = []
    for i in range(n):
        term = terms[i % 5]
        rows.append((i, i % 7, f"Lessons from {term} in the Nova{i} project", f"We compare {term} before and after the switch. It also covers the limits of {terms[(i + 1) % 5]} under load.", f"https://a.com/view?id={i}", None))
    return rows


def test_truncation_table(spark):
    rows = corpus()
    extra = [
        (1001, 1, "Fine", "We compare type checking before and after the switch. It also covers the lim", None, "x"), (1002, 1, "Fine", "We compare type checking before and after the switch", None, None),
        (1003, 1, "Fine", "We compare type checking before and after the switch...", None, None), (1004, 1, "Fine", "We compare type checking before and aft...", None, None), (1005, None, None, None, None, None), (None, 1, "a", "cut he", None, None),
        (1006, 1, "Lessons from thread pools in the No", "This one is fine.", None, None), (1001, 1, "Fine", "We compare type checking before and after the switch. It also covers the lim", None, "x"), (1007, 1, " ", "  ", None, None),
    ]
    whole = "Nine words of text that go on and on for a good while here."
    extra += [(1010, 3, "Same headline", whole + " More.", None, None), (1011, 3, "Same headline!", whole, None, None), (1012, 3, "Same headline", whole + " More.", None, None), (1013, 4, "Same headline", whole, None, None)]
    table = spark.createDataFrame(rows + extra, ROWS)
    left_out = spark.createDataFrame([(1004,)], "id bigint")
    found = sorted((r.id, r.field_name) for r in T.truncated(table, left_out).collect())
    summaries = [i for i, f in found if f == "summary"]
    assert summaries == [1001, 1011], found
    assert all(f == "summary" or i >= 1000 for i, f in found)
    shares = {r.corporation_id: r for r in T.shares(T.truncated(table), table).collect()}
    assert shares[3].cut_texts >= 1 and None in shares and 0 < shares[3].cut_share < 0.1
    assert T.truncated(table.limit(0)).count() == 0


def test_signatures_find_near_copies():
    words = [f"w{i}" for i in range(60)]
    found = 0
    for k in range(200):
        one = [f"{w}{k}" for w in words]
        a, b = T.signatures([one, one[:54]], T._Words())
        found += bool(set(a.tolist()) & set(b.tolist()))
    assert found >= 190


WHOLE = "Seven teams moved their nightly jobs to the new cluster and none of them lost a run in spring"


def cut_ids(spark, rows):
    table = spark.createDataFrame([(i, source, title, summary, None) for i, source, title, summary in rows], "id bigint, source bigint, title string, summary string, link string")
    return sorted({r.id for r in T.cut_copies(table).collect()})


def test_copies_of_other_sources(spark):
    rows = [(1, 1, "A headline", WHOLE + " and summer."), (2, 2, "A headline", WHOLE), (3, -1, "A headline", WHOLE + " and"), (4, 2, "A headline", WHOLE + " and summer.")]
    assert cut_ids(spark, rows) == [2, 3]


def test_copies_beside_longer_texts_of_their_group(spark):
    rows = [(1, 1, "A headline", WHOLE + " and summer."), (2, 1, "A headline", WHOLE + " and sum"), (3, 1, "A headline", WHOLE + " and summer. " + "More was said of it. " * 9)]
    rows += [(10 + k, 1, "A headline", f"{WHOLE} or{k} autumns.") for k in range(60)]
    assert cut_ids(spark, rows) == [2]


def test_near_copies_are_aligned(spark):
    more = WHOLE + " and summer while the old cluster was kept for tests that need special disks and for nothing else."
    rows = [
        (1, 1, "How teams moved nightly jobs to the cluster", more), (2, 1, "[New] How teams moved nightly jobs to the cluster", more.replace("nightly", "Nightly").replace("Seven", "Eight")[:-6]), (3, 1, None, more[:-9]),
        (4, 2, "How teams moved nightly jobs to the clu", more), (5, 1, "How teams moved nightly jobs to the cluster - Acme Labs", more), (6, 1, "How teams moved nightly jobs to the cluster", more.replace("kept", "held")),
    ]
    table = spark.createDataFrame(rows, "id bigint, source bigint, title string, summary string")
    found = {(r.id, r.field) for r in T.near_copies(table, spark.createDataFrame([], "id bigint, field string")).collect()}
    assert found == {(2, "s"), (3, "s"), (4, "t")}


def test_taglines_of_a_large_host(spark):
    rows = [(i, None, f"Real headline number {i}", None, "https://a.com/3", None) for i in range(10, 3000)]
    rows += [(i, None, f"Real headline of {i} - Notes by the builders", None, "https://a.com/3", None) for i in (1, 2)] + [(3, None, "upstream timed out - Notes by the builders", None, "https://a.com/4", None)]
    assert [r.id for r in R.residue(spark.createDataFrame(rows, ROWS)).collect()] == [3]


@pytest.mark.parametrize(
    "text",
    ["Please enable JavaScript to continue.", "502 Bad Gateway nginx/1.18.0", "Service Temporarily Unavailable", "{{ post.title | upper }}", "The requested URL was not found on this server.", "Your browser does not support cookies.",
     "Whoops, looks like something went wrong.", "Account suspended", "Session timed out, log in again", "Please verify you are not a robot", "Insert your description here", "500 - Internal Server Error", "Enter the title",
     "서버 오류가 발생했습니다", "사이트에 접속할 수 없습니다", "내용을 입력해주세요", "제목 없음", "java.lang.IllegalStateException: null", "An unexpected error has occurred. Please contact the administrator."],
)
def test_residue_in_other_words(text):
    assert R.evidence(text.lower()) or R.own_placeholders(text)


@pytest.mark.parametrize(
    "text",
    ["How we handle errors in our payment service", "JavaScript", "Error handling in Go", "Why our site was down for two hours", "A guide to browser cookies", "Writing better error messages", "서비스 장애 회고", "에러 페이지 디자인을 다시 했습니다",
     "로그인 시스템을 다시 만든 이유", "Release notes", "Access control without tears", "503 pull requests later", "Here is what went wrong with the render loop.", "Session storage in the browser", "요약 모델을 서비스에 적용하기"],
)
def test_content_in_words_of_notices(text):
    assert not R.evidence(text.lower())


def test_wording_that_many_hosts_share(spark):
    line = next(t for t in ("error: the zorbled page is missing", "sorry, zorbled error on this page of ours", "please try the zorbled page again later or contact us") if R.MAYBE <= R.score(t) < R.COVERED)
    few = [(i, 1, "Fine", line, f"https://h{i % 2}.com/x", None) for i in range(6)]
    many = [(10 + i, 1, "Fine", line + " 7", f"https://k{i}.com/x", None) for i in range(R.HOSTS)]
    assert R.residue(spark.createDataFrame(few, ROWS)).count() == 0
    assert R.residue(spark.createDataFrame(few + many, ROWS)).count() == len(few + many)


def test_crowded_bands_give_the_same(spark, monkeypatch):
    more = WHOLE + " and summer while the old cluster was kept for tests that need special disks and for nothing else."
    title = "How teams moved nightly jobs to the cluster"
    rows = [(1, 1, title, more), (2, 1, "[New] " + title, more.replace("Seven", "Eight")[:-6]), (3, 1, None, more[:-9]), (4, 2, title[:-4], more), (5, 1, title + " - Acme Labs", more), (6, 2, title, more[:-9]), (7, None, title, None), (8, 1, None, None)]
    rows += [(100 + i, i % 3, title, more.replace("spring", f"spring{i}")) for i in range(40)]
    table = spark.createDataFrame(rows, "id bigint, source bigint, title string, summary string")
    found = {(r.id, r.field) for r in T.near_copies(table).collect()}
    assert found == {(2, "s"), (3, "s"), (4, "t"), (6, "s")}
    monkeypatch.setattr(T, "BLOCK", 1)
    monkeypatch.setattr(T, "PARTNERS", 2)
    assert {(r.id, r.field) for r in T.near_copies(table).collect()} == found


def test_residue_is_left_out_in_the_same_pass(spark):
    rows = [(i, 1, f"Real headline number {i} - Site of Acme", "real text that goes on", "https://a.com/3", None) for i in range(10, 30)]
    rows += [(1, 1, "upstream timed out - Site of Acme", "It also covers the lim… Read more", "https://a.com/4", None), (2, 1, "Acme", "404\nLoading the wor… Read more", "https://a.com/5", None), (3, None, "Fine", "{{ title }} {{ summary", None, None)]
    rows += [(1, 1, "upstream timed out - Site of Acme", "It also covers the lim… Read more", "https://a.com/4", None), (None, 1, "404", "404", None, None), (4, 2, "null | Acme", "with an open (bracket", "https://b.com/2", None), (5, 3, None, "cut at 44% of the wor… Read more", None, None)]
    table = spark.createDataFrame(rows, ROWS)
    names = spark.createDataFrame([(1, "Acme"), (2, "Acme"), (None, "x")], "id bigint, name string")
    apart = sorted((r.id, r.field_name) for r in T.truncated(table, R.residue(table, names)).collect())
    assert sorted((r.id, r.field_name) for r in T.truncated(table, sites=names).collect()) == apart
    assert (5, "summary") in apart and not {1, 4} & {i for i, _ in apart}


def test_shared_bands(monkeypatch):
    rng = np.random.default_rng(3)
    rows = sorted((int(band), k, int(rng.integers(3))) for k, band in enumerate(rng.choice([2, 4, 5, 7, 8, 10, 11, *range(20, 400, 2)], 2000, p=[0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1, *[0.3 / 190] * 190])))
    rows += [(1000, 1, 1), (1000, 2, 2), (1002, 1, 5), (1002, 2, 6), (1004, 9, 4), (1004, 8, 4), *((1006, k, 0) for k in range(100))]
    expected, small = set(), set()
    for band in {b for b, _, _ in rows}:
        own = [(i, t) for b, i, t in rows if b == band]
        if len({t for _, t in own}) > 1:
            if band & 1 or len(own) > 20:
                expected |= {(T.BEGUN if band & 1 else T.CROWD, i) for i, _ in own}
            else:
                small.add(frozenset(i for i, _ in own))
    for held, size in ((1 << 16, 5000), (1 << 16, 7), (30, 64)):
        monkeypatch.setattr(T, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=["band", "id", "text"]) for k in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in T._shared(iter(batches), 20) for r in b.to_pylist()]
        several = {band for kind, band, _ in found if kind == T.SEVERAL}
        assert {(kind, i) for kind, band, i in found if kind == T.BEGUN or (kind == T.CROWD and band in several)} == expected
        groups = {}
        for kind, band, i in found:
            if kind == T.GROUP:
                groups.setdefault(band, set()).add(i)
        assert len(groups) == len(small) and set(map(frozenset, groups.values())) == small
