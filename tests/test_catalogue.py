"""Lists, maintenance, runs and streams of the catalogue."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressfold.operators import corporations as C
from pressfold.operators import ingest, listing, stats
from pressfold.operators import predicates as P
from pressfold.schemas import ARTICLE, CORPORATION, CORPORATION_INDUSTRY, CRAWL_RESULT, INDUSTRY
from pressfold.sources import snapshots

NOW = datetime(2025, 6, 30, 12)


def lit():
    return F.lit(NOW).cast("timestamp_ntz")


def company(i, name="c", link="https://b.com", deleted=None, created=NOW):
    return (i, name, None, link, None, None, created, created, deleted)


def companies(spark, *rows):
    return spark.createDataFrame(list(rows), CORPORATION)


def article(i, source=1, link=None, published=NOW, created=NOW, views=0, deleted=None, title="A good title"):
    return (i, source, title, "s", link or f"https://b.com/{i}", views, 0, None, None, published, created, created, deleted)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def test_crawlable(spark):
    rows = companies(spark, company(1), company(2, deleted=NOW), company(3, link=None), company(4, link=""), company(5, link="   "))
    assert sorted(r.id for r in rows.where(P.crawlable()).collect()) == [1, 5]
    assert sorted(r.id for r in rows.where(P.blank_link()).collect()) == [3, 4, 5]


def test_name_match(spark):
    rows = companies(spark, company(1, "a_b"), company(2, "axb"), company(3, "100%"), company(4, "back\\slash"))
    assert sorted(r.id for r in rows.where(P.name_match("_b")).collect()) == [1, 2]
    assert [r.id for r in rows.where(P.name_match("\\")).collect()] == [4]
    assert [r.id for r in rows.where(P.name_match("A_B", ignore_case=True)).collect()] == [1, 2]
    assert P.search_text("  ") is None and P.search_text(" a ") == " a "


def test_pages_follow_the_whole_order(spark):
    rows = [article(i, published=NOW - timedelta(days=i // 3) if i % 7 else None, views=i % 4, deleted=NOW if i % 5 == 0 else None) for i in range(1, 40)]
    tables = (articles(spark, *rows), companies(spark, company(1, deleted=NOW)), spark.createDataFrame([(1, 1, 9, NOW, NOW, None), (2, 1, 9, NOW, NOW, None)], "id bigint, article_id bigint, tag_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"), spark.createDataFrame([(9, "x")], "id bigint, keyword string"))
    for sort, key in (("latest", lambda r: (r[9] is not None, r[9] or NOW, r[10], r[0])), ("popular", lambda r: (r[5], r[9] is not None, r[9] or NOW, r[0]))):
        expected = [r[0] for r in sorted((r for r in rows if r[12] is None), key=key, reverse=True)]
        got = [r.id for page in range(5) for r in listing.article_page(*tables, page=page, size=8, sort=sort).collect()]
        assert got == expected
    first = next(r for r in listing.article_page(*tables, size=100).collect() if r.id == 1)
    assert [t.keyword for t in first.tags] == ["x", "x"] and first.corporation.id == 1
    assert next(r for r in listing.article_page(*tables, size=100).collect() if r.id == 2).tags == []
    for bad in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            listing.article_page(*tables, page=bad[0], size=bad[1])
    assert listing.page_numbers(41, 2, 20) == listing.PageNumbers(41, 3, 2, 20, False, True)


def test_page_reads_few_columns(spark, data):
    from pressfold.sources.tables import table

    tables = (table(spark, data, n) for n in ("article", "corporation", "article_tag", "tag"))
    plan = listing.article_page(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNull(deleted_at)" in plan


def test_maintenance(spark):
    industries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], INDUSTRY)
    links = spark.createDataFrame([(1, 1, 1, NOW), (2, 2, 3, NOW)], CORPORATION_INDUSTRY)
    rows = companies(spark, company(1, "old"), company(2, "other"), company(3, "gone", deleted=NOW))
    new, all_rows, bridge = C.create(rows, links, industries, C.CompanyForm("gone", industry_ids=[2, 2, 99]), NOW)
    assert new == 4 and [r.industry_id for r in bridge.where("corporation_id = 4").collect()] == [2]
    with pytest.raises(C.Conflict):
        C.create(rows, links, industries, C.CompanyForm("old"), NOW)
    with pytest.raises(C.Invalid) as wrong:
        C.create(rows, links, industries, C.CompanyForm(" "), NOW)
    assert wrong.value.errors == {"name": "must not be blank"}
    later = NOW + timedelta(hours=1)
    changed, bridge = C.update(all_rows, bridge, industries, 1, C.CompanyForm("new", blog_link=None, industry_ids=[3, 2]), later)
    row = changed.where("id = 1").first()
    assert (row.name, row.blog_link, row.created_at, row.updated_at) == ("new", None, NOW, later)
    assert sorted(r.industry_id for r in bridge.where("corporation_id = 1").collect()) == [2, 3]
    assert C.update(changed, bridge, industries, 1, C.CompanyForm("new", industry_ids=None), later)[1].where("corporation_id = 1").isEmpty()
    for bad in (3, 99):
        with pytest.raises(C.NotFound):
            C.update(rows, links, industries, bad, C.CompanyForm("x"), NOW)
    with pytest.raises(C.Conflict):
        C.update(rows, links, industries, 1, C.CompanyForm("other"), NOW)
    assert C.get(rows, links, industries, 1)["industries"] == ["a"] and C.edit_form(rows, 1).name == "old"
    with pytest.raises(C.NotFound):
        C.get(rows, links, industries, 3)
    deleted = C.soft_delete(rows, 1, later)
    assert deleted.where("id = 1").first().deleted_at == later
    with pytest.raises(C.NotFound):
        C.soft_delete(deleted, 1, later)


def test_counts_and_runs(spark):
    rows = articles(spark, *[article(i, 1, deleted=NOW if i == 1 else None) for i in range(1, 4)], *[article(i, 2, created=NOW - timedelta(days=2)) for i in (4, 5)])
    assert {r.corporation_id: r.articles for r in stats.articles_by_company(rows).collect()} == {1: 3, 2: 2}
    row = stats.crawl_stats(companies(spark, company(1), company(2), company(3, link="")), rows, lit()).first()
    assert (row.total_corporations, row.total_new_articles, row.last_crawled_at) == (2, 3, NOW)
    assert tuple(stats.crawl_stats(companies(spark), rows, lit()).first())[:2] == (0, 0)
    runs = [(i, f"c{i}", i % 5 != 0, None if i % 5 else "x", NOW, 0, i % 10 if i % 5 else 0) for i in range(1, 101)]
    assert tuple(stats.run_summary(spark.createDataFrame(runs, CRAWL_RESULT)).first()) == (100, 80, 20, 400)
    failures = spark.createDataFrame([(1, "a", True, None, NOW, 3, 3), (None, None, False, "boom", NOW, 0, 0)], CRAWL_RESULT)
    assert stats.run_failures(failures).first().corporation_name == "Unknown"


PAGE = "<article><h2><a href='{}'>{}</a></h2></article>"


def test_ingest(spark):
    sources = companies(spark, company(1, link="https://a.com"), company(2, link="https://b.com"), company(3, link="  "), company(4, link="https://d.com"), company(5, link="https://e.com"), company(6, link="https://f.com"))
    pages = spark.createDataFrame(
        [
            ("https://a.com", PAGE.format("https://a.com/1", "First title") + PAGE.format("https://a.com/1", "First again") + PAGE.format("https://a.com/2", "Second title")),
            ("https://b.com", PAGE.format("https://a.com/2", "Taken title") + PAGE.format("https://b.com/9", "Known title") + PAGE.format("https://b.com/8", "Deleted one")),
            ("https://d.com", "<p>Are you a ROBOT?</p>"),
            ("https://e.com", PAGE.format("https://e.com/1", "x" * 201)),
        ],
        "url string, html string",
    )
    known = articles(spark, article(10, 2, "https://b.com/9"), article(11, 2, "https://b.com/8", deleted=NOW))
    run = ingest.ingest(sources, pages, known, lit())
    found = {r.link: (r.id, r.corporation_id, r.title) for r in run.articles.collect()}
    assert found == {"https://a.com/1": (12, 1, "First title"), "https://a.com/2": (13, 1, "Second title"), "https://b.com/8": (14, 2, "Deleted one")}
    report = {r.corporation_id: (r.success, r.error_message, r.new_articles, r.extracted_articles) for r in run.report.collect()}
    assert report == {1: (True, None, 2, 3), 2: (True, None, 1, 3), 3: (False, ingest.NO_LINK, 0, 0), 4: (False, ingest.CHALLENGE, 0, 0), 5: (False, ingest.TOO_LONG, 0, 0), 6: (False, ingest.NOT_FETCHED, 0, 0)}
    one = ingest.ingest_one(2, sources, pages, known, lit())
    assert [r.corporation_id for r in one.report.collect()] == [2] and one.articles.count() == 2
    again = ingest.ingest(sources, pages, known.unionByName(run.articles), lit())
    assert again.articles.count() == 0
    assert ingest.ingest(sources, pages, known, lit(), enabled=False).report.count() == 0


def test_stream(spark, tmp_path):
    from pressfold.streaming.pages import ingest_stream

    folder = str(tmp_path / "pages")
    write = lambda n: spark.createDataFrame([("https://a.com", PAGE.format(f"https://a.com/{n}", f"Title number {n}"))], "url string, html string").write.mode("append").parquet(folder)
    sources, kept = companies(spark, company(1, link="https://a.com")), []

    def catalogue():
        return sources, articles(spark, *kept)

    def keep(new, report, number):
        kept.extend(tuple(r) for r in new.collect())

    write(1)
    for _ in range(2):
        ingest_stream(spark, folder, str(tmp_path / "state"), catalogue, keep)
    write(1)
    write(2)
    ingest_stream(spark, folder, str(tmp_path / "state"), catalogue, keep)
    assert sorted(r[4] for r in kept) == ["https://a.com/1", "https://a.com/2"]


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path)
    rows = companies(spark, company(1))
    snapshots.write_snapshot(rows, folder, "corporation")
    old = snapshots.read_snapshot(spark, folder, "corporation")
    snapshots.write_snapshot(C.soft_delete(old, 1, NOW), folder, "corporation")
    assert snapshots.read_snapshot(spark, folder, "corporation").first().deleted_at == NOW
    assert old.first().deleted_at is None


def test_queries_on_the_test_tables(spark, data):
    import __spark_entry__ as entry
    from pressfold.plans import catalogue

    for name in catalogue.QUERIES:
        if name not in ("page_extract", "feed_parse"):
            catalogue.QUERIES[name](spark, data).collect()
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_archives(spark):
    post = '<div class="postArticle" data-post-id="1"><a href="#">1</a><a href="#">2</a><a href="#">3</a><a href="{}">4</a><h3>{}</h3></div>'
    bucket = '<div class="timebucket"><a href="{}">x</a></div>'
    m = "https://medium.com/"
    sources = companies(spark, *(company(i, link=f"{m}{n}") for i, n in enumerate("abcde", 1)))
    pages = spark.createDataFrame(
        [
            (m + "a", post.format(m + "no", "Not read"), None), (m + "a/archive", bucket.format(m + "a/1") + bucket.format(m + "a/2"), None),
            (m + "a/1", post.format(m + "x", "First title") + post.format(m + "y", "Second title"), None), (m + "a/2", post.format(m + "x", "Repeated title"), None),
            (m + "b/archive", bucket.format(m + "b/1"), None), (m + "c/archive", bucket.format(m + "c/1"), None), (m + "c/1", None, "timed out"), (m + "d/archive", "<p>no buckets</p>", None), (m + "e/archive", None, "timed out"),
        ],
        "url string, html string, error string",
    )
    run = ingest.ingest(sources, pages, articles(spark), lit())
    assert sorted((r.link, r.title) for r in run.articles.collect()) == [(m + "x", "First title"), (m + "y", "Second title")]
    report = {r.corporation_id: (r.error_message, r.new_articles, r.extracted_articles) for r in run.report.collect()}
    assert report == {1: (None, 2, 3), 2: (ingest.NOT_FETCHED, 0, 0), 3: ("timed out", 0, 0), 4: (None, 0, 0), 5: ("timed out", 0, 0)}
    assert run.rejects.count() == 0


def test_rejected_items(spark, monkeypatch):
    from pressfold.operators import extract

    monkeypatch.setattr(extract, "record", lambda item, site, own=extract.record: own(item, site) if "bad" not in item.text() else 1 / 0)
    found = list(extract.records(PAGE.format("/1", "A good title") + PAGE.format("/2", "A bad title") + PAGE.format("/3", "Another title"), "Default", "https://a.com"))
    assert [(r["title"], r.get("reject")) for r in found] == [("A good title", None), (None, "ZeroDivisionError: division by zero"), ("Another title", None)]


def test_newest_page_of_a_batch(spark, tmp_path):
    from pressfold.streaming.pages import ingest_stream, scheduled

    folder, kept, reports = str(tmp_path / "pages"), [], []
    sources = companies(spark, company(1, link="https://a.com"), company(2, link="https://b.com"))
    rows = [("https://a.com", PAGE.format(f"https://a.com/{n}", f"Title number {n}"), None, None if n == 3 else NOW + timedelta(days=n)) for n in (2, 1, 3)]
    for row in rows:
        spark.createDataFrame([row], "url string, html string, error string, fetched_at timestamp_ntz").write.mode("append").parquet(folder)

    def keep(new, report, number):
        kept.extend(r.link for r in new.collect())
        reports.extend((r.corporation_id, r.success) for r in report.collect())

    run = lambda: ingest_stream(spark, folder, str(tmp_path / "state"), lambda: (sources, articles(spark)), keep)
    assert scheduled(run) and kept == ["https://a.com/2"] and reports == [(1, True)]
    assert not scheduled(run, enabled=False) and not scheduled(lambda: 1 / 0)


def test_writing_and_reading(spark, tmp_path):
    from pressfold.sources import pages, tables
    from pressfold.streaming.pages import first_links

    sources = companies(spark, company(1, link="https://a.com"))
    web = spark.createDataFrame([("https://a.com", PAGE.format("https://a.com/1", "First title"))], "url string, html string")
    run = ingest.ingest(sources, web, articles(spark), lit())
    ingest.append_articles(run, str(tmp_path / "articles"))
    ingest.write_report(run, str(tmp_path / "reports"))
    assert spark.read.schema(ARTICLE).parquet(str(tmp_path / "articles")).first().link == "https://a.com/1"
    assert str(spark.read.parquet(str(tmp_path / "reports")).first().crawled_on) == "2025-06-30"
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "p.html").write_text("<p>\none\n</p>")
    page = pages.page_files(spark, str(tmp_path / "web")).first()
    assert page.url.endswith("p.html") and page.html == "<p>\none\n</p>"
    rows = [(f"l{i % 3}", NOW + timedelta(hours=i)) for i in range(9)]
    spark.createDataFrame(rows, "link string, published_at timestamp_ntz").select("link", F.col("published_at").cast("timestamp").alias("published_at")).write.parquet(str(tmp_path / "links"))
    stream = first_links(spark.readStream.schema("link string, published_at timestamp").parquet(str(tmp_path / "links")))
    stream.writeStream.format("memory").queryName("links_seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.link for r in spark.table("links_seen").collect()) == ["l0", "l1", "l2"]
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).selectExpr("cast(id as int) as id").write.jdbc(url, "numbers", properties=driver)
    for split in (None, ("id", 0, 100, 4)):
        read = tables.jdbc_table(spark, url, "numbers", properties=driver, split=split).where("id >= 90")
        assert read.count() == 10 and "PushedFilters: [*IsNotNull" in read._jdf.queryExecution().executedPlan().toString()


def test_calls(spark):
    industries, links = spark.createDataFrame([(1, "a")], INDUSTRY), spark.createDataFrame([(1, 1, 1, NOW)], CORPORATION_INDUSTRY)
    rows = companies(spark, *(company(i, f"c{i}", created=NOW + timedelta(hours=i)) for i in range(1, 14)), company(20, "gone", deleted=NOW))
    page = C.page_of(rows, links, industries, page=1)
    assert [r["id"] for r in page["content"]] == [3, 2, 1] and page["content"][2]["industries"] == ["a"]
    assert (page["total_elements"], page["total_pages"], page["has_next"], page["has_previous"]) == (13, 2, False, True)
    assert C.page_of(rows, links, industries, search="c1")["total_elements"] == 5
    assert C.answered("GET", lambda: C.get(rows, links, industries, 2))[0] == 200
    assert C.answered("GET", lambda: C.get(rows, links, industries, 20)) == (404, None)
    assert C.answered("POST", lambda: C.create(rows, links, industries, C.CompanyForm("c1"), NOW)) == (400, {"message": "c1"})
    assert C.answered("POST", lambda: C.create(rows, links, industries, C.CompanyForm(""), NOW)) == (400, {"name": "must not be blank"})
    assert C.answered("POST", lambda: C.create(rows, links, industries, C.CompanyForm("new"), NOW)[0]) == (201, 21)
    assert C.answered("DELETE", lambda: C.soft_delete(rows, 20, NOW))[0] == 400
    assert C.answered("GET", lambda: C.page_of(rows, links, industries, page=-1))[0] == 400
