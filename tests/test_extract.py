"""Pages and feeds: what is taken, what is left out, and how dates are read."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressfold.functions.html import parse
from pressfold.operators import extract, feeds

NOW = datetime(2025, 6, 30, 12)
BLOG, TISTORY = "https://test-blog.com", "https://test.tistory.com"


def run(spark, html, blog=BLOG, provider="Default"):
    pages = spark.createDataFrame([(1, blog, blog, provider, html)], "corporation_id bigint, blog_link string, page_url string, provider string, html string")
    return extract.settled(extract.raw_records(pages), F.lit(NOW).cast("timestamp_ntz")).orderBy("ordinal").collect()


def test_default_basic(spark):
    html = """<div class="post"><h2><a href="/one">First long title</a></h2><p class="excerpt">Short one</p></div>
    <article><h3><a href="/two">Second long title</a></h3><div class="content">Text <b>two</b></div></article>"""
    found = run(spark, html)
    assert [(r.title, r.link, r.summary) for r in found] == [("First long title", BLOG + "/one", "Short one"), ("Second long title", BLOG + "/two", "Text two")]
    assert all(r.published_at == NOW for r in found)


def test_default_classes(spark):
    html = """<div class="blog-post"><h2><a href="/a">Blog post title</a></h2></div>
    <div class="entry"><h3 class="entry-title"><a href="/b">Entry title here</a></h3></div><div class="item"><h4><a href="/c">Item title here</a></h4></div>"""
    found = run(spark, html)
    assert {r.title for r in found} == {"Blog post title", "Entry title here", "Item title here"}
    assert len(found) == 4 and len({r.link for r in found}) == 3


def test_default_image_and_drops(spark):
    found = run(spark, '<article><h2><a href="/x">A good title</a></h2><img src="/img.png"></article>')
    assert found[0].thumbnail_image == BLOG + "/img.png"
    assert run(spark, "<article><h2></h2><a>No link here</a></article>") == []
    assert run(spark, '<article><h2><a href="/x">ab</a></h2></article>') == []
    assert run(spark, '<article><h2><a href="x/y">A good title</a></h2></article>') == []


def test_long_summary(spark):
    for provider, blog in (("Default", BLOG), ("Tistory", TISTORY)):
        found = run(spark, f'<article><h2><a href="/x">A good title</a></h2><p>{"a" * 250}</p></article>', blog, provider)
        assert len(found[0].summary) == 203 and found[0].summary.endswith("...")


def test_dates_of_the_default_provider(spark):
    item = '<article><h2><a href="/x">A good title</a></h2>{}</article>'
    assert run(spark, item.format("<time>2024-05-06</time>"))[0].published_at == datetime(2024, 5, 6)
    assert run(spark, item.format("<time>yesterday</time>")) == []
    assert run(spark, item.format("<time>2024-02-31</time>")) == []
    naver = run(spark, item.format("<dl><dt>x<dd>2024.05.06<dd>other</dl>"), "https://d2.naver.com/home")
    assert naver[0].published_at == datetime(2024, 5, 6)


def test_special_sites(spark):
    kakao = run(spark, '<article><a href="https://tech.kakao.com/blog/posts/1"><h4>Kakao title</h4></a><dd class="txt_date">2024.01.02</dd></article>', "https://tech.kakao.com/blog")
    assert (kakao[0].link, kakao[0].published_at) == ("https://tech.kakao.com/posts/1", datetime(2024, 1, 2))
    toss_item = '<a class="css-1qr3mg1" href="/article/1"><img src="/1.png"><img src="/2.png"><span class="typography--h6">Toss title</span>{}</a>'
    toss = run(spark, toss_item.format('<span class="typography--small">2024년 3월 4일 · 홍</span>'), "https://toss.tech/")
    assert (toss[0].link, toss[0].thumbnail_image, toss[0].published_at) == ("https://toss.tech/article/1", "https://toss.tech/2.png", datetime(2024, 3, 4))
    assert run(spark, toss_item.format(""), "https://toss.tech/") == []
    aws_item = '<article class="blog-post"><h2><span property="name headline">Aws title</span></h2><a href="https://aws.amazon.com/x">more</a>{}</article>'
    aws = run(spark, aws_item.format('<time datetime="2024-03-04T21:00:00-08:00">x</time>'), "https://aws.amazon.com/blogs")
    assert aws[0].published_at == datetime(2024, 3, 4, 21)
    assert run(spark, aws_item.format('<time datetime="2024-03-04">x</time>'), "https://aws.amazon.com/blogs") == []
    google = run(
        spark,
        '<div class="search-result__wrapper"><p class="search-result__eyebrow">2025년 6월 18일 / Cloud</p><h3 class="search-result__title"><a href="/ko/x">Google title</a></h3></div>',
        "https://developers.googleblog.com/ko/search",
    )
    assert (google[0].link, google[0].published_at) == ("https://developers.googleblog.com/ko/x", datetime(2025, 6, 18))


def test_tistory(spark):
    html = '<article><h2><a href="/1">One</a></h2></article><div class="item_post"><h3><a href="/2">Two</a></h3><img src="x.png"></div><div class="entry-content"><h4><a href="/3">Three</a></h4></div>'
    found = run(spark, html, TISTORY, "Tistory")
    assert [(r.title, r.link) for r in found] == [("One", TISTORY + "/1"), ("Two", TISTORY + "/2"), ("Three", TISTORY + "/3")]
    assert found[1].thumbnail_image == "x.png"
    assert run(spark, "<article><h2></h2></article>", TISTORY, "Tistory") == []


def test_medium(spark):
    html = """<div class="postArticle" data-post-id="1"><a href="/1">1</a><a href="/2">2</a><a>no</a><a href="/3">3</a><a href="/4">4</a>
    <h3>Medium title</h3><img class="progressiveMedia-image" src="https://m.com/resize:fill:30:40/x.png"><time datetime="2024-01-02T03:04:05.000Z">x</time></div>"""
    found = run(spark, html, "https://medium.com/x", "Medium")
    assert (found[0].link, found[0].thumbnail_image, found[0].published_at) == ("https://medium.com/x/4", "https://m.com/x.png", datetime(2024, 1, 2, 3, 4, 5))
    assert extract.bucket_links('<div class="timebucket u-x"><a href="/2024">2024</a></div><div class="timebucket"></div>') == ["/2024"]


def test_bad_input(spark):
    for html in (None, "", "<", "<article><h2><a href='/x'>A good title", "<p>" * 5000, "plain text"):
        run(spark, html)
    assert run(spark, "<article><h2><a href='/x'>A good title")[0].title == "A good title"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/ap=\"' bdiv&;", max_size=200))
def test_any_markup_parses(html):
    parse(html).text()


def test_selectors():
    page = parse("<div class='A b'><p>one<p>two<br>three<script>x()</script></div><span title='hello'></span>")
    assert page.first(".a").tag == "div" and len(page.select("p")) == 2
    assert page.first("h1, span[title*='ELL']").get("title") == "hello"
    assert page.first("div").text() == "one two three"


RSS = """<?xml version="1.0"?><rss><channel><item><title> First title </title><link>https://a/1</link><description>&lt;p&gt;Text&nbsp;here&lt;/p&gt;</description>
<pubDate>Wed, 02 Oct 2024 13:00:00 GMT</pubDate></item><item><title>abc</title><link>https://a/2</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom title</title><link href="https://a/3"/><updated>2024-10-02T13:00:00+02:00</updated></entry></feed>'


def test_feeds(spark):
    bodies = spark.createDataFrame([("https://a/rss", f"<html id='xml-viewer'>{RSS}</html>"), ("https://a/feed", "<html>no</html>"), ("https://a/atom.xml", ATOM)], "url string, body string")
    companies = spark.createDataFrame([(1, "https://a/")], "id bigint, blog_link string")
    tried = feeds.candidates(companies)
    assert tried.count() == 10
    best = feeds.first_feed(tried, bodies)
    assert best.first().feed_url == "https://a/rss"
    found = feeds.feed_records(best, F.lit(NOW).cast("timestamp_ntz"), "Asia/Seoul").collect()
    assert [(r.title, r.link, r.summary, r.published_at) for r in found] == [("First title", "https://a/1", "Text here", datetime(2024, 10, 2, 22))]
    other = spark.createDataFrame([(1, "u", ATOM), (2, "u", "<rss>"), (3, "u", None)], "corporation_id bigint, feed_url string, body string")
    assert [r.published_at for r in feeds.feed_records(other, F.lit(NOW).cast("timestamp_ntz")).collect()] == [datetime(2024, 10, 2, 11)]


@pytest.mark.parametrize(("link", "provider"), [("https://x.tistory.com", "Tistory"), ("https://medium.com/x", "Medium"), ("https://d2.naver.com", "Default"), ("", "Default"), (None, "Default")])
def test_dispatch(spark, link, provider):
    from pressfold.functions.text import provider_of

    rows = spark.createDataFrame([(link,)], "blog_link string")
    assert rows.select(provider_of(F.col("blog_link"))).first()[0] == provider
