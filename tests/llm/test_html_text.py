import time

from tallyloom.llm import html_text as H

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T &amp; more</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header class="top"><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> -->'
    '<div class="ad">Buy {i}</div><article><h1>Title {i}</h1><p><b>First\n {i} &amp; so&nbsp;on.<br><p>Second &lt;b&gt; {i}</p><aside>Note</aside>'
    '<form><input name="q"><label>Find</label></form><p>Third <i>it</i>al</p><section id="comments"><p>Nice!</p></section></article><div class="cookie-notice">OK?</div>'
    "<footer>&copy; site</footer></body></html>"
)


def want(i):
    return f"Title {i}\nFirst {i} & so on.\nSecond <b> {i}\nThird ital"


def plain(i):
    return f"<html><body><div>Welcome to the site</div><div>Menu of today</div><div><p>Story {i} tells.</p><p>More {i}.</p></div><div>All rights reserved</div></body></html>"


def test_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i)), "x") for i in range(6)]
    rows += [(10, "http://one.example/", PAGE.replace("{i}", "10"), "y"), (11, None, None, None), (12, "http://h.example/x", "", ""), (13, "u", "<p>a < b &am c", ""), (0, "http://h.example/0", PAGE.replace("{i}", "0"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(pages, keep=["page_id"]).collect()))
    texts = [(i, want(i)) for i in range(6)] + [(0, want(0)), (10, want(10)), (11, ""), (12, ""), (13, "a < b &am c")]
    assert got == sorted((i, t, len(t)) for i, t in texts)


def test_repeated_text_is_template_where_no_article_is_marked(spark):
    rows = [(i, f"https://p.example:8080/{i}?x", plain(i)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == {i: f"Story {i} tells.\nMore {i}." for i in range(5)}


def test_repeated_blocks_inside_the_article_are_template(spark):
    line = 'Subscribe to our <a href="/s">letter</a>, now and for ever. ' + "More of this line. " * 20
    page = lambda i: f"<html><body><article><h1>Head {i}</h1><p>{line}</p><p>Story {i} of <b>many</b>.</p>" + f"<p>Also {i}.</p>" * (i % 3) + "</article></body></html>"
    rows = [(i, "http://a.example/", page(i)) for i in range(5)] + [(9, "http://a.example/9", page(4))]
    rows += [(20 + i, "http://copies.example/", page(7)) for i in range(4)]  # one page, four times: nothing can be told from it
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = lambda i: "\n".join([f"Head {i}", f"Story {i} of many.", *[f"Also {i}."] * (i % 3)])
    assert {i: got[i] for i in (0, 1, 2, 3, 4, 9)} == {i: want(i) for i in range(5)} | {9: want(4)}
    assert all("Subscribe to our letter" in got[i] and "Story 7 of many." in got[i] for i in range(20, 24))


def test_text_beside_a_teaser_stays(spark):
    page = lambda i: f"<html><body><div>Menu of today</div><div><p>A long story {i} that no article holds.</p><p>End {i}.</p></div><article>Teaser {i}</article></body></html>"
    rows = [(i, "http://t.example/", page(i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"A long story {i} that no article holds.\nEnd {i}.\nTeaser {i}" for i in range(5)}
    assert H.main_text("<div>Home</div><article>This is the story.</article><div>Imprint</div>") == "This is the story."


def test_length_decides_nothing_beside_an_article():
    legal = "All rights reserved by the owner of this site. " * 12
    page = f'<div id="top-links">Home World</div><article>Short news of today.</article><div class="legal">{legal}</div>'
    assert H.main_text(page) == "Short news of today."


def test_bylines_and_headings_of_few_pages_stay(spark):
    page = lambda i: f"<html><body><nav>Home</nav><article><h1>Head {i}</h1><p>By Jane Roe</p><h2>What happened</h2><p>Story {i} is told.</p></article></body></html>"
    for n in (3, 8):
        got = H.extract(spark.createDataFrame([(i, "http://j.example/", page(i)) for i in range(n)], "page_id long, url string, html string")).collect()
        byline = "By Jane Roe\n" if n == 3 else ""  # on eight pages of eight it is the host's, like a notice
        assert {r["page_id"]: r["text"] for r in got} == {i: f"Head {i}\n{byline}What happened\nStory {i} is told." for i in range(n)}


def test_common_names_of_what_is_no_article():
    text = "<h1>Head</h1><p>Story.</p>"
    for name in ("comments-area", "comment-list", "comments-section", "post-comments", "comment-body", "site-footer", "main-nav", "cookie-bar", "subscribe-box", "ad-container", "related-posts", "share-buttons", "widget-area"):
        assert H.main_text(f'<article>{text}<div class="{name}"><p>Other</p></div></article>') == "Head\nStory.", name
    for mark in ('id="search"', 'class="post-header"', 'class="page-content"', 'class="article-list"', 'class="main-content"'):
        assert H.main_text(f"<article>{text}<section {mark}><h2>Search for the wreck</h2></section></article>") == "Head\nStory.\nSearch for the wreck", mark


def test_names_that_only_contain_a_listed_word_drop_nothing():
    text = "<h1>Head</h1><p>Story.</p>"
    for page in (
        f'<body class="has-sidebar">{text}</body>',
        f'<html class="banner"><body class="search"><article class="post comments-open comment">{text}</article></body></html>',
        f'<main id="search-results">{text}</main>',
        f'<main id="search">{text}</main>',
        f'<div class="no-banner">{text}</div>',
        '<article><div class="article-header"><h1>Head</h1></div><div class="header"><p>Story.</p></div></article>',
        f'<div class="search" id="widget"><main>{text}</main></div>',
    ):
        assert H.main_text(page) == "Head\nStory.", page
    for name in ("ad", "post sidebar", "ad-banner", "ad_2", "cookie-notice"):
        assert H.main_text(f'{text}<div class="{name}">Buy</div>') == "Head\nStory.", name
    nested = f'<article>{text}<section id="comments"><article>Nice!</article></section></article>'
    assert H.main_text(nested) == "Head\nStory."


def test_invalid_classes_are_not_used():
    t = {1: (7, 0.0), 2: (7, 1.0), 3: (8, 0.5), 4: (8, 3.0)}
    assert H.valid_tokens([1, 2, 9, 1, 2], t) == {0, 1, 3, 4}
    assert H.valid_tokens([2, 1], t) == set()
    assert H.valid_tokens([1, 3, 4, 2], t) == {0, 1, 2, 3}
    assert H.valid_tokens([1, 3, 2, 4], t) == {0, 2}


def test_hostile_pages_take_no_time():
    began = time.time()
    for page in ("<a" * 200_000, "<a " * 100_000 + '">"', "<a '" * 100_000 + ">", '<a ""' * 100_000 + '">"', "<a <b '" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<a x='\">" * 50_000, '<a b="' + "<i>" * 100_000, "<" * 400_000):
        H.main_text(page)
    assert time.time() - began < 60


def test_tags_with_quotes():
    assert H.main_text('<p title="a > b">One</p><p title=\'x" > y\'>Two</p>') == "One\nTwo"
    assert H.main_text('<p>a <b title="open>bold</b> c') == "a bold c"
    assert H.main_text('1 < 2 and <a "x" and more') == '1 < 2 and <a "x" and more'


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
