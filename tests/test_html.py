from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from contactloom.functions import html, phone
from contactloom.operators import extract, links

PAGE = """<!DOCTYPE html><html><head><title>Call 2025550199</title><style>p{width:2025550198px}</style>
<script>var n = "2025550197"; if (a<b) {}</script></head><body>
<!-- <a href="/contact/old">202-555-0196</a> --><nav><ul><li><a class="x" href="/Contact">Us</a></li>
<li><A HREF='/a?x=1&amp;y=2'>q</A></li><li><a href=/bare>q</a><abbr href="/no">n</abbr></li>
<a href="tel:tel:+1 (202) 555-0100">t</a><a href='&#116;el:2025550101'>t</a><a href="TEL:2025550102">t</a>
<a data-href="/no2" href="">e</a></nav>
<div>Ring 202-<b>555</b>-0103 or (202)&nbsp;555-0104<br>&#40;202) 555&#45;0105</div>
<p>4465758382889437</p><td>202.555.0106</td><p>x &#169; 12345 &amp;#49; &#x32;025550107</p></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "https://a.example.com/x/y", PAGE)], "page_id long, url string, html string")


def test_page_links(page):
    rows = links.page_links(page, "url").orderBy("link_ord").collect()
    assert [r.href for r in rows] == [
        "/Contact", "/a?x=1&y=2", "/bare", "tel:tel:+1 (202) 555-0100", "tel:2025550101",
        "TEL:2025550102", "",
    ]
    assert [r.link_ord for r in rows] == list(range(7))


def test_tel_numbers_come_after_the_last_tel(page):
    rows = extract.tel_link_numbers(links.page_links(page, "url"), "url").collect()
    assert [r.raw for r in rows] == ["+1 (202) 555-0100", "2025550101"]


def test_text_blocks(page):
    texts = [r.text.strip() for r in extract.text_blocks(page, "url").orderBy("block_ord").collect()]
    assert "Ring 202-555-0103 or (202) 555-0104" in texts
    assert "(202) 555-0105" in texts and "202.555.0106" in texts
    assert "x © 12345 &#49; 2025550107" in texts
    assert not any("0199" in t or "0198" in t or "0197" in t or "0196" in t for t in texts)


def test_numbers_of_a_page_in_order(page):
    found = extract.numbers_of_pages(page, "url").first()
    assert found.numbers == [
        "+12025550100", "2025550101", "2025550104", "2025550103", "2025550105", "4465758382",
        "2025550106", "2025550107",
    ]
    assert found.zips == ["12345"]


def test_parent_filter_leaves_tel_links_only(page):
    found = extract.numbers_of_pages(page, "url", parent_filter=True).first()
    assert found.numbers == ["+12025550100", "2025550101"]


def test_explode_path_and_array_path_agree(spark, page):
    blocks = extract.text_blocks(page, "url")
    ranked = extract.pattern_candidates(blocks, "url", "block_ord").transform(
        extract.format_candidates
    ).transform(extract.check_candidates).filter("valid").orderBy(
        "block_ord", "pattern_ord", "match_ord"
    ).collect()
    tel = ["+12025550100", "2025550101"]
    want = list(dict.fromkeys(tel + [r.number for r in ranked]))
    assert extract.numbers_of_pages(page, "url").first().numbers == want


QUOTED = [
    '<p>x<a title="a > b" href="/contact">Us</a>y', """<a onclick="()=>x()" href='tel:2025550101'>t</a>""", "<a title='>' class=\"b>c\" href=/bare>q</a>",
    '<a title="x href=/no >" href="/yes">q</a>', '<a href="/a>b" title=">">q</a>', '<p data-x="1 > 2025550109">in</p><div title=\'">"\'>out</div>',
    '<a data-q = "it\'s >" href = "/spaced">q</a>', "<b title='>'>bold</b> plain <img alt=\"a>b\">", "<a it's href='/odd'>q</a> rest", '<a title="no > link">q</a>',
]


def test_quoted_values_hold_tag_ends(spark):
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.text = [], ""

        def handle_starttag(self, tag, attrs):
            self.links += [v for k, v in attrs if tag == "a" and k == "href"]

        def handle_data(self, data):
            self.text += data

    df = spark.createDataFrame(list(enumerate(QUOTED)), "page_id long, html string")
    got = {i: [] for i in range(len(QUOTED))}
    for r in links.page_links(df, "page_id").orderBy("page_id", "link_ord").collect():
        got[r.page_id].append(r.href)
    texts = {i: "" for i in got}
    for r in extract.text_blocks(df, "page_id").orderBy("page_id", "block_ord").collect():
        texts[r.page_id] += r.text
    for i, html in enumerate(QUOTED):
        reader = Reader()
        reader.feed(html)
        reader.close()
        assert (got[i], texts[i]) == (reader.links, reader.text), html
    assert [n for r in extract.numbers_of_pages(df, "page_id").collect() for n in r.numbers] == ["2025550101"]


@pytest.mark.parametrize("html", ["<a title=\"" * 50000, "<a x='> " * 1 + "<a y=\"" + "<a z=" * 50000, "<a href " * 50000, "<a " + "b=\"c>\" " * 50000])
def test_quotes_stay_linear(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    assert links.page_links(df).count() == 0 and extract.numbers_of_pages(df).count() == 0


def test_an_unclosed_quote_ends_with_its_tag(spark):
    df = spark.createDataFrame([('<a title="x href=/y>q</a><p>2025550101</p>',)], "html string")
    assert extract.numbers_of_pages(df).first().numbers == ["2025550101"]


@pytest.mark.parametrize(
    "html",
    ["<!-- 2025550100", "<script>2025550100", "<a href", "<p", "<" * 50000, "<a " * 20000,
     "<p x='" + "y" * 100000, "&#" * 20000, "<b>" * 30000, "a" * 200000],
)
def test_broken_pages_give_nothing_and_do_not_fail(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    assert extract.numbers_of_pages(df).count() == 0
    assert links.page_links(df).count() == 0


@pytest.mark.parametrize(
    "url, kept",
    [("https://a/x.PDF", False), ("https://a/x.pdf?x=1", True), ("https://a/x.js", False),
     ("https://a/xjs", True), ("https://a/x.css\n", True), ("https://a/x.7z", False)],
)
def test_unwanted_extensions(spark, url, kept):
    df = spark.createDataFrame([(url,)], "url string")
    assert (links.drop_unwanted_extensions(df).count() == 1) == kept


def test_link_filters(spark):
    hrefs = ["/Contact", "https://blog.x.com", "/products", "https://facebook.com/contact",
             "https://Facebook.com/contact", "/SERVICES", "https://t.co/help"]
    df = spark.createDataFrame([(h,) for h in hrefs], "href string")
    relevant = [r.href for r in links.relevant_links(df).collect()]
    assert relevant == [h for h in hrefs if h != "/products"]
    social = [r.href for r in links.not_social_links(df).collect()]
    assert social == [h for h in hrefs if h != "https://facebook.com/contact"]
    internal = df.select(links.is_internal(F.col("href"), F.lit("https://blog")).alias("i")).collect()
    assert [r.i for r in internal] == [True, True, True, False, False, True, False]


BASES = ["https://a.com", "https://a.com/", "https://a.com/x/y", "https://a.com/x/?q=1/2", "https://a.com/x#f/g",
         "https://a.com?q"]
HREFS = ["/c", "c/d", "?p=1", "#top", "", "//b.com/e", "https://b.com/f#g", "HTTP://b.com", "/c#x", "c?a=b:c",
         "./about", "../support", "a/../b", "../../../up", "/x/./y/..", ".", "..", "/a/b/../../c?d=../e", "x/..?q=1", "...", "/.hidden",
         "https://b.com/a/../b", "//b.com/a/../b"]


@pytest.mark.parametrize("base", BASES)
def test_resolve_like_the_standard_library(spark, base):
    df = spark.createDataFrame([(base, h) for h in HREFS], "base string, href string")
    got = {r.href: r.target for r in links.follow(df, "base").collect()}
    want = {h: urldefrag(urljoin(base, h))[0] for h in HREFS}
    want["HTTP://b.com"] = "HTTP://b.com"  # the scheme's case is kept
    assert got == want


def test_links_that_are_no_pages_are_not_followed(spark):
    df = spark.createDataFrame([("https://a.com", h) for h in
                                ["mailto:help@a.com", "tel:1", "javascript:help()", "/contact.pdf"]],
                               "base string, href string")
    assert links.follow(df, "base").count() == 0


def test_numeric_entities_of_any_length(spark):
    from html import unescape

    from contactloom.functions.html import decode_entities

    texts = ["&#50;&#x32;", "&#12345678901;5", "&#x110000;a", "&#xFFFFFFFFFFFFFFFF;z", "&#0000000000000050;2", "&#x;", "&#;", "&#99999999", "&#1114111;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(decode_entities(F.col("t"))).collect()]
    want = [unescape(t) for t in texts]
    want[8] = "\U0010ffff"  # which Python leaves out
    assert got == want


def test_digit_runs_of_a_page_in_one_scan(spark):
    """The blocks' digit runs are those of each block on its own, encoded or not."""
    texts = [
        "", "no digits\u0001\u0001", "Call 202-555-0199 or 3125550142\u0001555 01\u0001(202) 555-0100", "202-555-\u00010199\u0001",
        "Call 202&nbsp;555&#45;0199\u0001&#53;125550142\u000112&#5\u00015550142 2025550142\u0001a &amp; b", "&#1;2025550142|3125550142", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    kept = F.transform(html.blocks(F.col("text")), lambda b: html.decode_entities(b))
    each = phone.valid_numbers(None, kept)
    once = phone.valid_numbers(None, None, phone.runs_of_blocks(html.digit_text(F.col("text")), html.BLOCK_MARK))
    found = rows.select(each.alias("each"), once.alias("once")).collect()
    assert [r["once"] for r in found] == [r["each"] for r in found]
    assert found[2]["once"] == ["2025550199", "3125550142", "2025550100"] and found[3]["once"] == []


def test_pages_are_read_without_their_links_where_only_numbers_count(spark, page):
    """The same numbers and zips; links are looked for only in pages that may hold a tel: link."""
    more = spark.createDataFrame(
        [(2, "u", '<a href="/x?a&amp;b">a</a><p>202&nbsp;555&period;0100 10001</p>'), (3, "v", "<p>none</p>"), (4, "w", None)],
        "page_id long, url string, html string",
    )
    pages = page.unionByName(more)
    read = extract.numbers_of_all_pages(pages, "page_id")
    both = extract.numbers_and_links(pages, "page_id")
    assert sorted(map(str, read.collect())) == sorted(map(str, both.drop("links").collect()))
    plan = extract.numbers_of_all_pages(more.repartition(2), "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN (Contains(visible" in plan and plan.count("regexp_extract_all(visible") == 1


def test_names_are_replaced_only_where_there_is_one(spark):
    texts = ["a &amp; b", "&amp;nbsp;", "&#38;nbsp;1", "2&nbsp;&amp;&lpar;", "&unknown;", "&", "&amp", "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(html.decode_entities(F.col("t"))).collect()]
    assert got == ["a & b", "&nbsp;", " 1", "2 &(", "&unknown;", "&", "&amp", "none", None]


def test_relevant_words_are_found_anywhere_in_any_case(spark):
    from contactloom.functions.fixed_values import LINK_KEYWORDS

    df = spark.createDataFrame([(f"x{a}{word[:1]}{b}{word.upper()}y",) for word in LINK_KEYWORDS for a in "cs" for b in ("", "a")], "href string")
    assert links.relevant_links(df).count() == df.count()
    assert links.relevant_links(spark.createDataFrame([("/product",), ("/cal",), ("",)], "href string")).count() == 0
