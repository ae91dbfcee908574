"""Nested elements against a tree built with html.parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from contactloom.functions import elements
from contactloom.operators import extract
from tests import model

EVERY = set(elements.TEXT_TAGS + elements.STRUCTURE_TAGS)


class Tree(HTMLParser):
    """Text and elements of a page, by the rules that the module's docstring gives."""

    def __init__(self):
        super().__init__()
        self.text, self.stack, self.done, self.ord, self.beyond = "", [], [], 0, 0

    def close_from(self, n):
        for i in range(n, len(self.stack)):
            ord_, tag, start = self.stack[i]
            self.done.append((ord_, tag, start, len(self.text), self.stack[i - 1][0] if i else -1))
        del self.stack[n:]

    def handle_starttag(self, tag, attrs):
        if tag not in EVERY:
            return
        closes = elements.CLOSES.get(tag) or (["p"] if tag in elements._BLOCKS else [])
        while self.stack and self.stack[-1][1] in closes:
            self.close_from(len(self.stack) - 1)
        if len(self.stack) >= elements.MAX_DEPTH:
            self.beyond += 1
        else:
            self.stack.append((self.ord, tag, len(self.text)))
        self.ord += 1

    def handle_startendtag(self, tag, attrs):
        if tag in EVERY:
            closes = elements.CLOSES.get(tag) or (["p"] if tag in elements._BLOCKS else [])
            while self.stack and self.stack[-1][1] in closes:
                self.close_from(len(self.stack) - 1)
            self.ord += 1

    def handle_endtag(self, tag):
        if tag not in EVERY:
            return
        self.ord += 1
        if self.beyond:
            self.beyond -= 1
            return
        at = max((i for i, x in enumerate(self.stack) if x[1] == tag), default=None)
        strength = elements.STRENGTH.get
        if at is not None and not any(strength(x[1], 1) > strength(tag, 1) for x in self.stack[at + 1 :]):
            self.close_from(at)

    def handle_data(self, data):
        self.text += data


def tree(html):
    t = Tree()
    t.feed(html)
    t.close()
    t.close_from(0)
    return t.text, sorted(t.done)


def random_pages(n):
    rng = random.Random(8)
    tags = ["p", "p", "div", "div", "li", "ul", "span", "b", "a", "td", "tr", "table", "section", "h2", "strong", "dt", "dd", "br"]
    words = ["202", "555", "0143", "2025550143", "-", " ", "call ", "(312) 555-0100", "10001", "+1", "é😀", "&amp;", "&#50;", "&nbsp;", "x"]
    pages = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 120)):
            kind = rng.random()
            tag = rng.choice(tags)
            parts.append(
                f"<{tag}>" if kind < 0.3 else f"</{tag}>" if kind < 0.55 else f"<{tag} class='a > b' />" if kind < 0.58
                else f"<{tag.upper()} id=x>" if kind < 0.62 else rng.choice(words)
            )
        pages.append("".join(parts))
    return pages


PAGES = [
    "", "no tags 2025550143", "<div>Call <section><p>202-555-</p><p>0143</p></section> or <span>x</span></div>",
    "<ul><li>One<li>Two<ul><li>in</ul>rest</ul><p>a<p>b<div>c</p>d</div>", "</div></p>x<div>y", "<table><tr><td><p>a</div>b<td>c</table>d",
    "<div><div><div>2025550143</div>55</div>5</div>", "<p>2025550143<span>1</span></p>", "<span><p>202</span>555</p>0143",
    "<div>" * 300 + "2025550143" + "</div>" * 300 + "<p>3125550143</p>", "<p>" * 2000 + "<li>" * 500 + "2025550143",
]


@pytest.fixture(scope="module")
def pages(spark):
    listed = PAGES + random_pages(400)
    return listed, spark.createDataFrame(list(enumerate(listed)), "page_id long, html string").repartition(4)


def test_elements_equal_the_tree(pages):
    listed, df = pages
    got = df.select("page_id", elements.text_and_elements(F.col("html")).alias("p")).collect()
    for r in got:
        assert (r.p.text, [tuple(e) for e in r.p.elements]) == tree(listed[r.page_id]), listed[r.page_id][:300]


def test_texts_of_elements_and_of_those_around_them(pages):
    listed, df = pages
    want = set()
    for i, page in enumerate(listed):
        text, found = tree(page)
        by_ord = {e[0]: e for e in found}
        for ord_, tag, start, end, parent in found:
            if tag in elements.TEXT_TAGS:
                around = text if parent < 0 else text[by_ord[parent][2] : by_ord[parent][3]]
                want.add((i, ord_, tag, text[start:end], around))
    rows = extract.element_texts(df, "page_id").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_numbers_of_nested_elements_equal_the_model(pages):
    listed, df = pages
    got = {r.page_id: (r.numbers, r.zips) for r in extract.numbers_of_elements(df, "page_id").collect()}
    split = 0
    for i, page in enumerate(listed):
        text, found = tree(page)
        texts = [text[s:e] for _, tag, s, e, _ in found if tag in elements.TEXT_TAGS]
        numbers = list(dict.fromkeys(n for t in texts for n in model.numbers(t)))
        zips = list(dict.fromkeys(z for t in texts for z in model.zips(t)))
        assert got.get(i, ([], None))[0] == numbers, page[:300]
        assert not numbers or got[i][1] == zips
        split += bool(numbers)
    assert split > 50
    assert got[2][0] == ["2025550143"]


def test_every_text_match_stands_in_the_text_around_its_element(pages):
    """Which is why the parent filter leaves tel: links only."""
    _, df = pages
    texts = extract.element_texts(df, "page_id").withColumn("at", F.col("element_ord"))
    raw = extract.pattern_candidates(texts, "page_id", "element_ord", "parent_text")
    assert raw.count() > 100 and extract.outside_parent(raw).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 60_000, "<p><b>" * 40_000 + "</p>" * 40_000, "<li>2025550143" * 20_000, "</div>" * 100_000])
def test_hostile_pages_are_linear(spark, page):
    df = spark.createDataFrame([(page,)], "html string")
    assert len(extract.numbers_of_elements(df).collect()) <= 1


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_made_once(spark):
    """Runs of a text are found by one expression, and a mark needs no second reading of the pages."""
    df = spark.createDataFrame([(1, "<div>202-555-0143</div>"), (2, None), (3, "<p>x")], "page_id long, html string")
    texts = extract.element_texts(df.repartition(2), "page_id").withColumn("at", F.col("element_ord"))
    raw = extract.pattern_candidates(texts, "page_id", "element_ord", "parent_text")
    assert _plan(raw).count("array_join(regexp_extract_all") == 1
    marked = extract.outside_parent(raw, mark="left").collect()
    assert [(r.page_id, r.pattern_ord, r.raw, r.left) for r in marked] == [
        (1, 2, "202-555-0143", False), (1, 6, "202-555-0143", False)
    ]
    gone = raw.withColumn("parent_text", F.lit("elsewhere"))
    assert [r.left for r in extract.outside_parent(gone, mark="left").collect()] == [True, True]
    assert extract.outside_parent(gone).count() == 2


def test_nested_parent_filter_reads_its_pages_once(spark, tmp_path):
    from checks import registry

    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert _plan(registry.nested_parent_filter(spark, str(tmp_path))).count("Scan parquet") == 1


def test_a_machine_of_many_steps_is_no_expression(spark):
    """The stack was an aggregate over tags, hundreds of interpreted expressions for each."""
    df = spark.createDataFrame([("<div><p>a</p></div>",)], "html string").repartition(1)
    plan = _plan(df.select(elements.page_elements(F.col("html")).alias("p")))
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
