import random

import pytest
from pyspark.sql import functions as F

from contactloom.operators import extract, links, rollup
from contactloom.plans import contacts

SITES = 12
PATHS = ["contact/1", "about/2", "products/3", "support/4.pdf", "blog/5"]


def number(rng) -> str:
    return f"{rng.choice(['202', '416', '312'])}-555-{rng.randint(0, 9):04d}"


@pytest.fixture(scope="module")
def web():
    """Seeds, pages (with copies of urls) and postal rows; site 0 has a third of all pages."""
    rng = random.Random(3)
    seeds = [(i, f"s{i}.example.com") for i in range(SITES)] + [(SITES, "s1.example.com")]
    pages = []

    def page(url, links=()):
        body = "".join(f'<a href="{h}">x</a>' for h in links)
        body += "".join(f"<p>{number(rng)}</p>" for _ in range(rng.choice([0, 0, 1, 1, 2])))
        if rng.random() < 0.3:
            body += f"<p>{rng.choice(['10001', '20002', '99999'])}</p>"
        pages.append((len(pages), url, f"<html><body>{body}</body></html>"))

    for i in range(SITES):
        many = [f"/contact/{k}" for k in range(40)] if i == 0 else []
        tel = ["tel:3125550100", "tel:4165550101", "tel:2025550102"] if i % 4 == 3 else []
        links = [f"/{p}" for p in PATHS] + many + tel + ["https://shared.example.net/help"]
        page(f"https://s{i}.example.com", links)
        for p in PATHS + [m[1:] for m in many]:
            if rng.random() < 0.8:
                for _ in range(rng.choice([1, 1, 1, 2])):
                    page(f"https://s{i}.example.com/{p}")
    page("https://shared.example.net/help")
    rng.shuffle(pages)
    return seeds, pages, [("10001", "US"), ("20002", "CA")]


@pytest.fixture(scope="module")
def frames(spark, web):
    seeds, pages, postal = web
    return (
        spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5),
        spark.createDataFrame(seeds, "seed_ord long, domain string"),
        spark.createDataFrame(postal, "zip string, country string"),
    )


@pytest.fixture(scope="module")
def expected(spark, web, frames):
    """The crawl as a loop: pages' pairs come from Spark, everything after them is plain Python."""
    seeds, pages, _ = web
    rows = contacts.page_pairs(frames[0], "url", "page_id", postal=frames[2]).collect()
    pairs = {r.page_id: [(p.number, p.country) for p in r.pairs] for r in rows}
    first = {}
    for page_id, url, html in sorted(pages):
        first.setdefault(url, (page_id, html))
    found = {u: pairs.get(i, []) for u, (i, _) in first.items()}
    visited, reached = set(), {}
    homes = list(dict.fromkeys(f"https://{d}" for _, d in seeds))
    for home in homes:
        visited.add(home)
        reached[home] = [home]
    for home in homes:
        if len(found[home]) >= 3:
            continue
        for href in (h.split('"')[0] for h in first[home][1].split('href="')[1:]):
            if href.startswith("tel:") or href.endswith(".pdf"):
                continue
            if not any(w in href for w in ("contact", "about", "support", "blog", "help")):
                continue
            url = href if href.startswith("http") else home + href
            if url not in visited:
                visited.add(url)
                if url in first:
                    reached[home].append(url)
    final, hit = {}, {}
    for home, urls in reached.items():
        distinct = list(dict.fromkeys(p for u in urls for p in found[u]))
        if distinct:
            final[home] = distinct[:3]
            hit[home] = next(found[u] for u in urls if found[u])[:3]
    return reached, final, hit


def wide(df):
    return {
        r.url: [(r[f"phone_number_{i}"], r[f"country_{i}"]) for i in (1, 2, 3) if r[f"phone_number_{i}"]]
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def reached(frames):
    return contacts.stored_crawl(*frames).cache()


def test_crawl_reaches_the_same_pages(reached, expected):
    got = {}
    for r in reached.orderBy("depth", "link_ord").collect():
        got.setdefault(r.parent_url, []).append(r.url)
    assert got == expected[0]


def test_contacts_final(reached, expected):
    assert wide(contacts.contacts_final(reached)) == expected[1]


def test_contacts_first_hit(reached, expected):
    assert wide(contacts.contacts_first_hit(reached)) == expected[2]


def test_partitioning_changes_nothing(frames, expected):
    pages, seeds, postal = frames
    for n in (1, 7):
        again = contacts.stored_crawl(pages.repartition(n, "html"), seeds.repartition(n), postal)
        assert wide(contacts.contacts_final(again)) == expected[1]


def test_parent_filter_gives_tel_numbers_only(frames):
    got = wide(contacts.contacts_final(contacts.stored_crawl(*frames, parent_filter=True)))
    tel = {"3125550100", "4165550101", "2025550102"}
    assert got and all({n for n, _ in pairs} == tel for pairs in got.values())


def test_country_and_plus_make_pairs_distinct(spark):
    rows = [("p", 1, 0, "2025550143", "US"), ("p", 2, 0, "2025550143", "CA"),
            ("p", 3, 0, "+12025550143", "US"), ("p", 4, 0, "2025550143", None), ("p", 5, 0, "2025550143", "US")]
    df = spark.createDataFrame(rows, "parent string, page long, place long, number string, country string")
    got = rollup.contacts_of_pairs(df, "parent", ["page", "place"]).first()
    assert tuple(got) == ("p", "2025550143", "US", "2025550143", "CA", "+12025550143", "US")
    assert rollup.distinct_pairs(df, "parent", ["page", "place"]).count() == 4


def test_new_pairs(spark):
    schema = "parent string, number string, country string"
    pairs = spark.createDataFrame([("p", "1", None), ("p", "1", "US"), ("q", "1", "US"), ("q", "1", "US")], schema)
    known = spark.createDataFrame([("p", "1", None), ("p", "2", "US")], schema)
    got = sorted(tuple(r) for r in rollup.new_pairs(pairs, known, "parent").collect())
    assert got == [("p", "1", "US"), ("q", "1", "US")]


def test_contacts_per_site_with_a_hot_site(spark):
    """One site and one number hold most rows; each site still gets its first three pairs."""
    rows = [("hot", i, "call 202-555-0100" if i % 2 else f"call 202-555-{i % 10000:04d}") for i in range(3000)]
    rows += [(f"s{i}", i, f"416-555-{i:04d} and 416-555-{i + 1:04d}") for i in range(50)]
    df = spark.createDataFrame(rows, "site string, id long, text string").repartition(6)
    out = contacts.contacts_per_site(df, "site", "id")
    got = {r.site: tuple(r)[1:] for r in out.collect()}
    assert got["hot"] == ("2025550000", "US", "2025550100", "US", "2025550002", "US")
    assert got["s7"] == ("4165550007", "CA", "4165550008", "CA", None, None) and len(got) == 51


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(frames):
    """HTML is read through a join with the wanted urls; no Python; ranks are cut before the shuffle."""
    pages, seeds, postal = frames
    facts = plan_of(contacts.home_facts(pages, seeds))
    assert "LeftSemi" in facts and "Python" not in facts and "CartesianProduct" not in facts
    edges = plan_of(contacts.home_edges(pages, seeds))
    assert "LeftSemi" in edges and "tel:" not in edges
    df = pages.select(F.col("url").alias("site"), "page_id", F.col("html").alias("text"))
    site = plan_of(contacts.contacts_per_site(df, "site", "page_id", postal))
    assert "WindowGroupLimit" in site and "Python" not in site


def test_all_numbers_of_a_page_are_kept(spark):
    body = "".join(f"<p>202-555-{i:04d}</p>" for i in range(5))
    pages = spark.createDataFrame(
        [(1, "https://a.com", '<a href="/contact">c</a>'), (2, "https://a.com/contact", body)], "page_id long, url string, html string"
    )
    seeds = spark.createDataFrame([(0, "a.com")], "seed_ord long, domain string")
    pairs = rollup.explode_pairs(contacts.stored_crawl(pages, seeds), "parent_url", "depth")
    home, child = pairs.filter("depth = 0"), pairs.filter("depth = 1")
    assert rollup.new_pairs(child, home, "parent_url").count() == 5


def test_redirected_homes(spark):
    """A home page that answers under another url, or with a slash, is the seed's; its links are its own."""
    number = "<p>202-555-01{:02d}</p>"
    pages = spark.createDataFrame([
        (1, "https://www.a.com/", "https://a.com", '<a href="about">x</a>' + number.format(1)),
        (2, "https://www.a.com/about", None, number.format(2)),
        (3, "https://b.com/", None, '<a href="/contact/">x</a>'),
        (4, "https://b.com/contact/", None, number.format(4)),
    ], "page_id long, url string, requested_url string, html string")
    seeds = spark.createDataFrame([(0, "a.com"), (1, "b.com")], "seed_ord long, domain string")
    got = wide(contacts.contacts_final(contacts.stored_crawl(pages, seeds)))
    assert got == {"https://a.com": [("2025550101", "US"), ("2025550102", "US")], "https://b.com": [("2025550104", "US")]}


def test_rows_that_share_a_key_keep_their_numbers(spark):
    rows = [("s", 1, "call 202-555-0100 or 202-555-0101"), ("s", 1, "call 202-555-0102 at 10001"), ("s", 1, "call 202-555-0102")]
    texts = spark.createDataFrame(rows, "site string, id long, text string")
    postal = spark.createDataFrame([("10001", "CA"), ("10001", "CA"), ("2", "US")], "zip string, country string")
    for table in (None, postal):
        pairs = rollup.explode_pairs(contacts.text_pairs(texts, "site", "id", postal=table), "site")
        assert pairs.count() == 4
    assert {r.country for r in pairs.collect()} == {"US", "CA"}


def test_no_folder_is_guessed_on_a_cluster():
    from types import SimpleNamespace

    from contactloom.sources.shared import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master, applicationId="app-x"),
        )

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[4]"))


# --- resumed crawls and filtered frontiers --------------------------------------------------------


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_a_stopped_crawl_goes_on_from_its_last_finished_table(spark, frames, monkeypatch):
    # a mark of its own for this test: the pages' ids
    pages, seeds, postal = frames[0].withColumn("page_id", F.col("page_id") + 1_000_000), *frames[1:]
    want = rows_of(contacts.stored_crawl(pages, seeds, postal))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(contacts, "visited", stop)
        with pytest.raises(KeyboardInterrupt):
            contacts.stored_crawl(pages, seeds, postal, resume=True)
    with monkeypatch.context() as patch:
        patch.setattr(contacts, "home_facts", stop)  # not made again
        assert rows_of(contacts.stored_crawl(pages, seeds, postal, resume=True)) == want
        patch.setattr(contacts, "crawl", stop)  # the whole result is there
        assert rows_of(contacts.stored_crawl(pages, seeds, postal, resume=True)) == want
        with pytest.raises(KeyboardInterrupt):  # other inputs are another run
            contacts.stored_crawl(pages, seeds.filter("seed_ord > 0"), postal, resume=True)


@pytest.mark.parametrize("bits", [1 << 10, contacts.FILTER_BITS])
def test_urls_that_are_not_wanted_stay_out_of_the_shuffle(spark, bits):
    keys = spark.range(20_000).selectExpr("concat('u', id) AS asked", "id")
    wanted = spark.range(0, 20_000, 100).selectExpr("concat('u', id) AS url")
    passed = contacts.likely(keys, wanted, "asked", bits)
    found = {r.asked for r in passed.collect()}
    assert {r.url for r in wanted.collect()} <= found
    assert len(found) < (20_000 if bits == 1 << 10 else 2_500)
    assert "Exchange hashpartitioning" not in passed._jdf.queryExecution().executedPlan().toString()
    none = contacts.likely(keys, wanted.limit(0), "asked")
    assert none.collect() == []


def test_filtered_frontier_finds_the_same_pages(spark, frames):
    pages, seeds, _ = frames
    wanted = seeds.selectExpr("concat('https://', domain) AS url").distinct()
    assert rows_of(contacts.first_pages(pages, wanted, filter_from=0)) == rows_of(contacts.first_pages(pages, wanted))


def test_nested_crawl_finds_numbers_that_are_split(spark):
    home = '<div><a href="/contact">c</a><section><p>202-555-</p><p>0143</p></section></div>'
    child = "<div><span>416</span>.<span>555</span>.<span>0100</span></div>2025550199"
    pages = spark.createDataFrame(
        [(1, "https://a.example.com", home), (2, "https://a.example.com/contact", child)], "page_id long, url string, html string"
    )
    seeds = spark.createDataFrame([(0, "a.example.com")], "seed_ord long, domain string")
    flat, nested = (wide(contacts.contacts_final(contacts.stored_crawl(pages, seeds, nested=n))) for n in (False, True))
    assert nested == {"https://a.example.com": [("2025550143", "US"), ("4165550100", "CA")]}
    assert flat == {"https://a.example.com": [("4165550100", "CA"), ("2025550199", "US")]}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_links_are_made_once(spark):
    """Filters that are pushed below what makes pairs or links would make them again."""
    found = spark.createDataFrame([("u", 1, ["2025550143"])], "url string, page_id long, numbers array<string>").repartition(2)
    pairs = found.withColumn("pairs", contacts.pair_array(F.col("numbers"), F.lit(None).cast("string")))
    rows = rollup.explode_pairs(pairs, "url", "page_id")
    assert [tuple(r) for r in rows.collect()] == [("u", 1, 0, "2025550143", "US")]
    assert "size(transform(" not in _plan(rows)
    page = spark.createDataFrame([("u", '<a href="/contact?a=1&amp;b">x</a><a href=tel:5>y</a>')], "url string, html string")
    kept = links.not_social_links(links.relevant_links(links.page_links(page.repartition(2), "url")))
    assert _plan(kept).count("regexp_extract_all") == 1
    assert [tuple(r) for r in kept.collect()] == [("u", 0, "/contact?a=1&b")]


def test_joins_and_groups_by_url_sort_by_a_hash_first(spark):
    """Urls begin alike, so a sort by url compares whole strings."""
    pages = spark.createDataFrame([(2, "https://a", "x"), (1, "https://a", "y")], "page_id long, url string, html string")
    first = links.first_copies(pages.drop("html"), pages)
    assert first.columns == ["page_id", "url"] and [tuple(r) for r in first.collect()] == [(1, "https://a")]
    assert "[url_key" in _plan(first).replace("xxhash64(", "[url_key")
    claims = contacts.visited(
        spark.createDataFrame([("https://b", 0, 0, "https://a")], "target string, seed_ord long, link_ord int, parent_url string"),
        spark.createDataFrame([(0, "a")], "seed_ord long, domain string"),
    )
    assert "Sort [url_key" in _plan(claims)


def test_only_links_that_may_be_numbers_are_decoded(spark):
    html_ = '<a href="/x">a</a><a href=\'t&#101;l:2025550143\'>b</a><a href="te&#108;&colon;3125550142">c</a><a href="TEL:2125550141">d</a>'
    page = spark.createDataFrame([("u", html_)], "url string, html string")
    assert [r.numbers for r in extract.numbers_of_pages(page, "url").collect()] == [["2025550143", "3125550142"]]
    assert "tel" in _plan(extract.numbers_of_pages(page.repartition(2), "url")).split("array_join(filter(")[1][:3000]


def test_home_edges_takes_one_whole_copy(spark):
    """Two pages of one key are not mixed link by link."""
    both = ['<a href="/contact/1">a</a><a href="/contact/2">b</a>', '<a href="/help/1">a</a><a href="/help/2">b</a>']
    pages = spark.createDataFrame([(1, "https://a", h) for h in both], "page_id long, url string, html string")
    edges = contacts.home_edges(pages, spark.createDataFrame([(0, "a")], "seed_ord long, domain string")).collect()
    assert len(edges) == 2 and len({r.href.split("/")[1] for r in edges}) == 1


def test_links_of_home_pages_are_stored_once_and_only_of_open_parents(frames, expected):
    """A page with as many numbers as its parent can have keeps none, and no lookup of postal codes carries links."""
    tables = {}

    def keep(name, make):
        tables[name] = contacts.kept_once(name, make)
        return tables[name]

    reached = contacts.crawl(*frames, keep=keep)
    assert wide(contacts.contacts_final(reached)) == expected[1]
    full, others = (tables["home-pages"].filter(f"size(numbers) {c} 3") for c in (">=", "<"))
    assert full.count() == 3 and full.filter("links IS NOT NULL").isEmpty()
    assert others.filter("size(links) > 0").count() == others.count() == SITES - 3
    assert tables["home-facts"].columns == ["parent_url", "pairs"]


def test_rows_that_become_pages_are_dealt_without_a_sort(spark):
    """Dealing rows in turn sorts them first; they are dealt by the columns that the pages are made of."""
    from checks import registry
    from tests.conftest import SF

    plan = _plan(registry.crawl_pages(spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 3 and "RoundRobin" not in plan and "hashpartitioning(l_orderkey" in plan
