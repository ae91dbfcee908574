"""Whole jobs: contacts per site from texts, and contacts per seed from a crawl over page tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators import extract, links, rollup
from contactloom.operators.country import numbered, pair_array, zip_country
from contactloom.sources.inputs import seed_urls
from contactloom.sources.shared import Keep, input_mark, kept_once, resumable, shared_table

PAGE_RANK = ["depth", "seed_ord", "link_ord"]
#: Bits of a filter of urls at most (16 MB as a table), and the number of urls from which there is one.
FILTER_BITS, FILTER_FROM = 1 << 26, 500_000


def _with_pairs(found: DataFrame, postal: DataFrame | None, stored: bool = False) -> DataFrame:
    """Numbers and zips of one row -> ``pairs``. With a postal table, what was found is stored first.

    ``stored``: it is, and its rows have a ``row_id``.
    """
    if postal is None:
        known = found.withColumn("zip_country", F.lit(None).cast("string"))
    else:
        known = zip_country(found if stored else numbered(found, "numbers-and-zips"), postal)
    return known.withColumn("pairs", pair_array(F.col("numbers"), F.col("zip_country")))


def text_pairs(texts: DataFrame, *keys: str, postal: DataFrame | None = None) -> DataFrame:
    """``(keys, numbers, pairs)`` of plain texts that hold a number."""
    return _with_pairs(extract.numbers_of_texts(texts, *keys), postal)


def page_pairs(
    pages: DataFrame, *keys: str, postal: DataFrame | None = None, parent_filter: bool = False, nested: bool = False,
) -> DataFrame:
    """``(keys, numbers, pairs)`` of HTML pages that hold a number.

    ``nested`` reads every element with what is nested in it, so that numbers which are split over
    blocks count; the parent filter leaves tel: links only, however elements are read.
    """
    if nested and not parent_filter:
        return _with_pairs(extract.numbers_of_elements(pages, *keys), postal)
    return _with_pairs(extract.numbers_of_pages(pages, *keys, parent_filter=parent_filter), postal)


def contacts_per_site(
    texts: DataFrame, site: str, order: str, postal: DataFrame | None = None
) -> DataFrame:
    """First three distinct pairs per site over ``(site, order, text)`` rows.

    Only rows with a number leave the scan, with at most three pairs each; then one shuffle by
    ``(site, number, country)`` and one by site that carries three rows per task and site.
    """
    pairs = text_pairs(texts, site, order, postal=postal)
    return (
        pairs.transform(rollup.first_pairs)
        .transform(lambda df: rollup.explode_pairs(df, site, order))
        .transform(lambda df: rollup.contacts_of_pairs(df, site, [order, "number_ord"]))
    )


def asked(pages: DataFrame) -> DataFrame:
    """Pages under the url that was asked for, in ``asked``; ``url`` is the one that answered.

    A page table may have ``requested_url``; where it has none, the two are the same. A bare
    host's ``/`` is its home page.
    """
    requested = F.coalesce("requested_url", "url") if "requested_url" in pages.columns else F.col("url")
    bare = F.regexp_replace(requested, r"^(https?://[^/?#]+)/\z", "$1")
    return pages.withColumn("asked", F.when(requested.endswith("/"), bare).otherwise(requested))


def likely(keys: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``keys`` whose ``key`` may be in ``wanted(url)``, and few others; none is shuffled.

    A Bloom filter of one hash: a stored table of words of 64 bits, at most ``bits`` in all, which is
    broadcast. With sixteen bits a url one row in sixteen passes by chance; where the bound leaves
    fewer, more do.
    """
    size = wanted.count()
    width = min(bits, 1 << max(10, (16 * size).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(width))
    mask = F.expr("shiftleft(1L, CAST(place % 64 AS int))")
    words = wanted.select(place("url").alias("place")).select(F.floor(F.col("place") / 64).alias("word"), mask.alias("bit"))
    words = shared_table(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "url-filter")
    at = place(key)
    hit = (F.floor(at / 64) == F.col("word")) & (
        F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
    )
    return keys.join(F.broadcast(words), hit, "left_semi")


def first_pages(pages: DataFrame, wanted: DataFrame, filter_from: int = FILTER_FROM) -> DataFrame:
    """``(url_key, asked, page_id, url, html)`` of the ``wanted`` urls, the copy with the lowest ``page_id``.

    Two joins of key columns decide which copies are read; ``wanted`` is a stored table, so Spark
    knows its size. Where it is too large to be broadcast (``filter_from`` urls), a Bloom filter of it
    goes before the joins, so that urls which are not wanted are not shuffled. HTML is read only
    through the second join.
    """
    known = asked(links.drop_unwanted_extensions(pages))
    if wanted.count() >= filter_from:
        known = likely(known, wanted, "asked")
    known = links.keyed(known, "asked")
    of = links.keyed(wanted.select(F.col("url").alias("asked")), "asked")
    first = (
        known.select("url_key", "asked", "page_id").join(of, ["url_key", "asked"], "left_semi")
        .groupBy("url_key", "asked").agg(F.min("page_id").alias("page_id"))
    )
    first = shared_table(first, "first-copies")
    return known.select("url_key", "asked", "url", "page_id", "html").join(first, ["url_key", "asked", "page_id"], "left_semi")


def one_of_each(facts: DataFrame, key: str) -> DataFrame:
    """One whole row for each ``key``: of several the one with the smallest hash, so the choice is the rows' own."""
    row = F.struct(*facts.columns)
    of = F.xxhash64(key).alias("of_key"), F.col(key).alias("of")
    return facts.groupBy(*of).agg(F.min_by(row, F.xxhash64(*facts.columns)).alias("row")).select("row.*")


def home_facts(pages: DataFrame, seeds: DataFrame, parent_filter: bool = False, nested: bool = False) -> DataFrame:
    """``(parent_url, answer_url, seed_ord, numbers, zips, links)`` of the seeds' own pages.

    Only these pages' links are read; a domain listed twice keeps its first place. All their
    numbers are kept; a page that has as many as its parent can have leads nowhere, so it has no links here.
    """
    first = shared_table(seed_urls(seeds).groupBy("url").agg(F.min("seed_ord").alias("seed_ord")), "homes")
    found = extract.numbers_and_links(
        first_pages(pages, first), "asked", "url", parent_filter=parent_filter, nested=nested
    )
    kept = F.filter("links", lambda x: links.is_relevant(x.href) & ~links.is_social(x.href))
    homes = found.select(
        F.col("asked").alias("parent_url"), F.col("url").alias("answer_url"), "numbers", "zips",
        F.when(F.size("numbers") < rollup.MAX_CONTACTS, kept).alias("links"),
    ).transform(one_of_each, "parent_url")
    return homes.join(first.withColumnRenamed("url", "parent_url"), "parent_url")


def home_edges(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Followed links of every seed's home page, whatever its numbers are; texts are not read."""
    first = shared_table(seed_urls(seeds).groupBy("url").agg(F.min("seed_ord").alias("seed_ord")), "homes")
    # one row a page until copies are told apart, not one a link
    listed = F.transform("hrefs", lambda h, i: F.struct(i.alias("link_ord"), h.alias("href")))
    kept = F.filter(listed, lambda x: links.is_relevant(x.href) & ~links.is_social(x.href))
    found = links.link_lists(first_pages(pages, first), "asked", "url").select("asked", "url", kept.alias("links"))
    homes = found.transform(one_of_each, "asked").transform(links.keyed, "asked")
    of = links.keyed(first.withColumnRenamed("url", "asked"), "asked")
    edges = homes.join(of, ["url_key", "asked"]).select("asked", "url", "seed_ord", F.inline("links"))
    return links.follow(edges.select("asked", "link_ord", "url", "href", "seed_ord"), "url").withColumnRenamed(
        "asked", "parent_url"
    ).drop("url")


def open_parents(home: DataFrame) -> DataFrame:
    """Parents that still need numbers after their own page: only these are expanded. A number is a pair."""
    return home.filter(F.size("numbers") < rollup.MAX_CONTACTS)


def link_targets(home: DataFrame) -> DataFrame:
    """``(parent_url, seed_ord, link_ord, href, target)`` of the links that are followed.

    They are resolved against the url that answered.
    """
    edges = home.select("parent_url", "answer_url", "seed_ord", F.inline("links"))
    return links.follow(edges, "answer_url").drop("answer_url")


def visited(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(url, parent_url, depth, seed_ord, link_ord)``: each url once, owned by who is first.

    Seeds own their own url, then the lowest seed and link. One partial aggregate: a url that a
    third of all sites link to is reduced before the shuffle.
    """
    claims = seed_urls(seeds).select(
        "url", F.struct(F.lit(0).alias("depth"), "seed_ord", F.lit(-1).alias("link_ord"),
                        F.col("url").alias("parent_url")).alias("claim")
    ).unionByName(
        edges.select(
            F.col("target").alias("url"),
            F.struct(F.lit(1).alias("depth"), "seed_ord", "link_ord", "parent_url").alias("claim"),
        )
    )
    wanted = claims.transform(links.drop_unwanted_extensions, "url").transform(links.keyed, "url")
    return wanted.groupBy("url_key", "url").agg(F.min("claim").alias("claim")).select(
        "url", "claim.parent_url", *[f"claim.{c}" for c in PAGE_RANK]
    )


def crawl(
    pages: DataFrame, seeds: DataFrame, postal: DataFrame | None = None, parent_filter: bool = False,
    nested: bool = False, keep: Keep = kept_once,
) -> DataFrame:
    """``(parent_url, url, depth, seed_ord, link_ord, pairs)`` of every page the crawl reaches.

    Seeds first: their pages are read for numbers and links, the links say which other pages are
    reached, and only those are read, for their numbers. All pairs of a page are kept.
    """
    # links are stored once, with the numbers, and not carried through the lookup of postal codes
    read = keep("home-pages", lambda: home_facts(pages, seeds, parent_filter, nested).withColumn(
        "row_id", F.monotonically_increasing_id()
    ))
    numbers = read.select("parent_url", "numbers", "zips", "row_id")
    home = keep("home-facts", lambda: _with_pairs(numbers, postal, stored=True).select("parent_url", "pairs"))
    reached = keep("visited", lambda: visited(link_targets(open_parents(read)), seeds))

    def found() -> DataFrame:
        children = first_pages(pages, reached.filter("depth = 1"))
        facts = extract.numbers_of_all_pages(children, "asked", parent_filter=parent_filter, nested=nested)
        return _with_pairs(one_of_each(facts, "asked"), postal)

    others = keep("child-facts", found).select(F.col("asked").alias("url"), "pairs")
    known = home.select(F.col("parent_url").alias("url"), "pairs").unionByName(others)
    joined = links.keyed(reached, "url").join(links.keyed(known, "url"), ["url_key", "url"])
    return joined.select("parent_url", "url", *PAGE_RANK, "pairs")


def stored_crawl(
    pages: DataFrame, seeds: DataFrame, postal: DataFrame | None = None, parent_filter: bool = False,
    nested: bool = False, resume: bool = False,
) -> DataFrame:
    """``crawl``, its result stored in the shared folder.

    ``resume`` goes on with the stages that an earlier run over the same pages, seeds and postal codes
    has finished; pages are told apart by all their columns but the html.
    """
    keep = kept_once
    if resume:
        inputs = [pages.drop("html"), seeds, f"{parent_filter=} {nested=}", *([] if postal is None else [postal])]
        keep = resumable(pages.sparkSession, input_mark(*inputs))
    return keep("crawl", lambda: crawl(pages, seeds, postal, parent_filter, nested, keep))


def contacts_final(reached: DataFrame) -> DataFrame:
    """One row per parent from all its pages: the first three distinct pairs."""
    rank = [*PAGE_RANK, "number_ord"]
    return (
        reached.transform(rollup.first_pairs)
        .transform(lambda df: rollup.explode_pairs(df, "parent_url", *PAGE_RANK))
        .transform(lambda df: rollup.contacts_of_pairs(df, "parent_url", rank))
        .withColumnRenamed("parent_url", "url")
    )


def contacts_first_hit(reached: DataFrame) -> DataFrame:
    """One row per parent from its first page that has a number; one shuffle, reduced before it."""
    hits = reached.filter(F.size("pairs") > 0).transform(rollup.first_pairs)
    of = links.keyed(hits, "parent_url").groupBy("url_key", "parent_url")
    first = of.agg(F.min_by("pairs", F.struct(*PAGE_RANK)).alias("pairs")).drop("url_key")
    return rollup.array_to_pairs(first.withColumnRenamed("parent_url", "url"), "url")
