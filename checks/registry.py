"""One runnable query per operator, over whole tables."""

import contextlib
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import derived
from contactloom.functions import phone
from contactloom.functions.dialing import country_of_number
from contactloom.operators import country, extract, links, metrics, rollup
from contactloom.plans import contacts
from contactloom.sources import cache, inputs, outputs
from contactloom.sources.shared import input_mark, new_path, resumable, shared_table
from contactloom.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ("url", "page_id")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs -------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """The test tables are single small files; every core gets a part, whatever their size.

    Rows are dealt by the columns ``by``; without any they are dealt in turn, for which Spark sorts them first.
    """
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism, *by)


def spread_table(spark: SparkSession, sf: str, name: str, sql: str = "") -> DataFrame:
    """A table whose rows become pages: few bytes to spread, much work per row.

    Rows are dealt by those columns of ``sql`` that are no texts.
    """
    scan = table(spark, sf, name)
    return spread(scan, *[c for c, kind in scan.dtypes if kind != "string" and re.search(rf"\b{c}\b", sql)])


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A pattern, since a stream reads a directory or what matches a pattern, but no single file.
    return inputs.stream_table(spark, f"{sf}/{name}.parquet*", table(spark, sf, name).schema)


def derive(spark: SparkSession, sf: str, sql: str, source=table) -> DataFrame:
    """Run derivation SQL on the tables it names."""
    names = [n for n in ("orders", "lineitem", "nation", "customer", "documents") if f"FROM {n}" in sql]
    read = {name: source(spark, sf, name, *([sql] if source is spread_table else [])) for name in names}
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **read)


def seeds(spark, sf):
    return derive(spark, sf, derived.SEEDS)


def home_pages(spark, sf):
    return derive(spark, sf, derived.HOME_PAGES, spread_table)


def crawl_pages(spark, sf):
    return derive(spark, sf, derived.CRAWL_PAGES, spread_table)


def wanted_pages(spark, sf):
    return links.drop_unwanted_extensions(crawl_pages(spark, sf))


def given_pages(spark, sf):
    return spread(inputs.read_pages(spark, f"{sf}/pages.parquet"))


def postal_rows(spark, sf):
    return inputs.build_postal(
        derive(spark, sf, derived.POSTAL_CA), derive(spark, sf, derived.POSTAL_US)
    )


def postal(spark, sf):
    rows = postal_rows(spark, sf)
    return inputs.last_country_per_zip(rows, F.when(F.col("Country") == "US", 1).otherwise(0))


def documents(spark, sf):
    return spread_table(spark, sf, "documents")


# --- sources and reference data -----------------------------------------------------------------


@query
def seed_domains(spark, sf):
    path = new_path(spark, "seeds")
    seeds(spark, sf).orderBy("seed_ord").select("domain").write.csv(path)
    return inputs.load_seeds(spark, path)


@query
def single_seed(spark, sf):
    return inputs.single_seed(seeds(spark, sf), "  site7.example.com ")


@query
def seed_urls(spark, sf):
    return inputs.seed_urls(seeds(spark, sf))


@query
def postal_reference_build(spark, sf):
    return postal_rows(spark, sf)


@query
def postal_reference_load(spark, sf):
    path = new_path(spark, "postal")
    postal_rows(spark, sf).write.csv(path, header=True)
    return inputs.load_postal(spark, path)


@query
def pages_scan(spark, sf):
    return given_pages(spark, sf).select("page_id", "url", F.length("html").alias("html_chars"))


@query
def pages_cached(spark, sf):
    """The given pages, each url's first copy, through a response cache."""
    pages = given_pages(spark, sf)
    folder = new_path(spark, "responses")
    cache.write_cache(links.first_copies(pages, pages), folder)
    return cache.read_cache(spark, folder, "url", "html").select("url", F.length("html").alias("html_chars"))


# --- links --------------------------------------------------------------------------------------


def home_links(spark, sf):
    return links.page_links(home_pages(spark, sf), "url", "page_id")


@query
def unwanted_extension_filter(spark, sf):
    web = given_pages(spark, sf).unionByName(crawl_pages(spark, sf))
    return links.drop_unwanted_extensions(web).select("page_id", "url")


@query
def visited_dedupe(spark, sf):
    return contacts.visited(_all_edges(spark, sf), seeds(spark, sf))


@query
def page_links(spark, sf):
    return links.page_links(given_pages(spark, sf).unionByName(home_pages(spark, sf)), *KEYS)


@query
def relevant_link_filter(spark, sf):
    return home_links(spark, sf).transform(links.relevant_links).drop("page_id")


@query
def social_link_filter(spark, sf):
    return home_links(spark, sf).transform(links.not_social_links).drop("page_id")


@query
def internal_link_flag(spark, sf):
    flag = links.is_internal(F.col("href"), F.col("url"))
    return home_links(spark, sf).select("url", "link_ord", "href", flag.alias("internal"))


# --- extraction ---------------------------------------------------------------------------------


@query
def tel_link_numbers(spark, sf):
    pages = wanted_pages(spark, sf)
    return extract.tel_link_numbers(links.page_links(pages, "url"), "url")


def _all_pages(spark, sf):
    """The given pages and every copy of the crawl's pages."""
    return given_pages(spark, sf).unionByName(wanted_pages(spark, sf))


@query
def text_blocks(spark, sf):
    return extract.text_blocks(_all_pages(spark, sf), *KEYS)


def nested_pages(spark, sf):
    return derive(spark, sf, derived.NESTED_PAGES, spread_table)


@query
def nested_text_blocks(spark, sf):
    texts = extract.element_texts(nested_pages(spark, sf), "url")
    order = F.row_number().over(Window.partitionBy("url").orderBy("element_ord"))
    return texts.select("url", order.alias("nth"), "tag", "text")


@query
def nested_numbers(spark, sf):
    return extract.page_numbers(extract.numbers_of_elements(nested_pages(spark, sf), "url"), "url")


@query
def contacts_nested(spark, sf):
    """Contacts of pages whose numbers are split over nested blocks."""
    pairs = contacts.page_pairs(nested_pages(spark, sf), "url", nested=True)
    return rollup.array_to_pairs(rollup.first_pairs(pairs), "url")


@query
def nested_parent_filter(spark, sf):
    """Of how many candidates of each pattern the number stands in the text around its element: all."""
    texts = extract.element_texts(nested_pages(spark, sf), "url")
    raw = extract.pattern_candidates(texts, "url", "element_ord", "parent_text")
    left = extract.outside_parent(raw, mark="left").groupBy("pattern_ord")
    return left.agg(F.count("*").alias("n"), F.sum(F.col("left").cast("int")).alias("n_left"))


@query
def pattern_candidates(spark, sf):
    return extract.pattern_candidates(documents(spark, sf), "doc_id")


@query
def pattern_candidates_html(spark, sf):
    blocks = extract.text_blocks(_all_pages(spark, sf), *KEYS)
    return extract.pattern_candidates(blocks, *KEYS, "block_ord")


@query
def zip_codes(spark, sf):
    pages = wanted_pages(spark, sf)
    texts = extract.page_texts(pages, *KEYS)
    return extract.zip_codes(texts, *KEYS).transform(lambda df: links.first_copies(df, pages))


@query
def zip_codes_text(spark, sf):
    return extract.zip_codes(derive(spark, sf, derived.POSTAL_TEXTS, spread_table), "doc_id")


@query
def parent_text_filter(spark, sf):
    pages = wanted_pages(spark, sf)
    found = extract.numbers_of_pages(pages, *KEYS, parent_filter=True)
    return extract.page_numbers(found, *KEYS).transform(lambda df: links.first_copies(df, pages))


# --- cleaning and validation --------------------------------------------------------------------


def _raw_candidates(spark, sf):
    return (
        pattern_candidates(spark, sf).select("raw")
        .unionByName(pattern_candidates_html(spark, sf).select("raw"))
    )


def _checked(spark, sf):
    return _raw_candidates(spark, sf).transform(extract.format_candidates).transform(
        extract.check_candidates
    )


@query
def format_number(spark, sf):
    formatted = extract.format_candidates(_raw_candidates(spark, sf))
    return formatted.groupBy("raw", "number").agg(F.count("*").alias("n"))


@query
def valid_number(spark, sf):
    return _checked(spark, sf).select("number", "valid", "reason").distinct()


@query
def rejection_breakdown(spark, sf):
    return extract.rejection_breakdown(_checked(spark, sf))


# --- country ------------------------------------------------------------------------------------


@query
def country_from_zip(spark, sf):
    pages = wanted_pages(spark, sf)
    texts = extract.page_texts(pages, *KEYS)
    zips = texts.select(*KEYS, phone.zip_codes(F.col("text")).alias("zips"))
    stored = country.numbered(zips.filter(F.size("zips") > 0), "zips")
    found = country.zip_country(stored, postal(spark, sf))
    return found.filter(F.col("zip_country").isNotNull()).transform(
        lambda df: links.first_copies(df, pages)
    )


@query
def country_from_number(spark, sf):
    pages = wanted_pages(spark, sf)
    given = extract.page_numbers(extract.numbers_of_pages(given_pages(spark, sf), "url"), "url")
    texts = extract.page_numbers(extract.numbers_of_texts(documents(spark, sf), "doc_id"), "doc_id")
    numbers = (
        page_number_dedupe(spark, sf).select("number")
        .unionByName(given.select("number")).unionByName(texts.select("number")).distinct()
    )
    return numbers.withColumn("country", country_of_number(F.col("number")))


@query
def country_resolve(spark, sf):
    pages = wanted_pages(spark, sf)
    pairs = contacts.page_pairs(pages, *KEYS, postal=postal(spark, sf))
    return rollup.explode_pairs(pairs, *KEYS).transform(lambda df: links.first_copies(df, pages))


# --- crawl --------------------------------------------------------------------------------------


def _all_edges(spark, sf):
    """Resolved links of every home page, with or without early stop."""
    return contacts.home_edges(home_pages(spark, sf), seeds(spark, sf))


def _reached(spark, sf):
    return contacts.stored_crawl(crawl_pages(spark, sf), seeds(spark, sf), postal(spark, sf))


@query
def link_frontier(spark, sf):
    owners = contacts.visited(_all_edges(spark, sf), seeds(spark, sf)).filter(F.col("depth") == 1)
    known = wanted_pages(spark, sf).select("url").distinct()
    return owners.join(known, "url").select("parent_url", "url", "link_ord")


@query
def contacts_tel_only(spark, sf):
    """The crawl with the parent filter: only ``tel:`` links count."""
    return contacts.contacts_final(contacts.stored_crawl(
        crawl_pages(spark, sf), seeds(spark, sf), postal(spark, sf), parent_filter=True
    ))


@query
def frontier_early_stop(spark, sf):
    return _reached(spark, sf).select("parent_url", "url", "depth", "link_ord")


@query
def new_pairs(spark, sf):
    reached = _reached(spark, sf)
    pairs = rollup.explode_pairs(reached, "parent_url", "depth")
    home, child = pairs.filter(F.col("depth") == 0), pairs.filter(F.col("depth") == 1)
    return rollup.new_pairs(child, home, "parent_url")


# --- rollup -------------------------------------------------------------------------------------


@query
def page_number_dedupe(spark, sf):
    pages = wanted_pages(spark, sf)
    found = extract.numbers_of_pages(pages, *KEYS)
    return extract.page_numbers(found, *KEYS).transform(lambda df: links.first_copies(df, pages))


@query
def contacts_final(spark, sf):
    return contacts.contacts_final(_reached(spark, sf))


class _Stopped(Exception):
    pass


@query
def contacts_resumed(spark, sf):
    """``contacts_final`` of a crawl that is stopped when it knows its home pages, and taken up again."""
    inputs_of = crawl_pages(spark, sf), seeds(spark, sf), postal(spark, sf)
    mark = f"{input_mark(inputs_of[0].drop('html'), *inputs_of[1:])}-{uuid.uuid4().hex}"

    def until_home_is_known(name, make):
        if name == "visited":
            raise _Stopped
        return resumable(spark, mark)(name, make)

    with contextlib.suppress(_Stopped):
        contacts.crawl(*inputs_of, keep=until_home_is_known)
    return contacts.contacts_final(contacts.crawl(*inputs_of, keep=resumable(spark, mark)))


@query
def contacts_first_hit(spark, sf):
    return contacts.contacts_first_hit(_reached(spark, sf))


@query
def contacts_per_site(spark, sf):
    return contacts.contacts_per_site(documents(spark, sf), "source", "doc_id", postal(spark, sf))


@query
def contacts_per_host(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    pages = given_pages(spark, sf).withColumn("host", host)
    return (
        contacts.page_pairs(pages, "host", "page_id")
        .transform(rollup.first_pairs)
        .transform(lambda df: rollup.explode_pairs(df, "host", "page_id"))
        .transform(lambda df: rollup.contacts_of_pairs(df, "host", ["page_id", "number_ord"]))
    )


def _document_pairs(spark, sf):
    pairs = contacts.text_pairs(documents(spark, sf), "source", "doc_id", postal=postal(spark, sf))
    ranked = rollup.explode_pairs(pairs, "source", "doc_id")
    return rollup.distinct_pairs(ranked, "source", ["doc_id", "number_ord"])


@query
def top3_per_key(spark, sf):
    top = rollup.top_per_key(_document_pairs(spark, sf), "source", ["doc_id", "number_ord"])
    return top.select("source", "number", "country", "rn")


@query
def pairs_to_columns(spark, sf):
    ranked = country_resolve(spark, sf).withColumn("rn", F.col("number_ord") + 1)
    return rollup.pairs_to_columns(ranked.filter(F.col("rn") <= rollup.MAX_CONTACTS), "url")


@query
def found_not_found(spark, sf):
    return metrics.found_not_found(contacts_final(spark, sf), "url")


@query
def contact_totals(spark, sf):
    return metrics.contact_totals(contacts_final(spark, sf))


@query
def progress(spark, sf):
    return metrics.progress(contacts_final(spark, sf), seeds(spark, sf))


def _numbered(spark, sf):
    """Final contacts with serial numbers in seed order."""
    final = shared_table(contacts_final(spark, sf), "contacts")
    order = inputs.seed_urls(seeds(spark, sf)).groupBy("url").agg(F.min("seed_ord").alias("seed_ord"))
    return metrics.serial_numbers(final.join(order, "url"), "seed_ord")


@query
def serial_number(spark, sf):
    return _numbered(spark, sf).select("serial", "url")


# --- outputs ------------------------------------------------------------------------------------


@query
def export_projection(spark, sf):
    return outputs.export_projection(_numbered(spark, sf))


@query
def csv_sink(spark, sf):
    path = new_path(spark, "csv")
    rows = export_projection(spark, sf)
    outputs.write_csv(rows, path)
    return outputs.read_csv(spark, path, rows.columns)


@query
def array_to_columns(spark, sf):
    pages = wanted_pages(spark, sf)
    found = extract.numbers_of_pages(pages, *KEYS)
    first = links.first_copies(found.select(*KEYS, F.col("numbers").alias("phone_numbers")), pages)
    return outputs.array_to_columns(first)


# --- streaming ----------------------------------------------------------------------------------


def _start(stream: DataFrame, checkpoint: str, mode: str = "append", **options):
    cores = stream.sparkSession.sparkContext.defaultParallelism
    return feed.start(stream, checkpoint, mode, state_partitions=cores, **options)


def _run(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> str:
    """Work off a stream into a new table of the shared folder; returns its path."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    _start(stream, checkpoint or new_path(spark, "checkpoint"), path=path).awaitTermination()
    return path


def _stored(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def _target_urls(home: DataFrame) -> DataFrame:
    """Urls of the followed links of home pages, each once."""
    edges = links.frontier_links(links.page_links(home, "url"), "url")
    return feed.distinct_urls(edges.select(F.col("target").alias("url")))


def _feed(spark, sf, *jobs) -> tuple[str, DataFrame]:
    """The feed's batches through ``page_hits`` and the ``jobs`` behind it; path and stream of the last.

    Batches arrive one after another, and every job works each off before the next one comes, from
    its own checkpoint. A job reads the table that the one before it writes.
    """
    pages = derive(spark, sf, derived.FEED_PAGES, spread_table)
    jobs = [lambda arrived: feed.page_hits(arrived, postal(spark, sf)), *jobs]
    paths = [new_path(spark, "feed") for _ in range(len(jobs) + 1)]
    checkpoints = [new_path(spark, "checkpoint") for _ in jobs]
    for batch in range(derived.FEED_BATCHES):
        pages.filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(paths[0])
        schema = pages.drop("batch").schema
        for job, source, checkpoint, path in zip(jobs, paths, checkpoints, paths[1:]):
            stream = job(inputs.stream_table(spark, source, schema))
            _run(stream, "", checkpoint, path)
            schema = stream.schema
    return paths[-1], stream


@query
def stream_visited(spark, sf):
    urls = _target_urls(derive(spark, sf, derived.HOME_PAGES, stream_table))
    return _stored(spark, _run(urls, "urls"), urls)


@query
def stream_first_hit(spark, sf):
    return _stored(spark, *_feed(spark, sf, feed.first_hits))


@query
def stream_contacts(spark, sf):
    return feed.current_contacts(_stored(spark, *_feed(spark, sf, feed.growing_contacts)))


@query
def stream_csv_feed(spark, sf):
    """First hits, written as CSV as they come and read back."""
    path, first = _feed(spark, sf, feed.first_hits)
    folder = new_path(spark, "csv-feed")
    items = inputs.stream_table(spark, path, first.schema)
    _start(items, new_path(spark, "checkpoint"), each=outputs.csv_feed(folder)).awaitTermination()
    return outputs.read_feed(spark, folder, first.columns)


@query
def stream_totals(spark, sf):
    path, first = _feed(spark, sf, feed.first_hits)
    totals = feed.running_totals(inputs.stream_table(spark, path, first.schema))
    name = f"totals_{uuid.uuid4().hex}"
    _start(totals, new_path(spark, "checkpoint"), "complete", table=name).awaitTermination()
    return spark.table(name)


@query
def stream_restart(spark, sf):
    """``stream_visited``, stopped after a batch and taken up again from its checkpoint."""
    parts, out = new_path(spark, "orders"), new_path(spark, "urls")
    orders = table(spark, sf, "orders")
    orders.repartition(4).write.parquet(parts)

    def urls() -> DataFrame:
        # a trigger reads one file, that is one task; its rows are dealt to every core
        source = lambda *_: spread(inputs.stream_table(spark, parts, orders.schema, files_per_trigger=1))
        return _target_urls(derive(spark, sf, derived.HOME_PAGES, source))

    checkpoint = new_path(spark, "checkpoint")
    first_run = _start(urls(), checkpoint, path=out, processingTime="0 seconds")
    while first_run.isActive and not first_run.recentProgress:
        time.sleep(0.1)
    first_run.stop()
    return _stored(spark, _run(urls(), "urls", checkpoint, out), urls())
