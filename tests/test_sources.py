import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from contactloom.functions.fixed_values import EXPORT_COLUMNS
from contactloom.operators import metrics
from contactloom.operators.country import numbered, zip_country
from contactloom.sources import cache, inputs, outputs
from contactloom.sources.shared import input_mark, new_path, resumable
from contactloom.streaming import feed


def test_seeds_keep_file_order_and_drop_blanks(spark, tmp_path):
    domains = [f"site{i}.example.com" for i in range(200)]
    for i in range(4):
        rows = domains[i * 50 : i * 50 + 50] + ["", "   "]
        (tmp_path / f"part-{i}.csv").write_text("\n".join(f'"{d}",note' for d in rows) + "\n")
    rows = inputs.load_seeds(spark, str(tmp_path)).orderBy("seed_ord").collect()
    assert [r.domain for r in rows] == domains
    assert len({r.seed_ord for r in rows}) == 200


def test_single_seed(spark):
    seeds = spark.createDataFrame([(0, "a.com"), (1, "b.com")], "seed_ord long, domain string")
    assert inputs.single_seed(seeds, " b.com ").first().seed_ord == 1
    assert inputs.seed_urls(inputs.one_seed(spark, " http://x ")).first().url == "https://http://x"
    with pytest.raises(ValueError):
        inputs.single_seed(seeds, "  ")


def test_postal_keys_are_strings_and_the_last_row_wins(spark, tmp_path):
    path = tmp_path / "zip.csv"
    path.write_text("Zip,Country\n00501,CA\nK1A0B1,CA\n00501,US\n12345,US\n12345,CA\n")
    got = {r.zip: r.country for r in inputs.load_postal(spark, str(path)).collect()}
    assert got == {"00501": "US", "K1A0B1": "CA", "12345": "CA"}


def test_build_postal_puts_canada_first(spark):
    ca = spark.createDataFrame([("1", "x"), ("2", "x")], "Zip string, City string")
    us = spark.createDataFrame([("1", "y")], "Zip string, State string")
    rows = [tuple(r) for r in inputs.build_postal(ca, us).collect()]
    assert rows == [("1", "CA"), ("2", "CA"), ("1", "US")]


def test_first_zip_with_a_country_counts(spark):
    postal = spark.createDataFrame([("11111", "US"), ("22222", "CA")], "zip string, country string")
    found = spark.createDataFrame(
        [(1, ["99999", "22222", "11111"]), (2, ["99999"]), (3, []), (3, None), (4, ["11111"]), (4, ["11111"])],
        "id long, zips array<string>",
    )
    got = sorted((r.id, r.zip_country or "") for r in zip_country(numbered(found, "found"), postal).collect())
    assert got == [(1, "CA"), (2, ""), (3, ""), (3, ""), (4, "US"), (4, "US")]


def test_rows_without_zips_are_not_shuffled(spark):
    """They come out of a scan of their own; what is exchanged for the fold are numbers and countries."""
    postal = spark.createDataFrame([("11111", "US")], "zip string, country string")
    found = spark.createDataFrame([(1, ["11111"], "x"), (2, [], "y")], "id long, zips array<string>, links string")
    plan = zip_country(numbered(found, "found"), postal)._jdf.queryExecution().executedPlan().toString()
    with_zips, without = plan.split("Union")[1].split("\n   +- Project", 1)
    assert "size(zips" in without and "Exchange" not in without
    folded = [line for line in with_zips.splitlines() if "Aggregate" in line]
    assert folded and not any("links" in line for line in folded)


CONTACTS = "url string, phone_number_1 string, country_1 string, phone_number_2 string, " \
           "country_2 string, phone_number_3 string, country_3 string"


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(
        [("https://a", "1", "US", "2", None, None, None), ("https://b,\"q\"", "3", "CA", None, None, None, None)],
        CONTACTS,
    )


def test_found_totals_and_progress(spark, rows):
    got = {r.url: (r.found, r.not_found) for r in metrics.found_not_found(rows, "url").collect()}
    assert sorted(got.values()) == [(1, 2), (2, 1)]
    assert tuple(metrics.contact_totals(rows).first()) == (2, 3, 3, 50.0)
    assert tuple(metrics.contact_totals(rows.limit(0)).first()) == (0, 0, 0, None)
    assert tuple(metrics.progress(rows, spark.range(8)).first()) == (2, 8, 25.0)
    assert tuple(metrics.progress(rows, spark.range(0)).first()) == (2, 0, 0.0)


def test_serial_numbers_over_many_ranges(spark):
    ords = [0, 5, 9, 10, 11, 1000, 1001, 99999]
    df = spark.createDataFrame([(o,) for o in reversed(ords)], "seed_ord long").repartition(3)
    got = {r.seed_ord: r.serial for r in metrics.serial_numbers(df, "seed_ord", 10).collect()}
    assert got == {o: str(i) for i, o in enumerate(ords, 1)}


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_csv_round_trip(spark, rows, tmp_path, delimiter):
    path = str(tmp_path / "out")
    table = outputs.export_projection(rows.withColumn("serial", F.lit("1")))
    assert table.columns == EXPORT_COLUMNS
    assert outputs.write_csv(table, path, delimiter) and outputs.write_csv(table, path, delimiter)
    back = outputs.read_csv(spark, path, table.columns, delimiter)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_nothing_is_written_for_an_empty_result(spark, rows, tmp_path):
    path = tmp_path / "none"
    assert not outputs.write_csv(rows.limit(0), str(path))
    assert not path.exists()


def test_array_to_columns(spark):
    df = spark.createDataFrame([("u", ["1", "2", "3", "4"]), ("v", [])], "url string, phone_numbers array<string>")
    assert [tuple(r) for r in outputs.array_to_columns(df).collect()] == [("u", "1", "2", "3"), ("v", "", "", "")]


# --- response cache ---------------------------------------------------------------------------


PAGES = [(1, "https://a/é?x=1", "<p>é 😀</p>"), (2, "https://b", ""), (3, "https://c", None), (4, None, "x"), (5, "https://d", "d" * 100_000)]


@pytest.fixture(scope="module")
def responses(spark):
    folder = new_path(spark, "responses")
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    assert cache.write_cache(table, folder) == 4
    return folder


def test_responses_are_read_as_pages(spark, responses):
    rows = cache.read_cache(spark, responses).collect()
    assert {(r.url, r.requested_url, r.status, r.html) for r in rows} == {(u, u, 200, h or "") for _, u, h in PAGES if u}
    assert len({r.page_id for r in rows}) == 4 and all(r.page_id >= 0 for r in rows)
    again = {r.page_id for r in cache.read_cache(spark, responses, "page_id").collect()}
    assert again == {r.page_id for r in rows}


def test_bodies_are_read_for_html_only_and_responses_are_whole(spark, tmp_path):
    table = spark.createDataFrame([("https://a", "x"), ("https://b", "y"), ("https://c", "z")], "url string, html string")
    cache.write_cache(table, str(tmp_path))
    entries = {url: next(tmp_path.glob(f"*/{cache.fingerprint(url)}")) for url in ("https://a", "https://b", "https://c")}
    (entries["https://b"] / "meta").unlink()
    assert {r.url for r in cache.read_cache(spark, str(tmp_path)).collect()} == {"https://a", "https://c"}
    assert {r.url for r in cache.read_cache(spark, str(tmp_path), "url", "status").collect()} == {"https://a", "https://c"}
    meta = entries["https://c"] / "meta"
    meta.write_text(repr({"url": "https://c", "response_url": "https://www.c", "status": 301}))
    moved = [r for r in cache.read_cache(spark, str(tmp_path), "url", "requested_url", "status").collect() if r.status == 301]
    assert [(r.url, r.requested_url) for r in moved] == [("https://www.c", "https://c")]


def test_an_empty_cache_has_no_pages(spark, tmp_path):
    assert cache.read_cache(spark, str(tmp_path / "none")).collect() == []


# --- the feed of CSV files ----------------------------------------------------------------------


def test_a_repeated_batch_overwrites_itself(spark, rows):
    folder = new_path(spark, "feed")
    write = outputs.csv_feed(folder, delimiter=";")
    write(rows, 0)
    write(rows.limit(0), 1)
    write(rows.withColumn("url", F.concat("url", F.lit("/2"))), 2)
    write(rows.withColumn("url", F.concat("url", F.lit("/2"))), 2)
    back = outputs.read_feed(spark, folder, rows.columns, ";")
    assert sorted(r.url for r in back.collect()) == sorted(["https://a", 'https://b,"q"', "https://a/2", 'https://b,"q"/2'])
    assert {r.phone_number_3 for r in back.collect()} == {""}


def test_a_stream_that_fails_after_a_batch_writes_it_again_once(spark, rows):
    """The writer is stopped between a batch's files and its commit; the restart repeats the batch."""
    source, folder, checkpoint = (new_path(spark, n) for n in ("items", "feed", "ck"))
    for n in range(3):
        rows.withColumn("url", F.concat("url", F.lit(f"/{n}"))).coalesce(1).write.mode("append").parquet(source)
    write = outputs.csv_feed(folder)

    def fails_once(items, batch):
        write(items, batch)
        if batch == 1:
            raise RuntimeError("stopped")

    def run(each):
        items = inputs.stream_table(spark, source, rows.schema, files_per_trigger=1)
        query = feed.start(items, checkpoint, each=each)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            return False
        return True

    assert not run(fails_once)
    assert outputs.read_feed(spark, folder, rows.columns).count() == 4
    assert run(write)
    back = [r.url for r in outputs.read_feed(spark, folder, rows.columns).collect()]
    assert len(back) == len(set(back)) == 6


# --- resumable stages ---------------------------------------------------------------------------


def test_finished_stages_are_found_again(spark):
    mark = input_mark("x", uuid.uuid4().hex)
    made = []

    def make(n):
        def table():
            made.append(n)
            return spark.range(n).selectExpr("id", "named_struct('a', array(id)) AS `odd name`")
        return table

    assert resumable(spark, mark)("one", make(3)).count() == 3
    again = resumable(spark, mark)("one", make(4))
    assert again.count() == 3 and again.columns == ["id", "odd name"]
    assert resumable(spark, mark)("two", make(5)).count() == 5
    assert resumable(spark, mark + "0")("one", make(6)).count() == 6
    assert made == [3, 5, 6]


def test_a_stage_that_failed_is_made_again(spark):
    keep = resumable(spark, input_mark(uuid.uuid4().hex))
    with pytest.raises(Exception, match="no good"):
        keep("one", lambda: spark.range(3).select(F.raise_error(F.lit("no good"))))
    assert keep("one", lambda: spark.range(2)).count() == 2


def test_the_mark_depends_on_rows_not_on_their_order(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n long, t string")
    assert input_mark(one) == input_mark(one.orderBy(F.desc("n")).repartition(3))
    others = [one.limit(1), one.withColumn("t", F.upper("t")), one.withColumnRenamed("n", "m"), one.dropDuplicates()]
    assert len({input_mark(df) for df in [one, *others]}) == 5
    assert input_mark(one, "x") != input_mark(one, "y")
