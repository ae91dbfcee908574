import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contactloom.operators import metrics
from contactloom.plans import contacts
from contactloom.sources import inputs
from contactloom.sources.shared import new_path
from contactloom.streaming import feed

PAGES = "page_id long, url string, parent_url string, html string"


def html(*numbers, zip_code=""):
    return "".join(f"<p>{n}</p>" for n in numbers) + f"<p>{zip_code}</p>"


# Batches in page order; urls come again in later batches, and parent b gets its numbers late.
BATCHES = [
    [(1, "a/1", "a", html("202-555-0101")), (2, "b/1", "b", html()), (3, "c/1", "c", html("416-555-0101", zip_code="10001"))],
    [(4, "a/1", "a", html("202-555-9999")), (5, "a/2", "a", html("202-555-0101", "202-555-0102")), (6, "b/2", "b", html("312-555-0100")), (60, "a/x.pdf", "a", html("202-555-7777"))],
    [(7, "a/3", "a", html("202-555-0103", "202-555-0104")), (8, "b/3", "b", html("312-555-0101")), (9, "c/2", "c", html("416-555-0101"))],
]


@pytest.fixture(scope="module")
def stored(spark):
    path = new_path(spark, "batches")
    for batch in BATCHES:  # file times order the stream's batches
        spark.createDataFrame(batch, PAGES).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def postal(spark):
    return spark.createDataFrame([("10001", "US")], "zip string, country string")


def run(stream, path, checkpoint=None):
    spark = stream.sparkSession
    feed.start(stream, checkpoint or new_path(spark, "ck"), path=path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@pytest.fixture(scope="module")
def hits(spark, stored, postal):
    pages = inputs.stream_table(spark, stored, PAGES, files_per_trigger=1)
    stream = feed.page_hits(pages, postal)
    path = new_path(spark, "hits")
    run(stream, path)
    return lambda: inputs.stream_table(spark, path, stream.schema, files_per_trigger=1)


def rows(df):
    return sorted(tuple(v for v in r if v is not None) for r in df.select("url", *feed.CONTACT_COLUMNS).collect())


def test_first_hits_are_emitted_once(spark, hits):
    out = run(feed.first_hits(hits()), new_path(spark, "first"))
    assert rows(out) == [
        ("a", "2025550101", "US"), ("b", "3125550100", "US"), ("c", "4165550101", "US"),
    ]


def test_growing_contacts_end_at_the_batch_result(spark, hits):
    changes = run(feed.growing_contacts(hits()), new_path(spark, "changes"))
    current = feed.current_contacts(changes)
    assert rows(current) == [
        ("a", "2025550101", "US", "2025550102", "US", "2025550103", "US"),
        ("b", "3125550100", "US", "3125550101", "US"),
        ("c", "4165550101", "US", "4165550101", "CA"),
    ]
    assert changes.count() > current.count()


def test_growing_contacts_equal_batch_contacts(spark, stored, postal, hits):
    pages = spark.read.schema(PAGES).parquet(stored)
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    once = pages.drop("parent_url").join(first, ["url", "page_id"], "left_semi")
    batch = contacts.page_pairs(once, "url", "page_id", postal=postal).withColumn("seed_ord", F.col("page_id"))
    ranked = batch.selectExpr("left(url, 1) AS parent_url", "url", "0 AS depth", "seed_ord", "0 AS link_ord", "pairs")
    changes = run(feed.growing_contacts(hits()), new_path(spark, "changes"))
    assert rows(feed.current_contacts(changes)) == rows(contacts.contacts_final(ranked))


def test_running_totals_end_at_the_batch_totals(spark, hits):
    path = new_path(spark, "first")
    first = feed.first_hits(hits())
    run(first, path)
    items = inputs.stream_table(spark, path, first.schema, files_per_trigger=1)
    feed.start(feed.running_totals(items), new_path(spark, "ck"), "complete", table="totals").awaitTermination()
    want = metrics.contact_totals(spark.read.schema(first.schema).parquet(path)).collect()
    assert spark.table("totals").collect() == want and want[0].urls_processed == 3


def test_restart_goes_on_from_the_checkpoint(spark, stored):
    """Two runs over one checkpoint, with pages arriving in between, equal one run."""
    pages = spark.read.schema(PAGES).parquet(stored).orderBy("page_id").collect()
    source, out, checkpoint = (new_path(spark, n) for n in ("pages", "out", "ck"))

    def arrive(some):
        spark.createDataFrame(some, PAGES).coalesce(1).write.mode("append").parquet(source)

    def urls():
        return feed.distinct_urls(inputs.stream_table(spark, source, PAGES)).select("url")

    arrive(pages[:4])
    first = {r.url for r in run(urls(), out, checkpoint).collect()}
    assert first == {"a/1", "b/1", "c/1"}
    arrive(pages[4:])
    both = [r.url for r in run(urls(), out, checkpoint).collect()]
    assert sorted(both) == ["a/1", "a/2", "a/3", "b/1", "b/2", "b/3", "c/1", "c/2"]


def test_a_first_copy_without_a_number_counts(spark):
    """A later copy of a url is not looked at, whether it comes in another batch or not."""
    source, out = new_path(spark, "pages"), new_path(spark, "out")
    for some in ([(1, "a/1", "a", "<p>none</p>")], [(2, "a/1", "a", "<p>202-555-0100</p>"), (3, "a/2", "a", "<p>202-555-0101</p>")]):
        spark.createDataFrame(some, "page_id long, url string, parent_url string, html string").select(
            *[c.split()[0] for c in PAGES.split(", ")]
        ).coalesce(1).write.mode("append").parquet(source)
    hits = feed.page_hits(inputs.stream_table(spark, source, PAGES, files_per_trigger=1))
    assert [r.url for r in run(hits, out).collect()] == ["a/2"]


@pytest.fixture(scope="module")
def busy(spark):
    """Many copies of few urls over four batches; parent ``a`` has most pages."""
    rng = random.Random(4)
    batches, page_id = [], 0
    for _ in range(4):
        batch = []
        for _ in range(120):
            page_id += 1
            parent = rng.choice("aaaaaabc")
            numbers = [f"202-555-{rng.randrange(40):04d}" for _ in range(rng.choice([0, 0, 1, 2]))]
            batch.append((page_id, f"{parent}/{rng.randrange(60)}", parent, html(*numbers)))
        rng.shuffle(batch)
        batches.append(batch)
    path = new_path(spark, "busy")
    for batch in batches:
        spark.createDataFrame(batch, PAGES).coalesce(1).write.mode("append").parquet(path)
    return path, batches


def test_repeated_urls_over_batches_equal_the_batch_jobs(spark, busy):
    path, batches = busy
    pages = [(n, *page) for n, batch in enumerate(batches) for page in batch]
    kept = {}
    for page in sorted(pages, key=lambda p: p[:2]):
        kept.setdefault(page[2], page)
    once = spark.createDataFrame([(p[1], p[2], p[4], p[0]) for p in kept.values()], "page_id long, url string, html string, batch int")
    stream = feed.page_hits(inputs.stream_table(spark, path, PAGES, files_per_trigger=1))
    stored = run(stream, new_path(spark, "hits"))
    batch = contacts.page_pairs(once, "url", "page_id", "batch")
    assert {(r.url, r.page_id, len(r.pairs)) for r in stored.collect()} == {(r.url, r.page_id, len(r.pairs)) for r in batch.collect()}
    hits = lambda: inputs.stream_table(spark, stored.inputFiles()[0].rsplit("/", 1)[0], stream.schema, files_per_trigger=1)
    ranked = batch.selectExpr("left(url, 1) AS parent_url", "url", "0 AS depth", "page_id AS seed_ord", "0 AS link_ord", "pairs")
    changes = run(feed.growing_contacts(hits(), parts=4), new_path(spark, "changes"))
    assert rows(feed.current_contacts(changes)) == rows(contacts.contacts_final(ranked))


def test_first_hit_of_a_parent_in_parts_equals_the_batch_job(spark, busy):
    """All hits in one batch: the parent's first page is in one of its parts."""
    path, _ = busy
    stream = feed.page_hits(inputs.stream_table(spark, path, PAGES))
    source = new_path(spark, "hits")
    stored = run(stream, source)
    ranked = stored.selectExpr("parent_url", "url", "0 AS depth", "page_id AS seed_ord", "0 AS link_ord", "pairs")
    want = rows(contacts.contacts_first_hit(ranked))
    for parts in (1, 5):
        first = run(feed.first_hits(inputs.stream_table(spark, source, stream.schema), parts), new_path(spark, "first"))
        assert rows(first) == want and len(want) == 3


@pytest.mark.parametrize("job", ["page_hits", "distinct_urls"])
def test_urls_are_forgotten_behind_the_watermark(spark, job):
    """With a time column the state holds the urls of the last hour only, and a later copy counts anew."""
    schema = f"{PAGES}, seen timestamp"
    source, out, checkpoint = (new_path(spark, n) for n in ("pages", "out", "ck"))

    def arrive(page_id, url, hour):
        row = (page_id, url, "a", html("202-555-0100"), datetime(2024, 1, 1, hour))
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)

    arrive(1, "a/1", 0)
    arrive(2, "a/1", 0)
    arrive(3, "a/2", 9)
    arrive(4, "a/3", 12)
    arrive(5, "a/1", 13)
    pages = inputs.stream_table(spark, source, schema, files_per_trigger=1)
    stream = feed.page_hits(pages, time="seen") if job == "page_hits" else feed.distinct_urls(pages, "seen").select("url", "page_id")
    query = feed.start(stream, checkpoint, path=out)
    query.awaitTermination()
    got = sorted((r.url, r.page_id) for r in spark.read.schema(stream.schema).parquet(out).collect())
    assert got == [("a/1", 1), ("a/1", 5), ("a/2", 3), ("a/3", 4)]
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) == 2  # of three urls


def test_zips_are_looked_up_in_the_row(spark):
    codes = [("00001", "US"), ("00002", "US"), ("00003", "CA"), ("00007", "US"), ("K1A0B1", "CA"), ("99999", "CA")]
    look = feed.zip_country_of(spark.createDataFrame(codes, "zip string, country string"))
    zips = [["00002"], ["00003", "00001"], ["00004", "99999"], ["00008"], [], ["K1A0B1"], ["１２３４５", "00007"], None]
    df = spark.createDataFrame([(z,) for z in zips], "zips array<string>")
    assert [r[0] for r in df.select(look(F.col("zips"))).collect()] == ["US", "CA", "CA", None, None, None, "US", None]
    nothing = feed.zip_country_of(spark.createDataFrame([], "zip string, country string"))
    assert {r[0] for r in df.select(nothing(F.col("zips"))).collect()} == {None}


def test_a_restarted_streams_rows_are_dealt_to_every_core(spark, monkeypatch):
    """A trigger reads one file; its pages are read by all tasks, not by the file's one."""
    from checks import registry
    from tests.conftest import SF

    started = []

    def captured(stream, *args, **options):
        started.append(stream)
        raise InterruptedError

    monkeypatch.setattr(registry, "_start", captured)
    with pytest.raises(InterruptedError):
        registry.stream_restart(spark, SF)
    assert "Repartition" in started[0]._jdf.queryExecution().analyzed().toString()


def _operators(stream, path):
    query = feed.start(stream, new_path(stream.sparkSession, "ck"), path=path)
    query.awaitTermination()
    return [o.operatorName for o in query.lastProgress.stateOperators]


def test_first_copies_and_hits_need_no_python_call_per_key(spark, busy):
    path, _ = busy
    out = new_path(spark, "hits")
    stream = feed.page_hits(inputs.stream_table(spark, path, PAGES))
    assert _operators(stream, out) == ["dedupe"]
    first = feed.first_hits(inputs.stream_table(spark, out, stream.schema))
    assert _operators(first, new_path(spark, "first")) == ["dedupe"]


def test_lowest_of_a_batch_takes_null_keys_and_ids(spark):
    source, out = new_path(spark, "copies"), new_path(spark, "out")
    rows = [(None, "a", 1), (3, "a", 2), (2, "a", 3), (2, None, 4), (1, None, 5), (None, "b", 6)]
    schema = "page_id long, url string, n int"
    for some in (rows, [(0, "a", 7), (1, "c", 8), (0, None, 9)]):
        spark.createDataFrame(some, schema).repartition(3).write.mode("append").parquet(f"{source}/{len(some)}")
    streams = (inputs.stream_table(spark, f"{source}/{n}", schema) for n in (6, 3))
    assert sorted(r.n for r in run(feed.first_copies(next(streams)), out).collect()) == [3, 5, 6]
    assert sorted(r.n for r in run(feed.first_copies(next(streams)), new_path(spark, "out")).collect()) == [7, 8, 9]


@pytest.mark.parametrize("buckets", [1, 7])
def test_parts_of_a_bucket_are_told_apart(spark, busy, monkeypatch, buckets):
    """Many parts share a bucket's state; the contacts are those of the batch job."""
    monkeypatch.setattr(feed, "BUCKETS", buckets)
    path, _ = busy
    out = new_path(spark, "hits")
    stream = feed.page_hits(inputs.stream_table(spark, path, PAGES, files_per_trigger=1))
    ranked = run(stream, out).selectExpr("parent_url", "url", "0 AS depth", "page_id AS seed_ord", "0 AS link_ord", "pairs")
    hits = inputs.stream_table(spark, out, stream.schema, files_per_trigger=1)
    changes = run(feed.growing_contacts(hits, parts=4), new_path(spark, "changes"))
    assert rows(feed.current_contacts(changes)) == rows(contacts.contacts_final(ranked))
    assert changes.groupBy("url", "part", "revision").count().filter("count > 1").isEmpty()


def test_blocks_of_a_bucket_split_as_it_grows(spark, busy, monkeypatch):
    """Parts move to other blocks with all they hold: the contacts are the batch job's, revisions count on."""
    monkeypatch.setattr(feed, "BUCKETS", 2)
    monkeypatch.setattr(feed, "BLOCK_PARTS", 1)
    path, _ = busy
    out = new_path(spark, "hits")
    stream = feed.page_hits(inputs.stream_table(spark, path, PAGES, files_per_trigger=1))
    # one more parent a batch, so that blocks that hold something are split
    odd = F.when(F.col("page_id") % 7 == 0, F.concat("parent_url", (F.col("page_id") / 60).cast("int"), F.lit('"ä\n'))).otherwise(F.col("parent_url"))
    named = stream.withColumn("parent_url", F.when(F.col("page_id") % 11 != 0, odd))
    stored = run(named, out)
    hits = inputs.stream_table(spark, out, named.schema, files_per_trigger=1)
    changes = run(feed.growing_contacts(hits, parts=16), new_path(spark, "changes"))
    ranked = stored.selectExpr("parent_url", "url", "0 AS depth", "page_id AS seed_ord", "0 AS link_ord", "pairs")
    assert sorted(map(str, feed.current_contacts(changes).collect())) == sorted(map(str, contacts.contacts_final(ranked).collect()))
    counts = changes.groupBy("url", "part").agg(F.count("*").alias("n"), F.max("revision").alias("last"))
    assert counts.filter("n != last").isEmpty() and counts.count() > 40


def test_a_bucket_of_growing_contacts_asks_the_state_once_for_many_parts():
    """Reads and writes of state, counted: 200 parts in one bucket take few."""
    import json
    from types import SimpleNamespace

    calls = []

    def kept(of):
        return SimpleNamespace(
            get=lambda: calls.append("get") or of.get(()), exists=lambda: () in of, update=lambda v: calls.append("update") or of.update({(): v}),
            getValue=lambda k: calls.append("get") or of.get(k), updateValue=lambda k, v: calls.append("update") or of.update({k: v}),
            containsKey=lambda k: k in of,
        )

    job = feed.GrowingContacts()
    job.init(SimpleNamespace(getValueState=lambda *_: kept({}), getMapState=lambda *_: kept({})))
    pages = [{"parent_url": f"p{i}", "part": i % 3, "page_id": i, "pairs": [{"number": str(i), "country": None}]} for i in range(200)]
    rows = [SimpleNamespace(page=json.dumps(p)) for p in pages]
    first = [c for row in job.handleInputRows((0,), rows, None) for c in json.loads(row.changes)]
    assert len(first) == 200 and {c["revision"] for c in first} == {1} and len(calls) < 30
    assert list(job.handleInputRows((0,), rows, None)) == []
