"""Seed lists, postal reference tables and page tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED_SCHEMA = "domain string"
POSTAL_SCHEMA = "Zip string, Country string"
PAGE_SCHEMA = "page_id long, url string, html string"


def _with_position(df: DataFrame) -> DataFrame:
    """Add where a row stands in its files: ``split`` (file, offset) and ``row_in_scan``."""
    split = F.struct("_metadata.file_path", "_metadata.file_block_start")
    return df.withColumns({"split": split, "row_in_scan": F.monotonically_increasing_id()})


def not_blank(value: Column) -> Column:
    return value.rlike(r"\S")


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV whose first column is a domain -> ``(seed_ord, domain)`` in file order.

    Rows are numbered without a one-task sort: each file split counts its rows, a running sum over
    the splits (one row each) gives its offset, and rows add their place in the split. Blank cells
    are dropped.
    """
    rows = _with_position(spark.read.schema(SEED_SCHEMA).csv(path, header=False))
    splits = rows.groupBy("split").agg(
        F.count("*").alias("n"), F.min("row_in_scan").alias("first_row")
    )
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "split", "first_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return (
        rows.join(offsets, "split")
        .filter(not_blank(F.col("domain")))
        .select(
            (F.col("offset") + F.col("row_in_scan") - F.col("first_row")).alias("seed_ord"),
            F.trim("domain").alias("domain"),
        )
    )


def single_seed(seeds: DataFrame, domain: str) -> DataFrame:
    """The job for one typed domain: its row of ``seeds``; blank input is an error."""
    domain = domain.strip()
    if not domain:
        raise ValueError("a job for one domain needs a domain")
    return seeds.filter(F.col("domain") == domain)


def one_seed(spark: SparkSession, domain: str) -> DataFrame:
    """A seed table of one typed domain."""
    seeds = spark.range(1).select(F.col("id").alias("seed_ord"), F.lit(domain.strip()).alias("domain"))
    return single_seed(seeds, domain)


def seed_urls(seeds: DataFrame) -> DataFrame:
    """Add ``url``: ``https://`` before the domain, whatever it holds."""
    return seeds.withColumn("url", F.concat(F.lit("https://"), F.col("domain")))


def build_postal(ca: DataFrame, us: DataFrame) -> DataFrame:
    """Two country tables -> ``(Zip, Country)``, Canada first."""
    return ca.select("Zip", F.lit("CA").alias("Country")).unionByName(
        us.select("Zip", F.lit("US").alias("Country"))
    )


def last_country_per_zip(rows: DataFrame, order: Column) -> DataFrame:
    """``(zip, country)`` with one row per zip: the last one in ``order`` wins."""
    return rows.groupBy(F.col("Zip").alias("zip")).agg(
        F.max_by(F.col("Country"), order).alias("country")
    )


def load_postal(spark: SparkSession, path: str) -> DataFrame:
    """``Zip,Country`` CSV -> ``(zip, country)``; keys stay strings, the last row of a zip wins."""
    rows = _with_position(spark.read.schema(POSTAL_SCHEMA).csv(path, header=True))
    return last_country_per_zip(
        rows.filter(F.col("Zip").isNotNull()), F.struct("split", "row_in_scan")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table of fetched pages; columns that a query does not use are never read."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
