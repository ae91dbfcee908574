"""Country of a page from its postal codes, and of a number from its prefix."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.dialing import country_of_number
from contactloom.sources.shared import shared_table


def five_digit_postal(postal: DataFrame) -> DataFrame:
    """``(zip, country)`` of the postal rows a 5-digit token can match, one row per zip.

    At most 100,000 rows whatever the table holds, so safe to broadcast. Of several countries of
    one zip the first in the alphabet is taken; ``inputs.last_country_per_zip`` decides by order.
    """
    five = postal.filter(F.col("zip").rlike(r"^[0-9]{5}\z"))
    return F.broadcast(five.groupBy("zip").agg(F.min("country").alias("country")))


def numbered(found: DataFrame, name: str) -> DataFrame:
    """``found`` as a stored table whose rows have a number, ``row_id``: what ``zip_country`` reads."""
    return shared_table(found.withColumn("row_id", F.monotonically_increasing_id()), name)


def zip_country(found: DataFrame, postal: DataFrame) -> DataFrame:
    """Add ``zip_country`` to numbered rows with a ``zips`` array: the first zip that has a country.

    Only ``(row_id, zip_ord, zip)`` of the rows with zips is exploded and looked up, and only what has
    a country is folded, by row. Rows without zips take part in nothing. A row's number is its own, so
    no list of zips that many rows share meets in one task.
    """
    listed = found.filter(F.size("zips") > 0)
    known = (
        listed.select("row_id", F.posexplode("zips").alias("zip_ord", "zip"))
        .join(five_digit_postal(postal), "zip")
        .groupBy("row_id").agg(F.min(F.struct("zip_ord", "country")).alias("first"))
        .select("row_id", F.col("first.country").alias("zip_country"))
    )
    looked_up = listed.drop("zip_country", "zips").join(known, "row_id", "left")
    others = found.filter("size(zips) <= 0 OR zips IS NULL").drop("zip_country", "zips")
    nothing = F.lit(None).cast("string").alias("zip_country")
    return looked_up.unionByName(others.select("*", nothing)).drop("row_id")


def resolve_country(number: Column, zip_country: Column) -> Column:
    """The page's zip country for all its numbers, else the number's own country."""
    return F.coalesce(zip_country, country_of_number(number))


def pair_array(numbers: Column, zip_country: Column) -> Column:
    """Numbers of one page -> array of ``(number, country)``."""
    return F.transform(
        numbers,
        lambda n: F.struct(n.alias("number"), resolve_country(n, zip_country).alias("country")),
    )
