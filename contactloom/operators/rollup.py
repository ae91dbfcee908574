"""Per-parent accumulation: distinct pairs, the first three, one wide row."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CONTACTS = 3
ROW_KEY = "row_key"  # a hash of the key columns, first in sort orders: urls begin alike
CONTACT_COLUMNS = [
    f"{name}_{i}" for i in range(1, MAX_CONTACTS + 1) for name in ("phone_number", "country")
]


def explode_pairs(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, number_ord, number, country)`` from a ``pairs`` array per page.

    A filter on the size of a plain column would be inferred and pushed below what makes the pairs, and
    so make them twice.
    """
    none = F.array().cast(pages.schema["pairs"].dataType)
    every = F.posexplode(F.coalesce("pairs", none)).alias("number_ord", "pair")
    return pages.select(*keys, every).select(
        *keys, "number_ord", "pair.number", "pair.country"
    )


def distinct_pairs(pairs: DataFrame, parent: str, rank: list[str]) -> DataFrame:
    """One row per ``(parent, number, country)`` with its first ``rank``.

    The shuffle key holds the pair, so a parent with a third of all rows is spread over tasks, and
    copies of one pair are reduced before the shuffle. A hash goes first in the sort order, since parents begin alike.
    """
    return (
        pairs.groupBy(F.xxhash64(parent, "number", "country").alias("pair_key"), parent, "number", "country")
        .agg(F.min(F.struct(*rank)).alias("rank"))
        .select(parent, "number", "country", "rank.*")
    )


def top_per_key(df: DataFrame, key: str | list[str], order: list[str], n: int = MAX_CONTACTS) -> DataFrame:
    """First ``n`` rows per key, with ``rn`` from 1; each task sends at most ``n`` rows per key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", rn).filter(F.col("rn") <= n)


def pairs_to_columns(top: DataFrame, *keys: str) -> DataFrame:
    """Rows with ``rn`` 1 to 3 -> ``phone_number_1, country_1, ...``; missing ones are null."""
    of = () if ROW_KEY in keys else (F.xxhash64(*keys).alias(ROW_KEY),)
    return top.groupBy(*of, *keys).agg(
        *[
            F.max(F.when(F.col("rn") == i, F.col(source))).alias(f"{name}_{i}")
            for i in range(1, MAX_CONTACTS + 1)
            for source, name in (("number", "phone_number"), ("country", "country"))
        ]
    ).drop(ROW_KEY)


def array_to_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """The same wide row from a ``pairs`` array."""
    return df.select(
        *keys,
        *[
            F.get("pairs", F.lit(i))[source].alias(f"{name}_{i + 1}")
            for i in range(MAX_CONTACTS)
            for source, name in (("number", "phone_number"), ("country", "country"))
        ],
    )


def first_pairs(df: DataFrame) -> DataFrame:
    """Keep a page's first three pairs: no later one can be among its parent's first three."""
    return df.withColumn("pairs", F.slice("pairs", 1, MAX_CONTACTS))


def contacts_of_pairs(pairs: DataFrame, parent: str, rank: list[str]) -> DataFrame:
    """Ranked pairs -> one row per parent with its first three distinct pairs."""
    return (
        distinct_pairs(pairs, parent, rank)
        .withColumn(ROW_KEY, F.xxhash64(parent))
        .transform(lambda df: top_per_key(df, [ROW_KEY, parent], rank))
        .transform(lambda df: pairs_to_columns(df, ROW_KEY, parent))
    )


def new_pairs(pairs: DataFrame, known: DataFrame, parent: str) -> DataFrame:
    """Distinct pairs that are not yet known for their parent."""
    key = [parent, "number", "country"]
    left, right = pairs.select(*key).distinct().alias("l"), known.select(*key).distinct().alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    return left.join(right, same, "left_anti")
