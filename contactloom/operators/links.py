"""Links of pages: extraction, filters, resolution."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.fixed_values import LINK_KEYWORDS, SOCIAL_DOMAINS, UNWANTED_EXTENSIONS
from contactloom.functions.html import hrefs, quoted_hrefs, visible_html

_SUFFIXES = "|".join(ext[1:] for ext in UNWANTED_EXTENSIONS)
_LONGEST = max(map(len, UNWANTED_EXTENSIONS))
# told by their first letter, so that a place is not compared with every word
_FIRST = "".join(sorted({word[0] for word in LINK_KEYWORDS}))
_KEYWORDS = rf"(?i)(?=[{_FIRST}])(?:{'|'.join(sorted(LINK_KEYWORDS))})"


def has_unwanted_extension(url: Column) -> Column:
    """The whole url, lower-cased, ends in a file suffix (``a.pdf?x=1`` does not)."""
    end = F.substring(url, -_LONGEST, _LONGEST)
    return end.contains(".") & F.lower(end).rlike(rf"\.(?:{_SUFFIXES})\z")


def drop_unwanted_extensions(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.filter(~has_unwanted_extension(F.col(url)))


def link_lists(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, hrefs)``: every ``<a href>`` of a page in one array, decoded, not resolved."""
    return pages.select(*keys, hrefs(quoted_hrefs(visible_html(F.col("html")))).alias("hrefs"))


def page_links(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, link_ord, href)``: every ``<a href>`` in document order, not resolved.

    Hrefs are decoded below the generator, once each: a filter on them would be pushed below a
    projection and decode them again for each of its conditions.
    """
    every = F.posexplode(F.coalesce("hrefs", F.array().cast("array<string>"))).alias("link_ord", "href")
    return link_lists(pages, *keys).select(*keys, every)


def is_relevant(href: Column) -> Column:
    return href.rlike(_KEYWORDS)


def is_social(href: Column) -> Column:
    return reduce(Column.__or__, [href.contains(domain) for domain in SOCIAL_DOMAINS])


def is_internal(href: Column, base_url: Column) -> Column:
    return href.startswith("/") | href.contains(base_url)


def relevant_links(links: DataFrame) -> DataFrame:
    return links.filter(is_relevant(F.col("href")))


def not_social_links(links: DataFrame) -> DataFrame:
    return links.filter(~is_social(F.col("href")))


def fold_dots(url: Column) -> Column:
    """The url with ``.`` and ``..`` segments of its path worked off; ``..`` stops at the host."""
    origin = F.substring_index(url, "/", 3)
    query = F.regexp_extract(url, r"\?.*\z", 0)
    path = F.substring_index(F.substring(url, F.length(origin) + 2, F.length(url)), "?", 1)
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments, none,
        lambda kept, x: F.when(x == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(none))
        .when(x == ".", kept).otherwise(F.concat(kept, F.array(x))),
    )
    # a path that ends in a dot segment is a folder
    whole = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(
        url.contains("/.") & url.rlike(r"^[^?]*/\.{1,2}(?:/|\?|\z)"), F.concat(origin, F.lit("/"), F.array_join(whole, "/"), query)
    ).otherwise(url)


def resolve(link: Column, base_url: Column) -> Column:
    """Absolute url of a link without fragment; null for links that are no page.

    ``.`` and ``..`` segments of links to the page's own host are worked off.
    """
    page = F.substring_index(F.substring_index(base_url, "#", 1), "?", 1)
    origin = F.substring_index(page, "/", 3)
    after_last_slash = F.length(F.substring_index(page, "/", -1))
    folder = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(
        F.left(page, F.length(page) - after_last_slash)
    )
    lower = F.lower(link)
    return (
        F.when(link == "", F.substring_index(base_url, "#", 1))
        .when(lower.startswith("http://") | lower.startswith("https://"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(base_url, "/", 1), link))
        .when(link.startswith("/"), fold_dots(F.concat(origin, link)))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .otherwise(fold_dots(F.concat(folder, link)))
    )


def follow(links: DataFrame, base_url: str) -> DataFrame:
    """Links that lead to a page, with the resolved ``target``.

    The target is kept by a generator, since a filter on it would be pushed below the projection
    and work the target out again for each condition.
    """
    link = F.substring_index(F.trim("href"), "#", 1)
    target = F.array(resolve(F.col("link"), F.col(base_url)))
    kept = F.filter(target, lambda t: t.isNotNull() & ~has_unwanted_extension(t))
    return links.withColumn("link", link).withColumn("target", F.explode(kept)).drop("link")


def frontier_links(links: DataFrame, base_url: str) -> DataFrame:
    """Links worth following, with the resolved ``target``."""
    relevant = links.transform(relevant_links).transform(not_social_links)
    return follow(relevant, base_url)


def keyed(df: DataFrame, url: str) -> DataFrame:
    """Add ``url_key``, a hash of the url, for joins by url: it goes first in their sort order.

    Urls begin alike, so a sort by url alone compares whole strings at nearly every step.
    """
    return df.withColumn("url_key", F.xxhash64(url))


def first_copies(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Keep what was found on the first copy of each url: the one with the lowest ``page_id``.

    Copies are told apart on the key columns alone, so HTML is neither read again nor shuffled,
    and a url with very many copies is reduced before the shuffle. The join is by ``(url,
    page_id)``, which spreads the copies of one url.
    """
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).transform(keyed, "url")
    kept = results.transform(keyed, "url").join(first, ["url_key", "url", "page_id"], "left_semi")
    return kept.dropDuplicates().select(*results.columns)
