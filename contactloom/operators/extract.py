"""Text blocks, number candidates, postal codes and per-page numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import elements, html, phone


def tel_link_numbers(links: DataFrame, *keys: str) -> DataFrame:
    """``(keys, link_ord, raw)`` of the links that are ``tel:`` links."""
    return links.filter(F.col("href").startswith("tel:")).select(
        *keys, "link_ord", phone.after_last_tel(F.col("href")).alias("raw")
    )


def page_texts(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, text)`` with the whole text of a page in one row, blocks marked."""
    marked = html.marked_text(html.visible_html(F.col("html")))
    return pages.select(*keys, marked.alias("text")).withColumn(
        "text", html.decode_entities(F.col("text"))
    )


def text_blocks(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, block_ord, text)``: the non-blank text blocks of a page in document order."""
    blocks = F.posexplode(html.blocks(F.col("text"))).alias("block_ord", "text")
    return page_texts(pages, *keys).select(*keys, blocks).filter(
        F.col("text").rlike(r"[^\t-\r ]")
    )


def pattern_candidates(texts: DataFrame, *keys: str, patterns: list[str] | None = None) -> DataFrame:
    """``(keys, pattern_ord, match_ord, raw)``: all matches of every pattern, from 1 and 0 on.

    Two generators after one scan of the text: patterns only read the digit runs, and only those
    that match go on. Runs are kept by a generator, since a filter on them would be pushed below the
    projection and find them twice.
    """
    found = F.filter(F.array(phone.digit_runs(F.col("text"), letters=True)), lambda r: r != "")
    runs = texts.select(*keys, F.explode(found).alias("runs"))
    matches = F.array(*phone.pattern_matches(F.col("runs"), patterns or phone.PATTERNS))
    told = F.transform(matches, lambda m, i: F.struct((i + 1).alias("pattern_ord"), m.alias("matches")))
    return (
        runs.select(*keys, F.inline(F.filter(told, lambda x: F.size(x["matches"]) > 0)))
        .select(*keys, "pattern_ord", F.posexplode("matches").alias("match_ord", "raw"))
        .toDF(*keys, "pattern_ord", "match_ord", "raw")
    )


def format_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("number", phone.format_number(F.col("raw")))


def check_candidates(formatted: DataFrame) -> DataFrame:
    """Add ``valid`` and the first failing ``reason``."""
    reason = phone.reject_reason(F.col("number"))
    return formatted.withColumns({"valid": reason.isNull(), "reason": reason})


def rejection_breakdown(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("n")
    )


def zip_codes(texts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, zip_ord, zip)``: distinct 5-digit tokens in order of sighting."""
    return texts.select(
        *keys, F.posexplode(phone.zip_codes(F.col("text"))).alias("zip_ord", "zip")
    )


def _if_any(numbers: Column) -> Column:
    """Generator that keeps a row only if it has numbers.

    A filter on ``size(numbers)`` would be pushed below the projection and find them twice.
    """
    return F.explode(F.filter(F.array(numbers), lambda n: F.size(n) > 0)).alias("numbers")


def numbers_of_texts(texts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, numbers, zips)`` of the plain texts with a valid number; each text is one block.

    A row-to-row step: finding, formatting, checking and the first-sighting dedupe of a text's
    numbers need no shuffle.
    """
    numbers = phone.valid_numbers(None, F.array("text"))
    return texts.select(*keys, "text", _if_any(numbers)).select(
        *keys, "numbers", phone.zip_codes(F.col("text")).alias("zips")
    )


def _hrefs(tel_only: bool) -> Column:
    visible = F.col("visible")
    quoted = html.quoted_hrefs(visible)
    if not tel_only:
        return html.hrefs(quoted)
    # most pages have no such link, and theirs are not looked for
    likely = html.likely_tel_hrefs(quoted)
    return F.when(visible.contains("tel") | visible.contains("&#"), likely).otherwise(F.array().cast("array<string>"))


def _page_parts(pages: DataFrame, *keys: str, tel_only: bool = False) -> DataFrame:
    """``(keys, hrefs, text)``: the two readings of a page; the text's entities are still encoded.

    ``tel_only``: only the links that may be ``tel:`` links are read on.
    """
    visible = pages.select(*keys, html.visible_html(F.col("html")).alias("visible"))
    return visible.select(
        *keys, _hrefs(tel_only).alias("hrefs"), html.marked_text(F.col("visible")).alias("text"),
    )


def _page_numbers(parent_filter: bool) -> Column:
    runs = None if parent_filter else phone.runs_of_blocks(html.digit_text(F.col("text")), html.BLOCK_MARK)
    return phone.valid_numbers(html.tel_hrefs(F.col("hrefs")), None, runs)


def _page_zips() -> Column:
    return phone.zip_codes(html.decode_entities(F.col("text")))


def numbers_of_pages(pages: DataFrame, *keys: str, parent_filter: bool = False) -> DataFrame:
    """``(keys, numbers, zips)`` of the HTML pages with a valid number, without a shuffle.

    ``parent_filter`` drops every text match, since the enclosing element always holds the same
    text; only ``tel:`` links are left.
    """
    parts = _page_parts(pages, *keys, tel_only=True)
    return parts.select(*keys, "text", _if_any(_page_numbers(parent_filter))).select(
        *keys, "numbers", _page_zips().alias("zips")
    )


def _numbers_of_all(pages: DataFrame, *keys: str, parent_filter: bool, nested: bool, tel_only: bool) -> DataFrame:
    """``(keys, numbers, zips, hrefs)`` of all HTML pages, with a number or without."""
    none = F.array().cast("array<string>")
    if nested and not parent_filter:
        parts, numbers, page_zips = _element_parts(pages, *keys, tel_only=tel_only), _element_numbers(), _element_zips()
        text = "page"
    else:
        parts, numbers, page_zips = _page_parts(pages, *keys, tel_only=tel_only), _page_numbers(parent_filter), _page_zips()
        text = "text"
    found = parts.select(*keys, text, "hrefs", numbers.alias("numbers"))
    zips = F.when(F.size("numbers") > 0, page_zips).otherwise(none)
    return found.select(*keys, "numbers", zips.alias("zips"), "hrefs")


def numbers_and_links(pages: DataFrame, *keys: str, parent_filter: bool = False, nested: bool = False) -> DataFrame:
    """``(keys, numbers, zips, links)`` of all HTML pages; ``links`` are raw hrefs with their place.

    ``nested`` reads numbers and zips element by element, as ``numbers_of_elements`` does.
    """
    found = _numbers_of_all(pages, *keys, parent_filter=parent_filter, nested=nested, tel_only=False)
    links = F.transform("hrefs", lambda h, i: F.struct(i.alias("link_ord"), h.alias("href")))
    return found.select(*keys, "numbers", "zips", links.alias("links"))


def numbers_of_all_pages(pages: DataFrame, *keys: str, parent_filter: bool = False, nested: bool = False) -> DataFrame:
    """``numbers_and_links`` without the links: those that are no ``tel:`` links are not read on."""
    return _numbers_of_all(pages, *keys, parent_filter=parent_filter, nested=nested, tel_only=True).drop("hrefs")


def _page_elements(pages: DataFrame, *keys: str) -> DataFrame:
    visible = pages.select(*keys, html.visible_html(F.col("html")).alias("visible"))
    return visible.select(*keys, "visible", elements.page_elements(F.col("visible")).alias("page"))


def element_texts(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, element_ord, tag, text, parent_text)``: every text element's own text, nested ones included.

    In document order, so an element comes before those inside it and its text holds theirs.
    ``parent_text`` is the text of the element around it, the whole page's if there is none.
    """
    found = _page_elements(pages, *keys).select(*keys, "page.text", F.col("page.elements").alias("every"))
    one, text = F.col("one"), F.col("text")
    around = F.substring(text, one["around_start"] + 1, one["around_end"] - one["around_start"])
    return found.select(*keys, "text", F.explode(F.filter("every", elements.is_text_tag)).alias("one")).select(
        *keys, one["ord"].alias("element_ord"), one["tag"].alias("tag"), elements.text_of(text, one).alias("text"),
        around.alias("parent_text"),
    )


def _element_parts(pages: DataFrame, *keys: str, tel_only: bool = False) -> DataFrame:
    """``(keys, page, hrefs, runs)``: text and elements of a page, its links, and its elements' digit runs."""
    return _page_elements(pages, *keys).select(
        *keys, "page", _hrefs(tel_only).alias("hrefs"), elements.runs_of_elements(F.col("page")).alias("runs")
    )


def _element_numbers() -> Column:
    return phone.valid_numbers(html.tel_hrefs(F.col("hrefs")), None, F.col("runs"))


def _element_zips() -> Column:
    page = F.col("page")
    texts = F.transform(F.filter(page["elements"], elements.is_text_tag), lambda e: elements.text_of(page["text"], e))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: phone.zip_codes(t))))


def numbers_of_elements(pages: DataFrame, *keys: str) -> DataFrame:
    """``(keys, numbers, zips)`` of the pages with a valid number, read element by element.

    Every text element is read with all that is nested in it: tel: links first, then the elements in
    document order, so a number that is split over two blocks is found in the element around them.
    Text outside all text elements is not read. A row-to-row step, like ``numbers_of_pages``.
    """
    return _element_parts(pages, *keys, tel_only=True).select(*keys, "page", _if_any(_element_numbers())).select(
        *keys, "numbers", _element_zips().alias("zips")
    )


def outside_parent(candidates: DataFrame, mark: str | None = None) -> DataFrame:
    """Candidates ``(raw, parent_text, ...)`` that do not stand in the text of the element around theirs.

    With ``mark``, all of them, and a column of that name that says of each whether it is one.
    """
    outside = ~F.col("parent_text").contains(F.trim("raw"))
    if mark is None:
        return candidates.filter(outside)
    return candidates.withColumn(mark, F.coalesce(outside, F.lit(False)))


def page_numbers(found: DataFrame, *keys: str) -> DataFrame:
    """``(keys, number_ord, number)``: a page's distinct numbers in order of first sighting."""
    return found.select(*keys, F.posexplode("numbers").alias("number_ord", "number"))
