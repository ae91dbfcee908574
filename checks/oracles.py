"""DuckDB SQL for every registered query that SQL can express."""

import re

from checks import derived
from contactloom.functions import phone
from contactloom.functions.dialing import dial_plan
from contactloom.functions.fixed_values import (
    LINK_KEYWORDS,
    NAMED_ENTITIES,
    SOCIAL_DOMAINS,
    UNWANTED_EXTENSIONS,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _decode(s: str) -> str:
    numeric = (
        f"CASE WHEN contains({s}, '&#') THEN array_to_string(list_transform(string_split({s}, '&#'), "
        "lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[0-9]{1,7}') THEN "
        "chr(CAST(regexp_extract(x, '^([0-9]{1,7})', 1) AS INTEGER)) || "
        f"regexp_replace(x, '^[0-9]{{1,7}};?', '') ELSE '&#' || x END), '') ELSE {s} END"
    )
    for name, char in NAMED_ENTITIES.items():
        numeric = f"replace({numeric}, {_q(name)}, {_q(char)})"
    return f"replace({numeric}, '&amp;', '&')"


# How the SQL reads tags: a quote opens a value after "=" only, and may hold ">".
_REST = """(?:[^>=]|=\\s*(?:"[^"]*"|'[^']*')?)*(?:>|$)"""
_BREAKS = "p|div|li|footer|section|header|aside|blockquote|address|nav|article|h[1-6]|ul|ol|table|tr|td|br"
A_TAG = rf"(?i)<a\b{_REST}"
BREAK_TAG = rf"(?i)</?(?:{_BREAKS})\b{_REST}"
ANY_TAG = rf"<[a-zA-Z/!?]{_REST}"
HREF = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<title\b.*?(?:</title\s*>|$)"


def _visible(s: str) -> str:
    return f"regexp_replace({s}, {_q(UNSEEN)}, '', 'g')"


def _links(pages: str, keys: str) -> str:
    return f"""
    SELECT {keys}, link_ord, {_decode("regexp_replace(quoted, '^[''\"]|[''\"]$', '', 'g')")} AS href
    FROM (SELECT {keys}, unnest(range(len(h))) AS link_ord, unnest(h) AS quoted
          FROM (SELECT {keys}, list_filter(list_transform(
                  regexp_extract_all({_visible('html')}, {_q(A_TAG)}), lambda t: regexp_extract(t, {_q(HREF)}, 1)),
                  lambda x: x <> '') AS h
                FROM {pages}))"""


def _texts(pages: str, keys: str) -> str:
    marked = f"regexp_replace({_visible('html')}, {_q(BREAK_TAG)}, chr(1), 'g')"
    stripped = f"regexp_replace({marked}, {_q(ANY_TAG)}, '', 'g')"
    return f"SELECT {keys}, {_decode('s')} AS text FROM (SELECT {keys}, {stripped} AS s FROM {pages})"


def _blocks(texts: str, keys: str) -> str:
    return f"""
    SELECT {keys}, block_ord, text
    FROM (SELECT {keys}, unnest(range(len(b))) AS block_ord, unnest(b) AS text
          FROM (SELECT {keys}, string_split(text, chr(1)) AS b FROM {texts}))
    WHERE regexp_matches(text, '[^\\t-\\r ]')"""


def _candidates(texts: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({i} AS INTEGER) AS pattern_ord, "
        "CAST(unnest(range(len(m))) AS INTEGER) AS match_ord, unnest(m) AS raw "
        f"FROM (SELECT {keys}, regexp_extract_all(text, {_q(p)}) AS m FROM {texts})"
        for i, p in enumerate(phone.PATTERNS, 1)
    )


def _format(raw: str) -> str:
    return rf"regexp_replace(regexp_replace({raw}, '^(\+91|0)', ''), '[^\p{{Nd}}+]', '', 'g')"


def _reason(number: str) -> str:
    digits = rf"regexp_replace({number}, '[^\p{{Nd}}]', '', 'g')"
    runs = "|".join(f"{d}{{7}}" for d in range(10))
    return f"""CASE WHEN length({digits}) < 10 OR length({digits}) > 12 THEN 'length'
      WHEN regexp_matches({digits}, '^({runs})') THEN 'repeat_run'
      WHEN contains({digits}, '168') THEN 'contains_168'
      WHEN length({digits}) > 11 THEN 'length_12'
      WHEN starts_with({digits}, '1790') THEN 'prefix_1790' END"""


def _zips(texts: str, keys: str) -> str:
    """Whole words of five digits, each at its first place in the text."""
    return f"""
    SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY min(word_ord)) - 1 AS zip_ord, zip
    FROM (SELECT {keys}, unnest(range(len(w))) AS word_ord, unnest(w) AS zip
          FROM (SELECT DISTINCT {keys}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM {texts}))
    WHERE regexp_full_match(zip, '\\p{{Nd}}{{5}}') GROUP BY {keys}, zip"""


def _numbers(sightings: str, keys: str) -> str:
    """First sighting of every valid number per page; sightings are ranked rows with ``raw``."""
    return f"""
    SELECT {keys}, number, row_number() OVER (PARTITION BY {keys} ORDER BY first) - 1 AS number_ord
    FROM (SELECT {keys}, number, min(rank) AS first
          FROM (SELECT {keys}, {_format('raw')} AS number, rank FROM ({sightings}))
          WHERE ({_reason('number')}) IS NULL GROUP BY {keys}, number)"""


def _tel(links: str, keys: str) -> str:
    return f"""
    SELECT {keys}, string_split(href, 'tel:')[-1] AS raw, [0, link_ord, 0, 0] AS rank
    FROM {links} WHERE starts_with(href, 'tel:')"""


def _text(candidates: str, keys: str) -> str:
    return f"SELECT {keys}, raw, [1, block_ord, pattern_ord, match_ord] AS rank FROM {candidates}"


def _is_relevant(href: str) -> str:
    return "(" + " OR ".join(f"contains(lower({href}), '{w}')" for w in LINK_KEYWORDS) + ")"


def _is_social(href: str) -> str:
    return "(" + " OR ".join(f"contains({href}, '{d}')" for d in SOCIAL_DOMAINS) + ")"


def _unwanted(url: str) -> str:
    return "(" + " OR ".join(f"ends_with(lower({url}), '{e}')" for e in UNWANTED_EXTENSIONS) + ")"


def _wide(top: str, key: str, name: str) -> str:
    columns = ", ".join(
        f"max(CASE WHEN rn = {i} THEN number END) AS phone_number_{i}, "
        f"max(CASE WHEN rn = {i} THEN country END) AS country_{i}"
        for i in (1, 2, 3)
    )
    return f"SELECT {key} AS {name}, {columns} FROM {top} GROUP BY {key}"


def _top3(pairs: str, key: str) -> str:
    return f"""
    SELECT * FROM (
      SELECT {key}, number, country, row_number() OVER (PARTITION BY {key} ORDER BY min(rank)) AS rn
      FROM {pairs} GROUP BY {key}, number, country) WHERE rn <= 3"""


_RESOLVED = """
SELECT parent_url, seed_ord, link_ord, href, CASE
  WHEN link = '' THEN parent_url
  WHEN regexp_matches(lower(link), '^https?://') THEN link
  WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(link, '/') THEN parent_url || link
  ELSE parent_url || '/' || link END AS target
FROM (SELECT *, regexp_replace(href, '#.*$', '') AS link FROM home_links)"""

K = "url, page_id"
_PLAN = ", ".join(f"('{r.low}', '{r.high}', '{r.country}', {r.shortest}, {r.longest})" for r in dial_plan())
_FACT_ORDER = "depth, seed_ord, link_ord"

CTES = {
    "seeds": derived.SEEDS,
    "home_pages": derived.HOME_PAGES,
    "crawl_pages": derived.CRAWL_PAGES,
    "web": "SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM crawl_pages",
    "ca_zips": derived.POSTAL_CA,
    "us_zips": derived.POSTAL_US,
    "postal": """SELECT Zip AS zip, CASE WHEN max(src) = 1 THEN 'US' ELSE 'CA' END AS country
        FROM (SELECT Zip, 0 AS src FROM ca_zips UNION ALL SELECT Zip, 1 FROM us_zips) GROUP BY Zip""",
    "plan": f"SELECT * FROM (VALUES {_PLAN}) AS t(low, high, country, shortest, longest)",
    # pages of the crawl
    "first_copies": f"""SELECT {K}, html FROM crawl_pages WHERE NOT {_unwanted('url')}
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
    "links": _links("first_copies", K),
    "texts": _texts("first_copies", K),
    "blocks": _blocks("texts", K),
    "candidates": _candidates("blocks", f"{K}, block_ord"),
    "numbers": _numbers(f"{_tel('links', K)} UNION ALL {_text('candidates', K)}", K),
    "tel_numbers": _numbers(_tel("links", K), K),
    "zips": _zips("texts", K),
    "zip_countries": f"""SELECT {K}, min_by(country, zip_ord) AS zip_country
        FROM zips JOIN postal USING (zip) GROUP BY {K}""",
    "copies": f"SELECT {K}, html FROM crawl_pages WHERE NOT {_unwanted('url')}",
    "copy_texts": _texts("copies", K),
    "copy_blocks": _blocks("copy_texts", K),
    "copy_candidates": _candidates("copy_blocks", f"{K}, block_ord"),
    # texts of nested elements, as the pages are made
    "nested_facts": f"""SELECT 'https://nest' || CAST(o_orderkey AS string) || '.example.com' AS url,
          {derived._AREA.format(k='o_custkey')} AS a, {derived._LINE.format(k='o_orderkey')} AS b,
          {derived._AREA.format(k='o_orderkey')} AS c, {derived._LINE.format(k='o_custkey')} AS d FROM orders""",
    "nested_texts": """SELECT url, unnest(range(1, 8)) AS nth, unnest(['div', 'section', 'p', 'p', 'span', 'li', 'li']) AS tag,
          unnest(['Call ' || a || '-555-' || b || ' or ' || c, a || '-555-' || b, a || '-555-', b, c, c || '.555.' || d, '2']) AS text
        FROM nested_facts""",
    "nested_candidates": _candidates("nested_texts", "url, nth"),
    "nested_found": f"""SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY first) - 1 AS INTEGER) AS number_ord, number
        FROM (SELECT url, number, min(rank) AS first FROM (
                SELECT url, {_format('raw')} AS number, [nth, pattern_ord, match_ord] AS rank FROM nested_candidates)
              WHERE ({_reason('number')}) IS NULL GROUP BY url, number)""",
    # documents and given pages
    "doc_candidates": _candidates("documents", "doc_id"),
    "doc_numbers": _numbers(
        "SELECT doc_id, raw, [pattern_ord, match_ord] AS rank FROM doc_candidates", "doc_id"
    ),
    "doc_zips": _zips("documents", "doc_id"),
    "postal_texts": derived.POSTAL_TEXTS,
    "postal_text_zips": _zips("postal_texts", "doc_id"),
    "doc_countries": """SELECT doc_id, min_by(country, zip_ord) AS zip_country
        FROM doc_zips JOIN postal USING (zip) GROUP BY doc_id""",
    "given_links": _links("pages", K),
    "given_texts": _texts("pages", K),
    "given_blocks": _blocks("given_texts", K),
    "given_candidates": _candidates("given_blocks", f"{K}, block_ord"),
    "given_numbers": _numbers(f"{_tel('given_links', K)} UNION ALL {_text('given_candidates', K)}", K),
    "all_numbers": """SELECT number FROM numbers UNION SELECT number FROM doc_numbers
        UNION SELECT number FROM given_numbers UNION SELECT number FROM nested_found""",
    "e164": """SELECT number, CASE WHEN length(digits) >= 8 THEN digits END AS digits
        FROM (SELECT number, CASE
            WHEN regexp_full_match(number, '1?[0-9]{10}') THEN '1' || right(number, 10)
            WHEN regexp_full_match(number, '\\+[0-9]+') THEN ltrim(number, '+') END AS digits
          FROM all_numbers)""",
    # of all ranges that hold a number the one with most digits counts, whatever its lengths are
    "number_ranges": """SELECT number, digits, max_by({'c': country, 's': shortest, 'l': longest}, [length(low), low::INT - high::INT]) AS r
        FROM e164 JOIN plan ON left(digits, length(low)) BETWEEN low AND high GROUP BY number, digits""",
    "number_countries": """SELECT number, CASE WHEN length(e.digits) BETWEEN r.s AND r.l THEN r.c END AS number_country
        FROM e164 e LEFT JOIN number_ranges USING (number)""",
    "page_pairs": f"""SELECT {K}, number_ord, number, coalesce(zip_country, number_country) AS country
        FROM numbers LEFT JOIN zip_countries USING (url, page_id)
        LEFT JOIN number_countries USING (number)""",
    "doc_pairs": """SELECT source, doc_id, number_ord, number,
          coalesce(zip_country, number_country) AS country, [doc_id, number_ord] AS rank
        FROM doc_numbers JOIN documents USING (doc_id) LEFT JOIN doc_countries USING (doc_id)
        LEFT JOIN number_countries USING (number)""",
    "given_pairs": f"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, number,
          number_country AS country, [page_id, number_ord] AS rank
        FROM given_numbers LEFT JOIN number_countries USING (number)""",
    # the crawl
    "homes": """SELECT 'https://' || domain AS url, min(seed_ord) AS seed_ord FROM seeds GROUP BY 1""",
    "home_links": f"""SELECT url AS parent_url, seed_ord, link_ord, href FROM links JOIN homes USING (url)
        WHERE {_is_relevant('href')} AND NOT {_is_social('href')}""",
    "edges": f"SELECT * FROM ({_RESOLVED}) WHERE target IS NOT NULL AND NOT {_unwanted('target')}",
    "full_parents": "SELECT url FROM page_pairs GROUP BY url HAVING count(*) >= 3",
    "open_edges": "SELECT * FROM edges WHERE parent_url NOT IN (SELECT url FROM full_parents)",
    **{
        name: f"""SELECT * FROM (
            SELECT url, parent_url, depth, seed_ord, link_ord, row_number() OVER (
              PARTITION BY url ORDER BY {_FACT_ORDER}) AS claim FROM (
              SELECT url, url AS parent_url, 0 AS depth, seed_ord, -1 AS link_ord FROM homes
              UNION ALL SELECT target, parent_url, 1, seed_ord, link_ord FROM {edges}))
          WHERE claim = 1"""
        for name, edges in (("owners", "edges"), ("open_owners", "open_edges"))
    },
    "reached": """SELECT o.*, p.page_id FROM open_owners o JOIN first_copies p USING (url)""",
    "crawl_pairs": f"""SELECT parent_url, url, {_FACT_ORDER}, number_ord, number, country,
          [{_FACT_ORDER}, number_ord] AS rank, [{_FACT_ORDER}] AS page_rank
        FROM reached JOIN page_pairs USING (url)""",
    "final": _wide(f"({_top3('crawl_pairs', 'parent_url')})", "parent_url", "url"),
    "first_hit": _wide(
        """(SELECT parent_url, number, country, number_ord + 1 AS rn FROM crawl_pairs c
            WHERE number_ord < 3 AND page_rank = (SELECT min(page_rank) FROM crawl_pairs d
                                                  WHERE d.parent_url = c.parent_url))""",
        "parent_url", "url",
    ),
    # the crawl in which only tel: links count
    "tel_pairs": f"""SELECT {K}, number_ord, number, coalesce(zip_country, number_country) AS country
        FROM tel_numbers LEFT JOIN zip_countries USING (url, page_id)
        LEFT JOIN number_countries USING (number)""",
    "tel_full_parents": "SELECT url FROM tel_pairs GROUP BY url HAVING count(*) >= 3",
    "tel_open_edges": "SELECT * FROM edges WHERE parent_url NOT IN (SELECT url FROM tel_full_parents)",
    "tel_owners": f"""SELECT * FROM (
            SELECT url, parent_url, depth, seed_ord, link_ord, row_number() OVER (
              PARTITION BY url ORDER BY {_FACT_ORDER}) AS claim FROM (
              SELECT url, url AS parent_url, 0 AS depth, seed_ord, -1 AS link_ord FROM homes
              UNION ALL SELECT target, parent_url, 1, seed_ord, link_ord FROM tel_open_edges))
          WHERE claim = 1""",
    "tel_crawl_pairs": f"""SELECT parent_url, number, country, [{_FACT_ORDER}, number_ord] AS rank
        FROM tel_owners JOIN tel_pairs USING (url)""",
    "tel_final": _wide(f"({_top3('tel_crawl_pairs', 'parent_url')})", "parent_url", "url"),
    "found": """SELECT url, (coalesce(phone_number_1, '') <> '')::INT
          + (coalesce(phone_number_2, '') <> '')::INT + (coalesce(phone_number_3, '') <> '')::INT AS found
        FROM final""",
    "numbered": """SELECT f.*, CAST(row_number() OVER (ORDER BY seed_ord) AS VARCHAR) AS serial
        FROM final f JOIN homes USING (url)""",
}


def _sql(body: str) -> str:
    """Put the common table expressions that ``body`` names, and theirs, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(*{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    heads = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return f"WITH {heads} {body}" if heads else body


_EXPORT = ", ".join(
    f"coalesce({c}, '') AS \"{n}\""
    for c, n in [
        ("serial", "Sl"), ("url", "Website"),
        *[(f"{c}_{i}", f"{n} {i}") for i in (1, 2, 3)
          for c, n in (("phone_number", "Phone Number"), ("country", "Country"))],
    ]
)
_TOTALS = """SELECT count(*) AS urls_processed, sum(found) AS found, sum(3 - found) AS not_found,
    round(100.0 * sum(found) / (3 * count(*)), 2) AS success_rate FROM """
_ALL_CANDIDATES = """(SELECT raw FROM doc_candidates UNION ALL SELECT raw FROM copy_candidates
    UNION ALL SELECT raw FROM given_candidates)"""
_FORMATTED = f"(SELECT raw, {_format('raw')} AS number FROM {_ALL_CANDIDATES})"
_CHECKED = f"(SELECT raw, number, {_reason('number')} AS reason FROM {_FORMATTED})"
_FINAL_COLUMNS = "url, phone_number_1, country_1, phone_number_2, country_2, phone_number_3, country_3"

BODIES = {
    "seed_domains": "SELECT row_number() OVER (ORDER BY seed_ord) - 1 AS seed_ord, domain FROM seeds",
    "single_seed": "SELECT seed_ord, domain FROM seeds WHERE domain = 'site7.example.com'",
    "seed_urls": "SELECT seed_ord, domain, 'https://' || domain AS url FROM seeds",
    "postal_reference_build": """SELECT Zip, 'CA' AS Country FROM ca_zips
        UNION ALL SELECT Zip, 'US' FROM us_zips""",
    "postal_reference_load": "SELECT zip, country FROM postal",
    "pages_scan": "SELECT page_id, url, length(html) AS html_chars FROM pages",
    "unwanted_extension_filter": f"SELECT page_id, url FROM web WHERE NOT {_unwanted('url')}",
    "visited_dedupe": "SELECT url, parent_url, depth, seed_ord, link_ord FROM owners",
    "page_links": """SELECT url, page_id, link_ord, href FROM given_links
        UNION ALL SELECT url, page_id, link_ord, href FROM links JOIN homes USING (url)""",
    "relevant_link_filter": f"""SELECT url, link_ord, href FROM links JOIN homes USING (url)
        WHERE {_is_relevant('href')}""",
    "social_link_filter": f"""SELECT url, link_ord, href FROM links JOIN homes USING (url)
        WHERE NOT {_is_social('href')}""",
    "internal_link_flag": """SELECT url, link_ord, href, starts_with(href, '/') OR contains(href, url) AS internal
        FROM links JOIN homes USING (url)""",
    "tel_link_numbers": """SELECT url, link_ord, string_split(href, 'tel:')[-1] AS raw
        FROM links WHERE starts_with(href, 'tel:')""",
    "text_blocks": """SELECT url, page_id, block_ord, text FROM given_blocks
        UNION ALL SELECT url, page_id, block_ord, text FROM copy_blocks""",
    "pattern_candidates": """SELECT doc_id, pattern_ord, match_ord, raw FROM doc_candidates""",
    "pattern_candidates_html": """SELECT url, page_id, block_ord, pattern_ord, match_ord, raw
        FROM given_candidates UNION ALL
        SELECT url, page_id, block_ord, pattern_ord, match_ord, raw FROM copy_candidates""",
    "zip_codes": "SELECT url, page_id, zip_ord, zip FROM zips",
    "zip_codes_text": "SELECT doc_id, zip_ord, zip FROM postal_text_zips",
    "contacts_tel_only": "SELECT * FROM tel_final",
    "parent_text_filter": "SELECT url, page_id, number_ord, number FROM tel_numbers",
    "format_number": f"SELECT raw, number, count(*) AS n FROM {_FORMATTED} GROUP BY raw, number",
    "valid_number": f"""SELECT DISTINCT number, reason IS NULL AS valid, reason FROM {_CHECKED}""",
    "rejection_breakdown": f"""SELECT coalesce(reason, 'valid') AS reason, count(*) AS n
        FROM {_CHECKED} GROUP BY 1""",
    "country_from_zip": "SELECT url, page_id, zip_country FROM zip_countries",
    "country_from_number": """SELECT number, number_country AS country FROM number_countries
        WHERE number IN (SELECT number FROM numbers UNION SELECT number FROM doc_numbers
                         UNION SELECT number FROM given_numbers)""",
    "country_resolve": "SELECT url, page_id, number_ord, number, country FROM page_pairs",
    "link_frontier": """SELECT parent_url, o.url, link_ord FROM owners o
        JOIN first_copies p ON o.url = p.url WHERE depth = 1""",
    "frontier_early_stop": "SELECT parent_url, url, depth, link_ord FROM reached",
    "new_pairs": """SELECT DISTINCT parent_url, number, country FROM crawl_pairs c WHERE depth = 1
        AND NOT EXISTS (SELECT 1 FROM crawl_pairs h WHERE h.depth = 0 AND h.parent_url = c.parent_url
          AND h.number = c.number AND h.country IS NOT DISTINCT FROM c.country)""",
    "page_number_dedupe": "SELECT url, page_id, number_ord, number FROM numbers",
    "contacts_final": f"SELECT {_FINAL_COLUMNS} FROM final",
    "contacts_first_hit": f"SELECT {_FINAL_COLUMNS} FROM first_hit",
    "contacts_per_site": _wide(f"({_top3('doc_pairs', 'source')})", "source", "source"),
    "contacts_per_host": _wide(f"({_top3('given_pairs', 'host')})", "host", "host"),
    "top3_per_key": _top3("doc_pairs", "source"),
    "pairs_to_columns": _wide(
        "(SELECT url, number, country, number_ord + 1 AS rn FROM page_pairs WHERE number_ord < 3)",
        "url", "url",
    ),
    "found_not_found": "SELECT url, found, 3 - found AS not_found FROM found",
    "contact_totals": f"{_TOTALS} found",
    "progress": """SELECT (SELECT count(*) FROM final) AS urls_processed,
        (SELECT count(*) FROM seeds) AS total_domains,
        100.0 * (SELECT count(*) FROM final) / (SELECT count(*) FROM seeds) AS progress""",
    "serial_number": "SELECT serial, url FROM numbered",
    "export_projection": f"SELECT {_EXPORT} FROM numbered",
    "csv_sink": f"SELECT {_EXPORT} FROM numbered",
    "array_to_columns": """SELECT url, max(CASE WHEN number_ord = 0 THEN number ELSE '' END) AS phone_number1,
        max(CASE WHEN number_ord = 1 THEN number ELSE '' END) AS phone_number2,
        max(CASE WHEN number_ord = 2 THEN number ELSE '' END) AS phone_number3
        FROM numbers GROUP BY url""",
    "stream_visited": "SELECT DISTINCT target AS url FROM edges",
    "stream_contacts": _wide(f"({_top3('feed_pairs', 'parent_url')})", "parent_url", "url"),
    "stream_first_hit": f"SELECT {_FINAL_COLUMNS} FROM feed_first",
    "nested_text_blocks": "SELECT url, CAST(nth AS INTEGER) AS nth, tag, text FROM nested_texts",
    "nested_numbers": "SELECT url, number_ord, number FROM nested_found",
    "contacts_nested": _wide("""(SELECT url, number, number_country AS country, number_ord + 1 AS rn FROM nested_found
        LEFT JOIN number_countries USING (number) WHERE number_ord < 3)""", "url", "url"),
    "nested_parent_filter": "SELECT pattern_ord, count(*) AS n, 0::BIGINT AS n_left FROM nested_candidates GROUP BY pattern_ord",
    "stream_csv_feed": "SELECT url, " + ", ".join(
        f"coalesce({c}, '') AS {c}" for c in _FINAL_COLUMNS.split(", ")[1:]
    ) + " FROM feed_first",
    "pages_cached": """SELECT url, length(html) AS html_chars FROM pages
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
    "contacts_resumed": f"SELECT {_FINAL_COLUMNS} FROM final",
    "stream_totals": f"""{_TOTALS} (SELECT (phone_number_1 IS NOT NULL)::INT
        + (phone_number_2 IS NOT NULL)::INT + (phone_number_3 IS NOT NULL)::INT AS found
        FROM feed_first)""",
    "stream_restart": "SELECT DISTINCT target AS url FROM edges",
}

# The feed that streams read: of a url's copies the first of the batch in which it first comes.
CTES |= {
    "feed_pages": f"""SELECT * FROM ({derived.FEED_PAGES}) WHERE NOT {_unwanted('url')}
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, page_id) = 1""",
    "feed_links": _links("feed_pages", K),
    "feed_texts": _texts("feed_pages", K),
    "feed_blocks": _blocks("feed_texts", K),
    "feed_candidates": _candidates("feed_blocks", f"{K}, block_ord"),
    "feed_numbers": _numbers(
        f"{_tel('feed_links', K)} UNION ALL {_text('feed_candidates', K)}", K
    ),
    "feed_zips": _zips("feed_texts", K),
    "feed_countries": f"""SELECT {K}, min_by(country, zip_ord) AS zip_country
        FROM feed_zips JOIN postal USING (zip) GROUP BY {K}""",
    "feed_pairs": """SELECT parent_url, batch, n.page_id, number_ord, number,
          coalesce(zip_country, number_country) AS country, [n.page_id, number_ord] AS rank
        FROM feed_numbers n JOIN feed_pages p ON n.url = p.url
        LEFT JOIN feed_countries z ON n.url = z.url LEFT JOIN number_countries USING (number)""",
    "feed_first": _wide(
        """(SELECT parent_url, number, country, number_ord + 1 AS rn FROM feed_pairs
            JOIN (SELECT parent_url, arg_min(page_id, [batch, page_id]) AS page_id FROM feed_pairs GROUP BY parent_url)
              USING (parent_url, page_id) WHERE number_ord < 3)""",
        "parent_url", "url",
    ),
}
CTES["all_numbers"] += " UNION SELECT number FROM feed_numbers"


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
